"""Credentials in code: a trigram index names candidates, detection regexes verify only those.

The index is a table of postings (gram, chunk), written once; the grams are those that the detection regexes require. The
postings of a regex are intersected in Spark, and only texts of candidates are read by the regexes that named them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodeflow.llm.grams import folded, required_grams
from lodeflow.session import spread, written

# Names under which credentials stand, words that are no credential, and token forms.
NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|tok|api_?key|apikey|access_?key|auth_?key|svc_?key|maps_?key|app_?key"
    r"|(?<=[a-z_])key|signing_?key|private_?key|encryption_?key|credential|creds?)"
)
# Looked for in names whose words are in lower case and joined by underscores: whole words, or the end of one that names a credential.
NOT_NAMES = (
    r"(?:^|_)(?:[a-z0-9]*hash(?:es|ed)?|(?:password|passwd|pass|pwd|pw|secret|token|key|creds?)?(?:digests?|checksums?|etags?|lengths?|counts?|ttl|expir\w*)|polic(?:y|ies)|min|max|pub)(?:_|$)"
    r"|(?:^|_)(?:(?:ssh|rsa|gpg|pgp)?pub(?:lic|key)|tokenizer|token_row|(?:primary|foreign|sort|cache)_?key)|_(?:len|files?|paths?|urls?|types?)(?:_|$)|_id$|name$"
)
PLACEHOLDER = (
    r"(?i)^(?:<.*>|\$\{.*|\$[A-Z_]+|\{\{.*|%\(.*|%[A-Z_]+%|\[.*\]|x+|\*+|\.+|-+|_+|0+|change[_-]?(?:me|it)|replace[_-]?(?:me|this|with.*)|redacted|masked|hidden|secret|password|passwd"
    r"|token|key|your[_\-\s].*|my[_\-].*|insert[_\-\s].*|enter[_\-\s].*|put[_\-\s].*|todo.*|tbd|dummy.*|sample.*|example.*|placeholder.*|fake.*|test|none|null|nil|undefined|true|false"
    r"|str|string|number|boolean|bool|any|bytes|object|(?:vault|env|ssm|secretsmanager|arn|keyring|op)[:/].*|.*\{\{.*\}\}.*|.*_here)$"
)
FORMS = (
    r"A(?:KI|SI)A[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[0-9A-Za-z]{20,}",
    r"github_pat_[0-9A-Za-z_]{22,}",
    r"npm_[0-9A-Za-z]{30,}",
    r"pypi-[0-9A-Za-z_\-]{16,}",
    r"SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}",
    r"rk_live_[0-9A-Za-z]{8,}",
    r"zk_(?:live|test)_[0-9A-Za-z]{8,}",
    r"eyJ[0-9A-Za-z_\-]{8,}\.eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}",
    r"xox[abprs]-[0-9A-Za-z\-]{10,}",
    r"AIza[0-9A-Za-z_\-]{30,}",
    r"sk_live_[0-9A-Za-z]{8,}",
    r"glpat-[0-9A-Za-z_\-]{16,}",
)
#: Shorter values let no one in.
LEAST_VALUE = 4
# Words of messages: a value of several words is no passphrase if it holds one.
PROSE = r"(?i)\b(?:the|a|an|is|are|was|be|must|should|may|can(?:not)?|please|enter|invalid|required?|missing|your|my|for|to|and|or|of|in|on|at|by|not|no|wrong|failed|error|expired|forgot|reset|with|from|login|log|sign|user|default|see|set|use)\b"
QUOTED = r"(?:\"(?P<a>[^\"\n]*)\"|'(?P<b>[^'\n]*)'|`(?P<c>[^`\n]*)`)"


@dataclass(frozen=True)
class Detector:
    """A detection regex whose filled named group (or whole match) is the credential."""

    name: str
    pattern: str
    named: bool = False


_ASSIGN = rf"(?i)(?P<name>{NAME}\w*)[\"']?\]?\s*(?:===?|!==?|:=|=>|=|:)\s*[rbfu]?"
# What follows a slash without blanks in a path, a ratio or a date rather than in a login.
_PATH = r"(?-i:\S*/|[a-z_\-]+(?:\.[a-z]{1,5})?[,;)]?(?:\s|$)|\d+[.,;)]?(?:\s|$))"
DETECTORS = (
    Detector("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    Detector("assignment", _ASSIGN + QUOTED, named=True),
    Detector("short_name", r"(?i)(?P<name>\b(?:\w*[_\W])?pw)[\"']?\s*(?:===?|!==?|=|:)\s*" + QUOTED),
    Detector("camel_pw", r"(?P<name>\b\w*[a-z](?:Pw|Pwd|Pass))[\"']?\s*(?:===?|!==?|=|:)\s*" + QUOTED),
    Detector("pieces", r"(?i)(?P<name>\b[\w.]*(?:key|" + NAME + r")\w*)\s*[=:]\s*(?:\"(?P<a>[^\"\n]+\"\s*(?:\+|\.|\\\n)\s*\"[^\"\n]+(?:\"\s*\+\s*\"[^\"\n]+)*)\"|'(?P<b>[^'\n]+'\s*(?:\+|\.|\\\n)\s*'[^'\n]+(?:'\s*\+\s*'[^'\n]+)*)')"),
    Detector("argument", r"(?i)[\"'](?P<name>[\w.\-]*" + NAME + r"\w*)[\"']\s*,\s*" + QUOTED, named=True),
    Detector("client", r"\b\w*(?:Client|Session|Api|connect|Connection)\w*\(\s*[\"'][^\"'\n]*[\"']\s*,\s*" + QUOTED),
    Detector("export", r"(?im)(?:^|\s)(?:export|set|env)\s+(?P<name>\w*" + NAME + r"\w*)=(?P<a>[^\s\"'`;&|]+)", named=True),
    Detector("property", r"(?im)^[ \t]*(?:-[ \t]+)?(?P<name>[\w.\-]*" + NAME + r"\w*)[ \t]*(?::[ \t]+|(?<=[A-Z])=)(?P<a>[^\s\"'`;,(\[{]+)[ \t]*(?:#.*)?$", named=True),
    Detector("url_user", r"[a-z][a-z0-9+.\-]*://[^\s:/@\"'`]*:(?P<a>[^\s@\"'`/]+)@"),
    Detector("url_query", r"(?i)[?&](?P<name>(?:[\w\-]*(?:key|token|sig|signature|secret|password|pass|auth|code)))=(?P<a>[^&\s\"'`#]{6,})"),
    Detector("scheme", r"(?i)\b(?:basic|bearer|token|apikey)\s+(?P<a>[0-9A-Za-z+/=._~\-]{10,})"),
    Detector("sql", r"(?i)\b(?:identified\s+by|(?:with|set|encrypted)\s+password|password\s+(?:to|for\s+\S+))\s*=?\s*" + QUOTED),
    Detector("option", r"(?i)--(?:password|passwd|pass|pwd|token|secret|api-key|apikey)(?:=|\s+)(?P<a>[^\s\"'`]+)"),
    Detector("mysql_option", r"\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass)\b[^\"'`\n]*?\s-p(?P<a>[^\s\"'`\-][^\s\"'`]*)"),
    Detector("comment", r"(?im)(?:#|//|/\*|--|\*).*?\b(?:logins?|creds?|credentials|tmp|temp|account|user|staging)\b[^:\n]*:[ \t]*[^\s/]+(?:[ \t]+/[ \t]*|/[ \t]+|/(?!" + _PATH + r"))(?P<a>[^\s/]+)"),
    *(Detector(f"form_{i}", rf"(?<![0-9A-Za-z_\-])(?P<a>{form})") for i, form in enumerate(FORMS)),
)


def _words_of(name: str) -> str:
    """The words of a name in lower case, joined by underscores: split at camel case and at other characters."""
    return re.sub(r"[\W_]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)).lower()


def _is_secret(value: str, name: str, detector: Detector) -> bool:
    """Whether the value is a live literal rather than a placeholder, a reference or a digest."""
    joined = re.sub(r"[\"']\s*(?:\+|\.|\\\n)\s*[\"']", "", value) if detector.name == "pieces" else value
    if len(joined.strip()) < LEAST_VALUE or re.match(PLACEHOLDER, joined.strip()):
        return False
    if name and re.search(NOT_NAMES, _words_of(name)):
        return False
    if joined.startswith(("$2a$", "$2b$", "$2y$", "$argon2", "sha256:", "sha1:", "sha512:", "md5:", "{SHA", "-----BEGIN", "data:", "http://", "https://", "ssh-rsa")):
        return False
    if detector.name in ("property", "export") and re.search(r"\(|\[|^\$|^os\.|^process\.|\.env\b", joined):
        return False
    if detector.name in ("client", "argument") and re.search(r"\s|^[a-z_]+$|^[a-z]+(?:[./:][a-z_]+)+$|^[A-Z_]+$", joined):
        return False
    if detector.name in ("assignment", "short_name", "camel_pw", "scheme") and (
        re.search(r"^\s*$|^[a-z_]+/[a-z_/]+$", joined) or (re.search(r"\s\S.*\s", joined) and (re.search(PROSE, joined) or not re.fullmatch(r"[\w.\-!@#$%^&*+]+(?: [\w.\-!@#$%^&*+]+)+", joined)))
    ):
        return False
    if detector.name in ("scheme", "url_query") and not re.search(r"[0-9]", joined) and len(set(joined)) < 8:
        return False
    if detector.name == "scheme" and re.fullmatch(r"[a-z]+|[a-z_.]+", joined):
        return False
    return True


def find_spans(text: str, detectors: list[int] | None = None) -> list[tuple[int, int]]:
    """Spans of the credential values of a text, in order; of spans that overlap the longest stays."""
    spans = []
    for i in range(len(DETECTORS)) if detectors is None else detectors:
        detector = DETECTORS[i]
        for m in _compiled(i).finditer(text):
            groups = m.groupdict()
            value = next((k for k in ("a", "b", "c") if groups.get(k) is not None), None)
            start, end = m.span(value) if value else m.span()
            if value is None and detector.name != "private_key":
                continue
            name = groups.get("name") or ""
            if name:
                head = m.start("name")
                while head and (text[head - 1].isalnum() or text[head - 1] in "_.-"):
                    head -= 1
                name = text[head : m.start("name")] + name
            if value is None or _is_secret(text[start:end], name, detector):
                spans.append((start, end))
    spans.sort(key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int]] = []
    for s in spans:
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


_CACHE: dict[int, re.Pattern] = {}


def _compiled(i: int) -> re.Pattern:
    if i not in _CACHE:
        _CACHE[i] = re.compile(DETECTORS[i].pattern)
    return _CACHE[i]


#: Grams in one word of a bitmap.
WORD = 63


class GramIndex:
    """The dictionary of required grams, and the alternatives of each detector as bit masks over it."""

    def __init__(self) -> None:
        required = [required_grams(d.pattern) for d in DETECTORS]
        self.grams = sorted({g for alternatives in required for a in alternatives for g in a})
        bit = {g: 1 << i for i, g in enumerate(self.grams)}
        self.alternatives = [[sum(bit[g] for g in a) for a in alternatives] for alternatives in required]
        self.automaton = ahocorasick.Automaton()
        for i, g in enumerate(self.grams):
            self.automaton.add_word(g, i)
        self.automaton.make_automaton()

    def postings(self, text: str) -> set[int]:
        """The numbers of the grams that a chunk holds, whatever the case."""
        return {i for _, i in self.automaton.iter(folded(text))}

    def detectors(self, text: str) -> list[int]:
        """The detectors for which the chunk lies in all postings of some alternative."""
        found = sum(1 << i for i in self.postings(text))
        return [i for i, masks in enumerate(self.alternatives) if any(found & m == m for m in masks)]


def records(df: DataFrame, table: str, record_id: str, text: str) -> DataFrame:
    """The texts that are searched: record_table, record_id, text, chunk.

    A chunk is a whole text, as a credential may run over many lines; ``chunk`` is its key in the index. Null and empty texts are left out.
    """
    rows = df.where(F.length(F.col(text)) > 0).select(F.lit(table).alias("record_table"), F.col(record_id).cast("bigint").alias("record_id"), F.col(text).alias("text"))
    return rows.withColumn("chunk", F.xxhash64("record_table", "record_id", "text"))


def gram_postings(rows: DataFrame) -> DataFrame:
    """The index of some records: gram, chunk; written once, then searched by any pattern whose grams are in the dictionary."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = GramIndex()
        for batch in batches:
            chunks, grams = [], []
            for chunk, text in zip(batch["chunk"], batch["text"], strict=True):
                found = index.postings(text)
                chunks += [chunk] * len(found)
                grams += found
            yield pd.DataFrame({"chunk": pd.Series(chunks, dtype="int64"), "gram": pd.Series(grams, dtype="int16")})

    return spread(rows.select("chunk", "text")).mapInPandas(post, "chunk bigint, gram smallint")


def _in_all(masks: list[int], words: int) -> Column:
    """Whether the bitmap ``w0``, ``w1``, ... holds all bits of one of the masks."""
    low = (1 << WORD) - 1
    one = lambda m: reduce(Column.__and__, (F.col(f"w{k}").bitwiseAND(F.lit(part)) == part for k in range(words) if (part := m >> WORD * k & low)))
    return reduce(Column.__or__, map(one, masks))


def candidates(postings: DataFrame) -> DataFrame:
    """Intersect the postings: chunk, detectors (those for which the chunk is in all postings of some alternative).

    Postings are combined to a bitmap per chunk before the shuffle; the masks they are compared with are the dictionary's.
    """
    index = GramIndex()
    words = len(index.grams) // WORD + 1
    bit = F.expr(f"shiftleft(1L, gram % {WORD})")
    maps = postings.groupBy("chunk").agg(*(F.bit_or(F.when(F.floor(F.col("gram") / WORD) == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(words)))
    named = F.array_compact(F.array(*(F.when(_in_all(masks, words), F.lit(i)) for i, masks in enumerate(index.alternatives))))
    return maps.select("chunk", named.alias("detectors")).where(F.size("detectors") > 0)


def verify(rows: DataFrame, named: DataFrame) -> DataFrame:
    """One row per credential in the candidates' texts: record_table, record_id, secret_start, secret_end.

    Rows without candidates' keys fall out in the join; no other text is read by a regex. Re-delivered records count once.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(t, r, s, e) for t, r, x, d in zip(batch["record_table"], batch["record_id"], batch["text"], batch["detectors"], strict=True) for s, e in find_spans(x, list(d))]
            yield pd.DataFrame(found, columns=["record_table", "record_id", "secret_start", "secret_end"]).astype({"record_id": "Int64"})

    chosen = rows.join(named, "chunk").select("record_table", "record_id", "text", "detectors")
    return chosen.mapInPandas(search, "record_table string, record_id bigint, secret_start int, secret_end int").distinct()


def find_secrets(rows: DataFrame) -> DataFrame:
    """Credentials in ``records``: record_table, record_id, secret_start, secret_end (characters from 0, end exclusive).

    The postings are written once, intersected, and the candidates verified. Records with a null id are searched too.
    """
    return verify(rows, candidates(written(gram_postings(rows), "grams")))


def redact_records(rows: DataFrame, mark: str = "REDACTED") -> DataFrame:
    """record_table, record_id, redacted: all records, the credentials of candidates blanked out; re-deliveries once.

    Line breaks within a credential stay, so that line numbers hold. Texts that aren't candidates never leave the JVM.
    """
    named = candidates(written(gram_postings(rows), "grams"))
    joined = rows.join(named, "chunk", "left").dropDuplicates(["chunk", "record_table", "record_id"])

    def blank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [_blanked(x, list(d), mark) for x, d in zip(batch["text"], batch["detectors"], strict=True)]
            yield batch[["record_table", "record_id"]].astype({"record_id": "Int64"}).assign(redacted=texts)

    plain = joined.where("detectors is null").select("record_table", "record_id", F.col("text").alias("redacted"))
    chosen = joined.where("detectors is not null").select("record_table", "record_id", "text", "detectors")
    return plain.unionByName(chosen.mapInPandas(blank, "record_table string, record_id bigint, redacted string"))


def _blanked(text: str, detectors: list[int], mark: str) -> str:
    for s, e in reversed(find_spans(text, detectors)):
        text = text[:s] + mark + "\n" * text[s:e].count("\n") + text[e:]
    return text


def redact(df: DataFrame, text: str, out: str = "redacted", mark: str = "REDACTED") -> DataFrame:
    """Add the text of each row with every credential value replaced by a mark, for streams and other texts without an index.

    Line breaks within a private key stay, so that line numbers hold. Null stays null.
    """

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        index = GramIndex()

        return texts.map(lambda t: _blanked(t, index.detectors(t), mark), na_action="ignore")

    return df.withColumn(out, blank(F.col(text)))
