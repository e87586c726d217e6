"""Personal information in free text: protected entities, and terms that disclose persons.

E-mail addresses, phone numbers, identity numbers and street addresses have forms of their own.
Names have none, so the corpus decides: the co-occurrence of each term with slots that hold a
protected person (after "reported by", in a signature, ...) gives how strongly it reveals one.
Name-shaped spans whose terms exceed the disclosure threshold are names; all found items are replaced by
placeholders of their type.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodeflow.session import spread, written

#: Share of the greatest possible information about a person that a term must give (in a slot, elsewhere).
DISCLOSURE, DISCLOSURE_ELSEWHERE = 0.6, 0.85
#: How often a term must stand in a slot before it is believed elsewhere.
SUPPORT_ELSEWHERE = 2

# Forms and labels of personal data.
_S = r"[ \t]*\n?[ \t]*"
_SP = r"(?:[ \t]+|[ \t]*\n[ \t]*)"
_AT = rf"(?:@|{_SP}?[(\[{{]{_SP}?(?:at|AT|ät){_SP}?[)\]}}]{_SP}?|{_SP}AT{_SP}|%40|&#64;)"
_DOT = rf"(?:\.|{_SP}?[(\[{{]{_SP}?(?:dot|DOT|punkt){_SP}?[)\]}}]{_SP}?|{_SP}DOT{_SP})"
EMAIL = re.compile(
    rf"(?<![\w.+%/\-])(?P<local>\w[\w.+%\-]*?){_AT}(?P<host>[^\W_][\w\-]*(?:{_DOT}[^\W_][\w\-]*)*{_DOT}[^\W\d_]{{2,}})(?![\w\-])(?P<after>:[\w/]|/)?"
)
SERVICE = r"(?i)^(?:git|svn|hg|noreply|no-reply|donotreply|mailer-daemon|postmaster|root|ci|bot|builds?|www|nobody)$"
_EXT = r"(?:,?\s*(?:ext\.?|x|extension|Durchwahl|poste)\s*\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w.+/\-])(?:"
    r"(?:\+1[ .\-\n]|001[ .\-]?)?\(\d{3}\)\s?\d{3}[.\-\s]\d{4}"
    r"|\+1[ .\-\n]?\d{3}[ .\-\n]\d{3}[ .\-\n]\d{4}"
    r"|00\d{1,3}[ \-/]?\d{6,12}"
    r"|\d{3}([.\-])\d{3}\1\d{4}"
    r"|[2-9]\d{2}[ \n][2-9]\d{2}[ \n\-]\d{4}"
    r"|\+\d{1,3}[ \n.\-]?\(?\d{1,4}\)?(?:[ \n.\-/]?\d{2,8}){1,4}"
    r"|0\d{2,5}/\d{3,9}(?:-\d{1,6})?"
    r"|0\d(?:[ .\n]\d{2}){4}"
    r"|0\d{2,4}[ \n]\d{3,4}[ \n]\d{3,4}"
    r"|[2-9]\d{2}-\d{4}"
    rf"){_EXT}(?![\w\-])"
)
_LABEL = (
    r"(?:social" + _SP + r"security" + _SP + r"(?:number|no\.?)|ssn|tin|tax" + _SP + r"(?:no\.?|id|number)|passport(?:" + _SP + r"(?:no\.?|number))?"
    r"|national" + _SP + r"(?:id|identity" + _SP + r"number|insurance" + _SP + r"number)|id" + _SP + r"card(?:" + _SP + r"(?:no\.?|number))?|personal" + _SP + r"number"
    r"|driving" + _SP + r"licen[cs]e(?:" + _SP + r"(?:no\.?|number))?|driver'?s" + _SP + r"licen[cs]e|ausweisnummer|personalausweis|steuernummer|steuer-?id|reisepass(?:nummer)?"
    r"|documento" + _SP + r"de" + _SP + r"identidad|pièce" + _SP + r"d'identité|dni|nif|nie|número" + _SP + r"de" + _SP + r"(?:identidad|pasaporte)|pasaporte|numéro" + _SP + r"de" + _SP + r"(?:sécurité" + _SP + r"sociale|passeport)|passeport)"
)
LABELLED_ID = re.compile(rf"(?i)\b{_LABEL}(?!\w)[\"']?(?:{_SP}?[:=#]|{_SP}(?:is|ist|es|est|:))?{_SP}?[\"']?(?P<id>(?=[A-Z/\-]{{0,6}}\d)(?:\d{{4}}[ \n]\d{{4}}[ \n]\d{{4}}|[A-Z\d]+(?:[\-/][A-Z\d]+)*))(?![\w\-/])")
BARE_ID = re.compile(r"(?<![\w/\-.])(?P<id>(?!000|123-45)\d{3}-\d{2}-\d{4}|\d{2}/\d{3}/\d{5}|\d{8}-[A-Z]|\d{6}-\d{4}|[A-Z]{5}\d{6}[A-Z]{2})(?![\w/\-])")
_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_TOWN = rf"{_CAP}(?:{_SP}{_CAP})?"
_KIND = r"(?:[Ss]t(?:reet)?|[Aa]ve(?:nue)?|[Bb]lvd|[Bb]oulevard|[Rr]oad|[Rr]d|[Ll]ane|[Ll]n|[Dd]rive|[Dd]r|[Cc]ourt|[Ct]t|[Ww]ay|[Pp]lace|[Pp]l|[Rr]ow|[Tt]errace|[Cc]rescent|[Cc]lose|[Ss]quare|[Gg]ardens|[Mm]ews|[Hh]ill|[Pp]ark)\.?"
_UNIT = rf"(?:,{_SP}(?:Apt|Apartment|Suite|Unit|Flat|Floor|#)\.?{_SP}?\w+)?"
_POSTCODE = r"(?:[A-Z]{1,2}\d[A-Z\d]?[ \n]\d[A-Z]{2}|[A-Z]{2}[ \n]\d{5}(?:-\d{4})?|\d{4,5}(?:-\d{4})?)"
_STATE_ZIP = rf"(?:,{_SP}[A-Z]{{2}}{_SP}\d{{5}}(?:-\d{{4}})?|,?{_SP}{_POSTCODE})?"
ADDRESS = re.compile(
    r"(?<![\w/.\-])(?:"
    rf"(?:(?:Flat|Apt|Apartment|Unit){_SP}\w+,{_SP})?\d{{1,5}}[A-Za-z]?{_SP}{_CAP}(?:{_SP}{_CAP})?{_SP}{_KIND}{_UNIT},{_SP}{_TOWN}{_STATE_ZIP}"
    rf"|\d{{1,4}}(?:{_SP}?(?:bis|ter))?,?{_SP}(?:rue|avenue|allée|boulevard|place|chemin|impasse|quai|cours|route){_SP}(?:(?:de{_SP}la|du|des|de|d'|de{_SP}l'){_SP}?)?{_CAP}(?:{_SP}{_CAP})?,{_SP}\d{{5}}{_SP}{_TOWN}"
    rf"|{_CAP}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer){_SP}\d{{1,4}}{_SP}?[a-z]?,{_SP}\d{{4,5}}{_SP}{_TOWN}"
    rf"|{_CAP}{_SP}(?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz){_SP}\d{{1,4}}{_SP}?[a-z]?,{_SP}\d{{4,5}}{_SP}{_TOWN}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Av\.|C/){_SP}(?:(?:de{_SP}la|del|de|los|las){_SP})?{_CAP}(?:{_SP}{_CAP})?,?{_SP}\d{{1,4}}{_SP}?[A-Za-z]?,{_SP}\d{{4,5}}{_SP}{_TOWN}"
    r")(?!\w)"
)
_TITLE = rf"(?:(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mx|Sir|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Don|Doña|Ing|Dipl)\.?{_SP})*"
_W = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_NAME = rf"(?P<name>[A-ZÀ-Þ]\.{_SP}(?:[A-ZÀ-Þ]\.{_SP})?{_W}|{_W},{_SP}{_W}(?:{_SP}[A-ZÀ-Þ]\.)?|{_W}{_SP}(?:[A-ZÀ-Þ]\.{_SP})?{_W})"
_BEFORE = (
    rf"(?:\b(?:[Rr]eported|[Aa]pproved|[Rr]eviewed|[Aa]ssigned|[Ww]ritten|[Ss]igned|[Rr]aised|[Ff]iled){_SP}(?:off{_SP})?(?:by|to){_SP}|\b(?:[Oo]wner|[Aa]uthor|[Cc]ontact|[Rr]eporter|[Aa]ssignee|[Kk]ontakt|[Cc]ustomer|[Aa]ttn|[Nn]ame):{_SP}"
    rf"|\b(?:customer|caller|employee|user|patient|Kundin|Kunde|cliente|client),{_SP}|\battention{_SP}|\bof{_SP}the{_SP}dump:{_SP}|\breviewed{_SP}with{_SP}|\b[Gg]emeldet{_SP}von{_SP}|\b[Ss]ignalé{_SP}par{_SP}"
    rf"|\bcomunicó{_SP}|\bgehört{_SP}zu{_SP}|(?:^|[\n ])--[ \t]*\n[ \t]*)"
)
SLOT_AFTER = re.compile(_BEFORE + _TITLE + _NAME)
SLOT_SECOND = re.compile(rf"\G{_SP}(?:and|und|et|y){_SP}".replace(r"\G", "") + _TITLE + _NAME + rf"(?={_SP}on{_SP}the{_SP}call)")
SAID = re.compile(rf"{_SP}(?:disagreed|agreed|objected|signed{_SP}off|complained|called{_SP}back){_SP}(?:with|that|to|about){_SP}")
NAMED_BEFORE = re.compile(rf"(?<![\w,]){_TITLE}" + _NAME + r"\Z")
# The words that slots begin with: the grammar is tried where one of them stands.
_CUES = (
    "Reported reported Approved approved Reviewed reviewed Assigned assigned Written written Signed signed Raised raised Filed filed Owner owner Author author Contact contact Reporter reporter"
    " Assignee assignee Kontakt kontakt Customer customer Attn attn Name name caller employee user patient Kundin Kunde cliente client attention of Gemeldet gemeldet Signalé signalé comunicó gehört --"
).split()
_VERBS = ("greed", "objected", "signed", "complained", "called")
# All ways in which the grammar of addresses writes the sign.
_AT_SIGNS = re.compile(r"@|%40|&#64;|(?<=\s)AT(?=\s)|[(\[{]\s*(?:at|AT|ät)\s*[)\]}]")
_LOCAL = re.compile(r"[\w.+%\-]")
# The words that labels of identity numbers begin with.
_LABELS = "social ssn tin tax passport national id personal driving driver ausweisnummer steuer reisepass documento pièce dni nif nie número pasaporte numéro passeport".split()
SHAPED = re.compile(rf"(?<![\w.@/\-])(?=(?P<name>(?:[A-ZÀ-Þ]\.{_SP}){_CAP}|{_CAP},{_SP}{_CAP}|{_CAP}{_SP}(?:[A-ZÀ-Þ]\.{_SP})?{_CAP})(?![\w@/]))")
_TERM = re.compile(r"(?<![\w@./\-])[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*(?![\w@/])")
_NO_TERMS = {"dr", "prof", "mr", "mrs", "ms", "herr", "frau"}


def terms_of(name: str) -> list[str]:
    """The terms of a name span in lower case: double names apart, initials left out."""
    if name.isalpha():
        return [name.lower()] if len(name) > 1 else []
    return [t for t in re.split(r"[^\w]+", name.lower()) if len(t) > 1]


@cache
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, len(w))
    found.make_automaton()
    return found


def _emails(text: str) -> Iterator[re.Match]:
    """Matches of EMAIL: the grammar is tried at the start of what stands before a sign."""
    end = 0
    for sign in _AT_SIGNS.finditer(text):
        at = sign.start()
        while at and text[at - 1] in " \t\n":
            at -= 1
        while at and _LOCAL.match(text, at - 1):
            at -= 1
        if at >= end and (m := EMAIL.match(text, at)):
            end = m.end()
            yield m


def _labelled(text: str) -> Iterator[re.Match]:
    """Matches of LABELLED_ID: the grammar is tried where a label's first word stands."""
    low = text.lower()
    if len(low) != len(text):
        yield from LABELLED_ID.finditer(text)
        return
    end = 0
    for at in sorted(last - length + 1 for last, length in _automaton(tuple(_LABELS)).iter(low)):
        if at >= end and (m := LABELLED_ID.match(text, at)):
            end = m.end()
            yield m


def entity_spans(text: str) -> list[tuple[str, int, int]]:
    """E-mail, address, identity number and phone spans; the earlier kind wins an overlap."""
    spans: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if all(end <= s or start >= e for _, s, e in spans):
            spans.append((kind, start, end))

    for m in _emails(text):
        if not re.match(SERVICE, m["local"]) and not m["after"] and not re.search(r"\d$", m["host"]):
            add("email", m.start("local"), m.end("host"))
    for m in ADDRESS.finditer(text):
        add("address", *m.span())
    for m in _labelled(text):
        if sum(c.isdigit() for c in m["id"]) >= 4 and not re.fullmatch(r"[0\-/ \n]+", m["id"]):
            add("id_number", *m.span("id"))
    for m in BARE_ID.finditer(text):
        add("id_number", *m.span("id"))
    for m in PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 20:
            add("phone", *m.span())
    return spans




def name_slots(text: str) -> list[tuple[int, int]]:
    """Name-shaped spans in slots that hold a person.

    The slot grammars only run where a word of theirs stands.
    """
    found = []
    end = 0
    for last, length in _automaton(tuple(_CUES)).iter(text):
        at = last - length + 1
        if length == 2 and text[at] == "-" and at and text[at - 1] in "\n ":
            at -= 1  # a signature's dashes take the blank before them
        if at >= end and (m := SLOT_AFTER.match(text, at)):
            end = m.end()
            found.append(m.span("name"))
            if second := SLOT_SECOND.match(text, m.end("name")):
                found.append(second.span("name"))
    for m in SAID.finditer(text) if any(a in text for a in _VERBS) else ():
        if named := NAMED_BEFORE.search(text, max(0, m.start() - 120), m.start()):
            found.append(named.span("name"))
    return found


def _scan(df: DataFrame, doc_id: str, text: str, spans: bool) -> DataFrame:
    """One pass over the documents: found spans with their terms, and term counts summed per batch.

    Rows with a null ``term`` are spans, the others counts.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            n_all: dict[str, int] = defaultdict(int)
            n_slot: dict[str, int] = defaultdict(int)
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                slots = list(dict.fromkeys(name_slots(t)))
                covered = bytearray(len(t))
                for s, e in slots:
                    covered[s:e] = b"\1" * (e - s)
                for m in _TERM.finditer(t):
                    for term in terms_of(m[0]):
                        n_all[term] += 1
                        n_slot[term] += covered[m.start()]
                if not spans:
                    continue
                entities = entity_spans(t)
                rows += [(d, kind, s, e, True, [], None, 0, 0) for kind, s, e in entities]
                taken = [(s, e) for _, s, e in entities]
                for known, own in ((True, slots), (False, [m.span("name") for m in SHAPED.finditer(t)])):
                    for s, e in own:
                        if all(e <= a or s >= b for a, b in taken):
                            rows.append((d, "name", s, e, known, terms_of(t[s:e]), None, 0, 0))
                    if known:
                        taken += slots
            rows += [(None, None, 0, 0, False, [], term, n, n_slot[term]) for term, n in n_all.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_char", "end_char", "in_slot", "terms", "term", "n_all", "n_slot"]).astype({"doc_id": object})

    docs = df.where(F.length(F.col(text)) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return spread(docs).mapInPandas(scan, f"doc_id {kind}, pii_type string, start_char int, end_char int, in_slot boolean, terms array<string>, term string, n_all bigint, n_slot bigint")


def _scores(scanned: DataFrame) -> DataFrame:
    terms = scanned.where("term is not null").groupBy("term").agg(F.sum("n_all").alias("n_all"), F.sum("n_slot").alias("n_slot"))
    total = terms.agg((F.sum("n_slot") / F.sum("n_all")).alias("p0"))
    scored = terms.where("n_slot > 0").crossJoin(F.broadcast(total))  # one row
    return scored.select("term", "n_all", "n_slot", (F.log2(F.col("n_slot") / F.col("n_all") / F.col("p0")) / -F.log2("p0")).alias("disclosure"))


def term_statistics(df: DataFrame, text: str) -> DataFrame:
    """Per term: its occurrences (n_all), those in person slots (n_slot), and its disclosure score.

    The score is the pointwise mutual information of term and slot over its greatest
    possible value: 1 for a term only seen in slots, 0 for one as frequent there as elsewhere.
    Counted over all documents, summed within each batch before the shuffle.
    """
    return _scores(_scan(df.withColumn("_doc", F.lit(None).cast("long")), "_doc", text, False))


def find_pii(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per item: doc_id, pii_type, start_char, end_char (characters from 0, end exclusive).

    Null and empty texts give no rows. Spans of one document don't overlap.
    """

    scanned = written(_scan(df, doc_id, text, True), "pii")
    found = scanned.where("term is null").drop("term", "n_all", "n_slot")
    certain = found.where("pii_type != 'name'")
    named = found.where("pii_type = 'name' and size(terms) > 0").select("*", F.explode(F.array_distinct("terms")).alias("term"))
    scores = _scores(scanned)
    enough = F.when(F.col("in_slot"), F.col("disclosure") >= DISCLOSURE).otherwise((F.col("disclosure") >= DISCLOSURE_ELSEWHERE) & (F.col("n_slot") >= SUPPORT_ELSEWHERE))
    keys = ["doc_id", "pii_type", "start_char", "end_char"]
    judged = named.join(scores, "term", "left").groupBy(*keys, "in_slot").agg(F.min(F.coalesce(enough, F.lit(False))).alias("ok"), F.array_sort(F.array_distinct(F.first("terms"))).alias("who"))
    # A name that holds in a slot is the same person's wherever all of it stands again.
    persons = judged.where("in_slot and ok").select("who", F.lit(True).alias("known")).distinct()
    names = judged.join(persons, "who", "left").where("ok or (not in_slot and known)")
    # Spans outside slots may overlap one another: of those that do, the first stays.
    before = F.max("end_char").over(Window.partitionBy("doc_id").orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1))
    free = names.where("not in_slot").withColumn("_before", before).where("_before is null or _before <= start_char")
    return certain.select(*keys).unionByName(names.where("in_slot").select(*keys)).unionByName(free.select(*keys))


def disclosing_terms(df: DataFrame, doc_id: str, text: str, items: DataFrame) -> DataFrame:
    """doc_id, terms: the terms of the persons of a document that disclose one beyond DISCLOSURE_ELSEWHERE over the whole corpus.

    Terms of an identity that stand alone (a surname further down) reveal the same person as the full name.
    """
    scored = term_statistics(df, text).where(F.col("disclosure") >= DISCLOSURE_ELSEWHERE).select("term")
    spans = items.where("pii_type = 'name'").join(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    names = spans.select("doc_id", F.explode(F.split(F.lower(F.expr("substring(_text, start_char + 1, end_char - start_char)")), r"[^\p{L}\p{N}_]+")).alias("term")).where("length(term) > 1").distinct()
    return names.join(scored, "term").groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))  # terms of one text's names


def sanitise(df: DataFrame, doc_id: str, text: str, out: str = "sanitised") -> DataFrame:
    """The documents with every found item replaced by a placeholder of its type, such as ``[EMAIL]``.

    What is left of a document's persons is generalised: terms of their names that disclose a person by themselves become
    ``[PERSON]`` wherever they stand alone. Null stays null, and texts without items stay as they are.
    """
    found = written(find_pii(df, doc_id, text), "items")
    items = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("_items"))
    items = items.join(disclosing_terms(df, doc_id, text, found), "doc_id", "left").select(F.col("doc_id").alias("_doc"), "_items", F.col("terms").alias("_terms"))
    joined = df.join(items, df[doc_id] == F.col("_doc"), "left").drop("_doc")
    # The parts between the items and their placeholders, in order; positions count from 0.
    ends = F.concat(F.array(F.lit(0)), F.expr("transform(_items, i -> i.end_char)"))
    general = F.when(F.size("_terms") > 0, F.concat(F.lit(r"(?iU)(?<![\w@./\[-])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\w@\]])")))
    parts = joined.withColumn("_ends", ends).withColumn("_general", general)
    between = lambda part: f"if(_general is null, {part}, regexp_replace({part}, _general, '[PERSON]'))"
    inner = between(f"substring({text}, _ends[n] + 1, i.start_char - _ends[n])")
    last = between(f"substring({text}, element_at(_ends, -1) + 1)")
    done = parts.withColumn(out, F.expr(f"case when _items is null then {text} else array_join(transform(_items, (i, n) -> {inner} || '[' || upper(i.pii_type) || ']'), '') || {last} end"))
    return done.drop("_items", "_ends", "_terms", "_general")
