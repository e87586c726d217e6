"""Broken prompt and response pairs: a pushdown parser, string tiling, script checks and refusal grammars."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodeflow.session import spread

#: Shortest tile in words, and the share of an answer that tiles of the prompt must cover.
TILE, COPIED = 3, 0.85

#: From so many words on a text of a language with function words below holds one of them.
TELLING_WORDS = 8

# The commonest words of languages, and the words of refusals.
FUNCTION_WORDS = {
    "en": "the a an is are was were be been of in into to from and or not no that this it its so which with without for as any by only cannot can before after because part works used keeps",
    "de": "der die das ein eine einen einer ist sind wird werden wurde und oder nicht nach von vor aus in im zu den dem des keine kein daher damit gilt weil sie es als mit auf für sich auch wie bei über durch",
    "es": "el la los las un una es son y o no de del que se en al lo así por eso sin ninguna antes dentro para con como pero más su sus por este esta",
    "fr": "le la les un une est sont et ou ne pas de du des que qui se dans au aux donc ce sans aucune avant leur son sa pour avec par sur d'une ce cette il elle pas plus mais",
    "pt": "o a os as um uma é são e ou não do da dos das que se em no na por isso sem nenhuma dentro antes para com como ao mas mais seu sua por este esta",
    "it": "il lo la gli le un una è sono e o non di del della dei che si in nel nella per questo senza alcun prima dentro quindi con come al ma più suo sua questa da dal",
    "nl": "de het een is zijn wordt worden en of niet van voor uit in naar geen dus omdat die dat met zonder als op aan deze maar meer zijn haar ook bij door over",
    "pl": "i w na nie jest są że się do z bez przed przez tego dlatego więc to oraz jako ale jak po od ten ta przy",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
SCRIPTS = {"zh": r"[一-鿿]", "ja": r"[぀-ヿ]", "ko": r"[가-힯]", "ru": r"[Ѐ-ӿ]", "ar": r"[؀-ۿ]", "el": r"[Ͱ-Ͽ]", "he": r"[֐-׿]", "hi": r"[ऀ-ॿ]", "th": r"[฀-๿]"}
_ACT = r"(?:help|assist|answer|respond|classif\w*|judge|label|look into|provide|comment|discuss|analy[sz]\w*|review|assess|evaluate|engage|support|complete|comply|do (?:that|this)|continue|fulfil\w*|share|give|advise)"
REFUSALS = re.compile(
    r"(?i)(?:"
    rf"\b(?:can(?:no|['’]?)t|can not|could not|couldn['’]t|won['’]t|will not|am unable to|['’]m unable to|unable to|not able to|not allowed to|may not|must not|not permitted to)\s+(?:\w+\s+){{0,3}}?{_ACT}\b"
    r"|\b(?:must|have to|need to|going to|will|would|shall|['’]ll|should)\s+(?:\w+\s+){0,2}?(?:decline|refuse|pass on|abstain|refrain)\b"
    rf"|\bi\s+(?:decline|refuse)\b|\brather not\s+{_ACT}\b|\bprefer not to\b|\bnot\s+(?:something\s+)?(?:i['’]m|i am)?\s*comfortable\b|\bisn['’]t something i\b"
    r"|\b(?:would be|is) wrong (?:of|for) me\b|\boutside (?:of )?what i (?:may|can|am allowed)\b|\bnot (?:permitted|allowed|possible) (?:for|to) me\b|\bnot for me to (?:judge|say|answer)\b|\bbeyond what i (?:may|can)\b"
    r"|\bagainst (?:my|the|our) (?:guidelines|policy|policies|rules|usage)|\bunder the usage rules\b|\bviolat\w+ (?:my|the|our) (?:guidelines|polic\w+)"
    r"|\b(?:muss|möchte|werde|darf|kann|will)\b[^.]{0,80}\b(?:ablehnen|nicht (?:helfen|beantworten|beurteilen|einordnen|bewerten|weiterhelfen|antworten|unterstützen)|keine (?:auskunft|antwort|einschätzung|hilfe))"
    r"|\b(?:nicht helfen|keine auskunft|leider nicht (?:helfen|beantworten|möglich)|lehne\b[^.]{0,40}\bab\b)"
    r"|\b(?:sorry|apologi[sz]e|regret|afraid)\b[^.!?]{0,120}\b(?:not|n['’]t|never|nothing)\b[^.!?]{0,60}\b(?:i|me|we)\b(?:[^.!?]{0,20}\b(?:discuss|do|cover|touch|address|handle|judge|answer|deal|talk)\b)?[^.!?]{0,30}[.!?]"
    r"|\bno puedo (?:ayudar|responder|asistir)|\bje ne peux pas (?:vous )?(?:aider|répondre)|\bnão posso (?:ajudar|responder)"
    r")"
)
_LABEL = re.compile(r"(?i)^\W*(?:label\s*[:=]\s*)?(?:source|sink|sanitizer|propagator|none)\b\s*(?:\(\s*[\d.]+\s*%?\s*\))?\s*[:.\-–]?\s*")
_NOTHING = re.compile(r"(?i)^(?:null|none|n/?a|nil|undefined|empty)?$")
_ENDS = (".", "!", "?", "。", "！", "？", "…", "»", "”")
_VOID = ("area", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][\w\-]*)(?:\s[^<>]*)?(?P<self>/?)>")
_CUT_TAG = re.compile(r"(?:<[A-Za-z][\w\-]*\s+[\w\-]+\s*=[^<>]*|</[\w\-]*)\Z")
_MARKER = re.compile(r"(?:^|[.!?:;\n])[ \t]*\(?(?P<n>\d{1,3})[.)](?=\s|$)")
_BULLET = re.compile(r"(?:^|\n)[ \t]*[-*+•][ \t]*\Z")


def _stack(text: str) -> list[str]:
    """What is still open at the end: fences, brackets, quotations, inline code, emphasis, tags and list items of a text.

    Within braces any double quote counts. Elsewhere one only opens after a blank or bracket, so that inch
    marks do no harm; apostrophes never count. Tags count in texts that close some, so that a mere
    mention of one does no harm. A list item is open if nothing follows its marker.
    """
    stack: list[str] = []
    marked = "</" in text
    i, n = 0, len(text)
    while i < n:
        c, top = text[i], stack[-1] if stack else ""
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if top == '"':
            if c == "\\" and "{" in stack:
                i += 1
            elif c == '"':
                stack.pop()
        elif text.startswith("```", i):
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
            i += 2
        elif top == "`":
            if c == "`":
                stack.pop()
        elif c == "`":
            stack.append("`")
        elif c in "{[(":
            stack.append(c)
        elif c in "}])":
            if top == {"}": "{", "]": "[", ")": "("}[c]:
                stack.pop()
        elif c == '"' and ("{" in stack or ((not before or before in " \t\n([") and after.strip())):
            stack.append('"')
        elif c in "“„«" and top != "„" and (c != "«" or not before or before.isspace() or before == "("):
            stack.append(c)
        elif c in "“”»" and top and top in {"“": "„", "”": "“„", "»": "«"}[c]:
            stack.pop()
        elif "```" in stack:
            pass
        elif text.startswith("**", i):
            if "**" in stack:
                del stack[stack.index("**") :]
            elif (not before or before in " \t\n(") and re.match(r"(?!(?:kw|opt|param|arg|attr|data)\w*\b)\w", text[i + 2 : i + 40]):
                stack.append("**")
            i += 1
        elif c == "<" and marked and (m := _TAG.match(text, i)):
            name = "<" + m["name"].lower()
            if m["close"]:
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not m["self"] and not m[0].endswith("/>") and name[1:] not in _VOID:
                stack.append(name)
            i = m.end() - 1
        i += 1
    return stack + _open_ends(text)


def _open_ends(text: str) -> list[str]:
    """A tag that is cut within itself, or a list marker with nothing behind it, at the end of a text."""
    found = ["<"] if _CUT_TAG.search(text) else []
    markers = [(int(m["n"]), m.end()) for m in _MARKER.finditer(text)]
    # A number that ends a sentence is no marker: the one before it must be there.
    if markers and markers[-1][1] == len(text.rstrip()) and (markers[-1][0] == 1 or markers[-1][0] - 1 in [k for k, _ in markers[:-1]]):
        found.append("item")
    return [*found, "item"] if _BULLET.search(text) else found


def _json_answer(text: str) -> tuple[dict | None, bool]:
    """The answer's JSON object, and whether one was begun but not finished."""
    begun = False
    for m in re.finditer(r"\{", text):
        try:
            found, _ = json.JSONDecoder(strict=False).raw_decode(text, m.start())
        except ValueError:
            begun = begun or bool(re.match(r"\{\s*(?:\"|$)", text[m.start() :]))
            continue
        if isinstance(found, dict):
            return found, False
    return None, begun


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _diagonal_runs(a: np.ndarray, p: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int]]:
    """The longest common runs of TILE words or more on some diagonals: length, place in a, place in p, as a heap."""
    runs = []
    for d in diagonals.tolist():
        lo, hi = max(0, -d), min(len(a), len(p) - d)
        same = np.concatenate(([False], a[lo:hi] == p[lo + d : hi + d], [False])).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= TILE:
                runs.append((start - end, -(lo + start), -(lo + start + d)))
    heapq.heapify(runs)
    return runs


def tile_coverage(answer: list[str], prompt: list[str], enough: float = 0.0) -> float:
    """Share of the answer's words that greedy string tiling marks in the prompt.

    The longest common run of unmarked words is marked, again and again, down to TILE words. All runs are found once, on the
    diagonals that share a run of TILE words at all, and kept in a heap; one that is marked in part goes back with what is left
    of it. If less than ``enough`` of the answer can stand in such runs, that bound is given without tiling.
    """
    if len(answer) < TILE or len(prompt) < TILE:
        return 0.0
    known = set(zip(*(prompt[i:] for i in range(TILE)), strict=False))
    hits = [g in known for g in zip(*(answer[i:] for i in range(TILE)), strict=False)]
    most = min(len(answer), TILE * sum(hits))
    if not most or most < enough * len(answer):
        return most / len(answer)
    ids: dict[str, int] = {}
    a, p = (np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in (answer, prompt))
    size = len(ids) + 1
    grams = [sum((x[i : len(x) - TILE + 1 + i] * size**i for i in range(TILE)), np.zeros(len(x) - TILE + 1, np.int64)) for x in (a, p)]
    shared = np.array(hits)
    order = np.argsort(grams[1], kind="stable")
    lo, hi = (np.searchsorted(grams[1][order], grams[0][shared], side) for side in ("left", "right"))
    touched = np.zeros(len(a) + len(p), bool)
    for at, low, high in zip(np.flatnonzero(shared).tolist(), lo.tolist(), hi.tolist(), strict=True):
        touched[order[low:high] - at + len(a)] = True
    runs = _diagonal_runs(a, p, np.flatnonzero(touched) - len(a))
    seen_a, seen_p = np.zeros(len(a), bool), np.zeros(len(p), bool)
    while runs:
        length, at, to = -runs[0][0], -runs[0][1], -runs[0][2]
        heapq.heappop(runs)
        free = ~(seen_a[at : at + length] | seen_p[to : to + length])
        if free.all():
            seen_a[at : at + length] = seen_p[to : to + length] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= TILE:
                heapq.heappush(runs, (start - end, -(at + start), -(to + start)))
    return float(seen_a.mean())


def language_of(text: str) -> str | None:
    """The language of a text by script, else by its function words; null if nothing tells."""
    plain = re.sub(r"```.*?```|`[^`]*`|\b\w*_\w*\b", " ", text, flags=re.S)
    letters = len(re.findall(r"[^\W\d_]", plain))
    for name, script in () if plain.isascii() else SCRIPTS.items():
        if letters and len(re.findall(script, plain)) > 0.2 * letters:
            return name
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", plain.lower())
    counts = {k: sum(w in v for w in words) for k, v in _WORDS.items()}
    best = max(counts, key=lambda k: counts[k])
    second = max((v for k, v in counts.items() if k != best), default=0)
    return best if counts[best] >= 2 and counts[best] > second else None


def lacks_language(text: str, wanted: str) -> bool:
    """Whether a text of some length holds no function word at all of the wanted language, whichever other it is in."""
    plain = re.sub(r"```.*?```|`[^`]*`|\b\w*_\w*\b|\S*[a-z][A-Z]\S*|\b\w+\([^)]*\)", " ", text, flags=re.S)
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", plain.lower())
    return wanted in _WORDS and len(words) >= TELLING_WORDS and not any(w in _WORDS[wanted] for w in words)


def defect_of(prompt: str | None, prompt_lang: str | None, content: str | None) -> str | None:
    """The defect of a pair, or null: empty, copies_prompt, refusal, truncated or other_language, in this order."""
    text = (content or "").strip().lstrip("﻿")
    bare = re.sub(r"^```\w*|```$", "", text).strip()
    if _NOTHING.match(bare.strip("\"' ")) or not re.search(r"\w", bare):
        return "empty"
    found, begun = _json_answer(text)
    if found is not None:
        reason = found.get("reason", found.get("explanation", found.get("reasoning")))
        body = reason if isinstance(reason, str) else "" if reason is None else json.dumps(reason)
        if not re.search(r"\w", body) or _NOTHING.match(body.strip()):
            return "empty"
    else:
        if re.fullmatch(r"[\[\]{}\s\"',:]*", bare):
            return "empty"
        body = _LABEL.sub("", bare, count=1) if not begun else bare
        if not re.search(r"\w", body):
            return "empty"
    words = _tokens(body)
    if len(words) > TILE and tile_coverage(words, _tokens(prompt or ""), COPIED) >= COPIED:
        return "copies_prompt"
    if REFUSALS.search(body):
        return "refusal"
    if found is None and (begun or _stack(text)):
        return "truncated"
    end = re.sub(r"[\s\"'`*_)]+$", "", re.sub(r"(?:\s*</[\w\-]+>)+\s*$", "", re.sub(r"```\s*$", "", body)))
    if not end.endswith(_ENDS) or _open_ends(body):
        return "truncated"
    wanted = (prompt_lang or "").strip().lower()[:2] or language_of(prompt or "")
    spoken = language_of(body)
    if wanted and (spoken != wanted if spoken else lacks_language(body, wanted)):
        return "other_language"
    return None


def find_defects(df: DataFrame, key: str = "call_id", prompt: str = "prompt", lang: str = "prompt_lang", content: str = "content") -> DataFrame:
    """One row per defective pair: key, defect. Re-delivered pairs count once.

    A null answer is empty; a null prompt can't be copied, and its language is taken from prompt_lang.
    """
    kind = dict(df.dtypes)[key]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, defect_of(p, g, c)) for k, p, g, c in zip(batch["k"], batch["p"], batch["g"], batch["c"], strict=True)]
            yield pd.DataFrame([r for r in found if r[1]], columns=[key, "defect"])

    rows = df.select(F.col(key).alias("k"), F.col(prompt).alias("p"), F.col(lang).alias("g"), F.col(content).alias("c"))
    return spread(rows).mapInPandas(judge, f"{key} {kind}, defect string").distinct()


def defect_report(found: DataFrame) -> DataFrame:
    """Per defect: n_pairs."""
    return found.groupBy("defect").agg(F.count("*").alias("n_pairs"))
