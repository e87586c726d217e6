"""Required trigrams of regular expressions, for trigram-index searches."""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as sre_c, _parser as sre_p
except ImportError:  # before Python 3.11
    import sre_constants as sre_c
    import sre_parse as sre_p

#: A class of more characters than this ends a literal run; more alternatives than MAX_ALTERNATIVES are cut to their common start.
MAX_CLASS, MAX_ALTERNATIVES = 8, 96


def _runs(tree) -> list[list[str]]:
    """Alternatives, each a list of literal runs that must occur (in lower case)."""
    alternatives: list[list[str]] = [[""]]

    def literal(chars: list[str]) -> None:
        nonlocal alternatives
        if len(alternatives) * len(chars) > MAX_ALTERNATIVES:
            brk()
            return
        alternatives = [[*a[:-1], a[-1] + c] for a, c in product(alternatives, chars)]

    def brk() -> None:
        nonlocal alternatives
        alternatives = [[*a, ""] for a in alternatives]

    def nested(options: list[list[str]], joined: bool) -> None:
        nonlocal alternatives
        if len(alternatives) * len(options) > MAX_ALTERNATIVES:
            brk()
            return
        grown = []
        for a, o in product(alternatives, options):
            grown.append([*a[:-1], a[-1] + o[0], *o[1:]] if joined else [*a, *o, ""])
        alternatives = grown

    for op, arg in tree:
        if op is sre_c.LITERAL:
            literal([chr(arg).lower()])
        elif op is sre_c.IN:
            chars: list[str] = []
            for kind, value in arg:
                if kind is sre_c.LITERAL:
                    chars.append(chr(value).lower())
                elif kind is sre_c.RANGE and value[1] - value[0] < MAX_CLASS:
                    chars += [chr(c).lower() for c in range(value[0], value[1] + 1)]
                else:
                    chars = []
                    break
            chars = sorted(set(chars))
            literal(chars) if 0 < len(chars) <= MAX_CLASS else brk()
        elif op is sre_c.SUBPATTERN:
            nested(_runs(arg[-1]), True)
        elif op is sre_c.BRANCH:
            nested([r for b in arg[1] for r in _runs(b)], True)
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT) or str(op) == "POSSESSIVE_REPEAT":
            least, most, inner = arg
            if least >= 1:
                options = _runs(inner)
                for _ in range(min(least, 6) if most == least else 1):
                    nested(options, True)
            if most != least or least > 6:
                brk()
        elif op is sre_c.AT or op in (sre_c.ASSERT, sre_c.ASSERT_NOT):
            continue  # takes no characters: the run goes on
        else:
            brk()
    return alternatives


def required_grams(pattern: str) -> list[list[str]]:
    """Alternatives of grams (trigrams; of shorter runs the signs, or where nothing else is there the pairs) one of which any match contains whole.

    Of each literal run the first, middle and last trigram are required: more would add postings
    but hardly remove candidates.

    An empty alternative means that nothing can be required, so every text is a candidate.
    """
    found = set()
    for runs in _runs(sre_p.parse(pattern)):
        grams = {run[i : i + 3] for run in runs if len(run) >= 3 for i in {0, (len(run) - 3) // 2, len(run) - 3}}
        grams |= {run for run in runs if 0 < len(run) < 3 and not re.fullmatch(r"[\s\w=:\"'.,;\-]+", run)}
        found.add(frozenset(grams or {run for run in runs if len(run) == 2}))
    least = [f for f in found if not any(g < f for g in found)]
    return sorted(sorted(f) for f in least)


def folded(text: str) -> str:
    """The text as the index sees it: letters that regexes take for equal, whatever the case, are one."""
    return text.lower() if text.isascii() else text.casefold().replace("\u0131", "i").replace("\u0307", "")
