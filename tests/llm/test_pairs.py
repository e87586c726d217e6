"""Defects of pairs."""

import random
import time

import pytest

from lodeflow.llm import pairs

PROMPT = "Classify the method below as SOURCE, SINK or NONE and give a reason.\n\nFile: a/b.py\n```python\ndef get_user(request):\n    value = request.args.get('q')\n    run_query(value)\n```"
OK = "The query in run_query is built by joining q to a string, which makes it injectable."
CASES = [
    (OK, None), (f'{{"label": "sink", "confidence": 0.4, "reason": "{OK}", "types": ["CWE-89"]}}', None), (f'```json\n{{"label": "sink", "reason": "{OK}"}}\n```', None), (f"SINK (0.6): {OK}", None),
    (f'The code in question is `run_query(value)`.\n{{"label": "sink", "reason": "{OK}"}}', None), ("I cannot find any caller that hands q to get_user, so it is harmless here.", None), ("Sorry-page rendering in get_user writes q into the markup without encoding it.", None),
    (None, "empty"), ("", "empty"), ("...", "empty"), ("null", "empty"), ("{}", "empty"), ('""', "empty"), ("```json\n```", "empty"), ('{"label": "sink", "confidence": 0.3, "reason": " "}', "empty"), ('{"label": "sink"}', "empty"), ("SINK (0.6):", "empty"),
    (OK[:40], "truncated"), (f'{{"label": "sink", "confidence": 0.4, "reason": "{OK[:40]}', "truncated"), ('```json\n{"label": "si', "truncated"), (f'{{"label": "sink", "reason": "{OK}", "types": ["CWE-', "truncated"),
    ("I'm sorry, but I can't help with analysing this code.", "refusal"), ('{"label": "none", "reason": "This request goes against my guidelines, so I have to decline."}', "refusal"), ("Dabei kann ich leider nicht helfen.", "refusal"),
    ("Unfortunately, it would be wrong of me to analyse get_user.", "refusal"),
    (PROMPT, "copies_prompt"), (PROMPT.split("\n")[0].lower(), "copies_prompt"), ('{"label": "none", "reason": "Classify the method below as SOURCE, SINK or NONE and give a reason."}', "copies_prompt"), ("```python\ndef get_user(request):\n    value = request.args.get('q')\n    run_query(value)\n```", "copies_prompt"),
    ("Die Werte werden vor der Ausgabe in run_query maskiert, daher gilt get_user als Filter.", "other_language"), ("Los valores se filtran antes de usarse en run_query, así que el método es seguro.", "other_language"), ("SOURCE (0.9): 该方法从请求中读取 q，没有经过任何检查就返回。", "other_language"),
]


@pytest.mark.parametrize(("content", "defect"), CASES)
def test_defect(content, defect):
    assert pairs.defect_of(PROMPT, "en", content) == defect


def test_tiling_against_brute_force():
    a, p = "a b c d x e f g".split(), "e f g q a b c d".split()
    assert pairs.tile_coverage(a, p) == 7 / 8
    assert pairs.tile_coverage([], p) == 0.0 and pairs.tile_coverage(a, []) == 0.0


def test_table(spark):
    rows = [(1, PROMPT, "en", None), (1, PROMPT, "en", None), (2, None, None, OK), (3, PROMPT, "en", OK * 2000), (4, None, None, "")]
    df = spark.createDataFrame(rows, "call_id long, prompt string, prompt_lang string, content string")
    assert sorted(tuple(r) for r in pairs.find_defects(df).collect()) == [(1, "empty"), (4, "empty")]
    assert pairs.find_defects(df.limit(0)).count() == 0
    assert pairs.find_defects(df.withColumn("defect", df.prompt)).count() == 2


@pytest.mark.parametrize("cut", ["Steps: 1. read the input. 2.", "- It reads q.\n- It runs q.\n-", "The value passes through sanitize(x)", "It is safe (see the filter above.", "It is <p>built from q. It is <b>not</b> escaped.", 'It is safe. <a href="x.', "It is **Unsafe as q is joined.", 'The page says "q is joined.', "Er sagt „q ist offen."])
def test_cut_within_markup(cut):
    assert pairs.defect_of(PROMPT, None, cut) == "truncated"


@pytest.mark.parametrize("whole", ["Steps: 1. read the input. 2. run it.", "- It reads q.\n- It runs q.", "It passes through sanitize(x).", "It is safe (see above.)", "It writes a <script> tag into the page.", "<p>It is <b>not</b> escaped.</p>", "It is **unsafe**.", "It passes **kwargs on.", 'It says "q is joined."', 'A 5" field is joined.', "Er sagt „q ist offen“.", "The sink is in line 12.", "1) it reads q. 2) it runs q."])
def test_whole_with_markup(whole):
    assert pairs.defect_of(PROMPT, None, whole) is None


def slow_coverage(answer, prompt):
    """Greedy string tiling as it is defined: the longest unmarked run first."""
    seen_a, seen_p = set(), set()
    while True:
        best = (0, 0, 0)
        for a in range(len(answer)):
            for p in range(len(prompt)):
                k = 0
                while a + k < len(answer) and p + k < len(prompt) and answer[a + k] == prompt[p + k] and a + k not in seen_a and p + k not in seen_p:
                    k += 1
                best = max(best, (k, a, p))
        if best[0] < pairs.TILE:
            return len(seen_a) / len(answer)
        seen_a |= set(range(best[1], best[1] + best[0]))
        seen_p |= set(range(best[2], best[2] + best[0]))


def test_tiling_against_its_definition():
    rng = random.Random(4)
    for _ in range(150):
        a, p = (rng.choices("abc" if rng.random() < 0.5 else "abcdefgh", k=rng.randrange(1, 30)) for _ in range(2))
        assert pairs.tile_coverage(a, p) == pytest.approx(slow_coverage(a, p))


def test_repeating_words_are_tiled_at_once():
    start = time.time()
    assert pairs.tile_coverage(["a"] * 800, ["a"] * 800) == 1.0
    assert pairs.tile_coverage(["a", "b"] * 3000, ["a", "b"] * 3000) == 1.0
    assert time.time() - start < 5


@pytest.mark.parametrize(("content", "defect"), [
    ("Metoden leser verdien fra forespørselen og sender den videre uten noen kontroll underveis.", "other_language"),
    ("Metoda vraci hodnotu primo do dotazu bez jakekoli predchozi kontroly vstupu.", "other_language"),
    ("I am sorry, this topic is not one I discuss.", "refusal"),
])
def test_beyond_the_listed_languages_and_refusals(content, defect):
    assert pairs.defect_of(PROMPT, "en", content) == defect
