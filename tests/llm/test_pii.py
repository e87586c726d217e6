"""Personal information: forms, slots, and the corpus's say on names."""

import pytest

from lodeflow.llm import pii

SPANS = {
    "Please contact nerissa.q+x@mail.example before": [("email", "nerissa.q+x@mail.example")],
    "Owner is m_k (at) lists (dot) example (dot) com, now": [("email", "m_k (at) lists (dot) example (dot) com")],
    "an david AT\nmail.example.": [("email", "david AT\nmail.example")],
    "user=<a.b@inbox.invalid> phone=+1 976 555 0149.": [("email", "a.b@inbox.invalid"), ("phone", "+1 976 555 0149")],
    "Call (925) 555-0108 ext. 12 if": [("phone", "(925) 555-0108 ext. 12")],
    "Call 212 736 5000 or 736-5000 today": [("phone", "212 736 5000"), ("phone", "736-5000")],
    "mail j.r(at\t)mail.example or k ( at ) bücher.example": [("email", "j.r(at\t)mail.example"), ("email", "k ( at ) bücher.example")],
    "au 01 99 00 32 67. Or 030/23125-388, 0012585550191 x36": [("phone", "01 99 00 32 67"), ("phone", "030/23125-388"), ("phone", "0012585550191 x36")],
    "gave national identity number 3338 2866 1278 and": [("id_number", "3338 2866 1278")],
    'leaked {"ssn": "918-42-9479"}': [("id_number", "918-42-9479")],
    "Die Ausweisnummer T58C80049 gehört": [("id_number", "T58C80049")],
    "address Flat 7, 226 Elmstead Row, Brunnsee N2 5EA was": [("address", "Flat 7, 226 Elmstead Row, Brunnsee N2 5EA")],
    "to 2350 Quellbruch Street, Montquerel,\nOR 60853, attention": [("address", "2350 Quellbruch Street, Montquerel,\nOR 60853")],
    "at 119 allée de la Elmstead, 44871 Montquerel and": [("address", "119 allée de la Elmstead, 44871 Montquerel")],
    "at Windrushstraße 99a, 94156 Kirkdale Weir was": [("address", "Windrushstraße 99a, 94156 Kirkdale Weir")],
    "Calle Osier 131, 39501 Montquerel y": [("address", "Calle Osier 131, 39501 Montquerel")],
}
NOTHING = ["left-join@4.13.6 is pinned", "Clone git@code.internal.test:a/b first", "<name>@<domain> and 000-00-0000", "Build 2023-49-1746 passed", "Advisory 431-555-1500-X of", "ticket 4027 4620 only", "on 10.13.10.107:2859", "The decorator @app.route sits", "Rule 79-17 matched", "Route 26 Gateway Lane is the name", ""]


@pytest.mark.parametrize("text", SPANS)
def test_entities(text):
    assert sorted((k, text[s:e]) for k, s, e in pii.entity_spans(text)) == sorted(SPANS[text])


@pytest.mark.parametrize("text", NOTHING)
def test_no_entities(text):
    assert pii.entity_spans(text) == []


def test_names_need_the_corpus(spark):
    rows = [
        "Reported by Dr. Katya Harrow during the week.", "Owner: Harrow, Katya, x", "KATYA HARROW disagreed with the verdict.", "Call Katya Harrow now. The Copper Lantern product.", "See the Copper Lantern product. -- \nK. Harrow\n",
        "Gemeldet von Katya Harrow, x. Signalé par Katya Harrow, y. Owner: Katya Harrow, z.", "Reported by the scanner of the day. The scanner of the team is the best of the scanners.", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = sorted((r.doc_id, rows[r.doc_id][r.start_char : r.end_char]) for r in pii.find_pii(df, "doc_id", "text").collect())
    assert found == [(0, "Katya Harrow"), (1, "Harrow, Katya"), (2, "KATYA HARROW"), (3, "Katya Harrow"), (4, "K. Harrow"), *[(5, "Katya Harrow")] * 3]
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(df, "doc_id", "text").collect()}
    assert clean[0] == "Reported by Dr. [NAME] during the week." and clean[7] is None and clean[8] == "" and clean[6] == rows[6]


def test_placeholders(spark):
    df = spark.createDataFrame([("a", "x a@b.example y (925) 555-0108"), ("b", "é" * 50_000 + " a@b.example")], "doc_id string, text string")
    out = {r.doc_id: r.sanitised for r in pii.sanitise(df, "doc_id", "text").collect()}
    assert out == {"a": "x [EMAIL] y [PHONE]", "b": "é" * 50_000 + " [EMAIL]"}
    assert pii.find_pii(df.limit(0), "doc_id", "text").count() == 0
    assert pii.find_pii(df.withColumn("term", df.text).withColumn("pii_type", df.text), "doc_id", "text").count() == 3


def test_one_slot_carries_the_whole_name(spark):
    rows = ["Reported by Ilse Varnholt during the week.", "Then Ilse Varnholt called, and Varnholt, Ilse wrote.", "The Copper Lantern product.", *["The scanner of the team is the best of the scanners."] * 20]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = sorted((r.doc_id, rows[r.doc_id][r.start_char : r.end_char]) for r in pii.find_pii(df, "doc_id", "text").collect())
    assert found == [(0, "Ilse Varnholt"), (1, "Ilse Varnholt"), (1, "Varnholt, Ilse")]


def test_disclosing_terms_are_generalised(spark):
    rows = ["Reported by Ilse Varnholt during the week. Later Varnholt called, and varnholt@x too.", *["The scanner of the team is the best of the scanners."] * 20]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(df, "doc_id", "text").collect()}
    assert clean[0] == "Reported by [NAME] during the week. Later [PERSON] called, and varnholt@x too." and clean[1] == rows[1]
