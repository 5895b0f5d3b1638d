import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from brute import tuples
from spanveil.operators import merge
from spanveil.operators.merge import merge_spans, redact_merged, swept
from spanveil.operators.rules import Rule

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SPANS = "ARRAY<STRUCT<label: STRING, value: STRING, start: INT, end: INT>>"


def painted(text, *detectors):
    """Entities by giving each character to the best span that covers it."""
    spans = {(max(a, 0), min(b, len(text)), d, label) for d, found in enumerate(detectors) for label, a, b in found}
    spans = [s for s in spans if s[0] < s[1]]
    best = [min((s for s in spans if s[0] <= i < s[1]), key=lambda s: (s[2], s[0] - s[1], s[0], s[3]), default=None) for i in range(len(text))]
    out, i = [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and best[j] == best[i]:
            j += 1
        s = best[i]
        if s and (j - i == s[1] - s[0] or any(c.isalnum() for c in text[i:j])):
            out.append((s[3], text[i:j], i, j))
        i = j
    return out


def merged(spark, rows):
    """Rows of (text, spans of one detector, spans of another)."""
    data = [(k, t, *([(label, "?", a, b) for label, a, b in found] for found in both)) for k, (t, *both) in enumerate(rows)]
    df = spark.createDataFrame(data, f"id INT, text STRING, one {SPANS}, two {SPANS}")
    return merge_spans(df, "text", ["one", "two"]).orderBy("id").collect()


CASES = [
    ("nested", "John a@b.c Smith", [("EMAIL", 5, 10)], [("NAME", 0, 16)]),
    ("outer wins", "John a@b.c Smith", [("NAME", 0, 16)], [("EMAIL", 5, 10)]),
    ("crossing", "abcdefgh", [("X", 2, 5)], [("Y", 4, 8), ("Y", 0, 3)]),
    ("equal", "abcdefgh", [("X", 2, 5)], [("Y", 2, 5)]),
    ("equal in one detector", "abcdefgh", [("B", 2, 5), ("A", 2, 5), ("A", 2, 5)], []),
    ("longer first", "abcdefgh", [("A", 0, 3), ("B", 2, 8)], []),
    ("leftmost first", "abcdefgh", [("B", 2, 5), ("A", 4, 7)], []),
    ("adjacent", "abcdefgh", [("A", 0, 4)], [("A", 4, 8)]),
    ("rest without letters", "a-b.c  d", [("A", 0, 3), ("B", 4, 5)], [("C", 0, 7)]),
    ("whole without letters", "--- abc", [], [("C", 0, 3)]),
    ("outside", "abc", [("A", -5, 2), ("B", 2, 99), ("C", 1, 1), ("D", 2, 1), ("E", 50, 60)], []),
    ("code points", "é😀x y", [("A", 1, 2)], [("B", 0, 3)]),
    ("none", "abc", [], []),
    ("empty", "", [("A", 0, 3)], []),
]


def test_nested_crossing_and_equal_spans(spark):
    rows = merged(spark, [c[1:] for c in CASES])
    for (name, text, *found), row in zip(CASES, rows, strict=True):
        assert tuples(row["pii_entities"]) == painted(text, *found), name
    assert tuples(rows[0]["pii_entities"]) == [("NAME", "John ", 0, 5), ("EMAIL", "a@b.c", 5, 10), ("NAME", " Smith", 10, 16)]
    assert rows[0]["redacted_text"] == "[NAME][EMAIL][NAME]" and rows[8]["redacted_text"] == "[A].[B]  d"


def test_random_spans_against_painting(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice("ab é-. ") for _ in range(rng.randrange(25)))
        found = [[(rng.choice("PQ"), a, a + rng.randrange(8)) for a in (rng.randrange(-2, 25) for _ in range(rng.randrange(6)))] for _ in "ab"]
        rows.append((text, *found))
    for (text, *found), row in zip(rows, merged(spark, rows), strict=True):
        assert tuples(row["pii_entities"]) == painted(text, *found)


def test_null_texts_and_spans(spark):
    data = [(1, None, [("A", "x", 0, 1)], None), (2, "abc", None, [("A", "x", None, 2), (None, "x", 0, 1), None, ("B", "x", 1, 2)])]
    rows = merge_spans(spark.createDataFrame(data, f"id INT, text STRING, one {SPANS}, two {SPANS}"), "text", ["one", "two"]).orderBy("id").collect()
    assert (rows[0]["redacted_text"], rows[0]["pii_entities"]) == (None, [])
    assert tuples(rows[1]["pii_entities"]) == [("B", "b", 1, 2)] and rows[1].asDict().keys() == {"id", "text", "redacted_text", "pii_entities"}


def test_many_spans_take_n_log_n():
    spans = [(i, 400_000 - i, 1 + i % 3, "A") for i in range(100_000)] + [(3 * i, 3 * i + 2, 0, "B") for i in range(100_000)]
    assert sum(1 for _ in swept(spans)) > 199_000


def answer(prompts):
    out = []
    for p in prompts:
        text = p.rsplit('"""', 2)[1]
        if "fail" in text:
            raise RuntimeError("no")
        out.append('{"redacted_text": "[X]", "pii_entities": [{"label": "CITY", "value": "Paris, Rue 5"}]}')
    return out


def test_rules_lists_and_a_model(spark):
    df = spark.createDataFrame(
        [(1, "in Paris, Rue 5 b@c.de", 7), (2, "fail Paris b@c.de", 7), (3, None, 7)], "id INT, text STRING, failed INT"
    )
    words = spark.createDataFrame([("paris", "GIVENNAME1"), ("de", "STATE")], "term STRING, label STRING")
    how = {"dictionary": words, "make_predict": lambda: answer}
    rows = redact_merged(df, "text", **how).orderBy("id").collect()
    assert rows[0]["redacted_text"] == "in [GIVENNAME1][CITY] [EMAIL]"
    assert rows[1]["redacted_text"] == "fail [GIVENNAME1] [EMAIL]"
    assert [r["failed"] for r in rows] == [False, True, True] and rows[1]["failure"] == "RuntimeError: no"
    rows = redact_merged(df, "text", order=("lists", "model", "rules"), **how).orderBy("id").collect()
    assert rows[0]["redacted_text"] == "in [GIVENNAME1][CITY] [EMAIL][STATE]"
    rows = redact_merged(df, "text", types=["EMAIL"], **how).orderBy("id").collect()
    assert rows[0]["redacted_text"] == "in Paris, Rue 5 [EMAIL]"
    alone = redact_merged(df, "text", rules=(Rule("NUM", "[0-9]+"),), order=("rules",)).orderBy("id").collect()
    assert alone[0]["redacted_text"] == "in Paris, Rue [NUM] b@c.de" and alone[0]["failed"] == 7
    long = redact_merged(df, "text", part_bytes=0, **how).orderBy("id").collect()
    assert long[0]["redacted_text"] == "in [GIVENNAME1][CITY] [EMAIL]"
    with pytest.raises(ValueError, match="order"):
        redact_merged(df, "text", order=("rules", "rules"))


def test_spans_of_rules_and_lists_come_from_their_segments(spark):
    """places were worked out by lambdas in three steps of the plan, and each prompt was sent whole."""
    df = spark.createDataFrame([(1, "in Paris, Rue 5 b@c.de"), (2, None), (3, "é😀 paris")], "id INT, text STRING")
    words = spark.createDataFrame([("paris", "GIVENNAME1"), ("de", "STATE")], "term STRING, label STRING")
    done = redact_merged(df, "text", dictionary=words, make_predict=lambda: answer, order=("rules", "lists", "model"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(sequence" not in plan and "data redaction assistant" not in plan
    rows = done.orderBy("id").collect()
    assert tuples(rows[0]["pii_entities"]) == [("GIVENNAME1", "Paris", 3, 8), ("CITY", ", Rue 5", 8, 15), ("EMAIL", "b@c.de", 16, 22)]
    assert rows[1]["pii_entities"] == [] and tuples(rows[2]["pii_entities"]) == [("GIVENNAME1", "paris", 3, 8)]


def test_rows_with_many_crossings_are_swept_alike(monkeypatch):
    rng = random.Random(4)
    rows = [sorted((rng.randrange(40), rng.randrange(50), rng.choice("PQ")) for _ in range(rng.randrange(30))) for _ in range(60)]
    row = np.repeat(np.arange(60), [len(r) for r in rows])
    flat = [s for r in rows for s in r]
    column = (row, np.array([s[0] for s in flat]), np.array([s[1] for s in flat]), pa.array([s[2] for s in flat]))
    found = []
    for few in (0, 1000):
        monkeypatch.setattr(merge, "FEW", few)
        found.append([list(x) for x in merge._held([column, column], np.full(60, 45))])
    assert found[0] == found[1] and len(found[0][0]) > 100
