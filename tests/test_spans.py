import random

import pytest
from pyspark.sql import functions as F

from brute import align, recover, tuples
from spanveil.functions.arrays import running_total
from spanveil.functions.text import WHITESPACE, normalise_newlines, strip
from spanveil.operators.align import SMALLEST_BLOCK, align_redaction
from spanveil.operators.recover import approximate_start, recover_spans, unlocated_values

ENTITIES = "ARRAY<STRUCT<label: STRING, value: STRING>>"

ALIGN_CASES = [
    ("Bob is here.", "[NAME] is here.", [("NAME", "Bob", 0, 3)]),
    ("John Smith went home", "[NAME] went home", [("NAME", "John", 0, 4)]),
    ("Alice went to Paris.", "[GIVENNAME1] went to [CITY].", [("CITY", "", 21, 20)]),
    ("AB cd", "[A][B] cd", [("A", "AB cd", 0, 5), ("B", "", 5, 5)]),
    ("é😀 x y", "[A] [B] y", [("A", "é😀", 0, 2), ("B", "x", 3, 4)]),
    ("ab", "xx [A][B] long tail [C]", [("A", "", 3, 2), ("B", "", 2, 2), ("C", "", 13, 2)]),
    ("abc", "no placeholder", []),
    ("", "", []),
    ("abc", "[A]", [("A", "abc", 0, 3)]),
]


def run_align(spark, pairs, placeholder="[A-Z]+"):
    df = spark.createDataFrame([(i, o, r) for i, (o, r) in enumerate(pairs)], "id INT, o STRING, r STRING")
    rows = align_redaction(df, "o", "r", placeholder).orderBy("id").collect()
    return [tuples(r["pii_entities"]) for r in rows]


def test_align_cases(spark):
    got = run_align(spark, [(o, r) for o, r, _ in ALIGN_CASES])
    assert got == [want for _, _, want in ALIGN_CASES]


def test_align_digit_labels_on_request(spark):
    got = run_align(spark, [("Alice went to Paris.", "[GIVENNAME1] went to [CITY].")], "[A-Z]+[0-9]*")
    assert got == [[("GIVENNAME1", "Alice", 0, 5), ("CITY", "Paris", 14, 19)]]


def random_text(rng, alphabet, most):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(most)))


def test_align_random(spark):
    rng = random.Random(7)
    pairs = [
        (random_text(rng, "ab é😀[]XY", 40), "".join(rng.choice(["a", "b ", "é", "😀", "[", "[X]", "[YZ]", "[A1]"]) for _ in range(rng.randrange(14))))
        for _ in range(400)
    ]
    assert run_align(spark, pairs) == [align(o, r) for o, r in pairs]


@pytest.mark.parametrize("words", [SMALLEST_BLOCK, SMALLEST_BLOCK + 1, 3 * SMALLEST_BLOCK, 3_000])
def test_align_many_placeholders_crosses_blocks(spark, words):
    rng = random.Random(words)
    parts = [random_text(rng, "abcdé😀", 8) + "x" for _ in range(words)]
    original = " ".join(parts)
    some = " ".join("[W]" if rng.random() < 0.8 else p for p in parts)
    every = " ".join("[W]" for _ in parts)
    assert run_align(spark, [(original, some), (original, every)]) == [align(original, some), align(original, every)]


RECOVER_CASES = [
    ("Phone: (555) 123-4567", [("TEL", "(555) 123-4567")], [("TEL", "(555) 123-4567", 7, 21)]),
    ("a a a", [("A", "a"), ("B", "a"), ("C", "a a")], [("A", "a", 0, 1), ("C", "a a", 0, 3)]),
    ("call 5551234 now", [("TEL", "555 1234")], [("TEL", "555 1234", 5, 13)]),
    ("ab  c", [("M", "b c")], []),
    ("", [("E", "")], [("E", "", 0, 0)]),
    ("abc", [("E", "  ")], [("E", "  ", 0, 2)]),
    ("", [("E", "  ")], []),
    ("x", [], []),
]


def run_recover(spark, cases):
    df = spark.createDataFrame(
        [(i, t, e) for i, (t, e) in enumerate(cases)], f"id INT, t STRING, e {ENTITIES}"
    )
    rows = recover_spans(df, "t", "e").orderBy("id").collect()
    return [tuples(r["pii_entities"]) for r in rows]


def test_recover_cases(spark):
    assert run_recover(spark, [(t, e) for t, e, _ in RECOVER_CASES]) == [w for _, _, w in RECOVER_CASES]


def test_recover_random(spark):
    rng = random.Random(11)
    cases = [
        (random_text(rng, "ab  é😀", 20), [(rng.choice("XY"), random_text(rng, "ab é😀", 5)) for _ in range(rng.randrange(6))])
        for _ in range(400)
    ]
    assert run_recover(spark, cases) == [recover(t, e) for t, e in cases]


def test_unlocated_values(spark):
    df = spark.createDataFrame([(1, "ab", [("X", "b"), ("Y", "zz")])], f"id INT, t STRING, e {ENTITIES}")
    assert [tuple(r) for r in unlocated_values(df, "t", "e", "id").collect()] == [(1, 1, "Y", "zz")]


@pytest.mark.parametrize("text, value, want", [
    ("The ID is AB1234", "AB1234", 10), ("The ID is AB1234", "AB 1234", 10), ("", " ", None), ("x", " ", 0), ("x", "y", None),
])
def test_approximate_start(spark, text, value, want):
    df = spark.createDataFrame([(text, value)], "t STRING, v STRING")
    assert df.select(F.expr(approximate_start("t", "v"))).first()[0] == want


def test_running_total(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 8, 9, 100, 1025):
        numbers = [rng.randrange(9) for _ in range(n)]
        df = spark.createDataFrame([(numbers,)], "n ARRAY<INT>")
        want, total = [], 0
        for x in numbers:
            total += x
            want.append(total)
        assert df.select(F.expr(running_total("n"))).first()[0] == want


def test_strip_and_newlines_follow_python(spark):
    cases = ["", " a ", WHITESPACE + "a b" + WHITESPACE, " x ", "\x1cq\x85", "​z", "a\r\nb\rc\n"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, c STRING").orderBy("i")
    rows = df.select(strip(F.col("c")).alias("s"), normalise_newlines(F.col("c")).alias("n")).collect()
    assert [r["s"] for r in rows] == [c.strip() for c in cases]
    assert [r["n"] for r in rows] == [c.replace("\r\n", "\n").replace("\r", "\n") for c in cases]
