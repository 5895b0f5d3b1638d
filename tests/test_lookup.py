import random
import re
import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import detect, tuples
from spanveil.functions.word_runs import WORD_CLASS, WordRuns, character_tables
from spanveil.operators.lookup import list_bytes, redact_with_lists
from spanveil.operators.rules import DEFAULT_RULES
from spanveil.streaming.redact_stream import read_redacted, read_text_stream, redact_stream

TERMS = [
    ("New York", "STATE"),
    ("New  York City", "CITY"),
    ("York", "LASTNAME1"),
    ("new", "TITLE"),
    ("Paris", "CITY"),
    ("alice", "GIVENNAME1"),
    ("Élise", "GIVENNAME1"),
    ("paris", "GIVENNAME2"),
    ("X_1", "STATE"),
]
TEXTS = [
    "Alice went to PARIS, alice@paris.fr did not; parisian Élise",
    "nothing here",
    "",
    "paris.paris-Paris 1.2.3.4paris",
    "a X_1 X_12 x_1",
    "In new york city, New\tYork,\nNEW \n YORK CITY; New. York; newyork New 1.2.3.4 York",
    None,
]


def expected(text, labels):
    """Rule spans first, then whole listed terms in the plain parts, longest first."""
    if text is None:
        return []
    terms = sorted(labels, key=len, reverse=True)
    listed = re.compile(r"(?<!\w)(" + "|".join(t.replace(" ", r"\s+") for t in terms) + r")(?!\w)", re.I)
    _, ruled = detect(text, DEFAULT_RULES)
    spans, at = [], 0
    for label, value, start, end in [*ruled, (None, "", len(text), len(text))]:
        for m in listed.finditer(text[at:start]):
            key = " ".join(m.group().lower().split())
            spans.append((labels[key], m.group(), at + m.start(), at + m.end()))
        if label:
            spans.append((label, value, start, end))
        at = end
    return spans


@pytest.mark.parametrize("how", [{}, {"part_bytes": 30}, {"part_bytes": 1}])
def test_lists_all_ways(spark, how):
    dictionary = spark.createDataFrame(TERMS, "term STRING, label STRING")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id INT, text STRING")
    rows = redact_with_lists(df, "text", dictionary, **how).orderBy("id").collect()
    labels = {}
    for term, label in sorted(TERMS, key=lambda t: t[1], reverse=True):
        labels[" ".join(term.lower().split())] = label
    for text, row in zip(TEXTS, rows, strict=True):
        assert tuples(row["pii_entities"]) == expected(text, labels)
    assert rows[0]["redacted_text"] == "[GIVENNAME1] went to [CITY], [EMAIL] did not; parisian [GIVENNAME1]"


def test_rows_that_share_an_id_or_have_none(spark):
    dictionary = spark.createDataFrame(TERMS, "term STRING, label STRING")
    df = spark.createDataFrame([(1, "Paris"), (1, "alice"), (None, "York")], "id INT, text STRING")
    rows = redact_with_lists(df, "text", dictionary, part_bytes=20).collect()
    assert sorted((r["text"], r["redacted_text"]) for r in rows) == [
        ("Paris", "[CITY]"), ("York", "[LASTNAME1]"), ("alice", "[GIVENNAME1]")
    ]


def test_types_and_bad_terms(spark):
    df = spark.createDataFrame([(1, "Paris alice")], "id INT, text STRING")
    dictionary = spark.createDataFrame(TERMS, "term STRING, label STRING")
    row = redact_with_lists(df, "text", dictionary, types=["CITY"]).first()
    assert row["redacted_text"] == "[CITY] alice"
    none = redact_with_lists(df, "text", dictionary, types=["EMAIL"]).first()
    assert none["redacted_text"] == "Paris alice" and none["pii_entities"] == []
    punctuated = spark.createDataFrame([("St. John", "CITY")], "term STRING, label STRING")
    with pytest.raises(ValueError):
        redact_with_lists(df, "text", punctuated)


def test_any_white_space_between_words(spark):
    df = spark.createDataFrame([(1, "in New\u00a0York, New\u2003 York")], "id INT, text STRING")
    dictionary = spark.createDataFrame([("New\u00a0York", "CITY")], "term STRING, label STRING")
    assert redact_with_lists(df, "text", dictionary).first()["redacted_text"] == "in [CITY], [CITY]"


def test_many_terms_and_a_long_text(spark):
    terms = [(f"name{i}", "LASTNAME1") for i in range(4_900)] + [(" ".join(f"w{i}" for i in range(60)), "TITLE")]
    dictionary = spark.createDataFrame(terms, "term STRING, label STRING")
    words = [f"name{i % 9_800}" for i in range(20_000)]
    df = spark.createDataFrame([(1, " ".join(words))], "id INT, text STRING")
    redact_with_lists(df.limit(0), "text", dictionary).collect()
    started = time.monotonic()
    row = redact_with_lists(df, "text", dictionary).first()
    assert time.monotonic() - started < 8
    assert len(row["pii_entities"]) == sum(i % 9_800 < 4_900 for i in range(20_000))


def test_no_text_is_exchanged(spark, sf):
    dictionary = spark.createDataFrame(TERMS, "term STRING, label STRING")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = redact_with_lists(docs, "text", dictionary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_long_list_is_one_join_of_hashes(spark, sf):
    dictionary = spark.createDataFrame(TERMS, "term STRING, label STRING")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    done = redact_with_lists(docs, "text", dictionary, part_bytes=0)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    # Hashes meet first; what they find goes back to the rows.
    assert len(joins) == 2 and "hash" in joins[1] and "_row" in joins[0], joins


words_of_any_kind = st.text(st.sampled_from("abAB ßΣσςİi\u0307é_1-'.\u00a0\n\t"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(words_of_any_kind, min_size=1, max_size=4))
def test_words_and_runs(texts):
    """Words, their places, what lies between them, and hashes, as a regular expression finds them."""
    runs = WordRuns(*character_tables())
    words = runs.words(texts)
    want = [(k, *m.span()) for k, text in enumerate(texts) for m in regex.finditer(f"[{WORD_CLASS}]+", text)]
    assert list(zip(words.text, words.start, words.end)) == want
    for i, (a, b) in enumerate(zip(want, want[1:])):
        assert words.joined[i] == (a[0] == b[0] and texts[a[0]][a[2] : b[1]].isspace())
    for n, (first, last, hashes) in enumerate(runs.of_lengths(words, [1, 2, 3]), 1):
        expected = [i for i in range(len(want) - n + 1) if all(words.joined[i : i + n - 1])]
        assert list(first) == expected and list(last) == [i + n - 1 for i in expected]
        keys = [" ".join(texts[want[i][0]][want[j][1] : want[j][2]].lower() for j in range(i, i + n)) for i in expected]
        if keys:
            assert list(runs.term_hashes(keys)) == list(hashes)


def test_hashes_across_chunks(monkeypatch):
    from spanveil.functions import word_runs

    text = " ".join(f"word{i % 50}" for i in range(400)) + " " + "x" * 300
    whole = WordRuns(*character_tables()).words([text, text])
    monkeypatch.setattr(word_runs, "CHUNK", 64)
    cut = WordRuns(*character_tables()).words([text, text])
    assert (whole.hashes == cut.hashes).all() and (whole.hashes[:401] == whole.hashes[401:]).all()


@pytest.mark.parametrize("seed", range(3))
def test_long_and_short_lists_agree(spark, seed):
    """Random texts over few words, so that terms nest, overlap and repeat; a third of the rows are one text."""
    rng = random.Random(seed)
    vocabulary = ["ab", "AB", "c", "d_e", "É", "x1", "Σας"]
    terms = {" ".join(rng.choices(vocabulary, k=rng.choice([1, 1, 2, 3]))).lower(): rng.choice("PQR") for _ in range(12)}
    dictionary = spark.createDataFrame(list(terms.items()), "term STRING, label STRING")
    texts = ["".join(w + rng.choice([" ", "  ", "\n", ", ", "-"]) for w in rng.choices(vocabulary, k=30)) for _ in range(40)]
    texts += [texts[0]] * 20 + ["", None, "a@b.cd " + texts[1]]
    df = spark.createDataFrame([(i % 7, t, "x") for i, t in enumerate(texts)], "id INT, text STRING, label STRING")
    key = lambda r: (str(r["id"]), str(r["text"]))
    short = sorted(redact_with_lists(df, "text", dictionary).collect(), key=key)
    long = sorted(redact_with_lists(df, "text", dictionary, part_bytes=0).collect(), key=key)
    assert short == long and sum(len(r["pii_entities"]) for r in short) > 100


def test_a_long_list_and_a_hot_term(spark):
    """Ten parts' worth of terms; one term stands in every row and many times in one."""
    dictionary = spark.range(3000).selectExpr("concat('name', id) AS term", "'LASTNAME1' AS label")
    df = spark.range(600).selectExpr("id", "concat('name7 and name', id, repeat(' name7', if(id = 5, 20000, 1))) AS text")
    size = list_bytes(dictionary)
    rows = redact_with_lists(df, "text", dictionary, part_bytes=size // 10).selectExpr("id", "size(pii_entities) AS n").collect()
    assert {r["id"]: r["n"] for r in rows} == {i: 20_002 if i == 5 else 3 for i in range(600)}


def test_a_stream_with_a_long_list_after_a_restart(spark, tmp_path):
    """A batch that was written but not noted as done is written again, not twice."""
    dictionary = spark.createDataFrame(TERMS, "term STRING, label STRING")
    rows = [(i, f"{TEXTS[i % 5]} Paris {i}") for i in range(30)]
    schema = "id INT, text STRING"
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    paths = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run(pattern):
        stream = read_text_stream(spark, f"{tmp_path}/in/{pattern}", schema, files_per_batch=1)
        how = {"dictionary": dictionary, "part_bytes": list_bytes(dictionary) // 10, "until_now": True}
        redact_stream(stream, *paths, **how).awaitTermination()

    run("part*")
    found = read_redacted(spark, paths[0])
    batch = redact_with_lists(spark.createDataFrame(rows, schema), "text", dictionary).orderBy("id").collect()
    assert found.columns == ["id", "text", "redacted_text", "pii_entities"]
    assert found.orderBy("id").collect() == batch
    # As if the driver had died behind the last write.
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    run("part*")
    assert read_redacted(spark, paths[0]).orderBy("id").collect() == batch
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"spanveil_batch={k}" for k in range(3)]


def test_a_long_list_on_a_plain_stream_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, "Paris")], "id INT, text STRING").write.parquet(f"{tmp_path}/in")
    dictionary = spark.createDataFrame(TERMS, "term STRING, label STRING")
    stream = read_text_stream(spark, f"{tmp_path}/in", "id INT, text STRING")
    with pytest.raises(ValueError, match="redact_stream"):
        redact_with_lists(stream, "text", dictionary, part_bytes=0)
