import random
import time

import pytest
from pyspark.sql import functions as F

from brute import detect, tuples
from spanveil.functions.spans import span_rows
from spanveil.operators.detect import MARK, SLOT, redact
from spanveil.operators.rules import BROAD_RULES, DEFAULT_RULES, DEFAULT_TYPES, Rule

LABELLED = [
    ("EMAIL", "write to {} now", "jo.doe+x@mail.example.co.uk"),
    ("IP", "host {} is up", "10.0.255.1"),
    ("TEL", "call {}.", "+1 (555) 123-4567"),
    ("TEL", "Phone: {}", "(555) 123-4567"),
    ("TEL", "Phone {}", "555-123-4567"),
    ("SOCIALNUMBER", "ssn {}", "123-45-6789"),
    ("DATE", "on {} we", "2024-02-29"),
    ("DATE", "on {} we", "3rd March, 2021"),
    ("TIME", "at {} sharp", "10:30:15 pm"),
    ("GEOCOORD", "near {}!", "48.8584, -2.2945"),
    ("TITLE", "dear {} Smith", "Prof."),
    ("DOB", "Date of Birth: {}", "01/02/1990"),
    ("PASS", "password = \"{}\"", "hunter2!"),
    ("PASSPORT", "Passport no.: {}", "X1234567"),
    ("IDCARD", "ID card: {}", "AB-12345"),
    ("DRIVERLICENSE", "driver's license: {}", "D1234-5678"),
    ("USERNAME", "username: {}", "jo_doe"),
    ("POSTCODE", "zip code: {}", "90210"),
    ("SEX", "Gender: {}", "female"),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")


def results(df):
    return [(r["redacted_text"], tuples(r["pii_entities"])) for r in df.orderBy("id").collect()]


def test_each_default_rule(spark):
    texts = [t.format(v) for _, t, v in LABELLED]
    for (label, template, value), (masked, spans) in zip(LABELLED, results(redact(frame(spark, texts)))):
        at = template.index("{}")
        assert spans == [(label, value, at, at + len(value))]
        assert masked == template.format(f"[{label}]")


def test_rule_labels_are_types():
    assert {r.label for r in DEFAULT_RULES + BROAD_RULES} <= set(DEFAULT_TYPES)
    assert len(DEFAULT_TYPES) == len(set(DEFAULT_TYPES)) == 27


def test_null_empty_and_reserved_characters(spark):
    got = results(redact(frame(spark, [None, "", "plain", f"a{MARK}1.2.3.4{SLOT}b@c.de", f"1.2{MARK}.3.4"])))
    assert got == [
        (None, []),
        ("", []),
        ("plain", []),
        (f"a{MARK}[IP]{SLOT}[EMAIL]", [("IP", "1.2.3.4", 2, 9), ("EMAIL", "b@c.de", 10, 16)]),
        (f"1.2{MARK}.3.4", []),
    ]


WHOLE = [
    ("x" * 80 + "@ex.com", "[EMAIL]"),
    ("a@b.com1", "[EMAIL]"),
    ("passport: AB1234567890123", "passport: [PASSPORT]"),
    ("id card: " + "A1" * 15, "id card: [IDCARD]"),
    ("driving license: " + "A1" * 15, "driving license: [DRIVERLICENSE]"),
    ("user: " + "u" * 80, "user: [USERNAME]"),
    ("123-45-67890", "[SOCIALNUMBER]"),
    ("9123-45-6789", "[SOCIALNUMBER]"),
    ("1234.5.6.78901", "[IP]"),
    ("1.2.3.4.5", "[IP]"),
    ("10:30:5", "[TIME]"),
    ("2024-01-123", "[DATE]"),
    ("123/4/56", "[DATE]"),
    ("May 12345", "[DATE]"),
    ("1555-123-45678", "[TEL]"),
    ("zip: 1234567", "zip: [POSTCODE]"),
    ("zip: 90210 something", "zip: [POSTCODE] something"),
    ("sex: malevolent", "sex: malevolent"),
    ("sex: male.", "sex: [SEX]."),
    ("jürgen@ex.com", "[EMAIL]"),
    ("müller.x@ex.com", "[EMAIL]"),
    ("a@exämple.com", "[EMAIL]"),
    ("пример@почта.рф!", "[EMAIL]!"),
    ("e\u0301.x@ex.com", "[EMAIL]"),
    ("password: geheim§12", "password: [PASS]"),
    ("password: p@ss:word:tail", "password: [PASS]"),
    ("password=\"(x{y}z)\", user=ab;", "password=\"[PASS]\", user=[USERNAME];"),
    ("token: ab:cd:ef", "token: [PASS]"),
    ("token: abc=def123", "token: [PASS]"),
    ("token: abc\u00a0d", "token: abc\u00a0d"),
    ("zip: 12345-678901", "zip: [POSTCODE]"),
    ("zip: AB1 2CD", "zip: [POSTCODE]"),
    ("passport: AB123456-789", "passport: [PASSPORT]"),
    ("passport: ABCDEFG", "passport: [PASSPORT]"),
    ("passport: please wait", "passport: please wait"),
    ("id card: ab-123456", "id card: [IDCARD]"),
    ("id card: ABCDEf-g", "id card: [IDCARD]"),
    ("driving license: d12345", "driving license: [DRIVERLICENSE]"),
    ("user: jürgen_x", "user: [USERNAME]"),
    ("user: bobü", "user: [USERNAME]"),
    ("12:30abc@x.com", "[TIME][EMAIL]"),
]


def test_no_tail_of_a_longer_value_is_left(spark):
    got = results(redact(frame(spark, [t for t, _ in WHOLE])))
    assert [masked for masked, _ in got] == [want for _, want in WHOLE]


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "1-" * 1_000_000, "a@" * 500_000, "A-" * 1_000_000,
                                  "ä" * 2_000_000 + "@", "token: " + "," * 2_000_000, "id card: " + "a-" * 1_000_000])
def test_long_junk_takes_linear_time(spark, text):
    started = time.monotonic()
    redact(frame(spark, [text])).collect()
    assert time.monotonic() - started < 40


def test_bad_rules_are_refused():
    for pattern in ("(c)at", "[0-9]*", "(?P<n>x)"):
        with pytest.raises(ValueError, match="rule BAD"):
            Rule("BAD", pattern)


def test_types_restrict_detection(spark):
    df = frame(spark, ["a@b.de 1.2.3.4"])
    assert results(redact(df, types=["IP"])) == [("a@b.de [IP]", [("IP", "1.2.3.4", 7, 14)])]
    assert results(redact(df, types=[])) == [("a@b.de 1.2.3.4", [])]
    assert results(redact(df, types=["CITY"])) == [("a@b.de 1.2.3.4", [])]


def test_callers_rules_and_priority(spark):
    df = frame(spark, ["1234567812345678 x 42"])
    rules = (Rule("CARD", "[0-9]{16}"), Rule("NUM", "[0-9]+"))
    assert results(redact(df, rules=rules))[0][0] == "[CARD] x [NUM]"
    assert results(redact(df, rules=rules[::-1]))[0][0] == "[NUM] x [NUM]"
    assert results(redact(df, types=["NUM"], rules=rules))[0][0] == "[NUM] x [NUM]"


def test_label_and_pattern_with_quotes(spark):
    df = frame(spark, ["it's \\d"])
    rules = (Rule("IT'S", r"'[a-z]"), Rule("BACK\\", r"\\d"))
    assert results(redact(df, rules=rules))[0][0] == "it[IT'S] [BACK\\]"


@pytest.mark.parametrize("rules", [DEFAULT_RULES, DEFAULT_RULES + BROAD_RULES, DEFAULT_RULES[::-1]])
def test_random_texts_against_plain_regex(spark, rules):
    rng = random.Random(len(rules))
    parts = ["a@b.co", "1.2.3.4", ".5", "+1 (555) 123-4567", " ", "x", "é", "😀", "password: ", "dob:", "1990-01-02",
             "12:30", "Dr.", "@", "-", "token=\"abcd\"", "zip: 123 ", "May 4", "9 Main Street", "PassPort#AB12345", "\n", "user:", "["]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)]
    assert results(redact(frame(spark, texts), rules=rules)) == [detect(t, rules) for t in texts]


def test_documents_against_plain_regex(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    got = results(redact(docs))
    assert got == [detect(r["text"], DEFAULT_RULES) for r in docs.orderBy("id").collect()]


def test_spans_are_slices_and_disjoint_and_redaction_is_stable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    once = redact(docs)
    rows = span_rows(once, "pii_entities", "doc_id", "text").orderBy("doc_id", "pos").collect()
    assert rows
    last = (None, 0)
    for r in rows:
        assert r["text"][r["start"]:r["end"]] == r["value"]
        assert r["doc_id"] != last[0] or r["start"] >= last[1]
        last = (r["doc_id"], r["end"])
    again = redact(once.select("doc_id", F.col("redacted_text").alias("text")))
    assert again.filter("text <> redacted_text").count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i % 256}.0.0.{i % 200}" for i in range(20_000))
    (masked, spans), = results(redact(frame(spark, [text])))
    assert masked == " ".join(["[IP]"] * 20_000)
    assert len(spans) == 20_000 and all(text[s:e] == v for _, v, s, e in spans)


def test_plan_scans_once_and_has_no_exchange(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = span_rows(redact(docs), "pii_entities", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Filter (" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
