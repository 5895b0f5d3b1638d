import json

import pytest
from pyspark.sql import functions as F

from brute import tuples
from spanveil.operators import limits
from spanveil.operators.limits import head_n
from spanveil.operators.rules import DEFAULT_TYPES, Rule
from spanveil.plans.jobs import redact_corpus, redact_files, score_results
from spanveil.plans.queries import corpus as derived_corpus
from spanveil.sources import shared
from spanveil.sources.corpus import read_split, split_counts, split_sample, write_splits
from spanveil.sources.results import read_results
from spanveil.sources.type_list import choose_types, read_types
from spanveil.streaming.redact_stream import read_text_stream, redact_stream
from test_answers import fixed_stub


@pytest.fixture(scope="module")
def saved_corpus(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "c")
    derived_corpus(spark, sf).write.parquet(path)
    return path


@pytest.mark.parametrize("n", [None, 0, -1, 1, 3, 4, 5, 99])
def test_head_n(spark, n):
    ids = [5, 1, 4, 4, 4, 2]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "id INT, t STRING").repartition(3)
    got = sorted(r["id"] for r in head_n(df, "id", n).collect())
    assert got == (sorted(ids) if not n else [] if n < 0 else sorted(ids)[:n])


def test_head_n_with_rows_without_an_id(spark):
    df = spark.createDataFrame([(i, str(i)) for i in (3, 1, 2, None, None)], "id INT, t STRING").repartition(3)
    for n, want in ((2, [1, 2]), (3, [1, 2, 3]), (4, [1, 2, 3, None]), (5, [1, 2, 3, None, None]), (9, [1, 2, 3, None, None])):
        got = [r["id"] for r in head_n(df, "id", n).collect()]
        assert sorted(got, key=lambda x: (x is None, x)) == want
    texts = df.selectExpr("CAST(id AS STRING) AS id")
    assert sorted(r["id"] for r in head_n(texts, "id", 2).collect()) == ["1", "2"]


def test_own_labels_survive_without_types(spark, saved_corpus, caplog):
    own = [Rule("COMPANY", "Th[a-z]+")]
    found = redact_corpus(spark, saved_corpus, rules=own)
    assert {s["label"] for r in found.collect() for s in r["pii_entities"]} == {"COMPANY"}
    words = spark.createDataFrame([("the", "ARTICLE")], "term STRING, label STRING")
    listed = redact_corpus(spark, saved_corpus, rules=[], dictionary=words)
    assert {s["label"] for r in listed.collect() for s in r["pii_entities"]} == {"ARTICLE"}
    redact_corpus(spark, saved_corpus, types=["IP", "CITY"])
    assert "CITY" in caplog.text and "IP," not in caplog.text


def test_head_n_filter_reaches_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = head_n(docs, "doc_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(doc_id,2)" in plan and "Sort" not in plan and "Exchange" not in plan


IDS = {
    "long": [0, 1, 2, 2, 2, 3, 700, 701, -5, 2**63 - 1, -(2**63), 10**12, 10**12 + 1, -1, 10**12],
    "smallint": [-32768, 32767, 0, 5, 5, 6, -7],
    "string": ["", "a", "aa", "ab", "b", "Z", "ä", "äa", "日本", "日", "😀", "\uffff", "aa", "aab", "1", "10", "9"],
    "date": ["1969-12-31", "1970-01-01", "2024-02-29", "2024-02-29", "0001-01-01", "9999-12-31"],
    "timestamp": ["2024-01-01 00:00:00.000001", "2024-01-01 00:00:00", "1960-06-01 12:00:00", "2024-01-01 00:00:00"],
}


@pytest.mark.parametrize("kind", IDS)
@pytest.mark.parametrize("parts", [1, 2, 4096])
def test_selection_by_narrowing(spark, monkeypatch, kind, parts):
    """Each n, with ranges cut so finely or coarsely that many rounds are needed."""
    monkeypatch.setattr(limits, "BUCKETS", max(parts, 2))
    monkeypatch.setattr(limits, "FEW", parts)
    ids = IDS[kind]
    df = spark.createDataFrame([(str(i),) for i in ids], "s STRING").selectExpr(f"CAST(s AS {kind}) AS `i.d`").repartition(3)
    want = sorted(ids, key=(lambda x: x.encode()) if kind == "string" else None)
    for n in (1, 2, len(ids) // 2, len(ids) - 1, len(ids), len(ids) + 1):
        got = [r[0] for r in head_n(df, "i.d", n).select(F.col("`i.d`").cast("string")).collect()]
        again = spark.createDataFrame([(str(i),) for i in want[:n]], "s STRING").selectExpr(f"CAST(CAST(s AS {kind}) AS string) AS s").collect()
        assert sorted(got) == sorted(r[0] for r in again)


def test_selection_over_many_ids(spark):
    df = spark.range(0, 3_000_000, 3).selectExpr("id * 7 % 3000017 AS id", "CAST(id * 7 % 3000017 AS STRING) AS s")
    numbers = sorted(3 * i * 7 % 3000017 for i in range(1_000_000))
    for n in (1, 999, 500_000):
        assert head_n(df, "id", n).agg(F.max("id"), F.count("*")).first() == (numbers[n - 1], n)
        assert head_n(df, "s", n).agg(F.max("s"), F.count("*")).first() == (sorted(map(str, numbers))[n - 1], n)
    with pytest.raises(TypeError, match="double"):
        head_n(df.selectExpr("CAST(id AS DOUBLE) AS id"), "id", 3)


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Mail a@b.de\r\nIP 1.2.3.4\rend".encode())
    (tmp_path / "b.txt").write_bytes("é none".encode())
    rows = {r["original_text"]: r for r in redact_files(spark, str(tmp_path / "*.txt")).collect()}
    text = "Mail a@b.de\nIP 1.2.3.4\nend"
    assert set(rows) == {text, "é none"}
    assert rows[text]["redacted_text"] == "Mail [EMAIL]\nIP [IP]\nend"
    assert tuples(rows[text]["pii_entities"]) == [("EMAIL", "a@b.de", 5, 11), ("IP", "1.2.3.4", 15, 22)]


def test_one_file_with_a_model(spark, tmp_path):
    (tmp_path / "sample.txt").write_text("Alice went to Paris.")
    rows = redact_files(spark, str(tmp_path / "sample.txt"), str(tmp_path / "out"), make_predict=fixed_stub).collect()
    assert [r["redacted_text"] for r in rows] == ["[GIVENNAME1] went to [CITY]."]
    assert rows[0].__fields__ == ["original_text", "redacted_text", "pii_entities"]
    lines = [line for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert json.loads(lines[0])["redacted_text"] == "[GIVENNAME1] went to [CITY]."


def test_types_from_file(spark, tmp_path):
    path = tmp_path / "types.txt"
    path.write_bytes("  EMAIL \r\n\r\nIP\n \t\nEMAIL\rÉTÉ".encode())
    assert read_types(spark, str(path)) == ["EMAIL", "IP", "EMAIL", "ÉTÉ"]
    assert read_types(spark, str(tmp_path / "missing.txt")) == list(DEFAULT_TYPES)
    assert choose_types(spark, [], str(path)) == []
    assert choose_types(spark, ["X"], str(path)) == ["X"]
    assert choose_types(spark, None, str(path))[0] == "EMAIL"
    assert choose_types(spark) == list(DEFAULT_TYPES)


def test_redact_corpus_and_score_it(spark, saved_corpus, tmp_path):
    out = str(tmp_path / "out")
    result = redact_corpus(spark, saved_corpus, out)
    assert result.columns == [
        "id", "language", "set", "original_source_text", "original_target_text", "original_privacy_mask",
        "original_span_labels", "redacted_text", "pii_entities", "mbert_text_tokens", "mbert_bio_labels",
    ]
    back = read_results(spark, out)
    assert {r["id"]: r for r in back.collect()} == {r["id"]: r for r in result.collect()}
    overall, labels = score_results(spark, out, per_label=True)
    row = overall.first()
    assert row["tp"] > 0 and (row["fp"], row["fn"]) == (0, 0) and row["f1"] == pytest.approx(1)
    assert labels.count() == len({s["label"] for r in back.collect() for s in r["pii_entities"]})
    assert score_results(spark, out)[1] is None


def test_redact_corpus_limit_and_types(spark, saved_corpus):
    limited = redact_corpus(spark, saved_corpus, limit=7)
    everything = spark.read.parquet(saved_corpus)
    first = sorted(r["id"] for r in everything.select("id").collect())[:7]
    assert sorted(r["id"] for r in limited.collect()) == first
    only = redact_corpus(spark, saved_corpus, types=["IP"])
    assert {s["label"] for r in only.collect() for s in r["pii_entities"]} == {"IP"}


def test_one_indented_array_can_be_scored(spark, tmp_path):
    span = {"label": "A", "value": "v", "start": 0, "end": 1}
    entry = {"id": "1", "pii_entities": [span], "original_privacy_mask": [span, {**span, "start": 4, "end": 5}]}
    path = tmp_path / "results.json"
    path.write_text(json.dumps([entry], indent=2))
    row = score_results(spark, str(path), array_file=True)[0].first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 0, 1)


def test_splits(spark, saved_corpus, tmp_path):
    corpus = spark.read.parquet(saved_corpus)
    other = corpus.limit(1).withColumn("set", F.lit("test"))
    path = str(tmp_path / "splits")
    write_splits(corpus.unionByName(other), path)
    counts = {r["set"]: r["rows"] for r in split_counts(corpus.unionByName(other)).collect()}
    assert counts == {"train": 180, "validation": 20}
    train = read_split(spark, path, "train")
    assert train.count() == 180 and read_split(spark, path, "test").count() == 0
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(set" in plan
    first = split_sample(corpus).first()
    assert first["id"] == min(r["id"] for r in corpus.filter("set = 'train'").select("id").collect())


def test_long_type_file(spark, tmp_path):
    path = tmp_path / "types.txt"
    path.write_text("\n".join(f"T{i}" for i in range(12_000)))
    assert len(read_types(spark, str(path))) == 12_000


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    inbox, out, marks = (str(tmp_path / p) for p in ("in", "out", "marks"))
    first = spark.createDataFrame([(1, "a@b.de"), (2, "none")], "id INT, text STRING")
    second = spark.createDataFrame([(3, "1.2.3.4 x"), (4, None)], "id INT, text STRING")

    def run():
        stream = read_text_stream(spark, inbox, "id INT, text STRING")
        redact_stream(stream, out, marks, until_now=True).awaitTermination()
        return {r["id"]: r["redacted_text"] for r in spark.read.parquet(out).collect()}

    first.write.parquet(inbox)
    assert run() == {1: "[EMAIL]", 2: "none"}
    second.write.mode("append").parquet(inbox)
    assert run() == {1: "[EMAIL]", 2: "none", 3: "[IP] x", 4: None}
    assert spark.read.parquet(out).count() == 4


def test_shared_folder_comes_from_the_session(spark):
    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.folder or default

    class Context:
        master, applicationId = "spark://somewhere:7077", "app-x"

    class Session:
        def __init__(self, folder=None):
            self.conf, self.sparkContext = Conf(folder), Context()

    assert shared.shared_folder(Session("hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        shared.shared_folder(Session())
    assert shared.fresh_path(spark, "a") != shared.fresh_path(spark, "a")
