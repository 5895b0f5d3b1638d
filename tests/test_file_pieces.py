import random

import pytest

from spanveil.operators.rules import DEFAULT_RULES, Rule
from spanveil.plans.jobs import redact_files, redact_large_files
from spanveil.sources.file_pieces import read_file_pieces

PARTS = ["Mail jo@x.de", "é😀", "1.2.3.4", "New", "York", "password: a b", " ", "\n", "\r\n", "\r", "\n\n", "x" * 30, "10:30\n2024-01-02"]
ENDS = ["", "\n", "\r\n", "\r", "end", "\n\n"]


def write(path, name, text, mark=False):
    (path / name).write_bytes((b"\xef\xbb\xbf" if mark else b"") + text.encode())


def check(spark, path, piece_bytes, zone, **detection):
    """Pieces put together equal the file as one row, masked text and entities."""
    whole = {}
    for r in redact_files(spark, f"{path}/*.txt", **detection).collect():
        whole.setdefault(r["original_text"], r)
    pieces = {}
    for r in redact_large_files(spark, f"{path}/*.txt", piece_bytes=piece_bytes, zone=zone, **detection).collect():
        pieces.setdefault(r["path"], []).append(r)
    read = {}
    for r in read_file_pieces(spark, f"{path}/*.txt", piece_bytes, zone).orderBy("path", "block", "k").collect():
        assert r["start"] == len(read.get(r["path"], "")) and r["chars"] == len(r["text"])
        read[r["path"]] = read.get(r["path"], "") + r["text"]
    assert sorted(read.values()) == sorted(t for t in whole if t)
    for name, text in read.items():
        rows = sorted(pieces[name], key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [sum(r["chars"] for r in rows[:i]) for i in range(len(rows))]
        assert "".join(r["redacted_text"] for r in rows) == whole[text]["redacted_text"]
        found = [tuple(s) for r in rows for s in r["pii_entities"]]
        assert found == [tuple(s) for s in whole[text]["pii_entities"]]
        assert all(text[a:b] == value for _, value, a, b in found)
    return pieces


@pytest.mark.parametrize("piece_bytes", [1, 150])
def test_pieces_equal_the_whole(spark, tmp_path, piece_bytes):
    rng = random.Random(piece_bytes)
    for i in range(3):
        write(tmp_path, f"{i}.txt", "".join(rng.choice(PARTS) for _ in range(150)) + rng.choice(ENDS) + f" {i}", i % 3 == 0)
    write(tmp_path, "empty.txt", "")
    words = spark.createDataFrame([("new york", "CITY"), ("york", "STATE")], "term STRING, label STRING")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        check(spark, tmp_path, piece_bytes, 40, dictionary=words)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_each_kind_of_end(spark, tmp_path):
    for k, end in enumerate(ENDS):
        for mark in (False, True):
            write(tmp_path, f"{k}{mark}.txt", f"a@b.de {k}{mark}\r\nline" + end, mark)
    check(spark, tmp_path, 4, 1)


def test_entities_across_line_ends(spark, tmp_path):
    """Each cut lies in an entity: all pieces are joined again; one that is not stays apart."""
    write(tmp_path, "a.txt", "on New\nYork\nNew\n\nYork and\nnothing\nNew\n")
    words = spark.createDataFrame([("new york", "CITY")], "term STRING, label STRING")
    pieces = check(spark, tmp_path, 1, 4, dictionary=words, rules=())
    (rows,) = pieces.values()
    assert sorted((r["start"], r["redacted_text"]) for r in rows) == [
        (0, "on [CITY]\n"), (12, "[CITY] and\n"), (26, "nothing\n"), (34, "New\n"),
    ]
    own = [Rule("BLOCK", "<(?:[^>]|\n)+>"), *DEFAULT_RULES]
    write(tmp_path, "a.txt", "x <a\nb\nc> 1.2.3.4\n<\n>\n")
    check(spark, tmp_path, 1, 4, rules=own)


def test_offsets_are_long_and_results_can_be_written(spark, tmp_path):
    write(tmp_path, "a.txt", "a@b.de\n" * 50)
    done = redact_large_files(spark, f"{tmp_path}/a.txt", f"{tmp_path}/out", piece_bytes=30, zone=20)
    assert "start:bigint" in done.schema["pii_entities"].dataType.simpleString()
    assert sum(r["chars"] for r in done.collect()) == 350 and done.count() > 10


def test_a_large_file_over_many_tasks(spark, tmp_path):
    """10 MB in several splits and pieces."""
    line = "Write to jo.doe@example.com or call 555-123-4567 before 2024-02-29, from 10.0.0.1 and so on. "
    with open(tmp_path / "big.txt", "w") as file:
        for i in range(100_000):
            file.write(f"{line}{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        pieces = redact_large_files(spark, f"{tmp_path}/big.txt", f"{tmp_path}/out", output_format="parquet")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = pieces.selectExpr("start", "chars", "size(pii_entities) AS n", "pii_entities[0].start AS first").orderBy("start").collect()
    assert len(rows) >= 9 and sum(r["n"] for r in rows) == 400_000
    size = sum(len(line) + len(str(i)) + 1 for i in range(100_000))
    assert rows[-1]["start"] + rows[-1]["chars"] == size and all(r["first"] == r["start"] + 9 for r in rows)
