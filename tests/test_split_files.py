from pyspark.sql import DataFrameWriter

from spanveil.sources.corpus import OPEN_FILES, write_splits


def test_splits_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """a sort of whole rows by split spilled several times the input."""
    seen, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: seen.append(spark.conf.get(OPEN_FILES)) or real(w, *a, **k))
    before = spark.conf.get(OPEN_FILES)
    df = spark.createDataFrame([(i, "validation" if i % 3 else "train") for i in range(50)] + [(99, None), (98, "test")], "id int, set string")
    write_splits(df.coalesce(1), str(tmp_path / "s"))
    assert seen == ["3"] and spark.conf.get(OPEN_FILES) == before
    assert len(list((tmp_path / "s").glob("set=*/*.parquet"))) == 2
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.id, r.set) for r in back.collect()) == sorted((r.id, r.set) for r in df.where("id < 98").collect())
