import json
import sys

from pyspark import cloudpickle

from spanveil.operators import answer_table
from spanveil.operators.answer_table import read_table, redact_with_table
from spanveil.operators.answers import NOT_ASKED, _answer_batch, redact_with

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_of(prompt):
    return prompt.rsplit('"""', 2)[1]


def answer(text):
    return json.dumps({"redacted_text": f"[X] {text}", "pii_entities": [{"label": "X", "value": text}]})


def logged(log, bad=(), garbage=()):
    """A model that notes what it answers, fails on ``bad`` and gives garbage for ``garbage``."""

    def make():
        def predict(prompts):
            texts = [text_of(p) for p in prompts]
            if any(t in bad for t in texts):
                raise RuntimeError("bad text")
            with open(log, "a") as file:
                file.writelines(f"{t}\n" for t in texts)
            return ["{" if t in garbage else answer(t) for t in texts]

        return predict

    return make


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")


def asked(log):
    return sorted(open(log).read().split()) if log.exists() else []


def test_same_rows_as_without_a_table(spark, tmp_path):
    texts = ["a", "b", None, "", "a", "odd", "ä 😀"]
    make = logged(tmp_path / "log", bad={"odd"})
    plain = redact_with(frame(spark, texts), "text", make)
    kept = redact_with_table(frame(spark, texts), "text", make, f"{tmp_path}/table")
    assert kept.columns == plain.columns
    assert kept.orderBy("id").collect() == plain.orderBy("id").collect()


def test_a_text_is_asked_once_and_a_rerun_asks_none_of_the_answered(spark, tmp_path):
    log, table = tmp_path / "log", f"{tmp_path}/table"
    texts = [f"t{i % 20}" for i in range(200)] + ["bad"]
    redact_with_table(frame(spark, texts), "text", logged(log, bad={"bad"}), table).collect()
    assert asked(log) == sorted(f"t{i}" for i in range(20))
    log.unlink()
    done = redact_with_table(frame(spark, [*texts, "new"]), "text", logged(log), table)
    assert asked(log) == ["bad", "new"]
    assert done.where("failed").count() == 0 and done.count() == 202


def test_ten_bad_texts_in_a_row_leave_the_good_ones_answered(spark, tmp_path, monkeypatch):
    log, table = tmp_path / "log", f"{tmp_path}/table"
    monkeypatch.setattr(answer_table, "TASK_PROMPTS", 1000)
    bad = {f"bad{i}" for i in range(30)}
    texts = [*sorted(bad), *(f"good{i}" for i in range(60))]
    rows = redact_with_table(frame(spark, texts), "text", logged(log, bad), table).orderBy("id").collect()
    assert [r["failed"] for r in rows] == [True] * 30 + [False] * 60
    assert {r["failure"] for r in rows[:30]} == {"RuntimeError: bad text"}
    assert asked(log) == sorted(f"good{i}" for i in range(60))


def test_a_list_that_is_given_up(tmp_path):
    """What stands behind the failures is left for another pass, in which it may be first."""
    calls = []

    def predict(prompts):
        calls.append(len(prompts))
        if any(p.startswith("bad") for p in prompts):
            raise RuntimeError("bad text")
        return [p.upper() for p in prompts]

    prompts = ["a", "b", *(f"bad{i}" for i in range(10)), "c", "d"]
    found = _answer_batch(predict, prompts, give_up=8)
    assert [a for a, _ in found[:2]] == ["A", "B"] and [w for _, w in found[-4:]] == [NOT_ASKED] * 4
    assert [w for _, w in found[2:10]] == ["RuntimeError: bad text"] * 8
    assert [a for a, _ in _answer_batch(predict, prompts)] == ["A", "B", *[None] * 10, "C", "D"]


def test_answers_that_cannot_be_read_are_asked_for_again(spark, tmp_path):
    log, table = tmp_path / "log", f"{tmp_path}/table"
    rows = redact_with_table(frame(spark, ["x", "junk"]), "text", logged(log, garbage={"junk"}), table, passes=2).orderBy("id").collect()
    assert asked(log) == ["junk", "junk", "x"]
    assert [(r["failed"], r["failure"]) for r in rows] == [(False, None), (True, "answer cannot be read")]
    assert {(r["attempt"], r["usable"]) for r in read_table(spark, table).collect()} == {(1, True), (1, False), (2, False)}


def test_rounds_are_kept_when_a_run_ends_early(spark, tmp_path):
    """A run that dies in a later round loses that round alone."""
    log, table = tmp_path / "log", f"{tmp_path}/table"
    texts = [f"t{i}" for i in range(60)]
    first = frame(spark, texts)
    broken = tmp_path / "broken"

    def make():
        if broken.exists():
            raise SystemExit("the worker dies")
        inner = logged(log)()

        def predict(prompts):
            out = inner(prompts)
            if len(open(log).read().split()) >= 20:
                broken.touch()
            return out

        return predict

    try:
        redact_with_table(first, "text", make, table, round_prompts=20, batch_size=5)
        raise AssertionError("the run went on")
    except Exception as problem:
        assert "the run went on" not in str(problem)
    kept = {r["answer"] for r in read_table(spark, table).where("usable").collect()}
    broken.unlink()
    before = asked(log)
    assert 20 <= len(kept) < 60
    done = redact_with_table(first, "text", logged(log), table)
    assert done.where("failed").count() == 0
    again = asked(log)
    assert len(again) - len(before) == 60 - len(kept)


def test_empty_table_and_clashing_names(spark, tmp_path):
    df = frame(spark, ["x"]).selectExpr("id AS digest", "text AS answer", "id AS usable", "text")
    done = redact_with_table(df, "text", logged(tmp_path / "log"), f"{tmp_path}/table")
    row = done.first()
    assert (row["digest"], row["answer"], row["usable"], row["redacted_text"]) == (0, "x", 0, "[X] x")
    nothing = redact_with_table(df.where("false"), "text", logged(tmp_path / "log"), f"{tmp_path}/other")
    assert nothing.collect() == []
