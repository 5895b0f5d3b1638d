import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from brute import align, tuples
from spanveil.operators.answers import (
    assistant_part,
    chat_prompt,
    json_prompt,
    parse_answer,
    read_chat_answers,
    redact_with,
)

# The stubs below run in Python workers, which do not know this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The case of FIXTURES, section 2, whose offsets are wrong on purpose.
STUB_ANSWER = {
    "redacted_text": "[GIVENNAME1] went to [CITY].",
    "pii_entities": [
        {"label": "GIVENNAME1", "value": "Alice", "start": 0, "end": 5},
        {"label": "CITY", "value": "Paris", "start": 15, "end": 20},
    ],
}


def fixed_stub():
    return lambda prompts: [json.dumps(STUB_ANSWER)] * len(prompts)


def moody_stub():
    """Fails on any batch with a bad text, gives no answer for some, garbage for others."""

    def predict(prompts):
        answers = []
        for p in prompts:
            text = p.rsplit('"""', 2)[1]
            if text == "boom":
                raise RuntimeError("no answer")
            if text == "null":
                answers.append(None)
            elif text == "garbage":
                answers.append("{not json")
            else:
                answers.append(json.dumps({"redacted_text": "[X]", "pii_entities": [{"label": "X", "value": text}]}))
        return answers

    return predict


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")


def test_stub_result_passes_through_with_found_offsets(spark):
    row = redact_with(frame(spark, ["Alice went to Paris."]), "text", fixed_stub).first()
    assert row["redacted_text"] == "[GIVENNAME1] went to [CITY]."
    assert tuples(row["pii_entities"]) == [("GIVENNAME1", "Alice", 0, 5), ("CITY", "Paris", 14, 19)]
    assert row["failed"] is False


def test_only_types(spark):
    df = frame(spark, ["Alice went to Paris."])
    row = redact_with(df, "text", fixed_stub, types=["CITY"], only_types=True).first()
    assert [s["label"] for s in row["pii_entities"]] == ["CITY"]


def test_each_failure_touches_its_own_row_only(spark):
    texts = ["good", "boom", "null", "garbage", "fine", None]
    rows = redact_with(frame(spark, texts).coalesce(1), "text", moody_stub).orderBy("id").collect()
    assert [r["failed"] for r in rows] == [False, True, True, True, False, True]
    assert [r["redacted_text"] for r in rows] == ["[X]", "boom", "null", "garbage", "[X]", None]
    assert [len(r["pii_entities"]) for r in rows] == [1, 0, 0, 0, 1, 0]


def test_answers_that_are_no_texts_fail_alone(spark):
    def make():
        return lambda prompts: [{"a": 1} if "odd" in p else json.dumps(STUB_ANSWER) for p in prompts]

    rows = redact_with(frame(spark, ["odd", "Alice", None]).coalesce(1), "text", make).orderBy("id").collect()
    assert [r["failed"] for r in rows] == [True, False, True]
    assert [r["failure"] for r in rows] == ["no text but dict", None, "no text"]


def test_each_text_is_asked_for_however_many_fail(spark, tmp_path):
    """Ten bad texts in a row take no good one with them; a dead model is asked for each."""
    calls = tmp_path / "calls"

    def make():
        def predict(prompts):
            with calls.open("a") as file:
                file.write("x")
            if any("bad" in p for p in prompts):
                raise OSError("down")
            return [json.dumps(STUB_ANSWER)] * len(prompts)

        return predict

    texts = [f"{'bad' if 20 <= i < 30 else 'good'}{i}" for i in range(100)]
    rows = redact_with(frame(spark, texts).coalesce(1), "text", make).collect()
    assert [r["failed"] for r in rows] == [20 <= i < 30 for i in range(100)]
    assert {r["failure"] for r in rows[20:30]} == {"OSError: down"}
    assert len(calls.read_text()) < 50
    rows = redact_with(frame(spark, [f"bad{i}" for i in range(64)]).coalesce(1), "text", make).collect()
    assert all(r["failure"] == "OSError: down" and r["redacted_text"] == r["text"] for r in rows)


def test_answers_of_wrong_count_are_asked_again_one_by_one(spark):
    def make():
        return lambda prompts: [json.dumps(STUB_ANSWER)]

    rows = redact_with(frame(spark, ["Alice", "Paris", "x"]).coalesce(1), "text", make).collect()
    assert [r["failed"] for r in rows] == [False] * 3


@pytest.mark.parametrize(
    "raw, usable",
    [
        (json.dumps(STUB_ANSWER), True),
        ('{"redacted_text": "x", "pii_entities": []}', True),
        ('{"redacted_text": "x"}', False),
        ('{"pii_entities": []}', False),
        ('{"redacted_text": "x", "pii_entities": [{"label": "A"}]}', False),
        ('{"redacted_text": "x", "pii_entities": [null]}', False),
        ('{"redacted_text": "x", "pii_entities": "none"}', False),
        ("[]", False),
        ('{"redacted_text": "x", "pii_entities": []} done', False),
        ('{"redacted_text": "x", "pii_entities": []}]', False),
        ('{"redacted_text": "x", "pii_entities": []}, "y": 1', False),
        ("{'redacted_text': 'x', 'pii_entities': []}", False),
        ('{"redacted_text": 7, "pii_entities": []}', False),
        ('{"redacted_text": "x", "pii_entities": [{"label": "A", "value": 5}]}', False),
        (' {"redacted_text": "x", "pii_entities": [], "more": [1]}\n', True),
        ("", False),
        ("no json", False),
        (None, False),
    ],
)
def test_parse_answer(spark, raw, usable):
    df = spark.createDataFrame([(raw,)], "raw STRING")
    assert (df.select(parse_answer(F.col("raw"))).first()[0] is not None) is usable


def brute_part(content):
    head, mark, tail = content.partition("<|assistant|>")
    return (tail.split("<|user|>")[0] if mark else head).strip()


def test_assistant_part(spark):
    cases = [
        "<|system|>\ns\n<|user|>\nq\n<|assistant|>\n a [X] \n",
        "<|assistant|>a<|user|>b<|assistant|>c",
        "<|assistant|>a<|assistant|>b",
        "x<|user|>y",
        "  plain　\n",
        "",
        "<|assistant|>",
        "<|user|><|assistant|>é😀<|user|>",
    ]
    df = frame(spark, cases).orderBy("id")
    assert [r[0] for r in df.select(assistant_part(F.col("text"))).collect()] == [brute_part(c) for c in cases]


def test_chat_answers_are_aligned(spark):
    text, content = "Bob is here.", "<|user|>\nBob is here.\n<|assistant|>\n[NAME] is here. "
    df = spark.createDataFrame([(text, content)], "text STRING, content STRING")
    row = read_chat_answers(df, "text", "content").first()
    assert row["redacted_text"] == "[NAME] is here."
    assert tuples(row["pii_entities"]) == align(text, "[NAME] is here.")


def test_prompts(spark):
    df = frame(spark, ["hi {text} 'x' \\ \"y\""])
    chat, js = df.select(chat_prompt(F.col("text"), ["A", "B"]), json_prompt(F.col("text"), ["A", "B"])).first()
    assert chat == (
        "<|system|>\nYou redact PII from input and return redacted version only. Only use the following PII types: "
        "A, B. \n<|user|>\nhi {text} 'x' \\ \"y\"\n<|assistant|>\n"
    )
    assert js.startswith("\n        You are a data redaction assistant.\n\n        Your task")
    assert "PII types: A, B\n" in js
    assert js.endswith('        Input:\n         """hi {text} \'x\' \\ "y""""\n         Output:\n        ')
    assert '\nExample:\nInput: "John Smith' in js and "\n    {\n    \"label\"" in js
