import hashlib
import sys

from pyspark import cloudpickle

from spanveil.operators.training_text import MAX_LENGTH, python_tokenizer, sft_examples, sft_labels
from spanveil.plans.jobs import training_set

# The encoder below runs in Python workers, which do not know this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOURCES = [("1", "call  Bob\tnow ", "call [NAME] now"), ("2", "", ""), ("3", "w " * 700, "w " * 700), ("4", "a " * 460, "b c d " * 40)]


def corpus(spark):
    return spark.createDataFrame(SOURCES, "id STRING, source_text STRING, target_text STRING")


def prefix(source):
    return (
        "<|system|>\nYou are a data redaction assistant. You redact PII in the input below and return only the "
        f"redacted text. Do not explain anything.\n<|user|>\n{source}\n<|assistant|>\n"
    )


def word_ids(text):
    return [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) + 1 for w in text.split()]


def expected(encode, source, target, length, pad):
    ids = encode(prefix(source) + target)[:length]
    head = min(len(encode(prefix(source))), length)
    padded = ids + [pad] * (length - len(ids))
    labels = [-100 if i < head or t == pad else t for i, t in enumerate(padded)]
    return padded, [1] * len(ids) + [0] * (length - len(ids)), labels


def check(rows, encode, length, pad):
    assert len(rows) == len(SOURCES)
    for row, (_, source, target) in zip(rows, SOURCES):
        assert (row["input_ids"], row["attention_mask"], row["labels"]) == expected(encode, source, target, length, pad)


def test_examples(spark):
    rows = sft_examples(corpus(spark)).orderBy("id").collect()
    for row, (_, source, target) in zip(rows, SOURCES):
        assert (row["prompt"], row["text"]) == (prefix(source), prefix(source) + target)


def test_whitespace_ids_and_labels(spark):
    check(sft_labels(corpus(spark)).orderBy("id").collect(), word_ids, MAX_LENGTH, 0)
    check(sft_labels(corpus(spark), max_length=7).orderBy("id").collect(), word_ids, 7, 0)


def byte_encoder():
    return lambda texts: [list(t.encode()) for t in texts]


def test_python_tokenizer_with_a_pad_id_that_occurs_in_texts(spark):
    space = ord(" ")
    rows = sft_labels(corpus(spark), tokenizer=python_tokenizer(byte_encoder), pad_id=space).orderBy("id").collect()
    check(rows, lambda t: list(t.encode()), MAX_LENGTH, space)


def test_training_set_takes_the_head_of_both_splits(spark):
    rows = [(str(i), "train" if i % 3 else "validation", "s", "t") for i in range(10, 30)]
    df = spark.createDataFrame(rows, "id STRING, set STRING, source_text STRING, target_text STRING")
    got = [(r["id"], r["set"]) for r in training_set(df, 4, 100).collect()]
    ids = lambda s: [r[0] for r in rows if r[1] == s]
    assert sorted(got) == sorted([(i, "train") for i in ids("train")[:4]] + [(i, "validation") for i in ids("validation")])


def test_an_encoder_is_called_once_per_batch(spark, tmp_path):
    calls = tmp_path / "calls"

    def counting():
        def encode(texts):
            with open(calls, "a") as file:
                file.write(f"{len(texts)}\n")
            return [list(t.encode()) for t in texts]

        return encode

    tokenizer = python_tokenizer(counting)
    df = sft_labels(corpus(spark).coalesce(1), tokenizer=tokenizer)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    check(df.orderBy("id").collect(), lambda t: list(t.encode()), MAX_LENGTH, 0)
    assert [int(n) for n in calls.read_text().split()] == [2 * len(SOURCES)]
    row = corpus(spark).select(tokenizer.ids("source_text", 3).alias("i"), tokenizer.count("source_text", 3).alias("n")).first()
    assert (row["i"], row["n"]) == ([99, 97, 108], 3)
