"""Model-backed redaction around a caller's predict function.

Only the call itself runs in Python, in Arrow batches on the executors. The
prompt before it and the reading of the answer after it are expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import NO_SPANS
from spanveil.functions.text import name, strip
from spanveil.operators.align import PLACEHOLDER, align_spans
from spanveil.operators.recover import recovered_spans
from spanveil.operators.rules import DEFAULT_TYPES

Predict = Callable[[list[str]], Sequence[str | None]]

# Prompts per call of the caller's function.
BATCH_SIZE = 256

# The reason of a prompt that was passed over.
NOT_ASKED = "not asked"

ANSWER_DDL = "redacted_text STRING, pii_entities ARRAY<STRUCT<label: STRING, value: STRING>>"

# Markers and prompt texts, which models are tuned to word by word.
USER_MARK = "<|user|>"
ASSISTANT_MARK = "<|assistant|>"
CHAT_PROMPT = (
    "<|system|>\nYou redact PII from input and return redacted version only. "
    "Only use the following PII types: {types}. \n<|user|>\n{text}\n<|assistant|>\n"
)
JSON_PROMPT = '''
        You are a data redaction assistant.

        Your task is to identify all Personally Identifiable Information (PII) in the following text and redact them.

        Redact each PII by replacing it with [label] (in uppercase, in square brackets).
        Only use the following PII types: {types}

        For each PII entity found, return:
        - "label": the PII type (from the list above)
        - "value": the original text span
        - "start": the character index where the PII starts in the original text
        - "end": the character index where the PII ends (exclusive)
        Example:
        
Example:
Input: "John Smith's phone number is (555) 123-4567 and his email is john.smith@example.com."
Output:
{
"redacted_text": "[NAME]'s phone number is [PHONE] and his email is [EMAIL].",
"pii_entities": [
    {
    "label": "NAME",
    "value": "John Smith",
    "start": 0,
    "end": 10
    },
    {
    "label": "PHONE",
    "value": "(555) 123-4567",
    "start": 30,
    "end": 45
    },
    {
    "label": "EMAIL",
    "value": "john.smith@example.com",
    "start": 63,
    "end": 86
    }
]
}

        Respond in **valid JSON**. Do not include any other explanation.
        Input:
         """{text}"""
         Output:
        '''


def _fill(template: str, text: Column, types: Sequence[str]) -> Column:
    before, after = _around(template, types)
    return F.concat(F.lit(before), text, F.lit(after))


def _around(template: str, types: Sequence[str]) -> tuple[str, str]:
    before, after = template.split("{text}")
    return before.replace("{types}", ", ".join(types)), after


def chat_prompt(text: Column, types: Sequence[str] = DEFAULT_TYPES) -> Column:
    """Prompt for a model that answers with the masked text."""
    return _fill(CHAT_PROMPT, text, types)


def json_prompt(text: Column, types: Sequence[str] = DEFAULT_TYPES) -> Column:
    """Prompt for a model that answers with JSON."""
    return _fill(JSON_PROMPT, text, types)


def assistant_part(content: Column) -> Column:
    """The part after the first assistant marker, up to the next user marker.

    Without an assistant marker it is the whole content. Stripped either way.
    """
    at = F.position(F.lit(ASSISTANT_MARK), content)
    tail = F.substring(content, at + len(ASSISTANT_MARK), F.length(content))
    return strip(F.when(at > 0, F.split_part(tail, F.lit(USER_MARK), F.lit(1))).otherwise(content))


def parse_answer(raw: Column) -> Column:
    """A JSON answer as a struct, null where it cannot be used.

    It is unusable when it is not one JSON document and nothing else, when either
    field is missing or has the wrong shape, or when an entity lacks its label or
    value; these and the masked text have to be JSON strings.
    """
    # The parser stops behind the first document. Inside a list and inside an
    # object, text that follows it breaks one of the two.
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    document = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit("}")))
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))

    def sound(document: Column) -> Column:
        entities = F.try_variant_get(document, "$.x.pii_entities", "array<struct<label: variant, value: variant>>")
        return (
            document.isNotNull()
            & (F.schema_of_variant(F.try_variant_get(document, "$.x.redacted_text", "variant")) == "STRING")
            & _bound(
                entities,
                lambda a: a.isNotNull() & ~F.exists(a, lambda e: e.isNull() | ~is_text(e["label"]) | ~is_text(e["value"])),
            )
        )

    def used(parsed: Column) -> Column:
        return F.when(parsed["redacted_text"].isNotNull() & parsed["pii_entities"].isNotNull(), parsed)

    parsed = F.from_json(raw, ANSWER_DDL, {"allowSingleQuotes": "false"})
    return F.when(_bound(document, sound) & (F.size(listed) == 1), _bound(parsed, used))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_fallback(df: DataFrame, text_col: str, masked: Column, spans: Column) -> DataFrame:
    """Append the result columns, with the text unmasked where there is no result.

    ``failed`` marks those rows: they still hold whatever the text holds.
    """
    columns = [c for c in df.columns if c not in ("redacted_text", "pii_entities", "failed")]
    failed = masked.isNull() | spans.isNull()
    return df.select(
        *columns,
        F.when(failed, F.col(text_col)).otherwise(masked).alias("redacted_text"),
        F.when(failed, F.expr(NO_SPANS)).otherwise(spans).alias("pii_entities"),
        failed.alias("failed"),
    )


def read_chat_answers(
    df: DataFrame, text_col: str, content_col: str, placeholder: str = PLACEHOLDER
) -> DataFrame:
    """Result columns from decoded model output that holds the masked text."""
    staged = df.withColumn("_masked", assistant_part(F.col(content_col)))
    staged = staged.withColumn("_spans", F.expr(align_spans(name(text_col), "_masked", placeholder)))
    return with_fallback(staged, text_col, F.col("_masked"), F.col("_spans")).drop("_masked", "_spans")


def read_json_answers(df: DataFrame, text_col: str, raw_col: str) -> DataFrame:
    """Result columns from raw JSON answers; offsets given by the model are not used."""
    staged = df.withColumn("_answer", parse_answer(F.col(raw_col)))
    staged = staged.withColumn("_spans", F.expr(recovered_spans(name(text_col), "_answer.pii_entities")))
    return with_fallback(staged, text_col, F.col("_answer.redacted_text"), F.col("_spans")).drop(
        "_answer", "_spans"
    )


def _texts_only(answers: Sequence[str | None]) -> list[tuple[str | None, str | None]]:
    return [(a, None) if isinstance(a, str) else (None, f"no text but {type(a).__name__}") for a in answers]


def _answer_batch(
    predict: Predict, prompts: list[str], give_up: int | None = None
) -> list[tuple[str | None, str | None]]:
    """Answers of one batch with the reason where there is none.

    A batch that fails is asked again in halves, down to single texts, so a bad
    text costs a few calls and takes no other one with it. With ``give_up``, so
    many single texts failing in a row end the batch; what is left has the
    reason NOT_ASKED, and has to be asked in a further pass.
    """
    found: list[tuple[str | None, str | None]] = []
    waiting = [(0, len(prompts))]
    failures = 0
    while waiting:
        first, last = waiting.pop()
        try:
            answers = list(predict(prompts[first:last]))
            if last - first == 1:
                answers = answers[:1] or [None]
            if len(answers) == last - first:
                found += _texts_only(answers)
                failures = 0
                continue
            why = f"{len(answers)} answers to {last - first} prompts"
        except Exception as problem:
            why = _reason(problem)
        if last - first > 1:
            middle = (first + last) // 2
            waiting += [(middle, last), (first, middle)]
            continue
        found.append((None, why))
        failures += 1
        if failures == give_up:
            break
    return found + [(None, NOT_ASKED)] * (len(prompts) - len(found))


def _reason(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"[:200]


def ask(
    prompts: Column,
    make_predict: Callable[[], Predict],
    batch_size: int = BATCH_SIZE,
    give_up: int | None = None,
    around: tuple[str, str] = ("", ""),
) -> Column:
    """``answer`` and ``failure`` of the caller's function, which is made once per task.

    An answer that is no text counts as none, and ``failure`` says why there is
    none. Spark hands over ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows
    at a time; the function gets them in lists of at most ``batch_size``. Each
    prompt is asked, on its own if need be, unless ``give_up`` says how many
    failures in a row end a list. What all prompts begin and end with goes into
    ``around`` and is not sent with every row.
    """
    before, after = around

    @F.arrow_udf("answer string, failure string")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make_predict()
        for batch in batches:
            # Only one list of prompts and its answers are Python objects at a time.
            cuts = np.flatnonzero(batch.is_valid())[batch_size::batch_size].tolist()
            for low, high in zip([0, *cuts], [*cuts, len(batch)]):
                here = batch.slice(low, high - low).to_pylist()
                prompts_here = [before + p + after for p in here if p is not None]
                given = iter(_answer_batch(predict, prompts_here, give_up) if prompts_here else ())
                rows = [(None, "no text") if p is None else next(given) for p in here]
                columns = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
                yield pa.StructArray.from_arrays(columns, names=["answer", "failure"])
            del batch
            pa.default_memory_pool().release_unused()

    # Asking again gives another answer and costs another call, so the planner
    # must not copy the call into filters above it.
    return answer.asNondeterministic()(prompts)


def redact_with(
    df: DataFrame,
    text_col: str,
    make_predict: Callable[[], Predict],
    types: Sequence[str] = DEFAULT_TYPES,
    answers: str = "json",
    placeholder: str = PLACEHOLDER,
    only_types: bool = False,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Mask texts with the caller's model.

    ``make_predict`` returns a function from a list of prompts to a list of
    answers. ``answers`` says what it returns: ``"json"`` documents, or ``"chat"``
    output with the masked text. ``only_types`` drops entities of other labels.
    Rows without a usable answer keep their text, and ``failure`` gives the reason.
    Write the result before using it twice if the model is not deterministic.
    """
    text = F.col(text_col).cast("string")
    asked = df.withColumn("_asked", ask(text, make_predict, batch_size, around=_around(_template(answers), types)))
    asked = asked.withColumns({"_raw": F.col("_asked.answer"), "_why": F.col("_asked.failure")}).drop("_asked")
    return read_answers(asked, text_col, types, answers, placeholder, only_types)


def prompt_maker(answers: str) -> Callable[[Column, Sequence[str]], Column]:
    template = _template(answers)
    return lambda text, types: _fill(template, text, types)


def _template(answers: str) -> str:
    if answers not in ("json", "chat"):
        raise ValueError(f"answers must be 'json' or 'chat', not {answers!r}")
    return JSON_PROMPT if answers == "json" else CHAT_PROMPT


def read_answers(
    asked: DataFrame, text_col: str, types: Sequence[str], answers: str, placeholder: str, only_types: bool
) -> DataFrame:
    """Result columns and ``failure`` from ``_raw``, an answer, and ``_why``, the reason where there is none."""
    if answers == "json":
        result = read_json_answers(asked, text_col, "_raw").drop("_raw")
    else:
        result = read_chat_answers(asked, text_col, "_raw", placeholder).drop("_raw")
    # The model gave no text, or what it gave cannot be used.
    why = F.when(F.col("failed"), F.coalesce("_why", F.lit("answer cannot be read")))
    result = result.withColumn("failure", why).drop("_why")
    if only_types:
        wanted = list(types)
        result = result.withColumn(
            "pii_entities", F.filter("pii_entities", lambda s: s["label"].isin(wanted))
        )
    return result
