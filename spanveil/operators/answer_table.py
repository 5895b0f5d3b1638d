"""Answers of a model that are kept: a table that each answer is asked for once.

The table is a folder of Parquet files with a row per attempt: the digest of the
prompt, the answer or the reason why there is none, and whether the answer can be
used. A prompt is asked if no usable answer of its digest is in the table, so a
text that stands in many rows is asked once, and a run that is started again goes
on where the last one ended.

Asking takes passes. In all but the last, a model that fails often in a row is
left alone for the rest of a list, and what was not asked or failed goes round
again, in another order. In the last pass each prompt that is still open is asked
on its own if need be. A pass is asked in rounds of bounded size, and in each
round the stage that asks is the one that writes: a task that has ended is never
run again when its executor is lost, and a round that has ended is there after
the driver is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.align import PLACEHOLDER
from spanveil.operators.answers import BATCH_SIZE, NOT_ASKED, Predict, ask, parse_answer, prompt_maker, read_answers
from spanveil.operators.rules import DEFAULT_TYPES
from spanveil.sources.shared import written

TABLE_DDL = "digest STRING, answer STRING, failure STRING, usable BOOLEAN, attempt INT"
PASSES = 3
# Failed single prompts in a row that end a list, in all passes but the last.
GIVE_UP = 8
# Prompts that are asked between two commits of the table.
ROUND_PROMPTS = 1_000_000
# Prompts per task: what is asked again at most when a task is lost.
TASK_PROMPTS = 2048


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far; none where there is no table yet."""
    try:
        return spark.read.schema(TABLE_DDL).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLE_DDL)


def _open(prompts: DataFrame, attempts: DataFrame) -> DataFrame:
    """The prompts without a usable answer."""
    return prompts.join(attempts.where("usable").select("digest"), "digest", "left_anti")


def ask_open(
    prompts: DataFrame,
    make_predict: Callable[[], Predict],
    path: str,
    answers: str = "json",
    passes: int = PASSES,
    batch_size: int = BATCH_SIZE,
    round_prompts: int = ROUND_PROMPTS,
) -> None:
    """Ask the prompts (``digest, prompt``, each digest once) that the table at ``path`` has no usable answer for."""
    spark = prompts.sparkSession
    for attempt in range(1, passes + 1):
        todo = written(_open(prompts, read_table(spark, path)), "prompts")
        count = todo.count()
        if not count:
            return
        rounds = -(-count // round_prompts)
        # Another order in each pass, so that texts that fail do not stand together again.
        place = F.xxhash64("digest", F.lit(attempt))
        for r in range(rounds):
            here = todo.where(F.pmod(place, F.lit(rounds)) == r)
            dealt = here.repartition(max(1, -(-count // (rounds * TASK_PROMPTS))), place)
            give_up = GIVE_UP if attempt < passes else None
            asked = dealt.select("digest", ask(F.col("prompt"), make_predict, batch_size, give_up).alias("a"))
            readable = parse_answer(F.col("a.answer")).isNotNull() if answers == "json" else F.lit(True)
            rows = asked.select(
                "digest",
                F.col("a.answer").alias("answer"),
                F.col("a.failure").alias("failure"),
                (F.col("a.answer").isNotNull() & readable).alias("usable"),
                F.lit(attempt).alias("attempt"),
            )
            # What was passed over is no attempt, unless the model is never asked again.
            rows.where(F.col("failure").isNull() | (F.col("failure") != NOT_ASKED)).write.mode("append").parquet(path)
        prompts = todo


def last_answers(attempts: DataFrame) -> DataFrame:
    """``digest, _raw, _why``: of each prompt the usable answer, else the last one."""
    best = F.max_by(F.struct("answer", "failure"), F.struct(F.col("usable"), F.col("attempt")))
    kept = attempts.groupBy("digest").agg(best.alias("best"))
    return kept.select("digest", F.col("best.answer").alias("_raw"), F.col("best.failure").alias("_why"))


def redact_with_table(
    df: DataFrame,
    text_col: str,
    make_predict: Callable[[], Predict],
    path: str,
    types: Sequence[str] = DEFAULT_TYPES,
    answers: str = "json",
    placeholder: str = PLACEHOLDER,
    only_types: bool = False,
    passes: int = PASSES,
    batch_size: int = BATCH_SIZE,
    round_prompts: int = ROUND_PROMPTS,
) -> DataFrame:
    """Mask texts with the caller's model, as `redact_with` does, through the table of answers at ``path``.

    The model is asked before this returns. Tables may be shared between inputs,
    kinds of prompts and runs, one at a time; ``path`` has to be one that every
    executor reaches. Null texts are not asked.
    """
    spark = df.sparkSession
    prompt = prompt_maker(answers)(F.col(text_col), types)
    rows = df.withColumn("_digest", F.sha2(prompt, 256))
    # A text that many rows share is one row per task before it is exchanged.
    distinct = rows.where("_digest IS NOT NULL").groupBy(F.col("_digest").alias("digest")).agg(F.any_value(text_col).alias("_text"))
    prompts = distinct.select("digest", prompt_maker(answers)(F.col("_text"), types).alias("prompt"))
    ask_open(prompts, make_predict, path, answers, passes, batch_size, round_prompts)
    found = last_answers(read_table(spark, path))
    # Rows without a text meet nothing; numbers keep them from meeting in one task.
    key = F.coalesce(F.col("_digest"), F.concat(F.lit("-"), F.monotonically_increasing_id()))
    asked = rows.withColumn("_digest", key).join(found.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")
    why = F.when(F.col(text_col).isNull(), F.lit("no text")).otherwise(F.col("_why"))
    return read_answers(asked.withColumn("_why", why), text_col, types, answers, placeholder, only_types)
