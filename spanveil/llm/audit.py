"""How document filters interact: every order of five filters, counted from failure masks.

A document's mask has one bit per filter that it fails. Counts of documents by
part and mask (cells, 32 a part at most) hold all that any order of the filters
can do, so texts are read once and the orders are enumerated over the cells: a
recursive query starts with the empty prefix, extends each prefix with every
unused letter, carries the bits applied so far and emits the metrics of the step
it adds.

Failure conditions of a text (null: empty), words being maximal
``[^\\x20\\x09-\\x0D]+``:

- A: fewer than 200 words;
- B: 100 * distinct words < 50 * words;
- C: 100 * ``[A-Z]`` characters > 3 * code points;
- D: holds any of ``#$%&*|``;
- E: the text is that of a smaller id too, table-wide.

Repeated rows count as often as they stand; rows of the least id of a text all
pass E. A row without an id passes E, fails no other row, and has no labels.
Label rows of one id are joined by their greatest values; labels without an id
or without a document count nowhere. A null part is the empty one. An empty
table has no parts and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import saved

LETTERS = "ABCDE"
BITS = {letter: 1 << i for i, letter in enumerate(LETTERS)}
EXACT = BITS["E"]
WORD = r"[^\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """The bits of A to D that a text (no null) fails."""
    # Words are taken once: the lambda's argument is what both sizes read.
    sizes = F.transform(
        F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
        lambda words: F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct")),
    )[0]
    fails = {
        "A": lambda s: s["n"] < 200,
        "B": lambda s: 100 * s["distinct"].cast("long") < 50 * s["n"].cast("long"),
        "C": lambda _: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.char_length(text).cast("long"),
        "D": lambda _: text.rlike(r"[#$%&*|]"),
    }

    def mask(s: Column) -> Column:
        bits = [F.when(fails[letter](s), BITS[letter]).otherwise(0) for letter in fails]
        return sum(bits[1:], bits[0])

    return F.transform(F.array(sizes), mask)[0]


def mask_cells(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and labelled ones, by part and failure mask.

    Texts are digested in their own task; only ids, digests and masks are
    exchanged. Copies meet by partial aggregates first, so that a text or an id
    that a third of all rows share is a few rows when it is grouped, and rows
    without an id are spread by their digest.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        text_mask(body).alias("mask"),
    )
    rows = narrow.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = (
        labels.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("at"))
        .agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    )
    at = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("digest")))
    marked = rows.withColumn("at", at).join(marks, "at", "left")
    marked = marked.fillna(False, ["good", "toxic"])
    # Of one text: rows in all, rows of the least id, rows without an id.
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("least"),
        F.min_by(F.when(F.col("id").isNotNull(), F.col("n")), "id").alias("of_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    # A window over what is left of a text: at most four rows per part.
    first = F.expr("if(least = min(least) OVER (PARTITION BY digest), of_least, 0)")
    split = groups.withColumn("passing", F.coalesce(first, F.lit(0)) + F.col("no_id")).select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask"), F.col("passing").alias("n")),
                F.struct((F.col("mask") + EXACT).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
            )
        ).alias("cell"),
    )
    n = F.col("cell.n")
    return (
        split.groupBy("part", F.col("cell.mask").alias("mask"))
        .agg(
            F.sum(n).alias("n"),
            F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
        )
        .where("n > 0")
    )


# A prefix of an order, the bits it has applied, and the metrics of its last step.
STEPS_SQL = """
WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}),
steps(part, cells, prefix, step, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, cells, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT s.part, s.cells, concat(s.prefix, l.letter), s.step + 1, s.applied | l.bit, l.letter,
    aggregate(s.cells, 0L, (a, c) -> a + if(c.mask & (s.applied | l.bit) = 0, c.n, 0L)),
    aggregate(s.cells, 0L, (a, c) -> a + if(c.mask & s.applied = 0 AND c.mask & l.bit <> 0, c.n, 0L)),
    aggregate(s.cells, 0L, (a, c) -> a + if(c.mask & s.applied <> 0 AND c.mask & l.bit <> 0, c.n, 0L)),
    aggregate(s.cells, 0L, (a, c) -> a + if(c.mask = l.bit, c.n, 0L)),
    aggregate(s.cells, 0L, (a, c) -> a + if(c.mask & s.applied = 0 AND c.mask & l.bit <> 0, c.good, 0L)),
    aggregate(s.cells, 0L, (a, c) -> a + if(c.mask & s.applied = 0 AND c.mask & l.bit <> 0, c.toxic, 0L))
  FROM steps s JOIN letters l ON s.applied & l.bit = 0
)
SELECT part, prefix, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
FROM steps WHERE step > 0
"""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def prefix_steps(cells: DataFrame) -> DataFrame:
    """Metrics of the last step of every prefix of every order: 325 rows a part, by recursion over the mask cells."""
    spark = cells.sparkSession
    packed = saved(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "audit-cells")
    view = "audit_cells_" + format(id(packed), "x")
    packed.createOrReplaceTempView(view)
    before = spark.conf.get(ROW_LIMIT, None)
    # Rows grow with the parts alone; Spark's own limit would stop at about 3,000 of them.
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        letters = ", ".join(f"('{letter}', {bit})" for letter, bit in BITS.items())
        return saved(spark.sql(STEPS_SQL.format(letters=letters, cells=view)), "audit-steps")
    finally:
        spark.catalog.dropTempView(view)
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row per part, order of all filters, and step: the step's counts, and its filter's Shapley sum.

    ``shapley`` is what the filter removes, at whatever step it stands, summed
    over all 120 orders.
    """
    steps = prefix_steps(mask_cells(docs, labels, text, key, part))
    orders = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    prefixes = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("at"))
    prefixes = prefixes.withColumn("prefix", F.expr("substring(filter_order, 1, at)"))
    every = prefixes.join(steps, ["part", "prefix"])
    return every.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        *METRICS,
        F.expr("sum(removed) OVER (PARTITION BY part, letter)").alias("shapley"),
    )
