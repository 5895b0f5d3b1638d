"""Registered queries: each operator over the whole of the given tables.

``documents`` is the main text table. It has no gold spans, so a corpus is
derived from it: rule redaction gives the masked target text and the gold
spans, and aligning source and target gives the predictions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.spans import span, span_rows
from spanveil.operators.align import align_redaction
from spanveil.operators.answers import (
    assistant_part,
    chat_prompt,
    json_prompt,
    parse_answer,
    read_json_answers,
    redact_with,
)
from spanveil.operators.detect import redact
from spanveil.operators.limits import head_n
from spanveil.operators.lookup import redact_with_lists
from spanveil.operators.recover import approximate_start, recover_spans, unlocated_values
from spanveil.operators.rules import DEFAULT_RULES, Rule
from spanveil.operators.score import (
    rounded,
    score,
    score_by_label,
    score_long_form,
    score_long_form_by_label,
    score_rows,
    score_with_labels,
    stacked_rows,
)
from spanveil.functions.text import quoted
from spanveil.operators.training_text import sft_examples, sft_labels
from spanveil.plans.jobs import redact_any, redact_corpus, redact_files, redact_large_files, score_results
from spanveil.sources.corpus import (
    corpus_output,
    head_per_split,
    read_split,
    split_counts,
    split_sample,
    write_splits,
)
from spanveil.sources.results import read_results, write_results
from spanveil.sources.shared import fresh_path
from spanveil.sources.tables import read_table, spread
from spanveil.streaming.redact_stream import read_redacted, read_text_stream, redact_stream

TYPE_SUBSET = ("EMAIL", "TEL")
CUSTOM_RULES = (
    Rule("CREDITCARD", "(?<![0-9])[0-9]{16,}+", starts=("0-9",)),
    Rule("HEXKEY", "(?<![0-9a-f])[0-9a-f]{40,}+", starts=("0-9a-f",)),
    *DEFAULT_RULES,
)
HEAD = 100
HEAD_TRAIN, HEAD_VALIDATION = 300, 40
SCORE_DIGITS = 6
ROWS_PER_FILE = 200

RATIOS = ("precision", "recall", "f1")


def _table(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf}/{table}.parquet", spread(spark))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text", "lang")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The nine corpus columns, derived from ``documents``."""
    found = redact(documents(spark, sf))
    return found.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("set"),
        F.col("text").alias("source_text"),
        F.col("redacted_text").alias("target_text"),
        F.col("pii_entities").alias("privacy_mask"),
        F.array_join(F.transform("pii_entities", lambda s: s["label"]), " ").alias("span_labels"),
        F.split("text", " ").alias("mbert_text_tokens"),
        F.transform(F.split("text", " "), lambda _: F.lit("O")).alias("mbert_bio_labels"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """id, gold and predicted spans.

    The aligned spans get repeats (all but e-mail addresses come twice) and
    wrong labels (each IP also comes as TEL), so that lists and sets differ.
    """
    aligned = align_redaction(corpus(spark, sf), "source_text", "target_text", output_col="_aligned")
    again = "filter(_aligned, s -> s.label <> 'EMAIL')"
    as_tel = span("'TEL'", "s.value", "s.start", "s.end")
    wrong = f"transform(filter(_aligned, s -> s.label = 'IP'), s -> {as_tel})"
    return aligned.select(
        "id", F.expr(f"concat(_aligned, {again}, {wrong})").alias("pred"), F.col("privacy_mask").alias("gold")
    )


def _masked(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "redacted_text", F.size("pii_entities").cast("bigint").alias("n_entities"))


def redact_documents(spark, sf):
    return _masked(redact(documents(spark, sf)), "doc_id")


def entities_long(spark, sf):
    return span_rows(redact(documents(spark, sf)), "pii_entities", "doc_id")


def redact_conversations(spark, sf):
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return _masked(redact(turns), "conv_id", "turn")


def redact_pages(spark, sf):
    pages = _table(spark, sf, "pages").select("page_id", "html")
    return _masked(redact(pages, "html"), "page_id")


def redact_type_subset(spark, sf):
    return _masked(redact(documents(spark, sf), types=TYPE_SUBSET), "doc_id")


def redact_custom_types(spark, sf):
    return span_rows(redact(documents(spark, sf), rules=CUSTOM_RULES), "pii_entities", "doc_id")


def redact_head_n(spark, sf):
    return _masked(redact(head_n(documents(spark, sf), "doc_id", HEAD)), "doc_id")


def word_list(spark: SparkSession, sf: str) -> DataFrame:
    """A name list: the capitalised words of at least six letters in ``benchmark``."""
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))).alias("w")
    )
    names = words.filter(F.rlike("w", F.lit("^[A-Z][a-z]{5,}$"))).select(F.lower("w").alias("term")).distinct()
    return names.select(
        "term", F.when(F.length("term") >= 9, "LASTNAME1").otherwise("GIVENNAME1").alias("label")
    )


def _with_lists(spark, sf, **how):
    return redact_with_lists(documents(spark, sf), "text", word_list(spark, sf), **how)


def redact_dictionary(spark, sf):
    return _masked(_with_lists(spark, sf), "doc_id")


def dictionary_entities(spark, sf):
    return span_rows(_with_lists(spark, sf), "pii_entities", "doc_id")


def dictionary_broadcast_join(spark, sf):
    """The list as arrays that travel to the tasks."""
    return span_rows(_with_lists(spark, sf, part_bytes=1 << 20), "pii_entities", "doc_id")


def dictionary_shuffle_join(spark, sf):
    """The list taken as a long one: places are joined with it."""
    return span_rows(_with_lists(spark, sf, part_bytes=700), "pii_entities", "doc_id")


def dictionary_positions(spark, sf):
    """A list of every word of six letters or more that begins with a capital, of all documents and items, joined by places."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))).alias("w")
    every = documents(spark, sf).select(words).union(_table(spark, sf, "benchmark").select(words))
    capital = every.filter(F.rlike("w", F.lit("^[A-Z][a-z]{5,}$"))).select(F.lower("w").alias("term")).distinct()
    label = F.when(F.length("term") >= 9, "LASTNAME1").otherwise("GIVENNAME1").alias("label")
    done = redact_with_lists(documents(spark, sf), "text", capital.select("term", label), part_bytes=0)
    return _masked(done, "doc_id")


def phrase_list(spark: SparkSession, sf: str) -> DataFrame:
    """Two-word terms: the first two words of each ``benchmark`` item, but none that could overlap another."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    firsts = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.transform(F.slice(words, 1, 2), F.lower).alias("w"))
    pairs = firsts.where(F.size("w") == 2).select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")).distinct()
    apart = pairs.join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    return apart.select(F.concat_ws("  ", "a", "b").alias("term"), F.lit("LASTNAME2").alias("label"))


def dictionary_phrases(spark, sf):
    found = redact_with_lists(documents(spark, sf), "text", phrase_list(spark, sf))
    return span_rows(found, "pii_entities", "doc_id")


# A text of the columns of ``orders`` with one entity of each rule's label: what
# stands before the value, the value as SQL, the label.
_PADDED = "lpad(CAST({} AS STRING), {}, '0')".format
ORDER_PARTS = (
    ("mail ", "concat('u', o_custkey, '@ex', o_orderkey % 10, '.com')", "EMAIL"),
    ("; post ", "concat('jürgen', o_custkey, '@exämple', o_orderkey % 10, '.de')", "EMAIL"),
    ("; or ", "concat('Ж.müller+', o_custkey, '@пример.рф')", "EMAIL"),
    ("; place ", f"concat({_PADDED('o_orderkey % 90', 2)}, '.', {_PADDED('o_orderkey % 1000', 3)}, ', ', "
     f"{_PADDED('o_custkey % 90', 2)}, '.', {_PADDED('o_custkey % 1000', 3)})", "GEOCOORD"),
    ("; from ", "concat('10.0.', o_orderkey % 256, '.', o_custkey % 256)", "IP"),
    ("; call ", f"concat('555-', {_PADDED('o_orderkey % 1000', 3)}, '-', {_PADDED('o_custkey % 10000', 4)})", "TEL"),
    ("; ssn ", f"concat({_PADDED('o_orderkey % 1000', 3)}, '-', {_PADDED('o_custkey % 100', 2)}, '-', {_PADDED('o_orderkey % 10000', 4)})",
     "SOCIALNUMBER"),
    ("; on ", "substring(CAST(o_orderdate AS STRING), 1, 10)", "DATE"),
    ("; at ", f"concat({_PADDED('o_orderkey % 24', 2)}, ':', {_PADDED('o_custkey % 60', 2)})", "TIME"),
    ("; dear ", "'Dr.'", "TITLE"),
    ("; dob: ", "substring(CAST(o_orderdate AS STRING), 1, 10)", "DOB"),
    ("; token = ", "concat('tk', o_custkey, 'x', o_orderkey)", "PASS"),
    ("; passport: ", f"concat('P', {_PADDED('o_orderkey % 10000000', 7)})", "PASSPORT"),
    ("; id card: ", f"concat('ID-', {_PADDED('o_custkey % 1000000', 6)})", "IDCARD"),
    ("; driving license: ", f"concat('D', {_PADDED('o_orderkey % 100000', 5)})", "DRIVERLICENSE"),
    ("; user: ", "concat('cust', o_custkey)", "USERNAME"),
    ("; zip: ", _PADDED("o_orderkey % 100000", 5), "POSTCODE"),
    ("; sex: ", "CASE WHEN o_orderkey % 2 = 0 THEN 'female' ELSE 'male' END", "SEX"),
)


def redact_table_text(spark, sf):
    """Each default rule at least once per row: texts put together from ``orders``."""
    parts = ", ".join(f"{quoted(before)}, {value}" for before, value, _ in ORDER_PARTS)
    texts = _table(spark, sf, "orders").select("o_orderkey", F.expr(f"concat({parts}, '.')").alias("text"))
    return span_rows(redact(texts), "pii_entities", "o_orderkey")


def mask_cards(texts: list[str]) -> list[tuple[str, list[str]]]:
    """What the stub models know: sixteen digits or more are a card number."""
    return [(re.sub("[0-9]{16,}", "[CARD]", t), re.findall("[0-9]{16,}", t)) for t in texts]


def json_stub():
    """A deterministic model for JSON prompts."""

    def predict(prompts):
        texts = [p.split('Input:\n         """', 1)[1].rsplit('"""\n         Output:', 1)[0] for p in prompts]
        return [
            json.dumps({"redacted_text": m, "pii_entities": [{"label": "CARD", "value": v} for v in found]})
            for m, found in mask_cards(texts)
        ]

    return predict


def chat_stub():
    """A deterministic model for chat prompts; like a decoded output it repeats the prompt."""

    def predict(prompts):
        texts = [p.split("<|user|>\n", 1)[1].rsplit("\n<|assistant|>", 1)[0] for p in prompts]
        return [p + m for p, (m, _) in zip(prompts, mask_cards(texts))]

    return predict


def redact_with_stub(spark, sf):
    return span_rows(redact_with(documents(spark, sf), "text", json_stub), "pii_entities", "doc_id")


def redact_with_stub_text(spark, sf):
    result = redact_with(documents(spark, sf), "text", json_stub)
    return result.select("doc_id", "redacted_text", "failed")


def redact_with_chat_stub(spark, sf):
    result = redact_with(documents(spark, sf), "text", chat_stub, answers="chat")
    return span_rows(result, "pii_entities", "doc_id")


def moody_stub():
    """The JSON stub, but it fails on a list with a prompt whose length seven divides, unless that stands alone."""
    predict = json_stub()

    def moody(prompts):
        if len(prompts) > 1 and any(len(p) % 7 == 0 for p in prompts):
            raise RuntimeError("not today")
        return predict(prompts)

    return moody


def dead_stub():
    def predict(prompts):
        raise OSError("down")

    return predict


def durable_answers(spark, sf):
    """Answers of a moody model are kept; a second run with a dead one finds them all."""
    table = fresh_path(spark, "answers")
    docs = documents(spark, sf)
    redact_any(docs, "text", make_predict=moody_stub, answer_table=table)
    done = redact_any(docs, "text", make_predict=dead_stub, answer_table=table)
    return done.select("doc_id", "redacted_text", "failed", "failure")


def merged_redaction(spark, sf):
    """Lists before rules before a model, each over whole texts: listed words cut rule spans, rules cut card numbers."""
    done = redact_any(
        documents(spark, sf), "text", dictionary=word_list(spark, sf), make_predict=json_stub, order=("lists", "rules", "model")
    )
    return span_rows(done, "pii_entities", "doc_id")


def merged_table_text(spark, sf):
    """The same over texts put together from ``orders``, where values hold listed words and cards; the model wins."""
    cards = "concat('; card ', lpad(CAST(o_orderkey AS STRING), 16, '4'), '@mail.com; user: maker', o_custkey, '-', '1234567890123456', '.')"
    texts = _table(spark, sf, "orders").select("o_orderkey", F.expr(f"concat('to maker @ex', {cards})").alias("text"))
    words = spark.createDataFrame([("maker", "LASTNAME1"), ("mail", "CITY"), ("com", "STATE")], "term STRING, label STRING")
    done = redact_any(texts, "text", dictionary=words, make_predict=json_stub, order=("model", "rules", "lists"))
    return _masked(done, "o_orderkey")


def raw_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON answer per document: cut short for French, without masked text for German.

    Of each seven documents, one has text behind the answer, one single quotes,
    and one a number for the masked text.
    """
    found = redact(documents(spark, sf))
    entities = F.transform("pii_entities", lambda s: F.struct(s["label"].alias("label"), s["value"].alias("value")))
    whole = F.to_json(F.struct(F.col("redacted_text"), entities.alias("pii_entities")))
    partial = F.to_json(F.struct(entities.alias("pii_entities")))
    raw = (
        F.when(F.col("lang") == "fr", F.substring(whole, F.lit(2), F.length(whole)))
        .when(F.col("lang") == "de", partial)
        .when(F.col("doc_id") % 7 == 1, F.concat(whole, F.lit(" done")))
        .when(F.col("doc_id") % 7 == 2, F.lit("{'redacted_text': 'x', 'pii_entities': []}"))
        .when(F.col("doc_id") % 7 == 3, F.lit('{"redacted_text": 7, "pii_entities": []}'))
        .otherwise(whole)
    )
    return found.select("doc_id", "text", raw.alias("raw"))


def redact_fallback(spark, sf):
    result = read_json_answers(raw_answers(spark, sf), "text", "raw")
    return _masked(result, "doc_id", "failed")


def parse_model_json(spark, sf):
    parsed = raw_answers(spark, sf).withColumn("a", parse_answer(F.col("raw")))
    return parsed.select(
        "doc_id",
        F.col("a").isNotNull().alias("usable"),
        F.col("a.redacted_text").alias("redacted_text"),
        F.size("a.pii_entities").cast("bigint").alias("n_entities"),
    )


def prompt_local(spark, sf):
    return documents(spark, sf).select("doc_id", chat_prompt(F.col("text")).alias("prompt"))


def prompt_json(spark, sf):
    return documents(spark, sf).select("doc_id", json_prompt(F.col("text")).alias("prompt"))


def extract_response(spark, sf):
    """Decoded output in three forms: with a next turn, without any marker, to the end."""
    found = redact(documents(spark, sf))
    prompt = chat_prompt(F.col("text"))
    content = (
        F.when(F.col("lang") == "en", F.concat(prompt, "redacted_text", F.lit("\n<|user|>\nnext turn")))
        .when(F.col("lang") == "fr", F.concat(F.lit(" \n"), "redacted_text", F.lit("\t\n")))
        .otherwise(F.concat(prompt, "redacted_text", F.lit("  ")))
    )
    staged = found.select("doc_id", content.alias("content"))
    return staged.select("doc_id", assistant_part(F.col("content")).alias("response"))


def align_query(spark, sf):
    aligned = align_redaction(corpus(spark, sf), "source_text", "target_text")
    return span_rows(aligned, "pii_entities", "id")


def given_values(spark: SparkSession, sf: str) -> DataFrame:
    """Three entities to locate per found one: the value, with a space put in, reversed."""
    found = redact(documents(spark, sf))

    def variants(s: Column) -> Column:
        spaced = F.concat(F.substring(s["value"], 1, 2), F.lit(" "), F.substring(s["value"], F.lit(3), F.length(s["value"])))
        forms = ((s["label"], s["value"]), (s["label"], spaced), (F.lit("TITLE"), F.reverse(s["value"])))
        return F.array(*[F.struct(label.alias("label"), value.alias("value")) for label, value in forms])

    return found.select("doc_id", "text", F.flatten(F.transform("pii_entities", variants)).alias("given"))


def recover_query(spark, sf):
    return span_rows(recover_spans(given_values(spark, sf), "text", "given"), "pii_entities", "doc_id")


def approx_span(spark, sf):
    given = given_values(spark, sf)
    start = approximate_start("text", "e.value")
    found = f"transform(given, e -> named_struct('value', e.value, 'start', {start}))"
    rows = given.select("doc_id", F.expr(f"posexplode({found})").alias("pos", "e"))
    return rows.select("doc_id", "pos", "e.value", F.coalesce("e.start", F.lit(-1)).alias("start"))


def unlocated_query(spark, sf):
    return unlocated_values(given_values(spark, sf), "text", "given", "doc_id")


def _rounded_ratios(scores: DataFrame) -> DataFrame:
    return rounded(scores, SCORE_DIGITS)


def score_per_doc(spark, sf):
    return score_rows(predictions(spark, sf), "pred", "gold").select("id", "tp", "fp", "fn")


def score_per_doc_ignore_labels(spark, sf):
    return score_rows(predictions(spark, sf), "pred", "gold", True).select("id", "tp", "fp", "fn")


def score_overall(spark, sf):
    return _rounded_ratios(score(predictions(spark, sf), "pred", "gold"))


def score_overall_ignore_labels(spark, sf):
    return _rounded_ratios(score(predictions(spark, sf), "pred", "gold", True))


def score_per_label(spark, sf):
    return _rounded_ratios(score_by_label(predictions(spark, sf), "pred", "gold"))


def score_per_label_ignore_labels(spark, sf):
    return _rounded_ratios(score_by_label(predictions(spark, sf), "pred", "gold", True))


def score_report(spark, sf):
    return rounded(score(predictions(spark, sf), "pred", "gold")).select(*RATIOS)


def score_both_tables(spark, sf):
    """Totals and scores per label from one read."""
    totals, labels = score_with_labels(predictions(spark, sf), "pred", "gold")
    whole = totals.select(F.lit("all labels").alias("label"), "*")
    return _rounded_ratios(whole.unionByName(labels))


def score_long(spark, sf):
    return _rounded_ratios(score_long_form(stacked_rows(predictions(spark, sf), "pred", "gold", "id"), ["id"]))


def _long_by_label(spark, sf, ignore_labels):
    spans = stacked_rows(predictions(spark, sf), "pred", "gold", "id")
    return _rounded_ratios(score_long_form_by_label(spans, ["id"], ignore_labels))


def score_long_per_label(spark, sf):
    return _long_by_label(spark, sf, False)


def score_long_per_label_ignore_labels(spark, sf):
    return _long_by_label(spark, sf, True)


def corpus_output_query(spark, sf):
    """The eleven columns of a rule redaction; arrays as text."""
    out = corpus_output(redact(corpus(spark, sf), "source_text"))
    spans = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["label"], s["start"], s["end"])), " "
    )
    return out.select(
        "id",
        "language",
        "set",
        "original_source_text",
        "original_target_text",
        spans("original_privacy_mask").alias("original_privacy_mask"),
        "original_span_labels",
        "redacted_text",
        spans("pii_entities").alias("pii_entities"),
        F.array_join("mbert_text_tokens", " ").alias("mbert_text_tokens"),
        F.array_join(F.array_distinct("mbert_bio_labels"), " ").alias("mbert_bio_labels"),
    )


def split_write_read(spark, sf):
    path = fresh_path(spark, "splits")
    write_splits(corpus(spark, sf), path)
    back = read_split(spark, path, "train").unionByName(read_split(spark, path, "validation"))
    return back.select("id", "set", "source_text", F.size("privacy_mask").cast("bigint").alias("n_gold"))


def _results_reread(spark, sf):
    path = fresh_path(spark, "results")
    write_results(corpus_output(redact(corpus(spark, sf), "source_text")), path)
    return read_results(spark, path)


def results_json_roundtrip(spark, sf):
    return span_rows(_results_reread(spark, sf), "pii_entities", "id", "redacted_text")


def results_json_texts(spark, sf):
    """All texts after the round trip, those without entities too."""
    return _masked(_results_reread(spark, sf), "id", "original_source_text")


def _corpus_job(spark, sf, **options):
    """A saved corpus put through the job; the folder of the results and what the job returns."""
    saved, results = fresh_path(spark, "corpus"), fresh_path(spark, "results")
    corpus(spark, sf).write.parquet(saved)
    return results, redact_corpus(spark, saved, results, **options)


def redact_corpus_job(spark, sf):
    """The whole job with own rules and no list of types: labels outside the default list count."""
    return span_rows(_corpus_job(spark, sf, rules=CUSTOM_RULES)[1], "pii_entities", "id")


def redact_corpus_types_file(spark, sf):
    """The job with its types from a file with blank lines."""
    path = fresh_path(spark, "types")
    spark.range(1).select(F.lit("EMAIL\n\n  IP \n")).write.text(path)
    return span_rows(_corpus_job(spark, sf, types_file=path)[1], "pii_entities", "id")


def _text_files(spark: SparkSession, sf: str, rows_per_file: int) -> str:
    """A folder of text files: the texts (those that are not null) of a language and a range of ids, in order of id."""
    path = fresh_path(spark, "files")
    part = F.floor(F.col("doc_id") / F.lit(rows_per_file)).alias("part")
    texts = documents(spark, sf).where("text IS NOT NULL").select("lang", part, "doc_id", "text")
    ordered = texts.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id")
    ordered.select("lang", "part", "text").write.partitionBy("lang", "part").text(path)
    return f"{path}/*/*/*.txt"


def redact_files_job(spark, sf):
    """The job over whole files."""
    done = redact_files(spark, _text_files(spark, sf, ROWS_PER_FILE))
    return done.select(
        F.length("original_text").cast("bigint").alias("n_chars"),
        F.md5("redacted_text").alias("masked_md5"),
        F.size("pii_entities").cast("bigint").alias("n_entities"),
    )


def redact_large_files_job(spark, sf):
    """Larger files in pieces, with offsets in the file; listed words may reach across line ends."""
    words = phrase_list(spark, sf)
    done = redact_large_files(spark, _text_files(spark, sf, 20 * ROWS_PER_FILE), piece_bytes=1 << 14, dictionary=words)
    where = [F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c) for c in ("lang", "part")]
    rows = done.select(*where, F.explode("pii_entities").alias("e"))
    return rows.select("lang", F.col("part").cast("bigint").alias("part"), "e.label", "e.value", "e.start", "e.end")


def score_results_job(spark, sf):
    """Scores of the job's saved results against the corpus' own spans."""
    results, _ = _corpus_job(spark, sf, rules=CUSTOM_RULES)
    return _rounded_ratios(score_results(spark, results)[0])


def split_counts_query(spark, sf):
    return split_counts(corpus(spark, sf))


def split_sample_query(spark, sf):
    return split_sample(corpus(spark, sf))


def sft_head_per_split(spark, sf):
    return head_per_split(corpus(spark, sf), HEAD_TRAIN, HEAD_VALIDATION).select("id", "set", "source_text")


def sft_examples_query(spark, sf):
    return sft_examples(corpus(spark, sf)).select("id", "prompt", "text")


def sft_tokens(spark, sf):
    tokens = sft_labels(corpus(spark, sf))
    return tokens.select(
        "id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


def sft_labels_query(spark, sf):
    return sft_labels(corpus(spark, sf)).select(
        "id", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels")
    )


def _streamed(spark, sf, **detection):
    """``documents`` as a stream of files, redacted into the shared folder and read back."""
    # A bracket makes the single file a pattern, as a stream reads folders or patterns.
    stream = read_text_stream(spark, f"{sf}/documents.parque[t]", "doc_id BIGINT, text STRING")
    out = fresh_path(spark, "stream")
    redact_stream(stream, f"{out}/data", f"{out}/checkpoint", until_now=True, **detection).awaitTermination()
    return read_redacted(spark, f"{out}/data")


def stream_redact(spark, sf):
    return _masked(_streamed(spark, sf), "doc_id")


def stream_redact_dictionary(spark, sf):
    return _masked(_streamed(spark, sf, dictionary=word_list(spark, sf)), "doc_id")


def stream_redact_long_list(spark, sf):
    """The list taken as a long one, joined batch by batch."""
    return _masked(_streamed(spark, sf, dictionary=word_list(spark, sf), part_bytes=0), "doc_id")


def stream_redact_stub(spark, sf):
    return _streamed(spark, sf, make_predict=json_stub).select("doc_id", "redacted_text", "failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "redact_documents": redact_documents,
    "entities_long": entities_long,
    "redact_conversations": redact_conversations,
    "redact_pages": redact_pages,
    "redact_type_subset": redact_type_subset,
    "redact_custom_types": redact_custom_types,
    "redact_head_n": redact_head_n,
    "redact_dictionary": redact_dictionary,
    "dictionary_entities": dictionary_entities,
    "dictionary_broadcast_join": dictionary_broadcast_join,
    "dictionary_shuffle_join": dictionary_shuffle_join,
    "redact_with_stub": redact_with_stub,
    "redact_with_stub_text": redact_with_stub_text,
    "redact_with_chat_stub": redact_with_chat_stub,
    "redact_fallback": redact_fallback,
    "parse_model_json": parse_model_json,
    "prompt_local": prompt_local,
    "prompt_json": prompt_json,
    "extract_response": extract_response,
    "align_redaction": align_query,
    "recover_spans": recover_query,
    "approx_span": approx_span,
    "unlocated_values": unlocated_query,
    "score_per_doc": score_per_doc,
    "score_per_doc_ignore_labels": score_per_doc_ignore_labels,
    "score_overall": score_overall,
    "score_overall_ignore_labels": score_overall_ignore_labels,
    "score_per_label": score_per_label,
    "score_per_label_ignore_labels": score_per_label_ignore_labels,
    "score_report": score_report,
    "score_both_tables": score_both_tables,
    "score_long_form": score_long,
    "score_long_per_label": score_long_per_label,
    "score_long_per_label_ignore_labels": score_long_per_label_ignore_labels,
    "corpus_output": corpus_output_query,
    "split_write_read": split_write_read,
    "results_json_roundtrip": results_json_roundtrip,
    "results_json_texts": results_json_texts,
    "split_counts": split_counts_query,
    "split_sample": split_sample_query,
    "sft_head_per_split": sft_head_per_split,
    "sft_examples": sft_examples_query,
    "sft_tokens": sft_tokens,
    "sft_labels": sft_labels_query,
    "stream_redact": stream_redact,
    "stream_redact_dictionary": stream_redact_dictionary,
    "stream_redact_stub": stream_redact_stub,
    "stream_redact_long_list": stream_redact_long_list,
    "dictionary_positions": dictionary_positions,
    "durable_answers": durable_answers,
    "merged_redaction": merged_redaction,
    "merged_table_text": merged_table_text,
    "dictionary_phrases": dictionary_phrases,
    "redact_table_text": redact_table_text,
    "redact_corpus_job": redact_corpus_job,
    "redact_corpus_types_file": redact_corpus_types_file,
    "score_results_job": score_results_job,
    "redact_files_job": redact_files_job,
    "redact_large_files_job": redact_large_files_job,
}
