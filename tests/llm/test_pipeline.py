from __future__ import annotations

import sys
from pathlib import Path

import plain
import public_tokenizers
from tokenizers import Tokenizer as Library

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402

from spanveil.llm import quality  # noqa: E402
from spanveil.llm.tables import benchmark, documents, labels  # noqa: E402


def plain_run(spark, sf):
    """The same decisions, stage by stage, in plain Python; only the classifier's scores are its own."""
    docs = documents(spark, sf)
    scorer = quality.train(docs, labels(spark, sf))
    describer = quality.Describer()
    import pyarrow as pa

    rows = {}
    for r in docs.collect():
        if scorer.score(describer.of(pa.array([r.text])))[0] >= 0.5:
            rows[r.doc_id] = r.text
    cut = plain.cut_lines(list(rows.items()), passage=50)
    rows = {i: text for i, (n, gone, text) in cut.items() if gone == 0 or gone < n}
    groups = plain.near_groups(list(rows.items()), k=5)
    rows = {i: text for i, text in rows.items() if groups[i][1] == i}
    leaks = plain.leaks(list(rows.items()), [(r.item_id, r.text) for r in benchmark(spark, sf).collect()])
    rows = {i: text for i, text in rows.items() if not leaks[i][1]}
    library = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: library.encode(text, add_special_tokens=False).ids for i, text in rows.items()}


def test_run_equals_the_plain_version(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    want = plain_run(spark, sf)
    assert len(got) == len(want) > 50 and {r.doc_id: list(r.ids) for r in got} == want


def test_stages_keep_columns_and_take_edges(spark, edges, nothing, sf):
    odd = edges.drop("score", "hash")
    for frame in (odd, nothing.drop("score", "hash")):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, frame, sf)
            done.collect()
            assert name == "encoding" or done.columns == frame.columns
