from __future__ import annotations

import hashlib
import sys
import unicodedata

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer as Library

from spanveil.llm.bpe import Tokenizer, heap_ranks, scan_ranks
from spanveil.llm.queries import op1_token_counts, op5_bpe_round_trip
from spanveil.llm.tables import documents
from spanveil.llm.tokens import count_tokens, decode, encode, file_bytes, round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_edges_against_the_library(spark, edges, nothing, library):
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    for r in count_tokens(edges, PATH).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), len(want), len(want) > 2048)
    for r in round_trip(edges, PATH).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)
    assert decode(encode(edges, PATH), PATH).count() == edges.count()
    for done in (count_tokens(nothing, PATH), round_trip(nothing, PATH), encode(nothing, PATH)):
        assert done.count() == 0


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="vocabulary"):
        decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), PATH).collect()


def test_odd_texts(library):
    tokenizer = Tokenizer(file_bytes(PATH))
    odd = ["ΑΣ ΟΔΟΣ. ς", "I'LL we've 's", "<|startoftext|>a<|endoftext|><|endoftext", "a\x1cb\x1d \x85x", "été İ ǅ ﬁ Ⅷ ½ x²", "क़ ̈́", "__a_b__ ١٢٣", "﻿​\xa0 a", "it'sx 'dog"]
    for text in odd:
        ids = []
        for words, special in tokenizer.pieces(text):
            for word in words:
                ids.extend(tokenizer.encode_word(word))
            if special is not None:
                ids.append(special)
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def ids_of(tokenizer, text):
    ids = []
    for words, special in tokenizer.pieces(text):
        for word in words:
            ids.extend(tokenizer.encode_word(word))
        if special is not None:
            ids.append(special)
    return ids


def test_letters_of_newer_tables_are_signs(library):
    """Every code point that the pattern module knows and the library does not, between letters."""
    tokenizer = Tokenizer(file_bytes(PATH))
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    newer = [m.group() for m in regex.finditer(r"[\p{L}\p{N}]", every) if unicodedata.category(m.group()) == "Cn"]
    assert len(newer) > 10_000
    for c in newer:
        for text in (f"a{c}B", f"{c}{c} 1{c}2", f"é{c}.{c}x")[: 3 if ord(c) < 0x12000 else 1]:
            assert ids_of(tokenizer, text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_other_files_are_refused():
    import json

    spec = json.loads(file_bytes(PATH))
    for change in (
        lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="\\w+"),
        lambda s: s["normalizer"]["normalizers"][1]["pattern"].update(Regex="x"),
        lambda s: s["normalizer"]["normalizers"].pop(),
        lambda s: s["model"].update(type="WordPiece"),
    ):
        other = json.loads(json.dumps(spec))
        change(other)
        with pytest.raises(ValueError, match="supported"):
            Tokenizer(json.dumps(other).encode())


def test_rows_that_occur_again(spark, edges, library):
    twice = edges.union(edges)
    for done in (count_tokens(edges, PATH), round_trip(edges, PATH)):
        again = count_tokens(twice, PATH) if "n_bytes" in done.columns else round_trip(twice, PATH)
        rows = sorted(map(str, done.collect()))
        assert sorted(map(str, again.collect())) == sorted(rows * 2)


def test_rank_array_equals_heap():
    tokenizer = Tokenizer(file_bytes(PATH))
    for word in ("internationalization", "aaaaaaaaaaaaaaaab", "thethethethe", "x", "ab" * 40):
        parts = tokenizer.parts(word)
        assert scan_ranks(list(parts), tokenizer.ranks) == heap_ranks(list(parts), tokenizer.ranks)


def test_whole_words_are_single_tokens(library):
    whole = Tokenizer(file_bytes(PATH)).whole_words()
    assert len(whole) > 30_000
    for word in whole[::50]:
        assert len(library.encode(word, add_special_tokens=False).ids) == 1


def test_queries(spark, sf, library):
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    counts = op1_token_counts(spark, sf).collect()
    assert sorted(r.doc_id for r in counts) == sorted(texts)
    assert all((r.n_tokens, r.n_bytes) == (len(ids[r.doc_id]), len(texts[r.doc_id].encode())) for r in counts)
    for r in op5_bpe_round_trip(spark, sf).collect():
        decoded = library.decode(ids[r.doc_id], skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), sha(" ".join(map(str, ids[r.doc_id]))), sha(decoded))
