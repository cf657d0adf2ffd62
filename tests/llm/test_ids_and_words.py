"""Ids of all 64 bits beside nulls in every operator, and words encoded alone and in batches."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import decontam, exact, html_extract, packing, pii, simhash, substring, toxicity, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
A, B = 2**62 + 1, 2**62 + 3
TEXT = "the same long text of words " * 6


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([(B, TEXT), (None, "other"), (A, TEXT)], "doc_id long, text string").coalesce(1).cache()


@pytest.fixture(scope="module")
def wide_pages(spark):
    return spark.createDataFrame([(B, "u", "<p>one page</p>"), (None, "u", "x"), (A, "u", "<p>one page</p>")], "page_id long, url string, html string").coalesce(1).cache()


def test_ids_of_documents(spark, wide):
    labels = spark.createDataFrame([(A, 1), (B, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    frames = [
        packing.pack(wide, PATH), toxicity.toxicity(wide, labels), decontam.contamination(wide, items), simhash.near_duplicates(wide),
        substring.remove_repeats(wide), exact.exact_duplicates(wide), pii.find_personal_data(wide),
    ]
    for out in frames:
        assert {r.doc_id for r in out.collect()} == {A, B, None}
    assert {r.doc_id: r.keep_id for r in frames[5].collect() if r.doc_id} == {A: B, B: B}
    assert {r.doc_id: r.component_id for r in frames[3].collect() if r.doc_id} == {A: A, B: A}
    removed = {r.doc_id: r.n_removed for r in frames[4].collect()}
    assert removed[B] == 36 and removed[A] < 36


def test_ids_of_pages(wide_pages):
    assert {r.page_id for r in html_extract.main_text(wide_pages).collect()} == {A, B, None}
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(wide_pages).collect()} == {(A, "response", None), (B, "revisit", A), (None, "response", None)}


def test_encoder_on_texts_alone_and_in_batches():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(PATH), random.Random(4)
    parts = ["it", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'r", "''s", " ", "\n", "a", "é", "7", "42", ".", "-", "S", "'S", "\x85", "x'"]
    texts = ["it's", "'s", "'", "he said it's", "we're", "they'll", "x'l", ""] + ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(3000)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = packing.WordEncoder(PATH)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [encoder.encode([t])[0].tolist() for t in texts] == want


def test_last_text_of_a_batch_ends_in_a_contraction(spark):
    out = packing.pack(spark.createDataFrame([(1, "he said it's")], "doc_id long, text string"), PATH).first()
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(PATH).encode("he said it's", add_special_tokens=False).ids, 1]
    assert out.length == len(ids) and out.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
