"""Piece encoding against the library: ids, source spans and decoded texts, also under other normalisation rules."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from gridloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "  a  b ", "\0x\0", "▁▁a ▁", "é́ 😀 ñ", "a\nb\r\n\n\tc ", "x" * 5000, "the cat " * 400, "12345 6,7", " ｆｕｌｌ　ﬁｇ  ", "▁", "a▁b", "​", "  ​ x"]
RULES = {"ﬁ": "fi", "ｆ": "f", "ｆｕ": "FU", "ｕ": "u", "　": " ", "\t": " ", "\n": "  ", "​": "", "é": "e b ", "…": ". . .", "x́": " x", "½": " 1/2"}


def charmap(rules: dict[str, str]) -> bytes:
    """The compiled form of rules: a double-array trie that gives every node's children a block of 256 units."""
    trie: dict = {}
    texts, at = b"", {}
    for key, new in rules.items():
        at[key] = len(texts)
        texts += new.encode() + b"\0"
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[0] = at[key]
    units, todo = [0] * 256, [(0, trie)]
    while todo:
        place, node = todo.pop()
        base = len(units)
        units += [0] * 256
        units[place] |= (place ^ base) << 10 if (place ^ base) < 1 << 21 else (place ^ base) >> 8 << 10 | 1 << 9
        for label, child in node.items():
            if label == 0:
                units[place] |= 1 << 8
                units[base] = child | 1 << 31
            else:
                units[base ^ label] = label
                todo.append((base ^ label, child))
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def model(**changes) -> bytes:
    proto = ModelProto.FromString(open(PATH, "rb").read())
    for name, value in changes.items():
        setattr(proto.trainer_spec if name.startswith("treat") else proto.normalizer_spec, name, value)
    return proto.SerializeToString()


def same(raw: bytes, texts: list[str], whole: bool = False) -> None:
    library, encoder = SentencePieceProcessor(model_proto=raw), pieces.PieceEncoder(raw)
    encoder.by_words &= not whole
    ids, begins, ends, upto = encoder.encode([t.encode() for t in texts])
    for i, text in enumerate(texts):
        own = slice(upto[i], upto[i + 1])
        want = library.encode(text, return_type="proto").pieces
        assert list(zip(ids[own].tolist(), begins[own].tolist(), ends[own].tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in want], text


def made(rng: random.Random, n: int) -> list[str]:
    alphabet = [*"ab x1", "  ", "▁", "é", "😀", "the ", *RULES]
    return ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("collapse", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("suffix", [False, True])
@pytest.mark.parametrize("mapped", [False, True])
def test_ids_and_spans_equal_the_library(collapse, prefix, suffix, mapped):
    raw = model(remove_extra_whitespaces=collapse, add_dummy_prefix=prefix, treat_whitespace_as_suffix=suffix, precompiled_charsmap=charmap(RULES) if mapped else b"")
    same(raw, ODD + made(random.Random(9), 400))
    same(raw, ODD[:6] + made(random.Random(3), 50), whole=True)


def test_user_symbols_are_kept():
    proto = ModelProto.FromString(model(precompiled_charsmap=charmap(RULES)))
    for place, text in ((400, "ﬁx"), (401, "ｆ")):
        proto.pieces[place].piece, proto.pieces[place].type = text, proto.pieces[place].USER_DEFINED
    same(proto.SerializeToString(), ["ﬁx ﬁ", "ｆｕ ｕ", *made(random.Random(5), 200)])


def test_unknown_pieces_without_byte_fallback():
    proto = ModelProto.FromString(model())
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == p.BYTE:
            p.type = p.NORMAL
    same(proto.SerializeToString(), ["ሴስ aሴ", "", *made(random.Random(6), 100)])


def test_encode_and_decode_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(2**62 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (2**62, "again"), (5, None)], "doc_id long, text string")
    both = docs.unionByName(odd)
    library = SentencePieceProcessor(model_file=PATH)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in both.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.tokens_and_text(both, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.tokens_and_text(both.limit(0), PATH).count() == 0
    again = [(r.doc_id, sha(r.decoded)) for r in pieces.decode(pieces.encode(both, PATH), PATH).collect()]
    assert sorted(again, key=str) == sorted([(w[0], w[3]) for w in want], key=str)


def test_columns_of_other_names_pass(spark):
    docs = spark.createDataFrame([(1, "one two", "e", 3)], "doc_id long, text string, ids string, decoded int")
    tokens = pieces.encode(docs, PATH)
    assert tokens.columns == ["doc_id", "ids", "begins", "ends"]
    more = tokens.selectExpr("'p' AS decoded", "*", "CAST(null AS array<int>) AS none")
    row = pieces.decode(more, PATH).first()
    assert (row.doc_id, row.decoded, list(row.begins), list(row.ends)) == (1, "one two", [0, 3], [3, 7])
    assert pieces.decode(tokens.withColumn("ids", pieces.F.lit(None).cast("array<int>")), PATH).first().decoded == ""
