"""Encoding, decoding and counting against the tokenizer libraries."""

import os

import pytest
from pyspark.sql import functions as F

from codesift.llm.pieces import BPE, DEFAULT_MODEL, UNIGRAM, model_bytes, parse
from codesift.llm.tokencount import Counter, count_tokens
from codesift.llm.wfst import Transducer, decode, encode

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_MODEL), reason="no tokenizer files")

ODD = [
    "", " ", "  a  b ", "\n\nx", "日本語テスト😀 zz", "a" * 300, "<s> </s>", "\x00\x01 tab\t", " " * 40 + "end", "hello" * 50,
    "ﬁ ½ é é", "mixed 123456789 https://a.b/c?d=e&f", "no spaces at all".replace(" ", ""), "x" * 5000, "ab " * 3000, "trailing ",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return ODD + [r.text for r in rows]


def test_encoding_is_the_library_s(texts):
    import sentencepiece

    machine = Transducer(model_bytes())
    assert machine.bpe
    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    for text in texts:
        ids = machine.encode(text)
        assert ids == library.encode(text)
        assert machine.decode(ids) == library.decode(ids) == text
    assert machine.decode(machine.encode("a▁b")) == "a b"


def as_unigram(fallback=True):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(model_bytes())
    model.trainer_spec.model_type = UNIGRAM
    model.trainer_spec.byte_fallback = fallback
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -1.0 - (i % 4096) / 512  # small scores, with ties
        elif p.type == 6 and not fallback:
            p.type = 3
    return model.SerializeToString()


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_paths(texts, fallback):
    import sentencepiece

    blob = as_unigram(fallback)
    machine, counter = Transducer(blob), Counter(blob)
    assert not machine.bpe
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in texts:
        short = text[:200]  # the library sums in single precision, which rounds on long texts
        ids = library.encode(short)
        assert machine.encode(short) == ids
        assert counter.count(short) == len(ids)
        assert counter.count(text) == len(machine.encode(text))


def test_counts_are_viterbi_s(texts):
    from tokenizers import Tokenizer, models

    pieces = parse(model_bytes())
    low = min(pieces.scores.values())
    vocabulary = [(n, pieces.scores[n] if k == 1 else low) for n, k in zip(pieces.names, pieces.kinds)]
    library = Tokenizer(models.Unigram(vocabulary, pieces.unk, True))
    counter = Counter(model_bytes())
    for text in texts:
        if "<" not in text:  # the library takes byte and control pieces for text
            assert counter.count(text) == len(library.encode(pieces.normalise(text), add_special_tokens=False).ids)


def test_merge_condition_is_exact():
    """The path of allowed neighbours is the result of merging, on strings of frequent pieces."""
    import random

    machine = Transducer(model_bytes())
    assert machine.pieces.kind == BPE
    rng = random.Random(5)
    names = [n for n in machine.ids if n.isascii()][:400]
    for _ in range(300):
        text = "".join(rng.choices(names, k=rng.randint(1, 8)))
        assert [machine.names[i] for i in machine.solve(text)] == machine.merges(text)


def test_frames(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, None), (1, texts[1], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode(df, decoded=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "__ids", "__decoded"]
    for r in out.collect():
        assert r["__decoded"] == r.text and (len(r["__ids"]) == 0) == (not r.text)
    back = decode(out.drop("__decoded"), "__ids").collect()
    assert all(r["__decoded"] == (r.text or "") for r in back)
    counted = {r.doc_id: r["__tokens"] for r in count_tokens(df).collect()}
    assert counted[None] == 0 and counted[0] == 0 and counted[3] > 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty).count() == count_tokens(empty).count() == 0
    assert dict(encode(empty).dtypes)["__ids"] == "array<int>"
    assert decode(spark.createDataFrame([(None,), ([],)], "i array<int>"), "i").select(F.col("__decoded")).collect() == [(None,), ("",)]
