import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st

from subsidia.llm import piece_codec, token_counts
from tests.llm.messy import ROWS, both

MODEL, SPEC = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    spec = open(SPEC, encoding="utf-8").read()
    return token_counts.Counter(spec, token_counts.Counter(spec).table())


TEXTS = st.one_of(st.text(), st.text(alphabet="  aabthe<s>▁=\n-éß🙂漢0123"), st.text(alphabet=" \n\t'stre  \x1c\x85é漢1½<|endoftext|>."))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_equal_the_library(codec, library, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
    want = len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids)))
    assert codec.digests([text, "a", text]) == [want, codec.digests(["a"])[0], want]


@pytest.mark.parametrize("text", ["ab" * 3_000, " " * 5_000, "x" * 2_000 + " " * 2_000 + "the" * 900, "= " * 400 + "=" * 1_500])
def test_long_segments_equal_the_library(codec, library, text):
    assert codec.encode(text) == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(counter, text):
    assert counter.counts([text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_small_caches_change_nothing(library):
    spec = open(SPEC, encoding="utf-8").read()
    small, texts = token_counts.Counter(spec, {"the": 1}, 3), ["the cat sat", "on the mat", "", "the cat"]
    assert [small.counts([t])[0] for t in texts] == token_counts.Counter(spec).counts(texts)
    tiny = piece_codec.Codec(open(MODEL, "rb").read(), 2)
    assert [tiny.digests([t])[0][0] for t in texts] == [len(library.encode(t)) for t in texts]


def test_operators_on_edges(spark, library, counter):
    got = both(spark, lambda d: token_counts.token_counts(d, SPEC), lambda r: (r.doc_id is None, r.doc_id, r.n_bytes))
    want = sorted(((k, len((t or "").encode()), len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)
    got = both(spark, lambda d: piece_codec.piece_digests(d, MODEL), lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = sorted(((k, len(library.encode(t or ""))) for k, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want


def test_columns_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "  x", "ü 🙂\n", "", None])], "doc_id long, text string")
    back = piece_codec.decode_column(piece_codec.encode_column(docs, MODEL), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {0: "a b", 1: "  x", 2: "ü 🙂\n", 3: "", 4: ""}
