"""Merge rounds against the sentencepiece library, on whole tables and on texts made to be hard."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import piece_rounds
from linkloom.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER = piece_rounds.PieceCoder(PATH)
HARD = [
    "", " ", "  ", "a", "▁", "a▁▁b", "\n", "\n\n a\n ", " " * 15, "x" * 3000, "🙂 é", "a" + " " * 100 + "b", "\x00", " \n \n", "in" * 50,
    "    the", "▁ ▁the", "<s></s><unk><0x0A>", "ha" * 999 + "h", "aaaa" * 333, "中文字" * 100, "é" * 20, "� ", " " * 2000,
]


def same(texts):
    got = CODER.encode(texts)
    want = [x + [2] for x in LIBRARY.encode(texts, num_threads=1)]
    assert got.to_pylist() == want
    assert CODER.decode(got).to_pylist() == [LIBRARY.decode(x) for x in want]


def test_hard_texts():
    same(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("etaoinshr  \n.,▁é中\U0001f600="), max_size=80), max_size=6))
def test_any_texts(texts):
    same(texts)


def test_random_pieces():
    r = random.Random(4)
    names = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    same(["".join(r.choice(names) for _ in range(r.randint(0, 30))) for _ in range(800)])


def test_runs_of_spaces_of_any_length():
    same(["x" + " " * k + "y" for k in range(140)])


def test_lots(monkeypatch):
    monkeypatch.setattr(piece_rounds, "LOT_BYTES", 50)
    same(HARD * 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 31999), st.integers(3, 258), st.sampled_from([0, 1, 2, 28705, 259, 261, 229, 153, 132])), max_size=12), max_size=5))
def test_decoding_of_any_ids(lists):
    assert CODER.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(x) for x in lists]


def test_an_id_outside_the_vocabulary_is_told():
    with pytest.raises(ValueError):
        CODER.decode(pa.array([[32000]], pa.list_(pa.int32())))


def expected(text):
    ids = LIBRARY.encode(text or "") + [2]
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), hashed(" ".join(map(str, ids))), hashed(LIBRARY.decode(ids))


def test_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: expected(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_piece_rounds"](spark, sf).collect()}
    assert got == want


def test_messy_and_empty_tables(spark, messy, nothing):
    got = piece_rounds.decode(piece_rounds.encode(messy, PATH), PATH)
    assert got.columns == [*messy.columns, "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r.ids == LIBRARY.encode(r.text or "") + [2] and r.decoded == LIBRARY.decode(r.ids)
    assert piece_rounds.encode(messy, PATH, out="label").columns == messy.columns  # a column of that name is replaced
    assert piece_rounds.decode(piece_rounds.encode(nothing, PATH), PATH).count() == 0
    no_ids = spark.createDataFrame([(1, None), (2, [261])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in piece_rounds.decode(no_ids, PATH).collect()} == {1: None, 2: "t"}
