"""Token files, sharding, mixing."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import mixing, sharding, token_frames
from linkloom.llm._shared import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip(spark, messy, plain):
    out = shared_dir(spark)
    manifest = token_frames.write_token_frames(messy, out, PATH, 2)
    got = token_frames.read_token_frames(spark, out).collect()
    want = Counter((r.doc_id, tuple(ids_of(plain, r.text))) for r in messy.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    at, last = 0, -1
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    assert sum(m["n_tokens"] for m in manifest) == at


def test_reads_only_asked_frames(spark, messy, plain):
    out = shared_dir(spark)
    manifest = token_frames.write_token_frames(messy, out, PATH, 2)
    text = {r.doc_id: r.text for r in messy.collect()}
    file = next(f for m in manifest if 105 in (f := token_frames.FrameFile(f"{out}/{m['file']}")).ids)
    assert [x.tolist() for x in file.document(105)] == [ids_of(plain, text[105])]
    got = token_frames.read_token_frames(spark, out, [105, 3]).collect()
    assert {r.doc_id: r.ids for r in got} == {k: ids_of(plain, text[k]) for k in (105, 3)}


def test_frames_stand_alone_and_damage_is_seen(spark, messy):
    out = shared_dir(spark)
    m = token_frames.write_token_frames(messy.where("doc_id < 9"), out, PATH, 2)[0]
    path = f"{out}/{m['file']}".removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    first = zstandard.ZstdDecompressor().decompress(bytes(raw), allow_extra_data=True)  # any tool reads frame 0
    assert first == next(token_frames.FrameFile(f"{out}/{m['file']}").frames([0]))[1].tobytes()
    raw[12] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_frames.FrameFile(f"{out}/{m['file']}").frames([0]))


def test_empty_table_gives_no_files(spark, nothing):
    out = shared_dir(spark)
    assert token_frames.write_token_frames(nothing, out, PATH, 2) == []
    assert token_frames.read_token_frames(spark, out).count() == 0


@pytest.mark.parametrize("hot", [None, 7])
def test_an_id_with_most_rows_gets_several_files(spark, plain, hot):
    rows = [(hot if k % 4 else k, f"word{k} and {k * 7} more") for k in range(400)]
    out = shared_dir(spark)
    manifest = token_frames.write_token_frames(spark.createDataFrame(rows, "doc_id long, text string"), out, PATH, 2)
    assert sum(hot in token_frames.FrameFile(f"{out}/{m['file']}").ids for m in manifest) > 2
    got = sorted(token_frames.read_token_frames(spark, out).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids_of(plain, t))) for i, t in rows)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_memo_is_exact(plain, monkeypatch):
    import random

    coder = token_frames.WordEncoder(PATH, 2)
    assert coder.exact
    monkeypatch.setattr(token_frames, "CACHE_WORDS", 500)  # so that it is emptied often
    monkeypatch.setattr(token_frames, "LOT_BYTES", 700)
    r = random.Random(5)
    parts = [*"abcZE'’stre19 .,!\t\n\r\x0b\x0c\x1c\x85é́ßΣσİ中文ﬁ<|>", "\xa0", "　", "'s", "the. ", "AND, ", "<|endoftext|>", "<|end", "x!? ", "Ünï "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts[:3] = ["", "", "a long one " * 200]
    got = coder.encode(pa.array(texts))
    assert coder.encode(pa.array([], pa.string())) == []
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids_of(plain, t) for t in texts]


def test_shards_are_contiguous_and_balanced(messy):
    got = sharding.shard_by_bytes(messy, 4).collect()
    rows = sorted(messy.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), zlib.crc32((r.text or "").encode())))
    got.sort(key=lambda r: r.start)
    at, slots, total = 0, Counter(), sum(len((r.text or "").encode()) + 1 for r in rows)
    for a, b in zip(rows, got, strict=True):
        size = len((a.text or "").encode()) + 1
        assert (b.doc_id, b.size, b.text_crc32, b.start) == (a.doc_id, size, zlib.crc32((a.text or "").encode()), at)
        assert b.shard == min(3, at * 4 // total) and b.slot == slots[b.shard]
        slots[b.shard] += 1
        at += size


def test_shards_of_nothing(nothing):
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_mix_meets_targets(messy):
    got = mixing.mix(messy).collect()
    assert len(got) == messy.count()
    for source in {tuple(r.sources) for r in got}:
        own = [r for r in got if tuple(r.sources) == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    key = lambda rows: Counter((r.doc_id, r.size, r.taken) for r in rows)
    assert key(got) == key(mixing.mix(messy.repartition(3)).collect())


def test_mix_of_many_rows_has_exact_cuts(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'hot' else concat('s', id % 7) end").alias("source"))
    for bins in (4, 4096):
        got = mixing.mix(docs, bins=bins).groupBy("sources").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()
        assert all(abs(r.t - r.target) <= 1 for r in got)


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing, chars_col="n_chars").columns == nothing.columns


def test_mixed_rows_follow_taken(messy):
    taken = sum(r.taken for r in mixing.mix(messy).collect())
    made = mixing.mixed_documents(messy, chars_col="n_chars")
    assert made.schema == messy.schema
    assert made.select(F.sum(mixing.word_count(F.col("text"))).alias("w")).first().w == taken


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, "a b c d", ["x"] if k < 10 else ["x", "y"] if k < 30 else ["y"]) for k in range(40)], "doc_id long, text string, source array<string>")
    got = mixing.mix(docs, weights=(1, 1), share=1.0).collect()
    assert sum(r.taken for r in got) == 160 and max(r.taken for r in got) <= 8


def test_flow_against_all_flows():
    """Least cost over all ways to fill small quotas."""
    capacity, members = {"p": 2, "q": 2, "r": 1}, {"p": "a", "q": "ab", "r": "b"}
    for quota in product(range(5), range(5)):
        quotas = dict(zip("ab", quota))
        used, short = mixing.min_cost_flow(capacity, quotas, members, 2)
        cost = lambda u: sum(max(0, sum(u.get((p, s), 0) for s in "ab") - c) for p, c in capacity.items())
        options = []
        for pa, qa, qb, rb in product(range(5), range(5), range(5), range(3)):
            u = {("p", "a"): pa, ("q", "a"): qa, ("q", "b"): qb, ("r", "b"): rb}
            if pa <= 4 and qa + qb <= 4 and rb <= 2 and pa + qa <= quota[0] and qb + rb <= quota[1]:
                options.append((sum(quota) - pa - qa - qb - rb, cost(u)))
        assert (short, cost(used)) == min(options)
