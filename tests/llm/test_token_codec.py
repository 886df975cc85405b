import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linewright.llm import queries, token_codec as C

from ..conftest import SF
from . import edge_cases


def check(df, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}
    at, want = 0, {}
    rows = sorted(rows)
    for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], dtype="<u4")
        want[i] = at, len(ids), zlib.crc32(ids.tobytes())
        at += len(ids)
    assert got == want


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.op7_context_mixing_coder(spark, SF), rows)


def test_edges(spark):
    docs = edge_cases.frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(C.read_ids(C.write_ids(docs, block=64, lanes=8)), rows)
    assert C.read_ids(C.write_ids(edge_cases.empty(spark))).count() == 0
    twice = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in C.read_ids(C.write_ids(twice)).collect()) == [(False, 2, 3), (False, 5, 3), (True, 0, 2)]
    ends = spark.createDataFrame([(-(1 << 63), "a b"), ((1 << 63) - 1, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start) for r in C.read_ids(C.write_ids(ends)).collect()) == [(-(1 << 63), 0), ((1 << 63) - 1, 3)]
    odd = edge_cases.repeated(spark)
    assert C.read_ids(C.write_ids(odd)).count() == odd.count()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, (1 << 17) - 1)), min_size=1, max_size=300), st.integers(1, 70), st.integers(1, 5))
def test_round_trip(ids, block, lanes):
    ids = np.array(ids, dtype="<u4")
    blocks = C.encode_blocks(ids, [(0, 7, len(ids))], 0, block, lanes)
    random.Random(1).shuffle(blocks)
    out = sorted(((first, x) for first, x, _ in C.decode_blocks(blocks, lanes)), key=lambda p: p[0])
    assert np.array_equal(np.concatenate([x for _, x in out]), ids)


def test_repetition_is_learned_and_damage_is_seen():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 40), 100).astype("<u4")
    (block,) = C.encode_blocks(ids, [(0, 1, len(ids))], 0)
    assert len(block) < len(ids) * 2 / 4
    for at in (0, 30, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(C.decode_blocks([bytes(bad)]))


def test_joined_checksums():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"hello" * 9, b"world" * 5000)):
        assert C.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_added_tokens_as_in_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, want, at = [(1, "before<|endoftext|> after"), (2, "<|endoftext|>"), (3, "plain words")], {}, 0
    for i, x in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4")
        want[i] = at, len(ids), zlib.crc32(ids.tobytes())
        at += len(ids)
    got = C.read_ids(C.write_ids(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_classes_by_groups_and_packed_slots_code_as_plain_counts():
    """Parts of classes are sums of the counts, also after halving; the bytes are those of the first version of the format."""
    rng = np.random.default_rng(4)
    model, plain = C._Model(5), np.ones((5, 64), dtype=np.int64)
    for _ in range(3000):
        lanes = np.sort(rng.choice(5, rng.integers(1, 6), replace=False))
        kind = np.minimum(rng.geometric(0.1, len(lanes)), 64) - 1
        before, own = model.class_part(lanes, kind)
        sums = np.cumsum(plain[lanes], axis=1)
        row = np.arange(len(lanes))
        assert (own == plain[lanes, kind]).all() and (before == sums[row, kind] - plain[lanes, kind]).all() and (model.total[lanes] == sums[:, -1]).all()
        value = rng.integers(0, sums[:, -1]).astype(np.uint64)
        found, before, own = model.class_at(lanes, value)
        assert (before <= value).all() and (value < before + own).all() and (own == plain[lanes, found]).all()
        model.learn_class(lanes, kind)
        plain[lanes, kind] += 24
        full = plain.sum(axis=1) > 1 << 14
        plain[full] = (plain[full] + 1) >> 1
    ids = np.concatenate((np.arange(3000) ** 2 % 50_021, np.tile(np.arange(40), 60))).astype("<u4")
    assert zlib.crc32(b"".join(C.encode_blocks(ids, [(0, 1, len(ids))], 0))) == 733806813


def test_frequent_pieces_stay_when_the_store_is_full(monkeypatch):
    from linewright.llm import token_ids

    monkeypatch.setattr(token_ids, "CACHE_PIECES", 40)
    coder, asked = token_ids.PieceEncoder(token_ids.public_path()), []
    monkeypatch.setattr(coder.cache, "encode", lambda piece: asked.append(piece) or coder._encode(piece))
    text = "the cat" + "".join(f" w{chr(97 + k % 26)}{chr(97 + k // 26)} the cat" for k in range(300))
    want = Tokenizer.from_file(token_ids.public_path()).encode(text, add_special_tokens=False).ids
    assert np.array_equal(np.frombuffer(coder.raw(text), dtype="<u4"), want)
    assert asked.count(" the") == asked.count(" cat") == 1 and len(coder.cache) <= 40
