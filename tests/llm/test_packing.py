import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linewright.llm import packing, queries
from linewright.llm.token_ids import PieceEncoder, public_path

from ..conftest import SF
from . import edge_cases


def library(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def check(df, rows):
    got = [tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    ids = {i: np.array([*x, 0], dtype="<u4") for (i, _), x in zip(rows, library([t or "" for _, t in rows]))}
    by = defaultdict(list)
    places = defaultdict(list)
    for i, piece, start, length, crc, seq, offset in got:
        by[i].append((piece, start, length))
        places[seq].append((offset, length))
        assert crc == zlib.crc32(ids[i][start : start + length].tobytes())
    assert by.keys() == ids.keys()
    for i, own in by.items():
        here = 0
        for k, (piece, start, length) in enumerate(sorted(own)):
            assert piece == k and start == here and 0 < length <= 2048 and (k == 0 or length == 2048)
            here += length
        assert here == len(ids[i])
    for own in places.values():
        here = 0
        for offset, length in sorted(own):
            assert offset == here
            here += length
        assert here <= 2048
    return len(places), -(-sum(map(len, ids.values())) // 2048)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check(queries.op6_exact_complement_packing(spark, SF), rows)
    assert used <= least + max(2, least // 50)


def test_edges(spark):
    docs = edge_cases.frame(spark)
    check(packing.pack(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(edge_cases.empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_uses_each_piece_once(histogram):
    used = Counter()
    for lengths, times in packing.plan(histogram, 64):
        assert times > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == Counter(histogram)


def test_plan_finds_exact_triples():
    patterns = packing.plan({1000: 5, 700: 5, 348: 5, 2048: 2, 1500: 3, 548: 3})
    assert all(sum(p) == 2048 for p, _ in patterns)


def test_pieces_equal_whole_texts():
    rng = random.Random(3)
    odd = ["'s 'S don't I'll  x\n\n y\t\tz", "<|endoftext|> a", "  ", "é" * 9 + " ½ ² 12a3 　x", "''re 've've", "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32, 39])) for _ in range(5000))]
    e = PieceEncoder(public_path())
    for text, ids in zip(odd, library(odd)):
        assert np.frombuffer(e.whole(text), dtype="<u4").tolist() == ids


def test_narrow_texts_split_alike():
    import public_tokenizers
    import regex

    from linewright.llm import token_ids as T

    e, rng = PieceEncoder(public_path()), random.Random(6)
    assert e.split_narrow != e.split and T.narrow_pattern(r"\p{Lu}+") is None
    for _ in range(3000):
        text = "".join(rng.choice([chr(rng.randrange(T.NARROW)), rng.choice(" '\n\xa0½²ßa1!s")]) for _ in range(rng.randint(0, 40)))
        assert not T._IS_WIDE(text) and e.split_narrow(text) == regex.findall(public_tokenizers.PATTERN, text)
    assert T._IS_WIDE("abc\u0250")


SPECIAL = [(1, "before<|endoftext|> after"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|>\n<|endoftext"), (4, "plain words")]


def test_added_tokens_as_in_the_library(spark):
    t = Tokenizer.from_file(public_path())
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in SPECIAL}
    assert 50256 in want[1]
    rows = packing.pack(spark.createDataFrame(SPECIAL, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in want.items()}
    e, rng = PieceEncoder(public_path()), random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["<|endoftext|>", "<|endoftext|>", " ", "\n", "a b", "<|", "|>", "  word", "'s", "é", "12"]) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(e.whole(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_null_ids(spark):
    from . import edge_cases

    docs = edge_cases.repeated(spark)
    got = packing.pack(docs).collect()
    assert len(got) == docs.count() and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    sizes = {x: len(i) + 1 for x, i in zip({t or "" for _, t, _ in edge_cases.repeated_rows()}, library(list({t or "" for _, t, _ in edge_cases.repeated_rows()})))}
    assert sorted((str(r.doc_id), r.length) for r in got) == sorted((str(i), sizes[t or ""]) for i, t, _ in edge_cases.repeated_rows())
