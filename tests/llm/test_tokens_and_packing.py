import zlib

import numpy as np
import pytest

from loomstat.llm import packing, simple8b
from loomstat.llm.encoding import Encoder, tokenizer_path
from loomstat.session import scratch_path
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("wide", [False, True])
def test_simple8b_round_trip(wide):
    rng = np.random.default_rng(1)
    for k in range(120):
        n = int(rng.integers(0, 4000))
        ids = rng.integers(0, 2**64, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64) if wide else rng.integers(0, 50_000, n).astype(np.uint64)
        words, offsets = simple8b.encode(ids)
        assert (simple8b.decode(words, offsets, n) == ids).all()
        if n > 1:
            a, b = sorted(rng.integers(0, n, 2).tolist())
            assert (simple8b.decode_range(words, offsets, n, a, b + 1) == ids[a : b + 1]).all()


def test_simple8b_packs_small_ids():
    words, _ = simple8b.encode(np.zeros(60_000, np.uint64))
    assert len(words) <= 60_000 / 60 * 1.1
    words, offsets = simple8b.encode(np.array([2**64 - 1, 2**60, 0], np.uint64))
    assert len(words) == 5 and simple8b.decode(words, offsets, 3).tolist() == [2**64 - 1, 2**60, 0]


def test_encoder_equals_tokenizer(tokenizer):
    import pyarrow as pa

    texts = ["Hello, World! it's 2024...", "<|endoftext|> a<|startoftext|>b", "ÀÉ ñandú, straße. İstanbul ΟΔΟΣ", "é x\u0085y z w", "", None,
             "a.b,c!d? ... ,,", "\x1c\x1d 12345 x1y", "日本語 テキスト", "don't we'll I'M", "퟿ \U0001f600\U0001f601"]
    lengths, ids = Encoder().encode(pa.array(texts), 2)
    bounds = np.r_[0, np.cumsum(lengths)]
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(tokenizer, t, 2).tolist()


def test_files_round_trip(spark, odd, tokenizer):
    path = scratch_path(spark, "test-tokens")
    simple8b.write(odd, path, end=2, shards=3)
    got = sorted(simple8b.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert len(got) == len(ODD)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i))
    texts, at = {r[0]: r[1] for r in ODD}, 0
    for r in got:
        want = ids_of(tokenizer, texts[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(want), zlib.crc32(want.tobytes()), want.tolist())
        at += len(want)


def test_tightest_fit_by_hand():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1]
    bins, offsets = packing.best_fit(lengths, 100)
    left: list[int] = []
    for k, need in enumerate(lengths.tolist()):
        room = [r for r in left if r >= need]
        if room:
            assert left[bins[k]] == min(room)
        else:
            assert bins[k] == len(left)
            left.append(100)
        assert offsets[k] == 100 - left[bins[k]]
        left[bins[k]] -= need
    assert len(left) <= 1.05 * lengths.sum() / 100 + 1


def test_packing_is_whole_and_gapless(odd, tokenizer):
    got = packing.pack(odd, end=1, capacity=64).collect()
    ids = {r[0]: ids_of(tokenizer, r[1], 1) for r in ODD}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 64 and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(len(ids[r[0]]) for r in ODD)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_nothing_to_encode(spark, empty):
    path = scratch_path(spark, "test-tokens")
    simple8b.write(empty, path, end=2)
    assert simple8b.read(spark, path).count() == 0 and packing.pack(empty, end=1).count() == 0
