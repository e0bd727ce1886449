"""Token alignment against a plain walk over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomstat.llm import alignment as al


def plain(texts):
    """Contract columns by a walk over byte offsets, for distinct ids."""
    pair = al.process_pair(al.BYTE_TOKENIZER, al.PIECE_TOKENIZER)
    rows, links = {}, {}
    for i, text in texts:
        a, b = pair.ids([text or ""])
        a, b = (a[0], b[0]) if text else ([], [])
        ends = []
        for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, found = 0, []
            for x in ids:
                at += len(table[x])
                found.append(at)
            ends.append(found)
        common = sorted(set(ends[0]) & set(ends[1]))
        links[i] = [(x, y) for x, p in zip(a, ends[0]) for y, q in zip(b, ends[1]) if p == q]
        groups, low = [], 0
        for c in common:
            groups.append(",".join(str(x) for x, p in zip(a, ends[0]) if low < p <= c) + "|" + ",".join(str(x) for x, p in zip(b, ends[1]) if low < p <= c))
            low = c
        text = ";".join(groups)
        rows[i] = [len(a), len(b), len(common), hashlib.sha256(text.encode()).hexdigest() if text else ""]
    counts = Counter(x for found in links.values() for x in found)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return {i: (*rows[i][:3], len(links[i]), sum(counts[x] == best[x[1]] for x in links[i]), sum(counts[x] for x in links[i]), rows[i][3]) for i in rows}


def rows_of(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


TEXTS = ["the cat sat on the mat", "The  cat\n\nsat", "Ärger über Straße \U0001f600 12345", "<|endoftext|> and </s> <s>", "ﬁne ligature", "▁x", "a\x00b",
         "don't stop-believing, naïve café!", " leading and trailing ", "日本語のテキスト", "x" * 3000, "the cat sat"]


@pytest.mark.parametrize("frequent", [1, 1 << 20])
def test_columns_equal_the_plain_walk(make, frequent):
    rng = random.Random(1)
    words = " ".join(TEXTS).split()
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(900, None), (901, "")]
    got = rows_of(al.align(make([(i, t, "en", "a") for i, t in rows]), frequent=frequent))
    assert got == plain(rows)
    assert got[900] == got[901] == (0, 0, 0, 0, 0, 0, "") and got[5][0] == 0 and got[0][0] > 0


def test_odd_rows(odd, empty):
    assert al.align(odd).count() == odd.count()
    assert al.align(empty).count() == 0


def test_gallop_finds_lower_bounds_from_any_guess():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lists = [np.sort(rng.choice(60, rng.integers(0, 30), replace=False)) for _ in range(4)]
        sizes = np.array([len(x) for x in lists])
        ends, first = np.concatenate(lists).astype(np.int64), np.cumsum(sizes) - sizes
        of, wanted = rng.integers(0, 4, 50), rng.integers(-2, 63, 50)
        low, high = first[of], first[of] + sizes[of]
        got = al.gallop(wanted, ends, low, high, low + rng.integers(0, 40, 50))
        for w, a, b, g in zip(wanted, low, high, got):
            if a < b:
                assert g == a + np.searchsorted(ends[a:b], w)


def test_tokens_without_bytes_link_with_all_that_end_there():
    sizes = np.array([1, 2, 0]), np.array([1, 3, 0])
    x = al.aligned(sizes, [[0, 1, 2], []], [[1, 2], []])  # ends 1, 3, 3 and 3, 3
    assert sorted(zip(x["link_a"].tolist(), x["link_b"].tolist())) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert x["group_a"].tolist() == [3] and x["group_b"].tolist() == [2] and x["group_of"].tolist() == [0]


def test_ranks_give_the_ids_of_the_vocabulary_file():
    pair = al.process_pair(al.BYTE_TOKENIZER, al.PIECE_TOKENIZER)
    rng = random.Random(11)
    signs = [chr(c) for c in [*range(1, 127), 0xA0, 0xE9, 0xDF, 0x301, 0x2028, 0x4E2D, 0x1F600, 0x200D]]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["it's", "we'LL", "  ", "\n", "0123456", "naïve", "<|endoftext|>"]) for _ in range(20)) for _ in range(300)]
    want = [e.ids for e in pair.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert pair.ranked is not None and pair.first_ids([" " + t for t in texts]) == want
