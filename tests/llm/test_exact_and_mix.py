import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from loomstat.llm import bloom, exact_dedup, mixing
from tests.llm.conftest import ODD


def copies(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    return by


@pytest.mark.parametrize("max_keys", [bloom.MAX_KEYS, 0])
def test_assign_equals_grouping(odd, max_keys):
    by = copies(ODD)
    rank = lambda i: -1 if i is None else i
    got = exact_dedup.assign(odd, max_keys=max_keys).collect()
    assert len(got) == len(ODD)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    for r in got:
        ids = by[texts[r.text_sha256]]
        assert (r.keep_id, r.group_size) == (max(ids, key=rank), len(ids))
    assert sum(r.kept for r in got) == len(by)


@pytest.mark.parametrize("max_keys", [bloom.MAX_KEYS, 0])
def test_drop_keeps_one_row_and_all_columns(odd, max_keys):
    out = exact_dedup.drop_copies(odd, max_keys=max_keys)
    assert out.columns == odd.columns
    assert Counter((r.text or "") for r in out.collect()) == Counter(set(copies(ODD)))


def test_hot_group_of_copies(make):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}", "en", "a") for i in range(6000)]
    got = {r.doc_id: r for r in exact_dedup.assign(make(rows)).collect()}
    assert got[3].keep_id == 5997 and got[3].group_size == 2000 and sum(r.kept for r in got.values()) == len({r[1] for r in rows})


def test_filter_never_loses_a_key(spark):
    keys = spark.range(5000).selectExpr("id * 7919 AS slot")
    probe = spark.range(20000).selectExpr("id * 7919 AS slot")
    marked = bloom.split(probe, probe["slot"], keys, "slot", 5000, "maybe").collect()
    hit = [r.maybe for r in marked if r.slot < 5000 * 7919]
    assert all(hit) and len(hit) == 5000
    assert sum(r.maybe for r in marked) < 5000 + 15000 * 0.05


def test_rows_cleared_by_the_filter_are_not_shuffled(make):
    out = exact_dedup.drop_copies(make([(i, f"t{i % 50}", "en", "a") for i in range(60)]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        over = [s for s in free if sum(w[x] for x in free) and left * w[s] / sum(w[x] for x in free) > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: left * w[s] / sum(w[x] for x in free) for s in free}}
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def test_mix_meets_targets(make):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", None if i % 11 == 0 else "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    got = mixing.assign(make(rows)).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = targets_by_hand(sizes)
    taken = Counter()
    for r in got:
        assert r.size == words(rows[r.doc_id][1]) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.taken <= 3 * r.size and r.taken % r.size == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 12 for s in want)
    again = mixing.assign(make(rows[::-1])).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_nested_thresholds(make):
    rows = [(i, "w", "en", "abc"[i % 3]) for i in range(900)]
    low = {r.doc_id: r.taken for r in mixing.assign(make(rows), weights=(1, 4, 4)).collect() if r.source == "a"}
    high = {r.doc_id: r.taken for r in mixing.assign(make(rows), weights=(2, 4, 4)).collect() if r.source == "a"}
    assert sum(low.values()) < sum(high.values()) and all(low[i] <= high[i] for i in low)


def test_mix_on_odd_and_empty_tables(odd, empty):
    got = mixing.assign(odd).collect()
    assert len(got) == len(ODD) and sum(r.taken for r in got if r.doc_id == 3) == 0
    out = mixing.apply(odd)
    assert out.columns == odd.columns
    by_id = Counter(r.doc_id for r in out.collect())
    for i in {r[0] for r in ODD if words(r[1])}:
        assert by_id[i] == sum(r.taken // r.size for r in got if r.doc_id == i)
    assert mixing.assign(empty).count() == 0 and mixing.apply(empty).count() == 0 and exact_dedup.assign(empty).count() == 0
