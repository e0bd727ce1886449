import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat.llm import hamming_index, jaccard_join, substring_dedup
from loomstat.llm.components import components
from tests.llm.conftest import ODD


def groups_by_hand(rows, width, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
        parent[i] = i

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    inverse = defaultdict(list)
    for i, s in sets.items():
        for j, common in Counter(j for g in s for j in inverse[g]).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for g in s:
            inverse[g].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(n=400):
    """Random texts, chains of edits, groups of near copies, shared passages, short texts."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    boiler = list(rng.choice(words, 30))
    rows = []
    base = list(rng.choice(words, 120))
    for i in range(n):
        kind = i % 5
        if kind == 0:
            t = list(rng.choice(words, int(rng.integers(1, 200)))) + boiler * (i % 2)
        elif kind == 1:  # a large group of near copies
            t = base.copy()
            t[int(rng.integers(120))] = "edit"
        elif kind == 2:  # a chain whose ends don't link
            t = list(np.r_[base[:100], [f"c{k}" for k in range(i, i + 60)]])
        elif kind == 3:
            t = boiler + list(rng.choice(words, int(rng.integers(0, 6))))
        else:
            t = list(rng.choice(words[:3], int(rng.integers(0, 5))))
        rows.append((i, " ".join(map(str, t)), "en", "a"))
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(make, width, percent):
    rows = near_copies()
    want = groups_by_hand([r[:2] for r in rows], width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(make(rows), width=width, percent=percent).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) * 0.8
    kept = jaccard_join.one_of_each(make(rows), width=width, percent=percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_bound_never_loses_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)])
        if len(b):
            x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
            w = min(len(x), len(y))
            x, y = jaccard_join.folded(x, w), jaccard_join.folded(y, w)
            true = jaccard_join.linked(np.array(len(np.intersect1d(a, b))), len(a), len(b), 85)
            assert not true or jaccard_join.may_link(len(a), x, np.array([len(b)]), y[None, :], 85)[0]


def test_groups_of_odd_tables(odd, empty):
    got = jaccard_join.groups(odd).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.component_id) for r in got} == {
        (1, 1), (2, 1), (3, 3), (4, 4), (None, None), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9)}
    out = jaccard_join.one_of_each(odd)
    assert out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 4, None, 5, 6, 7, 8, 9])
    assert jaccard_join.groups(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0


def test_one_of_each_judges_every_text_of_an_id(make):
    near, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [
        (5, near, "en", "a"), (7, near + " end", "en", "a"),  # near copies
        (7, other, "en", "b"),  # the same number in another source: stands alone
        (5, third, "en", "b"), (9, third + " end", "en", "a"),  # a second group of the same smallest id
        (11, "few words", "en", "a"), (9, "", "en", "b"),
    ]
    kept = jaccard_join.one_of_each(make(rows)).collect()
    gone = {(7, near + " end"), (9, third + " end")}
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((r[0], r[1]) for r in rows if (r[0], r[1]) not in gone)
    assert {r.source for r in kept if r.text == other} == {"b"}


def test_one_of_each_keeps_one_of_equal_ids_in_a_group(make):
    near = " ".join(f"a{i}" for i in range(60))
    rows = [(5, near, "en", "a"), (5, near + " end", "en", "b"), (5, near, "en", "a"), (5, near + "  ", "en", "a")]
    kept = [jaccard_join.one_of_each(make(r)).collect() for r in (rows, rows[::-1])]
    assert len(kept[0]) == len(kept[1]) == 1 and kept[0][0].text == kept[1][0].text


def test_large_tiles_are_dealt_and_give_the_same_links(make, monkeypatch):
    """Near copies with distinct texts, three groups and single ones in the same
    tiles: no task holds a tile, and the groups stay those of the brute force."""
    rows = []
    for i in range(90):
        words = [f"w{k}" for k in range(60)]
        words[20:24] = [f"f{i % 3}_{k}" for k in range(4)]
        if i % 10 == 0:
            words[40:44] = [f"x{i}_{k}" for k in range(4)]
        rows.append((i, " ".join(words) + f" end{i}", "en", "a"))
    seen = []
    find = jaccard_join.candidates
    monkeypatch.setattr(jaccard_join, "candidates", lambda m, *a: (seen.append(m.groupBy("tile").count().agg(F.max("count")).first()[0]), find(m, *a))[1])
    texts = jaccard_join._texts(make(rows), "doc_id", "text")
    signed, nodes, _ = jaccard_join.links(texts, 4, 85)
    found = jaccard_join.cluster(nodes, texts, lambda c: jaccard_join.shingle_sets(c, 4), 85, size=10)
    ids = {r.node: r.min_id for r in nodes.collect()}
    got = defaultdict(set)
    for r in found.collect():
        got[r.component].add(ids[r.node])
    want = defaultdict(set)
    for r, (_, c) in groups_by_hand([r[:2] for r in rows], 4, 85).items():
        want[c].add(r)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    assert len(want) == 12 and max(x or 0 for x in seen[:4]) > 60 > max(x or 0 for x in seen[4:])  # four rounds with large tiles, four with dealt ones


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(5, i) for i in range(200, 260)]
    df = spark.createDataFrame([*path, *star, (7, 7), (300, 301), (301, 300)], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 5 for i in range(200, 260)) and got[301] == 300 and 7 not in got


def test_passages_and_lines(make):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"x{rng.integers(10**9)}" for _ in range(n)]
    passage, line = fresh(60), fresh(110)
    rows = []
    for i in range(60):
        t = [fresh(80), fresh(80)]
        if i % 10 == 1:
            t[0] = t[0][:30] + [w.upper() if k == 0 else w for k, w in enumerate(passage)] + t[0][30:]
        if i % 10 == 2:
            near = line.copy()
            near[i] = "changed"
            t.append(near)
        if i % 10 == 3:
            t.append("licensed under the same words as others".split())
        rows.append((i, "\n".join(" ".join(x) for x in t), "en", "a"))
    got = substring_dedup.repeats(make(rows)).collect()
    assert {r.doc_id for r in got} == {i for i in range(60) if i % 10 in (1, 2)}
    assert {r.kind for r in got if r.doc_id % 10 == 1} == {"passage"} and {r.kind for r in got if r.doc_id % 10 == 2} >= {"line"}
    assert all(30 <= r.first_word and r.last_word <= 90 for r in got if r.doc_id % 10 == 1)
    assert {r.doc_id for r in got if not r.removed} >= {1, 2}
    out = {r.doc_id: r.text for r in substring_dedup.remove(make(rows)).collect()}
    assert out[1] == rows[1][1] and out[0] == rows[0][1] and len(out[11].split()) <= 160 + 60 - 16 and set(rows[11][1].split()[:30]) <= set(out[11].split())


def test_pieces_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 500, 40)) for _ in range(200)]

    def pieces(order):
        owner, first, sizes, key = substring_dedup.pieces_of(pa.array([texts[i] for i in order]))
        return sorted((order[o], f, n, k) for o, f, n, k in zip(owner.tolist(), first.tolist(), sizes.tolist(), key.tolist()))

    want = pieces(list(range(200)))
    assert pieces(list(range(200))[::-1]) == want
    assert sorted(p for i in range(200) for p in [(i, *q[1:]) for q in pieces([i])]) == want


def test_passages_of_odd_tables(odd, empty):
    got = substring_dedup.repeats(odd)
    assert {r.doc_id for r in got.collect()} <= {1, 2} and substring_dedup.remove(odd).count() == len(ODD)
    assert substring_dedup.repeats(empty).count() == 0 and substring_dedup.remove(empty).count() == 0


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = hamming_index.search(df, F.col("vec_id") % 20 == 0, shard=700, block=60).toPandas()
    x, hit = x.astype(float), 0
    for i in range(0, 3000, 20):
        score = x @ x[i]
        order = [j for j in np.lexsort((np.arange(3000), -score)) if j != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert len(mine) == 20 and mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, score[mine.vec_id], rtol=1e-12) and (np.diff(mine.score) <= 0).all()
        hit += len(set(order) & set(mine.vec_id))
    assert hit / (150 * 20) >= 0.9


def test_index_returns_every_code_in_the_radius():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    index = hamming_index.Index(codes)
    for r in (0, 3, 10, 21, 26, 64):
        for q in codes[:10]:
            assert index.within(q, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= r).tolist()


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, id long, v string"
    bad = [(0, [1.0, 0.0], 1), (20, [0.0, 0.0], 1), (40, None, 1), (60, [float("nan"), 1.0], 1), (80, [None, 1.0], 1), (100, [1.0], 1), (1, [1.0, 0.0], 1),
           (2, [1.0, 0.0], 1), (3, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (5, [0.5, 0.5], None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in bad], schema)
    got = hamming_index.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 5, 0.5)]
    assert hamming_index.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_texts_of_one_id_lose_only_their_own_words(make):
    shared, other = " ".join(f"s{k}" for k in range(60)), " ".join(f"o{k}" for k in range(80))
    out = {(r.doc_id, r.text) for r in substring_dedup.remove(make([(1, shared, "en", "a"), (7, shared, "en", "a"), (7, other, "en", "b")])).collect()}
    assert (1, shared) in out and (7, other) in out and (7, shared) not in out


def test_vectors_of_one_id_are_searched_alike_in_any_order(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in [0, 0, *range(1, 60)]]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        got.append(sorted(tuple(r) for r in hamming_index.search(df, F.col("vec_id") == 0, k=5).collect()))
    assert got[0] == got[1] and len(got[0]) == 5
