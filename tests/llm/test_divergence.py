"""Source divergence against all terms of all pairs in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomstat.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=5):
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [s for g, s in groups if g == lang]
        total = {s: sum(found[lang, s][t] for t in kept) for s in mine}
        count = {t: sum(found[lang, s][t] for s in mine) for t in kept}
        share = lambda c, n: 1 + (10 ** 9 * (c + 5)) // (n + 5 * len(kept))
        p = {s: {t: share(found[lang, s][t], total[s]) for t in kept} for s in mine}
        q = {t: share(count[t], sum(count.values())) for t in kept}
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            own = [(q[t] - p[s][t], t.encode(), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, rows_, cut in (("pair", pairs, None), ("term", own, top)):
                out |= {(lang, s, part, x[2], -x[0], k + 1) for k, x in enumerate(sorted(rows_)[:cut])}
    return out


def rows_of(df):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = ["sea", "Sun", "DAY", "ÄRA", "ära", "box2go", "x-y", "\U0001f600", "état", "no"]
    rows = []
    for k in range(n):
        source = rng.choice(["a", "a", "b", "c", "é", None, "d"])
        weights = [1 + (ord((source or "z")[0]) * (j + 3)) % 7 for j in range(len(words))]
        text = " ".join(rng.choices(words, weights, k=rng.randrange(12)))
        rows.append((k, rng.choice([text, text, text.upper(), None, ""]), rng.choice(["en", "en", "de", None]), source))
    return [*rows, (1, "12 34", "fr", "a"), (2, "solo", "fr", "b"), (3, None, "it", None), rows[0], rows[0]]


@pytest.mark.parametrize("least", [1, 3, 40, 10 ** 6])
def test_audit_equals_all_pairs(make, least):
    rows = corpus()
    assert rows_of(dv.audit(make(rows), least_docs=least, top_terms=5)) == plain(rows, least)


def test_long_texts_odd_rows_and_empty_table(odd, make, empty):
    assert dv.audit(empty).count() == 0
    assert dv.audit(odd).count() > 0
    rows = [(k, f"word {'long ' * 40_000} tail", "en", "ab"[k % 2]) for k in range(4)]
    assert rows_of(dv.audit(make(rows), least_docs=2, top_terms=5)) == plain(rows, 2)


def test_tree_merges_shared_paths_and_corrects_every_pair():
    rng = np.random.default_rng(0)
    zero = rng.integers(1, 50, 6)
    paths = sorted(tuple((s, int(rng.integers(1, 4) * 40)) for s in range(6) if rng.random() < 0.6) for _ in range(200))
    lengths = np.array([len(x) for x in paths])
    item, p = (np.array([x[k] for path in paths for x in path], np.int64) for k in (0, 1))
    times = rng.integers(1, 9, 200)
    keys, sums = dv.corrections(lengths, item, p, zero[item], times, 6)
    want = Counter()
    for path, m in zip(paths, times.tolist()):
        for k, (b, y) in enumerate(path):
            for a, x in path[:k]:
                want[a * 6 + b] += m * (abs(y - x) - abs(y - zero[a]) - abs(zero[b] - x) + abs(zero[b] - zero[a]))
    assert dict(zip(keys.tolist(), sums.tolist())) == want


def test_shares_are_exact_for_large_totals(spark):
    rows = [(3, 7, 2), (10 ** 12 + 1, 3 * 10 ** 15 + 7, 12345), (0, 5, 1), (7, 7, 1), (1, 1, 0)]
    df = spark.createDataFrame(rows, "n long, total long, terms long").select(dv.share("n", "total", "terms").alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10 ** 9 * (n + 5) // (t + 5 * v) if v else None for n, t, v in rows]
