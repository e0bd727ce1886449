"""Document fingerprints against plain sets."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomstat.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def hashes(text, width=5):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    runs = [" ".join(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))] if words else []
    return {int(hashlib.md5(r.encode()).hexdigest()[:13], 16) for r in runs}


def likeness(a, b, k):
    low = sorted(a | b)[:k]
    return len([x for x in low if x in sorted(a)[:k] and x in sorted(b)[:k]]) / len(low) if low else 1.0


def expected(rows, k):
    """Rows of distinct ids in ascending order."""
    out = {}
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new = hashes(text), hashes(edited)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(map(str, sorted(own)[:k])), ",".join(map(str, sorted(new)[:k])),
                  pytest.approx(likeness(own, new, k)), pytest.approx(likeness(own, hashes(after), k)))
    return out


def rows_of(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()}


@pytest.mark.parametrize("k", [4, 128])
def test_edits_equal_brute_force(spark, make, k):
    rng = random.Random(3)
    rows = [(n * 7, " ".join(rng.choice(["Sun", "sea", "day", "ÄRA", "\U0001f600", "box"]) for _ in range(rng.randrange(40)))) for n in range(300)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "word " * 5000), (5005, rows[3][1])]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = make([(i, t, None, None) for i, t in shuffled])
    got = rows_of(fp.compare_edits(df, k=k, range_bytes=1000))
    assert got == expected(rows, k)
    assert got[5005][2] == got[rows[3][0]][2]


def test_single_empty_null_and_equal_ids(make, empty):
    assert rows_of(fp.compare_edits(make([(4, "abcd", "en", "a")]))) == expected([(4, "abcd")], fp.K)
    assert fp.compare_edits(empty).count() == 0
    rows = fp.compare_edits(make([(None, "a b", "en", "a"), (1, "c d", "en", "a"), (1, "c d", "en", "a"), (1, None, "en", "a")])).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 1
    again = fp.compare_edits(make([(1, None, "en", "a"), (1, "c d", "en", "a"), (None, "a b", "en", "a"), (1, "c d", "en", "a")])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_odd_rows(odd):
    assert fp.compare_edits(odd).count() == odd.count()


def test_sketches_merge_in_any_order(spark):
    words = [f"w{n}" for n in range(400)]
    parts = [" ".join(words[a : a + 104]) for a in range(0, 400, 100)]  # four words of overlap
    df = spark.createDataFrame([("x", t) for t in parts] + [("y", "")], "part string, text string").withColumn("sketch", fp.sketch(F.col("text"), 32))
    got = {r.part: r.sketch for r in fp.merged(df, ["part"], k=32).collect()}
    assert got == {"x": sorted(hashes(" ".join(words)))[:32], "y": []}
    a, b, c = [r.sketch for r in df.collect()[:3]]
    one = spark.createDataFrame([(a, b, c)], "a array<long>, b array<long>, c array<long>")
    left = fp.merge(fp.merge(F.col("a"), F.col("b"), 32), F.col("c"), 32)
    right = fp.merge(F.col("c"), fp.merge(F.col("b"), F.col("a"), 32), 32)
    x, y = one.select(left, right).first()
    assert x == y and len(x) == 32


def test_estimates(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a"), 1024).alias("a"), fp.sketch(F.col("b"), 1024).alias("b"))
    n, j, inside = df.select(fp.distinct_count(F.col("a"), 1024), fp.resemblance(F.col("a"), F.col("b"), 1024),
                             fp.containment(F.col("a"), F.col("b"), 1024)).first()
    assert abs(n / 3996 - 1) < 0.1 and abs(j - 1 / 3) < 0.06 and abs(inside - 0.5) < 0.08


def test_no_python_and_one_shuffle_of_texts(spark):
    df = fp.compare_edits(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
