"""The pipeline's stages, each against plain Python on its own input, and the whole run."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from loomstat.llm.common import stored
from loomstat.llm.encoding import tokenizer_path
from tests.llm.test_similarity import groups_by_hand
from tests.llm.test_text_operators import plain_scores

COLUMNS = ["doc_id", "text", "lang", "source"]


def corpus():
    rng = random.Random(8)
    words = {"en": "the and house garden water tree reading stone river".split(), "de": "und das haus garten wasser baum lesen straße fluss".split(),
             "fr": "et la maison jardin eau arbre lire être rivière".split()}
    rows = []
    for i in range(140):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", str(i)]) for _ in range(rng.randrange(5, 90)))
        rows.append((i, text, lang, rng.choice(["a", "a", "b", "c", None])))
    base = rows[3][1] + " " + rows[6][1] + " " + rows[9][1]
    rows += [(200 + k, base + f" end{k}", "en", "a") for k in range(12)]  # near copies
    rows += [(300 + k, rows[10][1], "de", "b") for k in range(9)]  # exact copies
    rows += [(400, None, "en", "a"), (401, "", None, "b"), (402, "12 34 !!", "en", "c"), (403, "the house " * 3000, "en", "b"),
             (300, rows[10][1], "de", "b"), (7, "und ein anderes haus am fluss", "de", "a"), (404, "中文", None, None)]
    return rows


def bag(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def spelled(rows):
    return Counter(tuple(r[:4]) for r in rows)


def languages(rows):
    names = plain_scores(rows, [r[1] for r in rows])
    return [r for r, (lang, score) in zip(rows, names) if lang != "und" and score >= 0.5]


def copies(rows):
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], r[0]), r[0])
    seen, out = set(), []
    for r in rows:
        if r[0] == last[r[1]] and r[1] not in seen:
            seen.add(r[1])
            out.append(r)
    return out


def mixed(rows):
    size = [len((r[1] or "").split()) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while True:  # what exceeds three times a source is shared again
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= full
    out = Counter()
    key = lambda r: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16)
    for s in names:
        n = math.floor(target[s] / total[s]) if total[s] else 0
        rest, groups = target[s] - n * total[s], defaultdict(list)
        for r, words in zip(rows, size):
            if r[3] == s:
                groups[key(r)].append((r, words))
        at = 0
        for h in sorted(groups):
            words = sum(w for _, w in groups[h])
            more = at + words <= rest or (at <= rest and 2 * (rest - at) > words)
            at += words
            for r, _ in groups[h]:
                out[r] += n + more
    return +out


@pytest.fixture(scope="module")
def steps(make):
    """Input and output of every stage, as run() chains them."""
    docs, out = make(corpus()), []
    for name, stage in cp.STAGES:
        result = stored(stage(docs.sparkSession, docs, ""), f"test-{name}")
        out.append((name, docs, result))
        docs = result
    return out


def test_stages_equal_plain_python(steps):
    rows = corpus()
    for (name, docs, out), expected in zip(steps[:2], (languages, copies)):
        assert out.columns == docs.columns
        rows = expected(rows)
        assert bag(out) == spelled(rows), name
    name, docs, out = steps[2]
    ids = Counter(r[0] for r in rows)
    groups = groups_by_hand([r[:2] for r in rows], 5, 80)
    kept = bag(out)
    assert out.columns == docs.columns and not kept - spelled(rows)
    by = defaultdict(list)
    for r in rows:
        if ids[r[0]] == 1:
            by[groups[r[0]][1]].append(r[0])
    for members in by.values():  # one of each group, that of the smallest id
        assert [i for i in sorted(members) if any(k[0] == i for k in kept)] == [min(members)]
    rows = list(kept.elements())
    assert bag(steps[3][2]) == mixed(rows) and steps[3][2].columns == docs.columns


def test_packing_holds_every_token_once(steps):
    _, docs, packed = steps[4]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.doc_id, n] += 1
    rows, bins, got = packed.collect(), defaultdict(list), Counter()
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
    assert got == Counter({i: sum(n * k for (d, n), k in want.items() if d == i) for i, _ in want})
    for pieces in bins.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 4096
    assert len(bins) <= math.ceil(sum(got.values()) / 4096) + 1


def test_run_is_the_chain_and_reruns_agree(spark, make, steps, tmp_path):
    make(corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    first, again = (Counter(map(key, cp.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert first == again == Counter(map(key, steps[4][2].collect()))


def test_stages_accept_odd_and_empty_tables(odd, empty):
    for name, stage in cp.STAGES:
        for docs in (odd, empty):
            out = stage(docs.sparkSession, docs, "")
            assert out.count() <= 12 * 3 + 5, name
            assert name == "best_fit_packing" or out.columns == docs.columns
