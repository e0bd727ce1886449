"""N-gram Jaccard join and its groups (operator 5).

Documents link when the Jaccard similarity of their word-shingle sets reaches a
threshold, exactly (sets are held as 64-bit shingle numbers).

1. Equal sets are one node: copies are never expanded into pairs.
2. Nodes are put into tiles by size band and shingle. Linked sets differ in
   size by less than the threshold's inverse, so a node meets its own band and
   the next; and in any fixed order of shingles, linked sets share one of their
   first few (a share ``1 - threshold`` of the set). The order puts shingles
   that fill heavy hash buckets of the whole corpus last, so passages that many
   documents share rarely make a tile. It decides only the work, not the links.
3. A tile's nodes meet as bitmaps of hashed shingles: set bits of one without
   the other bound the overlap from above. What passes is a candidate.
4. Candidates are verified by intersecting the sorted arrays and linked nodes
   are merged, in rounds, since candidates inside a group change nothing: first
   the pairs that join the tiles of each node's first shingle, then those that
   join the components left in any tile, then, after wider bitmaps, one pair of
   any two components of a tile, and at last every pair still apart.
5. A tile of more than ``LARGE`` members (or a small share of all, see
   ``large_tiles``) is dealt to blocks by node hash, which meet as tiles of their
   own. Where pairs join components, one member in ``SHARED`` of a block's size is in
   every block, so groups join across blocks; afterwards, members outside the tile's main
   group are dealt too, and each of their blocks meets each block of the tile.

Defined results: a null text counts as empty; a set without shingles links with
nothing; a row without id gets its set's size and no group; rows with equal ids
and different texts are judged each by its text (of a group whose smallest id
has several texts, ``one_of_each`` keeps that of the smallest set number, then of
the smallest text hash). Other columns are ignored by
``groups`` and kept by ``one_of_each``, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm import bloom
from loomstat.llm.common import by_step, hot_join, release, steps, stored
from loomstat.llm.components import components
from loomstat.llm.shingles import mixed, shingle_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The shingle sets of a column of texts.
Sets = Callable[[pa.Array], list[np.ndarray]]
#: Hash buckets in which shingles are counted over the whole corpus.
HEAVY_BITS = 20
#: A bucket is heavy in a task from this count on, or from this many times the task's mean.
HEAVY_COUNT, HEAVY_TIMES = 16, 8
#: Bits a shingle where groups are compared with each other.
WIDE = 16
#: Characters cut into shingles at a time.
STEP = 1_000_000
#: First shingles of a node that are tried before all others.
EARLY = 1
#: Members from which a tile is dealt to blocks of that size, and the size divided by the members that all its blocks share.
LARGE, SHARED = 4096, 64
#: Tiles that can be large number this at most, so they are broadcast; hash buckets in which ``tiles`` looks for them.
MAX_LARGE, SPOTS = 1 << 16, 1 << 16
#: Nodes up to which the list of candidates is broadcast to the texts; above, both are shuffled.
MAX_BROADCAST = 2_000_000


def bitmap(numbers: np.ndarray, each: int = 1) -> np.ndarray:
    """Hashed shingles as bits, at least ``each`` bits a shingle. A shingle that
    the other set lacks escapes the bound the less, the more bits there are."""
    bits = 1 << max(6, min(16, (max(1, len(numbers)) * each - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(numbers & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap with fewer bits: positions are hashes modulo a power of two."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def may_link(size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound of the bitmaps leaves room for a link."""
    most = np.minimum(size - np.bitwise_count(bits & ~others).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(others & ~bits).sum(axis=1, dtype=np.int64))
    return linked(most, size, sizes, percent)


def heavy_buckets(texts: DataFrame, width: int) -> np.ndarray:
    """Logarithm of each hash bucket's count over all texts, 0 for ordinary ones: one byte each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << HEAVY_BITS, np.int64)
        for batch in batches:
            for part in steps(batch, "text", STEP):
                sets = shingle_sets(part.column("text"), width)
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - HEAVY_BITS)).astype(np.int64), minlength=len(total))
        heavy = np.flatnonzero(total >= max(HEAVY_COUNT, HEAVY_TIMES * total.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(heavy), pa.array(total[heavy])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2^20
    out = np.zeros(1 << HEAVY_BITS, np.uint8)
    out[rows.column("bucket").to_numpy()] = np.log2(rows.column("n").to_numpy().astype(float)).astype(np.uint8)
    return out


def node_of(numbers: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(numbers.tobytes()))))


def signatures(texts: DataFrame, width: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """``id, hash, n, node, bits, prefix, short`` of every text: its hash, the
    set's size and number, its bitmap, and its first shingles in the common
    order, ``short`` of which suffice against larger sets."""
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        rank, sets = shared.value, shingle_sets(part.column("text"), width)
        prefixes, shorts = [], []
        for s in sets:
            n = len(s)
            long = n - -(-percent * n // 100) + 1 if n else 0
            shorts.append(n - -(-2 * percent * n // (100 + percent)) + 1 if n else 0)
            order = np.argsort(rank[(s >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)], kind="stable")
            prefixes.append(s[order[:long]].view(np.int64))
        ends = np.r_[0, np.cumsum([len(p) for p in prefixes])]
        return pa.RecordBatch.from_arrays([
            part.column("id"), part.column("hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()),
            pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))),
            pa.array(shorts, pa.int32())], ["id", "hash", "n", "node", "bits", "prefix", "short"])

    return texts.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(
        by_step(sign, limit=STEP), "id long, hash long, n long, node long, bits binary, prefix array<long>, short int")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Batches of whole groups from rows sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = batch.column(0).to_numpy()
        if held and key[0] == key[-1] == held[-1].column(0)[-1].as_py():
            held.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if held and cut == 0 and held[-1].column(0)[-1].as_py() != key[0]:
            ready, held = held, [batch]
        else:
            ready, held = [*held, batch.slice(0, cut)], [batch.slice(cut)]
        if sum(b.num_rows for b in ready):
            yield pa.Table.from_batches(ready).combine_chunks()
            release()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tiles(nodes: DataFrame, percent: int, large: int = LARGE) -> DataFrame:
    """``tile, node, own``: the node sets that share a size band and a prefix
    shingle, each set once (``tile`` is the set's number). Tiles of more than
    ``large`` members, found in the fullest hash buckets, are numbered by
    aggregates and held by no task."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")
    posts = nodes.select("node", band.alias("band"), "short", F.posexplode("prefix").alias("pos", "shingle")).select(
        "node", F.explode(F.when(F.col("pos") < F.col("short"), F.array(
            F.struct(F.xxhash64("shingle", "band").alias("tile"), F.lit(True).alias("own")),
            F.struct(F.xxhash64("shingle", F.col("band") + 1).alias("tile"), F.lit(False).alias("own")),
        )).otherwise(F.array(F.struct(F.xxhash64("shingle", "band").alias("tile"), F.lit(True).alias("own"))))).alias("p")
    ).select("p.tile", "node", "p.own")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            key, node, own = (t.column(c).to_numpy() for c in ("tile", "node", "own"))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[first, len(key)])
            met = (sizes > 1) & (np.add.reduceat(own.astype(np.int64), first) > 0)
            number = np.add.reduceat(mixed(node.view(np.uint64) * np.uint64(2) + own.astype(np.uint64)), first).view(np.int64)
            keep = np.repeat(met, sizes)
            for k in range(0, int(keep.sum()), 200_000):
                part = slice(k, k + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(number, sizes)[keep][part]), pa.array(node[keep][part]), pa.array(own[keep][part])], ["tile", "node", "own"])

    def ordinary(some: DataFrame) -> DataFrame:
        return some.repartition("tile").sortWithinPartitions("tile").mapInArrow(shared, "tile long, node long, own boolean")

    spot = F.pmod("tile", F.lit(SPOTS)).cast("int")
    counts = posts.groupBy(spot.alias("spot")).count().toArrow()  # at most SPOTS rows
    filled = counts.column("count").to_numpy()
    limit = large + 2 * int(filled.sum()) // SPOTS
    full = counts.column("spot").to_numpy()[filled > limit]
    if not len(full):
        return ordinary(posts).distinct()
    spots = F.broadcast(nodes.sparkSession.createDataFrame([(int(x),) for x in full], "spot int"))
    sums = stored(
        posts.join(spots, spot == F.col("spot"), "left_semi").groupBy("tile").agg(
            F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node", "own")).alias("number"), F.bool_or("own").alias("met"))
        .where(F.col("rows") > limit), "large-tiles")  # fewer than SPOTS
    dealt = posts.join(F.broadcast(sums.where("met").select("tile", "number")), "tile").select(F.col("number").alias("tile"), "node", "own")
    rest = posts.join(F.broadcast(sums.select("tile")), "tile", "left_anti")
    return ordinary(rest).unionByName(dealt).distinct()


def large_tiles(members: DataFrame, large: int = LARGE) -> DataFrame:
    """``tile, blocks`` of the tiles with more than ``large`` members and more
    than one in ``MAX_LARGE`` of all: they are few enough to be broadcast."""
    limit = max(large, members.count() // MAX_LARGE)
    return stored(members.groupBy("tile").count().where(F.col("count") > limit)
                  .select("tile", F.ceil(F.col("count") / large).cast("int").alias("blocks")), "large-tiles")


def block_of(salt: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")


def spread(members: DataFrame, large: DataFrame, size: int = LARGE) -> DataFrame:
    """Large tiles dealt to blocks, about ``size / SHARED`` members to all of them."""
    placed = members.join(F.broadcast(large), "tile", "left")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # shared by chance, whatever the tile's size
    shared = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks") * size) < max(1, size // SHARED)
    to = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).when(shared, every).otherwise(F.array(block_of(1, F.col("blocks"))))
    return placed.withColumn("block", F.explode(to)).withColumn(
        "tile", F.when(F.col("blocks").isNull(), F.col("tile")).otherwise(F.xxhash64("tile", "block"))).drop("block", "blocks")


def crossed(live: DataFrame, large: DataFrame, size: int = LARGE) -> DataFrame:
    """Adds ``side`` to ``tile, node, own, component``. Large tiles become pairs
    of blocks: members outside the main group (1) against all members (2, or 3 if
    outside the main group); in other tiles all meet each other (0)."""
    placed = live.join(F.broadcast(large), "tile")
    parts = placed.groupBy("tile", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("tile").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")).select(
        "tile", F.col("most.component").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / size).cast("int").alias("others"))
    placed = placed.join(F.broadcast(main), "tile").where("others > 0")
    outside = F.col("component") != F.col("main")
    right = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("j", block_of(3, F.col("blocks")))
    right = right.withColumn("side", F.when(outside, 3).otherwise(2))
    left = placed.where(outside).withColumn("i", block_of(4, F.col("others"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    pairs = left.unionByName(right).select(F.xxhash64("tile", "i", "j").alias("tile"), "node", "own", "component", "side")
    plain = live.join(F.broadcast(large.select("tile")), "tile", "left_anti")
    return plain.select("tile", "node", "own", "component", F.lit(0).alias("side")).unionByName(pairs)


def _spans(n: np.ndarray, own: np.ndarray, comp: np.ndarray, flat: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of a tile's members, in order of their nodes, that join its
    components: breadth first from the smallest node, so that the tiles of one
    group name the same pairs. A component is reached once and comes whole."""
    code, comp = np.unique(comp, return_inverse=True)
    by_comp = np.argsort(comp, kind="stable")
    first = np.searchsorted(comp[by_comp], np.arange(len(code) + 1))
    left, pairs = np.ones(len(n), bool), []
    for i in range(len(n)):
        if not left[i]:
            continue
        reached = by_comp[first[comp[i]] : first[comp[i] + 1]]
        left[reached] = False
        queue = deque(reached.tolist())
        while queue and left.any():
            x = queue.popleft()
            rest = np.flatnonzero(left)
            if not own[x]:
                rest = rest[own[rest]]
            if not len(rest):
                continue
            hit = rest[may_link(n[x], flat[x], n[rest], flat[rest], percent)]
            for c, at in zip(*np.unique(comp[hit], return_index=True)):
                pairs.append((x, int(hit[at])))
                reached = by_comp[first[c] : first[c + 1]]
                left[reached] = False
                queue.extend(reached.tolist())
    return pairs


def candidates(members: DataFrame, percent: int, spanning: bool, once: bool = False) -> DataFrame:
    """``a, b``: pairs of a tile that the bitmaps leave open, one of them from
    the tile's own band; either those that join the tile's ``component``s, or
    all between nodes of different components whose ``side`` lets them meet, of
    those the first for any two components with ``once``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            key, node, own, n, comp, side = (t.column(c).to_numpy() for c in ("tile", "node", "own", "n", "component", "side"))
            bits = [np.frombuffer(x.as_py(), "<u8") for x in t.column("bits")]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found: list[np.ndarray] = []
            for a, b in zip(first.tolist(), np.r_[first[1:], len(key)].tolist()):
                if (comp[a:b] == comp[a]).all():
                    continue
                words = min(len(x) for x in bits[a:b])
                flat = np.stack([folded(x, words) for x in bits[a:b]])
                if spanning:
                    pairs = np.array(_spans(n[a:b], own[a:b], comp[a:b], flat, percent), np.int64).reshape(-1, 2)
                    found.append(node[a + pairs].T)
                    continue
                at, met = np.arange(a, b), {}
                for i in range(b - a):
                    if side[a + i] > 1:
                        break
                    rest = np.arange(i + 1, b - a)  # the sides are in order
                    rest = rest[(comp[at[rest]] != comp[at[i]]) & (own[at[rest]] | own[at[i]]) & (side[at[rest]] != 1)]
                    rest = rest[(side[at[rest]] != 3) | (node[at[rest]] > node[at[i]])]
                    known = met.setdefault(int(comp[at[i]]), set())
                    if known:
                        rest = rest[~np.isin(comp[at[rest]], list(known))]
                    if len(rest):
                        hit = rest[may_link(n[at[i]], flat[i], n[at[rest]], flat[rest], percent)]
                        if once:
                            others, head = np.unique(comp[at[hit]], return_index=True)
                            hit = hit[head]
                            for other in others.tolist():
                                known.add(other)
                                met.setdefault(other, set()).add(int(comp[at[i]]))
                        found.append(np.stack([np.full(len(hit), node[at[i]]), node[at[hit]]]))
            if found:
                pairs = np.concatenate(found, axis=1)
                pairs = np.unique(np.sort(pairs[:, pairs[0] != pairs[1]], axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    ordered = members.select("tile", "node", "own", "n", "component", "side", "bits").repartition("tile").sortWithinPartitions("tile", "side", "node")
    return ordered.mapInArrow(find, "a long, b long").distinct()


def shingle_arrays(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, sets_of: Sets) -> DataFrame:
    """``node, numbers``: the sorted shingles of the nodes ``wanted (node)``,
    made again from their texts, which are found by the id of one row of each node."""
    needed = stored(wanted.join(nodes.select(F.col("node").alias("need"), "min_id"), F.col("node") == F.col("need"))
                    .select("need", F.col("min_id").alias("need_id")), "candidates")
    ids = needed.select("need_id").distinct()
    if needed.count() <= MAX_BROADCAST:
        ids = F.broadcast(ids)

    def arrays(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = sets_of(part.column("text"))
        return pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "numbers"])

    return stored(
        texts.join(ids, F.col("id") == F.col("need_id"), "left_semi").select("text").mapInArrow(by_step(arrays, limit=STEP), "node long, numbers binary")
        .join(needed.select("need"), F.col("node") == F.col("need"), "left_semi").groupBy("node").agg(F.any_value("numbers").alias("numbers")), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of stored candidate pairs, from the sorted shingle arrays."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                yes.append(bool(linked(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], ["a", "b", "linked"])
            release()

    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    # only the arrays that are compared move
    sets = sets.join(F.broadcast(ends) if ends.count() <= MAX_BROADCAST else ends, "node", "left_semi")
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("numbers").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("numbers").alias("y")), "b").select("a", "b", "x", "y")
    )
    return stored(both.mapInArrow(compare, "a long, b long, linked boolean"), "checked")


def wide_bitmaps(sets: DataFrame) -> DataFrame:
    """``node, bits`` with ``WIDE`` bits a shingle, where the bound is nearly exact."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [bitmap(np.frombuffer(x.as_py(), np.uint64), WIDE).tobytes() for x in batch.column("numbers")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.binary())], ["node", "bits"])

    return sets.select("node", "numbers").mapInArrow(widen, "node long, bits binary")


def cluster(nodes: DataFrame, texts: DataFrame, sets_of: Sets, percent: int, size: int = LARGE) -> DataFrame:
    """``node, component`` of the nodes that have a link. ``nodes`` holds
    ``node, min_id, n, bits, prefix, short``: nodes meet where they share a
    prefix number and a size band."""
    met = stored(tiles(nodes, percent, size), "tiles")
    sets = shingle_arrays(met.select("node").distinct(), nodes, texts, sets_of)
    narrow, checked = nodes.select("node", "n", "bits"), None

    def merged(pairs: DataFrame) -> DataFrame:
        """The components once ``pairs`` are verified as well."""
        nonlocal checked
        fresh = pairs if checked is None else pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        found = verified(stored(fresh, "candidates"), sets, percent)
        checked = found if checked is None else checked.unionByName(found)
        return stored(components(checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")

    def apart(tiled: DataFrame, groups: DataFrame) -> DataFrame:
        """Members of the tiles that hold several components."""
        named = stored(tiled.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "live")
        several = named.groupBy("tile").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("tile")
        return named.join(several, "tile").select("tile", "node", "own", "component")

    # near copies mostly share their first shingle: few pairs join most of a group
    early = nodes.withColumns({"prefix": F.slice("prefix", 1, EARLY), "short": F.least("short", F.lit(EARLY))})
    soon = stored(tiles(early, percent, size), "tiles")
    dealt = spread(soon, large_tiles(soon, size), size).join(narrow, "node")
    groups = merged(candidates(dealt.withColumn("component", F.col("node")).withColumn("side", F.lit(0)), percent, True))
    large = large_tiles(met, size)
    once = spread(apart(met, groups), large, size).join(narrow, "node").withColumn("side", F.lit(0))
    spans = stored(candidates(once, percent, True), "candidates")
    # what is left to compare: nodes with a candidate; members of large tiles may have theirs in another block
    ends = spans.select(F.explode(F.array("a", "b")).alias("node")).unionByName(groups.select("node"))
    open_nodes = stored(ends.unionByName(met.join(F.broadcast(large), "tile", "left_semi").select("node")).distinct(), "open-nodes")
    groups = merged(spans)
    wide = stored(wide_bitmaps(sets.join(open_nodes, "node", "left_semi")).join(nodes.select("node", "n"), "node"), "wide-bitmaps")
    left = met.join(open_nodes, "node", "left_semi")
    for once in (True, False):  # a first pair of any two components; then every pair that is still apart
        pairs = stored(candidates(crossed(apart(left, groups), large, size).join(wide, "node"), percent, False, once), "candidates")
        if pairs.limit(1).count():
            groups = merged(pairs)
    return groups


def links(texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows (``id, hash, n, node``), the nodes and the components
    (``node, component``) of those that have a link. ``texts`` holds ``id, text``."""
    signed = stored(signatures(texts, width, percent, heavy_buckets(texts, width)), "signatures")
    nodes = stored(
        signed.where("n > 0 and id is not null").groupBy("node").agg(
            F.min("id").alias("min_id"), F.count("*").alias("rows"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"),
            F.any_value("prefix").alias("prefix"), F.any_value("short").alias("short")), "nodes")
    groups = cluster(nodes, texts, lambda column: shingle_sets(column, width), percent)
    return signed.select("id", "hash", "n", "node"), nodes, groups


def grouped_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``node, rows, component, component_id, keep_node, members``: the group of
    each node, the group's smallest id, the smallest node that has it, and the group's rows."""
    named = nodes.select("node", "min_id", "rows").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min(F.struct("min_id", "node")).alias("least"), F.sum("rows").alias("members"))
    least = least.select("component", F.col("least.min_id").alias("component_id"), F.col("least.node").alias("keep_node"), "members")
    return stored(named.join(least, "component").select("node", "rows", "component", "component_id", "keep_node", "members"), "grouped-nodes")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    signed, nodes, found = links(_texts(df, id_col, text_col), width, percent)
    alone = (F.col("n") == 0) | F.col("id").isNull()
    rows = hot_join(signed.where(~alone), grouped_nodes(nodes, found), "node", "rows", signed.count())
    return (
        rows.select("id", "n", "component_id").unionByName(signed.where(alone).select("id", "n", F.col("id").alias("component_id")))
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each group of linked rows: that of the smallest
    id. A row is known by its id and text. Rows outside any group are not shuffled."""
    signed, nodes, found = links(_texts(df, id_col, text_col), width, percent)
    several = grouped_nodes(nodes, found).where("members > 1")
    rows = hot_join(signed.where("n > 0 and id is not null"), several, "node", "rows", signed.count())
    keeper = (F.col("id") == F.col("component_id")) & (F.col("node") == F.col("keep_node"))
    touched = stored(rows.groupBy("id", "hash").agg(F.min("component").alias("group"), F.bool_or(keeper).alias("stays")), "touched")
    marked = bloom.split(df, F.col(id_col).cast("long"), touched, "id", touched.count(), "__maybe")
    marked = marked.withColumn("__maybe", F.col("__maybe") & F.col(id_col).isNotNull())
    of = touched.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.col("group").alias("__group"), F.col("stays").alias("__stays"))
    judged = marked.where("__maybe").join(of, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left")
    free = judged.where(F.col("__id").isNull()).select(*df.columns)
    # equal in id and shingle set; the smallest text hash is the same one in each run
    stay = judged.where("__stays").groupBy("__group").agg(F.min_by(F.struct(*df.columns), "__hash").alias("__row")).select("__row.*")
    return marked.where(~F.col("__maybe")).select(*df.columns).unionByName(free).unionByName(stay)
