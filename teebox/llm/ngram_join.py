"""N-gram Jaccard self-join with count vectors and an R-tree.

A document's set holds its distinct five-word shingles (A-Z lower-cased; fewer words: the
whole sequence; no words: empty and linked with nothing).  Two documents link when
``100 * |A n B| >= 75 * |A u B|``.  The join is exact up to 64-bit shingle hashes:

1. Equal sets fold into one class per 128-bit set digest, so copies cost one row each.
2. A count sketch of fixed size (2^22 slots, summed over all documents) gives every shingle
   a rarity level relative to the mean slot.  Shingles are ordered by (level, hash); two sets that link must share one
   of the first ``n - ceil(0.75 n) + 1`` shingles of that order, so these are the keys that
   bring documents together.  The order only affects speed, never which pairs meet.
3. Keys held by one class fall away, and keys that the same documents hold count as one key
   (near copies share many), whose weight is their number.  Every class is first checked against
   the centre it shares most keys with (a key's centre is its holder with most shared keys); verified
   links are joined into components.
4. Keys that still hold two or more components get an R-tree: shingles are hashed into 256
   groups, a set's group counts are a point, and the overlap of two subtrees (or points) is
   at most the sum of the coordinate-wise minima of their upper corners.  Subtrees whose
   bound misses ``3/7 (|A| + |B|)`` are cut; surviving pairs of different components are
   verified on their whole sets and joined.  Subtrees of one component are cut too, so pairs inside
   a component are never listed.  The rows of a hot key are split into blocks of bounded size, and
   the tasks take pairs of blocks.  Keys of one family go to the same tasks, as far as these stay
   bounded, so that a pair is sent once and not once per key.

Defined results: null and empty texts have no set and are their own component; a row
without an id is a component only with rows of the same set and is never verified against
others; rows that share an id are one document; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch
from teebox.llm.blocks import row_key
from teebox.llm.graph import components
from teebox.llm.text import mix64, shingle_sets, slices

WORDS = 5
PERCENT = 75
SKETCH_BITS = 22
SKETCH_PARTS = 16
GROUPS = 256
FANOUT = 16
BLOOM_BITS = 25  # fixed-size filter of the ids whose whole sets are wanted
FULL = 255  # a group count that stands for any larger one
UNIT_BYTES = 1 << 26  # bytes of sets verified together, each pair's two sets counted
BLOCK = 1 << 12  # pairs of tree nodes looked at together
GROUP_ROWS = 1 << 12  # rows of a key that are searched in one group
TASK_ROWS = 1 << 17  # rows a search task holds, on average at most
DEAL_ROWS = 1 << 14  # rows of a family that are dealt to a task together
FOUND = 1 << 14  # pairs that wait in a task to be sent
SENT = 1 << 20  # pairs a task remembers to have sent, at most; the others may be sent again
PAIRS = "a long, b long, n long"
_LEVEL_SHIFT = np.uint64(60)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


# --- rarity -------------------------------------------------------------------------------


def rarity(docs: DataFrame, words: int) -> np.ndarray:
    """Level 0 to 15 of each sketch slot: quarter powers of two above the mean slot.

    A task reports at most 255 per slot (levels only order the shingles).
    """
    size = 1 << SKETCH_BITS

    @scratch.tidy
    def count(batches):
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for _, _, buf, offs in slices(batch.column(0)):
                sets = list(shingle_sets(buf, offs, words))
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        parts = np.split(np.minimum(total, 255).astype(np.uint8), SKETCH_PARTS)
        yield pa.record_batch([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    @scratch.tidy
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.uint8).astype(np.uint32)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.astype("<u4").tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = docs.mapInArrow(count, schema).repartition(SKETCH_PARTS, "part").mapInArrow(add, schema).collect()
    # part by part: whole arrays of doubles are many times what the levels take
    mean = sum(int(np.frombuffer(r["counts"], "<u4").sum(dtype=np.int64)) for r in rows) / size + 1
    levels = np.zeros((SKETCH_PARTS, size // SKETCH_PARTS), np.uint8)
    for r in rows:
        counts = np.frombuffer(r["counts"], "<u4")
        levels[r["part"]] = np.clip(np.ceil(4 * np.log2(np.maximum(counts / mean, 0.5))), 0, 15)
    return levels.reshape(-1)


# --- sets and keys ------------------------------------------------------------------------


def _fingerprints(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, n, set digest, count vector and prefix keys of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    @scratch.tidy
    def run(batches):
        level = shared.value
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                n, keys, d1, d2, vectors = [], [], [], [], []
                for s in shingle_sets(buf, offs, words):
                    n.append(len(s))
                    vectors.append(np.minimum(np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8).tobytes())
                    d1.append(int(np.bitwise_xor.reduce(mix64(s * np.uint64(3)))) if len(s) else 0)
                    d2.append(int(np.add.reduce(mix64(s + np.uint64(7)))) if len(s) else 0)
                    if len(s):
                        rank = (s >> np.uint64(4)) | (level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << _LEVEL_SHIFT)
                        rank.sort()
                        keys.append(rank[: prefix_size(len(s), percent)].view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(d1, np.uint64).view(np.int64)),
                        pa.array(np.array(d2, np.uint64).view(np.int64)),
                        pa.array(vectors, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys))),
                    ],
                    names=["doc_id", "n", "d1", "d2", "vector", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, vector binary, keys array<long>")


def _sorted_groups(batches) -> tuple[list[np.ndarray], np.ndarray] | None:
    """A partition's columns sorted by the first two, and where its groups begin; a group is alike in both."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return None
    cols = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((cols[1], cols[0]))
    cols = [c[order] for c in cols]
    return cols, np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))


def _held_keys(keys: DataFrame) -> DataFrame:
    """(key, doc_id): rows of keys that two or more documents hold; rows are dealt out by key once, for the count and the join."""
    dealt = keys.repartition("key")
    held = dealt.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    return dealt.join(held.select("key").hint("merge"), "key").select("key", "doc_id")


def _shared_keys(keys: DataFrame) -> DataFrame:
    """(key, doc_id, pivot, weight): rows of keys that two or more documents hold; pivot is the key's smallest id.

    Keys with the same holders meet the same pairs, so only the smallest of them is kept, with their
    number as weight.  Holders are told apart by their smallest and largest id, their number and the sums
    of two halves of a 64-bit hash, which add up however often an id occurs.
    """
    raw = scratch.written(_held_keys(keys), "raw-hits")
    h = F.xxhash64("doc_id")
    holders = raw.groupBy("key").agg(
        F.min("doc_id").alias("pivot"),
        F.max("doc_id").alias("last"),
        F.count(F.lit(1)).alias("c"),
        F.sum(F.shiftright(h, 32)).alias("high"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
    )
    kept = holders.filter("pivot < last").groupBy("pivot", "last", "c", "high", "low").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    hits = scratch.written(raw.join(kept.select("key", "pivot", "weight"), "key").select("key", "doc_id", "pivot", "weight"), "hits")
    scratch.remove(raw)
    return hits


def _with_centres(hits: DataFrame) -> DataFrame:
    """``hits`` (key, doc_id, pivot, weight) with another pivot: of the key's holders the one with most shared keys, then the smallest id.

    Of a text and its edited copies that is the text itself, as an edit makes shingles that nobody else holds:
    copies link with it where they may not link with each other.
    """
    rank = hits.groupBy("doc_id").agg(F.sum("weight").alias("shared"))
    centres = hits.join(rank, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("shared", F.bitwise_not("doc_id"))).alias("centre"))
    return hits.join(centres, "key").select("key", "doc_id", F.col("centre").alias("pivot"), "weight")


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(64 - BLOOM_BITS)).astype(np.int64), (h & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter (2^25 bits, two probes) of the ids, put together in Spark."""

    @scratch.tidy
    def fill(batches):
        seen = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False)):
                seen[at] = True
        parts = np.split(np.packbits(seen), SKETCH_PARTS)
        yield pa.record_batch([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "bits"])

    @scratch.tidy
    def union(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(*(c.to_pylist() for c in batch.columns)):
                parts[part] = parts.get(part, 0) | np.frombuffer(bits, np.uint8)
        if parts:
            yield pa.record_batch([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    out = np.zeros((SKETCH_PARTS, (1 << BLOOM_BITS) // 8 // SKETCH_PARTS), np.uint8)
    for r in ids.mapInArrow(fill, schema).repartition(SKETCH_PARTS, "part").mapInArrow(union, schema).collect():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _sets(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): whole sorted sets of the documents in ``pairs``, and of a few others.

    The Bloom filter keeps other texts from being read into sets; a false hit only adds a row.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(ids))

    @scratch.tidy
    def run(batches):
        bits = shared.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            wanted = np.ones(batch.num_rows, bool)
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False)):
                wanted &= (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            batch = batch.filter(pa.array(wanted))
            for lo, hi, buf, offs in slices(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in shingle_sets(buf, offs, words)], pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) of ``pairs`` (a, b, n: both sets' size) whose whole sets link, but for those that only close a circle.

    ``pairs`` is a written table, which is deleted: nothing needs it after.

    Pairs that hang together are verified together, so a set travels once per unit and not once
    per pair; a family whose pairs hold more than UNIT_BYTES is split by pair into units of about
    that size, so one document's pairs are split too.
    """
    labels = components(pairs)
    family = pairs.join(labels.select(F.col("node").alias("a"), "label"), "a")
    size = family.groupBy("label").agg(F.ceil(F.sum("n") * 8 / F.lit(UNIT_BYTES)).alias("units"))
    family = family.join(size, "label").select(F.xxhash64("label", F.pmod(F.xxhash64("a", "b"), "units")).alias("unit"), "a", "b")
    family = scratch.written(family, "units")
    sets = scratch.written(_sets(docs, pairs, words), "sets")
    wanted = family.select(F.col("unit").alias("at"), F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(sets, "doc_id").select("at", "doc_id", "shingles")

    def run(key: tuple[pa.Scalar, ...], todo: pa.Table, known: pa.Table) -> pa.Table:
        have: dict[int, list[np.ndarray]] = {}
        for part in known.to_batches():  # views, no copies
            column = part.column(2).cast(pa.large_binary())
            offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            for doc, lo, hi in zip(part.column(1).to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                have.setdefault(doc, []).append(np.frombuffer(column.buffers()[2], np.uint64, (hi - lo) // 8, lo))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for a, b in sorted(zip(todo["a"].to_pylist(), todo["b"].to_pylist())):
            u, v = find(a), find(b)
            if u != v and any(_links_exactly(x, y, percent) for x in have.get(a, ()) for y in have.get(b, ())):
                root[max(u, v)] = min(u, v)
                out.append((a, b))
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = scratch.written(family.groupBy("unit").cogroup(wanted.groupBy("at")).applyInArrow(run, "a long, b long"), "links")
    for table in (family, sets, pairs):
        scratch.remove(table)
    return links


def _links_exactly(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _points(vectors) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.uint8) for v in vectors])


def _bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of points row by row; a FULL minimum counts as beyond any size."""
    low = np.minimum(x, y)
    return low.sum(axis=1, dtype=np.int64) + ((low == FULL).sum(axis=1, dtype=np.int64) << 24)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n) that the summed coordinate minima do not exclude; n is both sets' size."""
    one = points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
    two = points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))

    @scratch.tidy
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                bound = _bound(_points(part.column(4).to_pylist()), _points(part.column(5).to_pylist()))
                size = part.column(2).to_numpy() + part.column(3).to_numpy()
                keep = pa.array((100 + percent) * bound >= percent * size)
                yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(size).filter(keep)], names=["a", "b", "n"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, PAIRS)


# --- R-tree -------------------------------------------------------------------------------


class CountTree:
    """Packed R-tree over count vectors; a node keeps its upper corner and its smallest and largest size.

    ``marks`` are further columns of the points (component, side), of which a node keeps the range:
    points that are alike in one of them are no pair.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, *marks: np.ndarray):
        self.order = self._pack(vectors, sizes)
        upper, least, most = vectors[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(upper, least, most)]
        spans = [(m[self.order], m[self.order]) for m in marks]
        self.spans = [spans]
        while len(upper) > 1:
            cut = np.arange(0, len(upper), FANOUT)
            upper, least, most = np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((upper, least, most))
            spans = [(np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)) for low, high in spans]
            self.spans.append(spans)

    @staticmethod
    def _pack(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: strips of like size, in a strip by the coordinates that vary most."""
        order = np.argsort(sizes, kind="stable")
        strip = max(FANOUT, int(len(order) ** 0.5) // FANOUT * FANOUT)
        for lo in range(0, len(order), strip):
            part = order[lo : lo + strip]
            v = vectors[part].astype(np.int64)
            top = np.argsort(v.var(axis=0))[-3:]
            order[lo : lo + strip] = part[np.lexsort(v[:, top].T)]
        return order

    def pairs(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of point numbers (i, j) that the bounds cannot exclude, in blocks."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > BLOCK:
                for part in range(0, len(i), BLOCK):
                    todo.append((level, i[part : part + BLOCK], j[part : part + BLOCK]))
                continue
            upper, least, most = self.levels[level]
            keep = (100 * most[i] >= percent * least[j]) & (100 * most[j] >= percent * least[i])
            for low, high in self.spans[level]:
                keep &= (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
            i, j = i[keep], j[keep]
            bound = _bound(upper[i], upper[j])
            keep = (100 + percent) * bound >= percent * (least[i] + least[j])
            i, j = i[keep], j[keep]
            if level == 0:
                if len(i):
                    yield self.order[i], self.order[j]
                continue
            below = len(self.levels[level - 1][1])
            x = (i[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            y = (j[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            x, y = np.broadcast_arrays(x, y)
            keep = (x < y if level == 1 else x <= y) & (x < below) & (y < below)
            if keep.any():
                todo.append((level - 1, x[keep], y[keep]))


def _open_keys(hits: DataFrame) -> DataFrame:
    """Rows (key, doc_id, pivot, label) of keys whose documents lie in two or more components."""
    mixed = hits.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return hits.join(mixed.select("key"), "key", "left_semi").select("key", "doc_id", "pivot", "label")


def _grouped(rows: DataFrame) -> DataFrame:
    """(grp, deal, side, doc_id, label): the rows of every key in groups whose pairs of unlike side are to be looked at.

    A key of at most GROUP_ROWS rows is a group in which every row is a side.  The rows of a larger key
    fall into blocks of about GROUP_ROWS rows: a component above that size into blocks of its own, the
    others into mixed ones.  Groups are then the mixed blocks, and two blocks, each a side, unless
    both belong to one component.  Groups of one deal are searched by one task: keys with the same
    pivot, in shares of about DEAL_ROWS rows; a group of a large key is a deal of its own.
    """
    own = F.col("c") > GROUP_ROWS
    plan = (
        rows.groupBy("key", "label")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("key")
        .agg(F.sum("c").alias("size"), F.sum(F.when(own, 0).otherwise(F.col("c"))).alias("rest"), F.collect_list(F.when(own, F.struct("label", "c"))).alias("own"))
        .filter(F.col("size") > GROUP_ROWS)
        .withColumn("rest", F.ceil(F.col("rest") / F.lit(GROUP_ROWS)))
        .withColumn("own", F.expr(f"transform(own, o -> struct(o.label AS label, ceil(o.c / {GROUP_ROWS}) AS n))"))
        .withColumn("own", F.expr("map_from_entries(own)"))
        .withColumn(
            "blocks",
            F.expr(
                "concat(flatten(transform(map_entries(own), o -> transform(sequence(1L, o.value), k -> struct(o.key AS label, k AS k)))),"
                " if(rest > 0, transform(sequence(1L, rest), k -> struct(CAST(NULL AS long) AS label, k AS k)), array()))"
            ),
        )
    )
    shares = rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(DEAL_ROWS)).alias("shares"))
    return (
        rows.join(plan, "key", "left")
        .join(shares, "pivot")
        .withColumn("n_own", F.expr("own[label]"))
        .withColumn("mine", F.expr("struct(if(n_own IS NULL, NULL, label) AS label, 1 + pmod(xxhash64(doc_id, key), coalesce(n_own, rest)) AS k)"))
        .withColumn("other", F.explode(F.expr("if(size IS NULL, array(NULL), filter(blocks, b -> b.label IS NULL OR mine.label IS NULL OR b.label <> mine.label))")))
        .select(
            F.expr("if(size IS NULL, key, xxhash64(key, least(mine, other), greatest(mine, other)))").alias("grp"),
            F.expr("if(size IS NULL, xxhash64(pivot, pmod(xxhash64(key), shares)), xxhash64(key, least(mine, other), greatest(mine, other)))").alias("deal"),
            F.expr("if(size IS NULL OR mine <=> other, doc_id, xxhash64(mine))").alias("side"),
            "doc_id",
            "label",
        )
    )


def _tree_pairs(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n) of different components that some group's tree lets through; n is both sets' size."""

    @scratch.tidy
    def run(batches):
        got = _sorted_groups(batches)
        if got is None:
            return
        (deal, group, doc, side, label, n, vector), first = got
        size = np.diff(np.append(first, len(group)))
        sent: set[tuple[int, int]] = set()
        fresh: list[tuple[int, int, int]] = []

        def add(x: np.ndarray, y: np.ndarray) -> None:
            for pair in zip(np.minimum(doc[x], doc[y]).tolist(), np.maximum(doc[x], doc[y]).tolist(), (n[x] + n[y]).tolist()):
                if pair[:2] not in sent:
                    sent.add(pair[:2])
                    fresh.append(pair)

        def ready():
            if len(fresh) >= FOUND:
                yield _pairs(fresh)
                fresh.clear()
                if len(sent) >= SENT:
                    sent.clear()

        # a group that fits one leaf is a tree of one node: all such groups' pairs at once
        for g in range(2, FANOUT + 1):
            at = first[size == g]
            i, j = np.triu_indices(g, 1)
            step = max(1, BLOCK // len(i))
            for lo in range(0, len(at), step):
                x, y = (at[lo : lo + step, None] + i).ravel(), (at[lo : lo + step, None] + j).ravel()
                keep = (label[x] != label[y]) & (side[x] != side[y]) & (100 * n[x] >= percent * n[y]) & (100 * n[y] >= percent * n[x])
                x, y = x[keep], y[keep]
                if len(x):
                    bound = _bound(_points(vector[x]), _points(vector[y]))
                    keep = (100 + percent) * bound >= percent * (n[x] + n[y])
                    add(x[keep], y[keep])
                yield from ready()
        for lo, hi in zip(first[size > FANOUT], (first + size)[size > FANOUT]):
            tree = CountTree(_points(vector[lo:hi]), n[lo:hi], label[lo:hi], side[lo:hi])
            for i, j in tree.pairs(percent):
                add(i + lo, j + lo)
                yield from ready()
        if fresh:
            yield _pairs(fresh)

    rows = scratch.written(_grouped(rows), "groups")
    parts = max(scratch.partitions(rows.sparkSession), -(-rows.count() // TASK_ROWS))
    dealt = rows.join(points, "doc_id").select("deal", "grp", "doc_id", "side", "label", "n", "vector").repartition(parts, "deal")
    pairs = scratch.written(dealt.mapInArrow(run, PAIRS).distinct(), "pairs")
    scratch.remove(rows)
    return pairs


def _pairs(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b", "n"])


# --- the join -----------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    scratch.ready(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    levels = rarity(docs.select("text"), words)
    prints = scratch.written(_fingerprints(docs, levels, words, percent), "prints")
    classes = prints.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("head"))
    heads = classes.filter("head IS NOT NULL")
    keys = (
        prints.filter("n > 0")
        .join(heads.select("d1", "d2", F.col("head").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
        .select(F.explode("keys").alias("key"), "doc_id")
    )
    shared = _shared_keys(keys)
    hits = scratch.written(_with_centres(shared), "centred")
    scratch.remove(shared)
    edges = _links(docs, hits, prints.select("doc_id", "n", "vector"), words, percent)
    labels = components(edges)
    return (
        prints.select("doc_id", "n", "d1", "d2")
        .join(classes, ["d1", "d2"], "left")
        .join(labels.withColumnRenamed("node", "head"), "head", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "head", "doc_id")).alias("component_id"))
    )


def _links(docs: DataFrame, hits: DataFrame, points: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified edges (a, b) whose components are those of all links; ``hits`` is deleted when nothing needs it any more."""
    star = (
        hits.filter("doc_id <> pivot")
        .groupBy("doc_id", "pivot")
        .agg(F.sum("weight").alias("shared"))
        .groupBy("doc_id")
        .agg(F.max_by("pivot", "shared").alias("pivot"))
        .select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    )
    first = _verified(docs, scratch.written(_bounded(star, points, percent), "pairs"), words, percent)
    labels = components(first)
    marked = hits.join(labels, hits["doc_id"] == labels["node"], "left").select("key", "doc_id", "pivot", F.coalesce("label", "doc_id").alias("label"))
    rows = scratch.written(_open_keys(marked), "open")
    pairs = _tree_pairs(rows, points, percent)
    scratch.remove(rows)
    scratch.remove(hits)
    second = _verified(docs, pairs, words, percent)
    return first.unionByName(second)


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; an unknown id comes last.

    Rows are joined by a number made from id and text, so rows without an id and rows that share
    one are verified on their own texts; rows equal in both are one document, of which the greatest
    row as JSON stays.
    """
    key = F.xxhash64(row_key(docs[id_col], docs[text_col]))
    keyed = docs.select(key.alias("_key"), docs[id_col].cast("long").alias("_id"), docs[text_col].alias("text"))
    found = near_duplicates(keyed, "_key", "text").select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct()
    groups = found.filter("_key <> _group").select("_group").distinct()
    members = scratch.written(found.join(groups, "_group", "left_semi").join(keyed.select("_key", "_id").distinct(), "_key"), "members")
    order = F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    kept = members.groupBy("_group").agg(F.min(order)["key"].alias("_kept"))
    drop = members.join(kept, "_group").filter("_key <> _kept").select(F.col("_key").alias("_drop")).distinct()
    twice = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("_key").alias("_twice"))
    twice = scratch.written(twice, "twice")
    left = docs.join(drop, key == drop["_drop"], "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = left.join(twice, key == twice["_twice"], "left_semi")
    folded = again.groupBy(F.xxhash64(row_key(F.col(id_col), F.col(text_col))).alias("_key")).agg(F.max_by(whole, F.to_json(whole)).alias("_row"))
    return left.join(twice, key == twice["_twice"], "left_anti").unionByName(folded.select("_row.*"))
