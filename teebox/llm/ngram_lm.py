"""N-gram LM scoring with a log-frequency Bloom filter.

Tokens are lower-cased (A-Z) words and one end token per text.  Training documents give
token counts and bigram counts; both travel as packed parcels, pre-added per few million tokens.

* Bigrams go into a log-frequency Bloom filter of ``ENTRY_BITS`` per entry: a bigram seen
  c times is entered with levels 1 to 1 + floor(log2 c), and none is left out.  The filter is cut
  into one segment per bucket of the hash, built where the bucket's counts meet and kept in a table.
* A bigram's count is read back by probing level after level until one is missing (a level that
  was not entered is taken for entered about 16 times in 10,000), and is
  bounded by the counts of both its tokens.  The probability backs off smoothly:
  ``(c(v w) + MU * p(w)) / (c(v) + MU)`` with ``p(w) = (c(w) + 1) / (N + V + 1)``.
* Token counts are exact at any size.  Blocks of documents ask the buckets for the counts of
  their distinct tokens and bigrams (see ``blocks``); neither the vocabulary nor the filter is
  broadcast, and there are more buckets the more text there is (``BUCKET_BYTES``), so what a task holds is bounded.

Defined results: null and empty texts have one token (the end); a null id is a training row;
no training rows: N = 0 and every probability is 1; rows that repeat an id are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teebox.llm import blocks, scratch
from teebox.llm.text import LOWER, mix64, slices, word_bounds, word_hashes

ENTRY_BITS = 24  # filter bits per bigram and level
PROBES = 3
BUCKET_BYTES = 1 << 24  # text per bucket
MU = 400.0
CHUNK = 2_000_000  # tokens added up before parcels leave a task
END = np.uint64(0xA0761D6478BD642F)
_LOW40 = np.uint64((1 << 40) - 1)
_STEP = 0xE7037ED1A0B428DB


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by END, and each text's offsets in them."""
    found, first, n = [], [np.zeros(1, np.int64)], 0
    for _, _, buf, offs in slices(column):
        low = LOWER[buf]
        s, e, f = word_bounds(low, offs)
        h = word_hashes(low, s, e)
        docs = len(f) - 1
        out = np.full(len(h) + docs, END)
        out[np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(f))] = h
        found.append(out)
        first.append(f[1:] + np.arange(1, docs + 1) + n)
        n += len(out)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(first)


def bigrams(tok: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; END comes before a text's first token."""
    before = np.empty_like(tok)
    before[:1], before[1:] = END, tok[:-1]
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + tok)


_PARCEL = pa.schema([("kind", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())])
_PARCEL_SQL = "kind long, bucket long, hashes binary, high binary, counts binary"


def _count(texts: DataFrame, buckets: int) -> DataFrame:
    """Parcels of token counts (kind 1) and bigram counts (kind 2)."""

    def run(batches):
        waiting, n = [], 0

        def parcels():
            tok = np.concatenate(waiting)
            rows = []
            names, c = np.unique(tok, return_counts=True)
            rows += [(1, b, h, b"", x) for b, _, h, x in blocks.parcels(0, buckets, names, c.astype("<u4"))]
            names, c = np.unique(bigrams(tok), return_counts=True)
            for b, _, h, x in blocks.parcels(0, buckets, names, c.astype("<u4")):
                h = np.frombuffer(h, "<u8")
                rows.append((2, b, h.astype("<u4").tobytes(), (h >> np.uint64(32)).astype("u1").tobytes(), x))
            return [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), _PARCEL.types)], schema=_PARCEL) for i in range(0, len(rows), 64)]

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                tok, _ = tokens(batch.column(0).slice(lo, 512))
                if len(tok):
                    waiting.append(tok)
                    n += len(tok)
                if n >= CHUNK:
                    yield from parcels()
                    waiting, n = [], 0
        if waiting:
            yield from parcels()

    return texts.mapInArrow(run, _PARCEL_SQL)


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return names, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def _positions(low40: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    x = mix64(low40 + np.uint64(level * _STEP & 0xFFFFFFFFFFFFFFFF))
    a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    return [(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)]


def _levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def segment(low40: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Filter segment of a bucket's bigrams."""
    levels = _levels(counts)
    out = np.zeros(bits, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(low40[levels >= level], level, bits):
            out[at] = 1
    return np.packbits(out)


class Filter:
    """The whole filter: one row of bits per bucket."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.buckets, self.bits = rows, rows.shape[0], rows.shape[1] * 8

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Lower edge of each bigram's quantised count (0: never entered), by repeated probes."""
        flat, out = self.rows.reshape(-1), np.zeros(len(h), np.int64)
        base = blocks.bucket_of(h, self.buckets).astype(np.uint64) * np.uint64(self.bits)
        low40, todo = h & _LOW40, np.arange(len(h))
        for level in range(1, 64):
            if not len(todo):
                break
            hit = np.ones(len(todo), bool)
            for at in _positions(low40[todo], level, self.bits):
                at += base[todo]
                hit &= (flat[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            todo = todo[hit]
            out[todo] = 1 << (level - 1)
        return out


def bucket_count(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(scratch.partitions(texts.sparkSession), -(-size // BUCKET_BYTES))


def fit(texts: DataFrame, buckets: int) -> tuple[DataFrame, int, int]:
    """Token counts (kind 1) and filter segments (kind 2) by bucket, a written table; N and V."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        counts = blocks.unpacked(table["counts"], "<u4")
        if kind == 1:
            names, c = _added(blocks.unpacked(table["hashes"]), counts)
            row = (1, bucket, names.tobytes(), c.astype("<i8").tobytes(), int(c.sum()), len(names))
        else:
            low = [a.astype(np.uint64) | b.astype(np.uint64) << np.uint64(32) for a, b in zip(blocks.unpacked(table["hashes"], "<u4"), blocks.unpacked(table["high"], "u1"))]
            names, c = _added(low, counts)
            bits = -(-int(_levels(c).sum()) * ENTRY_BITS // 8) * 8
            row = (2, bucket, segment(names, c, bits).tobytes(), b"", 0, 0)
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["kind", "bucket", "data", "counts", "n", "v"])

    merged = scratch.written(_count(texts, buckets).groupBy("kind", "bucket").applyInArrow(merge, "kind long, bucket long, data binary, counts binary, n long, v long"), "counts")
    n, v = merged.filter("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return merged.select("kind", "bucket", "data", "counts"), n, v


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    scratch.ready(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = bucket_count(docs)
    table_, n_train, v_train = fit(docs.filter(~held_out(F.col("doc_id"))).select("text"), buckets)
    dealt = blocks.blocked(docs.withColumn("held_out", held_out(F.col("doc_id"))))
    ask = pa.schema([("bucket", pa.int64()), ("blk", pa.int64()), ("hashes", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
    reply = pa.schema([("blk", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("levels", pa.binary())])

    def distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blk, tok = key[0].as_py(), tokens(table["text"])[0]
        rows = {b: (b, blk, h, b"", b"") for b, _, h in blocks.parcels(blk, buckets, np.unique(tok))}
        for b, _, h in blocks.parcels(blk, buckets, np.unique(bigrams(tok))):
            h = np.frombuffer(h, "<u8")
            rows[b] = (*rows.get(b, (b, blk, b""))[:3], h.astype("<u4").tobytes(), (h >> np.uint64(32)).astype("u1").tobytes())
        return blocks.as_table(list(rows.values()), ask)

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        """Counts of the tokens and levels of the bigrams, in the order asked."""
        if not asked.num_rows or not known.num_rows:
            return blocks.as_table([], reply)
        names, counts, part = np.zeros(1, np.uint64), np.zeros(1, np.int64), None
        for kind, data, n in zip(known["kind"].to_pylist(), blocks.unpacked(known["data"], "u1"), blocks.unpacked(known["counts"], "<i8")):
            if kind == 1:
                names, counts = data.view("<u8"), n
            else:
                part = Filter(data[None, :])
        rows = []
        for blk, h, low, high in zip(asked["blk"].to_pylist(), blocks.unpacked(asked["hashes"]), blocks.unpacked(asked["low"], "<u4"), blocks.unpacked(asked["high"], "u1")):
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            n = np.where(names[at] == h, counts[at], 0)
            seen = part.counts(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)) if part else np.zeros(len(low), np.int64)
            levels = np.where(seen > 0, _levels(np.maximum(seen, 1)), 0)
            rows.append((blk, key[0].as_py(), n.astype("<i8").tobytes(), levels.astype("u1").tobytes()))
        return blocks.as_table(rows, reply)

    def told(hashes: np.ndarray, known: pa.Table, column: str, dtype: str) -> np.ndarray:
        """What the buckets answered for each of the block's sorted distinct hashes; 0 without an answer."""
        out, which = np.zeros(len(hashes), np.int64), blocks.bucket_of(hashes, buckets)
        for bucket, found in zip(known["bucket"].to_pylist(), blocks.unpacked(known[column], dtype)):
            lo = np.searchsorted(which, bucket)
            out[lo : lo + len(found)] = found
        return out

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        tok, first = tokens(table["text"])
        names, inverse = np.unique(tok, return_inverse=True)
        counts = told(names, known, "counts", "<i8")
        c, end = counts[inverse], counts[names == END].sum()
        before = np.concatenate([[end], c[:-1]])
        p = (c + 1) / (n_train + v_train + 1)
        asked, inverse = np.unique(bigrams(tok), return_inverse=True)
        level = told(asked, known, "levels", "u1")
        pair = np.minimum(np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)[inverse], np.minimum(c, before))
        model = (pair + mu * p) / (before + mu)
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]  # noqa: E731  every text has a token
        return pa.table(
            [
                table["doc_id"],
                table["held_out"],
                pa.array(np.diff(first)),
                pa.array(add((c > 0).astype(np.int64))),
                pa.array(np.full(len(first) - 1, n_train)),
                pa.array(add(np.log10(p))),
                pa.array(add(np.log10(model))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    asked = dealt.groupBy("blk").applyInArrow(distinct, "bucket long, blk long, hashes binary, low binary, high binary")
    answers = asked.groupBy("bucket").cogroup(table_.groupBy("bucket")).applyInArrow(answer, "blk long, bucket long, counts binary, levels binary")
    return dealt.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
