"""Substring dedup: remove every word covered by a run of ``LENGTH`` words that occurs elsewhere.

A run counts wherever it starts a second time, same document included, judged on the input.
The whole corpus is its own reference.  Three passes over blocks of documents:

1. Anchors: in every window of ``LENGTH`` words the smallest hash of its ``GRAM``-word runs.
   Equal windows have equal anchors, so only windows whose anchor occurs twice can repeat.
2. Windows with a repeated anchor ask whether their own hash occurs twice.
3. Words covered by repeated windows are removed; the others are joined by one space.

Each pass asks through packed parcels (see ``blocks``), so a passage shared by any number of
documents costs one entry per block.  Hashes have 64 bits.

``SuffixAutomaton`` and ``remove_reference`` are the broadcast form for a bounded reference:
shards of the reference become suffix automata, documents stream past them, and maximal spans
whose matching statistics reach the threshold go.  README says why the query over the whole
corpus doesn't use it.

Defined results: null, empty and shorter texts keep all their words; rows that repeat an id are
documents of their own; a null id stays null; other columns are never read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import blocks, scratch
from teebox.llm.text import mix64, slices, windows, word_bounds, word_hashes

LENGTH = 35
GRAM = 8
BUCKET_BYTES = 16 << 20  # bytes of text that one bucket of hashes stands for
SHARD_WORDS = 100_000


def block_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block's texts and each document's offsets in them."""
    found, first, n = [], [np.zeros(1, np.int64)], 0
    for _, _, buf, offs in slices(column):
        s, e, f = word_bounds(buf, offs)
        found.append(word_hashes(buf, s, e))
        first.append(f[1:] + n)
        n += len(s)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(first)


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over every ``size`` consecutive values."""
    step, part = 1, x
    while 2 * step <= size:
        part = op(part[:-step], part[step:])
        step *= 2
    return op(part[: len(x) - size + 1], part[size - step : len(x) - step + 1])


def _starts(first: np.ndarray, length: int) -> np.ndarray:
    """Which words start a window of ``length`` words inside their document."""
    n = int(first[-1])
    out = np.ones(n, bool)
    for j in range(len(first) - 1):
        out[max(first[j], first[j + 1] - length + 1) : first[j + 1]] = False
    return out


def window_anchors(h: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the smallest run hash in each, and the hashes at all places that are a window's smallest."""
    inside = _starts(first, length)
    start = np.flatnonzero(inside)
    if not len(start):
        return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    run, span = windows(h, gram), length - gram + 1
    low = np.zeros(len(h), np.uint64)
    low[start] = _sliding(run, span, np.minimum)[start]
    seen = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), low]), span, np.maximum)[: len(run)]
    return start, low[start], run[(seen == run) & (seen > 0)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row."""
    scratch.ready(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a bucket answers for the hashes of so much text, however many partitions there are
    buckets = -(-(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1) // BUCKET_BYTES)
    dealt = blocks.blocked(texts)

    def ask_anchors(key, table):
        h, first = block_words(table["text"])
        # anchors are small hashes: mixed, they spread over all buckets
        return blocks.ask_repeated(key[0].as_py(), buckets, mix64(window_anchors(h, first, length, gram)[2]))

    def ask_windows(key, table, known):
        h, first = block_words(table["text"])
        start, low, _ = window_anchors(h, first, length, gram)
        start = start[blocks.among(mix64(low), blocks.replies(known))]
        return blocks.ask_repeated(key[0].as_py(), buckets, windows(h, length)[start] if len(start) else np.zeros(0, np.uint64))

    def remove(key, table, known):
        h, first = block_words(table["text"])
        names = blocks.replies(known)
        covered = np.zeros(len(h) + 1, np.int64)
        if len(names):
            start = np.flatnonzero(_starts(first, length))
            start = start[blocks.among(windows(h, length)[start], names)]
            np.add.at(covered, start, 1)
            np.subtract.at(covered, start + length, 1)
        keep = np.cumsum(covered[:-1]) == 0
        removed, texts = [], []
        for text, a, b in zip(table["text"].to_pylist(), first[:-1], first[1:]):
            words = (text or "").encode("utf-8").split()
            left = keep[a:b]
            removed.append(int(b - a - left.sum()))
            texts.append(b" ".join(compress(words, left.tolist()) if removed[-1] else words).decode("utf-8"))
        return pa.table([table["doc_id"], pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    ask = "bucket long, blk long, hashes binary, again binary"
    texts = dealt.groupBy("blk")
    anchors = blocks.repeated(texts.applyInArrow(_keyed(ask_anchors), ask))
    spans = blocks.repeated(texts.cogroup(anchors.groupBy("blk")).applyInArrow(_cokeyed(ask_windows), ask))
    return texts.cogroup(spans.groupBy("blk")).applyInArrow(_cokeyed(remove), "doc_id long, n_words long, n_removed long, kept string")


def _keyed(f):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return f(key, table)

    return run


def _cokeyed(f):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, other: pa.Table) -> pa.Table:
        return f(key, table, other)

    return run


# --- bounded reference: suffix automata ------------------------------------------------------


class SuffixAutomaton:
    """Suffix automaton of word sequences; ``None`` parts the sequences and never matches."""

    def __init__(self, sequences: list[list]):
        self.next, self.link, self.size = [{}], [-1], [0]
        last = 0
        for sequence in sequences:
            for w in [*sequence, None]:
                last = 0 if w is None else self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def statistics(self, words: list) -> list[int]:
        """Length of the longest reference string that ends at each word."""
        state, length, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            out.append(length)
        return out


def covered_words(statistics: list[int], length: int) -> list[bool]:
    """Words inside a match of at least ``length`` words."""
    out, reach = [False] * len(statistics), len(statistics)
    for i in range(len(statistics) - 1, -1, -1):
        if statistics[i] >= length:
            reach = min(reach, i - statistics[i] + 1)
        out[i] = reach <= i
    return out


def remove_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Remove what ``docs`` share with a bounded ``reference`` (id_col, text_col): doc_id, n_words, n_removed, kept.

    Documents are streamed once per shard of about ``shard_words`` reference words, so the
    broadcast is bounded and the work is shards x documents.
    """
    spark = scratch.ready(docs)
    size = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"))
    n = max(1, -(-int(reference.agg(F.sum(size)).first()[0] or 0) // shard_words))
    spans = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = spans.withColumn("covered", F.lit(None).cast("binary"))
    for k in range(n):
        rows = reference.filter(F.pmod(F.xxhash64(text_col), F.lit(n)) == k).select(text_col).collect()
        shard = spark.sparkContext.broadcast(SuffixAutomaton([(r[0] or "").encode("utf-8").split() for r in rows]))

        def run(batches, shard=shard):
            for batch in batches:
                out = []
                for text, old in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    new = np.array(covered_words(shard.value.statistics((text or "").encode("utf-8").split()), length), np.uint8)
                    out.append((new if old is None else new | np.frombuffer(old, np.uint8)).tobytes())
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "text", "covered"])

        spans = spans.mapInArrow(run, "doc_id long, text string, covered binary")

    def cut(batches):
        for batch in batches:
            n_words, removed, texts = [], [], []
            for text, covered in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode("utf-8").split()
                n_words.append(len(words))
                removed.append(sum(covered))
                texts.append(b" ".join(w for w, c in zip(words, covered) if not c).decode("utf-8"))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return spans.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
