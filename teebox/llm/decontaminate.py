"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased runs of letters and digits, hashed to 2^15 features with idf weights
from the word counts of all documents.  A randomised SVD of TF-IDF passages is
computed in Spark: tasks add up ``Y = A^T (A R)`` for a random test matrix R over the passages of
every document and of the benchmark, and the driver takes the latent basis from that small
matrix (features x rank).  Every document is then searched.

Every document is cut into overlapping windows of a few lengths.  A window whose latent
vector has a cosine of at least ``COSINE`` with a benchmark passage of like length is a
candidate.  A candidate is confirmed on the words themselves: the longest common subsequence
of the item and the text around the window must hold ``LCS`` of the item's words, and the
answer check must pass: ``ANSWER`` of the item's rarest words (its answer column's words, if
the benchmark has one) must occur there.

Benchmark items are taken in blocks of at most ``BLOCK`` items, so what is broadcast is bounded.

Defined results: null or empty texts and items match nothing; a document that holds an item
several times gives one row; a null id gives a row with a null id; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch
from teebox.llm.blocks import row_key
from teebox.llm.text import slices, word_bounds, word_hashes

FEATURE_BITS = 15
RANK = 32
FIT_WINDOW = 32
WINDOWS = (16, 24, 32, 48, 64)  # lengths in words
COSINE = 0.4
LCS = 0.6
ANSWER = 0.5
ANSWER_WORDS = 6
BLOCK = 20_000
PARTS = 16
RUN = 32  # rows added up in one step

_PLAIN = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _PLAIN[_b] = 0x20


def _lower(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _words(column: pa.Array, max_bytes: int):
    """(first row, last row, word hashes, word offsets per document) pieces."""
    for lo, hi, buf, offs in slices(_lower(column), max_bytes):
        plain = _PLAIN[buf]
        s, e, first = word_bounds(plain, offs)
        yield lo, hi, word_hashes(plain, s, e), first


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


# --- statistics and basis -----------------------------------------------------------------


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sum of float blocks by part, added up in Spark; PARTS rows reach the driver."""

    @scratch.tidy
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part] = sums.get(part, 0) + np.frombuffer(data, "<f8")
        if sums:
            yield _blocks(sums)

    found: dict[int, np.ndarray] = {}
    for r in rows.repartition(PARTS, "part").mapInArrow(add, "part int, data binary").collect():
        found[r["part"]] = found.get(r["part"], 0) + np.frombuffer(r["data"], "<f8")
    return found


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([np.ascontiguousarray(x, "<f8").tobytes() for x in sums.values()], pa.binary())], names=["part", "data"])


def idf_weights(docs: DataFrame) -> np.ndarray:
    """Weight of each feature from its count over all documents (inverse collection frequency)."""
    size = 1 << FEATURE_BITS

    @scratch.tidy
    def count(batches):
        total = np.zeros(size)
        for batch in batches:
            for _, _, h, _ in _words(batch.column(0), 4 << 20):
                total += np.bincount(_feature(h), minlength=size)
        yield _blocks({0: total})

    total = _summed(docs.select("text").mapInArrow(count, "part int, data binary")).get(0, np.zeros(size))
    return np.maximum(np.log((0.003 * total.sum() + 1) / (total + 1)), 0.05).astype(np.float32)


def _window_sums(x: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of windows of ``size`` words, a third apart; the last ends with its document."""
    n = first[-1]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n) - first[doc]
    start = np.flatnonzero(at % max(1, size // 3) == 0)
    doc = doc[start]
    end = np.minimum(start + size, first[doc + 1])
    start = np.maximum(first[doc], end - size)
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[keep], end[keep], doc[keep]


def _segment_sums(values: np.ndarray, pick: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[pick]`` over segments that begin at ``start`` (the first at 0, none empty).

    Segments are cut into runs of at most ``RUN`` rows; all runs' k-th rows are added at once, the longest runs first.
    """
    length = np.diff(start, append=len(pick))
    runs = -(-length // RUN)
    first = np.cumsum(runs) - runs
    at = np.repeat(start - first * RUN, runs) + RUN * np.arange(runs.sum())
    left = np.minimum(np.repeat(start + length, runs) - at, RUN)
    order = np.argsort(-left, kind="stable")
    at, left = at[order], left[order]
    sums = np.take(values, pick[at], axis=0)
    for k in range(1, int(left[0])):
        n = np.count_nonzero(left > k)
        sums[:n] += np.take(values, pick[at[:n] + k], axis=0)
    back = np.empty_like(sums)
    back[order] = sums
    return back if len(back) == len(start) else np.add.reduceat(back, first, axis=0)


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Features x rank basis of the TF-IDF matrix A of the texts' passages, already scaled by idf.

    Passages are runs of ``FIT_WINDOW`` words, the last of a text what is left.  One pass over the texts adds up
    ``Y = A^T A R``; with ``R^T Y`` it holds what the leading eigenvectors of ``A^T A`` are taken from (Nystroem).
    """
    size, wide = 1 << FEATURE_BITS, rank + 8
    test = np.random.default_rng(17).standard_normal((size, wide)).astype(np.float32)

    @scratch.tidy
    def sketch(batches):
        y = np.zeros((size, wide))
        weighted = test * idf[:, None]
        for batch in batches:
            for _, _, h, first in _words(batch.column(0), 1 << 20):
                f = _feature(h)
                if not len(f):
                    continue
                words = np.diff(first)
                start = np.flatnonzero((np.arange(len(f)) - np.repeat(first[:-1], words)) % FIT_WINDOW == 0)
                z = _segment_sums(weighted, f, start)
                norm = np.add.reduceat(idf[f].astype(np.float64) ** 2, start)
                z /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)  # rows of unit length, on both sides
                order = np.argsort(f.astype(np.uint16), kind="stable")
                passage = np.repeat(np.arange(len(start)), np.diff(start, append=len(f)))[order]
                f = f[order]
                cut = np.flatnonzero(np.diff(f, prepend=-1))
                y[f[cut]] += _segment_sums(z, passage, cut) * idf[f[cut], None]
        yield _blocks({p: x for p, x in enumerate(np.split(y, PARTS))})

    parts = _summed(passages.mapInArrow(sketch, "part int, data binary"))
    basis = np.zeros((size, rank), np.float32)
    if not parts:
        return basis
    y = np.concatenate([parts[p].reshape(-1, wide) for p in range(PARTS)])
    core = test.T.astype(np.float64) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    held = value > max(value[-1], 0) * 1e-9
    if held.any():
        u, _, _ = np.linalg.svd(y @ (vector[:, held] / np.sqrt(value[held])), full_matrices=False)
        basis[:, : min(rank, u.shape[1])] = u[:, :rank] * idf[:, None]
    return basis


# --- items --------------------------------------------------------------------------------


@dataclass
class Items:
    ids: list[int]
    words: list[list[int]]  # word hashes in order
    answers: list[set[int]]
    pieces: dict[int, tuple[np.ndarray, np.ndarray]]  # window length -> (unit latent vectors, item number)
    answer_words: np.ndarray
    answer_items: np.ndarray
    answers_needed: np.ndarray
    reach: np.ndarray  # words looked at on either side of a window

    @classmethod
    def build(cls, rows, basis: np.ndarray, idf: np.ndarray) -> Items:
        ids, words, answers, pieces = [], [], [], {w: ([], []) for w in WINDOWS}
        column = pa.array([r["text"] for r in rows], pa.large_string())
        asked = pa.array([r["answer"] for r in rows], pa.large_string())
        found = [(h[a:b], lo) for lo, _, h, first in _words(column, 1 << 30) for a, b in zip(first[:-1], first[1:])]
        given = [h[a:b] for _, _, h, first in _words(asked, 1 << 30) for a, b in zip(first[:-1], first[1:])]
        for r, (h, _), answer in zip(rows, found, given):
            if not len(h):
                continue
            f = _feature(h)
            distinct = list(dict.fromkeys(h.tolist()))
            weight = dict(zip(h.tolist(), idf[f].tolist()))
            key = set(answer.tolist()) or set(sorted(distinct, key=lambda x: (-weight[x], x))[:ANSWER_WORDS])
            number = len(ids)
            ids.append(r["item_id"])
            words.append(h.tolist())
            answers.append(key)
            size = next((w for w in WINDOWS if w >= len(h)), WINDOWS[-1])
            for lo in range(0, max(1, len(h) - size // 2), size // 2):
                v = basis[f[lo : lo + size]].sum(axis=0, dtype=np.float64)
                if (norm := np.linalg.norm(v)) > 0:
                    pieces[size][0].append(v / norm)
                    pieces[size][1].append(number)
        flat = sorted({(w, n) for n, key in enumerate(answers) for w in key})
        return cls(
            ids,
            words,
            answers,
            {w: (np.array(v, np.float32), np.array(n)) for w, (v, n) in pieces.items() if v},
            np.array([w for w, _ in flat], np.uint64),
            np.array([n for _, n in flat], np.int64),
            np.array([np.ceil(ANSWER * len(key)) for key in answers], np.int64),
            np.array([len(w) for w in words], np.int64),
        )

    def answer_places(self, h: np.ndarray) -> np.ndarray:
        """Sorted item << 32 | position of every occurrence of an item's answer word."""
        names, first, n = np.unique(self.answer_words, return_index=True, return_counts=True)
        if not len(names):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        place = np.flatnonzero(names[at] == h)
        at = at[place]
        reps = n[at]
        row = np.repeat(first[at] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        out = self.answer_items[row] << np.int64(32) | np.repeat(place, reps)
        out.sort()
        return out


def lcs_length(item: list[int], text: list[int]) -> int:
    """Longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _confirm(items: Items, number: int, text: np.ndarray) -> tuple[float, bool]:
    words = items.words[number]
    near = text.tolist()
    share = lcs_length(words, near) / len(words)
    key = items.answers[number]
    return share, len(key & set(near)) >= ANSWER * len(key)


def _search(docs: DataFrame, items: Items, basis: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, basis))

    @scratch.tidy
    def run(batches):
        it, v = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, h, first in _words(batch.column(1), 1 << 20):
                if not len(h):
                    continue
                places = it.answer_places(h)
                c = np.zeros((len(h) + 1, v.shape[1]), np.float32)
                np.take(v, _feature(h), axis=0, out=c[1:], mode="clip")
                np.cumsum(c, axis=0, out=c)
                best: dict[tuple[int, int], list] = {}
                for size, (vectors, numbers) in it.pieces.items():
                    start, end, doc = _window_sums(h, first, size)
                    for cut in range(0, len(start), 1 << 14):
                        s, e, d = start[cut : cut + (1 << 14)], end[cut : cut + (1 << 14)], doc[cut : cut + (1 << 14)]
                        x = np.take(c, e, axis=0) - np.take(c, s, axis=0)
                        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
                        cosine = x @ vectors.T
                        w, p = np.divmod(np.flatnonzero(cosine >= COSINE), len(numbers))
                        number, score = numbers[p], cosine[w, p]
                        # the answer check on counts first: no pair that passes it in full can fail here
                        lo_at, hi_at = np.maximum(s[w] - it.reach[number], first[d[w]]), np.minimum(e[w] + it.reach[number], first[d[w] + 1])
                        n = np.searchsorted(places, number << 32 | hi_at) - np.searchsorted(places, number << 32 | lo_at)
                        keep = np.flatnonzero(n >= it.answers_needed[number])
                        for i in keep:
                            best.setdefault((int(d[w[i]]), int(number[i])), []).append((int(s[w[i]]), int(e[w[i]]), float(score[i])))
                rows = []
                for (d, number), near in best.items():
                    hit = _check(it, number, near, h, int(first[d]), int(first[d + 1]))
                    if hit:
                        rows.append((ids[lo + d], it.ids[number], *hit))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "lcs"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, cosine double, lcs double")


def _check(items: Items, number: int, near: list, h: np.ndarray, lo: int, hi: int):
    """Best confirmed candidate of one document and item: (cosine, LCS share)."""
    size = len(items.words[number])
    found = None
    for s, e, cosine in near:
        reach = size if size > e - s else size // 2
        share, answered = _confirm(items, number, h[max(lo, s - reach) : min(hi, e + reach)])
        if share >= LCS and answered and (found is None or (share, cosine) > found[::-1]):
            found = (cosine, share)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs): documents that hold a benchmark item, best evidence per pair."""
    return _contaminated(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark)


def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminated`` of (doc_id, text) rows, whatever the type of the id."""
    scratch.ready(docs)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"), answer.alias("answer")).filter("text IS NOT NULL")
    idf = idf_weights(docs)
    basis = latent_basis(docs.select("text").unionByName(items.select("text")), idf)
    out = None
    blocks = max(1, -(-items.count() // BLOCK))
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        part = _search(docs, Items.build(block.collect(), basis, idf), basis)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; each row is judged on its own text, whatever its id."""
    key = row_key(docs[id_col], docs[text_col])
    drop = _contaminated(docs.select(key.alias("doc_id"), docs[text_col].alias("text")), benchmark).select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, key == drop["_drop"], "left_anti")
