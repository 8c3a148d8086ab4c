"""Ranked lexical search, term at a time with a limited set of accumulators.

1. Index: one pass over the documents writes blocks of postings (term, document, frequency) of the
   terms that the items ask for, and every block's number of documents and terms.
2. The blocks' sums give N, L and each term's document frequency, so its weight.
3. Search: every block is searched for every item, term at a time, rarest term first.  A posting of
   a document without an accumulator makes one as long as the largest contributions that the
   item's remaining terms have in the block, added up, can still reach the kth best score so far:
   of the block's accumulators, which are partial, or of the blocks that the task has finished.
   From then on no accumulator is made; those there are get every later term's exact contribution.
   A document without one cannot reach the kth place, not even by a tie.
4. A task sends on each item's k best; a window keeps the k best of all.

Items are searched in blocks of bounded size (ITEMS items, ITEM_BYTES of text on average), each
with its own index; only such a block's terms are broadcast.  All scores are 64-bit integers.

Defined results: terms are runs of ASCII letters and digits and of all other characters beyond
ASCII, A-Z lower-cased; null and empty texts have none and are never found, and an item without
terms, or whose terms no document holds, gives no row.  Documents that share an id are ranked each
by itself; one without an id comes last among equal scores.  Items equal in id and text are one
item; with the same id and different texts they are ranked apart.  Texts of any length are read
whole, in pieces.  Empty tables give no rows; other columns of any name are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teebox.llm import scratch

TOP = 20
ITEMS, ITEM_BYTES = 1000, 1 << 22  # of one block of items
DOCS, POSTINGS = 8192, 1 << 21  # of one block of the index, at most (one document more)
PIECE = 1 << 20  # bytes of a text split at once

#: Bytes of terms stay, A-Z lower-cased; all others become a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "n_docs long, n_terms long, ids array<long>, lengths binary, terms binary, ends binary, docs binary, tf binary"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + PIECE)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of the index over ``docs`` (doc_id, text), for the terms of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @scratch.tidy
    def run(batches):
        number = known.value.get
        n_docs = n_terms = 0
        ids, lengths, found, tf, at = [], [], [], [], []

        def block():
            t = np.array(found, np.int32)
            order = np.argsort(t, kind="stable")
            t = t[order]
            last = np.flatnonzero(np.append(t[1:] != t[:-1], True)) if len(t) else np.zeros(0, np.int64)
            packed = [np.array(lengths, "<i8"), t[last], (last + 1).astype("<i8"), np.array(at, "<i4")[order], np.array(tf, "<i8")[order]]
            return pa.record_batch(
                [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in packed)],
                names=["n_docs", "n_terms", "ids", "lengths", "terms", "ends", "docs", "tf"],
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, seen = 0, Counter()
                    for piece in terms(text):
                        n += len(piece)
                        seen.update(map(number, piece))
                    n_docs += n > 0
                    n_terms += n
                    seen.pop(None, None)
                    if not seen:
                        continue
                    at.extend([len(ids)] * len(seen))
                    found.extend(seen)
                    tf.extend(seen.values())
                    ids.append(doc_id)
                    lengths.append(n)
                    if len(ids) >= DOCS or len(at) >= POSTINGS:
                        yield block()
                        n_docs = n_terms = 0
                        ids, lengths, found, tf, at = [], [], [], [], []
        if n_docs:
            yield block()

    return docs.mapInArrow(run, INDEX)


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the vocabulary's terms."""

    @scratch.tidy
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for t, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df[np.frombuffer(t, "<i4")] += np.diff(np.frombuffer(e, "<i8"), prepend=0)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms", "ends").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], "<i8")
        norm = 100 - 25 + 25 * lengths * n // total
        self.docs, tf = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tf"], "<i8")
        self.part = 1_000_000_000 * tf // (1000 * tf + 12 * norm[self.docs])
        ends = np.frombuffer(row["ends"], "<i8")
        starts = np.concatenate([[0], ends[:-1]])
        largest = np.maximum.reduceat(self.part, starts) if len(ends) else ends
        self.lists = {t: x for t, *x in zip(np.frombuffer(row["terms"], "<i4").tolist(), starts.tolist(), ends.tolist(), largest.tolist())}

    def search(self, asked: list[tuple[int, int]], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the block's documents that may be among the ``top`` best.

        ``asked`` holds (term, weight x repeats), rarest first; ``least`` is a score that ``top``
        documents have reached elsewhere, or 0.
        """
        lists = [(w, *self.lists[t]) for t, w in asked if t in self.lists]
        rest = np.cumsum([0] + [w * largest for w, _, _, largest in reversed(lists)])[::-1].tolist()
        score = np.zeros(len(self.ids), np.int64)
        alive = None
        for (w, a, b, _), remaining in zip(lists, rest):
            if alive is None and (remaining < least or remaining < self._kth(score, top, remaining)):
                alive = score > 0
            docs, part = self.docs[a:b], self.part[a:b]
            if alive is not None:
                keep = alive[docs]
                docs, part = docs[keep], part[keep]
            score[docs] += w * part  # a document is in a term's list once
        found = np.flatnonzero(score >= max(1, least, self._kth(score, top, 0)))
        return found, score[found]

    @staticmethod
    def _kth(score: np.ndarray, top: int, above: int) -> int:
        """The kth best score; 0 if there are not so many, or if none is above ``above``."""
        if len(score) < top or score.max() <= above:
            return 0
        return int(np.partition(score, len(score) - top)[len(score) - top])


def best(found: list[tuple[int, int | None]], top: int) -> list[tuple[int, int | None]]:
    """The first of (score, doc_id), highest score first, then smallest id, no id last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]


def searched(index: DataFrame, asked: list[list[tuple[int, int]]], n: int, total: int, top: int) -> DataFrame:
    """item (its number), doc_id and score: each task's ``top`` best of every item."""
    plan = index.sparkSession.sparkContext.broadcast(asked)

    @scratch.tidy
    def run(batches):
        kept: list[list] = [[] for _ in plan.value]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, n, total)
                for item, wanted in enumerate(plan.value):
                    have = kept[item]
                    docs, scores = block.search(wanted, top, have[-1][0] if len(have) == top else 0)
                    if len(docs):
                        kept[item] = best(have + [(s, block.ids[d]) for d, s in zip(docs.tolist(), scores.tolist())], top)
        rows = [(i, d, s) for i, have in enumerate(kept) for s, d in have]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "ends", "docs", "tf").mapInArrow(run, "item int, doc_id long, score long")


def _search_block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame | None:
    """item_id, rank, doc_id, score for one block of items (item_id, text)."""
    wanted = [Counter(t for piece in terms(text) for t in piece) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    index = scratch.written(postings(docs, vocabulary), "postings")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = document_frequencies(index, len(vocabulary))
    asked = []
    for repeats in wanted:
        ranked = sorted((int(df[t]), t, r) for name, r in repeats.items() if df[t := vocabulary[name]])
        asked.append([(t, r * weight(n, d)) for d, t, r in ranked])
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = searched(index, asked, n, total, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents with a score above 0."""
    spark = scratch.ready(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter(F.col("text") != "").distinct()
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        if some:
            out = out.unionByName(_search_block(docs, [tuple(r) for r in some], top))
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms_sql(column: str) -> str:
    return rf"unnest(regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
occurrences AS (SELECT r, {_terms_sql("text")} AS term FROM d),
lengths AS (SELECT r, count(*) AS n FROM occurrences GROUP BY r),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
tf AS (SELECT r, term, count(*) AS tf FROM occurrences GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
asked AS (SELECT item_id, text, term, count(*) AS repeats FROM (SELECT item_id, text, {_terms_sql("text")} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scores AS (
  SELECT item_id, text, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (r), whole GROUP BY item_id, text, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN (SELECT r, doc_id FROM d) USING (r) WHERE score > 0 QUALIFY rank <= {TOP}"""
