"""Language ID by prediction by partial matching over frozen byte context trees.

Training counts, per language, how often each byte follows each context of 0 to
``ORDER`` bytes (lower-cased UTF-8).  The trees are frozen: a byte seen c times in a
context of total C with q different successors costs ``-log2(c / (C + q))`` bits, an
unseen byte pays the escape ``-log2(q / (C + q))`` and is tried in the next shorter
context, down to a uniform byte.  A text's code length under a language is the sum over
its whole text; the shortest code wins.

The fit uses at most about ``fit_docs`` whole documents per language (a documented bound:
documents are taken by a hash of their id with the rate fit_docs / rows of the language),
so the model collected to the driver and sent to workers is bounded.  Scoring covers every
byte of every row: code lengths of the model's longest contexts are tabulated once per
worker, other contexts are walked with vectorised look-ups.

Defined results: null text or no letter -> ``und`` with score 0; ties go to the language
first in the alphabet; no training rows -> every row ``und`` with score 0; other columns are
never inputs of a prediction.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teebox.llm import scratch
from teebox.llm.text import slices

ORDER = 3  # longest context in bytes
FIT_DOCS = 500  # documents per language in the fit
UNKNOWN = "und"
TABLE_BITS = 20
PAD = "\n" * ORDER

_letter = regex.compile(r"\p{L}").search


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Each position's last k+1 bytes (k of context, then the byte) as one number; the first k positions are cut."""
    key = buf[k:].astype(np.uint32)
    for j in range(1, k + 1):
        key |= buf[k - j : len(buf) - j].astype(np.uint32) << np.uint32(8 * j)
    return key


def _padded(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return pc.binary_join_element_wise(pa.scalar(PAD, pa.large_string()), low, pa.scalar("", pa.large_string()))


@dataclass
class Model:
    langs: list[str]
    seen: list[list[tuple[np.ndarray, np.ndarray]]]  # per language, per order: (grams, bits)
    escapes: list[list[tuple[np.ndarray, np.ndarray]]]  # per language, per order: (contexts, bits)
    common: np.ndarray  # longest grams worth tabulating

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each full gram under each language, by walking down the contexts."""
        out = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        for l in range(len(self.langs)):
            todo, cost = np.arange(len(keys)), np.zeros(len(keys), np.float32)
            for k in range(ORDER, -1, -1):
                if len(todo) == 0:
                    break
                g = keys[todo] if k == 3 else keys[todo] & np.uint32((1 << 8 * (k + 1)) - 1)
                names, values = self.seen[l][k]
                at, hit = _find(names, g)
                cost[todo[hit]] += values[at[hit]]
                todo, g = todo[~hit], g[~hit]
                names, values = self.escapes[l][k]
                at, hit = _find(names, g >> np.uint32(8))
                cost[todo[hit]] += values[at[hit]]
            cost[todo] += 8.0
            out[:, l] = cost
        return out

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.zeros(1 << TABLE_BITS, np.uint32)
        slot = _slot(self.common[::-1])
        keys[slot] = self.common[::-1]  # the more frequent gram keeps a shared slot
        return keys, self.bits(keys)

    def document_bits(self, column: pa.Array) -> np.ndarray:
        """Code length of every text under every language."""
        keys_at, bits_at = self.table
        out = np.zeros((len(column), len(self.langs)))
        for lo, hi, buf, offs in slices(_padded(column), 1 << 19):
            key = grams(buf, ORDER)
            slot = _slot(key)
            cost = bits_at[slot]
            miss = np.flatnonzero(keys_at[slot] != key)
            if len(miss):
                names, inverse = np.unique(key[miss], return_inverse=True)
                cost[miss] = self.bits(names)[inverse]
            for l in range(len(self.langs)):
                run = np.concatenate([[0.0], np.cumsum(cost[:, l], dtype=np.float64)])
                out[lo:hi, l] = run[offs[1:] - ORDER] - run[offs[:-1]]
        return out


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint32(2654435769)) >> np.uint32(32 - TABLE_BITS)


def _find(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(names) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return at, names[at] == keys


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, holdout: bool = True) -> Model:
    """Context trees of every language among the (not held out) labelled rows."""
    scratch.ready(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    if holdout:
        rows = rows.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], [], np.zeros(0, np.uint32))
    limits = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, fit_docs / sizes[l]) * (1 << 30))])
    sample = rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30)) < limits[F.col("lang")])

    @scratch.tidy
    def count(batches):
        for batch in batches:
            names = batch.column(1).to_pylist()
            for lang in sorted(set(names)):
                texts = _padded(batch.column(0).filter(pa.array([x == lang for x in names])))
                for _, _, buf, offs in slices(texts):
                    inside = np.ones(len(buf), dtype=bool)
                    for j in range(ORDER):
                        inside[offs[:-1] + j] = False
                    key, n = np.unique(grams(buf, ORDER)[inside[ORDER:]], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    seen, escapes, weight = [], [], {}
    for lang in langs:
        part = counted.filter(pc.equal(counted["lang"], lang))
        gram, n = part["gram"].to_numpy().astype(np.uint32), part["n"].to_numpy()
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        per_seen, per_escape = [], []
        for k in range(ORDER + 1):
            names, inverse = np.unique(gram if k == 3 else gram & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(inverse, weights=n) if len(names) else np.zeros(0)
            contexts, at, q = np.unique(names >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=c) if len(names) else np.zeros(0)
            per_seen.append((names, -np.log2(c / (total + q)[at]).astype(np.float32)))
            per_escape.append((contexts, -np.log2(q / (total + q)).astype(np.float32)))
        seen.append(per_seen)
        escapes.append(per_escape)
        weight[lang] = (gram, n)
    keys, inverse = np.unique(np.concatenate([g for g, _ in weight.values()]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([n for _, n in weight.values()]))
    return Model(langs, seen, escapes, keys[np.argsort(-total, kind="stable")])


def annotate(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share of the likelihood (0 to 1)."""
    spark = scratch.ready(docs)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (lang_out, score_out)] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    keep = [f.name for f in schema.fields[:-2]]

    @scratch.tidy
    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part.column(part.schema.get_field_index(text_col))
                if not m.langs:
                    names, scores = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
                else:
                    bits = m.document_bits(texts)
                    best = bits.argmin(axis=1)
                    share = 1.0 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                    letters = [t is not None and _letter(t) is not None for t in texts.to_pylist()]
                    names = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                    scores = [float(s) if ok else 0.0 for s, ok in zip(share, letters)]
                yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, lang_out, score_out])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in set(keep)]).mapInArrow(run, schema)


def bits_by_walking(model: Model, text: str) -> list[float]:
    """Plain per-byte reference of ``document_bits`` (tests)."""
    data = (PAD + text.lower()).encode("utf-8")
    trees = [[dict(zip(n.tolist(), v.tolist())) for n, v in side[l]] for side in (model.seen, model.escapes) for l in range(len(model.langs))]
    total = []
    for l in range(len(model.langs)):
        seen, escapes, cost = trees[l], trees[len(model.langs) + l], 0.0
        for i in range(ORDER, len(data)):
            for k in range(ORDER, -1, -1):
                key = int.from_bytes(data[i - k : i + 1], "big")
                if key in seen[k]:
                    cost += seen[k][key]
                    break
                cost += escapes[k].get(key >> 8, 0.0)
            else:
                cost += 8.0
        total.append(cost)
    return total

