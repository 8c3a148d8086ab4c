"""Secret scan: candidate strings judged by a random forest that removes false positives.

Candidates are long runs of key-like characters, and shorter runs assigned to a name such as
``token`` or ``password``.  Each gets features: its length and make-up, how usual its character
transitions are (log-likelihood under transitions counted over all documents), how much of it
dictionary words cover (the corpus's frequent words), whether the path (source) speaks of tests
or examples, and its neighbouring words (secret names, assignment, quotes, placeholder words).

The forest (Spark ML) is trained from labelled findings.  ``label_findings`` labels those that
need no model: known key formats and quoted assignments of random strings are secrets;
placeholders, plain words and digit runs are not.  The rest stay unlabelled and are judged by the
forest.  Training takes at most about ``FIT_ROWS`` labelled findings per class, taken by a hash;
transitions and words are counted over all documents.

Defined results: null and empty texts have no candidates; a null source is an empty path; without
labelled findings of both classes the label rule alone decides and unlabelled findings score 0.5;
rows that repeat an id are scanned each.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch
from teebox.llm.text import slices

FIT_ROWS = 5000
DICTIONARY = 4096  # frequent words
LONG = 20
SEED = 8

# Names that announce a secret, words that mark placeholders, known key formats.
NAMES = frozenset("key apikey token secret password passwd pwd auth authorization bearer credential credentials private access client".split())
PLACEHOLDERS = frozenset("example sample dummy placeholder changeme test fake your xxx todo insert replace".split())
TEST_PATHS = re.compile(r"test|example|sample|fixture|mock|doc|demo", re.I)
KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[0-9a-zA-Z]{24,}|xox[baprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)$")

_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{{LONG},}}={{0,2}}")
_NAMED = re.compile(r"(?i:\b(?:[a-z_]*(?:key|token|secret|passw(?:or)?d|pwd))[\"']?\s*[:=]\s*[\"']?)([^\s\"',;]{8,})")
_WORD = re.compile(r"[A-Za-z]+")
FEATURES = ["length", "digits", "upper", "symbols", "switches", "distinct", "entropy", "transition", "dictionary", "test_path", "named", "assigned", "quoted", "placeholder", "hex"]

_CLASS = np.zeros(256, np.int64)  # characters for transitions: a-z (case folded), digit, other
for _c in range(256):
    _CLASS[_c] = ord(chr(_c).lower()) - 96 if chr(_c).isascii() and chr(_c).isalpha() else 27 if 48 <= _c <= 57 else 0


def transitions(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of character transitions (28 x 28) over all documents."""

    def run(batches):
        total = np.zeros(28 * 28, np.int64)
        for batch in batches:
            for _, _, buf, offs in slices(batch.column(0)):
                c = _CLASS[buf]
                inside = np.ones(max(0, len(c) - 1), bool)  # the step from one text to the next is none
                inside[offs[(offs > 0) & (offs < len(c))] - 1] = False
                total += np.bincount((c[:-1] * 28 + c[1:])[inside], minlength=784)[:784]
        yield pa.record_batch([pa.array(range(784), pa.int32()), pa.array(total)], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.ones(784)
    for r in rows:
        n[r["pair"]] += r["n"]
    n = n.reshape(28, 28)
    return np.log(n / n.sum(axis=1, keepdims=True))


def dictionary(docs: DataFrame) -> frozenset[str]:
    """The corpus's most frequent words of 3 to 12 letters (a top-k report over all documents)."""
    limit = 200_000

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_WORD.findall(text.lower()) if text else ())
                if len(counts) > limit:
                    yield _words(counts)
                    counts = Counter()
        if counts:
            yield _words(counts)

    words = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in words.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect())


def _words(counts: Counter) -> pa.RecordBatch:
    kept = [(w, n) for w, n in counts.items() if 3 <= len(w) <= 12] or [("", 0)]
    words, n = zip(*kept)
    return pa.record_batch([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def coverage(s: str, words: frozenset[str]) -> float:
    """Share of the letters of ``s`` that dictionary words cover, longest word first from the left."""
    low, i, hit = s.lower(), 0, 0
    while i < len(low):
        for n in range(min(12, len(low) - i), 2, -1):
            if low[i : i + n] in words:
                hit, i = hit + n, i + n
                break
        else:
            i += 1
    return hit / max(1, len(low))


def spans(text: str) -> list[tuple[int, int]]:
    """Candidates in order: key-like runs and values assigned to a name, each searched by itself; what overlaps is one span."""
    values = [m.span(1) for m in _NAMED.finditer(text)]
    starts = [a for a, _ in values]
    out: list[tuple[int, int]] = []
    for a, b in sorted([*values, *(m.span() for m in _RUN.finditer(text))]):
        k = bisect.bisect_right(starts, a)
        if k < len(starts) and a < starts[k] < b:  # a name with its sign: the value stays a span of its own
            b = starts[k]
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def features(s: str, before: str, after: str, path: str, logp: np.ndarray, words: frozenset[str]) -> list[float]:
    n = len(s)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s]
    counts = Counter(s)
    codes = _CLASS[np.frombuffer(s.encode("utf-8"), np.uint8)]
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    here = [w.lower() for w in _WORD.findall(s)]
    return [
        float(n),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(logp[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0,
        coverage(s, words),
        float(bool(TEST_PATHS.search(path))),
        float(any(w in NAMES for w in near)),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(any(w in PLACEHOLDERS for w in [*near[-2:], *here]) or any(w in s.lower() for w in PLACEHOLDERS if len(w) > 4)),
        float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None),
    ]


def rule_label(s: str, f: dict[str, float]) -> int | None:
    """Label of a finding that needs no model: 1 secret, 0 none, None unknown."""
    if f["placeholder"] or f["distinct"] * f["length"] <= 4 or s.replace(".", "").replace("-", "").isdigit():
        return 0
    if KNOWN.match(s):
        return 1
    if f["digits"] == 0 and not f["assigned"]:
        return 0
    if f["named"] and f["assigned"] and f["quoted"] and f["digits"] > 0 and f["entropy"] >= 3:
        return 1
    if not f["named"] and not f["assigned"] and f["dictionary"] > 0.5:
        return 0
    return None


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Findings of every row: doc_id, start, secret, label (null: unknown) and the features."""
    spark = scratch.ready(docs)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    shared = spark.sparkContext.broadcast((transitions(docs), dictionary(docs)))

    def run(batches):
        logp, words = shared.value
        for batch in batches:
            rows = []
            for doc_id, text, where in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in spans(text or ""):
                    s = text[a:b]
                    f = features(s, text[max(0, a - 60) : a], text[b : b + 2], where, logp, words)
                    rows.append((doc_id, a, s, rule_label(s, dict(zip(FEATURES, f))), *f))
                if len(rows) >= 4096:
                    yield _findings(rows)
                    rows = []
            if rows:
                yield _findings(rows)

    return docs.mapInArrow(run, "doc_id long, start long, secret string, label int, " + ", ".join(f"{c} double" for c in FEATURES))


def _findings(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * len(FEATURES)]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "start", "secret", "label", *FEATURES])


def fit(findings: DataFrame, trees: int = 20, depth: int = 6):
    """Random forest from the labelled findings; None without both classes."""
    labelled = findings.filter("label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, FIT_ROWS / sizes[1]))).otherwise(F.lit(min(1.0, FIT_ROWS / sizes[0])))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "start", F.lit(SEED)), F.lit(1 << 30)) < rate * F.lit(1 << 30))
    sample = scratch.written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", F.col("label").cast("double").alias("label")), "labelled")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(sample)


def judge(findings: DataFrame, model) -> DataFrame:
    """doc_id, start, length, secret, secret_sha256, score, is_secret of every finding."""
    if model is None:
        scored = findings.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.5)))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", F.char_length("secret").cast("long").alias("length"), "secret", F.sha2("secret", 256).alias("secret_sha256"), "score", (F.col("score") > 0.5).alias("is_secret"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Judged findings of every document."""
    findings = scratch.written(find(docs, id_col, text_col, path_col), "findings")
    return judge(findings, fit(findings))
