"""BPE encoding and decoding by forced-boundary splitting.

A word-end BPE vocabulary (``tokenizers`` JSON: lower case, white space dropped,
``</w>`` at word ends) is read from a path that is a parameter; each worker loads it once.
Byte pairs that never occur inside any vocabulary token mark certain cuts: no merge can
cross them, so a pre-token is cut there, each fragment is merged on its own, and the
fragments' ids are concatenated.  A bounded cache keeps the ids of a task's recent pre-tokens.

Words are split by the ``regex`` module.  Its Unicode tables and the library's differ in age, so a
text with a character that Unicode 3.2 didn't have, or classed otherwise, is normalised and split
by the library's own components; its words are then encoded like all others.

Defined results: null text is empty (no ids, empty decoded text); special token strings
inside a text become their special id, as the library does by default; texts of any
length are encoded whole.  Ids are little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teebox.llm import scratch

CACHE_WORDS = 1 << 18
HEAP_FROM = 48  # fragments longer than this are merged with a heap


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return [out[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.steady = _Steady()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        pre = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pre["pattern"]["Regex"]).findall
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.table = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.table[i] = token
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + self.suffix] for c in chars]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        # byte pairs seen inside a token, apart for pairs whose second byte ends the word
        self.joined = np.zeros((2, 256, 256), dtype=bool)
        for token in vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            b = [back[c] for c in (token[: -len(self.suffix)] if ends else token)]
            for i in range(len(b) - 1):
                self.joined[int(ends and i == len(b) - 2), b[i], b[i + 1]] = True
        self.pairs = [[[bool(x) for x in row] for row in side] for side in self.joined]
        self.cache = _Cache(self)

    def fragments(self, b: bytes) -> list[list[int]]:
        """Start symbols of a pre-token, cut at every forced boundary."""
        inside, at_end = self.pairs
        out, last = [], len(b) - 1
        now = [self.inner[b[0]] if last else self.final[b[0]]]
        for i in range(1, last + 1):
            seen = at_end if i == last else inside
            if not seen[b[i - 1]][b[i]]:
                out.append(now)
                now = []
            now.append(self.final[b[i]] if i == last else self.inner[b[i]])
        out.append(now)
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Merge a fragment: always the pair of lowest rank, leftmost first."""
        if len(ids) < 2:
            return ids
        if len(ids) > HEAP_FROM:
            return self._merge_long(ids)
        rank, new, none = self.rank.get, self.merged, len(self.merged)
        ranks = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [new[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, new, n = self.rank.get, self.merged, len(ids)
        prev, nxt, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = new[r], False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                if x >= 0 and nxt[x] < n and (r := rank(ids[x] << 20 | ids[nxt[x]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[nxt[x]]))
        return [t for t, keep in zip(ids, alive) if keep]

    def word_ids(self, word: str) -> list[int]:
        return [t for f in self.fragments(word.encode("utf-8")) for t in self.merge(f)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed."""
        if self.split_special is not None and "<|" in text:
            return b"".join(self.special.get(part) or self._plain(part) for part in self.split_special(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not all(map(self.steady.__getitem__, set(text))):
                text = self.library.normalizer.normalize_str(text)
                return b"".join(self.cache[text[a:b]] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
            text = unicodedata.normalize("NFC", text)
        low = text.replace("Σ", "σ").lower()  # characters one by one: no final-sigma rule
        return b"".join(map(self.cache.__getitem__, self.words(low)))

    def decode(self, ids: bytes) -> str:
        """Token strings joined by one space (the file names no decoder), special tokens kept."""
        return " ".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class _Steady(dict):
    """Whether a character is of the same class in Unicode 3.2 and now."""

    def __missing__(self, c: str) -> bool:
        self[c] = old = unicodedata.ucd_3_2_0.category(c) == unicodedata.category(c) != "Cn"
        return old


class _Cache(dict):
    """Ids of recent pre-tokens, in two generations of at most CACHE_WORDS each."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.bpe.word_ids(word)).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids (binary) and decoded (string) of every row."""
    scratch.ready(docs)

    @scratch.tidy
    def run(batches):
        bpe = load(vocab_path)
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, rows):
                    part = batch.slice(lo, rows)
                    ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                    yield pa.record_batch(
                        [
                            part.column(0),
                            pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                            pa.array([bpe.decode(x) for x in ids], pa.string()),
                        ],
                        names=["doc_id", "n_tokens", "ids", "decoded"],
                    )
        finally:  # the worker lives on: its next tasks are other stages'
            bpe.cache.clear()

    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the operator's ids and texts."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
