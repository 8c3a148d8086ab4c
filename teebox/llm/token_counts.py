"""Token counts without token ids: pieces counted once per distinct pre-token.

1. One pass collects the distinct pre-tokens of all texts with their frequencies (merged in
   each task first); the pieces of every distinct pre-token are counted once, and pre-token,
   frequency and number of pieces are written as a table.
2. A second pass takes each document's pre-token frequencies and joins them to that table.  The
   most frequent pre-tokens, HEAD at most, are broadcast and joined in the pass itself, so no
   hot pre-token is shuffled; the others leave the pass as (row, pre-token, frequency) and are
   joined by a shuffle on the pre-token.
3. Pieces x frequency are summed per row.

The vocabulary is a byte-level BPE file of the ``tokenizers`` library, read from a path that is
a parameter.  ASCII text is split by an equivalent ASCII pattern; text with a character that
Unicode 3.2 didn't have, or classed otherwise, by the library itself (see ``bpe``).

Defined results: null text is empty (0 bytes, 0 tokens); the vocabulary's special strings inside
a text count one token each, as the library takes them by default; texts of any length are
counted whole; rows that share an id or are equal are counted each by itself; other columns of
any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import bpe, scratch

HEAD = 1 << 16  # pre-tokens that are broadcast, at most
HEAD_CHARS = 32  # longer ones are never broadcast
LIMIT = 512  # tokens; more is over the limit
MERGED = 1 << 18  # distinct pre-tokens that a task merges before it sends them on
LIST_CHARS = 1 << 20  # longer texts are read one pre-token at a time
BATCH = 4096  # distinct pre-tokens handed to the library at once

# The pre-token pattern of byte-level vocabularies, and what it comes to for ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


class Pieces:
    """Pre-tokens of texts, and the number of vocabulary pieces of a pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is no byte-level vocabulary without normaliser and prefix space")
        self.library = tokenizers.Tokenizer.from_file(path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.ascii, self.any = re.compile(ASCII_PATTERN, re.ASCII), regex.compile(PATTERN)
        self.steady = bpe._Steady()

    def _split(self, text: str) -> Iterator[str]:
        if text.isascii():
            pattern = self.ascii
        elif all(map(self.steady.__getitem__, set(text))):
            pattern = self.any
        else:
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return map(itemgetter(0), pattern.finditer(text)) if len(text) > LIST_CHARS else pattern.findall(text)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Frequencies of a text's pre-tokens, and the number of special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        found = Counter(self._split(parts[0]))
        for part in parts[1:]:
            found.update(self._split(part))
        return found, len(parts) - 1

    def count(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        return [len(e) for e in self.library.encode_batch_fast(pretokens, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def pieces(docs: DataFrame, vocab_path: str) -> DataFrame:
    """pretoken, freq (in all texts) and n (its pieces), one row per distinct pre-token; not yet run."""

    @scratch.tidy
    def distinct(batches):
        split, found = load(vocab_path), Counter()

        def rows():
            names = list(found)
            for lo in range(0, len(names), BATCH):
                part = names[lo : lo + BATCH]
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([found[p] for p in part], pa.int64())], names=["pretoken", "freq"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(lo, 256).to_pylist():
                    found.update(split.frequencies(text)[0])
                if len(found) > MERGED:
                    yield from rows()
                    found.clear()
        yield from rows()

    @scratch.tidy
    def counted(batches):
        split = load(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                yield pa.record_batch([*part.columns, pa.array(split.count(part.column(0).to_pylist()), pa.int64())], names=["pretoken", "freq", "n"])

    texts = docs.filter(F.col("text") != "").select("text")
    merged = texts.mapInArrow(distinct, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return merged.mapInArrow(counted, "pretoken string, freq long, n long")


def head(known: DataFrame, most: int = HEAD) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: all from a frequency on, ``most`` at most.

    The frequency comes from counts by eighths of a power of two, so that the driver sees no
    more than those few counts and the chosen pre-tokens.
    """
    short = known.filter(F.char_length("pretoken") <= HEAD_CHARS)
    size = F.floor(8 * F.log2("freq")).cast("int")
    left, least = most, None
    for r in sorted(short.groupBy(size.alias("size")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    if least is None:
        return {}
    return {r.pretoken: r.n for r in short.filter(size >= least).select("pretoken", "n").collect()}


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, most: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), n_tokens and over_limit of every row."""
    spark = scratch.ready(docs)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = scratch.written(pieces(docs, vocab_path), "pieces")
    common = spark.sparkContext.broadcast(head(known, most))

    @scratch.tidy
    def summed(batches):
        split, pieces_of = load(vocab_path), common.value.get
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sums, names, freqs = [], [], []
                for text in part.column(2).to_pylist():
                    found, total = split.frequencies(text)
                    rare = {}
                    for pretoken, freq in found.items():
                        n = pieces_of(pretoken)
                        if n is None:
                            rare[pretoken] = freq
                        else:
                            total += n * freq
                    sums.append(total)
                    names.append(list(rare))
                    freqs.append(list(rare.values()))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(sums, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int64()))],
                    names=["doc_id", "n_bytes", "n", "pretokens", "freqs"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    passed = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(
        summed, f"doc_id {id_type}, n_bytes long, n long, pretokens array<string>, freqs array<long>"
    )
    # rows get their number once, in the written table: nothing below can number them otherwise
    rows = scratch.written(passed.withColumn("row", F.monotonically_increasing_id()), "tokens")
    rare = rows.select("row", F.explode(F.arrays_zip("pretokens", "freqs")).alias("p")).select("row", F.col("p.pretokens").alias("pretoken"), F.col("p.freqs").alias("times"))
    rest = rare.join(known.select("pretoken", F.col("n").alias("each")), "pretoken").select(
        "row", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("each") * F.col("times")).alias("n")
    )
    whole = rows.select("row", "doc_id", "n_bytes", "n").unionByName(rest)
    out = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
