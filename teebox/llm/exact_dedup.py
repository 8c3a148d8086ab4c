"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row.

DataFrame functions only.  The content is the text without ``[\\x20\\x09-\\x0D]``
characters (null text is empty).  Grouping is by (128-bit hash, content): the hash
aggregate compares the content's bytes, so rows of one hash but different bytes form
different groups, and the map side already folds copies, however many there are.
Of a group the row with the most code points in the original text stays, then the
smallest id (a null id comes last).  Rows join their group by (128-bit hash,
SHA-256), a fixed-width key; the planner may split a hot key.

Defined results: empty table -> empty; null and empty texts are equal; rows that
repeat the same id in a group are the same document and share its verdict; other
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch

SPACES = " \t\n\x0b\x0c\r"
_ID_SPAN = "100000000000000000000"  # 10^20, above any 64-bit id
_MAX_ID = "9223372036854775807"


def content(text: Column) -> Column:
    """Text without the six ASCII white-space characters; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _precedence(n: Column, doc_id: Column) -> Column:
    """One decimal that orders by n, then by smallest id; fixed width, so hash aggregates keep it in place."""
    back = F.coalesce(F.lit(_MAX_ID).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)") + F.lit(1), F.lit(0).cast("decimal(21,0)"))
    return (n.cast("decimal(17,0)") * F.lit(_ID_SPAN).cast("decimal(21,0)") + back).cast("decimal(38,0)")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    c = content(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.md5(c)).alias("h"),
        F.unhex(F.sha2(c, 256)).alias("sha"),
        c.alias("content"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
    )
    groups = (
        rows.groupBy("h", "content")
        .agg(F.max(_precedence(F.col("n"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("content", 256)).alias("sha"), "group_size", (F.col("best") % F.lit(_ID_SPAN).cast("decimal(21,0)")).alias("back"))
        .select("h", "sha", "group_size", F.when(F.col("back") > 0, F.lit(_MAX_ID).cast("decimal(20,0)") + F.lit(1) - F.col("back")).cast("long").alias("keep_id"))
    )
    return (
        rows.select("doc_id", "h", "sha")
        .join(groups, ["h", "sha"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns unchanged; rows that share an id are judged on their own texts.

    Of the rows that share the id and the text of the one that stays (or have no id) the longest
    original text stays, then the greatest row as JSON.
    """
    sha = F.sha2(content(docs[text_col]), 256)
    found = scratch.written(verdicts(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"), "verdicts")
    drop = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_drop"), F.col("text_sha256").alias("_drop_sha")).distinct()
    twice = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("_twice"), F.col("text_sha256").alias("_twice_sha"))

    def of(rows: DataFrame, names: str):
        return docs[id_col].cast("long").eqNullSafe(rows[names]) & (sha == rows[f"{names}_sha"])

    left = docs.join(drop, of(drop, "_drop"), "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = F.struct(F.coalesce(F.char_length(F.col(text_col)), F.lit(-1)), F.sha2(F.col(text_col), 256), F.to_json(whole))
    again = left.join(twice, of(twice, "_twice"), "left_semi")
    folded = again.groupBy(F.col(id_col).alias("_id"), F.sha2(content(F.col(text_col)), 256).alias("_sha")).agg(F.max_by(whole, best).alias("_row"))
    return left.join(twice, of(twice, "_twice"), "left_anti").unionByName(folded.select("_row.*"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c
  FROM documents
), g AS (
  SELECT c, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY c
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.c) AS text_sha256
FROM t JOIN g ON t.c = g.c
"""
