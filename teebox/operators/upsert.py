"""Keyed upsert: whole-row replace by key, last write wins, optional preserved columns.

Plan: ``existing UNION incoming`` tagged with a precedence (incoming after
existing, then an optional in-batch order column), reduced per key with
``max_by(row, precedence)``, which Spark runs as a sort aggregate (the rows
hold strings); a key holds a handful of versions.  Preserved columns (user annotations such as the
exclusion flag and comment) are carried from the existing row when it has a
non-null value, so a re-import never resets them; an existing ``false`` also
beats an incoming ``true``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SRC = "_upsert_src"
SEQ = "_upsert_seq"


def with_preserved(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], preserve: Sequence[str]) -> DataFrame:
    """Incoming rows whose preserved columns take the existing non-null value."""
    keys = list(keys)
    cols = [c for c in preserve if c in existing.columns]
    if not cols:
        return incoming
    kept = existing.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in cols])
    joined = incoming.join(kept, on=keys, how="left")
    for c in cols:
        fallback = F.col(c) if c in incoming.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(F.col(f"__p_{c}"), fallback))
    out_cols = list(incoming.columns) + [c for c in cols if c not in incoming.columns]
    return joined.select(*out_cols)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    *,
    preserve: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    """Merged table: one row per key, incoming rows replacing existing ones.

    ``order`` names an incoming column that orders duplicates inside the
    batch (highest wins); of duplicates it doesn't tell apart, the same one
    always wins: that of the largest hash of its values.
    """
    keys = list(keys)
    if preserve:
        incoming = with_preserved(existing, incoming, keys, preserve)
    seq_in = F.col(order).cast("long") if order else F.lit(0).cast("long")
    a = existing.withColumn(SRC, F.lit(0)).withColumn(SEQ, F.lit(0).cast("long"))
    b = incoming.withColumn(SRC, F.lit(1)).withColumn(SEQ, seq_in)
    both = a.unionByName(b, allowMissingColumns=True)
    value_cols = [c for c in both.columns if c not in keys and c not in (SRC, SEQ)]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), F.struct(F.col(SRC), F.col(SEQ), F.xxhash64(*value_cols))).alias("_row"))
    ordered = [c for c in existing.columns if c not in (SRC, SEQ)] + [
        c for c in incoming.columns if c not in existing.columns and c not in (SRC, SEQ)
    ]
    return latest.select(*keys, "_row.*").select(*ordered)


def annotate(rounds: DataFrame, annotations: DataFrame) -> DataFrame:
    """Apply (round_id, exclude_from_stats, comment) annotations as whole-row upserts.

    A null flag or comment in an annotation keeps the round's current value
    (a round never flagged counts as included) and an empty comment clears
    it; nothing is preserved from the stored row beyond that, as for a
    one-round edit.
    """
    ann = annotations.select(
        "round_id",
        F.col("exclude_from_stats").cast("boolean").alias("_new_flag"),
        F.col("comment").cast("string").alias("_new_comment"),
    )
    updated = (
        rounds.join(ann, on="round_id", how="inner")
        .withColumn(
            "exclude_from_stats",
            F.coalesce(F.col("_new_flag"), F.col("exclude_from_stats").cast("boolean"), F.lit(False)),
        )
        .withColumn("comment", F.nullif(F.coalesce(F.col("_new_comment"), F.col("comment")), F.lit("")))
        .select(*rounds.columns)
    )
    return upsert(rounds, updated, ["round_id"])
