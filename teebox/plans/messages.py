"""Device message inventory per file, over an already decoded message table.

Input rows: (file_id, seq, name, fields).  Per file: counts by message name,
counts of unnamed (``unknown_*``) messages, the fields of the first session
message, and lap and record counts.  Names are counted in a partial/final
hash aggregate first, so only the per-file list of distinct names (a bounded
vocabulary of message types) is collected into the map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_inventory(messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("name"), F.col("n"))))
    per_name = counts.filter(F.col("name").isNotNull()).groupBy("file_id").agg(F.map_from_entries(entries).alias("_m"))
    per_file = messages.groupBy("file_id").agg(
        F.min_by(F.col("fields"), F.when(F.col("name") == "session", F.col("seq"))).alias("session"),
        F.count(F.when(F.col("name") == "lap", F.lit(1))).alias("lap_count"),
        F.count(F.when(F.col("name") == "record", F.lit(1))).alias("record_count"),
    )
    out = per_file.join(per_name, on="file_id", how="left")
    return out.select(
        "file_id",
        F.coalesce(F.to_json("_m"), F.lit("{}")).alias("message_counts"),
        F.coalesce(
            F.to_json(F.map_filter("_m", lambda k, v: k.startswith("unknown_"))), F.lit("{}")
        ).alias("unknown_message_counts"),
        "session",
        "lap_count",
        "record_count",
    )
