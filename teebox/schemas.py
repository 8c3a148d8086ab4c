"""Declared schemas of the three silver tables and the conform step.

The source documents are schemaless; instead of guarding every product with
"is the column there", every frame goes through ``conform`` once: missing
columns become typed nulls, present ones are ``try_cast`` (never a raising
cast), and extra columns are kept after the declared ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, D, S, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


ROUNDS = _struct(
    [
        ("round_id", L),
        ("scorecard_id", L),
        ("activity_id", L),
        ("played_on", S),
        ("start_time", S),
        ("course_name", S),
        ("location_name", S),
        ("tee_name", S),
        ("total_score", I),
        ("total_par", I),
        ("exclude_from_stats", B),
        ("comment", S),
        ("strokes_gained_handicap", D),
        ("player_profile_id", L),
        ("data_source", S),
        ("summary_json", S),
        ("scorecard_json", S),
    ]
)

HOLES = _struct(
    [
        ("round_id", L),
        ("hole_number", I),
        ("par", I),
        ("strokes", I),
        ("putts", I),
        ("fairway_hit", B),
        ("gir", B),
        ("penalties", I),
        ("fairway_shot_outcome", S),
        ("handicap_score", I),
        ("pin_position_lat", D),
        ("pin_position_lon", D),
        ("last_modified", S),
        ("hole_json", S),
    ]
)

SHOTS = _struct(
    [
        ("round_id", L),
        ("hole_number", I),
        ("shot_number", I),
        ("shot_id", L),
        ("scorecard_id", L),
        ("player_profile_id", L),
        ("shot_order", I),
        ("club", S),
        ("club_id", L),
        ("distance_meters", D),
        ("lie", S),
        ("result", S),
        ("shot_type", S),
        ("auto_shot_type", S),
        ("shot_source", S),
        ("shot_time", S),
        ("shot_time_zone_offset", I),
        ("start_lat", D),
        ("start_lon", D),
        ("start_x", I),
        ("start_y", I),
        ("end_lat", D),
        ("end_lon", D),
        ("end_x", I),
        ("end_y", I),
        ("shot_json", S),
    ]
)

TABLES: dict[str, T.StructType] = {"rounds": ROUNDS, "holes": HOLES, "shots": SHOTS}
KEYS: dict[str, list[str]] = {
    "rounds": ["round_id"],
    "holes": ["round_id", "hole_number"],
    "shots": ["round_id", "hole_number", "shot_number"],
}


def lenient_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that yields null instead of failing (the engine is ANSI by default)."""
    if source == target:
        return column
    if isinstance(target, T.BooleanType) and isinstance(source, T.StringType):
        # try_cast accepts 't'/'y' too; only the spellings the source format uses pass.
        lowered = F.lower(F.trim(column))
        return (
            F.when(lowered.isin("true", "yes", "1"), F.lit(True))
            .when(lowered.isin("false", "no", "0"), F.lit(False))
            .otherwise(F.lit(None).cast(B))
        )
    return column.try_cast(target)


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = True) -> DataFrame:
    """Project ``df`` onto ``schema``: add missing columns as typed nulls, try_cast the rest."""
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for field in schema.fields:
        if field.name in present:
            cols.append(lenient_cast(F.col(field.name), present[field.name], field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    if keep_extra:
        declared = set(schema.fieldNames())
        cols.extend(F.col(name) for name in df.columns if name not in declared)
    return df.select(*cols)


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
