"""Flattening of nested results to wide rows, and the projections of a model's inputs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import safe

SCALARS = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType)

# The blocks that a model reads and the prefixes of their columns.
BLOCK_PREFIXES = {
    "visual": "visual_", "geometry": "geometry_", "centering": "centrado_", "edge": "borde_", "corner": "esquina_", "whitening_surface": "superficie_",
    "capture_score": "score_capture_", "preliminary_score": "score_prelim_", "centering_score": "score_centering_", "edge_score": "score_edge_", "corner_score": "score_corner_", "surface_score": "score_ws_",
}
LEADING = (
    "image_id", "image_filename", "relative_path_from_raw", "categoria_carpeta_raw", "label_condition", "target_damaged", "analysis_status", "invalid_reasons",
    "usable_for_condition_model", "procesado_exito", "pipeline_stage", "error", "image_height", "image_width", "run_timestamp", "feature_schema_version",
)


def leaves(schema: T.StructType, path: str = "", name: str = "") -> Iterable[tuple[str, str, T.DataType]]:
    """(path, flat name, type) of every scalar below ``schema``; arrays, maps and binaries are left out."""
    for f in schema.fields:
        at, to = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}_{f.name}" if name else f.name
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, at, to)
        elif isinstance(f.dataType, SCALARS):
            yield at, to, f.dataType


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as columns named parent_child; of equal names the last one stands, in the place of the first."""
    found: dict[str, Column] = {}
    for path, name, _ in leaves(df.schema):
        found[name] = F.col(path).alias(name)
    return df.select(*found.values())


def prefixed(df: DataFrame, prefixes: dict[str, str] = BLOCK_PREFIXES) -> DataFrame:
    """The scalars of the named struct columns as doubles under their block's prefix; texts are left out."""
    found: dict[str, Column] = {}
    for block, prefix in prefixes.items():
        if block in df.columns and isinstance(df.schema[block].dataType, T.StructType):
            for path, name, kind in leaves(df.schema[block].dataType, f"`{block}`"):
                if isinstance(kind, (T.NumericType, T.BooleanType)):
                    found[prefix + name] = safe(F.col(path).cast("double")).alias(prefix + name)
    return df.select(*found.values())


def model_inputs(df: DataFrame, names: Sequence[str], default: float = 0.0) -> DataFrame:
    """Exactly ``names`` in order, as doubles; a column that is missing or no number becomes ``default``."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*((safe(F.col(f"`{n}`"), default) if isinstance(have.get(n), (T.NumericType, T.BooleanType)) else F.lit(default)).alias(n) for n in names))


def leading_first(df: DataFrame, lead: Sequence[str] = LEADING) -> DataFrame:
    first = [c for c in lead if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def first_existing(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def by_prefix(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), banned: Sequence[str] = ()) -> DataFrame:
    """Columns of numbers and booleans (as 0/1) whose name starts as asked and is not banned."""
    kept = [f for f in df.schema.fields if f.name not in banned and (not include or f.name.startswith(tuple(include))) and not f.name.startswith(tuple(exclude) or ("\0",)) and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return df.select(*(F.col(f"`{f.name}`").cast("byte").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`") for f in kept))


def drop_empty(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing but nulls; one aggregate over all of them."""
    counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in df.columns)).first()
    return df.select(*(f"`{c}`" for c in df.columns if counts[c]))


def without_infinities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in columns})
