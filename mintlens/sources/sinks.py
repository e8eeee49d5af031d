"""Writing data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet",), mode: str = "errorifexists") -> dict[str, str]:
    """Write ``df`` below ``path``, one folder a format, and return what came of each: its folder or why it failed.

    A format that fails doesn't keep the others from being written.

    Parquet is the one to rely on: CSV turns empty texts into nulls and needs flat columns.
    """
    done = {}
    for kind in formats:
        target = f"{path.rstrip('/')}/{kind}"
        if kind == "xlsx":
            done[kind] = "not available: no spreadsheet writer is installed"
            continue
        writer = df.write.mode(mode)
        try:
            (writer.option("header", True).csv if kind == "csv" else writer.format(kind).save)(target)
            done[kind] = target
        except Exception as e:  # the caller decides what a missing format means
            done[kind] = f"failed: {type(e).__name__}: {str(e).splitlines()[0]}"
    return done
