"""Parts of a rectified card as a long table: one row a side, corner and whole, measured by column expressions.

The raster pass hands out what can't be had without pixels: a histogram of grey values, the profile along a side, and
sums of second differences.  Shares, spreads, runs and roughness follow from these in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..schema import CORNERS, SIDES

#: What the raster pass says of a part; profile is empty but for sides.
PART = "struct<family:string, part:string, histogram:array<bigint>, profile:array<double>, bend_sum:double, bend_squares:double>"
#: The order in which a card's parts come.
PARTS = (("visual", "whole"), *(("edge", s) for s in SIDES), *(("corner", c) for c in CORNERS))
# A bright pixel lies above the mean by so much and by so many deviations; an anomaly off the moving mean likewise.
BRIGHT, ODD = (10.0, 1.2), (6.0, 1.5)


def _moment(h: Column, power: int) -> Column:
    """The sum of grey values, or of their squares, over a histogram."""
    weighted = F.transform(h, lambda n, k: n * (k * k if power == 2 else k))
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _first(p: Column) -> dict[str, Column]:
    h = p["histogram"]
    off = arrays.residual(p["profile"], 11)
    return {
        "pixels": F.aggregate(h, F.lit(0).cast("bigint"), lambda s, x: s + x), "total": _moment(h, 1), "squares": _moment(h, 2), "histogram": h, "length": F.size(p["profile"]), "off": off, "steps": arrays.differences(p["profile"]),
        "bend_sum": p["bend_sum"], "bend_squares": p["bend_squares"], "family": p["family"], "part": p["part"],
    }


def _second(p: Column) -> dict[str, Column]:
    n = p["pixels"].cast("double")
    mean = p["total"] / n
    std = F.sqrt((n * p["squares"] - p["total"].cast("double") * p["total"]).cast("double")) / n
    bend = p["bend_sum"] / n
    return {**{k: p[k] for k in ("family", "part", "histogram", "length", "off", "steps", "pixels")}, "mean": mean, "std": std, "bend": p["bend_squares"] / n - bend * bend, "odd": F.greatest(F.lit(ODD[0]), ODD[1] * arrays.deviation(p["off"]))}


def _third(p: Column) -> dict[str, Column]:
    limit = p["mean"] + F.greatest(F.lit(BRIGHT[0]), BRIGHT[1] * p["std"])
    bright = F.aggregate(F.transform(p["histogram"], lambda n, k: F.when(k > limit, n).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    side = p["family"] == "edge"
    return {
        "family": p["family"], "part": p["part"], "mean_intensity": p["mean"], "std_intensity": p["std"], "highlight_ratio": bright / p["pixels"],
        "roughness": F.when(side, F.coalesce(arrays.deviation(p["steps"]), F.lit(0.0))).otherwise(p["bend"]),
        "anomaly_ratio": F.when(side, F.coalesce(arrays.share_above(p["off"], p["odd"]), F.lit(0.0))), "profile_length": F.when(side, p["length"].cast("double")),
    }


def metrics(parts: Column) -> Column:
    """``parts``, an array of PART, as an array of family, part and the metrics of each; null stays null.

    roughness is the spread of the profile's steps for a side, else the variance of second differences, which for the
    whole tells how sharp it is.  Anomalies and length are told for sides only.
    """
    for step in (_first, _second, _third):
        parts = F.transform(parts, (lambda made: lambda p: F.struct(*(c.alias(n) for n, c in made(p).items())))(step))
    return parts


def long_table(df: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each part of each card in place of the array ``parts``, with its metrics; a card without parts has none."""
    rows = df.withColumn("__m", metrics(F.col(parts))).select(*(c for c in df.columns if c != parts), F.explode("__m").alias("__m"))
    return rows.select(*(c for c in df.columns if c != parts), "__m.*")


def families(df: DataFrame, card_height: Column, card_width: Column, parts: str = "parts") -> DataFrame:
    """``df`` with the structs visual, edge and corner of each card in place of the array ``parts``; null where it is null."""
    d = df.withColumn("__m", metrics(F.col(parts))).drop(parts)
    at = {(family, part): F.get("__m", F.lit(k)) for k, (family, part) in enumerate(PARTS)}
    whole = at["visual", "whole"]
    visual = {"width": card_width, "height": card_height, "aspect_ratio": card_width / card_height, "area": card_width * card_height, "blur_score": whole["roughness"], "brightness_score": whole["mean_intensity"], "contrast_score": whole["std_intensity"]}
    edge = {f"{s}_{m}": at["edge", s][m] for s in SIDES for m in ("anomaly_ratio", "highlight_ratio", "roughness", "mean_intensity", "std_intensity", "profile_length")}
    corner = {f"{c}_{m}": at["corner", c][m] for c in CORNERS for m in ("highlight_ratio", "roughness", "mean_intensity", "std_intensity")}
    made = {name: F.when(F.col("__m").isNotNull(), F.struct(*(c.cast("double").alias(n) for n, c in values.items()))) for name, values in (("visual", visual), ("edge", edge), ("corner", corner))}
    return d.withColumns(made).drop("__m")
