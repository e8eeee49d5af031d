"""Scans of image folders and catalogues."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pricing import market_prices

SUFFIXES = ("jpg", "jpeg", "png", "webp")


def listed(path: str | Column) -> Column:
    """Whether a path ends like an image, in either case."""
    return F.lower(F.col(path) if isinstance(path, str) else path).rlike(rf"\.({'|'.join(SUFFIXES)})$")


def index(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, label and names of every image below ``root``; nothing is decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return with_names(files.where(listed("path")), root)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: origin, label and names, and height, width, nChannels, data.  Files that do not decode keep a row with nChannels -1."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root).select("image.*")
    return with_names(rows.withColumnRenamed("origin", "path").where(listed("path")), root)


def with_names(df: DataFrame, root: str) -> DataFrame:
    """``df`` with relative_path, image_filename, image_id (the name without suffix) and label (the first folder, or "unknown")."""
    base = urlsplit(root).path.rstrip("/")
    # a root from "/" is stripped whole, whatever scheme and authority stand before it; another one at its first occurrence
    head = r"^(?:[A-Za-z][\w+.-]*:(?://[^/]*)?)?" if base.startswith("/") else r"^.*?/"
    rel = F.regexp_extract("path", f"{head}{re.escape(base)}/(.*)$", 1) if base else F.col("path")
    name = F.element_at(F.split("relative_path", "/"), -1)
    return df.withColumn("relative_path", rel).withColumns({"image_filename": name, "image_id": F.regexp_replace(name, r"\.[^.]*$", ""), "label": label_of("relative_path")})


def label_of(path: str | Column) -> Column:
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.when(F.size(parts) >= 2, F.lower(F.trim(parts[0]))).otherwise("unknown")


#: A card as catalogues describe it; fields that come in several spellings are told apart in ``cards``.
CARD_FIELDS = ("id", "name", "set_id", "set_name", "number", "rarity", "type", "hp", "description", "image", "illustrator", "abilities", "attacks", "prices")


def cards(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Catalogue rows from JSON texts that hold one card, a list of cards or an object with a list in ``data``.

    Elements that are no object, and texts that are no JSON, are left out.
    """
    v = payloads.select(F.try_parse_json(column).alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    one = v.where(F.col("v").isNotNull()).select(F.explode(items).alias("c")).where(F.schema_of_variant("c").startswith("OBJECT"))
    field = lambda *paths: F.coalesce(*(F.try_variant_get("c", p, "string") for p in paths))
    return one.select(
        field("$.id").alias("id"), field("$.name").alias("name"), field("$.set.id", "$.setId").alias("set_id"), field("$.set.name", "$.setName").alias("set_name"),
        field("$.localId", "$.cardNumber").alias("number"), field("$.rarity").alias("rarity"), field("$.types[0]", "$.type").alias("type"), F.try_variant_get("c", "$.hp", "int").alias("hp"),
        field("$.description").alias("description"), field("$.image.high", "$.image").alias("image"), field("$.illustrator").alias("illustrator"),
        *(F.try_variant_get("c", f"$.{n}", "variant").cast("string").alias(n) for n in ("abilities", "attacks")),
        F.coalesce(F.try_variant_get("c", "$.pricing", "variant"), F.try_variant_get("c", "$.prices", "variant")).cast("string").alias("prices"),
    )


def shown(cards: DataFrame, colours: dict[str, str] | None = None, other: str = "#999999") -> DataFrame:
    """Catalogue rows as an application shows them: Spanish names, the colour of the type, and the prices of both markets."""
    colour = F.lit(other)
    for kind, value in (colours or {}).items():
        colour = F.when(F.col("type") == kind, value).otherwise(colour)
    names = {"id": "id", "name": "nombre", "number": "numero", "set_name": "set", "rarity": "rareza", "type": "tipo_pokemon", "hp": "hp", "illustrator": "ilustrador", "description": "descripcion", "image": "imagen_url", "abilities": "habilidades", "attacks": "ataques"}
    markets = F.struct(*(c.alias(m) for m, c in market_prices(F.col("prices")).items()))
    return cards.select(*(F.col(a).alias(b) for a, b in names.items()), colour.alias("tipo_color"), markets.alias("mercado"))


CSV_PREDICTIONS = T.StructType([T.StructField("y_true", T.IntegerType()), T.StructField("y_pred", T.IntegerType()), T.StructField("y_prob_damaged", T.DoubleType())])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CSV_PREDICTIONS).csv(path, header=True)
