"""Making the package importable in Spark's Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers find this package also where the driver only has it on ``sys.path``.

    That serves sessions whose workers share the driver's disk; on other clusters the package is installed or sent by
    ``--py-files``.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def compilable(spark: SparkSession) -> SparkSession:
    """``spark``, which cuts what it generates into methods that the JVM compiles.

    HotSpot only interprets methods of over 8,000 bytes, such as whole stages of many rules become; Spark's default lets
    them grow to 65,535.  The setting holds for the session; one that differs from the default is left as it is.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, "65535") == "65535":
        spark.conf.set(limit, "8000")
    return spark
