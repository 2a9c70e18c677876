"""The notice-type dimension."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeboard.fixed_values import NOTICE_TYPES
from noticeboard.operators.sizing import is_small
from noticeboard.schema import NOTICE_TYPES as TYPES_SCHEMA


def notice_types(spark: SparkSession) -> DataFrame:
    """The fixed type table (27 rows)."""
    return spark.createDataFrame(NOTICE_TYPES, TYPES_SCHEMA)


def with_labels(df: DataFrame, types: DataFrame) -> DataFrame:
    """Adds `type`, the label of the code, or the code itself when it is unknown."""
    labels = types.select("code", "label")
    if is_small(labels, F.length("code") + F.length("label")):
        labels = F.broadcast(labels)
    return (df.join(labels, "code", "left")
            .withColumn("type", F.coalesce("label", "code")).drop("label"))
