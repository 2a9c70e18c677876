"""Keeping the notices table current: upserts and write-backs as joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeboard.schema import ANNOTATION_COLUMNS, RAW_COLUMNS


def latest_per_id(batch: DataFrame, seq: list[str]) -> DataFrame:
    """Last record of each id in arrival order. max_by combines map-side, so an id repeated in a
    third of the batch shuffles one row per task."""
    others = [c for c in batch.columns if c != "id" and c not in seq]
    return (batch.groupBy("id")
            .agg(F.max_by(F.struct(*others), F.struct(*seq)).alias("r"))
            .select("id", *[F.col(f"r.{c}").alias(c) for c in others]))


def upsert(target: DataFrame, batch: DataFrame, seq: list[str], now: Column | None = None,
           reset_on_change: bool = False) -> DataFrame:
    """The table after a batch: raw columns come from the batch's last record of an id, everything
    else is kept; new ids start unannotated. reset_on_change sends rows whose body changed back to
    annotation."""
    raw = [c for c in RAW_COLUMNS if c != "id"]
    new = latest_per_id(batch.select("id", *raw, *seq), seq).withColumn("_in", F.lit(True))
    old = target.withColumn("_had", F.lit(True))
    joined = old.alias("o").join(new.alias("n"), "id", "full_outer")
    touched, had = F.col("n._in").isNotNull(), F.col("o._had").isNotNull()
    changed = touched & had & ~F.col("o.fulltext").eqNullSafe(F.col("n.fulltext"))
    columns = [F.col("id")]
    for name in target.columns:
        if name == "id":
            continue
        if name in raw:
            value = F.when(touched, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        elif name == "loaded_at":
            value = F.coalesce(F.col("o.loaded_at"), F.current_timestamp() if now is None else now)
        elif reset_on_change and name in (*ANNOTATION_COLUMNS, "embedding"):
            value = F.when(~changed, F.col(f"o.{name}"))
        else:
            value = F.col(f"o.{name}")
        columns.append(value.alias(name))
    return joined.select(*columns)


def apply_annotations(notices: DataFrame, annotations: DataFrame) -> DataFrame:
    """Write-back of annotations to the rows still pending; annotated rows never change."""
    joined = notices.alias("o").join(annotations.alias("a"), "id", "left")
    fill = F.col("o.enriched_at").isNull() & F.col("a.enriched_at").isNotNull()
    return joined.select("id", *[
        (F.when(fill, F.col(f"a.{c}")).otherwise(F.col(f"o.{c}"))
         if c in ANNOTATION_COLUMNS else F.col(f"o.{c}")).alias(c)
        for c in notices.columns if c != "id"])


def apply_vectors(notices: DataFrame, vectors: DataFrame) -> DataFrame:
    """Write-back of vectors to rows that have none."""
    joined = notices.alias("o").join(vectors.alias("v"), "id", "left")
    return joined.select("id", *[
        (F.coalesce(F.col("o.embedding"), F.col("v.embedding")) if c == "embedding"
         else F.col(f"o.{c}")).alias(c) for c in notices.columns if c != "id"])
