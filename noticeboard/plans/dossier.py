"""Entity dossier: timeline, the notice that matters most, and who else is involved."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeboard.operators.entities import related, timeline
from noticeboard.session import settled


def key_notice(timelines: DataFrame) -> DataFrame:
    """Per entity the most significant notice of its timeline; ties go to the newest, then the id."""
    weight = F.struct(F.coalesce("significance", F.lit(-1)), F.coalesce("date", F.lit("")), "id")
    return timelines.groupBy("entity_id").agg(
        F.max_by("id", weight).alias("id"), F.count("*").alias("n_notices"))


def dossier(notices: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per (entity, related notice); an entity without related notices keeps one row."""
    # One narrow row per entity, used as seeds and again for the result: written once.
    picked = settled(key_notice(timeline(notices, entities)), "key-notices")
    links = related(notices, picked.select("id").distinct()).select(
        F.col("seed_id").alias("id"), F.col("id").alias("related_id"),
        F.col("rank").alias("related_rank"))
    detail = notices.select("id", "headline", F.col("event_category").alias("category"),
                            F.col("significance_score").alias("significance"))
    return (picked.join(detail, "id").join(links, "id", "left")
            .select("entity_id", "n_notices", F.col("id").alias("notice_id"), "headline", "category",
                    "significance", "related_rank", "related_id"))
