"""Mixing sources to target weights by pivotal dependent rounding.

Sizes and targets:
    size        words [^\\x20\\x09-\\x0D]+ of a document's text (null: 0); source_size: its source's sum
    weights     sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ...
    targets     all sizes together are shared by weight; a source's target stops at CAP times its size, and what
                lies above is shared again by weight among the others, until no target is above its cap
                (water filling; each round caps every source above the level at once, which the final level keeps)
    rate        target / source_size (0 for a source of size 0), at most CAP; copies of a document: floor(rate)
                plus one with probability frac(rate)
    taken       copies times size: the words the mix takes, repeats counted

Dependent rounding: within a group, documents sorted by size (largest first) take part in the ordered pivotal
method: two fractional units meet, mass moves between them in word units, up or down at random with chances that
keep each one's expectation, until one of them is 0 or 1; the other goes on. The words of the fractional parts
stay exactly as they were, so a source's taken words miss its target by less than the size of its last residual,
one document, usually a small one. A group leaves at most one fractional unit, its residual; residuals of FAN groups meet in the next level of a reduction tree until one per source is left, which
a last draw settles. Groups hold at most GROUP_ROWS rows (a hot source is split into many), so no task holds a
whole source. Random draws come from generators seeded by (source, level, group): reruns agree, and so does a
task run again after a lost executor.

Nulls and ties: null text has size 0 and takes nothing; null sources are one source, ordered last; repeated rows
and ids are separate documents; an empty table gives no rows. Extra columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from noticeboard.llm.tables import small_side, stored

# Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3.0

GROUP_ROWS = 50_000   # rows of one pivotal group
FAN = 16              # residuals that meet in one group of the next level
SEED = 20240611
EPS = 1e-9


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, weight, _rank (from 0). Ranks by code point order (null last) come from a range
    partitioned sort, per-partition counts and their running offsets; no window spans all sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    local = ordered.withColumn("_local", F.row_number().over(
        Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())))
    local = stored(local, "op12-sources")
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))     # one row per partition
    offsets = counts.withColumn("_offset", F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_offset"])
    rank = F.col("_offset") + F.col("_local") - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    return local.join(F.broadcast(offsets.select("_part", "_offset")), "_part").select(
        "source", "source_size", weight.cast("double").alias("weight"), rank.alias("_rank"))


def water_fill(sources: DataFrame) -> DataFrame:
    """sources(source, source_size, weight) with target: all sizes shared by weight, each at most CAP times its
    source's size. Only a level and counts pass through the driver per round."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    while True:
        state = sources.withColumn("_capped", capped)
        fixed, free = state.agg(
            F.sum(F.when(F.col("_capped"), F.col("source_size") * CAP).otherwise(0.0)),
            F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight")))).first()
        level = (total - (fixed or 0.0)) / free if free else 0.0
        over = state.filter(~F.col("_capped") & (F.col("weight") * level > F.col("source_size") * CAP)).limit(1).count()
        if not over:
            return state.select("source", "source_size", "weight", "_rank", F.when(
                F.col("_capped"), F.col("source_size") * CAP).otherwise(F.col("weight") * F.lit(level)).alias("target"))
        capped = capped | (F.col("weight") * F.lit(level) > F.col("source_size") * CAP)


def _pivot(p: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Ordered pivotal method over probabilities p of units of the given words: (values where all but at most one
    unit, the residual, are 0 or 1; the residual's index or -1). Each step moves mass between the carried unit
    and the next one in word units, up or down at random with the chances that keep both expectations, until one
    of the two is 0 or 1: the sum of words times p stays exactly, and every unit keeps its own expectation."""
    p = p.astype(np.float64).copy()
    carry = -1
    for j in range(len(p)):
        if p[j] <= EPS or p[j] >= 1 - EPS:
            p[j] = round(p[j])
            continue
        if carry < 0:
            carry = j
            continue
        a, b, ratio = p[carry], p[j], words[carry] / words[j]
        up = min(1 - a, b / ratio)          # carried unit up, the next one down by ratio times as much
        down = min(a, (1 - b) / ratio)      # carried unit down, the next one up
        if rng.random() * (up + down) < down:
            a, b = a + up, b - up * ratio
        else:
            a, b = a - down, b + down * ratio
        p[carry], p[j] = a, b
        for i in (carry, j):
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = round(p[i])
        carry = -1 if p[carry] in (0.0, 1.0) and p[j] in (0.0, 1.0) else (carry if p[j] in (0.0, 1.0) else j)
    return p, carry


def _settle(level: int):
    def settle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rank, group = int(key[0]), int(key[1])
        # Largest first: the residual that a group leaves is one of its smallest documents.
        pdf = pdf.sort_values(["size", "doc_id", "_key"], ascending=[False, True, True], na_position="last",
                              kind="stable")
        rng = np.random.default_rng([SEED, rank, level, group & 0x7FFFFFFF, group >> 31 & 0x7FFFFFFF])
        p, _ = _pivot(pdf["_p"].to_numpy(), pdf["size"].to_numpy(np.float64), rng)
        return pdf.assign(_p=p)
    return settle


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken (see the module's notes)."""
    sized = docs.select("doc_id", "source", F.size(F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("_key"))
    sized = stored(sized, "op12-sizes")
    sources = water_fill(ranked_sources(sized))
    sources = small_side(stored(sources, "op12-targets"))
    rate = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(CAP))
    units = (sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
             .drop(sources["source"])
             .withColumn("_rate", rate)
             .withColumn("_base", F.floor("_rate").cast("long"))
             .withColumn("_p", F.when(F.col("size") > 0, F.col("_rate") - F.col("_base")).otherwise(0.0)))
    counts = units.groupBy("_rank").agg(F.count("*").alias("_n"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("_n") / GROUP_ROWS))
    units = units.join(small_side(counts), "_rank").withColumn("_group", F.pmod(F.col("_key"), groups)).drop("_n")
    schema = units.schema
    settled, level = [], 0
    pending = stored(units, "op12-units")
    while True:
        done = stored(pending.groupBy("_rank", "_group").applyInPandas(_settle(level), schema), f"op12-level{level}")
        fractional = (F.col("_p") > EPS) & (F.col("_p") < 1 - EPS)
        settled.append(done.filter(~fractional))
        pending = done.filter(fractional)
        if pending.agg(F.max("_group")).first()[0] in (None, 0):
            break
        pending = pending.withColumn("_group", F.floor(F.col("_group") / FAN).cast("long"))
        level += 1
    # The last residual of a source: one draw, seeded by the source and the row.
    last = pending.withColumn("_u", (F.abs(F.xxhash64(F.lit(SEED), "_rank", "_key")) % 1_000_000_007) / 1_000_000_007.0)
    last = last.withColumn("_p", F.when(F.col("_u") < F.col("_p"), 1.0).otherwise(0.0)).drop("_u")
    out = settled[0]
    for more in settled[1:] + [last]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target",
                      ((F.col("_base") + F.round("_p").cast("long")) * F.col("size")).alias("taken"))
