"""Phrase table x corpus: which notices hold which phrases."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeboard.functions.text import overlaps_itself, spaced
from noticeboard.operators.sizing import BROADCAST_BYTES, BROADCAST_ROWS, is_small
from noticeboard.session import settled


def _word_pairs(token_list):
    """Adjacent word pairs 'a  b', spaced like the phrase text."""
    rest = F.slice(token_list, F.lit(2), F.greatest(F.size(token_list) - 1, F.lit(0)))
    starts = F.slice(token_list, F.lit(1), F.greatest(F.size(token_list) - 1, F.lit(0)))
    return F.zip_with(starts, rest, lambda a, b: F.concat(a, F.lit("  "), b))


def anchored(phrases: DataFrame, words_col: str = "words") -> DataFrame:
    """Adds `phrase` (spaced text), `overlaps` and `anchor`: the adjacent word pair - or the word of a one-word
    phrase - that the fewest phrases of the table share, so one corpus word pair leads to few
    phrases. Phrases without words match nothing and drop out."""
    usable = (phrases.filter(F.size(words_col) > 0)
              .withColumn("phrase", spaced(F.col(words_col)))
              .withColumn("overlaps", overlaps_itself(F.col(words_col))))
    pieces = usable.select("phrase", F.explode(F.array_distinct(
        F.when(F.size(words_col) == 1, F.col(words_col))
        .otherwise(_word_pairs(F.col(words_col))))).alias("piece"))
    shared = pieces.groupBy("piece").agg(F.count("*").alias("n_sharing"))
    anchors = (pieces.join(shared, "piece").groupBy("phrase")
               .agg(F.min(F.struct("n_sharing", -F.length("piece"), "piece")).alias("pick"))
               .select("phrase", F.col("pick.piece").alias("anchor")))
    return usable.join(anchors, "phrase")


def match_phrases(notices: DataFrame, phrases: DataFrame, words_col: str = "words",
                  max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every (notice, phrase row) pair in which the phrase occurs, all columns of both sides, plus
    `spaced_text` of the notice and the columns of `anchored`, which is applied where the caller has
    not done so.

    Each notice emits its distinct words and word pairs; they meet the phrase anchors in an equi
    join and the whole phrase is then checked in the row. A phrase table within the checked bounds
    is broadcast, so the corpus is read once and never shuffled. Beyond them the words meet the
    anchors in a shuffled join of narrow rows, and only candidate pairs go back to the texts.
    """
    table = phrases if "anchor" in phrases.columns else settled(anchored(phrases, words_col), "phrases")
    small = is_small(table, F.length(F.to_json(F.struct("*"))), max_rows, max_bytes)
    texts = notices.withColumn("spaced_text", spaced(F.col("tokens")))
    single = table.filter(F.size(words_col) > 1).isEmpty()      # then no anchor is a pair
    keys = F.array_distinct(F.col("tokens") if single else F.concat(F.col("tokens"), _word_pairs(F.col("tokens"))))
    holds = F.contains(F.col("spaced_text"), F.col("phrase"))
    if small:
        return (texts.withColumn("_key", F.explode(keys))
                .join(F.broadcast(table), (F.col("_key") == F.col("anchor")) & holds)
                .drop("_key", "anchor"))
    candidates = (notices.select("id", F.explode(keys).alias("_key"))
                  .join(table, F.col("_key") == F.col("anchor")).drop("_key", "anchor"))
    return texts.join(candidates, "id").filter(holds)
