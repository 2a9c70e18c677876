"""Company timelines and related parties for tables of entities and seeds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeboard.fixed_values import RELATED_LIMIT, TIMELINE_LIMIT
from noticeboard.operators.filters import name_like
from noticeboard.operators.sizing import is_small
from noticeboard.operators.topn import first_n, newest_first, oldest_first
from noticeboard.session import settled


def compact(df: DataFrame, keep_title: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """The scannable fields under their short names, the day as text."""
    columns = [F.col(c) for c in extra] + [
        F.col("id"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("headline"),
        F.col("event_category").alias("category"), F.col("significance_score").alias("significance")]
    if keep_title:
        columns.append(F.col("title").alias("name"))
    return df.select(*columns)


_TIMELINE_COLUMNS = ["id", "date", "headline", "event_category", "significance_score", "title"]


def _timeline_by_key(notices: DataFrame, entities: DataFrame, key: str, k: int) -> DataFrame:
    """First k notices of each wanted key, then the entities that asked for it. Cutting before the
    join keeps a key with a third of all notices, asked for many times, at k rows per entity."""
    wanted = entities.select("entity_id", F.col(key).alias("_key"))
    rows = (notices.select(F.col(key).alias("_key"), *_TIMELINE_COLUMNS)
            .join(wanted.select("_key").distinct(), "_key", "left_semi"))
    return first_n(rows, ["_key"], oldest_first(), k).join(wanted, "_key").drop("_key")


def _literal_runs(name: Column) -> Column:
    """The stretches of a name pattern that must occur literally, lower-cased."""
    return F.filter(F.split(F.lower(name), r"\\.?|[%_]"), lambda s: s != "")


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                         lambda i: F.substring(text, i, F.lit(n)))) \
        .otherwise(F.array().cast("array<string>"))


def _gram_keys(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct character grams of a title; the empty key stands for 'any title'."""
    keys = F.array(F.lit("")) if 0 in sizes else F.array().cast("array<string>")
    for n in sizes:
        if n:
            keys = F.concat(keys, _grams(text, n))
    return F.array_distinct(keys)


LONGEST_GRAM = 64


def _gram_size(run: str) -> Column:
    """Length of the grams a literal run is looked up by: its own up to 3, then the largest power of two in it."""
    return F.expr(f"CASE WHEN length({run}) < 4 THEN length({run}) "
                  f"ELSE least({LONGEST_GRAM}, shiftleft(1, length(bin(length({run}))) - 1)) END")


def name_candidates(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(name, title) pairs, once each, that hold every pair with the name inside the title; names and titles distinct.

    A title can only hold a name if it holds the name's character grams, so each name is looked up
    by one gram - the one the fewest titles have. Grams are as long as a
    power of two allows, so that candidates follow the matches: the titles that share three letters
    grow with the table, those that share half of a name or more are few. A title emits grams of the
    sizes in use only; a name without any literal character meets every title.
    """
    longest = F.reduce(_literal_runs(F.col("name")), F.lit(""),
                       lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best))
    sized = names.withColumn("_run", longest).withColumn("_n", _gram_size("_run"))
    sizes = tuple(sorted(r["_n"] for r in sized.select("_n").distinct().collect()))    # 0 to 3, powers of two
    by_size = F.array(F.lit(""))
    for n in filter(None, sizes):
        by_size = F.when(F.col("_n") == n, _grams(F.col("_run"), n)).otherwise(by_size)
    name_grams = sized.select("name", F.explode(F.array_distinct(by_size)).alias("_gram"))
    title_grams = titles.select("title", F.explode(_gram_keys(F.lower("title"), sizes)).alias("_gram"))

    wanted = name_grams.select("_gram").distinct()
    frequency = (title_grams.join(wanted, "_gram", "left_semi").groupBy("_gram")
                 .agg(F.count("*").alias("n_titles")))
    anchors = (name_grams.join(frequency, "_gram", "left")
               .groupBy("name").agg(F.min(F.struct(F.coalesce("n_titles", F.lit(0)).alias("n"),
                                                   "_gram")).alias("pick"))
               .filter(F.col("pick.n") > 0)
               .select("name", F.col("pick._gram").alias("_gram")))
    if is_small(names, 4 * F.length("name") + F.lit(64)):
        anchors = F.broadcast(anchors)      # one row per name, so within the same bound
    return title_grams.join(anchors, "_gram").select("name", "title")


def match_names(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(name, title) pairs with the name inside the title, over distinct names and titles."""
    return name_candidates(titles, names).filter(name_like(F.col("title"), F.col("name")))


def _timeline_by_name(notices: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    names = entities.select("name").distinct()
    rows = notices.filter(F.col("title").isNotNull()).select(*_TIMELINE_COLUMNS)
    pairs = match_names(rows.select("title").distinct(), names)
    per_title = first_n(rows, ["title"], oldest_first(), k, rank="_title_rank").drop("_title_rank")
    per_name = first_n(per_title.join(pairs, "title"), ["name"], oldest_first(), k)
    return per_name.join(entities.select("entity_id", "name"), "name").drop("name")


def timeline(notices: DataFrame, entities: DataFrame, k: int = TIMELINE_LIMIT) -> DataFrame:
    """Each entity's first k notices, oldest first. Match by nzbn, else company number, else name;
    an entity with none of them has no timeline.

    entities: entity_id, nzbn, company_number, name. Adds entity_id and `rank`.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    by_nzbn = entities.filter(given("nzbn"))
    by_number = entities.filter(~given("nzbn") & given("company_number"))
    by_name = entities.filter(~given("nzbn") & ~given("company_number") & given("name"))
    found = (_timeline_by_key(notices, by_nzbn, "nzbn", k)
             .unionByName(_timeline_by_key(notices, by_number, "company_number", k))
             .unionByName(_timeline_by_name(notices, by_name, k)))
    return compact(found, keep_title=True, extra=("entity_id", "rank"))


def party_postings(notices: DataFrame) -> DataFrame:
    """One row per (party, notice)."""
    parties = F.array_distinct(F.array_compact(F.col("affected_parties")))
    return notices.select(F.explode(parties).alias("party"), "id", "date")


def related(notices: DataFrame, seeds: DataFrame, k: int = RELATED_LIMIT) -> DataFrame:
    """Other notices naming any party of each seed notice, once each, newest first, k per seed.

    Of one party only its newest k+1 notices can reach any seed's list (one of them may be the seed
    itself), so postings are cut to that before they meet the seeds. A party named in a third of
    all notices costs k+1 keys per seed, not all its notices, and a seed's lists merge in its row.
    The kept notices are numbered in the order of the lists: lists hold 8-byte numbers, and only the
    kept notices' columns meet the winners. The seeds are laid out by id before their parties' lists
    are handed to them, so that lists within the broadcast bounds are merged without a shuffle.

    seeds: id. Result: seed_id, rank and the compact columns.
    """
    rows = settled(notices.select("id", "date", "headline", "event_category", "significance_score",
                                  "affected_parties"), "related-notices")
    kept = settled(first_n(party_postings(rows), ["party"], newest_first(), k + 1)
                   .filter(F.col("id").isNotNull()).select("party", "id", "date"), "party-newest")
    numbered = settled(kept.select("id", "date").distinct().orderBy(*newest_first())
                       .withColumn("_no", F.monotonically_increasing_id()), "numbered")
    same = (F.col("a.id") == F.col("b.id")) & F.col("a.date").eqNullSafe(F.col("b.date"))
    newest = settled(kept.alias("a").join(numbered.alias("b"), same).groupBy("party")
                     .agg(F.collect_list("_no").alias("newest")), "party-lists")               # k + 1 at most
    own = numbered.groupBy("id").agg(F.collect_list("_no").alias("own"))
    asked = (rows.select("id", "date", "affected_parties")
             .join(seeds.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
             .join(own.hint("shuffle_hash"), "id", "left"))
    parties = F.array_distinct(F.array_compact(F.col("affected_parties")))
    seed_parties = asked.select(F.col("id").alias("seed_id"), "own", F.explode(parties).alias("party"))
    small = is_small(newest, 8 * F.size("newest") + 4 * F.length("party"))
    met = (seed_parties.join(F.broadcast(newest) if small else newest.hint("shuffle_hash"), "party").groupBy("seed_id")
           .agg(F.flatten(F.collect_list("newest")).alias("met"), F.first("own").alias("own")))
    others = F.array_except("met", F.coalesce("own", F.array().cast("array<bigint>")))      # distinct as well
    best = met.select("seed_id", F.posexplode(F.slice(F.sort_array(others), 1, k)).alias("pos", "_no"))
    best = best.select("seed_id", (F.col("pos") + 1).alias("rank"), "_no")
    wide = numbered.select("id", "_no").join(rows.drop("affected_parties"), "id")
    return compact(best.join(wide.hint("shuffle_hash"), "_no"), extra=("seed_id", "rank"))
