"""Notices, requests and logs read from the test tables, and the same as SQL.

Each Spark fixture has a common table expression of the same name in FIXTURE_SQL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeboard.fixed_values import ACTION_TYPES, EVENT_CATEGORIES, NOTICE_TYPES
from noticeboard.functions.text import tokens, words
from noticeboard.session import spread

TYPE_CODES = [row[0] for row in NOTICE_TYPES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotated notices."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("doc_id")
    rows = spread(d.select("doc_id", "text", "lang", "source")).join(l, "doc_id", "left").select(
        n.cast("string").alias("id"), n, F.col("lang").alias("code"), F.col("source").alias("type"),
        F.when(n % 50 != 0, F.date_add(F.lit("2000-01-01").cast("date"), (n % 9000).cast("int")))
        .alias("date"),
        F.concat_ws(" ", "source", "lang", n.cast("string")).alias("title"),
        F.col("text").alias("fulltext"),
        _pick(EVENT_CATEGORIES, n % 13).alias("event_category"),
        _pick(ACTION_TYPES, n % 16).alias("action_taken"),
        (F.col("quality") * 60 + F.col("toxic") * 30).alias("significance_score"))
    return rows.withColumns({
        "headline": F.col("title"), "tokens": tokens(F.col("title"), F.col("fulltext"))})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices: the customer is the subject, the suppliers are the parties."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    names = (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
             .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy("l_orderkey").agg(F.sort_array(F.collect_set("s_name")).alias("affected_parties")))
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(names, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(F.col("o_orderkey").cast("string").alias("id"),
                    F.col("o_orderdate").cast("date").alias("date"),
                    F.col("o_custkey").cast("string").alias("nzbn"),
                    F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("company_number"),
                    F.col("c_name").alias("title"), F.col("o_orderpriority").alias("event_category"),
                    F.col("o_orderstatus").alias("action_taken"),
                    F.concat_ws(" ", "o_orderstatus", "c_name").alias("headline"),
                    F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000)).cast("int")
                    .alias("significance_score"), "affected_parties"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities; the segment decides which keys an entity carries."""
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        F.when(segment.isin("BUILDING", "HOUSEHOLD"), key).alias("nzbn"),
        F.when(segment.isin("AUTOMOBILE", "HOUSEHOLD"), F.concat(F.lit("C"), key))
        .alias("company_number"),
        F.when(segment.isin("MACHINERY", "HOUSEHOLD", "BUILDING"), F.lower("c_name"))
        .when(segment == "FURNITURE", F.lit("")).alias("name"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the benchmark passages as a search request."""
    item = F.col("item_id")
    pieces = table(spark, sf_dir, "benchmark").select(
        item, F.posexplode(F.split("text", r"[.\n]+")).alias("pos", "piece"))
    return pieces.filter(F.trim("piece") != "").select(
        (item * 1000 + F.col("pos")).alias("query_id"), F.trim("piece").alias("q"),
        (5 + item % 20).cast("int").alias("limit"),
        F.when(item % 7 == 3, _pick(EVENT_CATEGORIES, item % 13)).alias("event_category"),
        F.when(item % 11 == 4, _pick(ACTION_TYPES, item % 16)).otherwise(F.lit(""))
        .alias("action_taken"),
        F.when(item % 4 == 1, F.lit("en")).alias("code"),
        F.when(item % 5 == 2, F.lit("2000-06-01").cast("date")).alias("date_from"),
        F.when(item % 6 == 2, F.lit("2024-06-30").cast("date")).alias("date_to"),
        F.when(item % 3 == 0, F.lit(0)).alias("min_significance"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("ip"), F.col("event_type").alias("route"),
        "value", "props")


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = log(spark, sf_dir), F.col("event_id")
    return e.select(
        "event_id", "ts", "route",
        F.when(n % 3 == 0, F.concat("ip", F.lit(".1.2.3, 10.0.0.1"))).when(n % 3 == 1, F.lit(""))
        .alias("forwarded"),
        F.when(n % 5 != 0, F.concat(F.lit("peer-"), "ip")).alias("peer"),
        F.lit(None).cast("string").alias("country"), F.repeat("route", 60).alias("ua"),
        F.lit(None).cast("string").alias("referer"), F.col("props").alias("request"),
        F.lit(None).cast("string").alias("response"), F.lit(200).alias("status"),
        F.floor("value").alias("ms"), F.repeat("props", 60).alias("error"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as research runs, one row per step."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), "role", "text")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a run's steps stand for the notices it read."""
    return runs(spark, sf_dir).select("run_id", "step", F.explode(words(F.col("text"))).alias("id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landed records: list and string bodies, with and without identifiers."""
    n = F.col("doc_id")
    tail = F.when(n % 2 == 0, F.concat(F.lit(" NZBN: "), F.lpad(n.cast("string"), 13, "0"))) \
        .otherwise(F.concat(F.lit(" Company No.: WN. "), n.cast("string")))
    year = 2000 + n % 25
    number = F.concat(F.lit("Notice Number: "), year.cast("string"), F.lit("-"),
                      _pick([c.upper() for c in TYPE_CODES], n % 27), n.cast("string"))
    has_number = n % 97 != 0
    return spread(table(spark, sf_dir, "documents")).select(
        n.alias("doc_id"), year.cast("int").alias("year"),
        F.when(has_number, F.array(F.concat(F.lit("Issue Number: "), n.cast("string")), number))
        .alias("dc_identifier"),
        F.concat_ws(" ", "source", "lang", n.cast("string")).alias("title"),
        F.array(F.when(n % 50 == 0, F.lit("unknown")).otherwise(F.concat(
            F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (n % 9000).cast("int")),
                          "yyyy-MM-dd"), F.lit(" 12:00:00 UTC")))).alias("date"),
        F.concat(F.lit("http://notices.example/"), n.cast("string")).alias("landing_url"),
        F.concat("text", tail).alias("body"), (n % 3).alias("shape"))


# JSON of a landed record: the body is a list, a string, or an empty text plus a description.
def record_json(df: DataFrame) -> DataFrame:
    body, shape = F.col("body"), F.col("shape")
    common = ["dc_identifier", "title", "date", "landing_url"]
    as_list = F.to_json(F.struct(*common, F.array(body).alias("fulltext")))
    as_text = F.to_json(F.struct(*common, body.alias("fulltext")))
    described = F.to_json(F.struct(*common, F.lit("").alias("fulltext"), body.alias("description")))
    return df.withColumn("json", F.when(shape == 0, as_list).when(shape == 1, as_text)
                         .otherwise(described))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in the shape a page scan returns."""
    schema = ("dc_identifier array<string>, title string, date array<string>, landing_url string, "
              "fulltext variant, description variant")
    return (record_json(records(spark, sf_dir))
            .select("doc_id", "year", F.from_json("json", schema).alias("r"))
            .select("doc_id", "year", "r.*"))


WORDS = r"'[\p{L}\p{N}]+'"

FIXTURE_SQL = {
    "docs": f"""docs AS (
        SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.lang AS code, d.source AS type,
               CASE WHEN d.doc_id % 50 <> 0
                    THEN DATE '2000-01-01' + CAST(d.doc_id % 9000 AS INTEGER) END AS date,
               d.source || ' ' || d.lang || ' ' || CAST(d.doc_id AS VARCHAR) AS title,
               d.source || ' ' || d.lang || ' ' || CAST(d.doc_id AS VARCHAR) AS headline,
               d.text AS fulltext,
               ({_sql_list(EVENT_CATEGORIES)})[CAST(d.doc_id % 13 AS INTEGER) + 1] AS event_category,
               ({_sql_list(ACTION_TYPES)})[CAST(d.doc_id % 16 AS INTEGER) + 1] AS action_taken,
               l.quality * 60 + l.toxic * 30 AS significance_score,
               regexp_extract_all(lower(d.source || ' ' || d.lang || ' ' ||
                   CAST(d.doc_id AS VARCHAR) || ' ' || d.text), {WORDS}) AS tokens
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "orders_n": """orders_n AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS date,
               CAST(o_custkey AS VARCHAR) AS nzbn, 'C' || CAST(o_custkey AS VARCHAR) AS company_number,
               c_name AS title, o_orderpriority AS event_category, o_orderstatus AS action_taken,
               o_orderstatus || ' ' || c_name AS headline,
               CAST(least(100, floor(o_totalprice / 5000)) AS INTEGER) AS significance_score
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "postings": """postings AS (
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, s_name AS party
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "entities": """entities AS (
        SELECT c_custkey AS entity_id,
               CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN CAST(c_custkey AS VARCHAR) END AS nzbn,
               CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')
                    THEN 'C' || CAST(c_custkey AS VARCHAR) END AS company_number,
               CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD', 'BUILDING') THEN lower(c_name)
                    WHEN c_mktsegment = 'FURNITURE' THEN '' END AS name
        FROM customer)""",
    "requests": f"""pieces AS (
        SELECT item_id, unnest(range(len(p))) AS pos, unnest(p) AS piece
        FROM (SELECT item_id, regexp_split_to_array(text, '[.\\n]+') AS p FROM benchmark)),
    requests AS (
        SELECT item_id * 1000 + pos AS query_id, trim(piece) AS q,
               CAST(5 + item_id % 20 AS INTEGER) AS k,
               CASE WHEN item_id % 7 = 3
                    THEN ({_sql_list(EVENT_CATEGORIES)})[CAST(item_id % 13 AS INTEGER) + 1] END AS f_category,
               CASE WHEN item_id % 11 = 4
                    THEN ({_sql_list(ACTION_TYPES)})[CAST(item_id % 16 AS INTEGER) + 1] END AS f_action,
               CASE WHEN item_id % 4 = 1 THEN 'en' END AS f_code,
               CASE WHEN item_id % 5 = 2 THEN DATE '2000-06-01' END AS f_from,
               CASE WHEN item_id % 6 = 2 THEN DATE '2024-06-30' END AS f_to,
               CASE WHEN item_id % 3 = 0 THEN 0 END AS f_sig
        FROM pieces WHERE trim(piece) <> '')""",
    "citations": f"""citations AS (
        SELECT conv_id AS run_id, turn AS step,
               unnest(regexp_extract_all(lower(text), {WORDS})) AS id FROM conversations)""",
    "notices": f"""notices AS (
        SELECT doc_id, 2000 + doc_id % 25 AS year,
               lower(CAST(2000 + doc_id % 25 AS VARCHAR) || '-' || code || CAST(doc_id AS VARCHAR)) AS id,
               code, label AS type,
               CASE WHEN doc_id % 50 <> 0
                    THEN DATE '2000-01-01' + CAST(doc_id % 9000 AS INTEGER) END AS date,
               source || ' ' || lang || ' ' || CAST(doc_id AS VARCHAR) AS title,
               CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 13, '0') END AS nzbn,
               CASE WHEN doc_id % 2 = 1 THEN 'WN. ' || CAST(doc_id AS VARCHAR) END AS company_number,
               text || CASE WHEN doc_id % 2 = 0 THEN ' NZBN: ' || lpad(CAST(doc_id AS VARCHAR), 13, '0')
                            ELSE ' Company No.: WN. ' || CAST(doc_id AS VARCHAR) END AS fulltext,
               'http://notices.example/' || CAST(doc_id AS VARCHAR) AS landing_url
        FROM documents JOIN (SELECT unnest(range({len(TYPE_CODES)})) AS t,
                                    unnest({_sql_list(TYPE_CODES)}) AS code,
                                    unnest({_sql_list([r[1] for r in NOTICE_TYPES])}) AS label)
             ON t = doc_id % 27
        WHERE doc_id % 97 <> 0)""",
}


def with_fixtures(*names: str) -> str:
    return "WITH " + ",\n".join(FIXTURE_SQL[n] for n in names)
