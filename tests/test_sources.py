"""Lookups, the type dimension, published statistics, the request log, and what reaches the scan."""
import pytest
import json
from datetime import date

from pyspark.sql import functions as F

from noticeboard.operators.filters import Filters, type_filter
from noticeboard.plans import search as Q
from noticeboard.schema import FULL_COLUMNS
from noticeboard.sources import notices as V, sinks as K
from noticeboard.sources.types import notice_types, with_labels

ROWS = [{"id": "2020-al1", "code": "al", "title": "Acme", "fulltext": "bay radiators", "date": date(2020, 1, 2),
         "significance_score": 5},
        {"id": "2021-ds2", "code": "ds", "title": "Bay", "fulltext": "radiators of the bay", "date": None,
         "significance_score": None}]


def test_lookups(spark, notices):
    table = notices(ROWS)
    assert V.get_notice(table, "2020-al1").columns == FULL_COLUMNS
    assert V.get_notice(table, "none").count() == 0
    ids = spark.createDataFrame([("2021-ds2",), ("2021-ds2",), ("none",)], "id string")
    assert [r["id"] for r in V.get_notices(table, ids).collect()] == ["2021-ds2"]


def test_details_join_the_winners(spark, notices):
    table = notices(ROWS)
    found = Q.search_phrase(table, "bay radiators")
    rows = Q.with_details(found, table).collect()
    assert {r["id"] for r in rows} == {"2020-al1", "2021-ds2"} and rows[0]["fulltext"]


def test_type_dimension(spark):
    types = notice_types(spark)
    assert (types.count(), type_filter(types, insolvency=True).count(), type_filter(types, tier=3).count(),
            type_filter(types, active=False).count()) == (27, 9, 6, 4)
    rows = spark.createDataFrame([("al",), ("zz",)], "code string")
    assert {r["code"]: r["type"] for r in with_labels(rows, types).collect()} == {
        "al": "Appointment/Release of Liquidators", "zz": "zz"}


def test_published_statistics(spark, notices, tmp_path):
    for _ in range(2):
        K.publish_stats(notices(ROWS), str(tmp_path / "stats"))
    text = spark.read.text(str(tmp_path / "stats")).first()[0]
    assert json.loads(text) == {"notice_count": 2, "oldest": "2020-01-02", "newest": "2020-01-02",
                                "yearly": [{"year": 2020, "count": 1}]}
    K.publish_stats(notices([]), str(tmp_path / "none"))
    assert json.loads(spark.read.text(str(tmp_path / "none")).first()[0]) == {
        "notice_count": 0, "oldest": None, "newest": None, "yearly": []}


def test_log_pruning_goes_by_the_day_in_the_name(spark, tmp_path):
    lines = spark.createDataFrame(
        [(f"2024-01-{d:02d} 10:00:00", "/search", "1.1.1.1, 2", None) for d in (1, 14, 15, 25)],
        "ts string, route string, forwarded string, peer string")
    for name, kind in (("country", "string"), ("ua", "string"), ("referer", "string"), ("request", "string"),
                       ("response", "string"), ("status", "int"), ("ms", "bigint"), ("error", "string")):
        lines = lines.withColumn(name, F.lit(None).cast(kind))
    K.write_request_log(K.log_lines(lines, "s"), str(tmp_path))
    assert K.prune_log(spark, str(tmp_path), date(2024, 1, 25), 10) == (2, 2)
    left = K.read_request_log(spark, str(tmp_path))
    assert {r["day"] for r in left.collect()} == {"2024-01-15", "2024-01-25"}
    assert {len(r["ip_hash"]) for r in left.collect()} == {16} and {r["ua"] for r in left.collect()} == {""}


def test_filters_and_columns_reach_the_scan(spark, notices, tmp_path):
    notices(ROWS).withColumns({"n_tokens": F.size("tokens"), "n_chars": F.length("fulltext")}) \
        .write.parquet(str(tmp_path / "t"))
    table = V.notices(spark, str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    wanted = Filters(code="al", date_from=date(2020, 1, 1), min_significance=0)
    plan = Q.search_phrase(table, "bay", wanted)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("EqualTo(code,al)", "GreaterThanOrEqual(date,2020-01-01)",
                 "GreaterThanOrEqual(significance_score,0)"):
        assert part in pushed
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "tokens" in read and "fulltext" not in read and "headline" not in read
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def _page(path, text, stamp):
    import os
    path.write_text(text)
    os.utime(path, (stamp, stamp))


def _record(title):
    return ('{"search": {"result_count": 1, "results": [{"dc_identifier": ["Notice Number: 2000-al1"], "title": "%s", '
            '"date": ["2000-01-01"], "landing_url": "u", "fulltext": "t", "description": "d"}]}}' % title)


def test_a_damaged_page_is_not_lost(spark, tmp_path):
    from noticeboard.sources.pages import read_pages, rejected_pages
    folder = tmp_path / "year=2000"
    folder.mkdir()
    _page(folder / "page-1.json", _record("good"), 1000)
    _page(folder / "page-2.json", _record("cut short")[:-40], 1001)
    _page(folder / "page-3.json", '{"search": null}', 1002)
    with pytest.raises(Exception, match="damaged page"):
        read_pages(spark, str(tmp_path)).collect()
    assert [r.title for r in read_pages(spark, str(tmp_path), skip_damaged=True).collect()] == ["good"]
    assert sorted(r.file[-11:] for r in rejected_pages(spark, str(tmp_path)).collect()) == ["page-2.json", "page-3.json"]


def test_the_last_landed_record_wins(spark, tmp_path):
    from noticeboard.sources.notices import NoticeTable
    from noticeboard.streaming.ingest import full_reload
    folder = tmp_path / "pages" / "year=2000"
    folder.mkdir(parents=True)
    _page(folder / "page-9.json", _record("OLD"), 1000)
    _page(folder / "page-10.json", _record("NEW"), 2000)
    full_reload(spark, str(tmp_path / "pages"), str(tmp_path / "table"))
    assert [r.title for r in NoticeTable(spark, str(tmp_path / "table")).read().collect()] == ["NEW"]


def test_scores_beyond_the_integer_range_are_clamped(spark):
    from noticeboard.functions.annotations import parse_annotation
    from pyspark.sql import functions as F
    answer = ('{"headline": "h", "plain_english": "p", "event_category": "x", "action_taken": "y", '
              '"affected_parties": [], "significance_score": %s, "significance_reason": "r"}')
    rows = [(answer % s,) for s in ("99999999999", "1e12", "-99999999999", "55")]
    got = spark.createDataFrame(rows, "raw string").select(parse_annotation(F.col("raw")).alias("a")).collect()
    assert [r.a.significance_score for r in got] == [100, 100, 0, 55]
