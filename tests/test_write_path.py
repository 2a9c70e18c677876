"""Upserts, the notices table, ingest, annotation and embedding."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeboard.operators.annotate import WordHashEmbedder, annotate, embed, embed_texts, parse_queries
from noticeboard.plans.update import Paths, update
from noticeboard.sources.notices import NoticeTable
from noticeboard.streaming.ingest import full_reload, stream_ingest


def page(records, count=None):
    return json.dumps({"search": {"result_count": count or len(records), "results": records}})


def record(number, text="text", code="al", year=2020):
    return {"dc_identifier": [f"Notice Number: {year}-{code}{number}"], "title": f"Company {number}",
            "date": [f"{year}-03-04 12:00:00 UTC"], "fulltext": [text], "landing_url": "u"}


def land(root, name, records, year=2020):
    folder = root / f"year={year}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(page(records))


def rows(table):
    return {r["id"]: r.asDict() for r in table.read().collect()}


def test_ingest_resumes_and_replays(spark, tmp_path):
    pages, table = tmp_path / "pages", str(tmp_path / "table")
    land(pages, "0001.json", [record(1), record(2), {"title": "no id"}])
    assert stream_ingest(spark, str(pages), table, str(tmp_path / "check")) == 1
    first = rows(NoticeTable(spark, table))
    assert set(first) == {"2020-al1", "2020-al2"} and first["2020-al1"]["type"] == \
        "Appointment/Release of Liquidators"
    # The live-edge page is read again with one more record and one changed text.
    land(pages, "0002.json", [record(1, "new text"), record(2), record(3)])
    stream_ingest(spark, str(pages), table, str(tmp_path / "check"))
    second = rows(NoticeTable(spark, table))
    assert set(second) == {"2020-al1", "2020-al2", "2020-al3"}
    assert second["2020-al1"]["fulltext"] == "new text" and "new" in second["2020-al1"]["tokens"]
    assert second["2020-al2"]["loaded_at"] == first["2020-al2"]["loaded_at"]
    assert stream_ingest(spark, str(pages), table, str(tmp_path / "check")) == 0
    full_reload(spark, str(pages), table)
    again = rows(NoticeTable(spark, table))
    assert {k: (v["fulltext"], v["loaded_at"]) for k, v in again.items()} == \
        {k: (v["fulltext"], v["loaded_at"]) for k, v in second.items()}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    pages = tmp_path / "pages"
    for i in range(4):
        land(pages, f"{i:04d}.json", [record(rng.randint(1, 9), f"version {i}") for _ in range(6)])
    stream_ingest(spark, str(pages), str(tmp_path / "a"), str(tmp_path / "check"), files_per_batch=10)
    full_reload(spark, str(pages), str(tmp_path / "b"))
    a, b = rows(NoticeTable(spark, str(tmp_path / "a"))), rows(NoticeTable(spark, str(tmp_path / "b")))
    assert {k: v["fulltext"] for k, v in a.items()} == {k: v["fulltext"] for k, v in b.items()}


def batch(spark, values):
    return spark.createDataFrame(
        [(f"2020-al{n}", "al", "T", f"t{n}", text, seq) for n, text, seq in values],
        "id string, code string, type string, title string, fulltext string, seq int").withColumns({
            "date": F.lit("2020-01-01").cast("date"), "nzbn": F.lit(None).cast("string"),
            "company_number": F.lit(None).cast("string"), "landing_url": F.lit("u"), "source": F.lit("s")})


def test_last_record_wins_and_annotations_survive(spark, tmp_path):
    table = NoticeTable(spark, str(tmp_path))
    table.upsert(batch(spark, [(1, "old", 1), (1, "newer", 2), (2, "x", 3)]), ["seq"])
    assert rows(table)["2020-al1"]["fulltext"] == "newer"
    table.annotate(annotate(table.read()))
    before = rows(table)
    assert all(r["enriched_at"] and r["event_category"] == "liquidation" for r in before.values())
    table.embed(embed(table.read(), WordHashEmbedder(16)))
    table.upsert(batch(spark, [(1, "changed", 1), (3, "y", 2)]), ["seq"])
    after = rows(table)
    assert after["2020-al1"]["fulltext"] == "changed"
    assert after["2020-al1"]["enriched_at"] == before["2020-al1"]["enriched_at"]
    assert len(after["2020-al1"]["embedding"]) == 16 and after["2020-al3"]["enriched_at"] is None
    table.compact()
    assert rows(NoticeTable(spark, str(tmp_path))) == after
    table.upsert(batch(spark, [(3, "z", 1)]), ["seq"])
    assert rows(table)["2020-al3"]["fulltext"] == "z" and len(rows(table)) == 3


def test_changed_bodies_can_be_sent_back(spark, tmp_path):
    table = NoticeTable(spark, str(tmp_path))
    table.upsert(batch(spark, [(1, "a", 1), (2, "b", 1)]), ["seq"])
    table.annotate(annotate(table.read()))
    table.upsert(batch(spark, [(1, "changed", 1), (2, "b", 1)]), ["seq"], reset_on_change=True)
    got = rows(table)
    assert got["2020-al1"]["enriched_at"] is None and got["2020-al2"]["enriched_at"] is not None


def test_replayed_batch_changes_nothing(spark, tmp_path):
    table = NoticeTable(spark, str(tmp_path))
    for _ in range(2):
        table.upsert(batch(spark, [(1, "a", 1)]), ["seq"], batch=0)
    assert len(rows(table)) == 1 and table.last_batch() == 0


def test_failed_annotations_stay_pending(spark, tmp_path):
    table = NoticeTable(spark, str(tmp_path))
    table.upsert(batch(spark, [(1, "a", 1), (2, "b", 1), (3, "c", 1)]), ["seq"])

    def annotator(code, title, prompt):
        if title == "t1":
            raise RuntimeError("down")
        return "not json" if title == "t2" else "{}"

    table.annotate(annotate(table.read(), annotator))
    done = {k: v["enriched_at"] is not None for k, v in rows(table).items()}
    assert done == {"2020-al1": False, "2020-al2": False, "2020-al3": True}


def test_embedding_keeps_order_and_retries(spark, tmp_path):
    marker = tmp_path / "failed"

    def flaky(texts):
        if not marker.exists():
            marker.write_text("x")
            raise RuntimeError("blip")
        return np.array([[float(t)] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "k int, t string").coalesce(1)
    got = embed_texts(df, "t", "v", flaky, batch=7, wait=0.0).collect()
    assert all(r["v"] == [float(r["k"])] for r in got) and len(got) == 50


def test_embedder_gives_unit_vectors():
    v = WordHashEmbedder(32)(["a b c", "a a", ""])
    assert np.allclose((v * v).sum(axis=1), [1, 1, 0], atol=1e-6)


def test_each_query_text_is_parsed_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def parser(text):
        with calls.open("a") as f:
            f.write(text + "\n")
        return '{"keywords": ["k"]}'

    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "query_id int, q string")
    parsed = parse_queries(df, parser)
    parsed.collect()
    assert all(r["parsed"]["keywords"] == ["k"] for r in parsed.collect())
    assert sorted(calls.read_text().split()) == ["other", "same"]


def test_search_and_responses_ask_once_and_for_sentences_only(spark, tmp_path, notices):
    from noticeboard.plans.search import parsed_sentences, responses, search
    calls, long = tmp_path / "calls", "which land notices were published about the old harbour road"

    def parser(text):
        with calls.open("a") as f:
            f.write(text + "\n")
        return '{"keywords": ["harbour"]}'

    asked = spark.createDataFrame([(1, "harbour", 5), (2, long, 5), (3, long, 5)], "query_id int, q string, `limit` int")
    from noticeboard.schema import FILTER_COLUMNS
    for column in FILTER_COLUMNS:
        kind = "date" if "date" in column else "int" if "sig" in column else "string"
        asked = asked.withColumn(column, F.lit(None).cast(kind))
    rows = notices([{"id": "a", "title": "Harbour", "fulltext": "the harbour road", "embedding": None}])
    sentences = parsed_sentences(asked, parser)
    found = search(rows, asked, sentences=sentences)
    got = {r["query_id"]: (r["route"], r["count"]) for r in responses(asked, found, sentences=sentences).collect()}
    assert got == {1: ("keyword", 1), 2: ("semantic", 0), 3: ("semantic", 0)}
    assert calls.read_text().splitlines() == [long]


def test_update_stops_at_the_first_failure(spark, tmp_path):
    from datetime import date
    land(tmp_path / "pages", "0001.json", [record(1)])
    paths = Paths(*[str(tmp_path / n) for n in ("pages", "table", "check", "stats", "log")])
    (tmp_path / "log" / "day=2023-01-01").mkdir(parents=True)
    (tmp_path / "log" / "day=2024-01-20").mkdir(parents=True)

    def broken(texts):
        raise RuntimeError("no service")

    with pytest.raises(Exception):
        update(spark, paths, date(2024, 1, 25), embedder=broken)
    assert not (tmp_path / "stats").exists()
    done = update(spark, paths, date(2024, 1, 25))
    assert (done["annotated"], done["embedded"], done["log_days_kept"], done["log_days_pruned"]) == (0, 1, 1, 1)
    again = update(spark, paths, date(2024, 1, 25))
    assert (again["batches"], again["annotated"], again["embedded"]) == (0, 0, 0)


def test_update_tells_rows_per_second(spark, tmp_path):
    from datetime import date
    land(tmp_path / "pages", "0001.json", [record(1)])
    for name in ("day=2023-01-01", "day=2024-01-20"):
        (tmp_path / "log" / name).mkdir(parents=True)
    done = update(spark, Paths(*[str(tmp_path / n) for n in ("pages", "table", "check", "stats", "log")]), date(2024, 1, 25))
    for stage in ("annotated", "embedded"):
        assert (done[f"{stage}_per_second"] > 0) == (done[stage] > 0) and done[f"{stage}_per_second"] <= 100 * done[stage]
    assert done["embedded"] == 1
