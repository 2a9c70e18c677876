"""Growth of single steps: what a step stores, scores or shuffles follows its own rows."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeboard.operators import journal as J, vectors as V
from noticeboard.operators.entities import related
from noticeboard.operators.postings import occurrences, phrase_index
from noticeboard.schema import FILTER_COLUMNS


def test_index_of_phrases_stores_their_occurrences_only(spark):
    texts = [("1", "a b a b a c".split()), ("2", "b a".split()), ("3", ["x"] * 500), ("4", []), ("4", "a b a".split())]
    rows = spark.createDataFrame(texts, "id string, tokens array<string>")
    asked = [(1, ["a", "b", "a"]), (2, ["b"]), (3, ["a", "c"]), (4, ["x", "y"]), (5, []), (6, ["b", "a", "b", "a"]),
             (7, ["c", "a"])]
    phrases = spark.createDataFrame(asked, "key int, words array<string>")
    few, whole = phrase_index(rows, phrases=phrases), phrase_index(rows)
    found = lambda index: {(r["key"], r["id"], r["occurrences"])
                           for r in occurrences(index, phrases).join(index.rows, "_row").collect()}
    assert found(few) == found(whole) == {(1, "1", 2), (1, "4", 1), (2, "1", 2), (2, "2", 1), (2, "4", 1), (3, "1", 1),
                                          (6, "1", 1)}
    assert few.postings.filter("word = 'x'").count() == 0
    assert few.postings.count() == few.postings.select("_row", "position").distinct().count() == 6 + 1 + 3


def test_cosines_are_scored_in_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    n, m = 60, 37
    table = lambda name, v: pa.array(v.tolist(), pa.list_(pa.float32()))
    queries = pa.table({"request_key": [str(i) for i in range(m)], "vector": table("vector", rng.normal(size=(m, 4))),
                        "k": pa.array([3] * m, pa.int32()), **{f"want_{c}": pa.array([None] * m, pa.string()) for c in FILTER_COLUMNS}})
    rows = pa.table({"id": [str(i) for i in range(n)], "date": pa.array([None] * n, pa.date32()),
                     "embedding": table("embedding", rng.normal(size=(n, 4)))})

    def best(tile):
        monkeypatch.setattr(V, "QUERY_TILE_ROWS", tile)
        found, seen = V.BestRows(V.QueryBlock(queries)), []
        score = found._score
        monkeypatch.setattr(found, "_score", lambda members, *rest: (seen.append(len(members)), score(members, *rest)))
        found.add(rows)
        assert max(seen) <= tile
        return [b.to_pydict() for b in found.batches()]
    assert best(5) == best(1000)


def test_a_slice_reads_its_own_questions(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit("q").alias("input"),
                                   F.lit("h").alias("input_hash"), F.lit(1).alias("attempt"))
    parts = J._sliced(rows, 5)
    assert sum(p.count() for p in parts) == 100
    files = [f for p in parts for f in p.inputFiles()]
    assert len(files) == len(set(files)) and len(parts) > 1


def test_lists_of_parties_meet_their_seed_without_a_shuffle(spark, notices):
    table = notices([{"id": f"n{i % 20}", "affected_parties": [f"p{i % 3}", f"p{i % 5}"]} for i in range(30)])
    plan = related(table, table.select("id"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seed_id" not in plan


def test_terms_are_sorted_natively(spark, monkeypatch):
    pytest.importorskip("noticeboard.llm")
    from noticeboard.llm import op11_search as S
    monkeypatch.setattr(S.F, "array_sort", lambda *a: pytest.fail("sorted by a lambda"))
    docs = spark.createDataFrame([(1, "b a b"), (2, None)], "doc_id long, text string")
    got = {(r["term"], r["tf"]) for r in S.index(docs)[0].collect()}
    assert got == {("a", 1), ("b", 2)}
