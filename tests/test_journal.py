"""Journal of outside answers: kept through a failed run, retried within a budget, spent rows reported."""
from pyspark.sql import functions as F

from noticeboard.operators import journal as J


def answering(stop=None):
    """An outside function, defined in a closure so that workers need not import this module."""
    def answer(text):
        if text.startswith("bad"):
            raise ValueError("never")
        if text == stop:
            raise SystemExit("the run dies here")
        return text.upper()
    return answer


def test_failed_run_keeps_answers_and_budget_is_spent(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = spark.createDataFrame([(f"k{i}", ("bad" if i == 3 else "ok") + str(i)) for i in range(40)],
                                 "key string, input string")
    slices = 8
    part = F.pmod(F.xxhash64("key", F.sha2("input", 256)), F.lit(slices))
    last = rows.filter(part == slices - 1).orderBy("key").first()     # a question of the last slice kills the run
    try:
        J.ask_journaled(rows, answering(last["input"]), path, attempts=2, slice_rows=5)
        raise AssertionError("the run should have failed")
    except AssertionError:
        raise
    except Exception:
        pass
    kept = J.read_journal(spark, path)
    first = kept.count()
    assert 0 < kept.filter("answer is not null").count() < 40      # slices written before the failure stay
    got = dict(map(tuple, J.ask_journaled(rows, answering(), path, attempts=2, slice_rows=5).collect()))
    assert len(got) == 39 and got["k0"] == "OK0" and last["key"] in got
    journal = J.read_journal(spark, path)
    assert journal.count() == first + (40 - first) + 1               # each open question once more, k3 twice in all
    spent = J.exhausted(spark, path, attempts=2).collect()
    assert [r["key"] for r in spent] == ["k3"] and spent[0]["tries"] == 2
    before = J.read_journal(spark, path).count()
    J.ask_journaled(rows, answering(), path, attempts=2)                 # nothing open: nothing asked
    assert J.read_journal(spark, path).count() == before


def test_limit_and_changed_input(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = spark.createDataFrame([(f"k{i}", f"x{i}") for i in range(10)], "key string, input string")
    assert J.ask_journaled(rows, answering(), path, limit=4).count() == 4
    assert J.ask_journaled(rows, answering(), path).count() == 10
    changed = rows.withColumn("input", F.when(F.col("key") == "k1", "y1").otherwise(F.col("input")))
    got = dict(map(tuple, J.ask_journaled(changed, answering(), path).collect()))
    assert got["k1"] == "Y1" and J.read_journal(spark, path).count() == 11
