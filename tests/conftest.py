import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="session")
def spark():
    from noticeboard.session import build_session
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def notices(spark):
    """Builds a notices table (all columns) from partial rows."""
    from pyspark.sql import functions as F
    from noticeboard.functions.text import tokens
    from noticeboard.schema import NOTICES

    def build(rows):
        empty = spark.createDataFrame([], NOTICES)
        names = [f.name for f in empty.schema]
        df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], empty.schema)
        return df.withColumn("tokens", tokens(F.col("title"), F.col("fulltext")))
    return build
