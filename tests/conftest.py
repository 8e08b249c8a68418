import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitesignal.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("sitesignal-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.streaming.noDataMicroBatches.enabled": "true",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stage"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows and a schema to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def each(spark):
    """Evaluate one column expression over a list of values of column ``v``."""
    def run(values, column, schema="v string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
        return [r[0] for r in df.select(column.alias("out"), "i").orderBy("i").select("out").collect()]

    return run
