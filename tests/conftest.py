import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (ships the package with the tasks)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column_of(spark):
    """Evaluate an expression of one column for each of some values."""

    def evaluate(values, expression, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]

    return evaluate
