import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glossaflow.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return configure(session)


@pytest.fixture(scope="session")
def value(spark):
    """The value of an expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""
    return lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
