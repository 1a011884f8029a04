import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("scoreloom-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one expression over literal columns."""
    from pyspark.sql import functions as F

    def run(build, *args):
        row = spark.range(1).select(*[F.lit(a).alias(f"c{i}") for i, a in enumerate(args)])
        out = row.select(build(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]
        return out.asDict(recursive=True) if hasattr(out, "asDict") else out

    return run
