import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("shiftledger-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "America/Los_Angeles")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def crowded(spark):
    """Treat keys of more than 40 rows as hot, in chunks of about 25 rows."""
    spark.conf.set("spark.shiftledger.hotKeyRows", "40")
    spark.conf.set("spark.shiftledger.chunkRows", "25")
    yield
    spark.conf.unset("spark.shiftledger.hotKeyRows")
    spark.conf.unset("spark.shiftledger.chunkRows")
