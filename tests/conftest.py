import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from adledger.session import SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").appName("adledger-tests")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    session = (builder.config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """A table of a schema from dicts; what is left out is null."""
    def make(schema, *dicts):
        return spark.createDataFrame([tuple(d.get(n) for n in schema.names) for d in dicts], schema)
    return make


@pytest.fixture(scope="session")
def eval_text(spark):
    """Applies a column function to each text and returns the results in order."""
    def run(fn, *texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        out = df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in out]
    return run


AS_OF = dt.date(2026, 9, 20)


@pytest.fixture(scope="session")
def as_of(spark):
    return F.lit(AS_OF)
