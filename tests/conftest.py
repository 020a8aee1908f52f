import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linkloom.limits import ESTABLISHED, using  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("linkloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def established_limits():
    with using(ESTABLISHED):
        yield


@pytest.fixture(scope="session")
def value(spark):
    """Value of an SQL expression over named texts: value(fn('t'), t='...')."""

    def evaluate(expression, **texts):
        schema = ", ".join(f"{name} string" for name in texts)
        return spark.createDataFrame([tuple(texts.values())], schema).selectExpr(f"{expression} AS r").first().r

    return evaluate


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF
