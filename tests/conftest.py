import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(shared / "checkpoint"))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.executorEnv.PYTHONPATH", str(ROOT))
        .getOrCreate()
    )
    session.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).is_dir():
        pytest.skip("the test tables are not there")
    return SF
