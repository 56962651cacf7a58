import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyline.session import tune

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").getOrCreate()
    )
    return tune(s)


@pytest.fixture(scope="session")
def sf():
    return SF
