import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    scratch = tmp_path_factory.mktemp("scratch")
    options = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": f"file://{scratch}/shared",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
    }
    session = SparkSession.builder.master("local[8]").config(map=options).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
