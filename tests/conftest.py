import os

os.environ.setdefault("PYSPARK_PYTHON", __import__("sys").executable)

import pytest


@pytest.fixture(scope="session")
def spark():
    from parlance.session import get_spark

    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
