import os

import pytest

from lumenfold.session import session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    made = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.execution.arrow.pyspark.enabled": "true"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
