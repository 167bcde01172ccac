import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from peakforge.session import configure  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("peakforge-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Fixed small labelled set with copies, as (sample_id, features, label)."""
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6))
    x[60:110] = x[60]
    rows = [(f"p{i:03d}", [float(v) for v in x[i]], float(i % 3 == 0)) for i in range(len(x))]
    return spark.createDataFrame(rows, "sample_id string, features array<double>, label double").repartition(5)
