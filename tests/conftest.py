import os
import sys
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("loomstat-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomstat-test-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dense():
    """Seeded 400 x 5 frame: three informative features, one noise, folds."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4))
    x[:, 1] = 0.6 * x[:, 0] + 0.8 * x[:, 1]
    y = 2.0 + x @ np.array([3.0, -1.5, 0.8, 0.0]) + rng.normal(scale=0.7, size=400)
    pdf = pd.DataFrame(x, columns=["a", "b", "c", "d"])
    pdf["y"], pdf["fold"], pdf["id"] = y, np.arange(400) % 5, np.arange(400)
    return pdf
