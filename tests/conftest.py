import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scored(spark):
    """600 scored rows with ties, two classes and two groups."""
    import numpy as np

    draw = np.random.default_rng(1)
    rows = []
    for i in range(600):
        label = int(draw.random() < 0.3)
        score = round(float(min(0.99, max(0.01, draw.normal(0.35 + 0.2 * label, 0.15)))), 2)
        rows.append((i, score, label, "a" if i % 3 else "b"))
    return spark.createDataFrame(rows, "ID bigint, score double, default_flag int, grp string").cache()
