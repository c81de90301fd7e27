import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Rows as sorted tuples with columns by name, doubles rounded, for comparing results of two engines."""

    def value(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v

    def rows(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        out = (tuple(value(v) for v in r) for r in frame.itertuples(index=False))
        return list(frame.columns), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))

    return rows
