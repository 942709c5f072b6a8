import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tracequarry.session import get_spark

    session = get_spark("tests", cpus=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of strings."""
    from pyspark.sql import functions as F

    def value(make, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
        return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return value
