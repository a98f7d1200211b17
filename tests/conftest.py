import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from regcast.session import local_session

    s = local_session("*", shuffle_partitions=8, app="regcast-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def base(spark):
    """20-row frame: row 0..19, feature = row, target = 2·row."""
    import pandas as pd

    pdf = pd.DataFrame({"row": list(range(20)), "feature": [float(v) for v in range(20)], "target": [float(2 * v) for v in range(20)]})
    return spark.createDataFrame(pdf)
