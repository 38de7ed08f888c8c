import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pixelweave.session import local_session

    session = local_session(partitions=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stack_of(spark):
    """Pixel rows of a (t, y, x) NumPy array."""
    import numpy as np

    def make(a, movie="m"):
        a = np.asarray(a, dtype=float)
        t, h, w = a.shape
        rows = [(movie, f, y, x, float(a[f, y, x]), h, w) for f in range(t) for y in range(h) for x in range(w)]
        return spark.createDataFrame(rows, "movie_id string, frame int, y int, x int, value double, h int, w int")

    return make


@pytest.fixture(scope="session")
def array_of():
    import numpy as np

    def back(df, column="value"):
        rows = df.select("frame", "y", "x", column).collect()
        out = np.full([1 + max(r[i] for r in rows) for i in range(3)], np.nan)
        for f, y, x, v in rows:
            out[f, y, x] = v
        return out

    return back
