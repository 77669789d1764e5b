import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from labelvec.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("staged")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def small(spark):
    """50 samples of 2 x 3 pixels with distinct images and classes 0..9."""
    rows = [
        (i, [(i * 7 + p * 31) % 256 for p in range(6)], [float(k == i % 10) for k in range(10)])
        for i in range(50)
    ]
    return spark.createDataFrame(rows, "sample_id long, image array<int>, label array<double>")
