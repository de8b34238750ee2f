import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sigspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def long_signal(spark):
    """Build a long signal from {(recording, channel): values}."""

    def build(series, t_step=None):
        rows = []
        for pos, ((rec, ch), values) in enumerate(series.items()):
            for i, v in enumerate(values):
                rows.append((rec, ch, pos, i, len(values), i * (t_step or 1.0), float(v)))
        return spark.createDataFrame(
            rows, "recording_id string, channel string, channel_pos long, idx long, n long, t double, value double"
        )

    return build
