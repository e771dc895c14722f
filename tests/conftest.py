import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spoorline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = get_spark("local[4]", 4, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder,
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Builds an event table from ``(src, dst, ts[, type[, score]])`` rows; ids follow the row order."""
    def build(rows):
        full = [(i, r[0], r[1], float(r[2]), r[3] if len(r) > 3 else "t", float(r[4]) if len(r) > 4 else 0.0) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "event_id long, src_key string, dst_key string, ts_s double, event_type string, score double")

    return build
