import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidepool.session import build_session, checkpoint_root
    s = build_session("local[4]", app="tidepool-tests", shuffle_partitions=4, extra={
        "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        # small Arrow batches so the ordered scan's carry across batches is exercised
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5",
        # keys with more than 2 rows count as hot: fixtures run the
        # range-partitioned scan, single-row keys the window path
        "tidepool.hotKeyRows": "2",
    })
    checkpoint_root(s, fallback=tempfile.mkdtemp(prefix="tidepool-ckpt-"))
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="tidepool-test-")
