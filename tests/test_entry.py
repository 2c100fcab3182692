"""The driver contract: entry, queries and their oracles."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["user", "score", "n"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(E.ORACLES) == set(E.QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(n for n in E.QUERIES if not n.startswith("stream_")))
def test_batch_query_matches_oracle(spark, name):
    res = compare(spark, SMOKE, [name], verbose=False)
    assert res[name] == "ok", res[name]


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.mark.parametrize("name", sorted(n for n in E.QUERIES if n.startswith("stream_")))
def test_stream_query_matches_oracle_in_a_plain_session(spark, name):
    plain = spark.newSession()
    plain.conf.unset(PROVIDER)  # as in a session without the library's defaults
    before = dict(plain.conf.getAll)
    assert "RocksDB" not in before.get(PROVIDER, "")
    res = compare(plain, SMOKE, [name], verbose=False)
    assert res[name] == "ok", res[name]
    assert dict(plain.conf.getAll) == before


def test_entry_point_survives_a_missing_package():
    code = ("import sys\n"
            "for name in ('ahocorasick', 'public_tokenizers'): sys.modules[name] = None\n"
            "import __spark_entry__ as E\n"
            "assert set(E.QUERIES) <= set(E.queries()) and E.oracle_sql()\n")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True,
                          text=True, cwd=os.path.dirname(E.__file__))
    assert done.returncode == 0, done.stderr
