"""The driver contract: entry() works, every query has an oracle or a stated reason."""

import os
import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E
from tests.conftest import SF_SMALL

NO_ORACLE = {"retry_until_pass"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "test_name" in df.columns


def test_every_query_has_an_oracle_or_a_reason():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if k != "pipeline" and not re.match(r"op\d+_", k)}  # the others come from an optional part
    assert own - set(o) == NO_ORACLE


def test_python_workers_need_no_path(tmp_path):
    """Started in an empty folder without PYTHONPATH, operators with Python workers still run."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(E.__file__).parent)!r})
import __spark_entry__ as E
sys.path.pop(0)
from fidelis.session import local_session
spark = local_session(2, shuffle_partitions=4)
assert E.queries()["nn_cosine"](spark, {SF_SMALL!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_streaming_rules_equal_batch(spark):
    a = {tuple(r) for r in E.queries()["stream_rule_failures"](spark, SF_SMALL).collect()}
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
    b = {tuple(r) for r in con.execute(E.oracle_sql()["stream_rule_failures"]).fetchall()}
    assert a == b
