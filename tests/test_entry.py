"""The driver contract: names agree, and every query with an equivalent matches DuckDB on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from braidflow.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "w02_idle_sessions", "w15_checkpoints", "a10_tolerance_sweep", "j04_class_consensus", "j20_golden_window", "a35_curve_areas", "m09_hbos_score", "t06_even_sample", "p12_audit_flags", "q08_membership_digest", "a03_terminal_vector",
    "a49_replay_confusion", "d10_oversample", "j13_replay_segments", "m21_pair_selection", "m26_cluster_bootstrap", "p17_buckets", "p19_ratios", "p20_suspicious_tokens", "p21_dns_features", "p22_http_features", "p23_conn_features", "p24_code_maps",
    "p28_layer2", "p29_layer3", "p30_layer1", "p31_family_map", "w21_simple_features", "w24_time_regressions", "w25_alert_order",
]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def test_every_equivalent_binds(sf_dir):
    """All of them parse and name existing columns; rows are compared below for a sample, and for all by the driver."""
    c = duck(sf_dir)
    assert all(c.sql(sql).columns for sql in ORACLE.values())


def test_workers_need_not_have_the_folder(tmp_path):
    """A job started elsewhere, whose Python workers see no package but what the entry sends."""
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('__spark_entry__', {str(Path(entry.__file__))!r})\n"
        "e = importlib.util.module_from_spec(spec); sys.modules['__spark_entry__'] = e; spec.loader.exec_module(e)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"print('rows', e.queries()['w03_w08_close_reasons'](s, {SF!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 20" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, sf_dir, name):
    c = duck(sf_dir)
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    key = lambda r: tuple("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r)
    got = sorted(key(r) for r in df.select(*cols).collect())
    want = sorted(key(r) for r in c.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall())
    assert got == want
