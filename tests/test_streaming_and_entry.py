import json

import duckdb
import pytest

import __spark_entry__ as entry
from genespark.plans import views as v
from genespark.streaming.aggregates import STREAMABLE, start_complete, stream_table

SMALL = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_genotype_counts_on_a_stream(spark, tmp_path):
    calls = v.calls(spark, SMALL)
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), calls.schema, files_per_trigger=1)
    for name in ("genotype_counts", "allele_freq_by_group"):
        q = start_complete(STREAMABLE[name](stream), f"out_{name}", str(tmp_path / f"cp_{name}"))
        q.processAllAvailable()
        q.stop()
        got = sorted(map(str, spark.table(f"out_{name}").collect()))
        assert got == sorted(map(str, STREAMABLE[name](calls).collect()))


@pytest.mark.parametrize("name", ["allele_freq_by_group", "d_statistic", "interval_annotation", "run_length_encoding", "thin_sites", "rolling_depth_histogram"])
def test_queries_match_their_oracles_for_any_partitioning(spark, partitions, name):
    import check

    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, SMALL)
    assert check.canon([tuple(r) for r in df.collect()], df.columns) == check.canon(cur.fetchall(), names)


def test_bench_names_exist():
    import bench

    assert set(bench.HEADLINE) <= set(entry.queries())
    assert json.dumps(bench.HEADLINE)
