"""Every query with SQL against that SQL, on the smallest tables; names on both sides agree."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FAST = ["exact_baseline", "tsv_round_trip", "audit_truth", "validate_output", "f05_per_entity", "conflict_margin", "country_guard_owner", "threshold_sweep", "rrf_fusion", "components", "hybrid_merge", "cardinality_bins", "pair_features_all", "rule_scores", "training_pairs", "structural_negatives"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    assert canonical(entry.queries()[name](spark, SF).toPandas()) == canonical(con.execute(entry.oracle_sql()[name]).df())
