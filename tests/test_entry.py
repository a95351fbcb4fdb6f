"""Driver contract: entry runs, every oracle has a query, a sample of oracles matches at sf0.001."""

import math
import os

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

import __spark_entry__ as E  # noqa: E402

SAMPLE = ["market_avg", "responder_lag", "rolling_mean_prefix", "aux_targets", "profile_ids", "missing_ratio",
          "weighted_r2_by_date", "cadence_schedule", "walk_forward_retrain", "variant_summary", "split_grid_scores",
          "cell_summary", "day_sequences", "canonical_order_rank", "tags_per_row"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["date_id", "n_rows", "version", "r2"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _norm([tuple(r) for r in sdf.collect()], sdf.columns) == _norm(rel.fetchall(), rel.columns)
