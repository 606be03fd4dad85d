"""Every panel query of a sample against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelforge.plans import registry

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["ts8_rank", "ts7_argmax", "xs10_neutralize", "xs16_quantile", "rsp1_monthly_bars", "cln5_two_level", "jn6_as_of", "acc5_growth", "srt1_spread", "reg1_pricing", "pf8_hedged", "evt3_event_time_average", "flt1_universe", "pf3_executed_orders", "xs14_signal_after", "xs17_alpha008", "dia2_weighted_slopes", "dia6_layer_description", "srt5_composite", "acc22_quarterly_family", "ind16_window_idio_vol", "ind18_consensus_monthly", "reg5_fama_macbeth_controls", "bst3_residual_and_factor", "mod5_scaled_intercept_p", "cmb7_parameter_sweep", "jn7_forward_as_of", "ts14_rolling_two", "mkt3_timing_grid", "reg3_ind13_rolling_beta", "rsp6_cln8_statement_to_daily", "xs9_adjusted_boxplot_large", "jn2_outer_align", "jn9_shared_index", "jn9_union_frame", "src3_stock_read", "src4_futures_read", "src5_index_read", "agg8_correlations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "nation supplier customer orders lineitem events documents pages".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, ROOT)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity", "dt", "signal"]
