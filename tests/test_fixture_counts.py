"""Counts published for the stand-in fixtures (measured independently in DuckDB)."""
from pyspark.sql import functions as F

from flowsieve.operators.matching import match_flows
from flowsieve.plans import standins as S

SF = "/root/testdata/sf0.01"


import pytest


@pytest.mark.parametrize("reuse", [True, False])
def test_f2_pass_counts(spark, reuse):
    m = match_flows(S.f2_flows(spark, SF), S.f2_labels(spark, SF), S.F2_TOLERANCE_MS, keep_diagnostics=True,
                    reuse_points=reuse)
    got = {r.match_pass: r["count"] for r in m.groupBy("match_pass").count().collect()}
    assert (got["uf"], got["ur"], got["df"], got["dr"]) == (12, 8, 295, 97)
    amb = m.where(F.col("label").isNull() & ((F.col("n_cand_f") + F.col("n_cand_r")) > 0)).count()
    assert amb == 18


def test_f3_counts(spark):
    m = match_flows(S.f3_flows(spark, SF), S.f3_labels(spark, SF), S.F3_TOLERANCE_MS,
                    directions="forward", flow_ts="ts_ms", keep_diagnostics=True)
    got = {r.match_pass: r["count"] for r in m.groupBy("match_pass").count().collect()}
    assert got["uf"] == 526 and got["df"] == 1274
    with_cands = m.where(F.col("n_cand_f") > 0).groupBy(
        F.when(F.col("match_pass") == "uf", "u").otherwise("d")).count().collect()
    assert {r[0]: r[1] for r in with_cands}.get("d") == 1370


def test_sweep_candidates_grow_with_tolerance(spark):
    from flowsieve.operators.matching import tolerance_sweep
    d = "/root/testdata/sf0.1"
    rows = sorted(tolerance_sweep(S.f2_flows(spark, d), S.f2_labels(spark, d)).collect(),
                  key=lambda r: r.tolerance_ms)
    cands = [r.with_candidates for r in rows]
    assert [r.tolerance for r in rows] == ["10s", "30s", "1min", "2min", "3min", "5min"]
    assert cands == sorted(cands) and cands[-1] > 0
