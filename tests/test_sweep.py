"""Nested tolerances from one pass equal one match for each tolerance."""
import random

import pytest

from flowsieve.operators import matching as M

FLOW = "flow_id long, flow_key string, flow_key_rev string, bidirectional_first_seen_ms {t}"
LABEL = "flow_key string, ts_ms {t}, label string"
TOLS = {"zero": 0, "few": 3, "some": 10, "many": 40, "most": 41}


@pytest.mark.parametrize("cardinality,directions,time,scope", [
    ("split", "both", "long", ()), ("any", "both", "long", ()), ("any", "forward", "double", ()), ("split", "both", "long", ("scenario",))])
def test_sweep_equals_single_matches(spark, cardinality, directions, time, scope):
    rnd = random.Random(len(cardinality) + len(directions))
    keys = ["a", "b", "c", "d", "e", "f"]
    num = float if time == "double" else int

    def when():
        return None if rnd.random() < 0.05 else num(rnd.randrange(-60, 400) / (4 if time == "double" else 1))
    flows = [(i, rnd.choice([*keys, None]), rnd.choice([*keys, None]), when()) for i in range(250)]
    flows += [(1000, "only", "b", num(5)), (1001, "alone", None, num(7))]
    labels = [(rnd.choice([*keys, None]), when(), rnd.choice(["x", "x", "x", "y", None])) for _ in range(60)]
    labels += [("only", num(6), "x"), ("alone", num(90), "y")]
    f = spark.createDataFrame(flows, FLOW.format(t=time))
    lab = spark.createDataFrame(labels, LABEL.format(t=time))
    if scope:
        f, lab = (d.selectExpr("*", "if(flow_key < 'c', 'p', 'q') AS scenario") for d in (f, lab))
    kw = {"cardinality": cardinality, "directions": directions, "scope": scope}
    got = {r["tolerance"]: (r["labelled"], r["with_candidates"]) for r in M.tolerance_sweep(f, lab, TOLS, **kw).collect()}
    for name, ms in TOLS.items():
        rows = M.match_flows(f, lab, ms, keep_diagnostics=True, **kw).collect()
        want = (sum(r["label"] is not None for r in rows), sum((r["n_cand_f"] or 0) + (r["n_cand_r"] or 0) > 0 for r in rows))
        assert got[name] == want, name
    wide = {r["tolerance"]: (r["labelled"], r["with_candidates"]) for r in M.tolerance_sweep(f, lab, TOLS, sub_cell_ms=5, **kw).collect()}
    assert wide == got


def test_sweep_of_nothing(spark):
    f, lab = spark.createDataFrame([], FLOW.format(t="long")), spark.createDataFrame([], LABEL.format(t="long"))
    assert [tuple(r)[2:] for r in M.tolerance_sweep(f, lab, TOLS).collect()] == [(0, 0)] * 5
    with pytest.raises(ValueError):
        M.tolerance_sweep(f, lab, {"x": -1})
