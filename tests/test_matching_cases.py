"""Hand-made matching cases (tolerance 60,000 ms); expected values per the design."""
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.matching import match_flows

A = ("10.0.0.1", "10.0.0.2", "1000", "80", "6")
TOL = 60_000
SUB = {"ms": 3_600_000}


@pytest.fixture(autouse=True, params=[7, 3_600_000], ids=["subcells", "onecell"])
def _sub_cells(request):
    """Run every case with tiny sub-cells (many per cell) and with one sub-cell per cell."""
    SUB["ms"] = request.param
    yield


def key(t):
    return "|".join(t)


def rev(t):
    return "|".join((t[1], t[0], t[3], t[2], t[4]))


def run(spark, flows, labels, **kw):
    """flows: [(flow_id, flow_key, flow_key_rev, ts)], labels: [(flow_key, ts, label)]."""
    f = spark.createDataFrame(flows, "flow_id long, flow_key string, flow_key_rev string, "
                                     "bidirectional_first_seen_ms long")
    lab = spark.createDataFrame(labels, "flow_key string, ts_ms long, label string")
    out = match_flows(f, lab, TOL, sub_cell_ms=SUB["ms"], **kw).orderBy("flow_id").collect()
    return [(r.label, r.match_pass) for r in out]


def fa(i, ts, t=A):
    return (i, key(t), rev(t), ts)


def test_unique_forward_inclusive(spark):
    assert run(spark, [fa(1, 100_000)], [(key(A), 160_000, "X")]) == [("X", "uf")]


def test_unique_forward_outside(spark):
    assert run(spark, [fa(1, 100_000)], [(key(A), 160_001, "X")]) == [(None, None)]


def test_unique_reverse(spark):
    assert run(spark, [fa(1, 0)], [(rev(A), 10, "X")]) == [("X", "ur")]


def test_duplicate_unanimous(spark):
    assert run(spark, [fa(1, 0), fa(2, 50_000)], [(key(A), 0, "X"), (key(A), 10_000, "X")]) == \
        [("X", "df"), ("X", "df")]


def test_duplicate_ambiguous(spark):
    assert run(spark, [fa(1, 0), fa(2, 50_000)], [(key(A), 0, "X"), (key(A), 10_000, "Y")]) == \
        [(None, None), (None, None)]


def test_duplicate_separated_by_time(spark):
    assert run(spark, [fa(1, 0), fa(2, 1_000_000)], [(key(A), 0, "X"), (key(A), 1_000_000, "Y")]) == \
        [("X", "df"), ("Y", "df")]


def test_duplicate_reverse(spark):
    assert run(spark, [fa(1, 0), fa(2, 10)], [(rev(A), 0, "X"), (rev(A), 5, "X")]) == \
        [("X", "dr"), ("X", "dr")]


def test_forward_ambiguous_reverse_unanimous(spark):
    labels = [(key(A), 0, "X"), (key(A), 1, "Y"), (rev(A), 0, "Z"), (rev(A), 1, "Z")]
    assert run(spark, [fa(1, 0), fa(2, 10)], labels) == [("Z", "dr"), ("Z", "dr")]


def test_class_split_and_any(spark):
    labels = [(key(A), 0, "X"), (key(A), 1, "X")]
    assert run(spark, [fa(1, 0)], labels) == [(None, None)]
    assert run(spark, [fa(1, 0)], labels, cardinality="any") == [("X", "uf")]


def test_null_key_kept_unlabelled(spark):
    f = [(1, None, None, 0)]
    assert run(spark, f, [(key(A), 0, "X")]) == [(None, None)]


def test_null_label_time_counts_as_occurrence(spark):
    assert run(spark, [fa(1, 0)], [(key(A), 0, "X"), (key(A), None, "Y")]) == [(None, None)]


def test_self_reverse_key_counted_once(spark):
    s = ("10.0.0.9", "10.0.0.9", "53", "53", "17")
    assert key(s) == rev(s)
    assert run(spark, [fa(1, 0, s)], [(key(s), 0, "X")]) == [("X", "uf")]


def test_labels_stay_on_their_rows(spark):
    keys = [("10.0.0.3", "10.0.0.2", "1", "80", "6"), ("10.0.0.2", "10.0.0.2", "1", "80", "6"),
            ("10.0.0.1", "10.0.0.2", "1", "80", "6")]
    flows = [fa(i, 0, k) for i, k in enumerate(keys)]
    labels = [(key(k), 0, c) for k, c in zip(keys, ("C3", "C2", "C1"))]
    assert [x[0] for x in run(spark, flows, labels)] == ["C3", "C2", "C1"]


def test_keys_compare_as_text(spark):
    a80 = ("10.0.0.1", "10.0.0.2", "1000", "080", "6")
    assert run(spark, [fa(1, 0)], [(key(a80), 0, "X")]) == [(None, None)]


def test_null_labels_ignored(spark):
    assert run(spark, [fa(1, 0), fa(2, 10)], [(key(A), 0, "X"), (key(A), 1, None)]) == \
        [("X", "df"), ("X", "df")]


def test_flow_without_time_dropped_before_counting(spark):
    assert run(spark, [fa(1, 0), fa(2, None)], [(key(A), 0, "X")]) == [("X", "uf"), (None, None)]


def test_zero_tolerance(spark):
    f = spark.createDataFrame([fa(1, 5), fa(2, 6)], "flow_id long, flow_key string, flow_key_rev string, "
                                                   "bidirectional_first_seen_ms long")
    lab = spark.createDataFrame([(key(A), 5, "X"), (key(A), 6, "X")], "flow_key string, ts_ms long, label string")
    got = [r.label for r in match_flows(f, lab, 0, sub_cell_ms=SUB["ms"]).orderBy("flow_id").collect()]
    assert got == ["X", "X"]


def test_one_row_per_flow_and_swap_invariance(spark):
    import sys
    sys.path.insert(0, "/root/repo")
    from flowsieve.plans import standins as S
    d = "/root/testdata/sf0.001"
    flows, labels = S.f2_flows(spark, d), S.f2_labels(spark, d)
    m = match_flows(flows, labels, S.F2_TOLERANCE_MS)
    assert m.count() == flows.count()
    assert m.select("flow_id").distinct().count() == flows.count()
    # writing every label from the other end swaps forward and reverse passes only
    parts = F.split("flow_key", r"\|")
    swapped = labels.withColumn("flow_key", F.concat_ws("|", parts[1], parts[0], parts[3], parts[2], parts[4]))
    m2 = match_flows(flows, swapped, S.F2_TOLERANCE_MS)
    ids1 = {r.flow_id for r in m.where("label is not null").select("flow_id").collect()}
    ids2 = {r.flow_id for r in m2.where("label is not null").select("flow_id").collect()}
    assert ids1 == ids2
