"""Label streams against the batch match, and key majorities."""
import uuid

import pytest
from conftest import SF_SMALL

from flowsieve.operators import matching as M
from flowsieve.plans import standins as S
from flowsieve.session import shared_dir
from flowsieve.streaming import labelling as LS

FLOW = "flow_id long, flow_key string, bidirectional_first_seen_ms long"
LABEL = "flow_key string, ts_ms long, label string"


def test_stream_equals_batch_and_state_shrinks(spark):
    flows, labels, log = S.f2_flows(spark, SF_SMALL), S.f2_labels(spark, SF_SMALL), []
    got = LS.replay_labels(spark, flows, labels, 3_600_000, phases=6, log=log).select("flow_id", "label").collect()
    want = M.match_flows(flows, labels, 3_600_000, cardinality="any", directions="forward").select("flow_id", "label").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    state = [p["state_rows"] for p in log]
    assert max(state) < flows.count() + labels.count() and state[-1] <= 5  # only the closing rows are left
    assert not any(p["late_rows"] for p in log)


def test_ties_nulls_and_copies(spark):
    flows = spark.createDataFrame([(1, "a", 1000), (2, "a", 5000), (3, "b", 1000), (4, None, 1000), (5, "c", None), (6, "d", 1000),
                                   (7, "a", 1000)], FLOW)
    labels = spark.createDataFrame([("a", 900, "x"), ("a", 900, "x"), ("a", 1100, "x"), ("b", 1000, "x"), ("b", 1001, "y"),
                                    ("c", 1000, "x"), (None, 1000, "x"), ("d", 1000, None), ("d", 1900, "z"), ("a", None, "q")], LABEL)
    got = sorted((r["flow_id"], r["label"], r["n_candidates"]) for r in LS.replay_labels(spark, flows, labels, 200, phases=2).collect())
    assert got == [(1, "x", 3), (2, None, 0), (3, None, 2), (4, None, 0), (5, None, 0), (6, None, 1), (7, "x", 3)]


def test_labels_wait_for_open_flows(spark):
    """The watermark passes a label's own tolerance while a flow that it reaches is still open; state is one value a bucket."""
    edges = [0, 1000, 2000]
    flows = spark.createDataFrame([(i, "edge", t) for i, t in enumerate(edges)] + [(10, "a", 900), (11, "a", 1150), (12, "b", 990), (12, "b", 990)], FLOW)
    labels = spark.createDataFrame([("edge", t, None) for t in edges] + [("a", 710, "x"), ("a", 1100, "x"), ("b", 800, "y"), ("b", 1190, "y")], LABEL)
    log = []
    out = LS.replay_labels(spark, flows, labels, 200, phases=2, log=log).where("flow_id >= 10").collect()
    assert sorted((r["flow_id"], r["label"], r["n_candidates"]) for r in out) == [(10, "x", 2), (11, "x", 1), (12, "y", 4)]
    assert max(p["state_rows"] for p in log) <= 4  # keys: edge, a, b, and that of the closing rows


def test_flow_columns_pass_through(spark):
    schema = "flow_id long, flow_key string, bidirectional_first_seen_ms long, at timestamp, wall timestamp_ntz, big decimal(30,4), some array<string>, x double"
    flows = spark.sql("SELECT 9007199254740993L, 'k', 5L, TIMESTAMP'2024-01-01 00:00:00.123456Z', TIMESTAMP_NTZ'2024-01-01 00:00:00.654321', "
                      "CAST(12345678901234567890.1234 AS DECIMAL(30,4)), array('p', null), double('NaN') UNION ALL "
                      "SELECT 2L, 'k', 7L, null, null, null, null, null").toDF(*[c.split()[0] for c in schema.split(", ")])
    labels = spark.createDataFrame([("k", 6, "x")], LABEL)
    out = LS.replay_labels(spark, flows, labels, 10, phases=1)
    assert out.drop("label", "n_candidates").exceptAll(flows).isEmpty() and out.where("label = 'x' AND n_candidates = 1").count() == 2


def test_late_rows_are_counted(spark):
    root = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"

    def step(k, flows, labels):
        spark.createDataFrame(flows, FLOW).write.parquet(f"{root}/in/f/{k}")
        spark.createDataFrame(labels, LABEL).write.parquet(f"{root}/in/l/{k}")
        read = [spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(f"{root}/in/{n}") for n, s in (("f", FLOW), ("l", LABEL))]
        q = (LS.label_stream(*read, 100, "0 seconds").writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        return LS.progress(q)
    step(0, [(1, "a", 10_000)], [("a", 10_050, "x")])
    step(1, [(2, "a", 90_000)], [("a", 90_000, "y")])
    late = step(2, [(3, "a", 5_000)], [("a", 5_000, "z")])
    assert sum(p["late_rows"] for p in late) >= 2  # the flow and the label, each at its first operator
    step(3, [(4, "b", 200_000)], [("b", 200_000, "y")])
    out = {r["flow_id"]: r["label"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert out[1] == "x" and out[2] == "y" and 3 not in out


def test_majority_of_a_key(spark):
    flows = spark.createDataFrame([(1, "one", 0), (2, "most", 0), (3, "tie", 0), (4, "few", 0), (5, "null", 0), (6, "none", 0),
                                   (7, None, 0), (8, "twice", 0), (9, "twice", 9), (10, "most", 50_000)], FLOW)
    far = 10 ** 9
    labels = [("one", far, "x"), ("twice", far, "x"), *[("most", far, "x")] * 8, ("most", far, "y"), ("most", far + 1, None), ("tie", far, "x"),
              ("tie", far, "y"), ("few", far, "x"), ("few", far, "x"), ("few", far, "y"), ("null", far, None), (None, far, "x"), ("most", 50_000, "near")]
    lab = spark.createDataFrame(labels, LABEL)
    matched = M.match_flows(flows, lab, 1000, directions="forward")
    got = {r["flow_id"]: (r["label"], r["match_pass"]) for r in M.label_majority(matched, lab, 0.7).collect()}
    no = (None, None)
    assert got == {1: ("x", "k1"), 2: ("x", "km"), 3: no, 4: no, 5: no, 6: no, 7: no, 8: ("x", "km"), 9: ("x", "km"), 10: ("near", "df")}
    low = {r["flow_id"]: r["label"] for r in M.label_majority(matched, lab, 0.0).collect()}
    assert low[3] is None and low[4] == "x"  # a tie has no majority at any threshold
    with pytest.raises(ValueError):
        M.label_majority(matched, lab, 1.0)
