"""Hot keys: one key holding most rows must give the brute-force answer."""
import random
from collections import Counter

from flowsieve.operators.matching import match_flows
from flowsieve.operators.metering import meter_flows

HOT = "10.0.0.1|10.0.0.2|1000|80|6"
HOT_REV = "10.0.0.2|10.0.0.1|80|1000|6"


def brute(flows, labels, tol):
    """Pairs per flow, same rules as the library (split classes, both directions)."""
    from collections import Counter
    nf = Counter(k for _, k, _, t in flows if k is not None and t is not None)
    nl = Counter(k for k, _, _ in labels if k is not None)
    out = {}
    for fid, k, kr, t in flows:
        res = None
        if k is not None and t is not None:
            for d, jk in (("f", k), ("r", kr)):
                if d == "r" and (kr is None or kr == k):
                    continue
                cands = {lab for lk, lt, lab in labels
                         if lk == jk and lt is not None and abs(lt - t) <= tol
                         and (nf[k] == 1) == (nl[jk] == 1) and lab is not None}
                if len(cands) == 1:
                    res = cands.pop()
                    break
        out[fid] = res
    return out


import pytest


@pytest.mark.parametrize("sub_cell_ms", [1_000, 7_919, 3_600_000])
def test_hot_key_matches_brute_force(spark, sub_cell_ms):
    rnd = random.Random(7)
    flows, labels = [], []
    for i in range(1500):
        key, rev = (HOT, HOT_REV) if i % 10 else (f"10.9.{i}.1|10.0.0.2|1|80|6", f"10.0.0.2|10.9.{i}.1|80|1|6")
        flows.append((i, key, rev, rnd.randrange(0, 2_000_000) // 1000 * 1000))   # many equal ts
    for j in range(1200):
        key = HOT if j % 3 else HOT_REV
        ts = None if j % 97 == 0 else rnd.randrange(0, 2_000_000) // 500 * 500
        lab = "A" if ts is None or ts < 900_000 else ("B" if ts > 1_100_000 else rnd.choice("AB"))
        labels.append((key, ts, lab))
    tol = 30_000
    f = spark.createDataFrame(flows, "flow_id long, flow_key string, flow_key_rev string, "
                                     "bidirectional_first_seen_ms long")
    lab = spark.createDataFrame(labels, "flow_key string, ts_ms long, label string")
    got = {r.flow_id: r.label for r in match_flows(f, lab, tol, sub_cell_ms=sub_cell_ms).collect()}
    exp = brute(flows, labels, tol)
    assert got == exp
    assert sum(v is not None for v in exp.values()) > 100      # the case is not trivial


def test_hot_conversation_metering(spark):
    # one conversation with 3,000 packets and no idle gap: many active cuts
    rows = [(i, i * 50, "10.0.0.1", "10.0.0.2", 1000, 80, 6, 60) for i in range(3000)]
    df = spark.createDataFrame(rows, "packet_id long, ts_ms long, src_ip string, dst_ip string, "
                                     "src_port int, dst_port int, protocol int, bytes long")
    out = meter_flows(df, idle_ms=1000, active_ms=10_000).orderBy("bidirectional_first_seen_ms").collect()
    assert [r.bidirectional_first_seen_ms for r in out] == list(range(0, 150_000, 10_000))
    assert all(r.bidirectional_packets == 200 for r in out)
    assert [r.expiration_id for r in out] == [1] * 14 + [0]


def _brute(flows, labels, tol):
    """(flow_id -> label) of small lists: split by key count, forward then reverse."""
    n_f, n_l = Counter(k for _, k, _, t in flows if t is not None), Counter(k for k, _, _ in labels)

    def one(key, of, t):
        near = [lab for k, s, lab in labels if k == key and s is not None and abs(s - t) <= tol]
        found = {x for x in near if x is not None}
        return found.pop() if len(found) == 1 and (n_l[key] > 1) == (n_f[of] > 1) else None
    return {i: None if t is None else one(k, k, t) or (one(r, k, t) if r != k else None) for i, k, r, t in flows}


@pytest.mark.parametrize("hot_rows", [0, 60, 10 ** 6])
@pytest.mark.parametrize("tol", [0, 40, 5_000])
def test_few_rows_and_hot_keys_answer_alike(spark, hot_rows, tol):
    """Keys answered whole and keys answered by time cells, and flows of which one direction is hot."""
    rnd = random.Random(tol)
    keys = ["a", "b", "c", "d", "once"]
    flows = [(i, *rnd.choice([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("s", "s")]), rnd.choice([None, *range(0, 9_000, 30)]))
             for i in range(200)] + [(1000, "once", "d", 500), (1001, "e", "once", 500)]
    labels = [(rnd.choice(keys[:2] if i % 3 else keys[2:4]), rnd.choice([None, *range(0, 9_000, 30)]), rnd.choice(["x", "x", "x", "y", None]))
              for i in range(150)] + [("once", 500, "z")]
    f = spark.createDataFrame(flows, "flow_id long, flow_key string, flow_key_rev string, bidirectional_first_seen_ms long")
    lab = spark.createDataFrame(labels, "flow_key string, ts_ms long, label string")
    got = {r.flow_id: r.label for r in match_flows(f, lab, tol, sub_cell_ms=700, hot_rows=hot_rows).collect()}
    assert got == _brute(flows, labels, tol)


def test_forward_match_shuffles_rows_once(spark):
    """One shuffle of the narrow rows by key besides the two sides of the last join."""
    f = spark.createDataFrame([(i, f"k{i % 50}", i) for i in range(500)], "flow_id long, flow_key string, bidirectional_first_seen_ms long")
    lab = spark.createDataFrame([(f"k{i % 60}", i, "x") for i in range(500)], "flow_key string, ts_ms long, label string")
    plan = match_flows(f, lab, 10 ** 8, directions="forward")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_far_times_do_not_overflow(spark):
    big = 2 ** 63 - 1
    f = spark.createDataFrame([(1, "k", big), (2, "k", 5)], "flow_id long, flow_key string, bidirectional_first_seen_ms long")
    lab = spark.createDataFrame([("k", -big, "x"), ("k", 4, "y")], "flow_key string, ts_ms long, label string")
    assert {r.flow_id: r.label for r in match_flows(f, lab, 10, directions="forward").collect()} == {1: None, 2: "y"}
