"""The streaming state function cut across micro-batches equals one batch cut."""
import random

import pandas as pd

from flowsieve.operators.metering import meter_flows
from flowsieve.streaming import metering as SM
from flowsieve.streaming.metering import collect_points, make_state_fn, raw_schema, run_stream_to_table

KEY = ("10.0.0.1", 1000, "10.0.0.2", 80, 6)
_COLS = [c.split()[0] for c in raw_schema(False).split(", ")]


class FakeState:
    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, t):
        self.timeout = t


def packets(ts_list):
    return pd.DataFrame({"packet_id": range(len(ts_list)), "ts_ms": ts_list, "a_sends": True, "sized": True, "size": 10})


def run(ts_list, splits, idle, active):
    fn, st, out = make_state_fn(idle, active), FakeState(), []
    pdf = packets(ts_list)
    bounds = [0, *splits, len(ts_list)]
    for a, b in zip(bounds, bounds[1:]):
        for o in fn(KEY, iter([pdf.iloc[a:b]]), st):
            out.append(o)
        # the watermark reaches the last packet seen; fire the timeout if it passed
        wm = ts_list[b - 1]
        if st.exists and st.timeout is not None and wm > st.timeout:
            st.hasTimedOut = True
            out.extend(fn(KEY, iter([]), st))
            st.hasTimedOut = False
    st.hasTimedOut = True
    if st.exists:
        out.extend(fn(KEY, iter([]), st))
    df = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=_COLS)
    return list(zip(df["bidirectional_first"], df["bidirectional_packets"], df["expiration_id"]))


def test_cuts_do_not_depend_on_batch_boundaries():
    rnd = random.Random(3)
    for _ in range(40):
        ts, t = [], 0
        for _ in range(60):
            t += rnd.choice([1, 2, 3, 5, 8, 13, 40])
            ts.append(t)
        idle, active = rnd.choice([6, 10, 20]), rnd.choice([15, 30, 50])
        whole = run(ts, [], idle, active)
        cuts = sorted(rnd.sample(range(1, 60), rnd.randint(1, 6)))
        assert run(ts, cuts, idle, active) == whole, (ts, cuts, idle, active)
        assert sum(p for _, p, _ in whole) == 60


def test_active_cut_spanning_batches():
    ts = [0, 4, 8, 12, 16, 20, 24]          # gap 4 < idle 5; active 10
    assert run(ts, [2, 5], 5, 10) == [(0, 3, 1), (12, 3, 1), (24, 1, 0)]


def test_scope_leads_the_rows():
    st, out = FakeState(), []
    fn = make_state_fn(5, 100, ("capture",))
    out.extend(fn(("c1", *KEY), iter([packets([0, 10])]), st))
    st.hasTimedOut = True
    out.extend(fn(("c1", *KEY), iter([]), st))
    df = pd.concat(out, ignore_index=True)
    assert list(df.columns) == ["capture", *_COLS] and list(df["capture"]) == ["c1", "c1"]


def test_points_held_follow_the_time_span_and_not_the_packets(monkeypatch):
    """A flood of one conversation: 300 batches of 1,000 packets within 50 ms."""
    monkeypatch.setattr(SM, "PENDING", 500)
    seen, merge = [], SM.merge_points

    def watched(parts):
        seen.append(sum(len(p["ts"]) for p in parts))
        return merge(parts)
    monkeypatch.setattr(SM, "merge_points", watched)
    rnd = random.Random(5)

    def flood():
        for k in range(300):
            yield pd.DataFrame({"packet_id": range(k * 1000, k * 1000 + 1000),
                                "ts_ms": [rnd.randrange(50) for _ in range(1000)],
                                "a_sends": [rnd.random() < 0.5 for _ in range(1000)], "sized": True, "size": 3})
    p = collect_points(flood(), True)
    assert len(p["ts"]) == 100 and p["c"].sum() == 300_000 and p["sq"].sum() == 9 * 300_000
    assert max(seen) <= 1000  # one batch of packets; merges of points: 100 held and some 500 waiting


def test_a_late_packet_joins_the_open_flow():
    fn, st = make_state_fn(50, 1000), FakeState()
    list(fn(KEY, iter([packets([100, 120])]), st))
    list(fn(KEY, iter([packets([90, 125])]), st))
    assert st.value[:3] == (100, 125, True) and st.value[3 + SM.PACKETS] == 4


SCHEMA = "packet_id long, ts_ms long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, bytes long"


def test_statistics_equal_the_batch_meter_on_odd_packets(spark):
    """Both directions, equal times, unknown sizes, sizes near 2^40, no ports, one flow over many micro-batches."""
    rnd, rows, t = random.Random(11), [], 1_000_000
    for i in range(400):
        t += rnd.choice([0, 0, 1, 3, 40, 700])
        a, b = ("10.0.0.1", rnd.choice([1000, None])), ("10.0.0.2", 80)
        s, d = (a, b) if rnd.random() < 0.6 else (b, a)
        rows.append((i, t, s[0], d[0], s[1], d[1], 6, rnd.choice([60, 1500, None, 2**40 + i])))
    rows.append((400, None, "10.0.0.1", "10.0.0.2", 1000, 80, 6, 10))
    df = spark.createDataFrame(rows, SCHEMA)
    want = meter_flows(df, 500, 20_000, statistics=True)
    got = run_stream_to_table(spark, df, 500, 20_000, statistics=True)
    assert got.columns == want.columns
    cols = sorted(want.columns)
    key = lambda r: str(tuple(r))
    assert sorted(got.select(*cols).collect(), key=key) == sorted(want.select(*cols).collect(), key=key)
    plain, batch = run_stream_to_table(spark, df, 500, 20_000), meter_flows(df, 500, 20_000)
    cols = sorted(batch.columns)
    assert sorted(plain.select(*cols).collect(), key=key) == sorted(batch.select(*cols).collect(), key=key)


def test_empty_packets_keep_the_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = run_stream_to_table(spark, df, 500, 20_000, statistics=True)
    assert got.count() == 0 and set(got.columns) == set(meter_flows(df, 500, 20_000, statistics=True).columns)


def test_a_bucket_is_cut_in_one_call_as_its_conversations_are_alone():
    """30 conversations over four micro-batches: one frame a call and one state, the flows as from 30 states."""
    rnd, idle, active = random.Random(7), 40, 150
    rows = [(f"c{rnd.randrange(30)}", t, rnd.random() < 0.5, i) for i, t in enumerate(sorted(rnd.randrange(2000) for _ in range(900)))]
    pdf = pd.DataFrame(rows, columns=["conv", "ts_ms", "a_sends", "packet_id"]).assign(sized=True, size=lambda d: d.packet_id + 1)
    names = [c.split()[0] for c in SM._flow_schema(True).split(", ")]

    def flows(df):
        return [tuple(None if pd.isna(x) else x for x in r) for r in df[names].itertuples(index=False)]
    want = []
    for conv, part in pdf.groupby("conv"):
        fn, st = make_state_fn(idle, active, (), True), FakeState()
        got = [*fn(KEY, iter([part]), st)]
        st.hasTimedOut = True
        want += [(conv, *f) for o in [*got, *fn(KEY, iter([]), st)] for f in flows(o)]
    fn, st, got = SM.make_bucket_fn(idle, active, True), FakeState(), []
    for wm, part in zip((0, 499, 999, 1499), (pdf[pdf.ts_ms // 500 == k] for k in range(4))):
        st.getCurrentWatermarkMs = lambda wm=wm: wm
        out = list(fn((0,), iter([part.iloc[::-1][:100], part.iloc[::-1][100:]]), st))
        assert len(out) <= 1 and len(st.value) == 1
        got += out
    st.hasTimedOut, st.getCurrentWatermarkMs = True, lambda: 10_000
    got += fn((0,), iter([]), st)
    assert not st.exists
    assert sorted((c, *f) for o in got for c, f in zip(o["conv"], flows(o))) == sorted(want)
