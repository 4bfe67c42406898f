"""Streaming flow metering (M4): the batch meter's semantics on a packet stream.

Conversations are dealt by hash to buckets, and ``applyInPandasWithState`` runs once
per bucket and micro-batch; the state of a bucket is a table of its open flows. A call
per conversation would cost some milliseconds each, most of them spent on a data frame
for every closed flow. Packets arrive in Arrow batches in no order. Each batch is added
up to points ``(conversation, ts, direction)`` as it comes in, and points of different
batches are merged whenever they outgrow the merged ones, so a task holds at most about
twice the distinct points of a bucket in a micro-batch and one Arrow batch, however many
packets a flood sends. Points of all conversations are cut together with numpy (idle gaps
by ``diff``, active cuts by ``searchsorted`` from one flow start to the next, for all
sessions at once). An open flow is closed once the watermark passes ``last + idle``: in the
next call of its bucket, or by the bucket's event-time timeout; flows cut by
the active timeout are emitted when the packet that opens the next flow arrives.

``statistics=True`` keeps exact running sums for each direction in the state
and adds the batch meter's per-direction statistics (M3); means and deviations
are computed from them by the same column expressions.

Packets later than the watermark are dropped by Spark. A packet that is late,
but not that late, joins the conversation's open flow and counts at the time
of its last packet (a closed flow is never reopened). With in-order input the
output equals the batch meter (``operators.metering.meter_flows``) once the
watermark has passed every open flow.
"""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.metering import BASE_COLUMNS, CONV, canonical, deviation
from ..session import ship_package, shared_dir

ENDS = "src_ip string, dst_ip string, src_port long, dst_port long, protocol int"
#: Running figures of one direction; the two sums of squares are decimal texts, as they may pass 64 bits.
SIDE = ("first", "last", "packets", "sized", "size", "size_lo", "size_hi", "gap_lo", "gap_hi", "size_sq", "gap_sq")
FIRST, LAST, PACKETS, SIZED, SIZE, SIZE_LO, SIZE_HI, GAP_LO, GAP_HI, SIZE_SQ, GAP_SQ = range(len(SIDE))
#: Points waiting beside the merged ones before they are merged, at least.
PENDING = 20_000
#: Conversations share this many states; a bucket's open flows are one value of the state store.
BUCKETS = 256
_HIGH, _LOW = np.iinfo("int64").max, np.iinfo("int64").min
#: Columns of points: how each is merged.
_MERGE = {"least": np.minimum, "c": np.add, "sized": np.add, "size": np.add, "lo": np.minimum, "hi": np.maximum,
          "sq": np.add}


def sides(statistics: bool) -> tuple[str, ...]:
    return ("bidirectional", "a2b", "b2a") if statistics else ("bidirectional",)


def _side_schema(statistics: bool) -> str:
    return ", ".join(f"{side}_{f} {'string' if f.endswith('_sq') else 'long'}" for side in sides(statistics) for f in SIDE)


def _flow_schema(statistics: bool) -> str:
    return f"first_a boolean, expiration_id int, {_side_schema(statistics)}"


def raw_schema(statistics: bool) -> str:
    return f"{ENDS}, {_flow_schema(statistics)}"


def state_schema(statistics: bool) -> str:
    return f"start long, last long, first_a boolean, {_side_schema(statistics)}"


def merge_points(parts: list[dict]) -> dict:
    """Points of several parts as one part, sorted by ``(conv, ts, a)``, one for each of these."""
    cols = {k: np.concatenate([p[k] for p in parts]) for k in ("conv", "ts", "a", *_MERGE)}
    order = np.lexsort((cols["a"], cols["ts"], cols["conv"]))
    conv, ts, a = (cols[k][order] for k in ("conv", "ts", "a"))
    at = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (ts[1:] != ts[:-1]) | (a[1:] != a[:-1])])
    return {"conv": conv[at], "ts": ts[at], "a": a[at], **{k: f.reduceat(cols[k][order], at) for k, f in _MERGE.items()}}


def _packets_as_points(pdf: pd.DataFrame, statistics: bool, names: dict) -> dict:
    size = pdf["size"].to_numpy("int64")
    sized = pdf["sized"].to_numpy(bool)
    conv = np.zeros(len(pdf), "int64")
    if "conv" in pdf:
        code, found = pd.factorize(pdf["conv"])
        conv = np.array([names.setdefault(c, len(names)) for c in found], "int64")[code]
    return {"conv": conv, "ts": pdf["ts_ms"].to_numpy("int64"), "a": pdf["a_sends"].to_numpy(bool),
            "least": pdf["packet_id"].to_numpy("int64"), "c": np.ones(len(pdf), "int64"), "sized": sized.astype("int64"),
            "size": size, "lo": np.where(sized, size, _HIGH), "hi": np.where(sized, size, _LOW),
            "sq": size.astype(object) ** 2 if statistics else np.zeros(len(pdf), "int64")}


def collect_points(batches, statistics: bool, names: dict | None = None) -> dict | None:
    """Sorted points of all packets of ``batches`` (data frames in any order); None without packets.

    ``names`` numbers the conversations (column ``conv``) as they come; without that column all packets are of one.
    """
    held, pending, waiting = [], [], 0
    names = {} if names is None else names
    for pdf in batches:
        if len(pdf):
            pending.append(merge_points([_packets_as_points(pdf, statistics, names)]))
            waiting += len(pending[-1]["ts"])
        if waiting > max(PENDING, sum(len(p["ts"]) for p in held)):
            held, pending, waiting = [merge_points(held + pending)], [], 0
    parts = held + pending
    return merge_points(parts) if parts else None


def _blank(n: int, statistics: bool) -> dict:
    """A table of ``n`` flows without packets: what is unknown holds the neutral element of its merge."""
    empty = {"size_lo": _HIGH, "size_hi": _LOW, "gap_lo": _HIGH, "gap_hi": _LOW}
    return {"conv": np.zeros(n, "int64"), "start": np.zeros(n, "int64"), "last": np.zeros(n, "int64"), "first_a": np.zeros(n, bool),
            **{f"{side}_{f}": np.full(n, empty.get(f, 0), object if f.endswith("_sq") else "int64")
               for side in sides(statistics) for f in SIDE}}


def _rows(table: dict, at) -> dict:
    return {k: v[at] for k, v in table.items()}


def _absorb(flows: dict, side: str, p: dict, flow: np.ndarray, statistics: bool) -> None:
    """Points of one direction added to the figures of their flows (ascending numbers ``flow``)."""
    if not len(flow):
        return
    head = np.flatnonzero(np.r_[True, flow[1:] != flow[:-1]])
    f, ts = flow[head], p["ts"]
    col = {c: flows[f"{side}_{c}"] for c in SIDE}
    known, last = col["packets"][f] > 0, col["last"][f]
    col["first"][f] = np.where(known, col["first"][f], ts[head])
    col["last"][f] = ts[np.r_[head[1:], len(ts)] - 1]
    for c, v in (("packets", "c"), ("sized", "sized"), ("size", "size")):
        col[c][f] += np.add.reduceat(p[v], head)
    if not statistics:
        return
    gap, timed = np.diff(ts, prepend=ts[:1]), np.ones(len(ts), bool)
    gap[head], timed[head] = np.where(known, ts[head] - last, 0), known
    none_apart = p["c"] > 1  # packets of one point are no time apart
    least = np.where(none_apart, 0, np.where(timed, gap, _HIGH))
    most = np.maximum(np.where(timed, gap, _LOW), np.where(none_apart, 0, _LOW))
    for c, how, v in (("gap_lo", np.minimum, least), ("gap_hi", np.maximum, most),
                      ("size_lo", np.minimum, p["lo"]), ("size_hi", np.maximum, p["hi"]),
                      ("size_sq", np.add, p["sq"]), ("gap_sq", np.add, gap.astype(object) ** 2)):
        col[c][f] = how(col[c][f], how.reduceat(v, head))


def advance(p: dict, open_: dict, idle: int, active: int, statistics: bool) -> tuple[dict, dict]:
    """(closed flows with their ``expiration_id``, open flows) after the sorted points ``p`` met the open flows.

    ``open_`` has at most one flow for a conversation; those without points stay as they are.
    """
    conv, n = p["conv"], len(p["conv"])
    is_first = np.r_[True, conv[1:] != conv[:-1]]
    first = np.flatnonzero(is_first)
    nth = np.cumsum(is_first) - 1
    slot = np.full(max(int(conv[-1]), int(open_["conv"].max(initial=0))) + 1, -1)
    slot[open_["conv"]] = np.arange(len(open_["conv"]))
    old = slot[conv[first]]
    met = old >= 0
    last, due = np.full(len(first), _LOW), np.zeros(len(first), "int64")
    last[met], due[met] = open_["last"][old[met]], open_["start"][old[met]] + active
    ts = np.maximum(p["ts"], last[nth])
    p = {**p, "ts": ts}
    # gap before each point; the first one of a conversation is measured from its open flow
    before = np.r_[ts[:1], ts[:-1]]
    before[first] = np.where(met, last, ts[first])
    gap = ts - before >= idle
    session = np.flatnonzero(gap | is_first)
    end = np.r_[session[1:], n]
    times = np.unique(ts)
    place = nth * (len(times) + 1) + np.searchsorted(times, ts)

    def reach(of, t):
        """The first point of conversations ``of`` at or after ``t``."""
        return np.searchsorted(place, of * (len(times) + 1) + np.searchsorted(times, t))
    opens, by_active = gap.copy(), np.zeros(n, bool)
    opens[first] |= ~met
    # active cuts: from an open flow's start, then from each flow start to the next, for all sessions at once
    goes_on = ~opens[session]
    here, stop = session.copy(), end
    here[goes_on] = reach(nth[session[goes_on]], due[nth[session[goes_on]]])
    inside = here < stop
    by_active[here[goes_on & inside]] = True
    here, stop = here[inside], stop[inside]
    while len(here):
        here = reach(nth[here], ts[here] + active)
        inside = here < stop
        here, stop = here[inside], stop[inside]
        by_active[here] = True
    opens |= by_active
    head = np.flatnonzero(opens | is_first)
    flow = np.cumsum(opens | is_first) - 1
    goes_on = ~opens[head]
    table = _blank(len(head), statistics)
    follows = old[nth[head[goes_on]]]
    for k, v in table.items():
        v[goes_on] = open_[k][follows]
    fresh = head[~goes_on]
    twin = np.minimum(fresh + 1, n - 1)  # the other direction's point at the same time
    other = (conv[twin] == conv[fresh]) & (ts[twin] == ts[fresh]) & (p["least"][twin] < p["least"][fresh])
    table["conv"], table["last"] = conv[head], ts[np.r_[head[1:], n] - 1]
    table["start"][~goes_on], table["first_a"][~goes_on] = ts[fresh], np.where(other, p["a"][twin], p["a"][fresh])
    for side, at in zip(sides(statistics), (slice(None), p["a"], ~p["a"])):
        _absorb(table, side, _rows(p, at), flow[at], statistics)
    # a flow is closed by the next one of its conversation
    ended = np.r_[conv[head[1:]] == conv[head[:-1]], False]
    gone = met & opens[first]
    closed = merged([{**_rows(open_, old[gone]), "expiration_id": by_active[first[gone]].astype(int)},
                     {**_rows(table, ended), "expiration_id": by_active[head[1:]][ended[:-1]].astype(int)}])
    stays = np.ones(len(open_["conv"]), bool)
    stays[old[met]] = False
    return closed, merged([_rows(open_, stays), _rows(table, ~ended)])


def merged(tables: list[dict]) -> dict:
    return {k: np.concatenate([t[k] for t in tables]) for k in tables[0]}


def _figures(flows: dict, statistics: bool) -> dict:
    """The columns of both directions with nulls for what is unknown, the sums of squares as texts."""
    out = {}
    for side in sides(statistics):
        n, sized = flows[f"{side}_packets"], flows[f"{side}_sized"]
        unknown = {"first": n == 0, "last": n == 0, "size_lo": sized == 0, "size_hi": sized == 0, "gap_lo": n < 2, "gap_hi": n < 2}
        for f in SIDE:
            v = flows[f"{side}_{f}"]
            out[f"{side}_{f}"] = (np.array([str(x) for x in v], object) if f.endswith("_sq")
                                  else pd.arrays.IntegerArray(v, unknown.get(f, np.zeros(len(v), bool)) | (not statistics and f[-3:] in ("_lo", "_hi"))))
    return out


def _table(figures: dict, statistics: bool) -> dict:
    """A table of flows from its columns with nulls."""
    out = _blank(len(figures["start"]), statistics)
    for k, v in out.items():
        if k in figures:
            here = ~pd.isna(figures[k])
            v[here] = [int(x) for x in figures[k][here]] if v.dtype == object else figures[k][here].astype(v.dtype)
    return out


def make_state_fn(idle: int, active: int, scope=(), statistics: bool = False):
    """The cutting of one conversation; its state is a row of its open flow (``state_schema``)."""
    names = [c.split()[0] for c in state_schema(statistics).split(", ")]

    def fn(key, batches, state):
        a_ip, a_port, b_ip, b_port, protocol = key[len(scope):]
        a_port, b_port, protocol = (None if pd.isna(x) else int(x) for x in (a_port, b_port, protocol))
        ends = {True: (a_ip, b_ip, a_port, b_port, protocol), False: (b_ip, a_ip, b_port, a_port, protocol)}

        def frame(flows):
            figures = pd.DataFrame({"first_a": flows["first_a"], "expiration_id": flows["expiration_id"], **_figures(flows, statistics)})
            lead = pd.DataFrame([(*key[:len(scope)], *ends[bool(a)]) for a in flows["first_a"]], dtype=object,
                                columns=[*scope, *[c.split()[0] for c in ENDS.split(", ")]])
            return pd.concat([lead, figures], axis=1)
        held = [state.get] if state.exists else []
        open_ = _table({c: np.array([r[i] for r in held], object) for i, c in enumerate(names)}, statistics)
        if state.hasTimedOut:
            state.remove()
            yield frame({**open_, "expiration_id": np.zeros(1, int)})
            return
        p = collect_points(batches, statistics)
        if p is None:
            return
        closed, open_ = advance(p, open_, idle, active, statistics)
        figures = {"start": open_["start"], "last": open_["last"], "first_a": open_["first_a"], **_figures(open_, statistics)}
        state.update(tuple(None if pd.isna(v[0]) else v[0] if isinstance(v[0], str) else v[0].item() for v in (figures[c] for c in names)))
        state.setTimeoutTimestamp(int(open_["last"][0]) + idle)
        if len(closed["conv"]):
            yield frame(closed)
    return fn


def _packed(texts: list, flows: dict, statistics: bool) -> bytes:
    """Open flows of a bucket as an Arrow stream."""
    import pyarrow as pa

    figures = {"conv": np.array(texts, object), "start": flows["start"], "last": flows["last"], "first_a": flows["first_a"],
               **_figures(flows, statistics)}
    batch = pa.RecordBatch.from_pandas(pd.DataFrame(figures), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict:
    import pyarrow as pa

    table = pa.ipc.open_stream(data).read_all()
    return {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) if not table[c].null_count
            else np.array(table[c].to_pylist(), object) for c in table.column_names}


def make_bucket_fn(idle: int, active: int, statistics: bool = False):
    """The cutting of all conversations of a bucket; its state is the table of their open flows."""
    def fn(key, batches, state):
        names, open_ = {}, _blank(0, statistics)
        if state.exists:
            figures = _unpacked(bytes(state.get[0]))
            names.update((c, i) for i, c in enumerate(figures.pop("conv")))
            open_ = _table(figures, statistics)
            open_["conv"] = np.arange(len(names))
        p = None if state.hasTimedOut else collect_points(batches, statistics, names)
        out = []
        if p is not None:
            closed, open_ = advance(p, open_, idle, active, statistics)
            out.append(closed)
        over = open_["last"] + idle < state.getCurrentWatermarkMs()
        out.append({**_rows(open_, over), "expiration_id": np.zeros(int(over.sum()), int)})
        open_ = _rows(open_, ~over)
        text = list(names)
        if len(open_["conv"]):
            state.update((_packed([text[i] for i in open_["conv"]], open_, statistics),))
            state.setTimeoutTimestamp(int(open_["last"].min()) + idle)
        elif state.exists:
            state.remove()
        closed = merged(out)
        if len(closed["conv"]):
            yield pd.DataFrame({"conv": [text[i] for i in closed["conv"]], "first_a": closed["first_a"],
                                "expiration_id": closed["expiration_id"], **_figures(closed, statistics)})
    return fn


def _statistics(side: str, digits: int) -> dict:
    """The batch meter's statistics of one direction from its running figures."""
    def c(name):
        return F.col(f"{side}_{name}")
    n_gap = F.when(c("packets") > 1, c("packets") - 1)
    gaps, size_sq, gap_sq = c("last") - c("first"), c("size_sq").cast("decimal(38,0)"), c("gap_sq").cast("decimal(38,0)")
    return {
        "first_seen_ms": c("first"), "last_seen_ms": c("last"), "duration_ms": gaps, "packets": c("packets"), "bytes": c("size"),
        "min_ps": c("size_lo"), "mean_ps": F.round(F.try_divide(c("size").cast("double"), c("sized")), digits),
        "stddev_ps": F.round(deviation(c("sized"), c("size"), size_sq), digits), "max_ps": c("size_hi"),
        "min_piat_ms": c("gap_lo"), "mean_piat_ms": F.round(F.try_divide(gaps.cast("double"), n_gap), digits),
        "stddev_piat_ms": F.round(deviation(n_gap, gaps, gap_sq), digits), "max_piat_ms": c("gap_hi"),
    }


def _finished(raw: DataFrame, scope, statistics: bool, digits: int) -> DataFrame:
    """Closed flows with the columns of the batch meter."""
    bi = _statistics("bidirectional", digits)
    head = [*scope, *BASE_COLUMNS[:5], *[bi[c.removeprefix("bidirectional_")].alias(c) for c in BASE_COLUMNS[5:9]]]
    if not statistics:  # a flow has no bytes only if no packet has a size, as in the batch meter
        nbytes = F.when(F.col("bidirectional_sized") > 0, F.col("bidirectional_size"))
        return raw.select(*head, nbytes.alias("bidirectional_bytes"), "expiration_id")
    a2b, b2a = _statistics("a2b", digits), _statistics("b2a", digits)
    by_sender = []
    for n in a2b:
        by_sender.append(F.when(F.col("first_a"), a2b[n]).otherwise(b2a[n]).alias(f"src2dst_{n}"))
        by_sender.append(F.when(F.col("first_a"), b2a[n]).otherwise(a2b[n]).alias(f"dst2src_{n}"))
    rest = [v.alias(f"bidirectional_{n}") for n, v in bi.items() if f"bidirectional_{n}" not in BASE_COLUMNS]
    return raw.select(*head, bi["bytes"].alias("bidirectional_bytes"), "expiration_id", *by_sender, *rest)


def _scoped(schema, scope, rest: str) -> str:
    return ", ".join([*(f"`{c}` {schema[c].dataType.simpleString()}" for c in scope), rest])


def _conversation(scope) -> Column:
    """The scope and conversation columns as one text, from which ``_named`` reads them again."""
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in (*scope, *CONV)]))


def _named(flows: DataFrame, schema, scope, statistics: bool) -> DataFrame:
    """Closed flows with the columns of their conversation, the source being the sender of the first packet."""
    part = F.from_json("conv", "array<string>")
    c = {n: F.element_at(F.col("__conv"), i + 1).cast(schema[n].dataType) for i, n in enumerate((*scope, *CONV))}

    def end(name, a, b):
        return F.when(F.col("first_a"), c[a]).otherwise(c[b]).alias(name)
    return flows.withColumn("__conv", part).select(
        *[c[n].alias(n) for n in scope], end("src_ip", "a_ip", "b_ip"), end("dst_ip", "b_ip", "a_ip"),
        end("src_port", "a_port", "b_port").cast("long"), end("dst_port", "b_port", "a_port").cast("long"),
        c["protocol"].cast("int").alias("protocol"), *[x.split()[0] for x in _flow_schema(statistics).split(", ")])


def meter_flows_stream(packets_stream: DataFrame, idle_ms: int, active_ms: int,
                       watermark: str, scope=(), statistics: bool = False, digits: int = 6, buckets: int = BUCKETS) -> DataFrame:
    """Streaming DataFrame of closed flows (append mode), with the columns of ``meter_flows``.

    ``scope``: columns (scenario, capture) that keep captures apart and lead the output. ``statistics``: adds
    per-direction statistics, rounded to ``digits``. ``buckets``: how many states the conversations share; it is part of
    the query's checkpoint and bounds its parallelism, and a state is some 200 bytes for each open flow of the bucket.

    ``watermark``: how late a packet may come; a later one is dropped, so there is no default. Packets without a
    time are left out, as in the batch meter; the progress of the query counts them in the observed metric
    ``packets_without_time``.
    """
    ship_package(packets_stream.sparkSession)
    idle, active = int(idle_ms), int(active_ms)
    if idle <= 0 or active <= 0:
        raise ValueError("timeouts must be > 0")
    timed = packets_stream.observe("packets_without_time", F.count_if(F.col("ts_ms").isNull()).alias("n")).where(
        F.col("ts_ms").isNotNull())
    pk = canonical(timed).withColumn("conv", _conversation(scope))
    s = (pk.select("conv", F.pmod(F.xxhash64("conv"), F.lit(int(buckets))).cast("int").alias("bucket"), "a_sends",
                   F.col("ts_ms").cast("long").alias("ts_ms"),
                   F.coalesce(F.col("packet_id").cast("long"), F.lit(_HIGH)).alias("packet_id"),
                   F.col("bytes").isNotNull().alias("sized"),
                   F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("size"),
                   F.timestamp_millis("ts_ms").alias("event_time"))
         .withWatermark("event_time", watermark))
    flows = (s.groupBy("bucket")
              .applyInPandasWithState(make_bucket_fn(idle, active, statistics), f"conv string, {_flow_schema(statistics)}",
                                      "open_flows binary", "append", GroupStateTimeout.EventTimeTimeout))
    return _finished(_named(flows, pk.schema, scope, statistics), scope, statistics, digits)


#: Not an address, so no packet can carry it (0.0.0.0 is the source of every DHCP discover).
SENTINEL_IP = "end of input"


def run_stream_to_table(spark: SparkSession, packets: DataFrame, idle_ms: int, active_ms: int,
                        slice_packets: int = 1_000_000, scope=(), statistics: bool = False) -> DataFrame:
    """Replay a packet table as a stream arriving in time slices, meter it, return the closed flows.

    There are enough slices for ``slice_packets`` packets each on average, and eight at least.

    The packets are staged once, partitioned by time slice. Each step appends one
    slice to the stream's input folder and runs the same query (same checkpoint,
    ``availableNow``), so slices arrive in time order exactly as a live feed would.
    Two sentinel packets on a reserved conversation then move the watermark past
    every open flow; the sink is read back without the sentinel conversation.
    """
    root = f"{shared_dir(spark)}/meter-stream-{uuid.uuid4().hex}"
    cols = [*scope, "packet_id", "ts_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes"]
    pk = packets.select(*cols)
    empty = _finished(spark.createDataFrame([], _scoped(pk.schema, scope, raw_schema(statistics))), scope, statistics, 6)
    lo, hi, n = pk.agg(F.min("ts_ms"), F.max("ts_ms"), F.count("ts_ms")).first()
    if lo is None:
        return empty
    phases = max(8, -(-n // slice_packets))
    width = max(1, (hi - lo + phases) // phases)
    (pk.withColumn("slice", F.call_function("div", F.col("ts_ms") - F.lit(lo), F.lit(width)).cast("int"))
       .write.mode("overwrite").partitionBy("slice").parquet(f"{root}/staged"))
    staged = spark.read.parquet(f"{root}/staged")
    sentinels = [(*[None] * len(scope), -1 - k, t, SENTINEL_IP, SENTINEL_IP, 0, 0, 0, 0)
                 for k, t in enumerate((hi + idle_ms + 1, hi + 2 * idle_ms + 2))]

    def run_once():
        stream = spark.readStream.schema(pk.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        q = (meter_flows_stream(stream, idle_ms, active_ms, "0 seconds", scope, statistics).writeStream.format("parquet")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    for k in range(phases):
        staged.where(F.col("slice") == k).drop("slice").write.parquet(f"{root}/in/phase-{k:06d}")
        run_once()
    for k, row in enumerate(sentinels):
        spark.createDataFrame([row], pk.schema).write.parquet(f"{root}/in/sentinel-{k}")
        run_once()
    return spark.read.schema(empty.schema).parquet(f"{root}/out").where(
        ~F.col("src_ip").eqNullSafe(SENTINEL_IP))
