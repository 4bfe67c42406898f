"""Flow labels on two streams (X1): both streams in one stateful step, by buckets of keys.

A flow gets a label when all labels of its key within the tolerance agree, as in the batch match
with ``cardinality="any", directions="forward"``. Each stream has its watermark, and the smaller one counts. Keys are dealt by hash
to buckets, and ``applyInPandasWithState`` runs once per bucket and micro-batch. The state of a bucket is one value: its open flows and
the labels that open or coming flows can reach, copies of a row with their number. Two joined streams and two
aggregations in Spark's own state would keep each flow's row three times and write six stores a partition and micro-batch.

A flow leaves once the watermark has passed ``ts + tolerance``, with the labels found by ``searchsorted`` for all flows of the
bucket at once; a label after twice the tolerance, when every flow that it could reach has left or would be late. A row behind the watermark is dropped by Spark and
counted (``progress``). Rows without a key or time can match nothing and carry no event time: ``untimed`` gives them, with a null label.
"""
from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import shared_dir, ship_package

LABEL_COLUMNS = "label string, n_candidates long"
#: Keys share this many states; a bucket's open flows and labels are one value of the state store.
BUCKETS = 256
#: Flow rows are kept as text, times to the microsecond.
_ROW_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_OPEN = ["kind", "key", "ts", "value", "n"]


def _pack(rows: pd.DataFrame) -> bytes:
    import pyarrow as pa

    table = pa.table({c: pa.array(rows[c], pa.string() if c in ("key", "value") else pa.int64(), from_pandas=True) for c in _OPEN})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all().to_pandas()


def _merged(parts: list) -> pd.DataFrame:
    """Rows of all parts, equal ones added up."""
    rows = pd.concat(parts, ignore_index=True)
    return rows.groupby(["kind", "key", "ts", "value"], dropna=False, sort=False, as_index=False)["n"].sum()


def _answers(flows: pd.DataFrame, labels: pd.DataFrame, tol: int) -> pd.DataFrame:
    """Flow rows with the label that all labels within ``tol`` agree on, and the number of label rows there."""
    code, _ = pd.factorize(np.concatenate([flows["key"].to_numpy(object), labels["key"].to_numpy(object)]))
    of, at = code[:len(flows)].astype("int64"), code[len(flows):].astype("int64")
    t, ts = flows["ts"].to_numpy("int64"), labels["ts"].to_numpy("int64")
    order = np.lexsort((ts, at))
    times = np.unique(ts)
    wide = len(times) + 1
    place = (at * wide + np.searchsorted(times, ts))[order]
    ends = [of * wide + np.searchsorted(times, t - tol, "left"), of * wide + np.searchsorted(times, t + tol, "right")]
    rows_upto = np.r_[0, np.cumsum(labels["n"].to_numpy("int64")[order])]
    lo, hi = (np.searchsorted(place, e, "left") for e in ends)
    names, found = pd.factorize(labels["value"].to_numpy(object)[order])  # no label: -1
    known = names >= 0
    place, names = place[known], names[known]
    first, last = (np.searchsorted(place, e, "left") for e in ends)
    changes = np.cumsum(np.r_[0, names[1:] != names[:-1]]) if len(names) else np.zeros(0, "int64")
    label = np.full(len(flows), None, object)
    some = np.flatnonzero(last > first)
    some = some[changes[last[some] - 1] == changes[first[some]]]
    label[some] = np.asarray(found, object)[names[first[some]]]
    # copies of a flow row are one row; their candidates add up
    return pd.DataFrame({"row": flows["value"].to_numpy(object), "label": label,
                         "n_candidates": (rows_upto[hi] - rows_upto[lo]) * flows["n"].to_numpy("int64")})


def _step(key, batches, state, tol: int):
    """One bucket in one micro-batch, or when the watermark has passed its first open flow."""
    parts = [_unpack(state.get[0])] if state.exists else []
    for pdf in batches:
        if len(pdf):
            parts.append(_merged([pdf.assign(n=1)[_OPEN]]))
    if not parts:
        return
    rows = _merged(parts)
    flow = rows["kind"].to_numpy("int64") == 1
    # an open flow is later than the watermark less the tolerance, and reaches back by another
    ends = rows["ts"].to_numpy("int64") + np.where(flow, tol, 2 * tol)
    due = ends <= state.getCurrentWatermarkMs()
    if (due & flow).any():
        yield _answers(rows[due & flow], rows[~flow], tol)
    rows, flow, ends = rows[~due], flow[~due], ends[~due]
    if not len(rows):
        state.remove()
        return
    state.update((_pack(rows),))
    state.setTimeoutTimestamp(int(ends[flow].min() if flow.any() else ends.max()))


def label_stream(flows: DataFrame, labels: DataFrame, tolerance_ms: int, watermark: str, flow_id: str = "flow_id",
                 flow_ts: str = "bidirectional_first_seen_ms", buckets: int = BUCKETS) -> DataFrame:
    """Streaming flows with ``label`` and ``n_candidates`` (append mode).

    ``flows`` has a unique ``flow_id``, ``flow_key`` and a time in epoch milliseconds; ``labels`` has ``flow_key``,
    ``ts_ms`` and ``label``. ``watermark`` is how late a row of either stream may come; there is no default.
    """
    ship_package(flows.sparkSession)

    def events(df, ts, kind, value):
        timed = df.where(F.col("flow_key").isNotNull() & F.col(ts).isNotNull()).withColumn("__ms", F.col(ts).cast("long"))
        return (timed.withColumn("__time", F.timestamp_millis("__ms")).withWatermark("__time", watermark)
                     .select("__time", F.pmod(F.xxhash64("flow_key"), F.lit(buckets)).alias("bucket"), F.lit(kind).cast("long").alias("kind"),
                             F.col("flow_key").alias("key"), F.col("__ms").alias("ts"), value.alias("value")))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in flows.columns]), _ROW_TEXT)
    both = events(flows, flow_ts, 1, row).unionAll(events(labels, "ts_ms", 0, F.col("label").cast("string")))
    out = both.groupBy("bucket").applyInPandasWithState(
        partial(_step, tol=int(tolerance_ms)), f"row string, {LABEL_COLUMNS}", "open binary", "append", GroupStateTimeout.EventTimeTimeout)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in flows.schema])
    return out.select(F.from_json("row", schema, _ROW_TEXT).alias("row"), "label", "n_candidates").select("row.*", "label", "n_candidates")


def untimed(flows: DataFrame, flow_ts: str = "bidirectional_first_seen_ms") -> DataFrame:
    """Flows without key or time, as the stream would give them if it could: no label, no candidate."""
    return flows.where(F.col("flow_key").isNull() | F.col(flow_ts).isNull()).withColumns(
        {"label": F.lit(None).cast("string"), "n_candidates": F.lit(0).cast("long")})


def progress(query) -> list[dict]:
    """Per micro-batch of a query: rows in state over all its operators, and late rows dropped so far by each."""
    return [{"batch": p["batchId"], "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"]),
             "late_rows": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])} for p in query.recentProgress]


def replay_labels(spark: SparkSession, flows: DataFrame, labels: DataFrame, tolerance_ms: int, phases: int = 4,
                  watermark: str = "0 seconds", flow_ts: str = "bidirectional_first_seen_ms", log: list | None = None) -> DataFrame:
    """Both tables replayed as streams that arrive in ``phases`` time slices; the labelled flows.

    Each step appends one slice to both input folders and runs the same query on one checkpoint. A last
    flow and label, of a key that no flow can have, move both watermarks past every open row. ``log`` receives ``progress`` rows.
    """
    root = f"{shared_dir(spark)}/label-stream-{uuid.uuid4().hex}"
    labels = labels.select("flow_key", F.col("ts_ms").cast("long").alias("ts_ms"), "label")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flows.schema), LABEL_COLUMNS])
    span = flows.select(F.col(flow_ts).alias("t")).union(labels.select("ts_ms")).agg(F.min("t"), F.max("t")).first()
    if span[0] is None:
        return untimed(flows, flow_ts)
    lo, hi = int(span[0]), int(span[1])
    width = max(1, (hi - lo + phases) // phases)
    for name, df, ts in (("flows", flows, flow_ts), ("labels", labels, "ts_ms")):
        (df.where(F.col(ts).isNotNull()).withColumn("slice", F.call_function("div", F.col(ts).cast("long") - lo, F.lit(width)).cast("int"))
           .write.partitionBy("slice").parquet(f"{root}/staged/{name}"))
        df.limit(0).write.parquet(f"{root}/in/{name}/empty")  # a folder, also where a table is empty

    def run_once():
        def read(name, df):
            return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in/{name}")
        q = (label_stream(read("flows", flows), read("labels", labels), tolerance_ms, watermark, flow_ts=flow_ts)
             .writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        if log is not None:
            log.extend(progress(q))

    for k in range(phases):
        for name, df in (("flows", flows), ("labels", labels)):
            staged = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, slice int").parquet(
                f"{root}/staged/{name}")
            staged.where(F.col("slice") == k).drop("slice").write.parquet(f"{root}/in/{name}/{k:06d}")
        run_once()
    end = "end of input"
    for k in (1, 2):  # the second moves the operators behind the first one's watermark
        last = hi + k * (2 * tolerance_ms + 1000)
        spark.range(1).select(*[(F.lit(last) if f.name == flow_ts else F.lit(end) if f.name == "flow_key" else F.lit(None))
                                .cast(f.dataType).alias(f.name) for f in flows.schema]).write.parquet(f"{root}/in/flows/end-{k}")
        spark.range(1).select(F.lit(end).alias("flow_key"), F.lit(last).alias("ts_ms"), F.lit(None).cast(
            labels.schema["label"].dataType).alias("label")).write.parquet(f"{root}/in/labels/end-{k}")
        run_once()
    done = spark.read.schema(schema).parquet(f"{root}/out").where(F.col("flow_key") != end)
    return done.unionByName(untimed(flows, flow_ts))
