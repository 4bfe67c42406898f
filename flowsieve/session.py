"""Session helpers: one place for the settings every job relies on."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the library needs for correct results (UTC wall clock for epoch
# conversions) and for scale (AQE re-plans joins and coalesces partitions at
# runtime; skew join splits hot keys of sort-merge joins).
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "flowsieve", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_defaults(spark: SparkSession) -> None:
    """Pin the runtime settings results depend on (time zone) on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there). Only when it is unset - local tests - a fresh local folder is
    created and registered, so later calls reuse it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the conf is all we have
        sc = None
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="flowsieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as parquet in the shared folder and reading it back.

    Unlike ``checkpoint()`` the result carries no partitioning claims from the
    plan it came from, and any executor can re-read it after a loss.
    """
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowsieve`` importable in Python workers (once per SparkContext).

    Operators that run Python inside tasks (mapInPandas, applyInPandasWithState)
    pickle references to this package. The package is zipped on the driver and
    distributed with ``addPyFile``, so workers need no pre-installed copy.
    """
    import os
    import zipfile

    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # Spark Connect
        sc, key = None, id(spark)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="flowsieve-pkg-"), "flowsieve.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("flowsieve", os.path.relpath(full, pkg)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)
