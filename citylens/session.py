"""Session helpers.

The master, executor sizes and the shared checkpoint folder come from the
launcher (``spark-submit`` / cluster config).  These helpers only fill in
what is unset, so the same code runs on ``local[*]`` in tests and on a
cluster unchanged.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the library relies on.  Session zone UTC keeps
# hour/day extraction of LTZ timestamps reproducible; AQE re-plans joins
# and shuffle sizes from runtime statistics (broadcast only when the
# measured side is small, skew splitting for hot keys).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "citylens", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch the session.  ``master`` is normally left to the launcher."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    except Exception:  # a Spark Connect session: the server's master is not known here
        return False


#: Private folders made for local sessions without a setting, by application; scratch locations handed out.
_LOCAL_FOLDERS: dict[str, str] = {}
_SCRATCH: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names shared storage and is only read; without
    it there is an error, since a machine-local folder would not be seen by
    the other machines.  A local session without the setting gets one fresh
    private folder, so ``checkpoint()`` and scratch tables have a home.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. a Spark Connect session: no context, read the setting only
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not configured and sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="citylens-ckpt-")
    sc.setCheckpointDir(configured or _LOCAL_FOLDERS[sc.applicationId])
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/citylens/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete what was written to the scratch locations handed out in this process; returns how many there were.

    Call it when no DataFrame that reads them is needed any more.
    """
    jvm, dropped = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


__all__ = ["DEFAULT_CONF", "get_session", "ensure_checkpoint_dir", "scratch_path", "drop_scratch"]

