"""Session defaults, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side we broadcast after counting it (rows).  Beyond it the join
# stays a shuffle join and AQE may still convert it from runtime statistics.
BROADCAST_ROW_LIMIT = 2_000_000
_WRITTEN: list[str] = []


def get_session(master: str | None = None, app: str = "colloquy",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators are written for.

    On a cluster ``master`` stays ``None`` and the cluster's own settings win;
    locally (tests, bench) we pin a small shuffle-partition count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("COLLOQUY_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``colloquy`` importable in Python workers (like ``--py-files``).

    Pandas UDFs and generator factories are pickled by reference to this
    package, so executors need it on their path.  Zipped once per driver.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="colloquy-pyfiles-"), "colloquy.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))


# Arrow batches to Python workers: rows and bytes at most, in place of Spark's
# larger defaults (a row here may hold a whole document or token list).
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"),
                "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def prepare(spark: SparkSession) -> str:
    """Per-session setup used by every entry point: code shipping, Arrow batch sizes, checkpoint folder.

    Sizes that the session has set itself are kept.
    """
    ship_package(spark)
    for key, (default, own) in ARROW_LIMITS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, own)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder there: without it every executor would
    write to its own disk and reads would miss the others' files, so a
    non-local master without the setting is an error.  Local runs and tests
    get a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = local_scratch(sc.master)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def local_scratch(master: str) -> str:
    """A temporary folder for a local master; any other master must set ``spark.checkpoint.dir``."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"master {master}: set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="colloquy-ckpt-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the file system of ``path`` has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written_tables() -> list[str]:
    """Paths of the intermediate tables written so far and not yet released."""
    return list(_WRITTEN)


def release(spark: SparkSession, keep: list[str] | None = None) -> int:
    """Delete the written intermediate tables but those in ``keep``; returns how many went.

    For the end of a use: DataFrames that still read them can no longer run.
    """
    gone = [p for p in _WRITTEN if p not in set(keep or [])]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _WRITTEN.remove(path)
    return len(gone)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block are deleted at its end (results must be written or collected there)."""
    before = written_tables()
    try:
        yield
    finally:
        release(spark, keep=before)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only after checking that it has at most ``limit`` rows.

    Used for sides that are small by construction but whose size is not known
    statically (vocabularies, per-batch tables).  The count is a real check;
    larger sides are returned untouched so the join shuffles.
    """
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and read it back.

    Used for intermediates read by several branches (tokenized corpora, sorted
    rows) so costly or nondeterministic expressions run exactly once; it also
    cuts lineage, so a lost executor re-reads files instead of recomputing.
    One job (the write); the read-back gets column pruning like any table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when the input has fewer partitions than cores.

    Row-local work here (regex tokenizing, rendering) is CPU-bound; a small
    table stored as one file would otherwise run in one task.  A large input
    already has enough splits and is left alone (no extra shuffle).  No key is
    used, so a hot conversation is not pinned to one task.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df

