"""Session helpers: checkpoints in the folder all executors share, and broadcasts behind a size check."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of them as estimated from their types, of a side that may be broadcast after they were counted; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def local_session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only in local mode, where it is unset, a folder is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that later jobs neither recompute it nor need its executors.

    A checkpoint keeps the optimizer's guess of its size, which every join multiplies; over rounds of joins the guess gets
    so many digits that planning never ends. A guess beyond 63 bits, which tells nothing any more, is left out.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    written = df.checkpoint(eager=True)
    plan = written._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()).bit_length() <= 63:
        return written
    plain = spark._jsparkSession.internalCreateDataFrame(plan.analyzed().collectLeaves().head().rdd(), written._jdf.schema(), False)
    return DataFrame(plain, spark)


def _cut_in_place(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written like ``cut``, partitioned and sorted by ``keys``, which later joins and groups on them make use of.

    The partitioning of a checkpoint is only kept if its plan isn't changed while it runs, so that is switched off for
    this one job.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return _cut_in_place(df.repartition(*keys).sortWithinPartitions(*keys))
    finally:
        conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from ``cut``, or of columns of one, that nothing needs any more."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    if leaves.size() != 1 or leaves.head().getClass().getSimpleName() != "LogicalRDD":
        return
    file = leaves.head().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_bytes(df: DataFrame, text: int = 40, items: int = 30) -> int:
    """Bytes of a row as its types let one expect: texts of ``text`` bytes, arrays of ``items`` elements."""

    def of(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return 16 + sum(of(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return 24 + items * of(kind.elementType)
        if isinstance(kind, T.MapType):
            return 24 + items * (of(kind.keyType) + of(kind.valueType))
        return text if isinstance(kind, (T.StringType, T.BinaryType)) else 16

    return of(df.schema)


def fits_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> bool:
    return rows <= limit and rows * row_bytes(df) <= BROADCAST_BYTES


def small_or_not(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its rows (``rows``, if they were counted before) and their estimated bytes are few, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df, df.count() if rows is None else rows, limit) else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_emberline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="emberline-package-"), "emberline_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)  # the driver serves it to the executors
    context._emberline_shipped = True
