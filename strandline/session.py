"""Session helpers: shared scratch tables and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20
#: Rows of a file at least, where a table's rows are known, and files that are written anyway.
FILE_ROWS, FILES = 1 << 18, 8


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs on this machine
    (tests, a laptop) a temporary folder is made and set as the checkpoint
    folder of this context; a cluster without the setting is an error, since
    its machines share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandline-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialise(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table survives the loss of any executor, and later jobs restart
    from it instead of from the whole lineage. ``rows`` is a bound on its rows
    where one is known: a table that is small by it is written by few tasks,
    since thousands of tiny files cost more than they hold.
    """
    spark = df.sparkSession
    if rows is not None:
        files = max(FILES, -(-rows // FILE_ROWS))
        if files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
    path = f"{scratch_dir(spark).rstrip('/')}/strandline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._strandline_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_strandline_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if it has fewer: a small input of few splits is then read by one task and worked on by all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to as many parts as are configured, which are not put together to a few large ones: what sorts and windows of a task hold is its share of the table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_keys(df: DataFrame) -> DataFrame:
    """``df``, which joins deal by key and sort, whatever the size of its files: for tables with a row for each node, step or edge.

    Spark takes the bytes of Parquet files for a table's size. Ordered numbers
    take few bits in a file and 8 bytes and more in memory, so that millions of
    rows would go through the driver to all tasks. An explicit broadcast of the
    other side still holds.
    """
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context, and bound Arrow batches by bytes.

    Texts differ in length by orders of magnitude, so batches are bounded by
    bytes as well as by rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="strandline-"), "strandline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("strandline", os.path.relpath(full, top)))
        sc.addPyFile(path)
    sc._strandline_shipped = True
