"""Table access shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``; columns are pruned by whoever selects."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as there are cores, for stages that compute much a row.

    Only a scan of fewer partitions (one small file) is repartitioned; a large one stays as read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def once(df: DataFrame, key: str) -> DataFrame:
    """One row a key, in partitions that aren't merged again before the stage that follows."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key).dropDuplicates([key])


#: Intermediate tables and checkpoints this process has made and not yet removed.
_made: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, from the session's ``spark.checkpoint.dir``.

    Only a session in local mode that sets none (tests, a laptop) gets a folder of its own; on a
    cluster, where executors would write to their own disks, that is an error.
    """
    sc = spark.sparkContext
    context = sc._jsc.sc()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    path = "file://" + tempfile.mkdtemp(prefix="webloom-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _keep(df.sparkSession, file.get())
    return kept


def cut_table(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table: for many narrow rows it takes a fraction of a checkpoint's space.

    What computes ``df`` runs once for each row that is kept, so calls to other services go here.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _keep(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df``, written first, for broadcasting where it has at most ``most_rows`` rows; a larger one is joined by shuffle."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def _keep(spark: SparkSession, path: str) -> None:
    import atexit

    if not _made:
        atexit.register(release, spark)
    _made.append(path)


def release(spark: SparkSession) -> None:
    """Removes the intermediate tables and checkpoints made so far; call it once the results that rest on them have been read.

    It is called when the Python process ends.  Later cuts make folders of their own again.
    """
    while _made:
        path = _made.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended before
            pass
