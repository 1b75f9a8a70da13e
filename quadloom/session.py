"""Sessions, and intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and small data; on a cluster pass your own session to the engine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application: their Python workers need it, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="quadloom-code-"), "quadloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, and only on one machine, a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quadloom-"))
    return _own[0]


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quadloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of files for a task of joins over large tables; more, up to the second, rather than over 200 tasks, as Spark deals rows out to so many without gathering them.
TASK_BYTES, MOST_TASK_BYTES, DEALT_AT_ONCE = 2_000_000, 16_000_000, 200


def tasks_for(*frames: DataFrame) -> int:
    """Tasks that give each ``TASK_BYTES`` or more of the files under the largest of the plans; rows that are in no file are not counted."""
    most = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
        most = max(most, sum(x for x in sizes if x < 2**62))  # what Spark does not know, it states as the largest number
    return max(min(math.ceil(most / TASK_BYTES), DEALT_AT_ONCE), math.ceil(most / MOST_TASK_BYTES))


def unique(df: DataFrame) -> DataFrame:
    """The different rows of ``df``, of which most are thought to be different: dealt out first, by small tasks.

    ``distinct`` gathers what a task has read, in memory, before it deals rows out, which only helps where many are equal.
    """
    n = tasks_for(df)
    return (df.repartition(n, *df.columns) if n > 2 else df).distinct()


class Growing:
    """A table in the shared folder that only grows: what is added is written, what was there is not written again.

    ``base``: a table of ``written`` that it begins with and does not copy.
    """

    def __init__(self, spark: SparkSession, name: str, base: DataFrame | None = None) -> None:
        self.spark, self.base = spark, base
        self.root = f"{shared_folder(spark)}/quadloom-{name}-{uuid.uuid4().hex}"
        self.parts: list[str] = []
        self.schema = None
        _written.append((spark, self.root))

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, read from where they are now."""
        path = f"{self.root}/part-{len(self.parts)}"
        df.write.parquet(path)
        self.parts.append(path)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def take(self, other: Growing) -> DataFrame | None:
        """Add what was added to another one, which stays as it is; None if that is nothing."""
        if not other.parts:
            return None
        self.parts += other.parts
        self.schema = self.schema or other.schema
        return self.spark.read.schema(self.schema).parquet(*other.parts)

    @property
    def all(self) -> DataFrame:
        if not self.parts:
            return self.base
        own = self.spark.read.schema(self.schema).parquet(*self.parts)
        return own if self.base is None else self.base.unionByName(own)


def free(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    for k, (_, path) in enumerate(_written):
        if files and all(path.rsplit("/", 1)[1] in f for f in files):
            delete(spark, path)
            del _written[k]
            return


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder together with the tables of ``written``."""
    _written.append((spark, path))


def clear_written() -> None:
    """Delete the tables of ``written``; results that read them become unusable."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001 - the session is going down
                return


atexit.register(clear_written)
