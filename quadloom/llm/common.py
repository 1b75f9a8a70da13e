"""What the operators share: tables, written intermediate results, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.session import ship

#: Rows of a batch that crosses to Python: long texts must not make it large.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the batches that Python sees small (a smaller setting of the session stays), and see that workers have this code."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests on one machine), a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_folder, "own", None)
    if own is None:
        own = shared_folder.own = tempfile.mkdtemp(prefix="quadloom-")
    return own


_written: list[tuple[weakref.ref, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted with the tables of ``written``."""
    path = f"{shared_folder(spark)}/quadloom-{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def clear_written() -> None:
    """Delete all tables of ``written``; results that still read them become unusable."""
    while _written:
        ref, path = _written.pop()
        spark = ref()
        if spark is not None and spark.sparkContext._jsc is not None:
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001 - the session is going down
                return


atexit.register(clear_written)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: other columns, whatever their names, stay out of the way."""
    return df.select([F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def sparse(df: DataFrame, key: Column, most: int, n: int) -> DataFrame:
    """Rows whose key hashes low, about four times ``most`` of ``n``: what tasks send for a bounded sample stays bounded, however many tasks there are."""
    share = min(1.0, 4 * most / max(1, n))
    return df if share == 1.0 else df.where(F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 1) < F.lit(int(share * ((1 << 63) - 1))))


def whole_texts(sample: DataFrame, most_bytes: int) -> list[tuple]:
    """(id, text) of a bounded sample with distinct ids ``id`` and ``k``, in the order of k: whole texts of ``most_bytes`` in all; one that would pass the bound stays out."""
    sample = written(sample.select("k", "id", F.coalesce("text", F.lit("")).alias("text")), "sample")
    taken, total = [], 0
    for r in sorted(sample.select("k", "id", F.octet_length("text").alias("n")).collect()):
        if total + r["n"] <= most_bytes:
            taken.append(r["k"])
            total += r["n"]
    rows = sample.where(F.col("k").isin(taken)).collect() if taken else []
    return [(r["id"], r["text"]) for r in sorted(rows)]


def null_safe_id(column: str) -> Column:
    """An id for joins in which null equals null."""
    return F.coalesce(F.col(column), F.lit(-(1 << 63)))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def hex_of(digest_column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(digest_column)), 16, "0"))
