"""What the operators of this package share: the shared folder, written tables, small column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.memory import give_back as give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset there is none: on a cluster no other folder is shared."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kinweave-work"  # one machine: tests and benches
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def bounded(df: DataFrame, limit_bytes: int, row_bytes: int) -> bool:
    """Whether ``df`` has at most ``limit_bytes``, at ``row_bytes`` a row; reads at most that many rows."""
    most = limit_bytes // row_bytes
    return df.limit(most + 1).count() <= most


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def portions(b: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about ``size`` bytes of ``column`` (a string column), of one row at least: what a task unpacks at once is bounded."""
    lengths = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        held += n + 64
        if held >= size:
            yield b.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < b.num_rows:
        yield b.slice(start)
