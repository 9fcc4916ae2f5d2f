"""Tables between steps: written once in a shared folder, read back with the columns and rows that are asked for; small maps as JSON."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.entities import checked, write_id_lists

_written: dict[tuple[str, str], str] = {}


def work_dir(spark: SparkSession) -> str:
    """``kinweave.work.dir`` if set, else a folder in ``spark.checkpoint.dir``, else in the warehouse: all are shared on a cluster."""
    own = spark.conf.get("kinweave.work.dir", None)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return own or f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/kinweave-tables"


def once(spark: SparkSession, name: str, inputs: str, build: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The table ``name`` made of ``inputs`` (a folder), built and written by the application's first call, partitioned by ``by``."""
    key = (spark.sparkContext.applicationId, f"{name}|{inputs}")
    if key not in _written:
        path = f"{work_dir(spark)}/{key[0]}/{name}-{hashlib.sha256(inputs.encode()).hexdigest()[:12]}"
        write_table(build(), path, by)
        _written[key] = path
    return spark.read.parquet(_written[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under a name of its own, read again."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    write_table(df, path, ())
    return spark.read.schema(df.schema).parquet(path)


#: Spark's option that removes a query's shuffle files as it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("country", "tgt_src")) -> None:
    """A Parquet table with a folder for each value of ``by``. What was shuffled for it is removed: what comes after reads the table."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and rows of a table (or of all that a glob names); both reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def save_map(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, sort_keys=True)


def load_map(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def safe(country: str) -> str:
    """A country's name as part of a path: other characters than letters, digits and _ become _, several of them one."""
    return re.sub(r"\W+", "_", country)


def known_truth(truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs both of whose records are known, with country and tgt_src."""
    t = truth.join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return t.join(targets.select(F.col("entity_id").alias("tgt_id"), F.col("k").alias("tgt_src")), "tgt_id").select("s1_id", "tgt_id", "country", "tgt_src")


def names_of(records: DataFrame, ids: DataFrame) -> DataFrame:
    """entity_id, name of the records whose ids are in ``ids`` (one column)."""
    return records.select("entity_id", "name").join(ids.toDF("entity_id").distinct(), "entity_id", "left_semi")


def write_outputs(s1: DataFrame, matches: DataFrame, candidates: DataFrame, path: str) -> None:
    """Two lists, of candidates and of matches, a row for each record of ``s1``; every match must be a candidate."""
    write_id_lists(s1, checked(matches, candidates), f"{path}/matches")
    write_id_lists(s1, candidates, f"{path}/candidates")


def validate(lists: DataFrame, s1: DataFrame, targets: DataFrame) -> list[str]:
    """What is wrong with lists (s1_id, ids): records that lack or repeat, ids that are unknown or repeat. Counts only, so bounded."""
    said = []
    n = lists.groupBy("s1_id").agg(F.count("*").alias("n"))
    checks = {
        "records without a row": s1.select("s1_id").distinct().join(n, "s1_id", "left_anti"),
        "rows of unknown records": n.join(s1.select("s1_id"), "s1_id", "left_anti"),
        "records with several rows": n.where("n > 1"),
    }
    ids = lists.where("ids <> ''").select("s1_id", F.explode(F.split("ids", ",")).alias("tgt_id"))
    checks["unknown targets"] = ids.join(targets.select("tgt_id"), "tgt_id", "left_anti")
    checks["repeated targets"] = ids.groupBy("s1_id", "tgt_id").agg(F.count("*").alias("n")).where("n > 1")
    for what, rows in checks.items():
        if (k := rows.count()) > 0:
            said.append(f"{what}: {k}")
    return said
