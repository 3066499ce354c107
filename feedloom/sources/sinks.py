"""Sinks: partitioned splits, histories, exports and versioned publication behind a pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import finite
from ..operators.split import content_digest


def write_split(split_rows: DataFrame, path: str) -> None:
    """One folder per split, its files in time order: ranges of (split, time) as sampled, each sorted by time, user and item.

    The number of ranges is that of the session's shuffle partitions; adaptive execution joins small ones.
    """
    split_rows.repartitionByRange("split", "ts_ms", "user_id", "item_id").sortWithinPartitions(
        "split", "ts_ms", "user_id", "item_id"
    ).write.mode("errorifexists").partitionBy("split").parquet(path)


def write_split_files(split_rows: DataFrame, path: str) -> None:
    """One folder of text files per split, with the header ``read_split`` asks for."""
    for name in ("train", "validation", "test"):
        rows = split_rows.filter(F.col("split") == name).select("user_id", "item_id", F.col("ts_ms").alias("timestamp_ms"))
        write_csv(rows.repartitionByRange("timestamp_ms", "user_id", "item_id").sortWithinPartitions("timestamp_ms", "user_id", "item_id"), f"{path}/{name}")


def write_items(items: DataFrame, path: str) -> None:
    items.sortWithinPartitions("item_id").write.mode("errorifexists").parquet(path)


def write_user_history(histories: DataFrame, path: str) -> None:
    """JSON lines, one per user."""
    histories.write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat export with a header; quotes inside text are doubled."""
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def check_table(df: DataFrame, key: list[str], vector: str | None = None, pair: tuple[str, str] | None = None) -> dict[str, int]:
    """Counts of what a published table must not contain: repeated keys, odd vector lengths,
    non-finite entries, items that neighbour themselves."""
    grouped = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    found = {"rows": df.count(), "repeated_keys": grouped.filter(F.col("c") > 1).count()}
    if vector:
        size = F.size(vector)
        row = df.agg(
            (F.max(size) - F.min(size)).alias("spread"),
            F.count_if(F.exists(vector, lambda x: ~finite(x.cast("double")))).alias("bad"),
        ).first()
        found |= {"uneven_vectors": int(row["spread"] or 0), "non_finite": int(row["bad"])}
    if pair:
        found["self_pairs"] = df.filter(F.col(pair[0]) == F.col(pair[1])).count()
    return found


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _write_small(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _fs(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers there are, smallest first."""
    fs, folder = _fs(spark, f"{root}/pointers")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """The published version, or None before the first publication."""
    numbers = _pointers(spark, root)
    if not numbers:
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/pointers/{numbers[-1]:08d}.json").collect()))


def _point(spark: SparkSession, root: str, pointer: dict) -> None:
    """Add the next pointer by a rename, which is refused if another publication was faster. None is ever overwritten."""
    number = (_pointers(spark, root) or [0])[-1] + 1
    staged, target = f"{root}/.pointer-{uuid.uuid4().hex}", f"{root}/pointers/{number:08d}.json"
    fs, folder = _fs(spark, f"{root}/pointers")
    fs.mkdirs(folder)
    _write_small(spark, staged, json.dumps(pointer, sort_keys=True))
    final = _fs(spark, target)[1]
    if fs.exists(final) or not fs.rename(_fs(spark, staged)[1], final):
        raise FileExistsError(f"another publication took pointer {number} of {root}")


def publish_table(
    df: DataFrame, root: str, version: str, key: list[str], vector: str | None = None, pair: tuple[str, str] | None = None
) -> dict:
    """Write, validate, rename, then add a pointer.

    The table is staged first and validated as written. An existing version is refused. The pointer is one small
    file with the version, the counts and the content digest of the table; it is written last and earlier pointers
    stay, so a failure leaves the previous version in place.
    """
    spark = df.sparkSession
    fs, final = _fs(spark, f"{root}/{version}")
    if fs.exists(final):
        raise FileExistsError(f"version {version} is already published")
    stage_name = f"{root}/.stage-{version}"
    df.write.mode("overwrite").parquet(stage_name)
    staged = spark.read.schema(df.schema).parquet(stage_name)
    report = check_table(staged, key, vector, pair)
    problems = {name: n for name, n in report.items() if name != "rows" and n}
    if problems or report["rows"] == 0:
        raise ValueError(f"table is not publishable: {problems or 'it is empty'}")
    digest = content_digest(staged, sorted(staged.columns)).first()["digest"]
    if not fs.rename(_fs(spark, stage_name)[1], final):
        raise OSError(f"could not move version {version} into place")
    pointer = {"version": version, "path": f"{root}/{version}", "digest": digest, "schema": staged.schema.json(), **report}
    _point(spark, root, pointer)
    return pointer


def read_published(spark: SparkSession, root: str, verify: bool = True) -> DataFrame:
    """The published table. ``verify`` reads it once more to compare its content digest with the pointer's."""
    pointer = read_pointer(spark, root)
    if pointer is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    table = spark.read.schema(StructType.fromJson(json.loads(pointer["schema"]))).parquet(pointer["path"])
    if verify and content_digest(table, sorted(table.columns)).first()["digest"] != pointer["digest"]:
        raise ValueError(f"checksum of version {pointer['version']} does not match")
    return table
