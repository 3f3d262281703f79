"""Small files in any file system that Arrow knows: pointers, marks and metadata of what Spark wrote beside them."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def write_text(path: str, text: str) -> None:
    """Written beside its place and moved there."""
    disk, p = opened(path)
    disk.create_dir(os.path.dirname(p), recursive=True)
    part = f"{p}.{uuid.uuid4().hex}.part"
    with disk.open_output_stream(part) as f:
        f.write(text.encode())
    disk.move(part, p)


def read_text(path: str) -> str | None:
    """None if there is no such file."""
    disk, p = opened(path)
    if disk.get_file_info(p).type != fs.FileType.File:
        return None
    with disk.open_input_stream(p) as f:
        return f.read().decode()


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, sort_keys=True))


def read_json(path: str):
    text = read_text(path)
    return None if text is None else json.loads(text)


def folders(path: str) -> list[str]:
    disk, p = opened(path)
    if disk.get_file_info(p).type != fs.FileType.Directory:
        return []
    return sorted(x.base_name for x in disk.get_file_info(fs.FileSelector(p)) if x.type == fs.FileType.Directory)


def remove(path: str) -> None:
    disk, p = opened(path)
    if disk.get_file_info(p).type == fs.FileType.Directory:
        disk.delete_dir(p)


def total_bytes(path: str) -> int:
    disk, p = opened(path)
    if disk.get_file_info(p).type != fs.FileType.Directory:
        return 0
    return sum(x.size or 0 for x in disk.get_file_info(fs.FileSelector(p, recursive=True)) if x.type == fs.FileType.File)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="lexquarry-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
