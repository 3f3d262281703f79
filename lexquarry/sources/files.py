"""File trees as tables of (path, content, length, modified), with the filters of a search tool, and what to do with bytes."""

from __future__ import annotations

import bz2
import gzip
import lzma
import subprocess
import zlib
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import content as C
from lexquarry.functions import paths as P
from lexquarry.sources import store


def walk(
    spark: SparkSession, root: str, globs: list[str] = (), types: list[str] = (), without_types: list[str] = (), hidden: bool = False, max_depth: int | None = None,
    max_size: int | None = None, ignore_case: bool = False, ignore: list[str] = (), explicit: list[str] = (),
) -> DataFrame:
    """(path, content, length, modified, explicit) of the files below root; paths are relative to it. Content is read only if it
    is used, and only of files that the filters leave. ignore: globs in the manner of an ignore file, comments and blank lines
    among them; explicit: paths named by the user, which no filter but the root leaves out."""
    files = _with_hidden(spark, root) if hidden else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    files = files.select(F.regexp_replace("path", F.lit("^[a-z]+:(?://)?" + "".join("\\" + c if not (c.isalnum() or c == "/") else c for c in base) + "/"), F.lit("")).alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
    p = F.col("path")
    keep = F.lit(True)
    if not hidden:
        keep = keep & ~P.hidden(p)
    if globs:
        keep = keep & P.glob_filter(p, list(globs), ignore_case)
    if types or without_types:
        keep = keep & P.type_filter(p, list(types), list(without_types))
    rules = [g.strip() for g in ignore if g.strip() and not g.strip().startswith("#")]
    if rules:
        ignored = F.lit(False)
        for g in rules:
            ignored = F.when(F.rlike(p, F.lit(P.glob_regex(g.lstrip("!"), ignore_case))), F.lit(not g.startswith("!"))).otherwise(ignored)
        keep = keep & ~ignored
    if max_depth is not None:
        keep = keep & (P.depth(p) <= max_depth)
    if max_size is not None:
        keep = keep & (F.col("length") <= max_size)
    named = p.isin(list(explicit)) if explicit else F.lit(False)
    return files.withColumn("explicit", named).where(named | keep)


def _with_hidden(spark: SparkSession, root: str) -> DataFrame:
    """Spark's own listing leaves out names that begin with a dot: here Arrow lists, and tasks read."""
    disk, base = store.opened(root)
    found = [(x.path, x.mtime, x.size) for x in disk.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File]

    def read(batches):
        here, _ = store.opened(root)
        for b in batches:
            for i in range(b.num_rows):  # a file at a time in memory
                with here.open_input_stream(b["path"][i].as_py()) as f:
                    data = f.read()
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row["path"], row["modificationTime"], row["length"], pa.array([data], pa.binary())], ["path", "modificationTime", "length", "content"])

    listed = spark.createDataFrame(found, "path string, modificationTime timestamp, length long")
    out = listed.mapInArrow(read, "path string, modificationTime timestamp, length long, content binary")
    return out.withColumn("path", F.concat(F.lit("file:" if base.startswith("/") else "x:"), "path"))


def paths(files: DataFrame) -> DataFrame:
    """Paths only; no content is read."""
    return files.select("path")


def type_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, list(g)) for t, g in sorted(P.TYPES.items())], "type string, globs array<string>")


def as_text(files: DataFrame, encoding: str | None = None, explicit_binary: bool = True) -> DataFrame:
    """(path, text, is_binary): decoded by encoding or byte-order mark; text before the first NUL, as that is all that is searched."""
    content = F.col("content")
    marked = C.decoding_bom_column(content)
    nul = (C.nul_position(content) > 0) & ~marked
    cut = F.when(marked, content).otherwise(C.searchable_prefix_column(content))
    return files.select("path", C.decoded_column(cut, encoding).alias("text"), nul.alias("is_binary"))


_OPENERS: dict[str, Callable[[bytes], bytes]] = {
    "gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress, "lzma": lzma.decompress, "zst": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b), "zz": zlib.decompress,
}


def decompressed(files: DataFrame) -> DataFrame:
    """Content of compressed files, told by their extensions, as it is inside; what can't be opened stays as it is."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                opener = _OPENERS.get((path or "").rsplit(".", 1)[-1].lower())
                if opener and data is not None:
                    try:
                        data = opener(data)
                    except (OSError, EOFError, ValueError, lzma.LZMAError, zlib.error, zstandard.ZstdError):
                        pass  # searched as it is
                out.append(data)
            yield pa.RecordBatch.from_arrays([b[n] if n != "content" else pa.array(out, pa.binary()) for n in b.schema.names], b.schema.names)

    return files.mapInArrow(run, files.schema)


def preprocessed(files: DataFrame, command: list[str], glob: list[str] = ()) -> DataFrame:
    """Content as a command gives it on its output, fed the content on its input; of files that match the globs."""
    chosen = P.glob_filter(F.col("path"), list(glob)) if glob else F.lit(True)
    schema = files.schema

    def run(batches):
        for b in batches:
            out = []
            for go, data in zip(b["__pre"].to_pylist(), b["content"].to_pylist()):
                out.append(subprocess.run(command, input=data, capture_output=True, check=True).stdout if go and data is not None else data)
            yield pa.RecordBatch.from_arrays([b[n] if n != "content" else pa.array(out, pa.binary()) for n in schema.names], schema.names)

    return files.withColumn("__pre", chosen).mapInArrow(run, schema)


def histogram_files(files: DataFrame, most: int = 20_000_000, cap: int | None = None) -> DataFrame:
    """Files that byte statistics are made of: not empty, not larger than `most`, no NUL in the first 8,192 bytes; with a cap, in
    the order of their paths as long as the sum stays within it."""
    from lexquarry.operators.quotas import byte_prefix

    out = files.where((F.col("length") > 0) & (F.col("length") <= most)).where(C.nul_position(F.substring("content", 1, C.HEAD)) == 0)
    return byte_prefix(out, cap, "length", ["path"]) if cap is not None else out
