"""Files listed and read in tasks.

Spark's file sources list every file on the driver: its index, and what the
listing tasks send for it, grow with the number of files. Here a folder is listed
by a task, level by level, the names are written to the shared folder, and tasks
read the files of their names; the driver sees the paths it was given. Stores that
Arrow does not know, and patterns beyond ``*`` and ``?``, are left to Spark's sources.

As there, names that begin with ``.`` or ``_`` (without ``=``) are hidden, and empty
files are passed over.
"""

from __future__ import annotations

import fnmatch
import re
import sys

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecurate.session import scratch_dir, shuffle_partitions

# ship this module's code with the tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of file contents that a reading task holds at a time (a larger file is held alone).
HELD_BYTES = 4 << 20
HELD_FILES = 1_000
_ENTRY = "store STRING, path STRING, is_dir BOOLEAN"
# what java.net.URI leaves as it is in a path
_QUOTED = re.compile(r"[^A-Za-z0-9_.!~'()*,;:$&+=/@\-\x80-\U0010ffff]")


def open_store(store: str) -> tuple[fs.FileSystem, str]:
    """(file system, what its paths begin with) of a URI's scheme and authority."""
    if store == "file:":
        return fs.LocalFileSystem(), ""
    system, base = fs.FileSystem.from_uri(store + "/")
    return system, base.rstrip("/")


def file_uri(store: str, path: str) -> str:
    """The path as ``_metadata.file_path`` has it."""
    return store + _QUOTED.sub(lambda m: f"%{ord(m[0]):02X}", path)


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _known(store: str) -> bool:
    try:
        open_store(store)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def _roots(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, bool]]:
    """(store, path, is a folder) of the paths."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        status = hp.getFileSystem(conf).getFileStatus(hp)
        if status.isFile() and not status.getLen():
            continue
        uri = status.getPath().toUri()
        authority = uri.getAuthority()
        out.append((f"{uri.getScheme()}:" + (f"//{authority}" if authority else ""), uri.getPath(), status.isDirectory()))
    return out


def listing(spark: SparkSession, paths: list[str], pattern: str, recursive: bool = True) -> DataFrame | None:
    """(store, path) of the files below the folders, and of the files among the
    paths, whose names match; dealt out evenly. None: for Spark's sources."""
    roots = _roots(spark, paths)
    if set(pattern) & set("{}[]^\\") or not all(map(_known, {s for s, _, _ in roots})):
        return None
    matches = re.compile(fnmatch.translate(pattern)).match

    def wanted(name: str) -> bool:
        return not _hidden(name) and matches(name) is not None

    def children(batches):
        for b in batches:
            for store, path in zip(b["store"].to_pylist(), b["path"].to_pylist()):
                system, base = open_store(store)
                found = [(i.base_name, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(base + path)) if i.size != 0]
                found = [(f"{path.rstrip('/')}/{n}", d) for n, d in found if (recursive and not _hidden(n) if d else wanted(n))]
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([store] * len(part)), pa.array([p for p, _ in part]), pa.array([d for _, d in part])],
                                                     names=["store", "path", "is_dir"])

    n = shuffle_partitions(spark)
    level = spark.createDataFrame([r for r in roots if r[2] or wanted(r[1].rpartition("/")[2])], _ENTRY)
    files, folders = level.filter("NOT is_dir"), level.filter("is_dir")
    while not folders.isEmpty():
        path = scratch_dir(spark, "level")
        folders.repartition(n, "store", "path").mapInArrow(children, _ENTRY).write.parquet(path)
        level = spark.read.schema(_ENTRY).parquet(path)
        files, folders = files.unionByName(level.filter("NOT is_dir")), level.filter("is_dir")
    path = scratch_dir(spark, "listing")
    files.select("store", "path").repartition(n, "path").write.parquet(path)
    return spark.read.schema("store STRING, path STRING").parquet(path)


def read_whole(files: DataFrame) -> DataFrame:
    """(file, value) of the files (store, path) that are not empty: URI and text."""

    def read(batches):
        stores = {}
        for b in batches:
            names, values, held = [], [], 0
            for i in range(0, b.num_rows, HELD_FILES):
                part = b.slice(i, HELD_FILES)
                for store, path in zip(part["store"].to_pylist(), part["path"].to_pylist()):
                    if store not in stores:
                        stores[store] = open_store(store)
                    system, base = stores[store]
                    with system.open_input_stream(base + path) as f:
                        value = f.read()
                    if not value:
                        continue
                    names.append(file_uri(store, path))
                    values.append(value)
                    held += len(value)
                    if held >= HELD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.binary())], names=["file", "value"])
                        names, values, held = [], [], 0
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.binary())], names=["file", "value"])
                    names, values, held = [], [], 0

    return files.mapInArrow(read, "file STRING, value BINARY").select("file", F.col("value").cast("string").alias("value"))
