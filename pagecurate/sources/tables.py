"""Table sources and sinks.

Parquet is the default sink; CSV is offered for exchange with the annotation
tools (header, no index column). Writes are whole-job writes — no rewrite of a
growing table per record.
"""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagecurate.plans.splits import split_contiguous

# ship this module's code with the writing tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_annotations(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A5: CSV with a header row; quoted fields may span lines, so one task reads
    a whole file."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, link_blank: bool = False) -> None:
    """Write a table. ``link_blank`` appends the blank the annotation CSVs
    carry after ``page_link`` (only for exchange with those files)."""
    out = df
    if link_blank and "page_link" in df.columns:
        out = out.withColumn("page_link", F.concat(F.col("page_link"), F.lit(" ")))
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_parts(df: DataFrame, path: str, n: int, order: list, fmt: str = "parquet") -> None:
    """N contiguous parts (F3), one folder ``part=i`` each."""
    write_table(split_contiguous(df, n, order, "part"), path, fmt, partition_by=["part"])


def read_parts(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | None = None) -> DataFrame:
    """The parts of a folder as one table (``part`` column kept for order, G5)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return r.load(path)


def read_part_files(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Separate part files in one read, with the path each row comes from
    (``part_file``) and in the order of these paths. Parts of one schema."""
    from_part = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)
    parts = spark.read.format(fmt).load(sorted(paths))
    return parts.withColumn("part_file", from_part).orderBy("part_file")


#: Files whose texts a task of ``write_files`` holds at a time.
WRITE_ROWS = 200
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_files(df: DataFrame, root: str, name_col: str, value_col: str) -> int:
    """One text file per row: ``root``/``name_col`` holds ``value_col`` (UTF-8).

    Names may have folders and must be distinct; a row without a name is an error,
    one without a value makes an empty file. Every task writes its own rows under
    temporary names and moves them in place, so a task that runs again (lost
    executor, speculation) leaves the same files. Returns their number."""
    def write(batches):
        where = root.removeprefix("file:") if root.startswith("file:/") else root
        store, base = fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), where)
        made = set()
        for b in batches:
            for name, value in zip(b["name"].to_pylist(), b["value"].to_pylist()):
                if not name:
                    raise ValueError("a file has no name")
                path = f"{base}/{name}"
                folder = path.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write((value or "").encode("utf-8"))
                store.move(part, path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    rows = df.select(F.col(name_col).alias("name"), F.col(value_col).alias("value"))
    spark = df.sparkSession
    rows_set = spark.conf.get(ARROW_ROWS, None)
    # the usual 10,000 rows to a batch suit narrow rows, not whole files
    spark.conf.set(ARROW_ROWS, str(WRITE_ROWS))
    try:
        return rows.mapInArrow(write, "n BIGINT").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        if rows_set is None:
            spark.conf.unset(ARROW_ROWS)
        else:
            spark.conf.set(ARROW_ROWS, rows_set)


def materialise_subset(records: DataFrame, path: str) -> int:
    """The files of the sampled records (folder, file, value), below ``path``
    in their year folders and under their own names. Returns their number."""
    name = F.concat_ws("/", "folder", F.element_at(F.split("file", "/"), -1))
    return write_files(records.select(name.alias("name"), "value"), path, "name", "value")
