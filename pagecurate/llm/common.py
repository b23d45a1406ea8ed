"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecurate.session import scratch_dir

#: A word is a run of characters outside space and U+0009..U+000D. As a Java
#: pattern for the JVM side; ``bytes.split()`` cuts the same words in Python,
#: since it splits on exactly these six ASCII characters.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans_array(found: Iterable[list[tuple[str, int, int]]]) -> pa.Array:
    """Arrow array of SPANS from (kind, start, end) lists."""
    return pa.array(([{"kind": k, "start": s, "end": e} for k, s, e in row] for row in found), type=_ARROW_SPANS)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts at a time are Python objects.
    When they are done the worker, which lives on, gives back what it has freed."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def values(array: pa.Array, rows: int = 1_000) -> Iterator:
    """The values of an array, converted a few at a time."""
    for i in range(0, len(array), rows):
        yield from array.slice(i, rows).to_pylist()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, by way of the
    shared folder: functions that run in Python workers import it there."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":  # not set: the default suits narrow rows, not texts
        spark.conf.set(ARROW_ROWS, "2000")
    sc = spark.sparkContext
    if getattr(sc, "_pagecurate_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    archive = f"{scratch_dir(spark, 'package')}/pagecurate.zip"
    store, path = fs.FileSystem.from_uri(archive)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(packed.getvalue())
    sc.addPyFile(archive)
    sc._pagecurate_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors, and later readers prune its columns."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text; NULL counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Words of a text as an array; NULL gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: Column, base_kinds: list[str]) -> list[Column]:
    """``base_sha256`` and ``spans`` columns of a span-finding query."""
    base = F.filter(spans, lambda s: s["kind"].isin(base_kinds))
    return [F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans")]


def n_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def with_ordinal(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order without gathering them:
    range partitions are sorted and written once, and each adds the rows of
    the partitions before it (one count per partition)."""
    spark = df.sparkSession
    slot = "_slot"
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn(slot, F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright(F.col(slot), 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["_part"], before))
        before += r["n"]
    table = spark.createDataFrame(offsets, "_part long, _before long")
    return (rows.join(F.broadcast(table), part == F.col("_part"))
            .withColumn(out, F.col("_before") + F.col(slot).bitwiseAND(F.lit((1 << 33) - 1)))
            .drop(slot, "_part", "_before"))


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast hint for a table that has been counted and found to have at
    most ``most_rows`` rows; a larger one stays with the shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
