"""Corpus sample (I1): decades -> folders with replacement (G4) -> one unseen
file per draw (H3) -> pages (A2) -> pages per file (G3) -> segments (A3).

Folder and file names are sampled first; only the chosen records are read
(an explicit path list), so I/O is proportional to the sample. The listings
are made by tasks, a folder each (``sources.files``); the only
thing brought to the driver is the chosen path list, which is bounded by
``files_per_decade`` x decades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecurate.functions.meta import decade
from pagecurate.operators.filters import year_window
from pagecurate.operators.sampling import draw_unseen, sample_per_group, sample_with_replacement
from pagecurate.sources.files import listing
from pagecurate.sources.tables import materialise_subset
from pagecurate.sources.tei import explode_pages, read_records, segments_table


def list_folders(spark: SparkSession, base: str) -> DataFrame:
    """(folder, year) of the sub-folders whose name starts with 4 digits."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    names = [s.getPath().getName() for s in root.getFileSystem(conf).listStatus(root) if s.isDirectory()]
    df = spark.createDataFrame([(n,) for n in names], "folder STRING")
    y = F.regexp_extract("folder", r"^(\d{4})", 1)
    return df.filter(y != "").withColumn("year", y.cast("int"))


def list_files(spark: SparkSession, base: str, folders: DataFrame) -> DataFrame:
    """(folder, file_name, path) of the *.xml files of the drawn folders."""
    paths = [f"{base.rstrip('/')}/{r.folder}" for r in folders.select("folder").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "folder STRING, file_name STRING, path STRING")
    files = listing(spark, paths, "*.xml", recursive=False)
    if files is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(paths).select("path")
    else:
        files = files.select(F.concat("store", "path").alias("path"))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file_name"),
                        "path")


def sample_corpus(spark: SparkSession, base: str, start_year: int, end_year: int,
                  files_per_decade: int = 5, pages_per_file: int = 1, seed: int = 42,
                  output: str | None = None) -> DataFrame:
    folders = year_window(list_folders(spark, base), "year", start_year, end_year)
    folders = folders.withColumn("decade", decade("year"))
    draws = sample_with_replacement(folders, "decade", "folder", files_per_decade, seed)
    files = list_files(spark, base, draws)
    chosen = draw_unseen(draws.withColumn("draw_key", F.col("draw_no")), files, "folder", "file_name", seed=seed)
    # bounded by files_per_decade x decades
    paths = sorted({r.path for r in chosen.select("path").collect()})
    records = read_records(spark, paths)
    if output:
        materialise_subset(records, f"{output}/records")
    # a page is known by folder, file name and place, wherever the corpus lies
    name = F.element_at(F.split("file", "/"), -1)
    pages = explode_pages(records).withColumn("_pid", F.concat_ws("#", "folder", name, F.col("page_ord").cast("string")))
    picked = sample_per_group(pages, ["file"], "_pid", pages_per_file, seed).drop("_pid")
    return segments_table(picked)
