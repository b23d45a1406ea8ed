"""Streaming form of the segment extraction (A1-A3).

New record files dropped into a folder are cut into pages and segments by the
same expressions as the batch reader and appended to a Parquet table. The
pipeline is stateless (one record = one row), so no watermark is needed; the
checkpoint goes to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagecurate.session import ensure_checkpoint_dir
from pagecurate.sources.tei import explode_pages, explode_segments


def stream_segments(spark: SparkSession, source_dir: str, sink_dir: str,
                    query_name: str = "segments_ingest", once: bool = False) -> StreamingQuery:
    records = (spark.readStream.option("pathGlobFilter", "*.xml")
               .option("maxFilesPerTrigger", 1000).text(source_dir, wholetext=True)
               .select(F.col("_metadata.file_path").alias("file"), "value"))
    seg = explode_segments(explode_pages(records))
    # one checkpoint per (query, source, sink): a restarted query resumes, a new one starts clean
    tag = hashlib.md5(f"{source_dir}|{sink_dir}".encode()).hexdigest()[:12]
    ckpt = f"{ensure_checkpoint_dir(spark)}/streams/{query_name}-{tag}"
    w = (seg.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", ckpt).queryName(query_name).outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
