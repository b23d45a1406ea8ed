import os
import tempfile

from conftest import FIXTURES
from pagecurate.sources.tei import explode_pages, explode_segments, read_records
from pagecurate.streaming.ingest import stream_segments


def test_stream_equals_batch(spark):
    src = os.path.join(FIXTURES, "tei")
    sink = tempfile.mkdtemp(prefix="pc-stream-") + "/seg"
    q = stream_segments(spark, src, sink, query_name="test_ingest", once=True)
    q.awaitTermination(180)
    assert q.exception() is None
    got = sorted((r.id, r.text_line) for r in spark.read.parquet(sink).collect())
    batch = explode_segments(explode_pages(read_records(spark, src)))
    assert got == sorted((r.id, r.text_line) for r in batch.collect())
