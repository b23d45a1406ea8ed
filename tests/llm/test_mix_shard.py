"""op1 and op7: edges, hot groups, and the SQL on small tables."""
import pandas as pd
import pytest
from llm_duck import duck, same_rows

from pagecurate.llm import mixing, sharding, toxicity

F = mixing.F

SCHEMA = "doc_id long, text string, source string, size string, target string, shard string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", 1) for i, t, s in rows], SCHEMA)


ROWS = ([(i, "w " * (i % 7), "hot") for i in range(300)] + [(i, "a b c", None) for i in range(300, 320)]
        + [(400, None, "nul"), (401, "", "nul"), (402, "x " * 500, "long"), (None, "q r", "b"), (None, "q r", "b"), (405, "q r", "b")])


def test_mix_targets_and_sampling(spark):
    df = table(spark, ROWS)
    got = mixing.plan_mix(df, (5, 2, 1)).collect()
    assert len(got) == len(ROWS)
    total = sum(len((t or "").split()) for _, t, _ in ROWS)
    by = {}
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 3 * r["size"]
        b = by.setdefault(r.source, dict(size=r.source_size, target=r.target, taken=0, most=0))
        b["taken"] += r.taken
        b["most"] = max(b["most"], r["size"])
    assert abs(sum(b["target"] for b in by.values()) - total) < 1e-6
    for b in by.values():
        assert b["target"] <= 3 * b["size"] and abs(b["taken"] - b["target"]) <= max(b["most"], 4)
    again = mixing.plan_mix(df, (5, 2, 1)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_refines_hot_prefixes(spark, monkeypatch):
    df = table(spark, ROWS).select("doc_id", "source", "text")
    whole = sorted(map(repr, mixing.plan_mix(df, (5, 2, 1)).collect()))
    monkeypatch.setattr(mixing, "EDGE_ROWS", 3)
    assert sorted(map(repr, mixing.plan_mix(df, (5, 2, 1)).collect())) == whole


def test_mix_query_sql_on_edges(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, t, s) for i, t, s in ROWS], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    con = duck(documents=pd.read_parquet(f"{d}/documents.parquet").astype({"doc_id": "Int64"}))
    same_rows(mixing.op1_mix(spark, d), con, mixing.OP1_SQL)


def test_mix_expands_rows_and_keeps_columns(spark):
    df = table(spark, ROWS)
    out = mixing.mix(df, (5, 2, 1))
    assert out.schema == df.schema
    planned = sum(r.repeats for r in mixing.plan_mix(df, (5, 2, 1)).collect())
    assert out.count() == planned and out.filter("size != 'x'").count() == 0


def test_empty_tables(spark):
    df = table(spark, ROWS).limit(0)
    assert mixing.plan_mix(df, (5, 2, 1)).count() == 0 and mixing.mix(df, (1,)).count() == 0
    assert sharding.assign_shards(df).count() == 0


def test_mix_without_words(spark):
    df = table(spark, [(1, None, "a"), (2, "", "a"), (3, " \n", "b")])
    assert [r.taken for r in mixing.plan_mix(df, (5, 2, 1)).collect()] == [0, 0, 0]


SHARD_ROWS = [(i, "é" * (i % 50), "s") for i in range(500)] + [(900, "z" * 3000, "s"), (901, None, "s"), (902, "", "s"), (None, "null id", "s")]


@pytest.mark.parametrize("limit", [100, 1000, 1 << 20])
def test_shards_fit_and_equal_sql(spark, tmp_path, limit):
    df = table(spark, SHARD_ROWS)
    got = sharding.assign_shards(df, limit)
    assert set(got.columns) == set(df.columns) | {"n_bytes", "depth", "shard_bytes", "shard_docs"}
    sums = {}
    for r in got.collect():
        sums.setdefault(r.shard, []).append(r.n_bytes)
        assert len(r.shard) == r.depth
    assert all(sum(b) <= limit or len(b) == 1 for b in sums.values()) and sum(map(len, sums.values())) == len(SHARD_ROWS)
    pdf = df.select("doc_id", "text").toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    same_rows(got.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"), duck(documents=pdf), sharding.op7_sql(limit))


def test_only_oversized_buckets_split(spark):
    rows = sharding.assign_shards(table(spark, SHARD_ROWS), 1000).select("shard", "n_bytes").collect()
    total = {}
    for r in rows:
        for d in range(len(r.shard) + 1):
            total[r.shard[:d]] = total.get(r.shard[:d], 0) + r.n_bytes
    assert all(total[r.shard[:d]] > 1000 for r in rows for d in range(len(r.shard)))


def test_identical_rows_fill_overflow_pages(spark):
    rows = [(7, "same text", "s")] * 40 + [(i, "other", "s") for i in range(20)]
    got = sharding.assign_shards(table(spark, rows), 60).collect()
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert len(got) == 60 and max(sums.values()) <= 60
    assert {r.shard_bytes for r in got if "." in r.shard} <= {54, 36}


def test_write_shards(spark, tmp_path):
    df = table(spark, SHARD_ROWS).select("doc_id", "text")
    sharding.write_shards(df, f"{tmp_path}/out", 1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(SHARD_ROWS)


def test_inner_names_as_columns(spark):
    """Columns of the input with the names of helpers stay as they are."""
    names = ["whole", "last_key", "_key", "_source", "_row", "rank", "key", "_label", "_labelled", "_held", "_scan", "_id", "_h", "_leaf", "_leaf0", "_cell0", "_at", "_tenth", "size", "n_bytes"]
    df = table(spark, [(i, f"some words {i} " * (i % 7), "ab"[i % 2]) for i in range(60)] + [(3, "same", "a")] * 30)
    df = df.select("doc_id", "text", "source", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for out, replaced in ((mixing.plan_mix(df, (5, 2, 1)), {"size"}), (sharding.assign_shards(df, 100), {"n_bytes"}), (toxicity.score_toxicity(df, labels), set())):
        rows = out.collect()
        assert len(rows) == 90 and len(set(out.columns)) == len(out.columns)
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names if n not in replaced)


def test_query_splits_at_every_size(spark):
    depths = {r.depth for r in sharding.op7_shards(spark, "/root/testdata/sf0.001").select("depth").distinct().collect()}
    assert len(depths) >= 4
