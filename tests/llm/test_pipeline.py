"""The corpus pipeline, each stage against a brute-force reading of its input."""
from collections import Counter

import corpus_pipeline
import pytest
from llm_brute import near_dups, token_rows
from llm_duck import duck
from tokenizers import Tokenizer

from pagecurate.llm import decontaminate, mixing, token_files, toxicity
from pagecurate.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        tables.append((name, docs))
    return tables


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in stages[1:]] == ["toxicity", "near_dedup", "decontaminate", "mix", "token_output"]
    first = stages[0][1].schema
    for _, df in stages[1:-1]:
        assert df.schema == first and df.count() > 0


def test_toxicity(spark, stages):
    before, after = stages[0][1], stages[1][1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(before, labels, carry=["doc_id"]).filter("predicted = 1").collect()}
    assert toxic and texts(after) == [r for r in texts(before) if r[0] not in toxic]


def test_near_dedup(stages):
    before = texts(stages[1][1])
    kept = {d for d, _, _, k in near_dups(before) if k}
    assert texts(stages[2][1]) == [r for r in before if r[0] in kept] and len(kept) < len(before)


def test_decontaminate(spark, stages):
    con = duck(documents=stages[2][1].toPandas(), benchmark=spark.read.parquet(f"{SF}/benchmark.parquet").toPandas())
    found = {r[0] for r in con.sql(f"SELECT doc_id FROM ({decontaminate.OP9_SQL})").fetchall()}
    assert found and texts(stages[3][1]) == [r for r in texts(stages[2][1]) if r[0] not in found]


def test_mix(stages):
    con = duck(documents=stages[3][1].toPandas())
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, repeats FROM ({mixing.OP1_SQL})").fetchall() if r[1]}
    assert Counter(r.doc_id for r in stages[4][1].collect()) == want and max(want.values()) > 1


def test_token_output(stages):
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    assert sorted((tuple(r) for r in stages[5][1].collect()), key=repr) == token_rows(texts(stages[4][1]), tokenizer)


def test_run_is_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, stages[5][1].collect()))
    assert corpus_pipeline.ORACLE_SQL is None
