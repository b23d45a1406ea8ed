"""Queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from functools import wraps

from pagecurate.llm.collocations import op13_collocations, op13_sql
from pagecurate.llm.common import ship_package
from pagecurate.llm.decontaminate import OP9_SQL, op9_decontaminate
from pagecurate.llm.mixing import OP1_SQL, op1_mix
from pagecurate.llm.near_dup import op8_near_dups
from pagecurate.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from pagecurate.llm.pii import op6_pii
from pagecurate.llm.quality import op10_quality
from pagecurate.llm.quality_trees import op11_quality_trees
from pagecurate.llm.secret_links import op5_secrets
from pagecurate.llm.sharding import op7_shards, op7_sql
from pagecurate.llm.substring import op2_substrings
from pagecurate.llm.token_files import op4_tokens
from pagecurate.llm.toxicity import op3_toxicity


def shipped(query):
    """The query, after the executors have been given this package."""
    @wraps(query)
    def run(spark, *args):
        ship_package(spark)
        return query(spark, *args)
    return run


QUERIES = {name: shipped(query) for name, query in {
    "op1_mix": op1_mix,
    "op2_substrings": op2_substrings,
    "op3_toxicity": op3_toxicity,
    "op4_tokens": op4_tokens,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_shards": op7_shards,
    "op8_near_dups": op8_near_dups,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_quality_trees": op11_quality_trees,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}.items()}

ORACLE = {
    "op1_mix": OP1_SQL,
    "op7_shards": op7_sql(),
    "op9_decontaminate": OP9_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_collocations": op13_sql(),
}
