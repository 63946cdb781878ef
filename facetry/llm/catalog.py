"""Queries of the document operators and their SQL."""

from __future__ import annotations

from functools import wraps

import corpus_pipeline
from facetry.llm import collocations, decontaminate, fingerprints, language, mixing, neardup, packing, secrets, tokenids, toxicity, urlfilter, whitening, wordpieces
from facetry.session import ship_package

QUERIES, SQL = {}, {}


def _query(fn):
    @wraps(fn)
    def run(spark, folder):
        ship_package(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run


for _fn in (fingerprints.op1_fingerprints, urlfilter.op2_url_filter, mixing.op3_mix_sources, toxicity.op4_toxicity, tokenids.op5_token_files, neardup.op6_near_duplicates, wordpieces.op7_token_counts, decontaminate.op8_benchmark_matches, secrets.op9_secrets, language.op10_language, whitening.op11_whitening, packing.op12_packing, collocations.op13_collocations):
    _query(_fn)
for _module in (mixing, collocations):
    SQL |= _module.SQL
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
