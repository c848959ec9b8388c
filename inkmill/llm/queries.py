"""The queries of this subpackage for the driver's entry module, and SQL for those that it can express."""

from __future__ import annotations

from inkmill.llm import cascade, decontam, license_scan, line_dedup, ngram_lm, packing, pii, prefix_trie, quality_gbdt, ranked_search, sharding, simhash, tokens
from inkmill.session import table


TEST_KEY = "a key for tests only"  #: real documents take a key that is kept secret


def over_documents(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": over_documents(line_dedup.op1),
    "op2_token_binary": over_documents(tokens.op2),
    "op3_packing": over_documents(packing.op3),
    "op4_sharding": over_documents(sharding.op4),
    "op5_pii_pseudonyms": over_documents(lambda docs: pii.op5(docs, TEST_KEY)),
    "op6_simhash_near_dedup": over_documents(simhash.op6),
    "op7_benchmark_decontamination": lambda spark, sf_dir: decontam.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op8_quality_classifier": lambda spark, sf_dir: quality_gbdt.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_license_scan": over_documents(license_scan.op9),
    "op10_quality_rules": over_documents(cascade.op10),
    "op11_ngram_lm": over_documents(ngram_lm.op11),
    "op12_prefix_trie": lambda spark, sf_dir: prefix_trie.op12(table(spark, sf_dir, "conversations")),
    "op13_ranked_search": lambda spark, sf_dir: ranked_search.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

ORACLE_SQL: dict[str, str] = {
    "op7_benchmark_decontamination": decontam.OP7_SQL,
    "op10_quality_rules": cascade.OP10_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
