"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, exact_dedup, licenses, minhash, packing, personal, pieces, prefix_trie, quality_model, quality_rules, substring_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": quality_model.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_pieces": pieces.query,
    "op6_quality_rules": quality_rules.query,
    "op7_warc": warc.query,
    "op8_minhash": minhash.query,
    "op9_packing": packing.query,
    "op10_licenses": licenses.query,
    "op11_collocations": collocations.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_personal_data": personal.query,
}

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": exact_dedup.SQL, "op6_quality_rules": quality_rules.SQL, "op11_collocations": collocations.SQL, "op12_prefix_trie": prefix_trie.SQL}
