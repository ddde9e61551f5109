"""Queries of this subpackage and their SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from . import bestfit_packing, exact_dedup, lexical_search, line_dedup, media_columns, minhash_dedup, mixing, prefix_trie, quality_classifier, quality_rules, substring_dedup, suffix_dedup, warc


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_bestfit_packing": bestfit_packing.op4_bestfit_packing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_media_columns": media_columns.op6_media_columns,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op9_warc": warc.OP9_SQL, "op11_exact_dedup": exact_dedup.OP11_SQL, "op12_lexical_search": lexical_search.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
