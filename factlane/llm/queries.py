"""One query per operator: production parameters over whole tables."""

from __future__ import annotations

from .common import read_table
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["QUERIES", "ORACLE_SQL"]


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    from .license_scan import license_scan
    return license_scan(read_table(spark, sf_dir, "documents"))


from .source_mix import MIX_SQL  # noqa: E402


@query("op9_source_mix", "WITH docs AS (SELECT * FROM documents)," + MIX_SQL
       + "SELECT doc_id, size, source_size, target, taken FROM mixed")
def op9_source_mix(spark, sf_dir):
    from .source_mix import mix_sources
    return mix_sources(read_table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    from .language_id import identify_language
    return identify_language(read_table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    """Chain of the two labelled categories: low quality, then toxic."""
    from pyspark.sql import functions as F

    from .toxicity import score_toxicity
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
    return score_toxicity(read_table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    from .decontaminate import find_leaks
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op3_lm_score")
def op3_lm_score(spark, sf_dir):
    from .lm_score import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    from .substring_dedup import remove_repeats
    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_components
    return jaccard_components(read_table(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeated_strings
    return remove_repeated_strings(read_table(spark, sf_dir, "documents"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from .best_fit_packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


from .lexical_search import SEARCH_SQL  # noqa: E402


@query("op11_lexical_search", SEARCH_SQL)
def op11_lexical_search(spark, sf_dir):
    from .lexical_search import rank_documents
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


from .collocations import COLLOCATION_SQL  # noqa: E402


@query("op12_collocations", COLLOCATION_SQL)
def op12_collocations(spark, sf_dir):
    from .collocations import collocations
    return collocations(read_table(spark, sf_dir, "documents"))
