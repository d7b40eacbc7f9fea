"""Queries for sources (S*) and claim rules (P1-P8) on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import claims as C
from ..session import scratch_path
from ..sources import csvio, posts, sinks, tables
from .registry import (query, sql_claims, sql_contains_any, sql_domain, sql_list, sql_str, sql_with,
                       sql_word_regex)

# Query parameters: the reference's hedge, domain and suspicious-word lists never
# occur in the synthetic documents, so the table queries pass these substrings
# (which do occur) through the same parameters. The reference lists are the
# operator defaults and are tested on their own fixtures.
TEST_HEDGES = ["ght", "shat"]
TEST_DOMAINS = {"Health": ["ouen"], "Politics": ["ntly", "shat"], "War": ["ght", "whe"]}
TEST_SUSPICIOUS = ["ntly", "ght"]
DOC_LANG = "en"


def doc_posts(spark, sf_dir, only_language: bool = True):
    """Documents as posts; queries that keep only in-language posts push the
    language predicate down to the scan."""
    return tables.document_posts(spark, sf_dir, DOC_LANG if only_language else None)


# P2 / P5 / P7 in SQL over `documents` (langs = [lang]).
SQL_P2 = f"length(text) > 0 AND list_contains([lang], '{DOC_LANG}')"
SQL_HEDGED = sql_contains_any("lower(text)", TEST_HEDGES)
SQL_VERB = f"regexp_matches(lower(text), {sql_word_regex(K.AUX_VERBS)})"
SQL_CLAIM = f"(NOT {SQL_HEDGED} AND {SQL_VERB})"
SQL_DOMAIN = sql_domain("lower(text)", TEST_DOMAINS)


@query("q1_claim_domains", f"""
SELECT domain, count(*) AS n FROM (
  SELECT {SQL_DOMAIN} AS domain FROM documents WHERE {SQL_P2} AND {SQL_CLAIM})
WHERE domain IS NOT NULL GROUP BY domain""")
def q1_claim_domains(spark, sf_dir):
    """Flagship: documents -> language filter -> claim rule -> domain tag ->
    tagged only -> counts per domain."""
    claims = C.extract_claims(doc_posts(spark, sf_dir), code=DOC_LANG, phrases=TEST_HEDGES)
    tagged = C.tag_domains(claims, domains=TEST_DOMAINS)
    return C.value_counts(tagged, "domain")


# ---- sources -----------------------------------------------------------------

SQL_POST_LINES = f"""
    lines AS (
      SELECT source || '.jsonl' AS filename, doc_id AS post_id, text,
             CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa'
                       ELSE lang END AS langs, 'ok' AS status
      FROM documents
      UNION ALL
      SELECT 'pages.jsonl', NULL, NULL, NULL,
             CASE WHEN NOT json_valid(v) OR v = '' THEN 'invalid_json'
                  WHEN json_type(v) = 'OBJECT' THEN 'ok' ELSE 'not_object' END
      FROM (SELECT unnest(string_split(html, chr(10))) AS v FROM pages)
      UNION ALL
      SELECT 'events.jsonl', NULL, NULL, NULL,
             CASE WHEN NOT json_valid(props) OR props = '' THEN 'invalid_json'
                  WHEN json_type(props) = 'OBJECT' THEN 'ok' ELSE 'not_object' END
      FROM events)"""


@query("s1_read_posts", sql_with(SQL_POST_LINES) + """
SELECT filename, post_id, text, coalesce(langs, '') AS langs FROM lines WHERE status = 'ok'""")
def s1_read_posts(spark, sf_dir):
    """Parse a post directory (derived from documents, pages and events)."""
    p = posts.parse_posts(tables.post_lines(spark, sf_dir))
    return p.select("filename", "post_id", "text", F.array_join("langs", ",").alias("langs"))


@query("s2_bad_lines", sql_with(SQL_POST_LINES) + """
SELECT filename, status AS reason, count(*) AS n_lines FROM lines WHERE status <> 'ok' GROUP BY ALL""")
def s2_bad_lines(spark, sf_dir):
    """Skipped lines per file, invalid JSON and non-objects apart."""
    return posts.bad_line_report(tables.post_lines(spark, sf_dir))


@query("s3_file_lineage", sql_with(SQL_POST_LINES) + """
SELECT filename, count(*) AS n_posts, count(post_id) AS n_with_id FROM lines WHERE status = 'ok' GROUP BY ALL""")
def s3_file_lineage(spark, sf_dir):
    """S3: valid posts per source file."""
    p = posts.parse_posts(tables.post_lines(spark, sf_dir))
    return p.groupBy("filename").agg(F.count(F.lit(1)).alias("n_posts"), F.count("post_id").alias("n_with_id"))


@query("p1_field_defaults", sql_with(SQL_POST_LINES) + """
SELECT filename, count(*) AS n_posts, count(*) FILTER (WHERE text IS NULL) AS n_no_text,
       count(*) FILTER (WHERE langs IS NULL) AS n_no_langs, count(*) FILTER (WHERE post_id IS NULL) AS n_no_id
FROM lines WHERE status = 'ok' GROUP BY ALL""")
def p1_field_defaults(spark, sf_dir):
    """Missing fields read as defaults (text null, langs empty, post_id null)."""
    p = posts.parse_posts(tables.post_lines(spark, sf_dir))
    return p.groupBy("filename").agg(
        F.count(F.lit(1)).alias("n_posts"), F.count_if(F.col("text").isNull()).alias("n_no_text"),
        F.count_if(F.size("langs") == 0).alias("n_no_langs"), F.count_if(F.col("post_id").isNull()).alias("n_no_id"))


@query("s4_csv_roundtrip", sql_with(sql_claims()) + """
SELECT dataset, claim_id, claim, domain, label FROM claims""")
def s4_csv_roundtrip(spark, sf_dir):
    """S7 then S4: write the evaluation set as headered CSV (multi-line quoted
    text) to the shared scratch folder and read it back with the null normaliser."""
    claims = tables.evaluation_claims(spark, sf_dir)
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    csvio.write_csv(claims, path)
    back = csvio.read_csv(spark, path, "dataset string, claim_id bigint, claim string, domain string, label int")
    return csvio.require_columns(back, ["claim", "label", "domain"])


@query("s6_claim_lines", sql_with(sql_claims()) + r"""
SELECT replace(replace(replace(claim, '\', '\\'), chr(13), '\r'), chr(10), '\n') AS value FROM claims""")
def s6_claim_lines(spark, sf_dir):
    """Claims written one per line (newlines escaped) and read back."""
    claims = tables.evaluation_claims(spark, sf_dir)
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    sinks.write_claim_lines(claims, path, text="claim")
    return spark.read.text(path)


@query("s8_partitioned_results", sql_with(sql_claims()) + """
SELECT claim_id, label, domain, dataset FROM claims""")
def s8_partitioned_results(spark, sf_dir):
    """Results written partitioned by dataset, each partition read back with pruning."""
    claims = tables.evaluation_claims(spark, sf_dir).select("claim_id", "label", "domain", "dataset")
    path = scratch_path(spark, f"parts-{uuid.uuid4().hex}")
    sinks.write_partitioned(claims, path, keys=("dataset",))
    parts = [spark.read.parquet(path).where(F.col("dataset") == d) for d in ("UGC", "NGC")]
    return parts[0].unionByName(parts[1])


@query("s9_load_summary", sql_with(sql_claims()) + """
SELECT 'dataset' AS kind, dataset AS value, count(*) AS n FROM claims GROUP BY dataset
UNION ALL
SELECT 'label', CAST(label AS VARCHAR), count(*) FROM claims GROUP BY label""")
def s9_load_summary(spark, sf_dir):
    """Rows per dataset and class distribution."""
    claims = tables.evaluation_claims(spark, sf_dir)
    a = claims.groupBy(F.lit("dataset").alias("kind"), F.col("dataset").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    b = claims.groupBy(F.lit("label").alias("kind"), F.col("label").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


# ---- claim rules -------------------------------------------------------------

@query("p2_language_filter", f"SELECT doc_id, source FROM documents WHERE {SQL_P2}")
def p2_language_filter(spark, sf_dir):
    """Non-empty text whose language list holds the code."""
    p = tables.document_posts(spark, sf_dir)  # all languages: the rule rejects
    return p.where(C.has_text_in_language("text", "langs", DOC_LANG)).select(
        F.col("post_id").alias("doc_id"), F.regexp_replace("filename", r"\.jsonl$", "").alias("source"))


@query("p3_hedged", f"SELECT doc_id, {SQL_HEDGED} AS hedged FROM documents WHERE {SQL_P2}")
def p3_hedged(spark, sf_dir):
    """Hedge phrases as substrings of the lower-cased text."""
    p = doc_posts(spark, sf_dir).where(C.has_text_in_language("text", "langs", DOC_LANG))
    return p.select(F.col("post_id").alias("doc_id"), C.is_hedged("text", TEST_HEDGES).alias("hedged"))


@query("p4_aux_verb", f"SELECT doc_id, {SQL_VERB} AS has_verb FROM documents WHERE {SQL_P2}")
def p4_aux_verb(spark, sf_dir):
    """An auxiliary verb as a whole word (reference verb list)."""
    p = doc_posts(spark, sf_dir).where(C.has_text_in_language("text", "langs", DOC_LANG))
    return p.select(F.col("post_id").alias("doc_id"), C.has_aux_verb("text").alias("has_verb"))


@query("p5_claim_like", f"SELECT doc_id FROM documents WHERE {SQL_P2} AND {SQL_CLAIM}")
def p5_claim_like(spark, sf_dir):
    """P5: claim-like = not hedged and has a verb."""
    claims = C.extract_claims(doc_posts(spark, sf_dir), code=DOC_LANG, phrases=TEST_HEDGES)
    return claims.select(F.col("post_id").alias("doc_id"))


@query("p5_claim_like_reference_lists",
       f"""SELECT doc_id FROM documents WHERE {SQL_P2}
           AND NOT {sql_contains_any('lower(text)', K.HEDGE_PHRASES)} AND {SQL_VERB}""")
def p5_claim_like_reference_lists(spark, sf_dir):
    """P5 with the reference's own hedge and verb lists."""
    claims = C.extract_claims(doc_posts(spark, sf_dir), code=DOC_LANG)
    return claims.select(F.col("post_id").alias("doc_id"))


@query("p6_claim_funnel", f"""
SELECT stage, n, stage_order FROM (
  SELECT 'read' AS stage, count(*) AS n, 1 AS stage_order FROM documents
  UNION ALL SELECT 'with_text_in_language', count(*) FILTER (WHERE {SQL_P2}), 2 FROM documents
  UNION ALL SELECT 'hedged', count(*) FILTER (WHERE {SQL_P2} AND {SQL_HEDGED}), 3 FROM documents
  UNION ALL SELECT 'no_verb', count(*) FILTER (WHERE {SQL_P2} AND NOT {SQL_HEDGED} AND NOT {SQL_VERB}), 4
            FROM documents
  UNION ALL SELECT 'claims', count(*) FILTER (WHERE {SQL_P2} AND {SQL_CLAIM}), 5 FROM documents)""")
def p6_claim_funnel(spark, sf_dir):
    """Read -> in language with text -> hedged / no verb -> claims."""
    return C.claim_funnel(doc_posts(spark, sf_dir, only_language=False), code=DOC_LANG, phrases=TEST_HEDGES)


@query("p7_domain_tag", f"SELECT doc_id, {SQL_DOMAIN} AS domain FROM documents WHERE {SQL_P2} AND {SQL_CLAIM}")
def p7_domain_tag(spark, sf_dir):
    """First matching domain in map order, null when none."""
    claims = C.extract_claims(doc_posts(spark, sf_dir), code=DOC_LANG, phrases=TEST_HEDGES)
    return C.tag_domains(claims, domains=TEST_DOMAINS, keep_untagged=True).select(
        F.col("post_id").alias("doc_id"), "domain")


@query("p7_domain_tag_reference_map",
       f"""SELECT doc_id, {sql_domain('lower(text)', K.DOMAIN_KEYWORDS)} AS domain
           FROM documents WHERE {SQL_P2} AND {SQL_CLAIM}""")
def p7_domain_tag_reference_map(spark, sf_dir):
    """P7 with the reference's ordered Health / Politics / War map."""
    claims = C.extract_claims(doc_posts(spark, sf_dir), code=DOC_LANG, phrases=TEST_HEDGES)
    return C.tag_domains(claims, keep_untagged=True).select(F.col("post_id").alias("doc_id"), "domain")


@query("p8_tagged_only", f"""
SELECT doc_id, source, domain FROM (
  SELECT doc_id, source, {SQL_DOMAIN} AS domain FROM documents WHERE {SQL_P2} AND {SQL_CLAIM})
WHERE domain IS NOT NULL""")
def p8_tagged_only(spark, sf_dir):
    """Keep only tagged claims (the hand-over table of the chain)."""
    claims = C.extract_claims(doc_posts(spark, sf_dir), code=DOC_LANG, phrases=TEST_HEDGES)
    return C.tag_domains(claims, domains=TEST_DOMAINS).select(
        F.col("post_id").alias("doc_id"), F.regexp_replace("filename", r"\.jsonl$", "").alias("source"), "domain")


@query("p8_tag_shares", f"""
SELECT domain, n, CAST(n AS DOUBLE) / sum(n) OVER () AS share FROM (
  SELECT domain, count(*) AS n FROM (
    SELECT {SQL_DOMAIN} AS domain FROM documents WHERE {SQL_P2} AND {SQL_CLAIM})
  WHERE domain IS NOT NULL GROUP BY domain)""")
def p8_tag_shares(spark, sf_dir):
    """P8 + G16 normalised: tagged claims per domain with shares."""
    claims = C.extract_claims(doc_posts(spark, sf_dir), code=DOC_LANG, phrases=TEST_HEDGES)
    return C.value_counts(C.tag_domains(claims, domains=TEST_DOMAINS), "domain", normalize=True)
