"""Claim rules (P2-P8): language filter, hedge exclusion, auxiliary-verb test,
ordered domain tagging and the claim funnel.

All rules are Column predicates; word lists are parameters (defaults are the
fixed values in ``constants``), folded into literal OR chains that compile into
the generated code of the scan stage. No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AUX_VERBS, DOMAIN_KEYWORDS, ENGLISH_CODE, HEDGE_PHRASES
from ..functions.text import col_of, contains_any, contains_word


def has_text_in_language(text="text", langs="langs", code: str = ENGLISH_CODE) -> Column:
    """Non-empty text and ``code`` is an element of the ``langs`` list
    (null list fails; multi-language lists pass)."""
    t = col_of(text)
    return t.isNotNull() & (F.length(t) > 0) & F.coalesce(F.array_contains(col_of(langs), code), F.lit(False))


def is_hedged(text="text", phrases=HEDGE_PHRASES) -> Column:
    """Any hedge phrase as a substring of the lower-cased text."""
    return contains_any(F.lower(col_of(text)), phrases)


def has_aux_verb(text="text", verbs=AUX_VERBS) -> Column:
    """Any auxiliary verb as a whole word."""
    return contains_word(F.lower(col_of(text)), verbs)


def is_claim_like(text="text", phrases=HEDGE_PHRASES, verbs=AUX_VERBS) -> Column:
    """P5: not hedged, and holds an auxiliary verb."""
    return ~is_hedged(text, phrases) & has_aux_verb(text, verbs)


def detect_domain(text="text", domains: dict[str, list[str]] = DOMAIN_KEYWORDS, match: str = "substring") -> Column:
    """First domain (in map order) with a keyword in the lower-cased text,
    else null. ``match="word"`` requires whole words instead of substrings."""
    low = F.lower(col_of(text))
    expr = None
    for name, words in domains.items():
        hit = contains_any(low, words) if match == "substring" else contains_word(low, words)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr if expr is not None else F.lit(None).cast("string")


def extract_claims(posts: DataFrame, text: str = "text", langs: str = "langs", code: str = ENGLISH_CODE,
                   phrases=HEDGE_PHRASES, verbs=AUX_VERBS) -> DataFrame:
    """P2 + P5: claim-like posts in the language, all columns kept."""
    return posts.where(has_text_in_language(text, langs, code) & is_claim_like(text, phrases, verbs))


def tag_domains(claims: DataFrame, text: str = "text", domains=DOMAIN_KEYWORDS, keep_untagged: bool = False,
                match: str = "substring") -> DataFrame:
    """P7 (+ P8 unless ``keep_untagged``)."""
    out = claims.withColumn("domain", detect_domain(text, domains, match))
    return out if keep_untagged else out.dropna(subset=["domain"])


def claim_funnel(posts: DataFrame, text: str = "text", langs: str = "langs", code: str = ENGLISH_CODE,
                 phrases=HEDGE_PHRASES, verbs=AUX_VERBS) -> DataFrame:
    """(stage, n) for read, in-language with text, hedged, no verb, claims,
    from one aggregate pass (partial aggregation before the single-row exchange)."""
    # rule flags once per row in a projection; the aggregate then only counts
    # (inside an aggregate each count_if would re-run the regex over the text)
    lang_c, hedged_c = has_text_in_language(text, langs, code), is_hedged(text, phrases)
    flags = posts.select(lang_c.alias("__l"), hedged_c.alias("__h"),
                         # the verb regex only runs where it decides something
                         F.when(lang_c & ~hedged_c, has_aux_verb(text, verbs)).otherwise(F.lit(False)).alias("__v"))
    lang_ok, hedged, verb = F.col("__l"), F.col("__h"), F.col("__v")
    counts = flags.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(lang_ok).alias("with_text_in_language"),
        F.count_if(lang_ok & hedged).alias("hedged"),
        F.count_if(lang_ok & ~hedged & ~verb).alias("no_verb"),
        F.count_if(lang_ok & ~hedged & verb).alias("claims"),
    )
    stages = ["read", "with_text_in_language", "hedged", "no_verb", "claims"]
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i + 1))])
    return (counts.unpivot([], stages, "stage", "n")
            .withColumn("stage_order", order[F.col("stage")].cast("int")))


def value_counts(df: DataFrame, column: str, normalize: bool = False, dropna: bool = True) -> DataFrame:
    """Counts per value (and share of total with ``normalize``)."""
    src = df.where(F.col(column).isNotNull()) if dropna else df
    out = src.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        # total as a scalar subquery (run once, no single-task window over all groups)
        total = src.agg(F.count(F.lit(1)).cast("double")).scalar()
        out = out.withColumn("share", F.col("n") / total)
    return out
