"""Model-answer parsers (R6-R10) as Column expressions.

* ``lenient_label``: strip + lower; only "true" -> 1, only "false" -> 0; both ->
  whichever the text starts with; else null (substring test, so "untrue" -> 1).
* ``structured_label``: "classification: true"/"classification: false"
  anywhere (true first); else the first line starting "classification:" that
  holds true/false; else only one of the two words anywhere; else null.
* ``confidence_level``: "confidence: high|medium|low" anywhere (in that
  order); else the first line starting "confidence:" with a level; else
  "Unknown".
* ``verifiable_label``: the answer stripped, plus a normalised class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CONFIDENCE_LEVELS, ERROR_LABEL, NOT_VERIFIABLE, UNKNOWN_CONFIDENCE, VERIFIABLE
from ..functions.text import col_of, first_line_matching, ustrip


def _null_int() -> Column:
    return F.lit(None).cast("int")


def _true_false_only(low: Column) -> Column:
    has_t, has_f = low.contains("true"), low.contains("false")
    return F.when(has_t & ~has_f, F.lit(1)).when(has_f & ~has_t, F.lit(0))


def lenient_label(answer="answer") -> Column:
    """R6."""
    low = F.lower(ustrip(col_of(answer)))
    return (_true_false_only(low)
            .when(low.startswith("true"), F.lit(1))
            .when(low.startswith("false"), F.lit(0))
            .otherwise(_null_int()))


def structured_label(answer="answer") -> Column:
    """R7."""
    a = col_of(answer)
    low = F.lower(a)
    line = first_line_matching(a, "classification:", ["true", "false"])
    return (F.when(low.contains("classification: true"), F.lit(1))
            .when(low.contains("classification: false"), F.lit(0))
            .when(line.isNotNull(), F.when(line.contains("true"), F.lit(1)).otherwise(F.lit(0)))
            .when(low.contains("true") & ~low.contains("false"), F.lit(1))
            .when(low.contains("false") & ~low.contains("true"), F.lit(0))
            .otherwise(_null_int()))


def confidence_level(answer="answer", levels=CONFIDENCE_LEVELS) -> Column:
    """R8."""
    a = col_of(answer)
    low = F.lower(a)
    expr = None
    for lv in levels:
        hit = low.contains(f"confidence: {lv}")
        expr = F.when(hit, F.lit(lv.title())) if expr is None else expr.when(hit, F.lit(lv.title()))
    line = first_line_matching(a, "confidence:", levels)
    from_line = None
    for lv in levels:
        from_line = (F.when(line.contains(lv), F.lit(lv.title())) if from_line is None
                     else from_line.when(line.contains(lv), F.lit(lv.title())))
    return expr.when(line.isNotNull(), from_line).otherwise(F.lit(UNKNOWN_CONFIDENCE))


def verifiable_answer(answer="answer") -> Column:
    """The stored label (stripped, otherwise as answered)."""
    return ustrip(col_of(answer))


def verifiable_class(answer="answer") -> Column:
    """R9 normaliser: Verifiable / Not Verifiable / Error / Other."""
    low = F.lower(ustrip(col_of(answer)))
    low = F.regexp_replace(low, r"[\s\p{P}\p{S}]+\z", "")
    return (F.when(low == ERROR_LABEL.lower(), F.lit(ERROR_LABEL))
            .when(low == NOT_VERIFIABLE.lower(), F.lit(NOT_VERIFIABLE))
            .when(low == VERIFIABLE.lower(), F.lit(VERIFIABLE))
            .otherwise(F.lit("Other")))
