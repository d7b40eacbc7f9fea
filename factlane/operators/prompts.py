"""Prompt texts (R1-R3) as Column expressions; the claim text is kept whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import col_of, py_str


def short_prompt(claim="claim", domain="domain") -> Column:
    """The short true/false prompt (wording kept verbatim)."""
    return F.concat(F.lit(K.SHORT_PROMPT_HEAD), py_str(domain), F.lit(K.SHORT_PROMPT_MID), py_str(claim),
                    F.lit(K.SHORT_PROMPT_TAIL))


def structured_prompt(claim="claim", domain="domain") -> Column:
    """R2: the prompt asking for classification, confidence and justification."""
    return F.concat(F.lit(K.STRUCTURED_PROMPT_HEAD), py_str(domain), F.lit(K.STRUCTURED_PROMPT_MID),
                    py_str(claim), F.lit(K.STRUCTURED_PROMPT_TAIL))


def verifiability_prompt(text="text") -> Column:
    """The verifiability prompt; a missing text prints as ``nan``."""
    return F.concat(F.lit(K.VERIFY_PROMPT_HEAD), py_str(text, "nan"), F.lit(K.VERIFY_PROMPT_TAIL))
