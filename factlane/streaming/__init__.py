"""Structured Streaming form of the extraction chain."""

from .extraction import bad_line_stream, claim_stream, domain_counts, post_line_stream, write_claims
