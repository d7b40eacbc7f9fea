"""Sources and sinks: JSONL posts (S1-S3), CSV (S4-S7), partitioned results (S8), driver tables."""

from .csvio import read_csv, require_columns, normalise_nulls, write_csv
from .posts import bad_line_report, classify_lines, parse_posts, read_lines, read_posts
from .sinks import escape_lines, write_claim_lines, write_partitioned
from .tables import document_posts, evaluation_claims, load, post_lines
