"""Column builders: text (F1-F15, F20), hashing (seeded choices, F18) and distribution tails."""

from .hashing import hash_bit, hash_int, hash_key, hash_mod, run_seed
from .stats import chi2_1_sf, stars, t_critical, t_two_sided_p, with_t_critical
from .text import (array_argmax, capitalize, contains_any, contains_word, first_line_matching, lower_text,
                   py_str, starts_with, timestamp_tag, truncate, ustrip, word_pattern)
