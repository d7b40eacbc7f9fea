"""Fixtures of the training-data tests: small texts with every awkward case."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double, hash binary"
WORDS = [a + b for a in ("ba", "ko", "li", "mu", "te", "ro", "sa", "ni") for b in ("n", "ra", "lo", "d", "st", "mi", "ve", "x", "pu")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() + ("." if i % 11 == 10 else "") + ("\n" if i % 37 == 36 else ""))
    return " ".join(out)


def frame(spark, rows):
    """rows of (doc_id, text[, lang[, source]]); further columns clash with
    names used inside the operators."""
    full = []
    for r in rows:
        r = (*r, *(None,) * (4 - len(r)))
        full.append((*r, None if r[1] is None else len(r[1]), "k", 0.5, b"x"))
    return spark.createDataFrame(full, SCHEMA)


def texts(seed: int = 1, n: int = 24):
    """(doc_id, text, lang, source): repeats, near copies, nulls, empties, a long
    text, a periodic text, equal rows and several texts under one id."""
    rng = random.Random(seed)
    passage = prose(rng, 120)
    out = []
    for i in range(n):
        t = prose(rng, rng.randint(30, 160))
        if i % 3 == 0:
            t = t + " " + passage + " " + prose(rng, 20)
        out.append((i * 7 - 20, t, ["aa", "bb", None][i % 3], f"s{i % 4}" if i % 5 else None))
    base = out[1][1]
    words = base.split(" ")
    out.append((500, base, "aa", "s1"))
    out.append((501, " ".join([*words[:40], "Edited", *words[41:]]), "aa", "s1"))
    out += [(600, None, "aa", "s2"), (601, "", "bb", "s2"), (602, " \n\t ", None, None), (603, "One", "aa", "s0"), (604, "One", "bb", "s0")]
    out.append((605, "Abc de. " * 400, "bb", "s3"))
    out.append((606, prose(rng, 6000), "aa", "s3"))
    out += [(607, "é" * 700 + " ü " + "é" * 700, "bb", "s3")]
    return out


AWKWARD = [(None, "Null id text with some words here", "aa", None), (None, "Another null id", None, "s1"),
           (500, "Same id, other text", "aa", "s1"), (603, "One", "aa", "s0")]
