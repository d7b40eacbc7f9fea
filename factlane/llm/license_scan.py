"""License scans: a trained paragraph classifier (operator 1).

A paragraph is a line of a text. Lines that hold an anchor are scored; the
anchors are derived from the templates, so that a line without one holds less
than ``CONFIRM`` of every template. Features are word 1- to 3-grams, hashed to
``DIMENSIONS`` places. Templates are short enough for notices wrapped over lines. A
softmax regression over licence families plus ``none`` is trained on perturbed
copies of notice templates and on a bounded sample of the corpus's own
paragraphs. Its temperature is set on held-out copies (calibration), and a
prediction holds only when the paragraph also contains enough of the family's
template; a paragraph that the model takes for a licence but no template
confirms is ``unknown``.

Scoring is one narrow projection of built-in functions: a text without an
anchor word is passed by substring tests, a paragraph's logits are sums of
constants looked up by hashed position. Nothing is shuffled.

Defined results: null or empty text has no paragraphs and no licence; ids are
carried as they are (null and repeated ids too).
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_CHARS

# Short public notices by family.
TEMPLATES: dict[str, list[str]] = {
    "apache": ["licensed under the apache license version 2.0",
               "you may not use this file except in compliance with the apache license"],
    "mit": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "gpl": ["this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it under the terms of the gnu general public license",
            "under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1",
             "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl": ["licensed under the gnu affero general public license version 3",
             "under the terms of the gnu affero general public license as published by the free software foundation"],
    "bsd": ["licensed under the bsd 3 clause license", "use of this source code is governed by a bsd style license",
            "redistribution and use in source and binary forms with or without modification",
            "redistributions of source code must retain the above copyright notice this list of conditions",
            "redistributions in binary form must reproduce the above copyright notice this list of conditions",
            "neither the name of the copyright holder nor the names of its contributors may be used to endorse"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license version 2.0"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0",
                 "licensed under a creative commons attribution share alike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0",
                 "licensed under a creative commons attribution non commercial 4.0 international license"],
    "cc0": ["released under the cc0 1.0 universal public domain dedication license"],
    "proprietary": ["copyright all rights reserved", "all rights reserved no license is granted"],
}
STEMS = ("licen", "copyright", "rights reserved", "permission", "public domain", "creative commons", "redistribut",
         "general public", "cc by", "cc-by", "cc0")
FAMILIES = ["none", *TEMPLATES]
DIMENSIONS = 2048
#: Bound of the sampled corpus paragraphs that the model sees as ``none``.
FIT_PARAGRAPHS = 2_000
COPIES = 60
CONFIRM = 0.5
MIN_PROBABILITY = 0.5


def template_grams(template: str) -> set[str]:
    w = template.split()
    return {" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def open_share(template: str, anchors) -> float:
    """The most of a template that a line without an anchor can hold."""
    grams = template_grams(template)
    return sum(not any(a in g for a in anchors) for g in grams) / len(grams)


def derived_anchors() -> tuple[str, ...]:
    """``STEMS`` and each template's longest words, until no line without an
    anchor can hold ``CONFIRM`` of a template."""
    out = list(STEMS)
    for t in (t for ts in TEMPLATES.values() for t in ts):
        for w in sorted(set(t.split()), key=lambda w: (-len(w), w)):
            if open_share(t, out) < CONFIRM:
                break
            if not any(a in w for a in out):
                out.append(w)
    return tuple(out)


ANCHORS = derived_anchors()


def has_anchor(text: Column) -> Column:
    out = F.lit(False)
    for a in ANCHORS:
        out = out | F.contains(text, F.lit(a))
    return out


def paragraph_grams(line: Column) -> Column:
    """Distinct word 1- to 3-grams of a lower-cased line. Words are runs of
    letters and digits (with inner dots)."""
    w = F.filter(F.split(line, r"[^\p{L}\p{N}.]+|\.(?![\p{N}])"), lambda x: x != "")
    n = F.size(w)
    two = F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    three = F.filter(F.zip_with(two, F.slice(w, 3, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(w, two, three))


def place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(DIMENSIONS)).cast("int")


def constant(values, kind: str) -> Column:
    """A constant array: parsed once by constant folding."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _perturbed(rng: np.random.Generator, template: str, filler: list[str]) -> str:
    words = [w for w in template.split() if rng.random() > 0.12]
    before = list(rng.choice(filler, rng.integers(0, 6)))
    after = list(rng.choice(filler, rng.integers(0, 6)))
    return " ".join(before + words + after)


def training_rows(docs: DataFrame) -> tuple[list[str], list[str]]:
    """(perturbed notices as 'family TAB text', corpus paragraphs): the corpus
    part is at most ``FIT_PARAGRAPHS`` lines of documents in hash order of the id
    that name no licence, one line per document."""
    lines = docs.where(F.col("text").isNotNull()).select(
        F.xxhash64("doc_id").alias("h"),
        F.element_at(F.split(F.lower("text"), "\n"), 1).alias("line")).where(~has_anchor(F.col("line")))
    got = [r["line"][:2000] for r in lines.orderBy("h", "line").limit(FIT_PARAGRAPHS).collect()]
    filler = sorted({w for line in got[:200] for w in line.split()[:40]}) or ["text"]
    rng = np.random.default_rng(11)
    notices = [f"{fam}\t{_perturbed(rng, t, filler)}" for fam, ts in TEMPLATES.items() for t in ts for _ in range(COPIES)]
    return notices, got


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(spark: SparkSession, docs: DataFrame) -> dict:
    """Weights, biases, temperature and template places (all of fixed size)."""
    notices, negatives = training_rows(docs)
    rows = [(n.split("\t")[0], n.split("\t")[1]) for n in notices] + [("none", t) for t in negatives]
    # notices that name only an anchor are ``none`` as well
    rows += [("none", f"{a} {b}") for a in ("license", "licensed", "permission", "copyright", "the license of")
             for b in ("this", "the work", "a", "text", "page", "and the other")]
    frame = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "i int, family string, line string")
    got = sorted(frame.select("i", "family", F.transform(paragraph_grams(F.col("line")), place).alias("p")).collect())
    x = np.zeros((len(got), DIMENSIONS), np.float64)
    y = np.array([FAMILIES.index(r["family"]) for r in got])
    for k, r in enumerate(got):
        x[k, r["p"]] = 1.0
    held = np.arange(len(got)) % 4 == 3
    w, b = np.zeros((DIMENSIONS, len(FAMILIES))), np.zeros(len(FAMILIES))
    xt, onehot = x[~held], np.eye(len(FAMILIES))[y[~held]]
    share = onehot.sum(0) + 1
    cost = (onehot / share).sum(1, keepdims=True)
    cost /= cost.sum()
    mw = np.zeros_like(w)
    for _ in range(300):
        g = (_softmax(xt @ w + b) - onehot) * cost
        mw = 0.9 * mw + xt.T @ g + 1e-5 * w
        w -= 2.0 * mw
        b -= 2.0 * g.sum(0)
    z = x[held] @ w + b
    nll = {t: -np.log(_softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1, 1.5, 2, 3)}
    temperature = min(nll, key=lambda t: (nll[t], t))
    accuracy = float((z.argmax(1) == y[held]).mean())
    parts = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, line string")
    core = parts.select("family", paragraph_grams(F.col("line")).alias("g")).collect()
    templates = [[sorted(r["g"]) for r in core if r["family"] == f] for f in FAMILIES]
    return {"w": (w / temperature).round(6), "b": (b / temperature).round(6), "templates": templates, "held_out_accuracy": accuracy}


def classify_paragraphs(lines: Column, model: dict) -> Column:
    """Array of lower-cased lines -> array of (line_no, family, probability,
    template_share, confirmed) for lines that the model takes for a licence."""
    n = len(FAMILIES)
    flat = constant([float(v) for v in model["w"].ravel()], "array<double>")
    bias = constant([float(v) for v in model["b"]], "array<double>")
    templates = constant(model["templates"], "array<array<array<string>>>")

    def logits(z: Column) -> Column:
        return F.aggregate(z["places"], bias, lambda acc, p: F.zip_with(
            acc, F.slice(flat, p * n + 1, n), lambda a, v: a + v))

    def chances(z: Column) -> Column:
        return F.struct(z["no"].alias("no"), z["grams"].alias("grams"), z["l"].alias("l"), F.array_max(z["l"]).alias("top"))

    found = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("no"), s.alias("s"))), lambda z: has_anchor(z["s"]))
    found = F.transform(found, lambda z: F.struct(z["no"].alias("no"), paragraph_grams(z["s"]).alias("grams")))
    found = F.transform(found, lambda z: F.struct(z["no"].alias("no"), z["grams"].alias("grams"), F.transform(z["grams"], place).alias("places")))
    found = F.transform(found, lambda z: F.struct(z["no"].alias("no"), z["grams"].alias("grams"), logits(z).alias("l")))
    found = F.transform(found, chances)
    found = F.transform(found, lambda z: F.struct(
        z["no"].alias("no"), z["grams"].alias("grams"), F.array_position(z["l"], z["top"]).cast("int").alias("k"),
        (F.lit(1.0) / F.aggregate(z["l"], F.lit(0.0), lambda acc, v: acc + F.exp(v - z["top"]))).alias("p")))
    found = F.filter(found, lambda z: z["k"] > 1)
    found = F.transform(found, lambda z: F.struct(
        z["no"].alias("no"), z["k"].alias("k"), z["p"].alias("p"),
        F.array_max(F.transform(F.element_at(templates, z["k"]), lambda t: (
            F.size(F.array_intersect(t, z["grams"])) / F.size(t)).cast("double"))).alias("share")))
    names = F.array(*[F.lit(f) for f in FAMILIES])

    def judged(z: Column) -> Column:
        sure = (z["p"] >= MIN_PROBABILITY) & (z["share"] >= CONFIRM)
        return F.struct(z["no"].alias("line_no"), F.when(sure, F.element_at(names, z["k"])).otherwise("unknown").alias("family"),
                        F.round(z["p"], 6).alias("probability"), F.round(z["share"], 6).alias("template_share"), sure.alias("confirmed"))

    return F.transform(found, judged)


def license_scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licence, family, probability, confirmed,
    paragraphs) of every document: ``paragraphs`` lists its licence paragraphs,
    ``family`` is that of the surest confirmed one (null: no licence found);
    a reserved right (``proprietary``), which heads many granted licences as
    well, counts only when nothing else is confirmed."""
    model = model or fit(docs.sparkSession, docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", (F.size(F.filter(F.split("text", "\n"), lambda s: F.trim(s, F.lit(GAP_CHARS)) != ""))).cast("bigint").alias("n_paragraphs"),
                 F.lower("text").alias("text"))
    d = d.select("doc_id", "n_paragraphs", F.when(has_anchor(F.col("text")), F.split("text", "\n")).otherwise(
        F.array().cast("array<string>")).alias("lines"))
    d = d.select("doc_id", "n_paragraphs", F.inline(F.array(F.struct(classify_paragraphs(F.col("lines"), model).alias("paragraphs")))))
    best = F.array_max(F.transform("paragraphs", lambda z: F.struct(
        z["confirmed"].alias("confirmed"), (z["family"] != "proprietary").alias("grants"), z["probability"].alias("probability"), z["family"].alias("family"))))
    return d.select("doc_id", "n_paragraphs", F.size("paragraphs").cast("bigint").alias("n_licence"), best["family"].alias("family"),
                    best["probability"].alias("probability"), F.coalesce(best["confirmed"], F.lit(False)).alias("confirmed"), "paragraphs")
