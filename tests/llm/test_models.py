"""Operators 1, 3, 5, 7, 8: learned models."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np

from factlane.llm import language_id, license_scan, lm_score, quality_rules, toxicity

from .helpers import AWKWARD, frame, prose, texts


def two_languages(n=160):
    rng = random.Random(8)
    a, b = ["the", "and", "thing", "with", "shall"], ["der", "und", "ßen", "über", "schon"]
    return [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(rng.randint(8, 90))), "en" if i % 2 else "de", "s") for i in range(n)]


def test_language_id_held_out(spark):
    rows = two_languages() + [(900, None, "en", "s"), (901, "123 456", "en", "s"), (902, "", None, "s")] + AWKWARD[:1]
    got = {r["doc_id"]: r for r in language_id.identify_language(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(160):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in range(160) if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert language_id.identify_language(frame(spark, []).limit(0)).count() == 0


def test_windows_cover_whole_texts():
    raw = bytes(range(1, 251)) * 5
    x, owner, used = language_id.text_windows(np.frombuffer(raw, np.uint8), np.array([0, 0, 300, len(raw)]))
    assert used.sum() == len(raw) and owner.tolist() == [1, 1, 2, 2, 2, 2]
    assert x[1][44] == 0 and x[1][43] == raw[299]


def test_quality_statistics_and_rules(spark):
    rows = [(i, t) for i, t, *_ in texts(4)] + [(700, "A b c d e f\nA b c d e f\n#$ x"), (701, "a b c")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows), spark.createDataFrame([], "doc_id bigint, quality int")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if c[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        lines = [s for s in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and r["kept"] == (not r["base_failed"])


def test_quality_learns_thresholds(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        t = prose(rng, 60)
        rows.append((i, t.replace(" ", "*** ") if bad else t))
        labels.append((i, 0 if bad else 1) if i < 160 else (i, None))
    labels += labels[:3]
    got = quality_rules.quality_rules(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got)


def test_license_scan(spark):
    rng = random.Random(5)
    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.",
               "cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3."}
    rows = [(i, prose(rng, 40) + "\n" + n + "\n" + prose(rng, 10)) for i, n in enumerate(notices.values())]
    rows += [(10, prose(rng, 50)), (11, None), (12, ""), (13, "permission was asked by the owner"), *[(r[0], r[1]) for r in AWKWARD]]
    docs = frame(spark, rows)
    model = license_scan.fit(spark, docs)
    assert model["held_out_accuracy"] > 0.85
    got = license_scan.license_scan(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["family"] for i in range(4)] == list(notices)
    assert all(by_id[i]["confirmed"] for i in range(4)) and not any(by_id[i]["confirmed"] for i in (10, 11, 12, 13))
    assert license_scan.license_scan(docs.limit(0), model).count() == 0


STANDARD = {
    "bsd": "Copyright (c) 2020, Some Holder. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without "
           "modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
           "above copyright notice, this list of conditions and the following disclaimer.",
    "mit": "Copyright (c) 2020 Some Holder\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
           "and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
           "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
           "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def test_standard_notices(spark):
    rng = random.Random(17)
    rows, want = [(0, prose(rng, 60))], {0: None}
    for width in (66, 72, 80, 10_000):
        for family, notice in STANDARD.items():
            lines = [line for part in notice.split("\n") for line in textwrap.wrap(part, width) or [""]]
            want[len(rows)] = family
            rows.append((len(rows), prose(rng, 20) + "\n" + "\n".join(lines) + "\n" + prose(rng, 20)))
    # the clause without its header
    want[len(rows)] = "bsd"
    rows.append((len(rows), "Redistribution and use in source and binary forms, with or without modification, are permitted provided"))
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["family"] if r["confirmed"] else None for r in license_scan.license_scan(docs).collect()}
    assert got == want
    assert all(license_scan.open_share(t, license_scan.ANCHORS) < license_scan.CONFIRM for ts in license_scan.TEMPLATES.values() for t in ts)


def test_toxicity_chain(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, 60).split(" ")
        if i % 5 == 0:
            words[rng.randrange(60)] = "vilething"
        rows.append((i, " ".join(words)))
        if i < 200:
            labels.append((i, int(i % 5 == 0), int(i % 10 == 0)))
    rows += [(400, None), (401, ""), *[(r[0], r[1]) for r in AWKWARD]]
    labels += [(0, None, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int, other int")
    got = toxicity.score_toxicity(frame(spark, rows), lab, ["toxic", "other"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and 200 <= r["doc_id"] < 300:
            assert r["toxic"] == (r["doc_id"] % 5 == 0)
        assert 0 <= r["toxic_score"] <= 1 and 0 <= r["other_score"] <= 1
    none = toxicity.score_toxicity(frame(spark, rows), lab.limit(0), ["toxic"]).collect()
    assert not any(r["toxic"] for r in none)
    assert toxicity.score_toxicity(frame(spark, []).limit(0), lab, ["toxic"]).count() == 0


def test_network_is_a_distribution_and_state_is_carried():
    rng = np.random.default_rng(2)
    net = lm_score.init_network(70, rng)
    h = rng.normal(size=(3, lm_score.HIDDEN)).astype(np.float32)
    total = sum(np.exp(lm_score.output_log_chance(net, h, np.full(3, y))) for y in range(70))
    assert np.allclose(total, 1, atol=1e-4)
    texts_ = [rng.integers(0, 69, n).tolist() + [69] for n in (5, 200, 0, 90)]
    got = lm_score.score_texts(net, [np.array(t) for t in texts_], 70)
    for t, s in zip(texts_, got):
        h, prev, want = np.zeros((1, lm_score.HIDDEN), np.float32), 70, 0.0
        for y in t:
            h = lm_score.step(net, np.array([prev]), h)[0]
            want += float(lm_score.output_log_chance(net, h, np.array([y]))[0])
            prev = y
        assert math.isclose(s, want, rel_tol=1e-4)


def test_backpropagation_lowers_the_loss():
    y = np.tile(np.array([1, 2, 3, 4, 9]), (8, 40))
    net = lm_score.train_network(y, 10, epochs=30)
    score = lm_score.score_texts(net, [np.array([1, 2, 3, 4, 9])], 10)[0]
    assert score > 5 * math.log(0.5)


def test_long_texts_train_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 8_000, raising=False)
    monkeypatch.setattr(lm_score, "LOTS", 2, raising=False)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:12]
    asked = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, "ka lo " * 2_050 + "mi nu pe " * 900) for i in ids] + [(asked, "mi nu pe " * 100)]
    got = {r["doc_id"]: r for r in lm_score.score_documents(frame(spark, rows)).collect()}
    assert got[asked]["held_out"] and got[asked]["score"] / 301 > math.log10(0.5)
    # both halves are learned, and no end after the 4,000th word
    assert all(got[i]["score"] / got[i]["n_tokens"] > math.log10(0.5) for i in ids)


def test_passes_do_not_depend_on_the_size(spark):
    """As long as the shards are the same, the number of tokens changes nothing."""
    train = frame(spark, [(i, "ka lo mi " * 30) for i in range(8)])
    nets = [lm_score.fit_network(train, {b"ka": 0, b"lo": 1, b"mi": 2}, 3, n) for n in (728, 1_900_000)]
    assert all((nets[0][k] == nets[1][k]).all() for k in nets[0])


def test_lm_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "COMMON", 20)
    monkeypatch.setattr(lm_score, "SYMBOLS", 8)
    monkeypatch.setattr(lm_score, "EPOCHS", 1)
    rows = [(i, t) for i, t, *_ in texts(7, 12)]
    got = {r["doc_id"]: r for r in lm_score.score_documents(frame(spark, rows)).collect()}
    low = lambda t: (t or "").encode().translate(lm_score.LOWER).split()
    train = [low(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v, e = sum(c.values()) + len(train), len(c) + 1, len(train)
    for i, t in rows:
        w = low(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((e + 1) / (n + v + 1))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert lm_score.score_documents(frame(spark, rows + [(r[0], r[1]) for r in AWKWARD])).count() == len(rows) + len(AWKWARD)
    assert lm_score.score_documents(frame(spark, rows).limit(0)).count() == 0
