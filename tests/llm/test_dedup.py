"""Operators 2, 4 and 6 against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from factlane.llm import jaccard_join, substring_dedup, suffix_dedup
from factlane.llm.hashing import window_hashes, word_hashes

from .helpers import AWKWARD, frame, prose, texts


def brute_words(rows, size=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - size + 1):
            k = tuple(w[j:j + size])
            if k in seen:
                gone.update(range(j, j + size))
            seen.add(k)
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, size=400):
    count = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        count.update(raw[j:j + size] for j in range(len(raw) - size + 1))
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for j in range(len(raw) - size + 1):
            if count[raw[j:j + size]] > 1:
                gone[j:j + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(t):
    w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if len(w) < 4:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[j:j + 4]) for j in range(len(w) - 3))


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def plain(rows):
    return [(r[0], r[1]) for r in rows]


def near_groups():
    """Chains and groups of near copies around the similarity bound."""
    rng = random.Random(9)
    out = []
    for g in range(4):
        words = prose(rng, 150).split(" ")
        for k in range(9):
            w = list(words)
            for p in rng.sample(range(len(w)), k * (g + 1) // 2):
                w[p] = f"Edit{k}"
            out.append((1000 + g * 20 + k, " ".join(w), "aa", "s1"))
    return out


def test_word_hashes_match_split():
    data = "Ab  cd\n efé".encode() + b"" + b"gh ab"
    offsets = np.array([0, len("Ab  cd\n efé".encode()), len("Ab  cd\n efé".encode()), len(data)])
    h, s, e, n = word_hashes(np.frombuffer(data, np.uint8), offsets)
    assert n.tolist() == [3, 0, 2]
    assert [data[a:b] for a, b in zip(s, e)] == [b"Ab", b"cd", "efé".encode(), b"gh", b"ab"]
    assert len(set(h.tolist())) == 5
    assert window_hashes(h[:1], 2, 3).size == 0


def test_cover_meets_every_shift():
    cover = set(substring_dedup.COVER)
    for d in range(substring_dedup.PERIOD):
        assert any(x in cover and (x + d) % substring_dedup.PERIOD in cover for x in range(substring_dedup.PERIOD))


@pytest.mark.parametrize("parts,entries", [(1, 500_000), (5, 200)])
def test_substring_dedup(spark, monkeypatch, parts, entries):
    monkeypatch.setattr(substring_dedup, "BUCKET_ENTRIES", entries)
    rows = texts(2)
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(parts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_words(plain(rows))
    assert any(r["n_removed"] for r in got)


def test_mark_rows_follow_the_repeats_and_not_the_buckets():
    passage = prose(random.Random(4), 200)
    blocks = [pa.RecordBatch.from_pylist([{"key": 10 * b + k, "text": f"{prose(random.Random(10 * b + k), 50)} {passage}"} for k in range(10)]) for b in range(2)]
    made = []
    for n in (1, 50):
        rows = pa.Table.from_batches([substring_dedup._anchor_rows(n)(b) for b in blocks])
        parts = [substring_dedup._repeated_anchors(rows.filter(pc.equal(rows.column("bucket"), k))) for k in range(n)]
        made.append(sorted((r["key"], r["mark"] or 0, r["marks"] or b"") for t in parts for r in t.to_pylist()))
    assert made[0] == made[1] and len(made[0]) > 20


@pytest.mark.parametrize("parts,bucket,shard,hot", [(1, 8 << 20, 1 << 20, 4000), (5, 4000, 3000, 1)])
def test_suffix_dedup(spark, monkeypatch, parts, bucket, shard, hot):
    for name, v in (("BUCKET_BYTES", bucket), ("SHARD_BYTES", shard), ("HOT_RUNS", hot)):
        monkeypatch.setattr(suffix_dedup, name, v)
    rows = texts(3)
    got = suffix_dedup.remove_repeated_strings(frame(spark, rows).repartition(parts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_bytes(plain(rows))


def test_no_key_holds_many_runs(spark, monkeypatch):
    rng = random.Random(22)
    short, long_ = prose(rng, 90)[:380], prose(rng, 200)
    rows = [(i, prose(rng, 120) + (short if i % 2 else long_) + prose(rng, 120)) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 5)
    real = suffix_dedup._repeats

    def limited(shard_bytes, width):
        inner = real(shard_bytes, width)

        def bucket(t):
            values = b"".join(v for v in t.column("value").to_pylist() if v is not None)
            most = np.unique(np.frombuffer(values, np.uint64), return_counts=True)[1]
            assert most.max(initial=0) <= 5, "one key holds many runs"
            return inner(t)

        return bucket

    monkeypatch.setattr(suffix_dedup, "_repeats", limited)
    for parts in (1, 5):
        got = suffix_dedup.remove_repeated_strings(frame(spark, rows).repartition(parts)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_bytes(rows)


@pytest.mark.parametrize("parts,hot", [(1, 4000), (3, 4)])
def test_suffix_dedup_of_other_widths(spark, monkeypatch, parts, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    rows = texts(9)
    got = suffix_dedup.remove_repeated_strings(frame(spark, rows).repartition(parts), width=suffix_dedup.Width(200, 75, 50)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_bytes(plain(rows), 200)


def test_pipeline_stage_leaves_no_passage_of_fifty_words(spark):
    """The stage on the given documents: no 50-word window in two documents."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["near_copies"](spark, docs, "")

    def shared(frame_):
        where = {}
        for r in frame_.select("doc_id", "text").collect():
            words = (r["text"] or "").encode().split()
            for k in range(len(words) - 49):
                where.setdefault(tuple(words[k:k + 50]), set()).add(r["doc_id"])
        return sum(len(v) > 1 for v in where.values())

    assert shared(docs) > 0
    out = stages["repeated_strings"](spark, docs, "")
    assert shared(out) == 0
    assert out.count() > 0.95 * docs.count() and set(out.columns) == set(docs.columns)


def test_repeats_beyond_four_mebibytes(spark):
    rng = np.random.default_rng(21)
    tail, other = (rng.integers(97, 123, 900).astype(np.uint8).tobytes().decode() for _ in range(2))
    rows = [(1, rng.integers(97, 123, 5_000_000).astype(np.uint8).tobytes().decode() + tail), (2, "x" + tail + other), (3, other + "y"),
            (4, rng.integers(97, 123, 3_000_000).astype(np.uint8).tobytes().decode())]
    got = suffix_dedup.remove_repeated_strings(frame(spark, rows).repartition(1)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got} == {1: (900, 1), 2: (1800, 1), 3: (900, 1), 4: (0, 0)}
    h = rng.integers(0, 2**63, (1 << 22) + 5000, dtype=np.uint64)
    place = suffix_dedup.sliding_least(h, 251)
    assert len(place) == len(h) - 250
    assert all(place[k] == k + h[k:k + 251].argmin() for k in range((1 << 22) - 600, len(place)))


def test_merged_transforms_group_equal_prefixes():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(97, 99, 700).astype(np.uint8) for _ in range(4)]
    pieces += [pieces[0].copy(), np.concatenate([pieces[1][100:], pieces[2][:300]]), np.full(900, 120, np.uint8)]
    lengths = np.array([len(p) for p in pieces])
    data = np.concatenate(pieces)
    cls = suffix_dedup.interval_classes(data, lengths, shard_bytes=1000)
    firsts = np.cumsum(lengths) - lengths
    places = [a + k for a, n in zip(firsts, lengths) for k in range(n - 399)]
    by_class, by_bytes = {}, {}
    for p in places:
        by_class.setdefault(int(cls[p]), set()).add(p)
        by_bytes.setdefault(data[p:p + 400].tobytes(), set()).add(p)
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, by_bytes.values()))


def test_a_bucket_is_indexed_in_parts_of_bounded_memory():
    rng = np.random.default_rng(6)
    w, pieces = suffix_dedup.WIDTH, []
    for v in range(1, 12_001):
        piece = rng.integers(97, 123, int(rng.integers(400, 650))).astype(np.uint8)
        pieces.append((v, piece.tobytes()))
        if v % 3 == 0:
            piece[450:] = 65
            pieces.append((v, piece.tobytes()))
    run = np.array([len(p) - w.match + 1 for _, p in pieces], np.int32)
    row = {"bucket": 0, "value": np.array([v for v, _ in pieces], np.uint64).tobytes(), "key": np.arange(len(pieces)).tobytes(),
           "start": np.zeros(len(pieces), np.int32).tobytes(), "run": np.stack([run, np.arange(len(pieces), dtype=np.int32)]).tobytes(),
           "bytes": b"".join(p for _, p in pieces)}
    t = pa.Table.from_pylist([row], schema=substring_dedup._arrow_schema(suffix_dedup.SEGMENT_ROWS))
    tracemalloc.start()
    got = suffix_dedup._repeats(suffix_dedup.SHARD_BYTES, w)(t).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(row["bytes"])
    want = {}
    for k in range(1, len(pieces)):
        if pieces[k][0] == pieces[k - 1][0]:
            n = min(len(pieces[k][1]) - 399, 51)
            want[k] = want[k - 1] = [0, n]
    assert {r["key"]: np.frombuffer(r["ranges"], np.int32).tolist() for r in got} == want


def test_ranks_tell_values_of_equal_leading_bits_apart():
    values = np.array([5, 3, 5, 2**63 + 1, 2**63, 3, 4, 2**63 + 1], np.uint64)
    assert suffix_dedup.dense_ranks(values).tolist() == [3, 1, 3, 5, 4, 1, 2, 5]


@pytest.mark.parametrize("parts,entries,first,tries", [(1, 500_000, 4, 2), (4, 100, 1, 0)])
def test_jaccard_join(spark, monkeypatch, parts, entries, first, tries):
    for name, v in (("BUCKET_ENTRIES", entries), ("FIRST_PARTNERS", first), ("TRY", 4 if tries else 10**6)):
        monkeypatch.setattr(jaccard_join, name, v)
    rows = texts(5) + near_groups()
    got = jaccard_join.jaccard_components(frame(spark, rows).repartition(parts)).collect()
    want = brute_components(plain(rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_sets_travel_about_once_for_all_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEET_BYTES", 4000)
    names = [10 * c + k for c in range(20) for k in range(8)]
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 10}x{i}" for i in range(40 + k % 10))) for k in names], "key bigint, text string").repartition(3)
    sizes = spark.createDataFrame([(k, 37 + k % 10) for k in names], "key bigint, n bigint")
    pairs = [(a, b) for a in names for b in names if a < b and a // 10 == b // 10]
    links = spark.createDataFrame(pairs, "x bigint, y bigint")
    sends = jaccard_join.dealt_pairs(links, sizes).collect()
    assert len({r["bucket"] for r in sends}) > 5
    assert len(sends) < 1.5 * len(names) < 0.5 * len(pairs)
    got = jaccard_join.count_overlaps(links, docs, sizes).collect()
    assert sorted(tuple(r) for r in got) == sorted((x, y, 37 + x % 10, 37 + y % 10, 37 + min(x % 10, y % 10)) for x, y in pairs)
    # a set with many partners: its pairs are dealt out, MEET_PAIRS at a time
    hub = spark.createDataFrame([(1, 2 + k) for k in range(2000)], "x bigint, y bigint")
    most = jaccard_join.dealt_pairs(hub, spark.range(2100).selectExpr("id AS key", "100000 AS n")).collect()
    assert max(len(r["partners"]) for r in most) < 4 * jaccard_join.MEET_PAIRS
    assert sorted(y for r in most for y in r["partners"]) == list(range(2, 2002))


def test_near_keys_keep_all_named_rows(spark):
    rows = spark.range(20_000).selectExpr("id * 7919 - 50000 AS key", "'t' AS text")
    wanted = rows.where("key % 50 = 0").select("key")
    got = {r["key"] for r in jaccard_join.near_keys(rows, wanted).collect()}
    want = {r["key"] for r in wanted.collect()}
    assert want <= got and len(got) < 1.1 * len(want)


def test_list_pairs_lose_nothing():
    rng = np.random.default_rng(1)
    n = rng.integers(20, 60, 400)
    pos = (rng.random(400) * n * 0.3).astype(np.int64)
    comp, none = np.arange(400) // 2, np.full(400, -1)
    comp[:60] = 0
    full = np.full((400, jaccard_join.CLASSES), 255, np.uint8)
    i, j, more = jaccard_join.list_pairs(n, pos, comp, none, np.zeros(400, np.int64), full)
    assert not len(more)
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if comp[a] != comp[b]
            and jaccard_join.may_link(n[a], pos[a], n[b], pos[b])}
    assert got == want
    i, j, more = jaccard_join.list_pairs(n, pos, comp, none, np.zeros(400, np.int64), full, 2)
    first = {(a, b) for a, b in zip(i.tolist(), j.tolist())}
    assert {tuple(sorted(p)) for p in first} <= want and np.bincount(i).max() == 2
    # what is not named belongs to a set that says so
    assert all(a in more or b in more for a, b in want - {tuple(sorted(p)) for p in first})


def test_signatures_never_say_too_little():
    rng = np.random.default_rng(7)
    for size in (1, 5, 90, 700, 6000, 50_000):
        pool = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
        a, b = (rng.choice(pool, size, replace=False) for _ in range(2))
        x, y = (jaccard_join.signature_counts(np.frombuffer(jaccard_join.signature(s), np.uint8)[None]) for s in (a, b))
        overlap = len(np.intersect1d(a, b))
        assert overlap <= jaccard_join.signature_bound(x, y)[0] <= size + 15 * jaccard_join.CLASSES
        assert len(jaccard_join.signature(a)) == jaccard_join.CLASSES // 2 + 1
        if size in (90, 700):  # unlinked sets are told apart
            assert not jaccard_join.linked(jaccard_join.signature_bound(x, y)[0], len(a), len(b))


def test_awkward_rows_and_empty_tables(spark):
    rows = texts(6, 6) + AWKWARD
    docs = frame(spark, rows)
    n = len(rows)
    for out in (substring_dedup.remove_repeats(docs), suffix_dedup.remove_repeated_strings(docs), jaccard_join.jaccard_components(docs)):
        assert out.count() == n
    copies = frame(spark, [(1, "x y z " * 100, "aa", "s")] * 2 + [(2, "q", "aa", "s")])
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeated_strings(copies).select("doc_id", "n_removed").collect())
    assert got == [(1, 600), (1, 600), (2, 0)]
    assert {r["component_id"] for r in jaccard_join.jaccard_components(copies).collect()} == {1, 2}
    empty = docs.limit(0)
    for out in (substring_dedup.remove_repeats(empty), suffix_dedup.remove_repeated_strings(empty), jaccard_join.jaccard_components(empty)):
        assert out.count() == 0
