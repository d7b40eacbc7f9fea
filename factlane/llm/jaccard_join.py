"""N-gram Jaccard self-join with set-relation skipping (operator 6).

A document's set is its distinct word 4-shingles (64-bit hashes of lower-cased
words). Two documents link when 100 * |intersection| >= 85 * |union|, that is
37 * overlap >= 17 * (size + size). The job finds the connected components:

1. Documents with equal sets are one class (hash of the whole set).
2. Shingles are ordered by how often their hash cell occurs, rare first. Two
   linked sets share ``SHARED`` shingles (all but a few of a small set) within
   their prefixes of size - ceil(0.85 * size) + ``SHARED`` shingles, so only
   prefixes are indexed: a list per shingle, of (set, size, position).
3. Set relations: each list has one representative; a set is tried against the
   one it shares most lists with, and their overlap is counted exactly. That
   links most of a group of near copies in one step.
4. Lists are joined block by block. A block is skipped when its positions leave
   too few shingles for the bound. A pair is skipped when its sets are already
   connected, or when their computed overlaps with a common representative r
   bound its own: overlap(x, y) <= overlap(r, y) + |x| - overlap(r, x), or when
   their counts by ``CLASSES`` hash classes do: a few shingles of a class are told
   apart only by their number, so the bound is close to the overlap. The remaining
   pairs are counted exactly. That is done twice: first each set names only the
   ``FIRST_PARTNERS`` of a list that may share most with it, which joins nearly all of
   a group of near copies by a few pairs a set; then the sets that had more to name
   are gone through again, with all pairs still in different components.

No pair is lost: prefixes, sizes, positions and the bound of step 4 are exact
conditions. Index entries travel as packed arrays by bucket (entries of all
lists, about ``BUCKET_ENTRIES`` a bucket).

Defined results: null text and text without words have an empty set and link
with nothing (the component is the document itself); a text of fewer than four
words has its whole sequence as one shingle; equal rows are one document;
null ids come last and never are a component's id unless alone (null).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_texts, text_buffers
from .hashing import R_WORD, mix, window_hashes, with_row_key, word_hashes
from .substring_dedup import _arrow_schema, _joined, _packed

SHINGLE = 4
PERCENT = 85
SHARED = 16
#: Common lists from which a representative is tried.
TRY = 4
TRIES = 2
FIRST_PARTNERS = 4
CELL_BITS = 18
BUCKET_ENTRIES = 500_000
KEY_BITS = 25
MEET_PAIRS = 64
MEET_BYTES = 4 << 20
BLOCK = 128
CLASSES = 256
NIBBLE = 15  # largest count of a class, in steps of 2**shift shingles
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, _, _, lengths = word_hashes(LOWER[data], offsets)
    every = window_hashes(h, size, R_WORD)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= size:
            out.append(np.unique(every[at:at + n - size + 1]))
        elif n:
            # shorter sequences: never equal to a full shingle but by chance
            out.append(mix(window_hashes(h[at:at + n], n, R_WORD) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def linked(overlap, a, b):
    """100 * overlap >= PERCENT * (a + b - overlap), in whole numbers."""
    return (100 + PERCENT) * overlap >= PERCENT * (a + b)


def must_share(n):
    """Shingles that a set's prefix shares with that of any linked set."""
    return np.minimum(SHARED, (PERCENT * n + 99) // 100)


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + must_share(n)


FACT_ROWS = "key bigint, n bigint, seq binary, cells binary"
SLICE_ROWS = "slice int, cells binary"
N_SLICES = 64


def _fact_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """A row per document, and one of the block's shingle counts by cell."""
    data, offsets = text_buffers(b.column("text"))
    sets = shingle_sets(data, offsets)
    rows = [{"key": k, "n": len(s), "seq": hashlib.blake2b(s.tobytes(), digest_size=16).digest()} for k, s in zip(b.column("key").to_pylist(), sets)]
    held = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cells = np.bincount((held >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    # only the order of cells matters, so a full count may stay full
    rows.append({"cells": np.minimum(cells, 255).astype(np.uint8).tobytes()})
    return pa.RecordBatch.from_pylist(rows, schema=_arrow_schema(FACT_ROWS))


def _task_cells(batches):
    """Sums of a task's blocks, in slices of fixed size."""
    total = np.zeros(1 << CELL_BITS, np.int64)
    for b in batches:
        for c in b.column("cells").to_pylist():
            total += np.frombuffer(c, np.uint8)
    rows = [{"slice": k, "cells": np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()} for k, part in enumerate(np.split(total, N_SLICES))]
    yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema(SLICE_ROWS))


def _slice_cells(t: pa.Table) -> pa.Table:
    total = np.zeros((1 << CELL_BITS) // N_SLICES, np.int64)
    for c in t.column("cells").to_pylist():
        total += np.frombuffer(c, np.int32)
    row = {"slice": t.column("slice")[0].as_py(), "cells": np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()}
    return pa.Table.from_pylist([row], schema=_arrow_schema(SLICE_ROWS))


ENTRY_ROWS = "bucket int, tok binary, key binary, n binary, pos binary"


def _entry_rows(n_buckets: int, cells: np.ndarray):
    schema = _arrow_schema(ENTRY_ROWS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(b.column("text"))
        keys = b.column("key").to_pylist()
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for key, s in zip(keys, shingle_sets(data, offsets)):
            n = len(s)
            if not n:
                continue
            p = int(prefix_length(np.int64(n)))
            order = np.argsort(cells[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")[:p]
            cols[0].append(s[order])
            cols[1].append(np.full(p, key, np.int64))
            cols[2].append(np.full(p, n, np.int32))
            cols[3].append(np.arange(p, dtype=np.int32))
        if not cols[0]:
            return pa.RecordBatch.from_pylist([], schema=schema)
        tok, key, n, pos = (np.concatenate(c) for c in cols)
        rows = _packed((tok % np.uint64(n_buckets)).astype(np.int64), [tok, key, n, pos], ["tok", "key", "n", "pos"])
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    return batch


def may_link(nx, px, ny, py):
    """Bound at a common shingle of two sets: those before it and from it on."""
    return linked(np.minimum(px, py) + np.minimum(nx - px, ny - py), nx, ny)


LIST_ROWS = "tok bigint, key bigint, n int, pos int, rep bigint, rep2 bigint"


def _lists(t: pa.Table) -> pa.Table:
    """One bucket: entries of all lists of two sets or more; ``rep`` and
    ``rep2`` are the list's representatives (least hash of the key, by two
    hashes) where they may link with the entry."""
    tok, key = _joined(t.column("tok"), np.uint64), _joined(t.column("key"), np.int64)
    n, pos = _joined(t.column("n"), np.int32), _joined(t.column("pos"), np.int32)
    order = np.lexsort((mix(key.astype(np.uint64)), tok))
    tok, key, n, pos = tok[order], key[order], n[order], pos[order]
    first = np.ones(len(tok), bool)
    first[1:] = tok[1:] != tok[:-1]
    run = np.cumsum(first) - 1
    many = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)

    def against(lead: np.ndarray) -> pa.Array:
        fits = (lead != np.arange(len(tok))) & may_link(*(v.astype(np.int64) for v in (n, pos, n[lead], pos[lead])))
        return pa.array(key[lead][many], mask=~fits[many])

    starts = np.flatnonzero(first)
    second = np.lexsort((mix(~key.astype(np.uint64)), tok))[starts] if len(tok) else starts
    return pa.Table.from_arrays(
        [pa.array(tok[many].view(np.int64)), pa.array(key[many]), pa.array(n[many]), pa.array(pos[many]),
         against(starts[run]), against(second[run])], schema=_arrow_schema(LIST_ROWS))


def signature(shingles: np.ndarray) -> bytes:
    """Counts by hash class in four bits each, behind the shift of their steps
    (rounded up, so that they never say too little)."""
    count = np.bincount((shingles % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
    shift = 0
    while int(count.max()) > NIBBLE << shift:
        shift += 1
    steps = (-(-count // (1 << shift))).astype(np.uint8)
    return bytes([shift]) + (steps[::2] << 4 | steps[1::2]).tobytes()


def signature_counts(raw: np.ndarray) -> np.ndarray:
    """Rows of packed signatures -> counts by class."""
    pairs = raw[:, 1:]
    out = np.empty((len(raw), CLASSES), np.int32)
    out[:, ::2], out[:, 1::2] = pairs >> 4, pairs & 15
    return out << raw[:, :1].astype(np.int32)


def signature_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles two sets can share, from their counts by hash class."""
    return np.minimum(a, b).sum(1, dtype=np.int64)


def list_pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, rep: np.ndarray, rep_overlap: np.ndarray,
               sig: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of one list that must be counted, and the entries i that have
    more: with ``most`` only so many are named for each i, those of the highest
    bounds. The list's largest
    component needs no pairs inside, so the other entries probe the whole list.
    Entries are cut into blocks by position; a block pair is skipped as a whole
    when even its best sizes and positions cannot reach the bound."""
    order = np.lexsort((n, pos))
    n, pos, comp, rep, ov = (v[order].astype(np.int64) for v in (n, pos, comp, rep, rep_overlap))
    sig = sig[order]
    coarse = sig.reshape(len(sig), CLASSES // 8, 8).sum(2)  # most pairs end here
    left = n - pos
    names, size = np.unique(comp, return_counts=True)
    probing = comp != names[size.argmax()]
    probes = np.flatnonzero(probing)
    out_i, out_j, cut = [], [], []
    for a in range(0, len(probes), BLOCK):
        i = probes[a:a + BLOCK]
        block = [np.zeros((3, 0), np.int64)]
        for b in range(0, len(n), BLOCK):
            j = np.arange(b, min(b + BLOCK, len(n)))
            if not linked(min(pos[i].max(), pos[j].max()) + min(left[i].max(), left[j].max()), n[i].min(), n[j].min()):
                continue
            x, y = n[i][:, None], n[j][None, :]
            ok = may_link(x, pos[i][:, None], y, pos[j][None, :]) & (comp[i][:, None] != comp[j][None, :])
            ok &= ~probing[j][None, :] | (i[:, None] < j[None, :])
            same = (rep[i][:, None] == rep[j][None, :]) & (rep[i][:, None] >= 0)
            ox, oy = ov[i][:, None], ov[j][None, :]
            ok &= ~same | linked(np.minimum(oy + x - ox, ox + y - oy), x, y)
            p, q = np.nonzero(ok)
            p, q = i[p], j[q]
            good = linked(signature_bound(coarse[p], coarse[q]), n[p], n[q])
            p, q = p[good], q[good]
            bound = signature_bound(sig[p], sig[q])
            good = linked(bound, n[p], n[q])
            block.append(np.stack([p[good], q[good], bound[good]]))
        p, q, bound = np.concatenate(block, 1)
        if most and len(p):
            ranked = np.lexsort((q, -bound, p))
            p, q = p[ranked], q[ranked]
            start = np.maximum.accumulate(np.where(np.append(True, p[1:] != p[:-1]), np.arange(len(p)), 0))
            kept = np.arange(len(p)) - start < most
            cut.append(order[np.unique(p[~kept])])
            p, q = p[kept], q[kept]
        out_i.append(order[p])
        out_j.append(order[q])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *c]) for c in (out_i, out_j, cut))


PAIR_ROWS = "x bigint, y bigint, nx bigint, ny bigint, lists bigint"


def _first_pairs(t: pa.Table) -> pa.Table:
    """One bucket of lists -> the pairs to be counted first."""
    return _pairs(t, FIRST_PARTNERS)


def _cross_pairs(t: pa.Table) -> pa.Table:
    """One bucket of lists -> all pairs to be counted."""
    return _pairs(t, 0)


def _pairs(t: pa.Table, most: int) -> pa.Table:
    """Pairs of sets in different components, with the number of lists they share
    here."""
    c = {k: t.column(k).to_numpy() for k in ("tok", "key", "n", "pos", "comp", "rep", "rep_overlap")}
    order = np.argsort(c["tok"], kind="stable")
    c = {k: v[order] for k, v in c.items()}
    sig = _joined(t.column("sig"), np.uint8).reshape(-1, CLASSES // 2 + 1)[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(c["tok"])) + 1, [len(order)]])
    low, high = np.minimum.reduceat(c["comp"], edges[:-1]), np.maximum.reduceat(c["comp"], edges[:-1])
    found: list[list[np.ndarray]] = [[], [], [], []]
    more = [np.zeros(0, np.int64)]
    for k in np.flatnonzero(low != high).tolist():
        part = slice(edges[k], edges[k + 1])
        key, n = c["key"][part], c["n"][part]
        i, j, cut = list_pairs(*(c[m][part] for m in ("n", "pos", "comp", "rep", "rep_overlap")), signature_counts(sig[part]), most)
        more.append(key[cut])
        swap = key[i] > key[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for out, v in zip(found, (key[i], key[j], n[i], n[j])):
            out.append(v.astype(np.int64))
    rows = np.stack([np.concatenate(v) if v else np.zeros(0, np.int64) for v in found])
    rows, lists = np.unique(rows, axis=1, return_counts=True)
    pairs = pa.Table.from_arrays([pa.array(r) for r in (*rows, lists.astype(np.int64))], schema=_arrow_schema(PAIR_ROWS))
    # a row without partner: the set has pairs that are not named here
    more = np.unique(np.concatenate(more))
    left = pa.Table.from_arrays([pa.array(more), *[pa.nulls(len(more), pa.int64())] * 4], schema=pairs.schema)
    return pa.concat_tables([pairs, left])


def _signature_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_buffers(b.column("text"))
    return pa.RecordBatch.from_arrays([b.column("key"), pa.array([signature(s) for s in shingle_sets(data, offsets)], pa.binary())], ["key", "sig"])


def near_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys``: a bitmap of
    fixed size (at most 2**KEY_BITS bits) reaches the rows where they are, so
    that a join by key need not move the other texts."""
    place = f"pmod(xxhash64(key), {1 << KEY_BITS}L)"
    words = keys.select(F.expr(place).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    found = rows.withColumn("bit", F.expr(place)).join(F.broadcast(words), F.expr("bit div 64 = word"))
    return found.where("(shiftright(bits, cast(bit % 64 AS int)) & 1) = 1").select(*rows.columns)


SET_ROWS = "bucket int, key bigint, s binary, partners array<bigint>"
OVERLAP_ROWS = "x bigint, y bigint, nx bigint, ny bigint, overlap bigint"


def _set_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_buffers(b.column("text"))
    sets = pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())
    return pa.RecordBatch.from_arrays([b.column("bucket"), b.column("key"), sets, b.column("partners")], ["bucket", "key", "s", "partners"])


def _overlaps(t: pa.Table) -> pa.Table:
    """One bucket: overlap of each set with its partners."""
    keys = t.column("key").to_pylist()
    sets = {k: np.frombuffer(s, np.uint64) for k, s in zip(keys, t.column("s").to_pylist())}
    found = [(x, y, len(sets[x]), len(sets[y]), len(np.intersect1d(sets[x], sets[y], assume_unique=True)))
             for x, partners in zip(keys, t.column("partners").to_pylist()) for y in partners]
    rows = np.array(found, np.int64).reshape(-1, 5)
    return pa.Table.from_arrays([pa.array(rows[:, k]) for k in range(5)], schema=_arrow_schema(OVERLAP_ROWS))


def dealt_pairs(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bucket, key, partners): where the set of ``key`` is needed, and against
    which sets it is counted there. Pairs around one set (the neighbour or the
    set itself that is in most pairs) meet, ``MEET_PAIRS`` at a time, so that a
    set travels about once and not once a pair."""
    pairs = cut_lineage(pairs.select("x", "y").distinct(), "jac-pairs")
    both = pairs.select(F.col("x").alias("key"), F.col("y").alias("other")).union(pairs.select(F.col("y").alias("key"), F.col("x").alias("other")))
    degree = both.groupBy("key").agg(F.count("*").alias("d"))
    lead = both.join(degree.withColumnRenamed("key", "other"), "other").select("key", F.struct("d", (-F.col("other")).alias("k")).alias("r")).union(
        degree.select("key", F.struct("d", (-F.col("key")).alias("k")).alias("r"))).groupBy("key").agg((-F.max("r")["k"]).alias("lead"))
    led = cut_lineage(pairs.join(lead.withColumnRenamed("key", "x"), "x"), "jac-led")
    parts = led.groupBy("lead").agg(F.ceil(F.count("*") / MEET_PAIRS).alias("parts"))
    met = led.join(parts, "lead").select("x", "y", F.xxhash64("lead", F.expr("pmod(xxhash64(x, y), parts)")).alias("meet"))
    sends = met.select("meet", F.col("x").alias("key"), F.col("y").alias("partner")).union(
        met.select("meet", F.col("y").alias("key"), F.lit(None).cast("bigint").alias("partner")))
    sends = cut_lineage(sends.groupBy("meet", "key").agg(F.collect_list("partner").alias("partners")), "jac-sends")
    shingles = sends.join(sizes.select("key", "n"), "key").agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-8 * shingles // MEET_BYTES))
    return sends.groupBy(F.expr(f"cast(pmod(meet, {n_buckets}) AS int)").alias("bucket"), "key").agg(F.flatten(F.collect_list("partners")).alias("partners"))


def count_overlaps(pairs: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(x, y, nx, ny, overlap) by intersecting the two sets. Only the documents
    of ``pairs`` get their sets built; without pairs no text is read. ``sizes``
    has the size ``n`` of each key's set."""
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], OVERLAP_ROWS)
    sends = cut_lineage(dealt_pairs(pairs, sizes), "jac-dealt")
    sets = map_texts(near_keys(docs, sends).join(sends, "key").select("bucket", "key", "text", "partners"), _set_rows, SET_ROWS)
    return sets.groupBy("bucket").applyInArrow(_overlaps, OVERLAP_ROWS)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(key, comp) for the nodes of ``edges(x, y)``: ``comp`` is the smallest
    key of the node's component. Every round takes the least label among the
    neighbours and then the label of that label, until nothing changes."""
    both = cut_lineage(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}-edges")
    labels = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("comp")).withColumnRenamed("x", "key"), f"{name}-0")
    while True:
        near = both.join(labels.withColumnRenamed("key", "y"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "key"), "key").select(
            "key", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = step.select(F.col("key").alias("mid"), F.col("mid").alias("far"))
        new = cut_lineage(step.join(jump, "mid").select("key", "old", F.least("mid", "far").alias("comp")), f"{name}-n")
        if new.where(F.col("comp") != F.col("old")).isEmpty():
            return new.select("key", "comp")
        labels = new.select("key", "comp")


def component_keys(rows: DataFrame, distinct: bool) -> DataFrame:
    """(key, n, comp) for the documents ``rows(key, text)``: set size and the
    smallest key of the component."""
    unique = rows.select("key", "text") if distinct else rows.select("key", "text").dropDuplicates(["key"])

    first = cut_lineage(map_texts(unique, _fact_rows, FACT_ROWS), "jac-facts")
    # a fixed size, whatever the input: summed inside the tasks, then by slice
    sums = first.where("key IS NULL").select("cells").mapInArrow(_task_cells, SLICE_ROWS).groupBy("slice").applyInArrow(_slice_cells, SLICE_ROWS)
    got = {r["slice"]: r["cells"] for r in sums.collect()}
    cells = np.concatenate([np.frombuffer(got[k], np.int32) for k in range(N_SLICES)]) if got else np.zeros(1 << CELL_BITS, np.int32)
    facts = first.where("key IS NOT NULL").select("key", "n", "seq")
    leaders = facts.groupBy("seq").agg(F.min("key").alias("leader"))
    facts = cut_lineage(facts.join(leaders, "seq").select(
        "key", "n", F.when(F.col("n") > 0, F.col("leader")).otherwise(F.col("key")).alias("leader")), "jac-classes")
    total = facts.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, int(-(-total * (100 - PERCENT) // (100 * BUCKET_ENTRIES))))

    copies = facts.where(F.col("key") != F.col("leader")).select("key")
    entries = map_texts(unique, _entry_rows(n_buckets, cells), ENTRY_ROWS)
    lists = entries.groupBy("bucket").applyInArrow(_lists, LIST_ROWS)
    # copies are represented by their leader: their entries go (by narrow key)
    lists = cut_lineage(lists.join(copies, "key", "left_anti"), "jac-lists")

    reps = lists.select("key", F.explode(F.array_distinct(F.array("rep", "rep2"))).alias("rep"), F.lit(1).alias("w"))
    stars = reps.where(F.col("rep").isNotNull()).groupBy("key", "rep").agg(F.sum("w").alias("lists"))
    stars = stars.where(F.col("lists") >= TRY).join(facts.select(F.col("key").alias("rep"), "leader"), "rep")
    # a set tries the representatives that it shares most lists with
    best = F.slice(F.sort_array(F.collect_set(F.struct(-F.col("lists"), "leader"))), 1, TRIES)
    stars = cut_lineage(stars.where(F.col("leader") != F.col("key")).groupBy(F.col("key").alias("x")).agg(
        best.alias("b")).select("x", F.explode("b.leader").alias("y")).distinct(), "jac-stars")
    # every document of a pair is in as many lists as a pair must share: the
    # texts of all others are left behind here, once
    able = lists.groupBy("key").agg(F.count("*").alias("lists"), F.first("n").alias("n")).where(
        F.col("lists") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100))).select("key")
    able = cut_lineage(able.union(stars.select("x")).union(stars.select("y")).distinct(), "jac-able")
    held = cut_lineage(near_keys(unique, able).join(able, "key"), "jac-held")
    tried = cut_lineage(count_overlaps(stars, held, facts), "jac-tried")
    good = linked(F.col("overlap"), F.col("nx"), F.col("ny"))
    links = tried.where(good).select("x", "y")
    comp = components(links, "jac-star")

    related = tried.groupBy(F.col("x").alias("key")).agg(F.max(F.struct("overlap", "y")).alias("r")).select(
        "key", F.col("r.y").alias("rep"), F.col("r.overlap").alias("rep_overlap"))
    rows, sigs = lists.select("tok", "key", "n", "pos"), None
    for pairs_of in (_first_pairs, _cross_pairs):
        # lists inside one component are done; of the rest only sets remain that
        # are in as many open lists as a pair must share
        known = cut_lineage(rows.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "jac-known")
        open_lists = known.groupBy("tok").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a != z").select("tok")
        known = cut_lineage(known.join(open_lists, "tok", "left_semi"), "jac-open")
        rows = known.select("tok", "key", "n", "pos")
        if sigs is None:
            enough = known.groupBy("key").agg(F.count("*").alias("lists"), F.first("n").alias("n")).where(
                F.col("lists") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100))).select("key")
            enough = cut_lineage(enough, "jac-enough")
            sigs = cut_lineage(map_texts(near_keys(held, enough).join(enough, "key"), _signature_rows, "key bigint, sig binary").join(
                related, "key", "left"), "jac-signatures")
        known = known.join(sigs, "key").select(
            F.pmod("tok", F.lit(n_buckets)).cast("int").alias("bucket"), "tok", "key", "n", "pos", "comp", "sig",
            F.coalesce("rep", F.lit(-1)).alias("rep"), F.coalesce("rep_overlap", F.lit(0)).alias("rep_overlap"))
        cross = known.groupBy("bucket").applyInArrow(pairs_of, PAIR_ROWS).groupBy("x", "y").agg(
            F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("lists").alias("lists"))
        if pairs_of is _cross_pairs:  # every shared list names a pair now
            cross = cross.where(F.col("lists") >= F.least(F.lit(SHARED), F.ceil(F.least("nx", "ny") * PERCENT / 100)))
        cross = cut_lineage(cross.select("x", "y"), "jac-cross")
        more = cross.where("y IS NULL").select(F.col("x").alias("key"))
        cross = cross.where("y IS NOT NULL")
        late = cut_lineage(count_overlaps(cross, held, facts).where(good).select("x", "y"), "jac-late")
        links = links.union(late)
        if pairs_of is _first_pairs:
            # only lists of sets with unnamed pairs are gone through again
            comp = components(links, "jac-first")
            rows = rows.join(rows.join(more, "key", "left_semi").select("tok").distinct(), "tok", "left_semi")
    copy_links = facts.where(F.col("key") != F.col("leader")).select(F.col("key").alias("x"), F.col("leader").alias("y"))
    comp = components(links.union(copy_links), "jac-all")
    return facts.select("key", "n").join(comp, "key", "left").select("key", "n", F.coalesce("comp", "key").alias("comp"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows, distinct = with_row_key(docs)
    found = component_keys(rows, distinct)
    out = rows.select("key", "doc_id").join(found, "key")
    if distinct:
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").cast(docs.schema["doc_id"].dataType).alias("component_id"))
    ids = rows.select(F.col("key").alias("comp"), F.col("doc_id").alias("component_id")).distinct()
    return out.join(ids, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_per_component(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, keep...): of each component only the document of the
    smallest id."""
    rows, distinct = with_row_key(docs, keep)
    found = component_keys(rows, distinct)
    out = rows.join(found.where(F.col("key") != F.col("comp")).select("key"), "key", "left_anti")
    out = out if distinct else out.dropDuplicates(["key"])
    return out.select("doc_id", "text", *keep)
