"""Substring dedup by difference-cover anchors (operator 2).

A window is ``WINDOW`` consecutive words. ``COVER`` is a difference cover modulo
``PERIOD``: for any two positions some shift below ``PERIOD`` takes both to
positions whose remainder is in the cover. So anchors - hashes of
``WINDOW - PERIOD + 1`` words - taken only at cover positions suffice: equal
windows share an anchor at the same shift. The job

1. hashes anchors, keeping one entry per block of documents and hash, and finds
   the hashes that occur twice anywhere;
2. extends: windows around a repeated anchor are hashed whole (128 bits), again
   with one entry per block and hash, and for each hash the earliest start
   (document order, then position) is found; all other starts are repeats;
3. removes every word covered by a repeat.

Entries travel as packed arrays, one row per (block, bucket). A frequent window
sends one entry per block, not one per document, and a bucket holds about
``BUCKET_ENTRIES`` entries, so no task gathers a hot group. Documents with the
same words as an earlier one are recognised by a hash of the whole sequence:
they do not enter step 2.

Defined results: null text has no words; equal rows (id and text) are one
document and get the same result; different texts under one id, and null ids
(last), are documents of their own in order of the text's hash.
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
from .hashing import R_WORD, R_WORD2, window_hashes, with_row_key, word_hashes

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
IS_COVER = np.isin(np.arange(PERIOD), COVER)
BUCKET_ENTRIES = 500_000


def _ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def sequence_hash(h: np.ndarray) -> bytes:
    """128-bit hash of a whole word sequence."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def anchors(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of the anchors at cover positions. Anchors of a
    text are those that lie inside it; texts shorter than a window have none."""
    n = np.where(lengths >= WINDOW, lengths - ANCHOR + 1, 0)
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), n)
    pos = _ragged(n)
    keep = IS_COVER[pos % PERIOD]
    text, pos = text[keep], pos[keep]
    every = window_hashes(words, ANCHOR, R_WORD)
    return every[first[text] + pos] if len(text) else np.zeros(0, np.uint64), text, pos


def _first_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, is first): a stable sort of ``values`` and where a run begins."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    return order, first


def _packed(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> list[dict]:
    """One row per bucket that occurs, each column's values as bytes."""
    order, first = _first_of(bucket)
    cuts = np.append(np.flatnonzero(first), len(order))
    return [{"bucket": int(bucket[order[a]]), **{n: c[order[a:z]].tobytes() for n, c in zip(names, columns)}}
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _grouped_bytes(key: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    """key -> its values as bytes."""
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    edges = np.flatnonzero(np.diff(key)) + 1
    return {int(k[0]): v.tobytes() for k, v in zip(np.split(key, edges), np.split(values, edges)) if len(k)}


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All values of a packed column."""
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v is not None), kind)


# --- step 1: repeated anchors ----------------------------------------------------

ANCHOR_ROWS = "bucket int, doc bigint, seq binary, n_words bigint, sha string, marks binary, hash binary, key binary, again binary"
MARK_ROWS = "key bigint, seq binary, n_words bigint, sha string, marks binary, mark bigint"


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _anchor_rows(n_buckets: int):
    """Per block: a row for each document (its facts, and hashes known to
    repeat inside the block) and one packed row per bucket. Document rows go
    through the same exchange, dealt by their key."""
    schema = _arrow_schema(ANCHOR_ROWS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(b.column("text"))
        keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        h, s, e, lengths = word_hashes(data, offsets)
        hashes, text, _ = anchors(h, lengths)
        order, first = _first_of(hashes)
        hashes, owner = hashes[order], text[order]
        run = np.cumsum(first) - 1
        again = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
        # all entries of a hash that repeats inside the block are known here
        local = _grouped_bytes(owner[again], hashes[again])
        raw = data.tobytes()
        rows, at = [], 0
        for k, n in enumerate(lengths.tolist()):
            joined = b" ".join(raw[offsets[k]:offsets[k + 1]].split())
            rows.append({"bucket": int(keys[k] % n_buckets), "doc": int(keys[k]), "seq": sequence_hash(h[at:at + n]),
                         "n_words": n, "sha": hashlib.sha256(joined).hexdigest(), "marks": local.get(k)})
            at += n
        # first entry per hash goes on; one that repeats here is known already
        sent = first
        rows += _packed((hashes[sent] % np.uint64(n_buckets)).astype(np.int64),
                        [hashes[sent], keys[owner[sent]], again[sent]], ["hash", "key", "again"])
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    return batch


def _repeated_anchors(t: pa.Table) -> pa.Table:
    """One bucket: document rows pass; entries whose hash occurs in several
    blocks become marks of their documents. One row per mark, so the rows follow
    the repeats and not the number of buckets."""
    schema = _arrow_schema(MARK_ROWS)
    rows = t.filter(pc.is_valid(t.column("doc"))).select(["doc", "seq", "n_words", "sha", "marks"])
    rows = rows.append_column("mark", pa.nulls(rows.num_rows, pa.int64())).rename_columns(schema.names)
    h, k = _joined(t.column("hash"), np.uint64), _joined(t.column("key"), np.int64)
    order, first = _first_of(h)
    run = np.cumsum(first) - 1
    many = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
    k, h = k[order][many], h[order][many].view(np.int64)
    order = np.lexsort((h, k))
    held = {"key": pa.array(k[order]), "mark": pa.array(h[order])}
    marks = pa.Table.from_arrays([held.get(f.name, pa.nulls(len(k), f.type)) for f in schema], schema=schema)
    return pa.concat_tables([rows.cast(schema), marks])


# --- step 2: extension to whole windows -------------------------------------------

WINDOW_ROWS = "bucket int, doc bigint, starts binary, h1 binary, h2 binary, key binary, start binary"


def _window_rows(n_buckets: int):
    """Per block: starts known to repeat inside it, and packed entries."""
    schema = _arrow_schema(WINDOW_ROWS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(b.column("text"))
        keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        h, _, _, lengths = word_hashes(data, offsets)
        hashes, text, pos = anchors(h, lengths)
        edges = np.searchsorted(text, np.arange(b.num_rows + 1))
        n_win = np.maximum(lengths - WINDOW + 1, 0)
        win_first = np.cumsum(n_win) - n_win
        cover = np.zeros(int(n_win.sum()) + 1, np.int32)
        shared = b.column("mark")
        at, shared = shared.offsets.to_numpy(), shared.values.to_numpy().view(np.uint64)
        for k, parts in enumerate(b.column("marks").to_pylist()):
            marked = np.unique(np.concatenate([shared[at[k]:at[k + 1]], *(np.frombuffer(p, np.uint64) for p in parts)]))
            a, z = edges[k], edges[k + 1]
            hit = pos[a:z][np.isin(hashes[a:z], marked)]
            lo, hi = np.maximum(hit - (PERIOD - 1), 0), np.minimum(hit, n_win[k] - 1) + 1
            live = lo < hi
            np.add.at(cover, win_first[k] + lo[live], 1)
            np.add.at(cover, win_first[k] + hi[live], -1)
        wanted = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        owner = np.repeat(np.arange(b.num_rows), n_win)[wanted]
        start = wanted - win_first[owner]
        first_word = np.cumsum(lengths) - lengths
        at = first_word[owner] + start
        h1 = window_hashes(h, WINDOW, R_WORD)[at] if len(at) else np.zeros(0, np.uint64)
        h2 = window_hashes(h, WINDOW, R_WORD2)[at] if len(at) else np.zeros(0, np.uint64)
        owner = keys[owner]
        # earliest entry of each window hash in the block; the others are repeats
        order = np.lexsort((start, owner, h2, h1))
        h1, h2, owner, start = h1[order], h2[order], owner[order], start[order]
        first = np.ones(len(h1), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        rows = [{"bucket": k % n_buckets, "doc": k, "starts": v}
                for k, v in _grouped_bytes(owner[~first], start[~first].astype(np.int32)).items()]
        sent = np.flatnonzero(first)
        rows += _packed((h1[sent] % np.uint64(n_buckets)).astype(np.int64),
                        [h1[sent], h2[sent], owner[sent], start[sent].astype(np.int32)], ["h1", "h2", "key", "start"])
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    return batch


START_ROWS = "key bigint, start int"


def _later_starts(t: pa.Table) -> pa.Table:
    """One bucket: (key, start) of all entries but the earliest of each hash,
    and of the starts known from their own block. One row per start, so the
    rows follow the repeats and not the number of buckets."""
    known = t.filter(pc.is_valid(t.column("doc"))).select(["doc", "starts"])
    parts = [np.frombuffer(v, np.int32) for v in known.column("starts").to_pylist()]
    keys = np.repeat(known.column("doc").to_numpy(), [len(v) for v in parts]) if parts else np.zeros(0, np.int64)
    h1, h2 = _joined(t.column("h1"), np.uint64), _joined(t.column("h2"), np.uint64)
    key, start = _joined(t.column("key"), np.int64), _joined(t.column("start"), np.int32)
    order = np.lexsort((start, key, h2, h1))
    h1, h2, key, start = h1[order], h2[order], key[order], start[order]
    later = np.zeros(len(h1), bool)
    later[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    key, start = np.concatenate([keys.astype(np.int64), key[later]]), np.concatenate([*parts, start[later]]).astype(np.int32)
    order = np.lexsort((start, key))
    return pa.Table.from_arrays([pa.array(key[order]), pa.array(start[order])], schema=_arrow_schema(START_ROWS))


# --- step 3: removal --------------------------------------------------------------

def _removal(b: pa.RecordBatch) -> pa.RecordBatch:
    removed, shas = [], []
    for text, parts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist()):
        words = (text or "").encode().split()
        cover = np.zeros(len(words) + 1, np.int32)
        s = np.array(parts, np.int64)
        cover += np.bincount(s, minlength=len(cover)).astype(np.int32)
        cover -= np.bincount(s + WINDOW, minlength=len(cover)).astype(np.int32)
        gone = np.cumsum(cover[:-1]) > 0
        removed.append(int(gone.sum()))
        shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
    return pa.RecordBatch.from_arrays([b.column("key"), pa.array(removed, pa.int64()), pa.array(shas)], ["key", "n_removed", "kept_sha256"])


def _n_buckets(entries: float) -> int:
    return max(1, int(-(-entries // BUCKET_ENTRIES)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    rows, distinct = with_row_key(docs)
    unique = rows.select("key", "text") if distinct else rows.select("key", "text").dropDuplicates(["key"])
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_words = n_bytes / 6
    n1, n2 = _n_buckets(n_words * len(COVER) / PERIOD), _n_buckets(n_words)

    entries = map_texts(unique, _anchor_rows(n1), ANCHOR_ROWS)
    step1 = cut_lineage(entries.groupBy("bucket").applyInArrow(_repeated_anchors, MARK_ROWS), "sub-anchors")
    facts = step1.where(F.col("seq").isNotNull()).select("key", "seq", "n_words", "sha")
    leaders = facts.groupBy("seq").agg(F.min("key").alias("leader"))
    facts = cut_lineage(facts.join(leaders, "seq").select(
        "key", "n_words", "sha", ((F.col("key") > F.col("leader")) & (F.col("n_words") >= WINDOW)).alias("copy")), "sub-facts")

    marks = step1.where(F.col("marks").isNotNull() | F.col("mark").isNotNull()).groupBy("key").agg(
        F.collect_list("marks").alias("marks"), F.collect_list("mark").alias("mark"))
    marks = marks.join(facts.where("copy").select("key"), "key", "left_anti")
    held = cut_lineage(unique.join(marks, "key"), "sub-candidates")
    starts = map_texts(held, _window_rows(n2), WINDOW_ROWS).groupBy("bucket").applyInArrow(_later_starts, START_ROWS)
    starts = starts.groupBy("key").agg(F.collect_list("start").alias("starts"))
    removed = map_texts(held.select("key", "text").join(starts, "key"), _removal, "key bigint, n_removed bigint, kept_sha256 string")

    out = facts.join(removed, "key", "left").select(
        "key", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
    return rows.select("key", "doc_id").join(out, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")
