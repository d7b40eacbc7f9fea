"""Suffix-array dedup by merging shard Burrows-Wheeler transforms (operator 4).

Every byte covered by a ``match``-byte string that starts at two places or more
(in any document, or twice in one) is removed (``Width``; 400 bytes by default). The suffixes that can match are
brought together by content, indexed in shards, and the shards' transforms are
merged:

1. Each window of ``match`` bytes has a minimizer, the least hash of its
   ``gram``-byte strings (leftmost on ties). Equal windows have equal
   minimizers, so runs of window starts with one minimizer are counted by it;
   only minimizers seen in two runs of different contents (or twice in one
   document) go on.
2. Those runs travel with their bytes to the minimizer's bucket, equal
   contents once per block. There each shard of at most ``SHARD_BYTES``
   gets the suffix array and the Burrows-Wheeler transform of its segments.
   The alphabet is blocks of ``step`` bytes (a segment is one string for each
   remainder of its positions), so four symbols are ``match`` bytes.
3. Transforms are merged without sorting suffixes again: starting from
   "first shard, then second shard, ...", each round deals the interleave stably
   by the transforms' symbols and thereby sorts it by one symbol more; after
   ``match / step`` rounds it is sorted by ``match`` bytes, and the places where
   neighbours first differed give the common prefixes. All shards of a part are
   merged at once, so every entry is dealt ``match / step`` times, however many
   shards there are; a bucket is worked off in parts of whole minimizers of
   about ``PART_BYTES``, which bounds a task's memory. Intervals that share all
   symbols and hold two starts or more are repeats.

Documents with equal texts are known by a hash of the whole text: they are
removed as a whole (when long enough), and one of them stands for all in steps
1 to 3. Runs of a minimizer that is very frequent are cut finer by further
minimizers (``_subkeys``). Runs are then counted by the finer key; where more
than ``HOT_RUNS`` still share one, each window is dealt by a hash of all its
bytes instead (128 bits), once per block, and windows that meet are repeats. So
a passage shared by many documents does not fill one bucket, however long it is.

Defined results: null text is empty; equal rows (id and text) are repeats of
each other; a text shorter than ``match`` keeps all its bytes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_texts, text_buffers
from .hashing import BYTE_TABLE, R_BYTE, R_WORD, mix, powers, running, with_row_key
from .substring_dedup import _arrow_schema, _first_of, _grouped_bytes, _joined, _packed



class Width(NamedTuple):
    """Bytes of a string that must not repeat, of the grams its minimizer is
    taken from, and of a symbol of the transforms (a whole part of ``match``)."""
    match: int
    gram: int
    step: int

    @property
    def span(self) -> int:
        """Grams in a window."""
        return self.match - self.gram + 1


WIDTH = Width(400, 150, 100)
BUCKET_BYTES = 8 << 20
PART_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
BATCH = 2 << 20
HOT_RUNS = 4_000  # runs of one minimizer beyond which it is cut finer
EXTRA = 3
PLACE = np.uint64((1 << 22) - 1)


# --- minimizers --------------------------------------------------------------------

def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = running(BYTE_TABLE[data], R_BYTE)
    return mix((p[size:] - p[:-size]) * powers(R_BYTE, n, inverse=True))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in every window of ``width`` values: leftmost
    among values whose leading 42 bits tie. Block prefixes and suffixes give
    each window in two steps. Places have 22 bits, so longer arrays go in
    pieces that overlap by ``width - 1``; a window's place does not depend on
    its piece."""
    n = len(h) - width + 1
    most = int(PLACE) + 1 - (width - 1)
    return np.concatenate([np.zeros(0, np.int64), *(
        _piece_least(h[a:a + most + width - 1], width) + a for a in range(0, n, most))])


def _piece_least(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
    padded[:len(h)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & PLACE).astype(np.int64)


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, w: Width = WIDTH) -> tuple[np.ndarray, ...]:
    """(minimizer, text, first start, number of starts) of all runs."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    lengths = np.diff(offsets)
    n_starts = np.maximum(lengths - w.match + 1, 0)
    if not n_starts.any():
        return none
    h = gram_hashes(data, w.gram)
    place = sliding_least(h, w.span)
    text = np.repeat(np.arange(len(lengths)), n_starts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    at = place[offsets[:-1][text] + within]
    edge = np.ones(len(text), bool)
    edge[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(edge)
    return h[at[first]], text[first], within[first], np.diff(np.append(first, len(text)))


RUN_ROWS = "bucket int, doc bigint, seq binary, n_bytes bigint, sha string, marks binary, hash binary, content binary, again binary"
FACT_ROWS = "key bigint, content bigint, seq binary, n_bytes bigint, sha string, marks binary, hot binary"


def _run_rows(n_buckets: int, w: Width):
    schema = _arrow_schema(RUN_ROWS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(b.column("text"))
        keys = b.column("key").to_pylist()
        raw = data.tobytes()
        texts = [raw[offsets[k]:offsets[k + 1]] for k in range(b.num_rows)]
        seqs = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        content = np.array([int.from_bytes(s[:8], "little", signed=True) for s in seqs], np.int64)
        value, text, _, _ = minimizer_runs(data, offsets, w)
        owner = content[text]
        # runs of one content: copies in the block count once, but a value that
        # a text holds twice stays twice
        order = np.lexsort((text, owner, value))
        value, owner, text = value[order], owner[order], text[order]
        twice = np.zeros(len(value), bool)
        twice[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1]) & (text[1:] == text[:-1])
        rows = [{"bucket": k % n_buckets, "doc": k, "seq": s, "n_bytes": len(t), "sha": hashlib.sha256(t).hexdigest()}
                for k, s, t in zip(keys, seqs, texts)]
        same = np.zeros(len(value), bool)
        same[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        lead = np.flatnonzero(~same)
        again = np.logical_or.reduceat(twice, lead) if len(lead) else np.zeros(0, bool)
        value, owner = value[lead], owner[lead]
        rows += _packed((value % np.uint64(n_buckets)).astype(np.int64), [value, owner, again], ["hash", "content", "again"])
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    return batch


def _repeated_runs(hot_runs: int):
    def bucket(t: pa.Table) -> pa.Table:
        """One bucket: document rows pass; minimizers of two contents, or twice in
        one, become marks of the contents (frequent ones are told apart)."""
        out = _arrow_schema(FACT_ROWS)
        docs = t.filter(pc.is_valid(t.column("doc")))
        seqs = docs.column("seq").to_pylist()
        content = [int.from_bytes(s[:8], "little", signed=True) for s in seqs]
        n = docs.num_rows
        facts = pa.Table.from_arrays([docs.column("doc"), pa.array(content, pa.int64()), docs.column("seq"), docs.column("n_bytes"), docs.column("sha"),
                                      pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=out)
        value, owner = _joined(t.column("hash"), np.uint64), _joined(t.column("content"), np.int64)
        again = _joined(t.column("again"), bool)
        order = np.lexsort((owner, value))
        value, owner, again = value[order], owner[order], again[order]
        same = np.zeros(len(value), bool)
        same[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        lead = np.flatnonzero(~same)
        again = np.logical_or.reduceat(again, lead) if len(lead) else again
        value, owner = value[lead], owner[lead]
        _, first = _first_of(value)
        run = np.cumsum(first) - 1
        count = np.bincount(run)[run] if len(run) else np.zeros(0, np.int64)
        many = (count > 1) | again
        hot = _grouped_bytes(owner[count > hot_runs], value[count > hot_runs])
        marks = _grouped_bytes(owner[many], value[many])
        return pa.concat_tables([facts, pa.Table.from_pylist(
            [{"content": k, "marks": v, "hot": hot.get(k)} for k, v in marks.items()], schema=out)])

    return bucket


# --- segments ----------------------------------------------------------------------

SEGMENT_ROWS = ("bucket int, value binary, key binary, start binary, run binary, bytes binary, "
                "doc bigint, ranges binary, h1 binary, h2 binary, wkey binary, wstart binary")
ENTRY_BYTES = 28  # of a window: two hashes, key and start


def _subkeys(data: np.ndarray, offsets: np.ndarray, hot: list[np.ndarray], runs: tuple[np.ndarray, ...], w: Width) -> tuple[np.ndarray, ...]:
    """Runs of frequent minimizers, cut where one of ``EXTRA`` further
    minimizers (by other hashes of the same grams) changes; the key then joins
    all of them. Equal windows keep equal keys."""
    value, text, start, n = runs
    is_hot = np.zeros(len(value), bool)
    for k, h in enumerate(hot):
        if len(h):
            mine = text == k
            is_hot[mine] = np.isin(value[mine], h)
    if not is_hot.any():
        return runs
    grams = gram_hashes(data, w.gram)
    out = [[v[~is_hot]] for v in (value, text, start, n)]
    for v, t, s, m in zip(value[is_hot], text[is_hot].tolist(), start[is_hot].tolist(), n[is_hot].tolist()):
        a = offsets[t] + s
        part = grams[a:a + m + w.span - 1]
        at = np.stack([sliding_least(mix(part + np.uint64(e + 1)), w.span) for e in range(EXTRA)])
        edges = np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(0)))
        key = np.full(len(edges), v, np.uint64)
        for row in at:
            key = mix(key * np.uint64(31) + part[row[edges]])
        for o, new in zip(out, (key, np.full(len(edges), t), s + edges, np.diff(np.append(edges, m)))):
            o.append(new)
    return tuple(np.concatenate(o) for o in out)


def _held_runs(b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, w: Width) -> tuple[np.ndarray, ...]:
    """Runs of the batch's marked minimizers, frequent ones cut finer."""
    value, text, start, run = minimizer_runs(data, offsets, w)
    edges = np.searchsorted(text, np.arange(b.num_rows + 1))
    held = np.zeros(len(value), bool)

    def values(parts):
        return np.concatenate([np.frombuffer(p, np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)

    for k, parts in enumerate(b.column("marks").to_pylist()):
        held[edges[k]:edges[k + 1]] = np.isin(value[edges[k]:edges[k + 1]], values(parts))
    hot = [values(parts) for parts in b.column("hot").to_pylist()]
    return _subkeys(data, offsets, hot, (value[held], text[held], start[held], run[held]), w)


CANDIDATES = "key bigint, text string, is_hot boolean, value binary, start binary, run binary"


def _candidate_rows(w: Width):
    """Texts with their marked runs, hashed and cut once; later steps read them."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        value, text, start, run = _held_runs(b, *text_buffers(b.column("text")), w)
        order = np.argsort(text, kind="stable")
        edges = np.searchsorted(text[order], np.arange(b.num_rows + 1)).tolist()
        packed = [[c[order[x:z]].astype(k).tobytes() for x, z in zip(edges, edges[1:])] for c, k in ((value, np.uint64), (start, np.int32), (run, np.int32))]
        is_hot = [any(h is not None for h in hot or ()) for hot in b.column("hot").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), pa.array(is_hot), *(pa.array(p, pa.binary()) for p in packed)],
                                          ["key", "text", "is_hot", "value", "start", "run"])

    return batch


def _stored_runs(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(value, text, start, number of starts) of a batch of candidates."""
    value = b.column("value").to_pylist()
    text = np.repeat(np.arange(b.num_rows), [len(v) // 8 for v in value])
    start, run = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("start", "run"))
    return np.frombuffer(b"".join(value), np.uint64), text, start, run


def _count_rows(batches):
    """(value, runs, starts) of the runs by their finer keys."""
    for b in batches:
        value = np.frombuffer(b"".join(b.column("value").to_pylist()), np.uint64)
        run = np.frombuffer(b"".join(b.column("run").to_pylist()), np.int32)
        distinct, at = np.unique(value, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.bincount(at, minlength=len(distinct)).astype(np.int64)),
                                          pa.array(np.bincount(at, run, len(distinct)).astype(np.int64))], ["value", "runs", "starts"])


def _window_entries(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, runs: tuple[np.ndarray, ...], n_buckets: int, n_windows: int, w: Width) -> list[dict]:
    """Rows of all windows of the runs, by hash: starts that repeat inside the
    block are known at once, and one entry of each hash goes on."""
    _, text, start, run = runs
    text = np.repeat(text, run)
    start = np.repeat(start, run) + np.arange(len(text)) - np.repeat(np.cumsum(run) - run, run)
    at = offsets[:-1][text] + start
    h1, h2 = (np.zeros(len(at), np.uint64) for _ in range(2))
    for r, out in ((R_BYTE, h1), (R_WORD, h2)):
        p = running(BYTE_TABLE[data], r)
        out[:] = mix((p[at + w.match] - p[at]) * powers(r, len(data), inverse=True)[at])
    order = np.lexsort((h2, h1))
    h1, h2, key, start = h1[order], h2[order], keys[text[order]], start[order]
    first = np.ones(len(h1), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    times = np.bincount(np.cumsum(first) - 1)
    again = times[np.cumsum(first) - 1] > 1
    rows = [{"bucket": int(k % n_buckets), "doc": k, "ranges": v} for k, v in _ranges(key[again], start[again]).items()]
    # start -1: repeats already, its starts are known
    sent = np.where(again, -1, start)[first].astype(np.int32)
    h1, h2, key = h1[first], h2[first], key[first]
    entries = _packed((h1 % np.uint64(n_windows)).astype(np.int64), [h1, h2, key, sent], ["h1", "h2", "wkey", "wstart"])
    return rows + [{**r, "bucket": n_buckets + r["bucket"]} for r in entries]


def _met_windows(t: pa.Table) -> dict[int, bytes]:
    """Starts of windows that occur in several blocks, or known to repeat."""
    h1, h2 = _joined(t.column("h1"), np.uint64), _joined(t.column("h2"), np.uint64)
    key, start = _joined(t.column("wkey"), np.int64), _joined(t.column("wstart"), np.int32).astype(np.int64)
    order = np.lexsort((h2, h1))
    h1, h2, key, start = h1[order], h2[order], key[order], start[order]
    first = np.ones(len(h1), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    run = np.cumsum(first) - 1
    met = (np.bincount(run)[run] > 1) & (start >= 0) if len(run) else np.zeros(0, bool)
    return _ranges(key[met], start[met])


def _segment_rows(n_buckets: int, hot_keys: np.ndarray, n_windows: int, w: Width):
    schema = _arrow_schema(SEGMENT_ROWS)

    def batch(b: pa.RecordBatch):
        data, offsets = text_buffers(b.column("text"))
        keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        value, text, start, run = found = _stored_runs(b)
        hot = np.isin(value, hot_keys)
        windows = _window_entries(data, offsets, keys, tuple(c[hot] for c in found), n_buckets, n_windows, w) if hot.any() else []
        value, text, start, run = (c[~hot] for c in found)
        bucket = (value % np.uint64(n_buckets)).astype(np.int64)
        order, first = _first_of(bucket)
        cuts = np.append(np.flatnonzero(first), len(order)).tolist()
        raw = data.tobytes()
        rows = []
        for a, z in zip(cuts, cuts[1:]):
            part = order[a:z]
            k = int(bucket[part[0]])
            begin = offsets[text[part]] + start[part]
            pieces = [raw[a:a + n + w.match - 1] for a, n in zip(begin.tolist(), run[part].tolist())]
            # equal segments of the block travel once; the others name the first
            seen: dict[tuple, int] = {}
            ref = np.array([seen.setdefault((v, p), len(seen)) for v, p in zip(value[part].tolist(), pieces)], np.int32)
            rows.append({"bucket": k, "value": value[part].tobytes(), "key": keys[text[part]].tobytes(),
                         "start": start[part].astype(np.int32).tobytes(), "run": np.stack([run[part].astype(np.int32), ref]).tobytes(),
                         "bytes": b"".join(p for _, p in seen)})
        return pa.RecordBatch.from_pylist(rows + windows, schema=schema)

    return batch


# --- transforms --------------------------------------------------------------------

def block_symbols(data: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Symbol of the block that starts at each place, cut at its segment's end
    (``ends`` per place); never 0, which is the end symbol."""
    p = running(BYTE_TABLE[data], R_BYTE)
    at = np.arange(len(data))
    to = np.minimum(at + step, ends)
    h = (p[to] - p[at]) * powers(R_BYTE, len(data), inverse=True)
    return mix(h + (to - at).astype(np.uint64)) | np.uint64(1)


def dense_ranks(values: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct ones, from 1. The leading bits are
    sorted with the place behind them; values that these do not tell apart are
    put in order by all their bits."""
    n = len(values)
    below = np.uint64((1 << n.bit_length()) - 1)
    packed = (values & ~below) | np.arange(n, dtype=np.uint64)
    packed.sort()
    at = (packed & below).astype(np.int64)
    new = np.ones(n, bool)
    ordered = values[at]
    new[1:] = ordered[1:] != ordered[:-1]
    close = np.zeros(n, bool)
    close[1:] = (packed[1:] ^ packed[:-1]) <= below
    if (new & close).any():
        group = np.cumsum(~close) - 1
        mixed = np.bincount(group, new & close)[group] > 0
        some = at[mixed]
        at[mixed] = some[np.lexsort((some, values[some]))]
        ordered = values[at]
        new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(n, np.int32)
    out[at] = np.cumsum(new)
    return out


def stable_order(keys: list[np.ndarray], top: int) -> np.ndarray:
    """Order by ``keys`` (of at most ``top``, first one first), equal ones by
    place. As many keys as fit are sorted in one number, with the place behind."""
    n = len(keys[0])
    below, bits = n.bit_length(), max(1, int(top).bit_length())
    each = max(1, (64 - below) // bits)
    order = None
    for z in range(len(keys), 0, -each):
        packed = np.zeros(n, np.uint64)
        for k in keys[max(0, z - each):z]:
            packed = packed << np.uint64(bits) | (k if order is None else k[order]).astype(np.uint64)
        packed = packed << np.uint64(below) | np.arange(n, dtype=np.uint64)
        packed.sort()
        at = (packed & np.uint64((1 << below) - 1)).astype(np.int64)
        order = at if order is None else order[at]
    return order


class Shard:
    """Suffix array and Burrows-Wheeler transform of a set of segments, over
    the alphabet of ``step``-byte blocks (``symbol``: their ranks by place, 0 is
    the end symbol). Suffix ids below ``n`` are places, the others are the ends
    of the strings."""

    def __init__(self, symbol: np.ndarray, lengths: np.ndarray, step: int, match: int):
        n = len(symbol)
        firsts = np.cumsum(lengths) - lengths
        seg = np.repeat(np.arange(len(lengths)), lengths)
        ends = (firsts + lengths)[seg]
        strings = np.minimum(lengths, step)  # one string per remainder
        n_ends = int(strings.sum())
        # the shard's own symbols, so that more of them fit into a number
        held = np.zeros(int(symbol.max()) + 1 if n else 1, bool)
        held[symbol] = True
        own = np.cumsum(held, dtype=np.int32)[symbol]
        keys = []
        at = np.arange(n)
        for k in range(match // step):
            there = at + k * step
            live = there < ends
            key = np.zeros(n + n_ends, np.int32)
            key[:n][live] = own[there[live]]
            keys.append(key)
        self.order = stable_order(keys, int(own.max()) if n else 0)
        # symbol before each suffix: the end symbol before a string's first
        before = np.zeros(n + n_ends, np.int32)
        inner = at - firsts[seg] >= step
        before[:n][inner] = symbol[at[inner] - step]
        owner = np.repeat(np.arange(len(lengths)), strings)
        phase = np.arange(n_ends) - np.repeat(np.cumsum(strings) - strings, strings)
        last = firsts[owner] + phase + ((lengths[owner] - 1 - phase) // step) * step
        before[n:] = symbol[last]
        self.transform = before[self.order]
        self.n = n


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, classes): the shard of each entry of the merged order, and
    the class of entries whose first ``rounds`` symbols agree. Each round deals
    the interleave stably by the symbols before its suffixes."""
    symbols = np.concatenate(transforms)
    top = int(symbols.max()) if len(symbols) else 0
    z = np.repeat(np.arange(len(transforms), dtype=np.min_scalar_type(len(transforms))), [len(t) for t in transforms])
    cls = np.zeros(len(z), np.int32)
    for _ in range(rounds):
        s = np.empty(len(z), np.int32)
        s[np.argsort(z, kind="stable")] = symbols
        order = stable_order([s], top)
        s, cls, z = s[order], cls[order], z[order]
        new = np.zeros(len(z), bool)
        new[1:] = (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])
        cls = np.cumsum(new, dtype=np.int32)
    return z, cls


def interval_classes(data: np.ndarray, lengths: np.ndarray, shard_bytes: int = SHARD_BYTES, w: Width = WIDTH) -> np.ndarray:
    """Class of the ``match``-byte prefix of each place, from merged shards."""
    cut = np.cumsum(lengths) // shard_bytes
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(lengths)]
    firsts = np.append(0, np.cumsum(lengths))
    symbol = dense_ranks(block_symbols(data, np.repeat(firsts[1:], lengths), w.step))
    transforms, ids = [], []
    for a, z in zip(edges, edges[1:]):
        shard = Shard(symbol[firsts[a]:firsts[z]], lengths[a:z], w.step, w.match)
        transforms.append(shard.transform)
        ids.append(np.where(shard.order < shard.n, shard.order + firsts[a], -1))
    del symbol
    side, cls = merge_transforms(transforms, w.match // w.step)
    cls = cls[np.argsort(side, kind="stable")]  # by shard again, as the ids
    ids = np.concatenate(ids)
    out = np.empty(len(data), np.int64)
    real = ids >= 0
    out[ids[real]] = cls[real]
    return out


def key_parts(value: np.ndarray, lengths: np.ndarray, part_bytes: int) -> list[tuple[int, int]]:
    """Cuts of sorted keys into parts of whole keys, each of less than
    ``part_bytes`` plus one key's segments."""
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    at = (np.cumsum(lengths) - lengths)[first] // part_bytes
    starts = np.flatnonzero(first)[np.append(True, at[1:] != at[:-1])]
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(value)]))


def repeated_starts(pieces: list[bytes], times: np.ndarray, shard_bytes: int, w: Width) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start within it) of all windows that occur twice or more;
    ``times`` says how often each segment occurs."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    firsts = np.cumsum(lengths) - lengths
    cls = interval_classes(np.frombuffer(b"".join(pieces), np.uint8), lengths, shard_bytes, w)
    n_starts = lengths - w.match + 1
    owner = np.repeat(np.arange(len(lengths)), n_starts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    c = cls[firsts[owner] + within]
    often = np.bincount(c, times[owner])[c] > 1
    return owner[often], within[often]


def _ranges(key: np.ndarray, start: np.ndarray) -> dict[int, bytes]:
    """key -> (first, end) int32 pairs of its runs of consecutive starts."""
    if not len(key):
        return {}
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(key)) - 1
    pairs = np.stack([start[a], start[z] + 1], 1).astype(np.int32)
    edges = np.flatnonzero(np.diff(key[a])) + 1
    return {int(k[0]): p.tobytes() for k, p in zip(np.split(key[a], edges), np.split(pairs, edges)) if len(k)}


def _repeats(shard_bytes: int, w: Width):
    def bucket(t: pa.Table) -> pa.Table:
        """One bucket: all starts whose window occurs at least twice."""
        known = t.filter(pc.is_valid(t.column("doc")))
        known = list(zip(known.column("doc").to_pylist(), known.column("ranges").to_pylist()))
        known += _met_windows(t.filter(pc.is_valid(t.column("h1")))).items()
        known = [{"key": k, "ranges": v} for k, v in known]
        t = t.filter(pc.is_valid(t.column("value")))
        value, key, start, run, seg = [], [], [], [], []
        distinct: dict[tuple, int] = {}
        for v, k, s, r, raw in zip(*(t.column(c).to_pylist() for c in ("value", "key", "start", "run", "bytes"))):
            v, k, s = np.frombuffer(v, np.uint64), np.frombuffer(k, np.int64), np.frombuffer(s, np.int32)
            r, ref = np.frombuffer(r, np.int32).reshape(2, -1)
            _, lead = np.unique(ref, return_index=True)
            ends = np.cumsum(r[lead] + w.match - 1)
            ids = np.array([distinct.setdefault((int(v[i]), raw[e - r[i] - w.match + 1:e]), len(distinct))
                            for i, e in zip(lead.tolist(), ends.tolist())])
            value.append(v), key.append(k), start.append(s), run.append(r), seg.append(ids[ref])
        schema = _arrow_schema("key bigint, ranges binary")
        if not value:
            return pa.Table.from_pylist(known, schema=schema)
        key, start, run, seg = (np.concatenate(c).astype(np.int64) for c in (key, start, run, seg))
        # equal windows have equal keys, so whole keys are worked off in parts
        pieces = list(distinct)
        value = np.array([v for v, _ in pieces], np.uint64)
        order = np.argsort(value, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        value, seg, pieces = value[order], rank[seg], [pieces[k][1] for k in order.tolist()]
        times = np.bincount(seg, minlength=len(pieces))
        owner, within = [], []
        for a, z in key_parts(value, np.array([len(p) for p in pieces], np.int64), PART_BYTES):
            o, i = repeated_starts(pieces[a:z], times[a:z], shard_bytes, w)
            owner.append(o + a), within.append(i)
        owner, within = np.concatenate(owner), np.concatenate(within)
        # starts that repeat, handed to every occurrence of the segment
        by_seg = np.searchsorted(owner, np.arange(len(pieces) + 1))
        n_hit = np.diff(by_seg)[seg]
        occ = np.repeat(np.arange(len(seg)), n_hit)
        nth = np.arange(len(occ)) - np.repeat(np.cumsum(n_hit) - n_hit, n_hit)
        starts = within[by_seg[seg[occ]] + nth] + start[occ]
        found = _ranges(key[occ], starts)
        return pa.Table.from_pylist(known + [{"key": k, "ranges": v} for k, v in found.items()], schema=schema)

    return bucket


# --- removal -----------------------------------------------------------------------

def removed_spans(parts: list[bytes], n_bytes: int, match: int = WIDTH.match) -> np.ndarray:
    """Maximal removed (first, end) spans from ranges of repeated starts."""
    pairs = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for p in parts]).astype(np.int64)
    edge = np.zeros(n_bytes + 1, np.int32)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1] - 1 + match, -1)
    gone = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    change = np.flatnonzero(gone[1:] != gone[:-1])
    return change.reshape(-1, 2)


def cut(raw: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, z in spans.tolist():
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans shrunk so that no character is cut."""
    out = []
    for a, z in spans.tolist():
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if z > a:
            out.append((a, z))
    return out


REMOVED = "key bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _removal(with_text: bool, match: int):
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, text, parts in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("ranges").to_pylist()):
            raw = (text or "").encode()
            spans = removed_spans(parts, len(raw), match)
            rows.append({"key": key, "n_removed": int((spans[:, 1] - spans[:, 0]).sum()), "n_spans": len(spans),
                         "kept_sha256": hashlib.sha256(cut(raw, spans)).hexdigest(),
                         "kept": cut(raw, np.array(whole_characters(raw, spans), np.int64).reshape(-1, 2)).decode() if with_text else None})
        return pa.RecordBatch.from_pylist(rows, schema=_arrow_schema(REMOVED))

    return batch


def remove_repeated_strings(docs: DataFrame, with_text: bool = False, keep: tuple[str, ...] = (), width: Width = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document;
    ``with_text`` adds ``text`` and ``kept``, the text without the removed
    spans (shrunk to whole characters), and the columns named by ``keep``;
    ``width`` has the length of the strings that must not repeat."""
    rows, distinct = with_row_key(docs, keep)
    unique = rows.select("key", "text") if distinct else rows.select("key", "text").dropDuplicates(["key"])
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n1 = max(1, int(-(-n_bytes // (BUCKET_BYTES * 4))))

    runs = map_texts(unique, _run_rows(n1, width), RUN_ROWS, BATCH)
    first = cut_lineage(runs.groupBy("bucket").applyInArrow(_repeated_runs(HOT_RUNS), FACT_ROWS), "suf-runs")
    facts = first.where(F.col("seq").isNotNull()).select("key", "content", "seq", "n_bytes", "sha")
    times = facts.groupBy("seq").agg(F.min("key").alias("leader"), F.count("*").alias("times"))
    facts = facts.join(times, "seq")
    if not distinct:
        facts = facts.join(rows.groupBy("key").agg(F.count("*").alias("same")), "key").withColumn(
            "times", F.col("times") + F.col("same") - 1)
    facts = cut_lineage(facts.select("key", "content", "n_bytes", "sha", (F.col("key") == F.col("leader")).alias("leads"),
                                     ((F.col("times") > 1) & (F.col("n_bytes") >= width.match)).alias("copied")), "suf-facts")

    marks = first.where(F.col("marks").isNotNull()).groupBy("content").agg(
        F.collect_list("marks").alias("marks"), F.collect_list("hot").alias("hot"))
    marks = facts.where("leads").select("key", "content").join(marks, "content").select("key", "marks", "hot")
    held = cut_lineage(map_texts(unique.join(marks, "key"), _candidate_rows(width), CANDIDATES, BATCH), "suf-candidates")
    # finer keys that many runs still share (at most runs / HOT_RUNS of them)
    counts = held.where("is_hot").select("value", "run").mapInArrow(_count_rows, "value bigint, runs bigint, starts bigint")
    still = counts.groupBy("value").agg(F.sum("runs").alias("runs"), F.sum("starts").alias("starts")).where(F.col("runs") > HOT_RUNS).collect()
    hot_keys = np.array([r["value"] for r in still], np.int64).view(np.uint64)
    n_windows = max(1, -(-sum(r["starts"] for r in still) * ENTRY_BYTES // BUCKET_BYTES))
    # runs overlap, so their bytes may be more than those of the texts
    n_runs = (held.agg(F.sum(F.octet_length("value"))).first()[0] or 0) // 8
    n2 = max(1, -(-max(n_bytes, n_runs * (width.match + width.span)) // BUCKET_BYTES))
    segments = map_texts(held, _segment_rows(n2, hot_keys, n_windows, width), SEGMENT_ROWS, BATCH)
    found = segments.groupBy("bucket").applyInArrow(_repeats(SHARD_BYTES, width), "key bigint, ranges binary")
    # fully repeated documents need no spans of their own
    found = found.join(facts.where("copied").select("key"), "key", "left_anti").groupBy("key").agg(F.collect_list("ranges").alias("ranges"))
    removed = map_texts(held.select("key", "text").join(found, "key"), _removal(with_text, width.match), REMOVED)

    out = facts.join(removed, "key", "left").select(
        "key", "n_bytes", F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copied"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if not with_text:
        return rows.select("key", "doc_id").join(out, "key").select(columns)
    return rows.join(out, "key").select(*columns, *keep, "text", F.coalesce("kept", "text").alias("kept"))
