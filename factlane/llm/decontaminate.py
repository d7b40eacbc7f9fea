"""Benchmark decontamination by BM25 with block-max pruning (operator 10).

The test items are indexed: a term's postings are (item, impact), where the
impact is the term's BM25 weight in the item divided by the weight that a full
copy of the item must reach inside one passage. Items stand in blocks of
``BLOCK``; each term keeps its maximum impact overall and per block.

Every document is cut into passages of ``PASSAGE`` words, one every ``STRIDE``
words, and each passage is a query:

1. the sum of the terms' overall maxima bounds every item's score; passages
   below ``RETRIEVE`` are skipped (no pivot can exist);
2. the sum of block maxima bounds the items of a block; (passage, block) pairs
   below the threshold are skipped;
3. the remaining pairs are scored exactly over the block's postings; all items
   at or above the threshold are retrieved.

A retrieved item is verified on the words around its passage: it counts when
enough word pairs of its question part and of its answer part (its last
sentence, or the last third when there is only one) occur there.

The index holds the test items in shards of about ``SHARD_ITEMS`` items and
``SHARD_BYTES`` of text at most; a shard is sent to the tasks (its size is bounded) and further shards run as further
passes over the documents. Words are lower-cased (ASCII) runs of letters
and digits.

Items of fewer than ``MIN_WORDS`` words identify themselves only as a whole: a
document that holds their word sequence without a gap matches (score and
overlaps 1). The same pass finds them by one look-up per word of the sequence.

Defined results: items or documents with null or empty text, or without a word,
match nothing; repeated document rows each report; ids are carried as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_texts, text_buffers
from .hashing import with_row_key

PASSAGE, STRIDE = 64, 32
BLOCK = 16
K1, B = 1.2, 0.75
RETRIEVE = 0.7
OVERLAP = 0.6
MIN_WORDS = 6  # shorter items are matched as whole word sequences
SHARD_ITEMS = 20_000
SHARD_BYTES = 16 << 20  # of item text
BATCH = 2 << 20  # bytes of text whose words are held at once


#: ASCII letters are lowered; they, digits and characters beyond ASCII are words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def term_list(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question part and of the answer part."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if term_list(p.encode())]
    words = term_list(text.encode())
    if len(parts) > 1:
        answer = term_list(parts[-1].encode())
        if 2 <= len(answer) < len(words) - 1:
            return words[:-len(answer)], answer
    cut = len(words) - max(2, len(words) // 3)
    return words[:cut], words[cut:]


def pairs_of(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


class Index:
    """Block-max inverted index of one shard of test items."""

    def __init__(self, items: list[tuple], n_items: int, df: dict[bytes, int], mean_length: float):
        self.ids = [i for i, _ in items]
        parts = [split_item(t) for _, t in items]
        self.parts = [(pairs_of(q), pairs_of(a)) for q, a in parts]
        self.lengths = np.array([len(q) + len(a) for q, a in parts])
        terms: dict[bytes, int] = {}
        rows = []
        for k, (q, a) in enumerate(parts):
            words = q + a
            weight = {}
            for t, f in Counter(words).items():
                idf = math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5))
                weight[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean_length))
            full = self.copy_weight(words, weight)
            for t, w in weight.items():
                rows.append((terms.setdefault(t, len(terms)), k, w / full))
        self.terms = terms
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.impact = np.array([r[2] for r in rows], np.float64)
        self.start = np.searchsorted(term, np.arange(len(terms) + 1))
        top = np.zeros(len(terms))
        np.maximum.at(top, term, self.impact)
        self.top = top
        # block postings: (term, block) -> maximum impact
        n_blocks = len(items) // BLOCK + 1
        key, place = np.unique(term * n_blocks + self.item // BLOCK, return_inverse=True)
        self.block = key % n_blocks
        self.block_impact = np.zeros(len(key))
        np.maximum.at(self.block_impact, place, self.impact)
        self.block_start = np.searchsorted(key // n_blocks, np.arange(len(terms) + 1))
        self.n_blocks = n_blocks

    @staticmethod
    def copy_weight(words: list[bytes], weight: dict[bytes, float]) -> float:
        """The least weight that the best passage holds of a full copy, over
        all places where the copy may start."""
        n, worst = len(words), math.inf
        for start in range(STRIDE):
            best = 0.0
            for p in range(0, start + n, STRIDE):
                held = set(words[max(0, p - start):max(0, p + PASSAGE - start)])
                best = max(best, sum(weight[t] for t in held))
            worst = min(worst, best)
        return worst


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) for all positions of the ranges."""
    n = ends - starts
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def retrieve(index: Index, ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of the passage, item, score) of all items at or above the
    threshold. ``ids``: term per word (-1: not indexed); ``docs``: document of
    each word; ``lengths``: words per document."""
    first = np.cumsum(lengths) - lengths
    n_pass = np.where(lengths > 0, np.maximum(1, -(-(lengths - (PASSAGE - STRIDE)) // STRIDE)), 0)
    pass_first = np.cumsum(n_pass) - n_pass
    places = np.flatnonzero(ids >= 0)
    if not len(places):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    d = docs[places]
    at = (places - first[d]) // STRIDE
    terms = ids[places]
    # a word lies in the passages at // STRIDE and the one before
    last = np.minimum(at, n_pass[d] - 1)
    prev = at - 1
    both = (prev >= 0) & (prev != last) & (at <= n_pass[d] - 1)
    passage = np.concatenate([pass_first[d] + last, (pass_first[d] + prev)[both]])
    term = np.concatenate([terms, terms[both]])
    total = int(n_pass.sum())
    bound = np.bincount(passage, index.top[term], total)
    open_ = bound >= RETRIEVE
    keep = open_[passage]
    # a passage counts a term once
    key = np.unique(passage[keep] * len(index.terms) + term[keep])
    passage, term = key // len(index.terms), key % len(index.terms)
    row, pos = _expand(index.block_start[term], index.block_start[term + 1])
    pair, inverse = np.unique(passage[row] * index.n_blocks + index.block[pos], return_inverse=True)
    bound = np.bincount(inverse, index.block_impact[pos], len(pair))
    pair = pair[bound >= RETRIEVE]
    if not len(pair):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    held = np.isin(passage, pair // index.n_blocks)
    passage, term = passage[held], term[held]
    row, pos = _expand(index.start[term], index.start[term + 1])
    item = index.item[pos]
    inside = np.isin(passage[row] * index.n_blocks + item // BLOCK, pair)
    row, pos, item = row[inside], pos[inside], item[inside]
    n_items = len(index.ids)
    hit, inverse = np.unique(passage[row] * n_items + item, return_inverse=True)
    score = np.bincount(inverse, index.impact[pos], len(hit))
    good = score >= RETRIEVE
    hit, score = hit[good], score[good]
    passage, item = hit // n_items, hit % n_items
    doc = np.searchsorted(pass_first, passage, side="right") - 1
    return first[doc] + (passage - pass_first[doc]) * STRIDE, item, score


class Sequences:
    """Short items as a tree of word sequences, one sorted level per word."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        lists = [term_list(t.encode()) for _, t in items]
        self.terms = {w: k for k, w in enumerate(sorted({w for words in lists for w in words}))}
        node = np.zeros(len(lists), np.int64)
        self.levels = []
        for depth in range(max(map(len, lists), default=0)):
            here = np.array([k for k, words in enumerate(lists) if len(words) > depth])
            key = node[here] * len(self.terms) + np.array([self.terms[lists[k][depth]] for k in here])
            keys, node[here] = np.unique(key, return_inverse=True)
            done = np.array([k for k in here if len(lists[k]) == depth + 1], np.int64)
            done = done[np.argsort(node[done], kind="stable")]
            self.levels.append((keys, done, np.searchsorted(node[done], np.arange(len(keys) + 1))))

    def find(self, words: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) whose sequence stands in the document."""
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        node, start = np.zeros(len(at), np.int64), at
        found = [np.zeros((2, 0), np.int64)]
        for keys, done, edges in self.levels:
            inside = np.flatnonzero(at < len(ids))
            inside = inside[(ids[at[inside]] >= 0) & (docs[at[inside]] == docs[start[inside]])]
            at, node, start = at[inside], node[inside], start[inside]
            key = node * len(self.terms) + ids[at]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            held = keys[node] == key
            at, node, start = at[held] + 1, node[held], start[held]
            doc, here = np.unique(np.stack([docs[start], node]), axis=1)
            row, pos = _expand(edges[here], edges[here + 1])
            found.append(np.stack([doc[row], done[pos]]))
        return np.concatenate(found, 1)


def _scan(index: Index | None, short: Sequences, id_name: str, item_kind: pa.DataType):
    get = index.terms.get if index else None

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(b.column("text"))
        raw = data.tobytes()
        words: list[bytes] = []
        lengths = np.zeros(b.num_rows, np.int64)
        for k in range(b.num_rows):
            w = term_list(raw[offsets[k]:offsets[k + 1]])
            lengths[k] = len(w)
            words += w
        docs = np.repeat(np.arange(b.num_rows), lengths)
        starts = items = scores = np.zeros(0)
        if index:
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            starts, items, scores = retrieve(index, ids, docs, lengths)
        near_doc, near_item = short.find(words, docs) if short.ids else np.zeros((2, 0), np.int64)
        first = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], tuple] = {}
        for s, k, score in zip(starts.tolist(), items.tolist(), scores.tolist()):
            doc = int(docs[s])
            margin = int(index.lengths[k])
            a = max(int(first[doc]), s - margin)
            z = min(int(first[doc] + lengths[doc]), s + PASSAGE + margin)
            around = pairs_of(words[a:z])
            q, ans = index.parts[k]
            qo = len(q & around) / len(q) if q else 0.0
            ao = len(ans & around) / len(ans) if ans else 0.0
            if qo >= OVERLAP and ao >= OVERLAP:
                best[doc, k] = max(best.get((doc, k), (0.0, 0.0, 0.0)), (qo, ao, score))
        item_ids = {}
        for d, k in zip(near_doc.tolist(), near_item.tolist()):
            best[d, -1 - k] = (1.0, 1.0, 1.0)
            item_ids[-1 - k] = short.ids[k]
        keys = sorted(best)
        return pa.RecordBatch.from_arrays(
            [b.column(id_name).take(pa.array([d for d, _ in keys], pa.int64())),
             pa.array([item_ids[k] if k < 0 else index.ids[k] for _, k in keys], item_kind),
             *[pa.array([round(best[key][c], 6) for key in keys], pa.float64()) for c in (2, 0, 1)]],
            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return batch


def item_statistics(items: DataFrame) -> tuple[int, float, DataFrame]:
    """(number of indexed items, their mean length, (shard, word, df)): document
    frequencies over all items, listed for the words of each shard."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        count: Counter = Counter()
        for shard, text in zip(b.column("shard").to_pylist(), b.column("text").to_pylist()):
            words = term_list(text.encode())
            if len(words) >= MIN_WORDS:
                count.update((shard, w) for w in set(words))
                count[shard, None] += 1
                count[shard, b""] += len(words)
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in count], pa.int32()), pa.array([w for _, w in count], pa.binary()),
                                           pa.array(list(count.values()), pa.int64())], ["shard", "word", "n"])

    # a null word counts the items, an empty one their words
    counts = map_texts(items.select("shard", "text"), batch, "shard int, word binary, n bigint", BATCH)
    counts = cut_lineage(counts.groupBy("shard", "word").agg(F.sum("n").alias("n")), "benchmark-words")
    sums = counts.agg(F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("items"),
                      F.sum(F.when(F.octet_length("word") == 0, F.col("n"))).alias("words")).first()
    terms = counts.where(F.octet_length("word") > 0)
    df = cut_lineage(terms.select("shard", "word").join(terms.groupBy("word").agg(F.sum("n").alias("df")), "word"), "benchmark-df")
    n_items = int(sums["items"] or 0)
    return n_items, (sums["words"] or 0) / max(n_items, 1), df


ITEM_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the verified
    pairs. ``score`` is the BM25 score relative to a full copy's. Item ids are
    whole numbers or strings and may be null."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = cut_lineage(items, "benchmark")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_shards = max(1, -(-size["n"] // SHARD_ITEMS), -(-(size["bytes"] or 0) // SHARD_BYTES))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)).cast("int"))
    n_items, mean_length, df = item_statistics(items)
    # one index per shard, with the statistics of all items
    found = []
    for shard in range(n_shards):
        held = items.where(F.col("shard") == shard).select("item_id", "text").collect()
        rows = sorted(((r["item_id"], r["text"]) for r in held), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        sizes = [len(term_list(t.encode())) for _, t in rows]
        short = Sequences([row for row, n in zip(rows, sizes) if 0 < n < MIN_WORDS])
        rows = [row for row, n in zip(rows, sizes) if n >= MIN_WORDS]
        if not rows and not short.ids:
            continue
        own = {bytes(r["word"]): r["df"] for r in df.where(F.col("shard") == shard).select("word", "df").collect()}
        index = Index(rows, n_items, own, mean_length) if rows else None
        found.append(map_texts(docs.select(id_col, "text"), _scan(index, short, id_col, ITEM_KINDS[item_kind]), schema, BATCH))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no verified test item, columns unchanged. Every row
    is judged by its own text: rows may share an id or have none."""
    rows, distinct = with_row_key(docs)
    if distinct:
        leaks = find_leaks(docs, benchmark).select("doc_id").distinct()
        return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
    leaks = find_leaks(rows, benchmark, "key").select(F.col("doc_id").alias("key")).distinct()
    bad = rows.join(leaks, "key").select(F.col("doc_id").alias("__id"), F.sha2("text", 256).alias("__sha")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("__sha"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)
