"""Ranked lexical search by presence masks (operator 11).

Every item ranks all documents by an integer BM25 score and keeps the ``TOP``
best. Only terms of the items matter, so one pass over the texts turns each block
of documents into postings of those terms and counts document frequencies. The
search then runs block by block:

1. postings of an item's terms set one bit each in the documents' masks (a lane of
   64 terms is one word of the bitmap);
2. documents with the same mask are one group; the sum of its terms' largest
   contributions in the block bounds all scores of the group;
3. groups are scored in descending order of that bound, and the item is finished
   in the block when the bound falls below the score that its ``TOP``-th best
   document is known to reach.

A share of the blocks is searched first: the ``TOP``-th best document of the share
is a bound that holds everywhere, so the rows that the blocks emit do not grow
with the corpus (about ``TOP`` * ``SEED_SHARE`` per item). Nothing is left out: a
document is passed over only when ``TOP`` documents that rank before it are known.

Distinct item texts are searched once. They are sent to the tasks in shards of
``SHARD_BYTES`` of text; further shards are further passes over the documents.

Defined results: a null or empty text, or one without a term, has no terms and is
in no result; an item without terms has no rows. Every row of ``items`` is an
item of its own: rows with equal text get equal rankings under their own ids, and
ids may repeat or be null. Equal scores rank by ascending doc_id (null last);
repeated documents each take a rank. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, join_small
from .common import map_texts, word_chunks

TOP = 50
SHARD_BYTES = 4 << 20  # item text searched in one pass over the documents
SEED_SHARE = 32  # one block in so many is searched first
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 8192

#: Separators are ASCII characters other than letters and digits.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


# --- step 1: postings of the items' terms --------------------------------------------

BLOCKS = "block bigint, ids binary, known binary, n binary, ptr binary, term binary, tf binary, docs bigint, words bigint, df array<bigint>"


def _postings(vocabulary: dict[bytes, int]):
    """Per block of documents: lengths, and for each document the numbers of the
    items' terms with their occurrences; document frequencies of the block."""
    size = len(vocabulary)
    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "n", "ptr", "term", "tf")),
                        ("docs", pa.int64()), ("words", pa.int64()), ("df", pa.list_(pa.int64()))])

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        get = vocabulary.get
        lengths, parts = [], []
        for t in b.column("text").to_pylist():
            length, found = 0, []
            for words in word_chunks((t or "").encode().translate(TABLE)):
                length += len(words)
                found.append(np.array([k for k in map(get, words) if k is not None], np.int64))
            lengths.append(length)
            parts.append(np.unique(np.concatenate(found), return_counts=True))
        n = np.array(lengths, np.int64)
        term = np.concatenate([p[0] for p in parts]).astype(np.int32)
        tf = np.concatenate([p[1] for p in parts]).astype(np.int64)
        ptr = np.zeros(len(n) + 1, np.int64)
        np.cumsum([len(p[0]) for p in parts], out=ptr[1:])
        known = np.asarray(b.column("doc_id").is_valid())
        ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        df = np.bincount(term, minlength=size)
        first = int(ids[0]) if len(ids) else 0
        row = {"block": first, "ids": ids.tobytes(), "known": known.tobytes(), "n": n.tobytes(), "ptr": ptr.tobytes(), "term": term.tobytes(),
               "tf": tf.tobytes(), "docs": int((n > 0).sum()), "words": int(n.sum()), "df": df.tolist()}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def batch(b: pa.RecordBatch):
        for a in range(0, b.num_rows, BLOCK_DOCS):
            yield block(b.slice(a, BLOCK_DOCS))

    return batch


# --- step 2: search of one block ------------------------------------------------------

class Block:
    """Postings of a block by term, with every posting's contribution."""

    def __init__(self, row: dict, weight: np.ndarray, n_docs: int, n_words: int):
        self.ids, n = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["n"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        ptr, term, tf = np.frombuffer(row["ptr"], np.int64), np.frombuffer(row["term"], np.int32), np.frombuffer(row["tf"], np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.int64), np.diff(ptr))
        # m = 50 + (50 n N) div L; Python's integers where the product may pass 64 bits
        if len(n) and int(n.max()) * 50 * n_docs >= 1 << 63:
            m = np.array([50 + 50 * int(x) * n_docs // n_words for x in n.tolist()], np.int64)
        else:
            m = 50 + (50 * n * n_docs) // max(n_words, 1)
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))
        # what of the order of documents beyond the score: ascending id, null last
        self.place = np.lexsort((self.ids, ~self.known))
        self.rank = np.empty(len(n), np.int64)
        self.rank[self.place] = np.arange(len(n))

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents in order of their mask, first of each group, bound of each
        group) of the documents that hold any of the terms."""
        most = np.array([self.gain[self.start[t]:self.start[t + 1]].max() for t in terms.tolist()], np.int64)
        lanes = -(-len(terms) // 64)
        bits = np.zeros((lanes, len(self.ids)), np.uint64)
        bound = np.zeros(len(self.ids), np.int64)
        for k, (t, top) in enumerate(zip(terms.tolist(), most.tolist())):
            docs = self.doc[self.start[t]:self.start[t + 1]]
            bits[k // 64, docs] |= np.uint64(1 << (k % 64))
            bound[docs] += top
        hit = np.flatnonzero(bits.any(axis=0))
        order = hit[np.lexsort(bits[:, hit])]
        sorted_bits = bits[:, order]
        first = np.ones(len(order), bool)
        first[1:] = (sorted_bits[:, 1:] != sorted_bits[:, :-1]).any(axis=0)
        at = np.flatnonzero(first)
        return order, at, bound[order[at]]

    def search(self, terms: np.ndarray, top: int, known: tuple[int, int | None] | None) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the ``top`` best of the block that rank before or
        at ``known``, the (score, id) of some ``top``-th best document."""
        none = np.zeros(0, np.int64)
        terms = terms[self.start[terms] < self.start[terms + 1]]
        if not len(terms):
            return none, none
        order, at, bound = self.masks(terms)
        ends = np.append(at[1:], len(order))
        by_bound = np.argsort(-bound, kind="stable")
        need = known[0] if known else 1
        docs, scores, done, take = none, none, 0, 4 * top
        while done < len(by_bound):
            live = by_bound[done:]
            if bound[live[0]] < need:
                break  # safely finished: no mask left can reach what is known
            held = np.cumsum(ends[live] - at[live])
            n = int(np.searchsorted(held, take)) + 1
            chosen = live[:n]
            chosen = chosen[bound[chosen] >= need]
            done += n
            size = ends[chosen] - at[chosen]
            member = order[np.repeat(at[chosen], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
            wanted = np.zeros(len(self.ids), bool)
            wanted[member] = True
            score = np.zeros(len(self.ids), np.int64)
            for t in terms.tolist():
                d, g = self.doc[self.start[t]:self.start[t + 1]], self.gain[self.start[t]:self.start[t + 1]]
                w = wanted[d]
                score[d[w]] += g[w]
            got = score[member]
            docs, scores = np.concatenate([docs, member[got >= need]]), np.concatenate([scores, got[got >= need]])
            best = np.lexsort((self.rank[docs], -scores))[:top]
            docs, scores = docs[best], scores[best]
            if len(docs) == top:
                need = max(need, int(scores[-1]))
            take *= 2
        if known:
            score, last = known
            later = np.zeros(len(docs), bool) if last is None else ~self.known[docs] | (self.ids[docs] > last)
            keep = (scores > score) | ((scores == score) & ~later)
            docs, scores = docs[keep], scores[keep]
        return docs, scores


FOUND = "th string, doc_id bigint, score bigint"


def _search(items: dict[str, np.ndarray], weight: np.ndarray, n_docs: int, n_words: int, top: int, known: dict):
    schema = pa.schema([("th", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, weight, n_docs, n_words)
                out = []
                for th, terms in items.items():
                    docs, scores = block.search(terms, top, known.get(th))
                    if len(docs):
                        ids = pa.array(block.ids[docs], mask=~block.known[docs])
                        out.append(pa.RecordBatch.from_arrays([pa.array([th] * len(docs)), ids, pa.array(scores)], schema=schema))
                yield from out

    return run


# --- the operator ----------------------------------------------------------------------

def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("th").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_shard(texts: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """(th, rank, doc_id, score) for the item texts of one shard (bounded)."""
    rows = texts.collect()
    vocabulary: dict[bytes, int] = {}
    items = {r["th"]: np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(r["text"])}), np.int64) for r in rows}
    blocks = cut_lineage(map_texts(docs, _postings(vocabulary), BLOCKS, limit=BLOCK_BYTES), "search-blocks")
    lot = F.pmod(F.xxhash64("block", F.octet_length("term")), F.lit(1 << 30))
    total = blocks.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.min(lot).alias("least")).first()
    n_docs, n_words = total["docs"] or 0, total["words"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in blocks.select(F.posexplode("df").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]  # one row per term of the shard
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def found(part: DataFrame, known: dict) -> DataFrame:
        return part.drop("df", "docs", "words").mapInArrow(_search(items, weight, n_docs, n_words, top, known), FOUND)

    # any top documents bound what can still enter; one block in SEED_SHARE gives good ones
    seed = blocks.where((lot % SEED_SHARE == 0) | (lot == F.lit(total["least"])))
    known = {r["th"]: (r["score"], r["doc_id"]) for r in _ranked(found(seed, {}), top).where(F.col("rank") == top).collect()}
    return _ranked(found(blocks, known), top).select("th", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = cut_lineage(items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
                        .withColumn("th", F.sha2("text", 256)), "search-items")
    texts = named.select("th", "text").dropDuplicates(["th"])
    shards = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes)
    found = None
    for k in range(shards):
        part = texts.where(F.pmod(F.xxhash64("th"), F.lit(shards)) == k) if shards > 1 else texts
        one = _search_shard(part, docs, top)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return named.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).where("false")
    # few rows: at most ``top`` an item text; rows of equal text each take them
    found = cut_lineage(found, "search-found")
    return join_small(named.select("item_id", "th"), found.groupBy("th").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("hits")),
                      ["th"]).select("item_id", F.inline("hits"))


#: DuckDB twin of ``rank_documents`` over ``documents`` and ``benchmark``.
SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
it AS (SELECT i, item_id, unnest(w) AS term FROM i),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nd, sum(len(w))::BIGINT AS l FROM d),
p AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT * FROM p WHERE term IN (SELECT term FROM it)),
t AS (SELECT term, floor(1000 * ln((2 * s.nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt FROM q, s GROUP BY term, s.nd),
g AS (SELECT k, doc_id, term, wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * s.nd) // s.l))) AS c FROM q JOIN t USING (term), s),
r AS (SELECT i, item_id, k, doc_id, sum(c)::BIGINT AS score FROM it JOIN g USING (term) GROUP BY i, item_id, k, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
WHERE rank <= 50
"""
