"""Best-fit decreasing packing of documents into sequences (operator 13).

Every document becomes its token ids and an end id; longer ones are cut into
pieces of ``CAPACITY`` ids. Best-fit decreasing takes the pieces from the longest
to the shortest and puts each into the open sequence with the least room that
still holds it, or opens a new one.

Lengths are whole numbers up to ``CAPACITY``, so the order of pieces of one length
does not matter and the packing of the whole corpus is decided on the count of
pieces by length (at most ``CAPACITY`` rows, at any corpus size). ``plan`` runs
best-fit decreasing on it: a segment tree over remaining room finds the tightest
open sequence in logarithmic time, and equal pieces that would go the same way
into equal sequences are placed together. Its result is a short table of runs:
the pieces number a to b of one length go to sequences s, s + 1, ... at a given
offset, so many to a sequence.

On Spark: one pass makes the pieces and numbers them by length inside their task;
counts by (task, length) give each task's first number of every length; a look-up
by (length, number) in the runs gives sequence and offset. Pieces are never
gathered: the only exchange is on the counts, and on (task, length) when these are
too many to broadcast.

Defined results: a null or empty text is the end id alone; repeated rows and ids
are packed as often as they stand; null ids are carried. An empty table gives
no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ..session import cut_lineage, join_small
from .common import BATCH_BYTES, sliced, word_chunks

CAPACITY = 2048
END_ID = 0
BATCH = 4 << 20
#: Words whose ids a task keeps; beyond, it starts anew (results are the same).
MEMO_WORDS = 600_000


# --- ids of whole texts -----------------------------------------------------------

LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordIds(dict):
    """Ids of a text, white-space separated word by word: the tokenizer drops white
    space and never joins what stands on its two sides. word -> number of its
    entry, whose ids stand in ``flat``; each distinct word is encoded once."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.flat, self.place, self.count = array("I"), array("q"), array("q")
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.symbols = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, word: bytes) -> int:
        """Latin letters are one piece for the model, in lower case and composed as
        they are. A stop or comma behind such a letter is a piece of its own.
        All else goes through the whole tokenizer."""
        text = word.decode()
        if LETTERS.fullmatch(text):
            low = text.lower()
            if low != text:
                k = self[word] = self[low.encode()]
                return k
            ids = [t.id for t in self.tokenize(text if text.isascii() else text.translate(self.symbols))]
        elif text[-1] in ".," and LETTERS.match(text[-2:-1]):
            stem, stop = self[word[:-1]], self[word[-1:]]
            ids = self.ids_of(stem) + self.ids_of(stop)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        k = self[word] = len(self.place)
        self.place.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        return k

    def ids_of(self, k: int) -> array:
        return self.flat[self.place[k]:self.place[k] + self.count[k]]

    def batch(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each text and the end): every text closed by ``end``."""
        get = self.__getitem__
        words, n = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            for chunk in word_chunks(t):
                words.append(np.fromiter(map(get, chunk), np.int64, len(chunk)))
                n[k] += len(chunk)
        index = np.concatenate(words)
        flat, place, every = np.array(self.flat, np.uint32), np.array(self.place, np.int64), np.array(self.count, np.int64)
        count = every[index]
        at = np.zeros(len(index) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        last = np.cumsum(n)
        size = at[last] - at[last - n] + 1
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(size, out=first[1:])
        ids = np.full(int(first[-1]), end, np.uint32)
        to = at[:-1] + np.repeat(np.arange(len(texts)), n)
        # word ids are laid down by their position inside the word
        source = place[index]
        step, live = 0, np.arange(len(index))
        while len(live):
            live = live[count[live] > step]
            ids[to[live] + step] = flat[source[live] + step]
            step += 1
            if step == 16:  # long words: one by one
                for k in live[count[live] > step].tolist():
                    ids[to[k] + step:to[k] + count[k]] = flat[source[k] + step:source[k] + count[k]]
                break
        return ids, first


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    return Tokenizer.from_file(path)


# --- pieces -----------------------------------------------------------------------

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint"


def make_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row per piece; ``number`` counts the pieces of a length in its task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memo = WordIds(_tokenizer(tokenizer_path))
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()

        for b in batches:
            if len(memo) > MEMO_WORDS:
                memo = WordIds(memo.tokenizer)
            ids, first = memo.batch([(t or "").encode() for t in b.column("text").to_pylist()], end)
            size = np.diff(first)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            raw, at = memoryview(ids.astype("<u4").tobytes()), (first[doc] + start) * 4
            crc = [zlib.crc32(raw[a:a + 4 * k]) for a, k in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ranks = np.empty(len(length), np.int64)
            counts = np.bincount(length, minlength=capacity + 1)
            ranks[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
            number = ranks + seen[length]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(number)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    df = docs.select("doc_id", "text")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: run(sliced(batches, limit=BATCH)), PIECES.format(id=id_type))


# --- the plan ---------------------------------------------------------------------

class RoomTree:
    """Segment tree over remaining room: how many open sequences have each room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.sums[k] += n
            k >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of ``length`` or more that an open sequence has."""
        k = length + self.leaves
        if self.sums[k]:
            return length
        while k > 1:
            if not k & 1 and self.sums[k + 1]:  # a left child whose sibling has some: go down there
                k += 1
                while k < self.leaves:
                    k *= 2
                    if not self.sums[k]:
                        k += 1
                return k - self.leaves
            k >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing on counts by length: (runs, number of sequences). A run
    (length, first number, first sequence, to a sequence, offset) holds the
    pieces from its first number to the next run's of that length.

    Sequences with equal room filled the same way are kept as ranges. A length
    opens at most one range and splits at most three, so ranges are at most four
    times ``capacity`` at any corpus size, and each has fewer than sqrt(2 * capacity)
    different lengths: so the runs are bounded as well."""
    tree, open_ranges, runs, sequences = RoomTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0

        def lay(first: int, n: int, room: int, fill: int) -> None:
            nonlocal left, number
            runs.append((length, number, first, fill, capacity - room))
            number += n * fill
            left -= n * fill
            rest = room - fill * length
            if rest:
                open_ranges.setdefault(rest, []).append((first, n))
                tree.add(rest, n)

        while left:
            room = tree.tightest(length)
            if room is None:
                # new sequences for all that is left, as full as the length allows
                first, n, room = sequences, -(-left // (capacity // length)), capacity
                sequences += n
            else:
                first, n = open_ranges[room].pop()
                tree.add(room, -n)
            fill = room // length
            full = min(n, left // fill)
            if full < n:  # the last sequence of this length is filled in part, those behind it stay
                used = full + (left % fill > 0)
                if n > used:
                    open_ranges.setdefault(room, []).append((first + used, n - used))
                    tree.add(room, n - used)
                part = left % fill
                if full:
                    lay(first, full, room, fill)
                if part:
                    lay(first + full, 1, room, part)
            else:
                lay(first, n, room, fill)
    return runs, sequences


# --- the packing ------------------------------------------------------------------

def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    pieces = cut_lineage(make_pieces(docs, tokenizer_path, capacity, end), "pack-pieces")
    by_task = cut_lineage(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs, _ = plan(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    by_length = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = join_small(pieces, bases, ["task", "length"]).withColumn("number", F.col("number") + F.col("base"))

    def place(batches):
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            run = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                a, z = by_length[n], by_length[n + 1]
                mine = length == n
                run[mine] = a + np.searchsorted(table[a:z, 1], number[mine], side="right") - 1
            _, first, sequence, fill, offset = table[run].T
            nth = number - first
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence + nth // fill), pa.array(offset + nth % fill * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        place, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
