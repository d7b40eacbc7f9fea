"""Operator 13 against plain best-fit decreasing and the tokenizer itself."""

import bisect
import random
import zlib

import numpy as np
import pytest

from .helpers import AWKWARD, frame, texts

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def plain_best_fit(counts, capacity):
    """Sequences that best-fit decreasing opens, one piece at a time."""
    rooms, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                opened, room = opened + 1, capacity
            else:
                room = rooms.pop(k)
            if room > length:
                bisect.insort(rooms, room - length)
    return opened


@pytest.mark.parametrize("capacity", [1, 7, 10, 64, 2048])
def test_plan_is_best_fit_decreasing(capacity):
    from factlane.llm.best_fit_packing import plan
    rng = random.Random(capacity)
    for trial in range(40):
        counts = {}
        for _ in range(rng.randint(1, 300)):
            n = rng.randint(1, capacity) if trial % 2 else max(1, int(capacity * rng.random() ** 3))
            counts[n] = counts.get(n, 0) + rng.choice([1, 1, 5])
        runs, sequences = plan(counts, capacity)
        assert sequences == plain_best_fit(counts, capacity)
        runs.sort()
        held = {}
        for k, (length, first, sequence, fill, offset) in enumerate(runs):
            last = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
            for i in range(last - first):
                held.setdefault(sequence + i // fill, []).append((offset + i % fill * length, length))
        assert set(held) == set(range(sequences))
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_plan_does_not_grow_with_the_corpus():
    from factlane.llm.best_fit_packing import plan
    rng = random.Random(5)
    counts = {n: rng.randint(1, 50) for n in range(1, 2049)}
    runs = [len(plan({n: c * k for n, c in counts.items()})[0]) for k in (1, 1000, 1_000_000)]
    assert max(runs) < 40_000 and runs[2] < 2 * runs[0]


def test_word_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    from factlane.llm.best_fit_packing import WordIds
    tokenizer = Tokenizer.from_file(PATH)
    memo = WordIds(tokenizer)
    samples = ["a<|endoftext|>b <|STARTOFTEXT|> <|endoftext|>, don't. Hello,World.. x$, é. ÀB, Σας ΑΣ, ½ ３ 1,000.",
               "　wide nb éá , .'s a.'s it's, ́x foo<bar. KK, İs, ßẞ. ... ,. a., 'll. ​", "", " \n", "ab" * 5000 + " é" + "é" * 3000]
    ids, first = memo.batch([t.encode() for t in samples], 0)
    for k, t in enumerate(samples):
        assert ids[first[k]:first[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_of_awkward_documents(spark, capacity):
    from tokenizers import Tokenizer

    from factlane.llm.best_fit_packing import pack_documents
    rows = [*texts(3), *AWKWARD, texts(3)[0]]
    got = pack_documents(frame(spark, rows).repartition(3), PATH, capacity).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected, counts = [], {}
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            counts[len(part)] = counts.get(len(part), 0) + 1
            expected.append((str(doc_id), k, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(held) == plain_best_fit(counts, capacity)
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_of_an_empty_table(spark):
    from factlane.llm.best_fit_packing import pack_documents
    assert pack_documents(frame(spark, []), PATH).collect() == []
