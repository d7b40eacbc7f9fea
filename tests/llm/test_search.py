"""Operator 11 against a plain scorer of all documents."""

import math
import random
import re

import pytest

from .helpers import AWKWARD, WORDS, frame, prose, texts

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, top=50):
    rows = [(i, terms(t)) for i, t in docs]
    rows = [(i, w) for i, w in rows if w]
    n_docs, n_words = len(rows), sum(len(w) for _, w in rows)
    out = []
    for item_id, text in items:
        weights = {}
        for t in set(terms(text)):
            df = sum(t in set(w) for _, w in rows)
            if df:
                weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        scored = []
        for doc_id, w in rows:
            m = 50 + 50 * len(w) * n_docs // n_words
            score = sum(x * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t, x in weights.items())
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort()
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:top])]
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1.5, "x") for i, t in items], "item_id bigint, text string, score double, doc_id string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows = [*texts(4), *AWKWARD, (900, "É1x, naïve_word! 12a", "aa", None)]
    rows += [(1000 + k, prose(rng, rng.randint(1, 60))) for k in range(150)]
    rows += [(3000 + k, rows[1][1]) for k in range(70)]  # copies tie: the smaller ids win
    rows.append(rows[1])  # a repeated row takes a rank of its own
    return rows


ITEMS = [(1, " ".join(WORDS[:9])), (2, "ban kora"), (2, "ban kora"), (3, None), (4, ""), (5, "..."), (6, "unheard words only"), (None, "é1X naïve"),
         (7, " ".join(WORDS) + " x" * 40), (8, " ".join(f"w{k}" for k in range(70)) + " ban"), (9, "BAN ban Kora")]


@pytest.mark.parametrize("block,shard,seed", [(8192, 4 << 20, 32), (20, 60, 3)])
def test_search_is_exact(spark, corpus, monkeypatch, block, shard, seed):
    from factlane.llm import lexical_search as L
    monkeypatch.setattr(L, "BLOCK_DOCS", block)
    monkeypatch.setattr(L, "SEED_SHARE", seed)
    items = [*ITEMS, (10, corpus[1][1]), (11, corpus[4][1])]
    got = L.rank_documents(frame(spark, corpus).repartition(3), items_frame(spark, items), shard_bytes=shard).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == plain([r[:2] for r in corpus], items)


def test_few_results_and_empty_tables(spark, corpus):
    from factlane.llm.lexical_search import rank_documents
    few = [(5, "alpha beta"), (2, "alpha"), (9, None), (1, "gamma")]
    got = rank_documents(frame(spark, few), items_frame(spark, [(1, "alpha beta"), (2, "gamma")])).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == plain(few, [(1, "alpha beta"), (2, "gamma")])
    assert rank_documents(frame(spark, []), items_frame(spark, ITEMS)).collect() == []
    assert rank_documents(frame(spark, corpus), items_frame(spark, [])).collect() == []


def test_masks_are_passed_over_when_the_bound_is_known(corpus):
    """With the best scores known, only the masks that can still enter are scored."""
    import numpy as np

    from factlane.llm.lexical_search import Block, _postings
    import pyarrow as pa
    vocabulary = {t.encode(): k for k, t in enumerate(w.lower() for w in WORDS[:12])}
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t, *_ in corpus])
    row = next(_postings(vocabulary)(batch)).to_pylist()[0]
    block = Block(row, np.arange(1, 13) * 100, row["docs"], row["words"])
    every = np.arange(12)
    docs, scores = block.search(every, 20, None)
    assert len(docs) == 20 and (np.diff(scores) <= 0).all()
    again, same = block.search(every, 20, (int(scores[4]), int(block.ids[docs[4]])))
    assert same.tolist() == scores[:5].tolist() and again.tolist() == docs[:5].tolist()
    assert len(block.search(every, 20, (int(scores[0]) + 1, 0))[0]) == 0
