"""Operators 9 and 10, the pipeline, and the registered queries."""

import random

import duckdb

import corpus_pipeline
from factlane.llm import decontaminate, source_mix
from factlane.llm.queries import ORACLE_SQL, QUERIES

from .helpers import AWKWARD, frame, prose, texts


def test_mix_agrees_with_sql(spark):
    rows = texts(11, 60) + AWKWARD
    docs = frame(spark, rows)
    got = source_mix.mix_sources(docs.repartition(3)).toPandas()
    data = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    want = duckdb.sql("WITH docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM data)," + source_mix.MIX_SQL
                      + "SELECT doc_id, size, source_size, target, taken FROM mixed").df()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    a, b = (f[key].fillna(-1).round(6).sort_values(key).reset_index(drop=True) for f in (got, want))
    assert a.values.tolist() == b.values.tolist()
    assert (got["taken"] <= 2 * got["size"]).all()
    total = got.groupby("source_size")["taken"].sum()
    for size, part in got.groupby("source_size"):
        assert abs(total[size] - part["target"].iloc[0] * (1 if len(part.target.unique()) == 1 else 1)) <= part["size"].max() or part["target"].nunique() > 1
    assert abs(got.drop_duplicates(["source_size", "target"])["target"].sum() - 1.5 * got["size"].sum()) < 1e-6 * got["size"].sum() + got["size"].sum()
    assert source_mix.mix_sources(docs.limit(0)).count() == 0


def test_targets_share_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 4000), (None, 10)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_mix.source_targets(sizes).collect()}
    total = 1.5 * 5110
    # a stops at 200 and the null source (weight 5) at 20; b gets 2, c gets 1
    rest = total - 200 - 20
    b = min(2000.0, rest * 2 / 3)
    assert got["a"] == 200 and got[None] == 20
    assert abs(got["b"] - b) < 1e-9 and abs(got["c"] - (rest - b)) < 1e-9


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_leaks(spark):
    rng = random.Random(12)
    items = [(k, f"Which {prose(rng, 8)} q{k} is {prose(rng, rng.randint(2, 40))}? The answer is {prose(rng, 5)} z{k}.") for k in range(30)]
    docs, want = [], set()
    for i in range(60):
        t = prose(rng, rng.randint(5, 400))
        if i % 4 == 0:
            k = rng.randrange(30)
            t = t + " " + items[k][1].upper() + " " + prose(rng, rng.randint(0, 300))
            want.add((i, k))
        if i % 10 == 1:
            t += " " + items[3][1][:30]  # a question's start alone is no leak
        docs.append((i, t))
    docs += [(900, None), (901, "")]
    got = decontaminate.find_leaks(frame(spark, docs), bench(spark, [*items, (77, None), (78, ""), (79, "a b")])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    kept = decontaminate.decontaminate(frame(spark, docs + [(None, "no id")]), bench(spark, items))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want} | {None}
    assert decontaminate.find_leaks(frame(spark, docs), bench(spark, items).limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, docs).limit(0), bench(spark, items)).count() == 0


def test_rows_without_an_own_id_are_judged_by_their_text(spark):
    rng = random.Random(17)
    item = prose(rng, 30)
    leak = prose(rng, 20) + " " + item
    docs = [(5, "clean text of five"), (5, leak), (None, leak), (None, "clean text without id"), (None, None), (6, leak), (6, leak), (7, "other"), (7, "other")]
    kept = decontaminate.decontaminate(frame(spark, docs), bench(spark, [(1, item)])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([d for d in docs if d[1] != leak], key=str)
    assert set(kept[0].asDict()) == set(frame(spark, docs).columns)


def test_item_ids_of_any_kind(spark):
    rng = random.Random(18)
    items = [("q-1", prose(rng, 25)), (None, prose(rng, 25)), ("q-2", "two words")]
    docs = frame(spark, [(k, prose(rng, 30) + " " + t + " " + prose(rng, 10)) for k, (_, t) in enumerate(items)])
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got)) == [(0, "q-1"), (1, None), (2, "q-2")]


def test_retrieval_equals_plain_bm25(spark, monkeypatch):
    """Every passage against every item without any bound."""
    import math
    from collections import Counter

    D = decontaminate
    rng = random.Random(19)
    words = [f"w{k}" for k in range(160)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) + ". " + " ".join(rng.choice(words) for _ in range(5))) for k in range(40)]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(1, 260))]
        for _ in range(2):
            edited = [w for w in items[rng.randrange(40)][1].split() if rng.random() > 0.25 * (i % 4)]
            at = rng.randint(0, len(t))
            t[at:at] = edited
        docs.append((i, " ".join(t)))
    lists = {k: [w.decode() for w in D.term_list(t.encode())] for k, t in items}
    df = Counter(w for ws in lists.values() for w in set(ws))
    mean = sum(map(len, lists.values())) / len(lists)
    want = {}
    for k, t in items:
        ws = lists[k]
        weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * f * (D.K1 + 1) / (f + D.K1 * (1 - D.B + D.B * len(ws) / mean))
                  for w, f in Counter(ws).items()}
        full = min(max(sum(weight[w] for w in set(ws[max(0, p - s):max(0, p + D.PASSAGE - s)])) for p in range(0, s + len(ws), D.STRIDE)) for s in range(D.STRIDE))
        q, a = D.split_item(t)
        q, a = D.pairs_of(q), D.pairs_of(a)
        for i, text in docs:
            doc = D.term_list(text.encode())
            for s in range(0, max(1, len(doc) - (D.PASSAGE - D.STRIDE)), D.STRIDE):
                score = sum(weight.get(w.decode(), 0.0) for w in set(doc[s:s + D.PASSAGE])) / full
                around = D.pairs_of(doc[max(0, s - len(ws)):s + D.PASSAGE + len(ws)])
                hits = [len(x & around) / len(x) if x else 0.0 for x in (q, a)]
                if score >= D.RETRIEVE and min(hits) >= D.OVERLAP:
                    want[i, k] = max(want.get((i, k), (0.0,) * 3), (*hits, score))
    for shard in (20_000, 7):
        monkeypatch.setattr(D, "SHARD_ITEMS", shard)
        got = D.find_leaks(frame(spark, docs).repartition(3), bench(spark, items)).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
        for r in got:
            q, a, score = want[r["doc_id"], r["item_id"]]
            assert abs(r["question_overlap"] - q) < 1e-6 and abs(r["answer_overlap"] - a) < 1e-6 and abs(r["score"] - score) < 2e-6
    assert len(want) > 30


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Null and repeated ids, clashing columns, and an empty table through all stages."""
    rng = random.Random(20)
    item = prose(rng, 30)
    base = [(i, prose(rng, 60), ["aa", "bb"][i % 2], f"s{i % 3}") for i in range(24)]
    rows = base + [(None, prose(rng, 50), "aa", "s0"), (None, prose(rng, 20) + " " + item, "aa", "s0"), (3, prose(rng, 40), "bb", None),
                   (4, prose(rng, 10) + " " + item + " " + prose(rng, 5), "aa", "s1"), (50, None, None, None), (51, "", "aa", "s2"), base[5], base[5]]
    sf = str(tmp_path)
    bench(spark, [(1, item)]).write.parquet(f"{sf}/benchmark.parquet")
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "source_mix":
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    got = sorted(str(r["doc_id"]) for r in docs.collect())
    assert got == sorted([*(str(i) for i in range(24)), "3", "None"])
    empty = frame(spark, rows).limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0


def test_short_and_numeric_items(spark):
    rng = random.Random(16)
    items = [(1, "Who wrote Hamlet? Shakespeare"), (2, "12 + 7 * 3 = 33. Answer: 33"), (3, "7 * 8 = 56"), (4, "who wrote hamlet: Shakespeare!"),
             (5, "?!"), (6, "Who wrote"), (7, "wrote Hamlet"), (8, prose(rng, 30))]
    docs = [(1, prose(rng, 90) + " who wrote HAMLET? (Shakespeare) " + prose(rng, 90)), (2, "Sum: 12 + 7 * 3 = 33. Answer: 33"), (3, "7 * 8 = 57"),
            (4, prose(rng, 10) + " 7 * 8 = 56"), (5, "Hamlet wrote Shakespeare. Who"), (6, "ends with who"), (7, "wrote Hamlet"), (8, ""), (9, None),
            (10, prose(rng, 20) + " " + items[-1][1])]
    want = {(1, 1), (1, 4), (1, 6), (1, 7), (2, 2), (4, 3), (7, 7), (10, 8)}
    for parts in (1, 3):
        got = decontaminate.find_leaks(frame(spark, docs).repartition(parts), bench(spark, items)).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)
    only = decontaminate.find_leaks(frame(spark, docs), bench(spark, items[:1])).collect()
    assert [tuple(r) for r in only] == [(1, 1, 1.0, 1.0, 1.0)]


def test_shards_find_the_same(spark, monkeypatch):
    rng = random.Random(13)
    items = [(k, prose(rng, 30)) for k in range(12)]
    docs = frame(spark, [(i, prose(rng, 50) + " " + items[i][1]) for i in range(12)])
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 5)
    got = decontaminate.find_leaks(docs, bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(12)}


def test_shards_score_edited_copies_the_same(spark, monkeypatch):
    rng = random.Random(15)
    items = [(k, prose(rng, 30)) for k in range(24)]
    docs = []
    for i in range(96):
        kept = [w if rng.random() > 0.1 + 0.3 * (i % 4) / 4 else f"edit{chr(97 + i % 26)}" for w in items[i % 24][1].split()]
        docs.append((i, prose(rng, 50) + " " + " ".join(kept)))
    docs = frame(spark, docs)
    whole = sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench(spark, items)).collect())
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 3)
    dealt = sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench(spark, items)).collect())
    assert dealt == whole
    assert 10 < len(whole) < 90 and any(r[2] < 0.9 for r in whole)


def test_pipeline_on_small_documents(spark, tmp_path):
    rng = random.Random(14)
    item = prose(rng, 30)
    long_ = prose(rng, 90)
    rows = [(i, prose(rng, 60), ["aa", "bb"][i % 2], f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[0][1], "aa", "s0"), (101, "12 34", "aa", "s0"), (102, None, "aa", "s0"),
             (103, prose(rng, 20) + " " + item + " " + prose(rng, 20), "aa", "s1"),
             (104, prose(rng, 80) + " " + long_, "aa", "s1"), (105, prose(rng, 80) + " " + long_, "bb", "s2")]
    sf = str(tmp_path)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    bench(spark, [(1, item)]).write.parquet(f"{sf}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(range(30)) | {104, 105}
    assert got[104]["size"] < 100 and got[105]["size"] < 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeated_strings", "decontamination", "source_mix"]


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
