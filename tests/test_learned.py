"""B5, B6, B9 and X4 on small fixtures."""

import numpy as np

from factlane.operators.classifier import MacroF1Evaluator, train_text_classifier
from factlane.operators.tfidf import tfidf_lr_baseline

COLUMNS = "dataset string, run_id int, claim_id bigint, claim string, label int, majority_baseline int, split string"


def rows(group, n, start, noise=7):
    out = []
    for i in range(n):
        y = int(i % 3 == 0)
        word = "storm" if y else "sunny"
        text = f"the day is {word} number {'odd' if i % 2 else 'even'} item{i % noise}"
        out.append((group, 0, start + i, text, y, 0, "test" if i % 4 == 3 else "train"))
    return out


def plain_solver(train, test, steps=4000):
    """TF-IDF (1-2 grams, L2) and logistic regression with C = 1 in numpy."""
    def grams(t):
        w = [x for x in t.lower().split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    terms = sorted({g for t, _ in train for g in grams(t)})
    place = {g: k for k, g in enumerate(terms)}
    df = np.zeros(len(terms))
    for t, _ in train:
        for g in set(grams(t)):
            df[place[g]] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1

    def matrix(data):
        x = np.zeros((len(data), len(terms)))
        for i, (t, _) in enumerate(data):
            for g in grams(t):
                if g in place:
                    x[i, place[g]] += 1
        x *= idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    x, y = matrix(train), np.array([y for _, y in train], float)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 0.05 * (x.T @ (p - y) + w)
        b -= 0.05 * (p - y).sum()
    return (matrix(test) @ w + b > 0).astype(int)


def test_lr_baseline_matches_a_plain_solver_and_guards(spark):
    data = rows("A", 60, 0) + rows("B", 40, 100, 5) + rows("C", 8, 200)
    df = spark.createDataFrame(data, COLUMNS)
    out = tfidf_lr_baseline(df.where("split = 'train'"), df.where("split = 'test'"))
    got = {r["claim_id"]: r["tfidf_baseline"] for r in out.collect()}
    for g in "AB":
        train = [(r[3], r[4]) for r in data if r[0] == g and r[6] == "train"]
        test = [(r[2], r[3], r[4]) for r in data if r[0] == g and r[6] == "test"]
        want = plain_solver(train, [(t, y) for _, t, y in test])
        assert [got[i] for i, _, _ in test] == want.tolist()
    # six train rows: the majority label stands in
    assert all(got[r[2]] == 0 for r in data if r[0] == "C" and r[6] == "test")


def long_features(spark, n_groups=3, rows=120, places=8, seed=1):
    rng = np.random.default_rng(seed)
    keys, values = [], []
    for g in range(n_groups):
        w = rng.normal(size=places) * 3
        for i in range(rows):
            at, v = rng.choice(places, 3, replace=False), rng.random(3) + 0.1
            y = int(rng.random() < 1 / (1 + np.exp(0.5 - v @ w[at])))
            keys.append((f"g{g}", g, i, y))
            if i:  # row 0 of a group has no feature at all
                values += [(f"g{g}", g, i, y, int(a), float(x)) for a, x in zip(at, v)]
    return (spark.createDataFrame(keys, "dataset string, run_id int, claim_id bigint, label int"),
            spark.createDataFrame(values, "dataset string, run_id int, claim_id bigint, label int, index int, value double"))


def test_many_blocks_give_the_same_weights(spark):
    """Groups in one block are solved in place, in many by an iteration a job."""
    from factlane.operators.logistic import feature_blocks, fit_logistic

    rows_, values = long_features(spark)
    group, found = ["dataset", "run_id"], []
    for size in (10**6, 90):
        blocks = feature_blocks(rows_, values, group, "claim_id", "label", block_values=size)
        assert blocks.where("n_blocks > 1").isEmpty() == (size > 1000)
        fitted = fit_logistic(blocks, group, 8, penalties=(1.0, 0.1))
        found.append({(r.dataset, r.problem, r["index"]): r.weight for r in fitted.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 3 * 2 * 9
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-6


def test_term_like_groups_are_fitted_in_few_iterations(spark, monkeypatch):
    """Features of very unlike size, in one block and in many: few points are
    tried, and the weights are those of the smooth, convex loss."""
    from factlane.operators import logistic

    rng = np.random.default_rng(5)
    keys, values = [], []
    for i in range(900):
        at = rng.choice(40, 12, replace=False, p=(w := 1.0 / (1 + np.arange(40))) / w.sum())
        v = rng.random(12) * (1 + 20.0 / (1 + at))
        y = int(rng.random() < 1 / (1 + np.exp(2 - v @ np.where(at % 2, 0.3, -0.1))))
        keys.append(("g", 0, i, y))
        values += [("g", 0, i, y, int(a), float(x)) for a, x in zip(at, v)]
    group, places = ["dataset", "run_id"], 40
    rows_ = spark.createDataFrame(keys, "dataset string, run_id int, claim_id bigint, label int")
    long = spark.createDataFrame(values, "dataset string, run_id int, claim_id bigint, label int, index int, value double")
    x, y = np.zeros((900, places)), np.array([k[3] for k in keys], float)
    for _, _, i, _, a, v in values:
        x[i, a] = v
    rounds = []
    cut = logistic.cut_lineage
    monkeypatch.setattr(logistic, "cut_lineage", lambda df, name="stage": (rounds.append(name), cut(df, name))[1])
    for size in (10**6, 3000):
        blocks = logistic.feature_blocks(rows_, long, group, "claim_id", "label", normalise=False, block_values=size)
        fitted = logistic.fit_logistic(blocks, group, places).collect()
        w = np.zeros(places + 1)
        for r in fitted:
            w[r["index"]] = r.weight
        rest = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        assert np.abs(x.T @ rest + w[:-1]).max() < 2e-4 and abs(rest.sum()) < 2e-4
    assert 1 < rounds.count("logistic-state") <= 36


def test_state_survives_a_table_row():
    from factlane.operators.logistic import Lbfgs

    a = np.diag([1.0, 10.0, 100.0])
    fit, kept = Lbfgs(3, 1e-9), Lbfgs(3, 1e-9)
    fit.at = kept.at = np.array([3.0, -2.0, 1.0])
    done = False
    for _ in range(60):
        done = fit.tell(0.5 * fit.at @ a @ fit.at, a @ fit.at)
        kept = Lbfgs.unpack(kept.pack(), 3)
        assert kept.tell(0.5 * kept.at @ a @ kept.at, a @ kept.at) == done and (kept.at == fit.at).all()
        if done:
            break
    assert done and np.abs(fit.weights()).max() < 1e-8


def test_ten_thousand_groups_without_terms_on_the_driver(spark, monkeypatch):
    """Vocabularies and weights stay tables: nothing is collected on the way."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from factlane.operators.logistic import margins
    from factlane.operators.tfidf import fit_group_models, group_features

    n = 10_000
    claims = spark.range(0, 6 * n, 1, 8).select(F.col("id").alias("claim_id"), F.concat_ws(
        " ", F.lit("word"), F.concat(F.lit("t"), F.col("id") % 7), F.concat(F.lit("u"), F.col("id") % 3)).alias("claim"))
    train = claims.select(F.lit("A").alias("dataset"), (F.col("claim_id") / 6).cast("int").alias("run_id"), "claim_id",
                          (F.col("claim_id") % 5 < 2).cast("int").alias("label"))

    def no_collect(*_):
        raise AssertionError("rows on the driver")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", no_collect)
        m.setattr(DataFrame, "toLocalIterator", no_collect)
        models = fit_group_models(train, claims, max_features=10)
    group = ["dataset", "run_id"]
    scored = margins(train, group_features(train, models.terms, models.vocabulary), models.weights, group, "claim_id")
    sums = scored.join(train, [*group, "claim_id"]).groupBy(*group).agg(
        F.abs(F.sum(1 / (1 + F.exp(-F.col("margin")))) - F.sum("label")).alias("off"))
    assert sums.count() == n and sums.where("off > 1e-3").isEmpty()


def test_top_terms_are_exact(spark, monkeypatch):
    """Bounds on cells against counting every term, also where the first cells
    are not enough."""
    from pyspark.sql import functions as F

    from factlane.operators import tfidf as T

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 400)) for i in range(80)], "claim_id bigint, claim string")
    train = docs.select("claim_id").withColumn("run_id", F.explode(F.array(F.lit(0), F.lit(1)))).where("(claim_id + run_id) % 3 > 0")
    terms = T.term_frequencies(docs)
    plain = train.join(terms, "claim_id").groupBy("run_id", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).collect()
    for cells, first in ((1 << 18, 4), (64, 1), (3000, 1)):
        monkeypatch.setattr(T, "TERM_CELLS", cells)
        monkeypatch.setattr(T, "FIRST_CELLS", first)
        got = T.fit_vocabulary(train, terms if cells == 64 else T.term_occurrences(docs), ["run_id"], max_features=25).collect()
        for run in (0, 1):
            best = sorted(((-r.total, r.term, r.df) for r in plain if r.run_id == run))[:25]
            assert sorted((-r.total, r.term, r.df) for r in got if r.run_id == run) == best


def test_classifier_learns_and_macro_f1(spark):
    df = spark.createDataFrame(rows("A", 120, 0), COLUMNS).drop("majority_baseline")
    out = train_text_classifier(df).select("label", "prediction").collect()
    assert len(out) == 30 and all(r["label"] == r["prediction"] for r in out)
    pairs = [(0, 0)] * 4 + [(0, 1)] * 2 + [(1, 0)] + [(1, 1)] * 3
    got = MacroF1Evaluator().evaluate(spark.createDataFrame(pairs, "label int, prediction int"))
    assert abs(got - (8 / 11 + 6 / 9) / 2) < 1e-9


def test_classifier_handles_empty_texts_and_reports_scores(spark):
    from factlane.operators.classifier import fit_text_classifier

    data = [(*r[:3], "" if r[2] % 11 == 0 else r[3], *r[4:]) for r in rows("A", 120, 0)]
    model = fit_text_classifier(spark.createDataFrame(data, COLUMNS).drop("majority_baseline"))
    assert set(model.scores) == {1e-3, 1e-2, 1e-1} and model.penalty == max(model.scores, key=lambda k: (model.scores[k], -k))


def test_classifier_in_many_blocks(spark, monkeypatch):
    """Rows in one block or in many take the same steps from the same start."""
    from pyspark.sql import functions as F

    from factlane.operators import classifier as C
    from factlane.operators.logistic import fit_logistic

    rng = np.random.default_rng(2)
    data = [("train", i, i % 2, sorted(int(x) for x in rng.integers(0, 40, 6) + 10 * (i % 2))) for i in range(60)] + [("train", 60, 1, [])]
    df = spark.createDataFrame(data, "part string, __rid bigint, label int, __places array<int>")
    start = spark.createDataFrame([(0, bytearray(np.append(np.zeros(C.FEATURES), 0.3).tobytes()))], "__model int, start binary")
    found = []
    for size in (C.SOLVE_VALUES, 150):
        monkeypatch.setattr(C, "SOLVE_VALUES", size)
        blocks = C.weighted_blocks(C.place_blocks(df, "label"), "train")
        assert (blocks.count() > 1) == (size == 150)
        weights = fit_logistic(blocks.withColumn("__model", F.lit(0)), ["__model"], C.FEATURES, [0.1], mean_loss=True, max_iter=3, start=start)
        found.append({r["__rid"]: r.margin for r in C.block_margins(blocks, weights).collect()})
    assert len(found[0]) == 61 and found[0].keys() == found[1].keys()
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-6


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    """Tables of blocks have a row group a block, rows that are only scored have
    small blocks, and a task gets its blocks about one by one."""
    import pyarrow.parquet as pq

    from factlane.operators import classifier as C

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    data = [("test" if i % 3 == 0 else "train", i, i % 2, [i % 7, 10 + i % 2, 20]) for i in range(90)]
    df = spark.createDataFrame(data, "part string, __rid bigint, label int, __places array<int>").coalesce(1)
    monkeypatch.setattr(C, "PART_VALUES", 30, raising=False)
    before = spark.conf.get(key)
    placed = C.place_blocks(df, "label")
    blocks = C.weighted_blocks(placed, "train")
    for table in (placed, blocks):
        for f in {f.removeprefix("file:").replace("///", "/") for f in table.inputFiles()}:
            meta = pq.ParquetFile(f).metadata
            assert [meta.row_group(k).num_rows for k in range(meta.num_row_groups)] == [1] * meta.num_rows
    assert {r.part: r["count"] for r in placed.groupBy("part").count().collect()} == {"train": 1, "test": 3}
    assert spark.conf.get(key) == before


def test_large_rows_go_to_python_one_by_one(spark):
    from pyspark.sql import functions as F

    from factlane.session import cut_lineage

    def rows_in(batches):
        for b in batches:
            yield b.slice(0, 1).select(["id"]).set_column(0, "n", [b.num_rows])

    rows = spark.range(0, 4, 1, 1).withColumn("x", F.repeat(F.lit("a"), F.lit(9 << 20)))
    assert {r.n for r in cut_lineage(rows.mapInArrow(rows_in, "n bigint"), "n", large_rows=True).collect()} == {1}


def test_vocabulary_from_stored_terms_exchanges_rows_only(spark):
    """Terms held as arrays give the same vocabulary as single occurrences."""
    from pyspark.sql import functions as F

    from factlane.operators import tfidf as T

    docs = spark.createDataFrame([(i, f"aa bb{i % 3} cc{i % 5} aa") for i in range(30)], "claim_id bigint, claim string")
    train = docs.select("claim_id").withColumn("run_id", F.explode(F.array(F.lit(0), F.lit(1)))).where("(claim_id + run_id) % 3 > 0")
    bags = T.term_bags(docs)
    assert bags.count() == 30  # a row a text
    got = [sorted(map(tuple, T.fit_vocabulary(train, t, ["run_id"], max_features=6).collect())) for t in (bags, T.term_occurrences(docs))]
    assert got[0] == got[1] and len(got[0]) == 12
