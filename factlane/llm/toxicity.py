"""Toxicity by a classifier chain (operator 8).

Categories are predicted one after the other: each is a logistic regression on
presence of selected words plus the chances of all earlier categories. While
training, those chances are out-of-fold predictions, so a later model does not
learn from chances that have seen their own label; the final models are fitted
on the whole sample. A category's cut is the one of best F1 out of fold.

The sample is bounded (``FIT_ROWS`` labelled documents by hash of the id);
words are selected by Spark from that sample: the ``FEATURES`` words of largest
difference in document share, with its standard error, per category.

Defined results: null and empty text has no words and gets the categories'
base chances; without labels the chances are 0 and nothing is flagged; null
labels are left out; of repeated ids the largest label counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_buffers

#: Bound of the labelled sample (documents) and of the selected words.
FIT_ROWS = 12_000
FEATURES = 400
FOLDS = 4
#: A selected word is in at least 4 and in 1 of ``RARE`` sampled documents, and
#: its z value is at least ``MIN_Z``: few words get there by chance.
MIN_DOCUMENTS, RARE = 4, 1_500
MIN_Z = 4.0
#: ASCII letters are lowered, other ASCII bytes that are no letters end a word.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Runs of other visible ASCII characters are words as well.
SIGNS = bytes(c if 33 <= c <= 126 and not chr(c).isalpha() else 32 for c in range(256))


def plain_words(text: Column) -> Column:
    """The same words in the JVM: distinct runs of lowered ASCII letters and
    of all characters beyond ASCII, and runs of signs."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    both = F.concat(F.split(low, r"[\x00-\x60\x7B-\x7F]+"), F.split(text, r"[^\x21-\x40\x5B-\x60\x7B-\x7E]+"))
    return F.array_distinct(F.filter(both, lambda w: w != ""))


def category_labels(labels: DataFrame, categories: list[str]) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull())
    for c in categories:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy("doc_id").agg(*[F.max(c).alias(f"y_{c}") for c in categories])


def select_words(sample: DataFrame, categories: list[str], n_docs: int, positives: dict[str, int]) -> list[str]:
    """Words whose share among positive documents differs most from that among
    negative ones (z value), ``FEATURES`` per category."""
    per = sample.select(*[f"y_{c}" for c in categories], F.explode(plain_words(F.col("text"))).alias("word"))
    per = per.groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f"y_{c}").alias(f"n_{c}") for c in categories])
    per = per.where(F.col("n") >= max(MIN_DOCUMENTS, n_docs / RARE))
    chosen: set[str] = set()
    for c in categories:
        p, n = max(positives[c], 1), max(n_docs - positives[c], 1)
        a, b = F.col(f"n_{c}") / p, (F.col("n") - F.col(f"n_{c}")) / n
        pooled = F.col("n") / (p + n)
        z = F.abs(a - b) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / p + 1 / n))
        chosen.update(r["word"] for r in per.select("word", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(FEATURES).collect())
    return sorted(chosen)


def presence(texts: list[bytes], index: dict[bytes, int]) -> list[list[int]]:
    """Places of the selected words that each whole text holds."""
    vocabulary = set(index)
    return [sorted(index[w] for w in vocabulary.intersection(t.translate(TABLE).split() + t.translate(SIGNS).split())) for t in texts]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression with both classes of equal total weight; the last
    weight is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    cost = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    w, m, v = np.zeros(x1.shape[1], np.float32), np.float32(0), np.float32(0)
    for k in range(1, steps + 1):
        g = x1.T @ ((_sigmoid(x1 @ w) - y) * cost) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - 0.05 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)).astype(np.float32)
    return w.astype(np.float64)


def _chance(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def best_cut(chance: np.ndarray, y: np.ndarray) -> float:
    """Cut of best F1; midway between the chances that it parts."""
    order = np.argsort(-chance, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    c = chance[order]
    f1[:-1][c[:-1] == c[1:]] = -1
    k = int(f1.argmax())
    return float((c[k] + c[k + 1]) / 2) if k + 1 < len(c) else float(c[k])


def fit_chain(x: np.ndarray, ys: list[np.ndarray], folds: int = FOLDS) -> list[tuple[np.ndarray, float]]:
    """(weights, cut) per category in chain order."""
    chain, earlier = [], np.zeros((len(x), 0))
    fold = np.arange(len(x)) % folds
    for y in ys:
        xe = np.hstack([x, earlier])
        out = np.empty(len(x))
        for f in range(folds):
            out[fold == f] = _chance(fit_linear(xe[fold != f], y[fold != f]), xe[fold == f])
        chain.append((fit_linear(xe, y), best_cut(out, y)))
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def run_chain(chain: list[tuple[np.ndarray, float]], x: np.ndarray) -> np.ndarray:
    for w, _ in chain:
        x = np.hstack([x, _chance(w, x)[:, None]])
    return x[:, x.shape[1] - len(chain):]


def fit(docs: DataFrame, labels: DataFrame, categories: list[str]) -> tuple[dict[bytes, int], list] | None:
    known = category_labels(labels, categories)
    total = known.count()
    if total == 0:
        return None
    share = int(1e6 * min(1.0, FIT_ROWS / total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).limit(int(1.2 * FIT_ROWS))
    # bounded by the limit: at most 1.2 * FIT_ROWS narrow rows
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    counts = sample.agg(F.count("*").alias("n"), *[F.sum(f"y_{c}").alias(c) for c in categories]).first()
    if not counts["n"]:
        return None
    vocabulary = select_words(sample, categories, counts["n"], {c: counts[c] or 0 for c in categories})
    index = {w.encode(): i for i, w in enumerate(vocabulary)}
    array = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    rows = sample.select("doc_id", *[f"y_{c}" for c in categories],
                         F.array_intersect(plain_words(F.col("text")), array).alias("held")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], sorted(r["held"])))
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, r in enumerate(rows):
        x[i, [index[w.encode()] for w in r["held"]]] = 1
    ys = [np.array([r[f"y_{c}"] for r in rows], np.float64) for c in categories]
    return index, fit_chain(x, ys)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """(doc_id, <category>_score, <category>) of every whole text; the label
    columns named by ``categories`` are 0/1 and predicted in that order."""
    model = fit(docs, labels, categories)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(b.column("text"))
        raw = data.tobytes()
        n = b.num_rows
        columns = []
        if model is None:
            chances, cuts = np.zeros((n, len(categories))), [1.0] * len(categories)
        else:
            index, chain = model
            x = np.zeros((n, len(index)), np.float32)
            for i, places in enumerate(presence([raw[offsets[k]:offsets[k + 1]] for k in range(n)], index)):
                x[i, places] = 1
            chances, cuts = run_chain(chain, x), [cut for _, cut in chain]
        for k, cut in enumerate(cuts):
            columns += [pa.array(chances[:, k].astype(np.float64)), pa.array(chances[:, k] >= cut)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *columns],
                                          ["doc_id", *[n for c in categories for n in (f"{c}_score", c)]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"`{c}_score` double, `{c}` boolean" for c in categories)
    return map_texts(docs.select("doc_id", "text"), batch, schema)
