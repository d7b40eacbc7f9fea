"""Language identification by a byte convolutional network (operator 5).

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes (the last one is
padded with zero bytes). Filters of widths 2, 3 and 4 run over each window
(the first layer on one-hot bytes is a table lookup per filter position), the
maximum over positions feeds a softmax. A text's chances are the mean of its
windows' log-chances weighted by their bytes, so the whole text counts.

The network is trained in numpy on windows of a bounded sample of labelled
texts (``FIT_PER_LANG`` documents per language, by hash of the id).

Defined results: null text or text without a letter is ``und`` with score 0;
with no labelled text every document is ``und``; ids are carried as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNDETERMINED = "und"
#: Bounds of the labelled sample that trains the network.
FIT_PER_LANG = 800
FIT_WINDOWS = 3
EPOCHS = 14
BATCH = 64
SEED = 5


def init_network(n_langs: int, rng: np.random.Generator) -> dict:
    f = FILTERS * len(WIDTHS)
    tables = [rng.normal(0, 0.1, (256, f)).astype(np.float32) for _ in range(max(WIDTHS))]
    for j, t in enumerate(tables):
        for k, w in enumerate(WIDTHS):
            if j >= w:
                t[:, k * FILTERS:(k + 1) * FILTERS] = 0
    return {"tables": tables, "bias": np.zeros(f, np.float32),
            "out": rng.normal(0, 0.1, (f, n_langs)).astype(np.float32), "out_bias": np.zeros(n_langs, np.float32)}


def _first(j: int) -> int:
    """First filter that reads the byte at offset ``j``."""
    return FILTERS * sum(w <= j for w in WIDTHS)


def convolve(net: dict, x: np.ndarray) -> np.ndarray:
    """uint8 windows (n, WINDOW) -> filter values (n, positions, filters)."""
    positions = x.shape[1] - max(WIDTHS) + 1
    z = net["tables"][0][x[:, :positions]]
    for j in range(1, max(WIDTHS)):
        a = _first(j)
        z[:, :, a:] += net["tables"][j][:, a:][x[:, j:j + positions]]
    return z


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def window_log_chances(net: dict, x: np.ndarray, chunk: int = 32) -> np.ndarray:
    """Log-chances of the languages for each window, in cache-sized chunks."""
    pooled = np.empty((len(x), len(net["bias"])), np.float32)
    for i in range(0, len(x), chunk):
        pooled[i:i + chunk] = convolve(net, x[i:i + chunk]).max(1)
    return _log_softmax(np.maximum(pooled + net["bias"], 0) @ net["out"] + net["out_bias"])


def train_network(x: np.ndarray, y: np.ndarray, n_langs: int, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Adam on cross-entropy; a max-pooled filter's gradient goes to the bytes
    at its winning position. Half of the windows of a batch are shortened at
    random so that short texts are covered."""
    rng = np.random.default_rng(seed)
    net = init_network(n_langs, rng)
    flat = [*net["tables"], net["bias"], net["out"], net["out_bias"]]
    mean, var, step = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    cols = np.arange(len(net["bias"]))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for i in range(0, len(x), BATCH):
            k = order[i:i + BATCH]
            xb, yb, n = x[k].copy(), y[k], len(k)
            keep = np.where(rng.random(n) < 0.5, rng.integers(6, WINDOW, n), WINDOW)
            xb[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
            z = convolve(net, xb)
            win = z.argmax(1)
            pooled = np.take_along_axis(z, win[:, None, :], 1)[:, 0] + net["bias"]
            hidden = np.maximum(pooled, 0)
            g = np.exp(_log_softmax(hidden @ net["out"] + net["out_bias"]))
            g[np.arange(n), yb] -= 1
            g /= n
            gh = (g @ net["out"].T) * (pooled > 0)
            grads = []
            for j in range(max(WIDTHS)):
                gt = np.zeros_like(net["tables"][j])
                a = _first(j)
                np.add.at(gt, (xb[np.arange(n)[:, None], win[:, a:] + j], cols[None, a:]), gh[:, a:])
                grads.append(gt)
            grads += [gh.sum(0), hidden.T @ g, g.sum(0)]
            step += 1
            for p, m, v, d in zip(flat, mean, var, grads):
                m *= 0.9
                m += 0.1 * d
                v *= 0.999
                v += 0.001 * d * d
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def text_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner of each window, bytes of each window)."""
    lengths = np.diff(offsets)
    n_windows = -(-lengths // WINDOW)
    first = np.concatenate([[0], np.cumsum(n_windows)])
    x = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    owner = np.repeat(np.arange(len(lengths)), n_windows)
    shift = first[:-1] * WINDOW - offsets[:-1]
    x[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    used = np.minimum(lengths[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW, WINDOW)
    return x.reshape(-1, WINDOW), owner, used


def fit(docs: DataFrame, per_lang: int = FIT_PER_LANG) -> tuple[list[str], dict | None]:
    """Languages and network from the labelled rows of ``docs(doc_id, text,
    lang)``. Per language at most 1.2 x ``per_lang`` documents (by hash of the
    id), ``FIT_WINDOWS`` windows each at hashed places."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    share = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(int(1e6 * min(1.0, per_lang / n))))])
    key = F.xxhash64("doc_id", "text")
    raw = F.encode("text", "utf-8")
    place = F.pmod(F.xxhash64(key, F.col("k")), F.greatest(F.octet_length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    rows = (known.where(F.pmod(key, F.lit(1_000_000)) < share[F.col("lang")])
            .select("lang", "text", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1))).alias("k"))
            .select("lang", F.substring(raw, place, F.lit(WINDOW)).alias("w"))
            .limit(int(1.2 * per_lang * FIT_WINDOWS * len(langs))).collect())
    rows = sorted((r["lang"], bytes(r["w"])) for r in rows)
    if not rows:
        return [], None
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, w) in enumerate(rows):
        x[i, :len(w)] = np.frombuffer(w, np.uint8)
    y = np.array([langs.index(r[0]) for r in rows])
    return langs, train_network(x, y, len(langs))


def predict(docs: DataFrame, langs: list[str], net: dict | None, keep: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns + the language and its chance, named by ``names``."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(b.column("text"))
        n = b.num_rows
        pred, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
        if net is not None and len(data):
            x, owner, used = text_windows(data, offsets)
            total = np.zeros((n, len(langs)))
            chances = window_log_chances(net, x) * used[:, None]
            for k in range(len(langs)):
                total[:, k] = np.bincount(owner, chances[:, k], n)
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            p = np.exp(_log_softmax(total))
            best = p.argmax(1)
            lettered = b.column("__lettered").to_numpy(zero_copy_only=False).astype(bool)
            pred[lettered] = np.array(langs, dtype=object)[best[lettered]]
            score[lettered] = p[np.arange(n), best][lettered]
        kept = [b.column(c) for c in keep]
        return pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], [*keep, *names])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__lettered")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    src = docs.select(*dict.fromkeys([*keep, "text"]), lettered)
    return map_texts(src, batch, f"{types}, `{names[0]}` string, `{names[1]}` double")


def identify_language(docs: DataFrame, hold_out: int = 2, modulus: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from documents whose id's
    crc32 modulo ``modulus`` is not ``hold_out`` (a null id trains)."""
    held = F.coalesce(crc_mod(F.col("doc_id"), modulus) == hold_out, F.lit(False))
    langs, net = fit(docs.where(~held))
    return predict(docs, langs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
