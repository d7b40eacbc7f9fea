"""Scoring texts with a gated recurrent language model (operator 3).

Corpus statistics come from all training documents: the count c of every
lower-cased word, the number N of tokens (each document ends with one end
token) and the number V of distinct tokens. They give the base score and the
spelling of rare words.

The model's symbols are the ``SYMBOLS`` most frequent words, a symbol for all
other words and the end of the text. A gated recurrent unit reads the symbols;
the output is factored into classes of symbols of like frequency: first the
class, then the symbol within it. A rare word costs its symbol and then its
share (c + 1) / Z among all rare words, where Z is the sum of c + 1 over them
plus 1 for words never seen, so chances add up to one.

Training is truncated backpropagation through time in numpy over all training
documents, whole texts with carried state. Documents are dealt by hash to
``ROUNDS`` rounds and to shards of about ``SHARD_TOKENS`` tokens; in a round
each shard trains from the same weights and the results are averaged by tokens.
Every corpus, small or large, is passed ``EPOCHS`` times. Scoring puts documents end to
end in lanes; windows of ``WINDOW`` steps follow each other and the state is
carried from window to window until the document ends, so the whole text is
scored however long it is.

The counts of the ``COMMON`` most frequent words travel to the tasks (a fixed
bound); all other words are counted by joining on the word, exactly.

Defined results: null text is an empty text (one end token); a null id trains;
repeated rows are scored each; without training tokens the counts are 0.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import crc_mod, map_texts, text_buffers

SYMBOLS = 1022
CLASSES = 32
HIDDEN = 24
COMMON = 50_000
#: Passes over the training texts, whatever their size.
EPOCHS = 1
ROUNDS = 4
SHARD_TOKENS = 500_000
#: Partial averages that reach the driver in a round.
LOTS = 32
WINDOW = 32
LANES = 64
SEED = 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- network -------------------------------------------------------------------

def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def init_network(n_symbols: int, rng: np.random.Generator, hidden: int = HIDDEN, classes: int = CLASSES) -> dict:
    per = -(-n_symbols // classes)
    classes = -(-n_symbols // per)  # no class without symbols
    net = {"x": rng.normal(0, 0.1, (n_symbols + 1, 3 * hidden)), "uzr": rng.normal(0, 0.2, (hidden, 2 * hidden)),
           "uh": rng.normal(0, 0.2, (hidden, hidden)), "b": np.zeros(3 * hidden), "c": rng.normal(0, 0.1, (hidden, classes)),
           "cb": np.zeros(classes), "w": rng.normal(0, 0.1, (classes, hidden, per)), "wb": np.zeros((classes, per))}
    real = np.arange(classes * per).reshape(classes, per) < n_symbols
    net["wb"][~real] = -30.0
    return {k: v.astype(np.float32) for k, v in net.items()}


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    z /= z.sum(-1, keepdims=True)
    return z


def _times(a: np.ndarray, b: np.ndarray, rows: int = 256) -> np.ndarray:
    """a @ b for a long, narrow ``a``, some rows at a time: products this small
    stay in the task's own thread."""
    if len(a) <= rows:
        return a @ b
    whole = len(a) // rows * rows
    out = np.empty((len(a), b.shape[1]), np.result_type(a, b))
    if whole:
        out[:whole] = (a[:whole].reshape(-1, rows, a.shape[1]) @ b).reshape(whole, -1)
    if whole < len(a):
        out[whole:] = a[whole:] @ b
    return out


def _inner(a: np.ndarray, b: np.ndarray, rows: int = 256) -> np.ndarray:
    """a.T @ b, some rows at a time."""
    if len(a) <= rows:
        return a.T @ b
    whole = len(a) // rows * rows
    out = a[whole:].T @ b[whole:]
    if whole:
        out += (a[:whole].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, rows, b.shape[1])).sum(0)
    return out


def run_window(net: dict, x: np.ndarray, h: np.ndarray, start: int) -> tuple:
    """The states of all lanes after each previous symbol of ``x``, (steps,
    lanes), and what the gradient needs; symbol ``start`` begins with state 0."""
    n = h.shape[1]
    a = net["x"][x]
    a += net["b"]
    goes_on = (x != start).astype(np.float32)[:, :, None]
    before, states = np.empty((2, *x.shape, n), np.float32)
    for k in range(len(x)):
        h0 = np.multiply(h, goes_on[k], out=before[k])
        zr = a[k, :, :2 * n]
        zr += h0 @ net["uzr"]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        cand = a[k, :, 2 * n:]
        cand += (zr[:, n:] * h0) @ net["uh"]
        np.tanh(cand, out=cand)
        h = np.subtract(cand, h0, out=states[k])
        h *= zr[:, :n]
        h += h0
    return states, before, a, goes_on


def step(net: dict, x: np.ndarray, h: np.ndarray) -> tuple:
    """One gated recurrent step for all lanes; ``x``: previous symbols."""
    n = h.shape[1]
    a = net["x"][x] + net["b"]
    zr = _sigmoid(a[:, :2 * n] + h @ net["uzr"])
    z, r = zr[:, :n], zr[:, n:]
    cand = np.tanh(a[:, 2 * n:] + (r * h) @ net["uh"])
    return h + z * (cand - h), z, r, cand


def output_log_chance(net: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log P(symbol | state): class, then symbol within the class."""
    per = net["wb"].shape[1]
    cls, inside = y // per, y % per
    out = _log_softmax(_times(h, net["c"]) + net["cb"])[np.arange(len(y)), cls]
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(len(net["cb"]) + 1))
    for k in range(len(net["cb"])):
        rows = order[edges[k]:edges[k + 1]]
        if len(rows):
            out[rows] += _log_softmax(_times(h[rows], net["w"][k]) + net["wb"][k])[np.arange(len(rows)), inside[rows]]
    return out


def train_pass(net: dict, opt: dict, y: np.ndarray, lengths: np.ndarray, n_symbols: int, rate) -> None:
    """One pass over ``y``, (lanes, steps) symbols of which each lane's first
    ``lengths`` count; changes ``net`` and the optimiser's state ``opt``.
    n_symbols is the start symbol that follows an end. Truncated
    backpropagation: gradients stay inside a window, the state goes on to the
    next one. ``rate``: learning rate by update."""
    per, hid = net["wb"].shape[1], net["uh"].shape[0]
    end = n_symbols - 1
    if not opt:
        opt.update(t=0, m={k: np.zeros_like(v) for k, v in net.items()}, v={k: np.zeros_like(v) for k, v in net.items()})
    m, v2 = opt["m"], opt["v"]
    by_length = np.argsort(-lengths, kind="stable")
    y, lengths = y[by_length], lengths[by_length]
    h = np.zeros((len(y), hid), np.float32)
    prev = np.full(len(y), n_symbols)
    for s in range(0, y.shape[1], WINDOW):
        lanes = int((lengths > s).sum())
        if not lanes:
            break
        h, prev, ys = h[:lanes], prev[:lanes], y[:lanes, s:s + WINDOW]
        after = np.where(ys == end, n_symbols, ys).T
        x = np.vstack([prev, after[:-1]])
        prev = after[-1]
        states, before, gates, goes_on = run_window(net, x, h, n_symbols)
        h = states[-1]
        hs, target = states.reshape(-1, hid), ys.T.ravel()
        live = (s + np.arange(ys.shape[1])[:, None] < lengths[:lanes]).ravel()
        n = int(live.sum())
        g = {k: np.zeros_like(p) for k, p in net.items()}
        cls, inside = target // per, target % per
        d = _softmax(_times(hs, net["c"]) + net["cb"])
        d[np.arange(len(target)), cls] -= 1
        d *= (live / np.float32(n))[:, None].astype(np.float32)
        g["c"], g["cb"] = _inner(hs, d), d.sum(0)
        dh_all = _times(d, net["c"].T)
        order = np.flatnonzero(live)
        order = order[np.argsort(cls[order], kind="stable")]
        edges = np.searchsorted(cls[order], np.arange(len(net["cb"]) + 1))
        by_class, own, back = hs[order], inside[order], np.empty((len(order), hid), np.float32)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            rows = slice(edges[k], edges[k + 1])
            d = _times(by_class[rows], net["w"][k])
            d += net["wb"][k]
            d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d /= d.sum(1, keepdims=True)
            d[np.arange(len(d)), own[rows]] -= 1
            d /= n
            g["w"][k], g["wb"][k] = _inner(by_class[rows], d), d.sum(0)
            back[rows] = _times(d, net["w"][k].T)
        dh_all[order] += back
        dh_all = dh_all.reshape(-1, lanes, hid)
        dh = np.zeros((lanes, hid), np.float32)
        z, r, cand = gates[..., :hid], gates[..., hid:2 * hid], gates[..., 2 * hid:]
        by_z, by_r, by_c, keep = (cand - before) * z * (1 - z), before * r * (1 - r), z * (1 - cand * cand), 1 - z
        da = np.empty_like(gates)
        uh_t, uzr_t = net["uh"].T.copy(), net["uzr"].T.copy()
        for k in range(len(x) - 1, -1, -1):
            dh = dh + dh_all[k]
            dc = np.multiply(dh, by_c[k], out=da[k, :, 2 * hid:])
            drh = dc @ uh_t
            np.multiply(dh, by_z[k], out=da[k, :, :hid])
            np.multiply(drh, by_r[k], out=da[k, :, hid:2 * hid])
            dh *= keep[k]
            drh *= r[k]
            dh += drh
            dh += da[k, :, :2 * hid] @ uzr_t
            dh *= goes_on[k]
        da, x = da.reshape(-1, 3 * hid), x.ravel()
        g["uzr"] = _inner(before.reshape(-1, hid), da[:, :2 * hid])
        g["uh"] = _inner((r * before).reshape(-1, hid), da[:, 2 * hid:])
        g["b"] = da.sum(0)
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.diff(x[order], prepend=-1))
        g["x"][x[order[first]]] = np.add.reduceat(da[order], first)
        opt["t"] += 1
        t = opt["t"]
        for k, p in net.items():
            np.clip(g[k], -1, 1, out=g[k])
            m[k] *= 0.9
            m[k] += 0.1 * g[k]
            np.square(g[k], out=g[k])
            g[k] *= 0.001
            v2[k] *= 0.999
            v2[k] += g[k]
            move = v2[k] / (1 - 0.999 ** t)
            np.sqrt(move, out=move)
            move += 1e-8
            np.divide(m[k], move, out=move)
            move *= rate(t) / (1 - 0.9 ** t)
            p -= move


def train_network(streams: np.ndarray, n_symbols: int, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A network trained on full lanes, ``streams``: (lanes, steps) symbols."""
    net = init_network(n_symbols, np.random.default_rng(seed))
    lanes, length = streams.shape
    total = epochs * max(1, -(-length // WINDOW))
    opt: dict = {}
    for _ in range(epochs):
        train_pass(net, opt, streams, np.full(lanes, length), n_symbols, lambda t: 0.01 * (1 - t / (total + 1)) + 0.0005)
    return net


def pack(lengths: list[int], lanes: int) -> list[list[int]]:
    """Texts dealt to lanes: the longest first, each to the shortest lane."""
    heap = [(0, k) for k in range(lanes)]
    out: list[list[int]] = [[] for _ in range(lanes)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        load, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (load + lengths[i], k))
    return out


def lane_matrix(texts: list[np.ndarray], lanes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, owner) of shape (lanes, steps); owner -1 is padding."""
    steps = max((sum(len(texts[i]) for i in lane) for lane in lanes), default=0)
    y = np.zeros((len(lanes), steps), np.int64)
    owner = np.full((len(lanes), steps), -1)
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            y[k, at:at + len(texts[i])] = texts[i]
            owner[k, at:at + len(texts[i])] = i
            at += len(texts[i])
    return y, owner


def score_texts(net: dict, texts: list[np.ndarray], n_symbols: int) -> np.ndarray:
    """Natural log chance of each symbol sequence (each ends with the end)."""
    if not texts:
        return np.zeros(0)
    lengths = [len(t) for t in texts]
    lanes = pack(lengths, max(1, min(192, len(texts), sum(lengths) // max(max(lengths), 512) + 1)))
    y, owner = lane_matrix(texts, lanes)
    total = np.zeros(len(texts))
    h = np.zeros((len(lanes), net["uh"].shape[0]), np.float32)
    prev = np.full(len(lanes), n_symbols)
    end = n_symbols - 1
    for s in range(0, y.shape[1], WINDOW):
        ys, own = y[:, s:s + WINDOW], owner[:, s:s + WINDOW]
        after = np.where(ys == end, n_symbols, ys).T
        states = run_window(net, np.vstack([prev, after[:-1]]), h, n_symbols)[0]
        h, prev = states[-1], after[-1]
        own, flat = own.T.ravel(), ys.T.ravel()
        live = own >= 0
        total += np.bincount(own[live], output_log_chance(net, states.reshape(-1, h.shape[1])[live], flat[live]), len(texts))
    return total


# --- corpus --------------------------------------------------------------------

def _split(raw: bytes) -> list[bytes]:
    return raw.translate(LOWER).split()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = text_buffers(batch.column("text"))
    raw = data.tobytes()
    return [raw[offsets[k]:offsets[k + 1]] for k in range(batch.num_rows)]


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training documents. Each batch is counted before the
    shuffle, so a frequent word sends one row per batch."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        count: Counter = Counter()
        for t in _texts(b):
            count.update(_split(t))
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()),
                                           pa.array(list(count.values()), pa.int64())], ["word", "n"])

    return map_texts(train.select("text"), batch, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def _flat(net: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in net.values()])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    cuts = np.cumsum([v.size for v in like.values()])[:-1]
    return {k: p.reshape(v.shape).astype(np.float32) for (k, v), p in zip(like.items(), np.split(flat, cuts))}


WEIGHT_ROWS = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("weights", pa.binary())])


def fit_network(train: DataFrame, index: dict[bytes, int], rare: int, n_total: int) -> dict:
    """The network, trained on every training text from its first word to its
    end. The result depends on the texts only, not on their partitions."""
    end, n_symbols = rare + 1, rare + 2
    net = init_network(n_symbols, np.random.default_rng(SEED))
    if not n_total:
        return net

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        seqs = [np.array([index.get(w, rare) for w in _split(t)] + [end], np.int16).tobytes() for t in _texts(b)]
        return pa.RecordBatch.from_arrays([b.column("k"), pa.array(seqs, pa.binary())], ["k", "seq"])

    encoded = cut_lineage(map_texts(train.select(F.xxhash64("doc_id", "text").alias("k"), "text"), encode, "k bigint, seq binary"), "lm-symbols")
    n_shards = max(1, -(-n_total // (ROUNDS * SHARD_TOKENS)))
    dealt = F.pmod("k", F.lit(ROUNDS * n_shards))
    encoded = encoded.select("k", "seq", (dealt % ROUNDS).alias("round"), F.floor(dealt / ROUNDS).alias("shard"))
    total = ROUNDS * EPOCHS

    def trainer(start: dict, rate: float):
        def shard(t: pa.Table) -> pa.Table:
            texts = sorted(zip(t.column("k").to_pylist(), t.column("seq").to_pylist()))
            texts = [np.frombuffer(s, np.int16) for _, s in texts]
            y, owner = lane_matrix(texts, pack([len(x) for x in texts], min(LANES, len(texts))))
            mine = {k: v.copy() for k, v in start.items()}
            train_pass(mine, {}, y, (owner >= 0).sum(1), n_symbols, lambda _: rate)
            n = sum(map(len, texts))
            return pa.Table.from_pylist([{"shard": t.column("shard")[0].as_py(), "n": n,
                                          "weights": (_flat(mine).astype(np.float64) * n).tobytes()}], schema=WEIGHT_ROWS)
        return shard

    def added(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["shard", "n", "weights"]).to_pylist(), key=lambda r: r["shard"])
        weights = sum(np.frombuffer(r["weights"]) for r in rows)
        return pa.Table.from_pylist([{"shard": rows[0]["shard"], "n": sum(r["n"] for r in rows), "weights": weights.tobytes()}], schema=WEIGHT_ROWS)

    kinds = "shard bigint, n bigint, weights binary"
    for r in range(total):
        part = encoded.where(F.col("round") == r % ROUNDS).groupBy("shard").applyInArrow(trainer(net, 0.01 * (1 - r / total) + 0.0005), kinds)
        if n_shards > LOTS:
            part = part.groupBy(F.pmod("shard", F.lit(LOTS)).alias("lot")).applyInArrow(added, kinds)
        rows = sorted(part.collect(), key=lambda row: row["shard"])
        if rows:
            net = _shaped(sum(np.frombuffer(row["weights"]) for row in rows) / sum(row["n"] for row in rows), net)
    return net


def score_documents(docs: DataFrame, hold_out: int = 2, modulus: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    of every whole text; documents whose id's crc32 modulo ``modulus`` is
    ``hold_out`` do not train."""
    held = F.coalesce(crc_mod(F.col("doc_id"), modulus) == hold_out, F.lit(False))
    train = docs.where(~held).select("doc_id", "text")
    counts = cut_lineage(word_counts(train), "lm-counts")
    n_docs = train.count()
    sums = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_total = int(sums["n"] or 0) + n_docs
    v_total = int(sums["v"]) + (1 if n_docs else 0)
    common = {r["word"].encode(): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(COMMON).collect()}
    ranked = sorted(common, key=lambda w: (-common[w], w))[:SYMBOLS]
    # symbols in order of count: classes hold symbols of like frequency
    rare, end = len(ranked), len(ranked) + 1
    n_symbols = rare + 2
    index = {w: i for i, w in enumerate(ranked)}
    top_c = sum(common[w] for w in ranked)
    rare_total = (int(sums["n"] or 0) - top_c) + (int(sums["v"]) - len(ranked)) + 1

    net = fit_network(train, index, rare, n_total)
    base_total = n_total + v_total + 1

    def known_part(b: pa.RecordBatch):
        """Per document what the network and the common words give."""
        n = b.num_rows
        tokens, known, base, tail = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        symbols, far_row, far_word, far_n = [], [], [], []
        end_base = float(np.log10((n_docs + 1) / base_total))
        for k, t in enumerate(_texts(b)):
            ws = _split(t)
            symbols.append(np.array([index.get(w, rare) for w in ws] + [end], np.int64))
            n_known, base_log, tail_log = 1 if n_docs else 0, end_base, 0.0
            for w, f in Counter(ws).items():
                log = logs.get(w)
                if log is None:
                    far_word.append(w)
                    far_n.append(f)
                    far_row.append(k)
                else:
                    n_known += f
                    base_log += f * log[0]
                    tail_log += f * log[1]
            tokens[k], known[k], base[k], tail[k] = len(ws) + 1, n_known, base_log, tail_log
        net_log = score_texts(net, symbols, n_symbols) / np.log(10)
        far_row = np.array(far_row, np.int64)
        starts = np.searchsorted(far_row, np.arange(n + 1)).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(far_word, pa.binary()).cast(pa.string()), pa.array(far_n, pa.int32())], ["word", "f"])
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("rid"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(net_log + tail),
             pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct)],
            ["doc_id", "rid", "n_tokens", "n_known", "base_score", "score", "far"])

    # the second part is the share among rare words, which symbols do not have
    logs = {w: (float(np.log10((c + 1) / base_total)), 0.0 if w in index else float(np.log10((c + 1) / rare_total))) for w, c in common.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = cut_lineage(map_texts(
        docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text"), known_part,
        f"doc_id {kind}, rid bigint, n_tokens bigint, n_known bigint, base_score double, score double, "
        "far array<struct<word:string,f:int>>"), "lm-part")

    # words beyond the common ones: joined with their counts, summed by row
    # (rid is stable here: ``part`` is a written table)
    far = part.select("rid", F.inline("far"))
    seen = counts.where(F.col("c") <= min(common.values(), default=0))
    far = far.join(seen, "word", "left").select(
        "rid", "f", F.coalesce("c", F.lit(0)).alias("c"))
    far = far.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("f")).otherwise(0)).cast("bigint").alias("far_known"),
        F.sum(F.col("f") * F.log10((F.col("c") + 1) / F.lit(float(base_total)))).alias("far_base"),
        F.sum(F.col("f") * F.log10((F.col("c") + 1) / F.lit(float(rare_total)))).alias("far_score"))
    out = part.drop("far").join(far, "rid", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(n_total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("far_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("far_score", zero)).alias("score"))
