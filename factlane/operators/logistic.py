"""Logistic regression of many groups at once.

Every group (dataset x run, or one group for a whole corpus) has its own L2
penalised model with a free intercept; a group may be fitted with several
penalties at once (``problem`` numbers them). Features come as a long table (group,
row, index, value), weights go out as a long table (group, problem, index, weight)
with the intercept at index -1, and no vocabulary, weight or row passes through the
driver.

A group of at most ``BLOCK_VALUES`` values is one block and is solved where the
block is. The rows of a larger group are dealt to blocks of about
``PART_VALUES`` values, and one iteration of L-BFGS is one job for all groups
and penalties together: blocks are joined with the points to be tried (a block is
read once for all of them), each task sends the sums of its blocks' gradients in
slices, the slices are added, and each problem's optimiser takes its step. Its
state is a table in the shared folder, so a lost executor costs one iteration at
most.

Features as unlike in size as term weights make plain L-BFGS slow. Up to ``DENSE``
features its directions therefore start from the inverse of a matrix of second
derivatives: of the whole group where it is one block, else of the group's first
block, fitted alone and scaled to the group's rows. That block only shapes the
steps and gives the first point; loss, gradient and the stop are those of all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LR_MAX_ITER
from ..session import cut_lineage, join_small, small_batches

BLOCK_VALUES = 4_000_000
#: Points of at most this many bytes are broadcast to the blocks; sums of at most this many wait in a task.
BROADCAST_BYTES = 64 << 20
#: Numbers of a gradient that are added up in one group.
PIECE = 1 << 14
#: Values of a block where a group has several.
PART_VALUES = 1_000_000
#: Largest mean gradient entry at which a model is taken as fitted.
TOLERANCE = 1e-7
MEMORY = 10
INTERCEPT = -1
#: Most features for which second derivatives are taken.
DENSE = 2048
#: There the stop is closer by this factor: it costs an iteration or two.
CLOSER = 0.01
#: Iterations after which a group in one block takes them anew.
RENEW = 6


# --- the optimiser ------------------------------------------------------------------

class Lbfgs:
    """Limited-memory BFGS that is told loss and gradient at ``at`` and moves
    ``at`` to the next point. All state is in numbers and arrays, so it can be kept in
    a table row between the iterations of a distributed fit."""

    def __init__(self, size: int, tolerance: float, inverse: np.ndarray | None = None):
        self.at = np.zeros(size)
        self.inverse = inverse
        self.best = self.slope = None
        self.tolerance, self.step, self.told, self.halved = tolerance, 1.0, 0, 0
        self.moves, self.turns = [], []

    def tell(self, loss: float, gradient: np.ndarray) -> bool:
        """True when the model is fitted."""
        self.told += 1
        if self.best is not None:
            point, last_loss, last_gradient, direction = self.best
            if loss > last_loss + 1e-4 * self.step * self.slope + 1e-12 * abs(last_loss):
                self.halved += 1
                self.step *= 0.5
                self.at = point + self.step * direction
                return self.halved > 40
            move, turn = self.at - point, gradient - last_gradient
            if move @ turn > 1e-12 * (turn @ turn):
                self.moves, self.turns = [*self.moves, move][-MEMORY:], [*self.turns, turn][-MEMORY:]
        if np.abs(gradient).max() <= self.tolerance:
            self.best = self.at, loss, gradient, gradient
            return True
        direction = -self._inverse(gradient)
        self.slope = float(direction @ gradient)
        if self.slope >= 0:
            self.moves, self.turns, direction = [], [], -gradient
            self.slope = float(direction @ gradient)
        self.best = self.at, loss, gradient, direction
        self.step = 1.0 if self.moves or self.inverse is not None else min(1.0, 1.0 / float(np.abs(gradient).sum()))
        self.halved = 0
        self.at = self.at + self.step * direction
        return False

    def _inverse(self, gradient: np.ndarray) -> np.ndarray:
        q, shares = gradient.copy(), []
        for s, y in zip(reversed(self.moves), reversed(self.turns)):
            a = (s @ q) / (s @ y)
            q -= a * y
            shares.append(a)
        if self.inverse is not None:
            q = self.inverse @ q
        elif self.moves:
            s, y = self.moves[-1], self.turns[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(zip(self.moves, self.turns), reversed(shares)):
            q += s * (a - (y @ q) / (s @ y))
        return q

    def weights(self) -> np.ndarray:
        return self.best[0] if self.best is not None else self.at

    def pack(self) -> bytes:
        empty = np.zeros_like(self.at)
        head = [self.tolerance, self.step, self.told, self.halved, len(self.moves), self.best is not None,
                self.slope or 0.0, self.best[1] if self.best else 0.0]
        point, gradient, direction = (self.best[0], *self.best[2:]) if self.best else (empty, empty, empty)
        return np.concatenate([head, self.at, point, gradient, direction, *self.moves, *self.turns]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, size: int, inverse: np.ndarray | None = None) -> "Lbfgs":
        values = np.frombuffer(raw)
        out = cls(size, values[0], inverse)
        out.step, out.told, out.halved, held = values[1], int(values[2]), int(values[3]), int(values[4])
        vectors = values[8:].reshape(-1, size)
        out.at = vectors[0].copy()
        if values[5]:
            out.slope, out.best = values[6], (vectors[1], values[7], vectors[2], vectors[3])
        out.moves, out.turns = list(vectors[4:4 + held]), list(vectors[4 + held:4 + 2 * held])
        return out


class Block:
    """Rows of one block: sparse values, labels."""

    def __init__(self, row: dict):
        self.row = np.frombuffer(row["row"], np.int32)
        self.index = np.frombuffer(row["index"], np.int32).astype(np.intp)  # looked up for each problem
        self.value = np.frombuffer(row["value"], np.float64)
        self.y = np.frombuffer(row["y"], np.float64)
        # a row's values stand together
        self.first = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.own, self.lengths = self.row[self.first], np.diff(self.first, append=len(self.row))

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Each row's margin; the intercept is the last weight."""
        terms = weights[self.index]
        terms *= self.value
        return np.bincount(self.own, np.add.reduceat(terms, self.first), len(self.y)) + weights[-1]

    def loss(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the log-loss and its gradient (the intercept last)."""
        z = self.margins(weights)
        rest = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - self.y
        gradient = np.empty(len(weights))
        gradient[:-1] = np.bincount(self.index, self.value * np.repeat(rest[self.own], self.lengths), len(weights) - 1)
        gradient[-1] = rest.sum()
        return float((np.logaddexp(0.0, z) - self.y * z).sum()), gradient

    def curvature(self, weights: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Second derivatives of the log-loss, ``rows`` rows at a time."""
        size = len(weights)
        root = 1.0 / (2.0 * np.cosh(np.clip(self.margins(weights) / 2, -350, 350)))  # sqrt(p (1 - p))
        out, order = np.zeros((size, size)), np.argsort(self.row, kind="stable")
        edges = np.searchsorted(self.row, np.arange(0, len(self.y) + rows, rows), sorter=order)
        for a, lo, hi in zip(range(0, len(self.y), rows), edges, edges[1:]):
            n, own = min(rows, len(self.y) - a), order[lo:hi]
            x = np.bincount((self.row[own] - a) * size + self.index[own], self.value[own], n * size).reshape(n, size)
            x[:, -1] = 1.0
            x *= root[a:a + n, None]
            out += x.T @ x
        return out


def _penalised(loss: float, gradient: np.ndarray, weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Adds penalty / 2 |weights|^2, the intercept left free."""
    pull = penalty * weights
    pull[-1] = 0.0
    return loss + 0.5 * float(pull @ weights), gradient + pull


def _inverse_curvature(curvature: np.ndarray, penalty: float) -> np.ndarray:
    """Inverse with the penalty; the intercept, which has none, is kept from a
    pivot of 0 when all chances are sure."""
    at = np.arange(len(curvature) - 1)
    curvature[at, at] += max(penalty, 1e-9)
    curvature[-1, -1] += 1e-9
    return np.linalg.inv(curvature)


def _fitted(block: Block, fit: Lbfgs, penalty: float, max_iter: int, shaped: bool) -> Lbfgs:
    """The fit of one block where it is; ``shaped``: by second derivatives."""
    done = False
    while not done and fit.told < max_iter:
        if shaped and fit.told % RENEW == 0:
            fit.inverse, fit.moves, fit.turns = _inverse_curvature(block.curvature(fit.at), penalty), [], []
        done = fit.tell(*_penalised(*block.loss(fit.at), fit.at, penalty))
    return fit


# --- blocks --------------------------------------------------------------------------

def large_rows(batches):
    """The rows of Arrow batches one at a time, bytes as views of the batch: a
    block is large and read once. Lists of structs become lists of dicts."""
    def plain(value):
        if pa.types.is_binary(value.type):
            return value.as_buffer()
        if pa.types.is_list(value.type):
            return [{k: plain(v) for k, v in x.items()} for x in value]
        return value.as_py()

    for b in batches:
        for i in range(b.num_rows):
            yield {c: plain(b.column(c)[i]) for c in b.schema.names}


def _pack(normalise: bool, group: list[str], schema: pa.Schema):
    def block(t: pa.Table) -> pa.Table:
        """One block: long rows become sparse rows; a row without values has an
        entry with a null index."""
        keys = t.column("row").combine_chunks().dictionary_encode()
        row = keys.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        n = len(keys.dictionary)
        y = np.zeros(n)
        y[row] = t.column("label").to_numpy()
        index = t.column("index").combine_chunks()
        real = np.asarray(index.is_valid())
        row, index = row[real], index.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)[real]
        value = t.column("value").combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False)[real]
        if normalise:
            norm = np.sqrt(np.bincount(row, value * value, n))
            value = value / np.where(norm > 0, norm, 1.0)[row]
        order = np.lexsort((index, row))  # sums do not depend on the order of arrival
        out = {g: t.column(g)[0].as_py() for g in group}
        out |= {"block": t.column("block")[0].as_py(), "n_blocks": t.column("n_blocks")[0].as_py(), "n_rows": t.column("n_rows")[0].as_py(),
                "row": row[order].tobytes(), "index": index[order].tobytes(), "value": value[order].tobytes(), "y": y.tobytes()}
        return pa.Table.from_pylist([out], schema=schema)
    return block


def blocks_for(n, block_values: int = BLOCK_VALUES):
    """Number of blocks (a column) for ``n`` values."""
    size = F.when(n > block_values, min(block_values, PART_VALUES)).otherwise(block_values)
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def feature_blocks(rows: DataFrame, features: DataFrame, group, row: str, label: str, normalise: bool = True,
                   block_values: int = BLOCK_VALUES) -> DataFrame:
    """(group..., block, n_blocks, n_rows, sparse rows): the rows of a group in
    blocks of about ``block_values`` values, kept in the shared folder."""
    group = list(group)
    entries = rows.select(*group, F.col(row).alias("row"), F.col(label).cast("double").alias("label"),
                          F.lit(None).cast("int").alias("index"), F.lit(None).cast("double").alias("value")).unionByName(
        features.select(*group, F.col(row).alias("row"), F.col(label).cast("double").alias("label"), F.col("index").cast("int").alias("index"),
                        F.col("value").cast("double").alias("value")))
    sizes = entries.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("index").isNull()).alias("n_rows")).select(
        *group, blocks_for(F.col("n"), block_values).alias("n_blocks"), "n_rows")
    dealt = join_small(entries, sizes, group).withColumn("block", F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int"))
    names = dict(rows.dtypes)
    ddl = ", ".join(f"{g} {names[g]}" for g in group) + ", block int, n_blocks int, n_rows bigint, `row` binary, `index` binary, value binary, y binary"
    kinds = pa.schema([*((g, _arrow(names[g])) for g in group), ("block", pa.int32()), ("n_blocks", pa.int32()), ("n_rows", pa.int64()),
                       *((c, pa.binary()) for c in ("row", "index", "value", "y"))])
    return cut_lineage(dealt.groupBy(*group, "block").applyInArrow(_pack(normalise, group, kinds), ddl), "logistic-blocks")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]


# --- the fit ---------------------------------------------------------------------------

def fit_logistic(blocks: DataFrame, group, dimension: int, penalties=(1.0,), mean_loss: bool = False,
                 tolerance: float = TOLERANCE, max_iter: int = LR_MAX_ITER, start: DataFrame | None = None) -> DataFrame:
    """(group..., problem, index, weight): problem k minimises the summed log-loss
    plus penalties[k] / 2 |weights|^2, with ``mean_loss`` the mean log-loss.
    ``start``: (group..., start), for each group the float64 weights, intercept
    last, at which the search begins (by default zeros)."""
    group = list(group)
    if dimension <= DENSE:
        tolerance *= CLOSER
    names = dict(blocks.dtypes)

    def started(rows: DataFrame) -> DataFrame:
        return rows.withColumn("start", F.lit(None).cast("binary")) if start is None else join_small(rows, start, group, "left")

    key_ddl = "".join(f"{g} {names[g]}, " for g in group)
    weight_ddl = f"{key_ddl}problem int, `index` int, weight double"
    key_kinds = [(g, _arrow(names[g])) for g in group]
    weight_kinds = pa.schema([*key_kinds, ("problem", pa.int32()), ("index", pa.int32()), ("weight", pa.float64())])

    def penalty_of(k: int, n_rows: int) -> float:
        return penalties[k] * (n_rows if mean_loss else 1.0)

    def long_rows(keys: list, problem: int, index: np.ndarray, values: np.ndarray, kinds: pa.Schema) -> pa.RecordBatch:
        n = len(index)
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k] * n, t) for k, (_, t) in zip(keys, key_kinds)), pa.array(np.full(n, problem, np.int32)),
             pa.array(index.astype(np.int32)), pa.array(values)], schema=kinds)

    def solve(batches):
        for b in batches:
            for r in b.to_pylist():
                block = Block(r)
                used, small = np.unique(block.index, return_inverse=True)
                block.index = small
                for k in range(len(penalties)):
                    fit = Lbfgs(len(used) + 1, tolerance * max(r["n_rows"], 1))
                    if r["start"]:
                        fit.at = np.frombuffer(r["start"])[np.append(used, -1)]
                    fit = _fitted(block, fit, penalty_of(k, r["n_rows"]), max_iter, dimension <= DENSE)
                    yield long_rows([r[g] for g in group], k, np.append(used, INTERCEPT), fit.weights(), weight_kinds)

    weights = started(blocks.where("n_blocks = 1")).mapInArrow(solve, weight_ddl)
    large = blocks.where("n_blocks > 1")
    if large.isEmpty():
        return cut_lineage(weights, "logistic-weights")

    # groups of several blocks: one job an iteration for all of them
    state_ddl = f"{key_ddl}n_rows bigint, problem int, at binary, state binary, open boolean"
    state_kinds = pa.schema([*key_kinds, ("n_rows", pa.int64()), ("problem", pa.int32()), ("at", pa.binary()), ("state", pa.binary()), ("open", pa.bool_())])
    size = dimension + 1
    sum_ddl = f"{key_ddl}problem int, piece int, part binary"
    sum_kinds = pa.schema([*key_kinds, ("problem", pa.int32()), ("piece", pa.int32()), ("part", pa.binary())])

    shape_kinds = pa.schema([*state_kinds, ("inverse", pa.binary())])

    def begin(batches):
        """A group's first block gives the first points and shapes the steps."""
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                for k in range(len(penalties)):
                    fit, inverse = Lbfgs(size, tolerance * max(r["n_rows"], 1)), None
                    if r["start"]:
                        fit.at = np.frombuffer(r["start"])
                    if dimension <= DENSE:
                        block, penalty = Block(r), penalty_of(k, r["n_rows"])
                        share = len(block.y) / r["n_rows"]
                        if np.ptp(block.y) and not r["start"]:
                            alone = Lbfgs(size, tolerance * len(block.y))
                            fit.at = _fitted(block, alone, penalty * share, max_iter, True).weights()
                        inverse = _inverse_curvature(block.curvature(fit.at) / share, penalty).tobytes()
                    yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in (*group, "n_rows")}, "problem": k, "at": fit.at.tobytes(),
                                                       "state": fit.pack(), "open": True, "inverse": inverse}], schema=shape_kinds)

    def pieces(held: dict):
        """Sums of gradient and loss, cut into slices of ``PIECE`` numbers."""
        for (*keys, problem), total in held.items():
            cuts = [total[at:at + PIECE].tobytes() for at in range(0, size + 1, PIECE)]
            n = len(cuts)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, t) for k, (_, t) in zip(keys, key_kinds)), pa.array([problem] * n, pa.int32()),
                                              pa.array(range(n), pa.int32()), pa.array(cuts, pa.binary())], schema=sum_kinds)

    def gradients(batches):
        """Each block is read once for all its open problems, and a task adds
        up its blocks before anything is sent."""
        held: dict = {}
        for r in large_rows(batches):
            block, keys = Block(r), [r[g] for g in group]
            for point in r["points"]:
                loss, gradient = block.loss(np.frombuffer(point["at"]))
                own = (*keys, point["problem"])
                if own in held:
                    held[own][:-1] += gradient
                    held[own][-1] += loss
                else:
                    held[own] = np.append(gradient, loss)
            if len(held) * 8 * size > BROADCAST_BYTES:
                yield from pieces(held)
                held = {}
        yield from pieces(held)

    def added(t: pa.Table) -> pa.Table:
        parts = t.column("part")
        total = np.frombuffer(parts[0].as_py()).copy()
        for p in parts[1:]:
            total += np.frombuffer(p.as_py())
        out = {c: t.column(c)[0].as_py() for c in (*group, "problem", "piece")} | {"part": total.tobytes()}
        return pa.Table.from_pylist([out], schema=sum_kinds)

    def tell(t: pa.Table) -> pa.Table:
        """One problem: its state row, the summed gradient and the matrix that
        shapes its steps. A fitted problem keeps its weights only."""
        def rows_with(c):
            return t.filter(pa.compute.is_valid(t.column(c)))
        held = rows_with("state").to_pylist()
        if not held:
            return pa.Table.from_pylist([], schema=state_kinds)
        held = held[0]
        sums = sorted(rows_with("part").select(["piece", "part"]).to_pylist(), key=lambda r: r["piece"])
        total = np.concatenate([np.frombuffer(r["part"]) for r in sums])
        inverse = rows_with("inverse").column("inverse").to_pylist()
        fit = Lbfgs.unpack(held["state"], size, np.frombuffer(inverse[0]).reshape(size, size) if inverse else None)
        done = fit.tell(*_penalised(float(total[-1]), total[:-1], fit.at, penalty_of(held["problem"], held["n_rows"])))
        open_ = not done and fit.told < max_iter
        out = {c: held[c] for c in state_kinds.names} | {
            "at": (fit.at if open_ else fit.weights()).tobytes(), "state": fit.pack() if open_ else b"", "open": open_}
        return pa.Table.from_pylist([out], schema=state_kinds)

    if dimension <= DENSE:
        first = join_small(large, large.groupBy(*group).agg(F.min("block").alias("block")), [*group, "block"])
    else:
        first = large.groupBy(*group).agg(F.first("n_rows").alias("n_rows"))
    with small_batches(blocks.sparkSession, row_a_group=True):
        begun = cut_lineage(started(first).mapInArrow(begin, f"{state_ddl}, inverse binary"), "logistic-state")
    states, shapes = begun.drop("inverse"), begun.where("inverse IS NOT NULL").select(*group, "problem", "inverse")
    n_open = states.count()
    while n_open:
        tried = states.where("open").groupBy(*group).agg(F.collect_list(F.struct("problem", "at")).alias("points"))
        tried = F.broadcast(tried) if n_open * 8 * size <= BROADCAST_BYTES else tried
        sums = large.join(tried, group).mapInArrow(gradients, sum_ddl).groupBy(*group, "problem", "piece").applyInArrow(added, sum_ddl)
        told = states.where("open").withColumns({"piece": F.lit(None).cast("int"), "part": F.lit(None).cast("binary")}).unionByName(
            sums, allowMissingColumns=True).unionByName(shapes, allowMissingColumns=True)
        moved = told.groupBy(*group, "problem").applyInArrow(tell, state_ddl)
        with small_batches(blocks.sparkSession, row_a_group=True):
            states = cut_lineage(moved.unionByName(states.where("not open")), "logistic-state")
        n_open = states.where("open").count()

    def finish(batches):
        for b in batches:
            for r in b.to_pylist():
                yield long_rows([r[g] for g in group], r["problem"], np.append(np.arange(dimension), INTERCEPT), np.frombuffer(r["at"]), weight_kinds)

    return cut_lineage(weights.unionByName(states.drop("state").mapInArrow(finish, weight_ddl)), "logistic-weights")


def margins(rows: DataFrame, features: DataFrame, weights: DataFrame, group, row: str, normalise: bool = True) -> DataFrame:
    """(group..., row, problem, margin) of every row: one join of the features
    with the weights and one aggregate. ``features`` holds only indexes that occur in
    the fit."""
    group = list(group)
    v, w = F.col("value"), F.col("weight")
    norm = F.sqrt(F.sum(v * v)) if normalise else F.lit(1.0)
    dots = (join_small(features.select(*group, row, "index", "value"), weights.where(F.col("index") != INTERCEPT), [*group, "index"], limit=1_000_000)
            .groupBy(*group, row, "problem").agg((F.sum(v * w) / F.when(norm > 0, norm).otherwise(1.0)).alias("dot")))
    free = weights.where(F.col("index") == INTERCEPT).select(*group, "problem", F.col("weight").alias("free"))
    every = join_small(rows.select(*group, row), free, group)
    return every.join(dots, [*group, row, "problem"], "left").select(
        *group, row, "problem", (F.coalesce("dot", F.lit(0.0)) + F.col("free")).alias("margin"))
