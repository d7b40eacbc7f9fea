"""Quality rules: a learned decision list over text statistics (operator 7).

``text_statistics`` computes per-document statistics with built-in functions.
``learn_decision_list`` learns ordered rules by sequential covering: each rule
is a conjunction of ``statistic >= t`` / ``statistic <= t`` conditions that is
grown on two thirds of the labelled rows (by gain in log-odds per covered bad
row) and pruned on the other third; covered rows leave, and the next rule is
learned on the rest. ``verdict`` turns the list into one ordered ``CASE WHEN``.

The list is fitted on the statistics of a bounded sample of labelled rows
(``FIT_ROWS``); everything else runs over all documents.

Defined results: null text has no words (all counts 0, ``base_failed``); no
labelled rows, or only one class, give an empty list, which keeps everything
the base rules keep; null labels are ignored; repeated rows each get a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

STATISTICS = ["n_words", "mean_word_length", "symbol_share", "capital_runs", "exclaim_share",
              "dup_line_share", "repeat_share", "words_per_line"]
#: Bound of the labelled sample that fits the list (rows, by hash of the id).
FIT_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_COVER = 0.002
MIN_PRECISION = 0.9


def _removed(text: Column, chars: str) -> Column:
    """``text`` without ``chars``: one byte-level ``replace`` per character,
    which is several times cheaper than ``translate`` on long texts."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(hashes: Column) -> Column:
    """Words covered by 5-word windows that occur at least twice in the text.
    ``hashes`` is the array of word hashes. Windows are compared by a 64-bit
    hash of the five word hashes, within one text only."""
    n = F.size(hashes)
    shifted = [hashes] + [F.slice(hashes, k + 1, F.greatest(n, F.lit(1))) for k in range(1, WINDOW)]
    zipped = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    full = F.slice(zipped, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    return F.transform(full, lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(WINDOW)]))


def _cover(sorted_windows: Column) -> Column:
    """Sorted (hash, start) pairs -> number of covered words."""
    m = F.size(sorted_windows)
    z = F.arrays_zip(sorted_windows.alias("a"),
                     F.slice(sorted_windows, 2, m).alias("b"),
                     F.concat(F.slice(sorted_windows, 1, 1), F.slice(sorted_windows, 1, m - 1)).alias("c"))
    twice = F.filter(z, lambda t: (t["a"]["h"] == t["b"]["h"])
                     | ((t["a"]["h"] == t["c"]["h"]) & (t["a"]["i"] != t["c"]["i"])))
    return F.sort_array(F.transform(twice, lambda t: t["a"]["i"]))


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    the statistics the list may test)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", *keep, text.alias("text"), words(F.col("text")).alias("words"))
    d = d.select("doc_id", *keep, "text", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
                 F.filter(F.split("text", "\n", -1), lambda s: F.trim(s, F.lit(GAP_CHARS)) != "").alias("lines"))
    d = d.withColumn("windows", repeated_words(F.col("hashes")))
    d = d.withColumn("pairs", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("starts", F.when(F.col("pairs").isNotNull(), _cover(F.col("pairs"))))
    steps = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))),
                       lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    counts = F.struct(
        F.size("hashes").cast("bigint").alias("n_words"),
        F.length(_removed(F.col("text"), GAP_CHARS)).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(_removed(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("starts").isNotNull(),
               F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]{2}")).alias("n_upper"),
        (F.length("text") - F.length(_removed(F.col("text"), "!"))).alias("n_exclaim"),
    )
    # inline() of a one-row array: the optimizer does not push a caller's filter
    # on these columns below it, which would evaluate the arrays once per use
    d = d.select("doc_id", *keep, F.inline(F.array(counts)))

    def share(a: str, b: str) -> Column:
        return (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")

    return d.withColumns({
        "mean_word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "capital_runs": share("n_upper", "n_words"),
        "exclaim_share": share("n_exclaim", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }).drop("n_lines", "n_upper", "n_exclaim")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic).cast("double")
        return c >= F.lit(self.threshold) if self.at_least else c <= F.lit(self.threshold)

    def holds(self, row: tuple) -> bool:
        v = row[STATISTICS.index(self.statistic)]
        return v >= self.threshold if self.at_least else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold -> the document is bad."""
    conditions: tuple[Condition, ...] = field(default_factory=tuple)

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def holds(self, row: tuple) -> bool:
        return all(c.holds(row) for c in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps the row."""
    expr = None
    for r in rules:
        expr = F.when(r.column(), False) if expr is None else expr.when(r.column(), False)
    return F.lit(True) if expr is None else expr.otherwise(True)


def rule_index(rules: list[Rule]) -> Column:
    """1-based number of the first rule that fires; null when none does."""
    expr = None
    for i, r in enumerate(rules):
        expr = F.when(r.column(), i + 1) if expr is None else expr.when(r.column(), i + 1)
    return F.lit(None).cast("int") if expr is None else expr.cast("int")


def _best_condition(rows: list, p0: int, n0: int, least: float) -> Condition | None:
    """The condition of the highest gain: bad rows kept times the rise of log2
    precision (ties: the first statistic, then the first threshold)."""
    best, choice = 1e-9, None
    base = math.log2(p0 / (p0 + n0))
    for k, s in enumerate(STATISTICS):
        order = sorted(rows, key=lambda r: r[k])
        for at_least in (True, False):
            p = n = 0
            walk = order[::-1] if at_least else order
            for i, r in enumerate(walk[:-1]):
                p, n = p + r[-2], n + 1 - r[-2]
                if r[k] == walk[i + 1][k] or p < least:
                    continue
                gain = p * (math.log2(p / (p + n)) - base)
                if gain > best:
                    best, choice = gain, Condition(s, at_least, (r[k] + walk[i + 1][k]) / 2)
    return choice


def _value(rows: list) -> float:
    """Worth of a cover: (bad - good) / rows; -1 when empty."""
    return (2 * sum(r[-2] for r in rows) - len(rows)) / len(rows) if rows else -1.0


def cover_sequentially(rows: list[tuple]) -> list[Rule]:
    """Ordered rules from rows (statistics..., bad 0/1, prune 0/1)."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, prune = [r for r in rows if not r[-1]], [r for r in rows if r[-1]]
        least = max(2.0, MIN_COVER * len(grow))
        chosen: list[Condition] = []
        while len(chosen) < MAX_CONDITIONS:
            p0 = sum(r[-2] for r in grow)
            cond = _best_condition(grow, p0, len(grow) - p0, least) if 0 < p0 < len(grow) else None
            if cond is None:
                break
            chosen.append(cond)
            grow = [r for r in grow if cond.holds(r)]
        held = [Rule(tuple(chosen[:k])) for k in range(1, len(chosen) + 1)]
        if not held:
            break
        best = max(held, key=lambda rule: (_value([r for r in prune if rule.holds(r)]), -len(rule.conditions)))
        caught = [r for r in prune if best.holds(r)]
        if not caught or sum(r[-2] for r in caught) < MIN_PRECISION * len(caught):
            break
        rules.append(best)
        rows = [r for r in rows if not best.holds(r)]
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, n_rows: int = FIT_ROWS) -> DataFrame:
    """About ``n_rows`` labelled documents (at most 1.2 times that): ids whose
    hash falls under the share n_rows / labelled ids. Rows without a label or
    id never enter; of repeated ids the least label counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    total = known.count()
    share = int(1_000_000 * min(1.0, n_rows / max(total, 1)))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).limit(int(1.2 * n_rows))
    # bounded by the limit above: two small columns of at most 1.2 * n_rows rows
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def learn_decision_list(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for bad documents (``quality`` = 0), learned on the statistics of
    a bounded labelled sample; a third of its ids, by hash, prunes."""
    sample = labelled_sample(docs, labels)
    rows = text_statistics(sample.select("doc_id", "text", "quality"), keep=("quality",)).where(~base_failed()).select(
        *[F.col(s).cast("double") for s in STATISTICS], (F.lit(1) - F.col("quality")).cast("int"),
        (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).cast("int"))
    return cover_sequentially(sorted(tuple(r) for r in rows.limit(2 * FIT_ROWS).collect()))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base rules and the learned verdict of every document."""
    rules = learn_decision_list(docs, labels)
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn(
        "rule", rule_index(rules)).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
