"""Quality by a sparse ensemble of rules over document statistics.

Statistics of whole texts are counted over Arrow batches. Shallow trees, boosted on a bounded sample, propose rules:
every path from the root is a conjunction of bounds. A lasso logistic regression keeps few of them, and the kept rules
are summed where the statistics are counted: as one column expression, hundreds of rules nested in each other, they take
the driver hundreds of MB to compile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovewise.llm.common import text_slices
from grovewise.llm.labelled import SAMPLE_ROWS, held_out, labelled_sample, lasso_logistic
from grovewise.llm.shingles import text_bytes, words_of

#: Byte classes that are counted per text.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "mark": b"#%&*$@^~=+<>{}[]\\_`",
    "pipe": b"|", "bang": b"!?", "stop": b".", "comma": b",;:", "line": b"\n", "quote": b"\"'()-/", "high": bytes(range(128, 256)),
}
STATS = ("n_words", "word_bytes", "upper", "digit", "mark", "pipe", "bang", "stop", "comma", "line", "quote", "high", "distinct", "repeated", "common")
STAT_SCHEMA = "doc_id long, y int, " + ", ".join(f"{s} double" for s in STATS)


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, STATS): counts by word or by byte, all finite; an empty text has zeros."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    counts, filled = {}, np.flatnonzero(np.diff(offsets))
    for name, members in CLASSES.items():
        table = np.zeros(256, dtype=np.uint8)
        table[list(members)] = 1
        counts[name] = np.zeros(n, dtype=np.int64)
        if len(filled):
            counts[name][filled] = np.add.reduceat(table[data], offsets[filled], dtype=np.int64)
    words, first = words_of(texts)
    n_words = np.diff(first)
    distinct, common = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(n_words):
        w = np.sort(words[first[i] : first[i + 1]])
        cuts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        distinct[i] = len(cuts)
        common[i] = np.diff(np.append(cuts, len(w))).max()
    same = np.append(0, np.cumsum(np.append(False, words[1:] == words[:-1]))) if len(words) else np.zeros(1, np.int64)
    repeated = np.where(n_words > 0, same[first[1:]] - same[np.minimum(first[:-1] + 1, first[1:])], 0)
    by_word, size = np.maximum(n_words, 1), np.diff(offsets)
    letters = np.maximum(counts["upper"] + counts["lower"] + counts["high"] // 2, 1)
    out = {
        "n_words": n_words, "word_bytes": size / by_word, "upper": counts["upper"] / letters, "digit": counts["digit"] / np.maximum(size, 1), "high": counts["high"] / np.maximum(size, 1),
        "distinct": distinct / by_word, "repeated": repeated / by_word, "common": common / by_word,
    } | {k: counts[k] / by_word for k in ("mark", "pipe", "bang", "stop", "comma", "line", "quote")}
    return np.column_stack([np.asarray(out[s], dtype=np.float64) for s in STATS])


def _measured(labelled: bool, at_once: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", at_once):
                x = statistics(part.column("text"))
                y = part.column("y").cast(pa.int32()) if labelled else pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), y, *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=["doc_id", "y", *STATS])

    return run


def measured(docs: DataFrame, labelled: bool = False) -> DataFrame:
    """(doc_id, y, STATS) of every row; null texts are measured as empty ones."""
    text = F.col("text").cast("string").alias("text")
    return docs.select("doc_id", text, *(["y"] if labelled else [])).mapInArrow(_measured(labelled), STAT_SCHEMA)


Bound = tuple[int, bool, float]  # statistic, is it an upper bound, value
Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, prefix: str = "") -> Column:
        """The score as one expression over the statistics' columns, whose names start with ``prefix``."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for stat, below, value in rule:
                c = F.col(prefix + STATS[stat]) <= F.lit(value) if below else F.col(prefix + STATS[stat]) > F.lit(value)
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return _logistic(total)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """What ``column`` sums, in its order, for rows of statistics."""
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += np.where(holds(rule, x), weight, 0.0)
        return total


def _logistic(total: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for stat, below, value in rule:
        out &= x[:, stat] <= value if below else x[:, stat] > value
    return out


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, rule: Rule, out: dict[Rule, float]) -> list[tuple[Rule, float]]:
    """Grow one regression tree; every path goes to ``out``, the leaves with their values are returned."""
    value = float(residual.sum() / (weight.sum() + 1.0))
    best = (1e-9, None)
    if depth and len(x) >= 2 * least:
        whole = residual.sum() ** 2 / (weight.sum() + 1.0)
        for stat, edges in enumerate(cuts):
            bin_ = np.searchsorted(edges, x[:, stat], side="left")
            n = np.cumsum(np.bincount(bin_, minlength=len(edges) + 1))[:-1]
            r = np.cumsum(np.bincount(bin_, residual, len(edges) + 1))[:-1]
            h = np.cumsum(np.bincount(bin_, weight, len(edges) + 1))[:-1]
            gain = r**2 / (h + 1.0) + (residual.sum() - r) ** 2 / (weight.sum() - h + 1.0) - whole
            gain[(n < least) | (len(x) - n < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (stat, float(edges[int(gain.argmax())])))
    if best[1] is None:
        return [(rule, value)]
    stat, edge = best[1]
    left, leaves = x[:, stat] <= edge, []
    for side, below in ((left, True), (~left, False)):
        path = (*[b for b in rule if b[:2] != (stat, below)], (stat, below, edge))  # a tighter bound replaces a looser one
        out[path] = 1.0
        leaves += _grow(x[side], residual[side], weight[side], cuts, depth - 1, least, path, out)
    return leaves


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 4e-4, seed: int = 3) -> RuleModel:
    """Rules from boosted trees on half samples, weighed by a lasso; one class only gives a constant score."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return RuleModel(bias, ())
    rng = np.random.default_rng(seed)
    cuts = []
    for column in x.T:
        edges = np.unique(np.quantile(column, np.linspace(0, 1, 65)[1:-1]))
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2 if len(values) < 64 else None
        cuts.append(middle if middle is not None else edges)
    score, found = np.full(len(y), bias), {}
    least = max(3, len(y) // 500)
    for _ in range(trees):
        some = rng.permutation(len(y))[: max(1, (len(y) + 1) // 2)] if len(y) > 200 else np.arange(len(y))
        p = 1 / (1 + np.exp(-score))
        leaves = _grow(x[some], (y - p)[some], (p * (1 - p))[some], cuts, depth, least, (), found)
        for rule, value in leaves:
            if rule:
                score[holds(rule, x)] += rate * value
    rules = list(found)
    grid = np.column_stack([holds(r, x) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    distinct = np.unique(grid, axis=1, return_index=True)[1] if rules else []  # rules that hold on the same rows are one
    rules, grid = [rules[i] for i in sorted(distinct)], grid[:, sorted(distinct)] if rules else grid
    bias, weights = lasso_logistic(grid, y.astype(np.float64), penalty)
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def _rated(docs: DataFrame, model: RuleModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the model's ``log_odds`` of their texts."""
    at, kept = docs.columns.index("text"), [docs.columns.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at):
                rated = model.log_odds(statistics(part.column(at)))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(rated)], names=[*keep, "log_odds"])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[k] for k in keep], T.StructField("log_odds", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, fitted on ``labels.quality`` outside the held-out fold.

    Null texts are scored as empty ones. Repeated rows are scored each. Without labels the score is 0.5. An empty table
    gives no rows; other columns than doc_id and text are ignored.
    """
    sample = measured(labelled_sample(docs, labels, "quality", rows), labelled=True).toPandas()
    model = fit_rules(sample[list(STATS)].to_numpy(), sample["y"].to_numpy())
    scored = _rated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, ["doc_id"])
    scored = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _logistic(F.col("log_odds")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose quality score reaches ``threshold``, with all their columns, of any name.

    Scored as by ``quality``, null and empty texts and rows with a null id like others. Log odds travel beside the
    rows, so texts aren't shuffled.
    """
    sample = measured(labelled_sample(docs, labels, "quality", rows), labelled=True).toPandas()
    model = fit_rules(sample[list(STATS)].to_numpy(), sample["y"].to_numpy())
    inner = [f"c{i}" for i in range(len(docs.columns))]
    inner[docs.columns.index("text")] = "text"
    return _rated(docs.toDF(*inner), model, inner).where(_logistic(F.col("log_odds")) >= threshold).select(*inner).toDF(*docs.columns)
