"""A quality classifier as a sparse rule ensemble, compiled into Spark columns.

Each text is described by statistics of its characters, words and lines.  Small boosted trees are grown on a bounded sample of labelled rows; every
path from a root to a node is a rule, a conjunction of at most three comparisons of a statistic with a
threshold.  A logistic model over the rules with a lasso penalty keeps few of them.  The model is then a Spark column: an
intercept plus the weights of the rules that hold, through the logistic function.

The statistics are computed in one pass over the texts; ids, labels, languages and sources are no part of a score.

Results for odd input: a null or empty text has all statistics 0 and a score like any other text; repeated rows give
repeated results; of different texts under one labelled id the one with the least statistics teaches; labels that are null are left out; without labels, or with labels of one kind, the score is the
smoothed share of label 1 (0.5 without any); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewire.llm.labelled import SAMPLE, held_out, teaching_sample
from tidewire.llm.shared import slices, text_of
from tidewire.staging import staged

STATISTICS = [
    "chars", "words", "word_length", "letters", "capitals", "digits", "punctuation", "symbols", "exclamations", "bars", "capital_words",
    "distinct_words", "repeats", "top_word", "lines", "line_length", "distinct_lines", "line_words", "line_ends", "long_words", "symbol_ends",
]
THRESHOLD = 0.3
TREES, DEPTH, BINS = 24, 3, 32

_CODES = np.arange(256)
_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_CAPITAL = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_PUNCTUATION = np.isin(_CODES, [ord(c) for c in ".,;:?!'\"()-"])
_SYMBOL = np.isin(_CODES, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"])


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        return [0.0] * len(STATISTICS)
    found = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, count, letters, counted = int(found.sum()), len(words), int(found[_LETTER].sum()), Counter(words)
    return [
        float(len(text)), float(count), sum(map(len, words)) / count, letters / n, float(found[_CAPITAL].sum()) / max(1, letters), float(found[_DIGIT].sum()) / n,
        float(found[_PUNCTUATION].sum()) / n, float(found[_SYMBOL].sum()) / n, float(found[33]) / count, float(found[124]) / count, sum(map(str.isupper, words)) / count,
        len(counted) / count, sum(map(eq, words, words[1:])) / count, max(counted.values()) / count, float(len(lines)), len(text) / len(lines), len(set(lines)) / len(lines),
        count / len(lines), sum(x.rstrip()[-1] in ".!?…\"'" for x in lines) / len(lines), sum(len(w) > 20 for w in words) / count, sum(w[-1] in "#$%&*|" for w in words) / count,
    ]


def with_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, one double a statistic) of every row, in one pass without a shuffle."""
    chosen = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float64).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v) for v in values.T]], ["id", *STATISTICS])

    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A comparison (statistic, whether above, threshold); a rule is a conjunction of them.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: dict[Rule, float]

    def column(self) -> Column:
        """The score as a column over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights.items():
            holds = F.lit(True)
            for name, above, at in rule:
                holds = holds & (F.col(name) > at if above else F.col(name) <= at)
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """The paths of boosted regression trees on the logistic gradient, each tree on half of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for v in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    margin, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    for _ in range(trees):
        p = _sigmoid(margin)
        gradient, curvature = y - p, p * (1 - p) + 1e-6
        drawn = rng.random(len(y)) < 0.5
        names = np.flatnonzero(rng.random(x.shape[1]) < 0.5)
        nodes: list[tuple[np.ndarray, Rule]] = [(np.ones(len(y), bool), ())]
        for level in range(depth):
            grown = []
            for inside, rule in nodes:
                best, use = None, inside & drawn
                g, h = gradient[use], curvature[use]
                for f in names:
                    bins = binned[use, f]
                    gs, hs = np.cumsum(np.bincount(bins, g, len(cuts[f]) + 1))[:-1], np.cumsum(np.bincount(bins, h, len(cuts[f]) + 1))[:-1]
                    if not len(gs):
                        continue
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    k = int(gain.argmax())
                    if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k)
                if best is None:
                    continue
                _, f, k = best
                above = binned[:, f] > k
                for side in (False, True):
                    child = inside & (above == side)
                    if child.sum() >= 5:
                        grown.append((child, (*rule, (STATISTICS[f], side, float(cuts[f][k])))))
            rules += [rule for _, rule in grown]
            if level == depth - 1 or not grown:
                for inside, _ in grown or nodes:
                    margin[inside] += 0.3 * gradient[inside].sum() / (curvature[inside].sum() + 1)
            nodes = grown
            if not grown:
                break
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, at in rule:
        v = x[:, STATISTICS.index(name)]
        out &= v > at if above else v <= at
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient."""
    n, k = z.shape
    design = np.hstack([np.ones((n, 1), np.float32), z.astype(np.float32)])
    rate = 4 * n / max(1.0, float(np.linalg.norm(design.T @ design, 2)))
    w = np.zeros(k + 1)
    w[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        step = ahead + rate * (design.T @ (y - _sigmoid(design @ ahead))) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleModel:
    """A rule model from statistics and labels 0 and 1."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), {})
    rules = grow_rules(x, y)
    if not rules:
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {})
    intercept, weights = lasso_logistic(np.stack([holds(r, x) for r in rules], 1), y, penalty)
    return RuleModel(intercept, {r: float(w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6})


def _fitted(described: DataFrame, known: DataFrame) -> RuleModel:
    """The model of the described rows that have a label in ``known``, the least row of each id, in the order of a hash of the ids."""
    taught = described.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    rows = taught.select(F.xxhash64("id").alias("mark"), "id", "s.*", "label").collect()  # one row a labelled id of the sample
    rows.sort(key=lambda r: (r["mark"], r["id"]))
    values = np.array([r[2:] for r in rows], np.float64).reshape(-1, len(STATISTICS) + 1)
    return fit(values[:, :-1], values[:, -1])


def score_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row.

    The statistics are written once; fitting reads ``sample`` labelled rows of them at most.
    """
    described = staged(with_statistics(docs, key=key, text=text), "statistics")
    model = _fitted(described, teaching_sample(labels, "quality", sample, key=key))
    scored = described.withColumn("score", model.column())
    return scored.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text is not predicted as label 0; ids serve the labels alone.

    Fitting describes the labelled sample only; every row is then described and judged in one pass without a shuffle.
    """
    known = staged(teaching_sample(labels, "quality", sample, key=key), "teaching")
    labelled = docs.join(F.broadcast(known), docs[key] == known["id"], "left_semi")
    model = _fitted(with_statistics(labelled, key=key, text=text), known)
    names, at = [f"__{i}" for i in range(len(docs.columns))], docs.columns.index(text)
    carried = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = np.array([statistics("" if t is None else str(t)) for t in b.column(at).to_pylist()], np.float64).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v) for v in values.T]], [*names, *STATISTICS])

    described = carried.mapInArrow(run, StructType([*carried.schema, *[StructField(s, DoubleType()) for s in STATISTICS]]))
    return described.where(model.column() >= threshold).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
