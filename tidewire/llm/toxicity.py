"""Toxicity by a classifier chain.

Categories are predicted one after another: ``kind_1`` .. ``kind_3`` and last ``toxic``.  Each link is a linear
logistic model over the words and word beginnings of a text and over the probabilities of the links before it.  While the
chain is trained these probabilities are out-of-fold predictions, so a later link learns from what earlier links say of texts that they
have not seen; folds are dealt by the text itself, so copies lie in one fold.

The table of labels has one label a text, toxic or not.  The kinds come from the data: the toxic texts of the sample are
clustered by the features that they hold, and the clusters, the largest first, are the categories; the last link learns the label
itself.  The threshold is the one that parts its out-of-fold predictions best, raised to where they bear out that no more than a share of
``FALSE_ALARMS`` of the clean texts lies above it; a sample too small to show that leaves the upper end of ``THRESHOLDS``, one half.  Features are chosen from counts over a bounded sample of labelled texts (``labelled.SAMPLE``): those that many toxic texts and few
others hold.

Results for odd input: a null or empty text has no features and gets the intercept's probability; repeated rows give repeated
results; of different texts under one labelled id the one with the least hash teaches; without labels, or with labels of
one kind, no text is toxic; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.labelled import SAMPLE, teaching_sample
from tidewire.llm.shared import slices, text_of
from tidewire.staging import staged

KINDS = 3
CATEGORIES = [*[f"kind_{k + 1}" for k in range(KINDS)], "toxic"]
FOLDS = 5
THRESHOLDS = (0.05, 0.5)
#: No more than this share of the clean texts may be called toxic, as out-of-fold predictions tell.
FALSE_ALARMS = 0.001
CANDIDATES = 20_000
FEATURES = 1024
PREFIXES = (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_"


def features(text: str) -> set[str]:
    """The distinct words of a text; their beginnings, marked by a bar, or two where several words share one."""
    words = {w.strip(EDGES) for w in set(text.lower().split())}
    out = set(words)
    for k in PREFIXES:
        shared = Counter(w[:k] for w in words if len(w) > k)
        out.update(b + "|" for b in shared)
        out.update(b + "||" for b, n in shared.items() if n > 1)
    out.discard("")
    return out


def _counted(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(feature, ones, zeros): in how many texts of each label a feature occurs."""
    share = sample.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = [pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())]
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays(out, ["feature", "ones", "zeros"])

        for b in slices(batches):
            for t, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                found = features(t)
                counts[label].update(found if share.value is None else found & share.value)
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield told()
        yield told()

    each = sample.select("text", "label").mapInArrow(run, "feature string, ones long, zeros long")
    return each.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


@dataclass
class Chain:
    """Weights of each link: over the features, over earlier probabilities, and the intercept; the probability from which a text is toxic."""

    index: dict[str, int]
    links: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)
    threshold: float = 0.5
    unseen: np.ndarray | None = None  # the last link's out-of-fold predictions

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities, texts x categories."""
        out = np.zeros((len(texts), len(self.links)))
        for i, t in enumerate(texts):
            at = [self.index[f] for f in features(t) if f in self.index]
            for k, (own, earlier, intercept) in enumerate(self.links):
                out[i, k] = 1 / (1 + np.exp(-np.clip(intercept + own[at].sum() + out[i, :k] @ earlier, -30, 30)))
        return out


def logistic(rows: np.ndarray, at: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, penalty: float = 2e-4, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """A ridge logistic model by accelerated gradient steps; features are given as (row, feature) pairs, ``extra`` is dense."""
    n, k = len(y), extra.shape[1]
    direction = np.ones(width + k + 1)
    for _ in range(30):  # the largest singular value sets the step
        z = np.bincount(rows, direction[at], n) + extra @ direction[width:-1] + direction[-1]
        direction = np.concatenate([np.bincount(at, z[rows], width), extra.T @ z, [z.sum()]])
        size = np.linalg.norm(direction)
        direction /= size
    rate = 4 * n / (1.2 * size)
    w = np.zeros(width + k + 1)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(rows, ahead[at], n) + extra @ ahead[width:-1] + ahead[-1]
        gap = y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = np.concatenate([np.bincount(at, gap[rows], width), extra.T @ gap, [gap.sum()]]) / n
        slope[:-1] -= penalty * ahead[:-1]
        new = ahead + rate * slope
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:width], w[width:-1], float(w[-1])


def threshold_of(unseen: np.ndarray, y: np.ndarray) -> float:
    """The probability, within ``THRESHOLDS``, that parts out-of-fold predictions with the fewest errors; amid a gap where there is one."""
    order = np.argsort(unseen, kind="stable")
    p, ones = unseen[order], np.concatenate([[0], np.cumsum(y[order])])
    errors = ones + (len(y) - np.arange(len(y) + 1)) - (ones[-1] - ones)  # ones below the cut, zeros above it
    errors[1:-1][p[1:] == p[:-1]] = len(y) + 1
    logit = np.log(np.concatenate([[THRESHOLDS[0]], p, [1]]) + 1e-9)
    widths = np.where(errors == errors.min(), np.diff(logit), -1.0)
    at = int(widths.argmax())
    return float(np.clip(np.exp((logit[at] + logit[at + 1]) / 2), *THRESHOLDS))


def quiet_threshold(unseen: np.ndarray, y: np.ndarray, share: float = FALSE_ALARMS) -> float:
    """The least probability within ``THRESHOLDS`` at which the share of clean texts above it, with one more than were seen, is ``share`` at most; the upper end if none is."""
    clean = np.sort(unseen[y == 0])
    allowed = int(np.floor(share * (len(clean) + 1))) - 1  # clean texts that may lie above
    if allowed < 0:
        return THRESHOLDS[1]
    highest = clean[len(clean) - 1 - allowed] if allowed < len(clean) else 0.0
    return float(np.clip(np.nextafter(highest, 1), *THRESHOLDS))


def clusters(held: list[list[int]], width: int, k: int = KINDS, rounds: int = 30) -> np.ndarray:
    """The cluster of each text by the features it holds: k-means by cosine from seeds far apart, the largest cluster first."""
    x = np.zeros((len(held), width))
    for i, own in enumerate(held):
        x[i, own] = 1
    x /= np.maximum(1, np.linalg.norm(x, axis=1, keepdims=True))
    seeds = [int((x @ x.sum(0)).argmax())]
    while len(seeds) < min(k, len(held)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    centres, of = x[seeds], None
    for _ in range(rounds):
        new = (x @ centres.T).argmax(1)
        if of is not None and (new == of).all():
            break
        of = new
        centres = np.stack([x[of == c].sum(0) for c in range(len(seeds))])
        centres /= np.maximum(1e-9, np.linalg.norm(centres, axis=1, keepdims=True))
    sizes = np.bincount(of, minlength=len(seeds))
    rank = np.argsort(np.argsort(-sizes, kind="stable"), kind="stable")
    return rank[of]


def fit_chain(index: dict[str, int], held: list[list[int]], targets: np.ndarray, fold: np.ndarray) -> Chain:
    """A chain from the features that each text holds, its 0/1 targets (texts x categories) and its fold."""
    chain, n = Chain(index), len(held)
    rows, at = np.repeat(np.arange(n), [len(x) for x in held]), np.array([f for x in held for f in x], np.int64)
    outside = np.zeros((n, 0))
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(np.float64)
        link = logistic(rows, at, outside, y, len(index))
        chain.links.append(link)
        unseen = np.full(n, (y.sum() + 1) / (n + 2))
        for f in np.unique(fold):
            others = fold != f
            if not others.any():
                continue  # all texts in one fold: the share of ones stands in
            use, place = others[rows], np.cumsum(others) - 1
            own, earlier, intercept = logistic(place[rows[use]], at[use], outside[others], y[others], len(index))
            score = np.bincount(rows, own[at], n) + outside @ earlier + intercept
            unseen[~others] = 1 / (1 + np.exp(-np.clip(score[~others], -30, 30)))
        outside = np.hstack([outside, unseen[:, None]])
    chain.unseen = outside[:, -1]
    chain.threshold = threshold_of(chain.unseen, targets[:, -1])
    return chain


def targets_of(held: list[list[int]], labels: np.ndarray, width: int) -> np.ndarray:
    """0/1 targets, texts x categories: a kind is toxic and in its cluster."""
    out = np.zeros((len(held), len(CATEGORIES)), int)
    toxic = np.flatnonzero(labels)
    out[toxic, -1] = 1
    out[toxic, clusters([held[i] for i in toxic], width)] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Chain | None:
    """The chain, or None where the labels hold one kind only."""
    known = F.broadcast(teaching_sample(labels, "toxic", sample, key=key))
    taught = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text")).join(known, "id")
    least = F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("least")
    taught = staged(taught.groupBy("id", "label").agg(least).select("id", "label", "least.mark", "least.text"), "teaching")
    totals = dict(taught.groupBy("label").count().collect())
    if len(totals) < 2:
        return None
    often = _counted(taught.where("label = 1"), None).where("ones > 2").orderBy(F.desc("ones"), "feature").limit(CANDIDATES)
    counted = _counted(taught, frozenset(r["feature"] for r in often.collect())).collect()

    def weight(r) -> tuple[float, str]:
        ones, zeros = r["ones"] / totals[1], r["zeros"] / totals[0]
        return (-ones * np.log((ones + 1e-3) / (zeros + 1e-3)), r["feature"])

    index = {r["feature"]: i for i, r in enumerate(sorted(counted, key=weight)[:FEATURES])}
    share = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = [sorted(share.value[f] for f in features(t) if f in share.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), b.column("label"), pa.array(held, pa.list_(pa.int64()))], ["id", "mark", "label", "held"])

    rows = taught.mapInArrow(run, f"id {dict(taught.dtypes)['id']}, mark long, label int, held array<long>").collect()  # one row a labelled id of the sample
    rows.sort(key=lambda r: (r["mark"], r["id"]))
    held, told = [r["held"] for r in rows], np.array([r["label"] for r in rows])
    chain = fit_chain(index, held, targets_of(held, told, len(index)), np.array([r["mark"] % FOLDS for r in rows]))
    chain.threshold, chain.unseen = max(chain.threshold, quiet_threshold(chain.unseen, told)), None
    return chain


def score_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, one probability a category as p_<category>, toxic boolean) of every whole text; the threshold is the chain's own where none is given."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample=sample, key=key, text=text))
    chosen = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = np.zeros((b.num_rows, len(CATEGORIES))) if chain.value is None else chain.value.predict(b.column("text").to_pylist())
            toxic = p[:, -1] >= 2 if chain.value is None else p[:, -1] >= (chain.value.threshold if threshold is None else threshold)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(x) for x in p.T], pa.array(toxic)], ["id", *[f"p_{c}" for c in CATEGORIES], "toxic"])

    columns = ", ".join(f"p_{c} double" for c in CATEGORIES)
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, {columns}, toxic boolean").withColumnRenamed("id", key)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text is not toxic; ids serve the labels alone."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample=sample, key=key, text=text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if chain.value is not None:
                p = chain.value.predict(["" if t is None else str(t) for t in b.column(at).to_pylist()])
                b = b.filter(pa.array(p[:, -1] < (chain.value.threshold if threshold is None else threshold)))
            yield b

    return docs.mapInArrow(run, docs.schema)
