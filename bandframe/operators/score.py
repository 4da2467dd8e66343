"""Scoring: linear heads in columns, block functions of the user, flips averaged, a fitted classifier."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandframe.functions.columns import dot, softmax_water
from bandframe.operators.evaluate import best_threshold, threshold_sweep, union_sweeps
from bandframe.operators.grid import FLIPS


def score_pixels(pixels: DataFrame, head: tuple[list[float], list[float]], bias: tuple[float, float] = (0.0, 0.0), bands: str = "bands") -> DataFrame:
    """Two logits per pixel from a linear head over its bands (radar alone, or with the embedding).

    A head that looks at one pixel gives the same in every window and flip, so none is needed.
    """
    logits = (dot(F.col(bands), w) + F.lit(float(b)) for w, b in zip(head, bias))
    return pixels.select("*", *(x.alias(f"logit{i}") for i, x in enumerate(logits)))


BlockScorer = Callable[[np.ndarray], np.ndarray]


def run_blocks(arrays: np.ndarray, fn: BlockScorer, tta: str | None = None) -> np.ndarray:
    """Scores (n, 2, size, size) of blocks (n, bands, size, size), flips averaged if asked for.

    ``tta`` is ``logit_mean``, the mean of logits, or ``prob_mean``, the mean of probabilities, which
    is returned as logits of the mean.
    """
    if tta is None:
        return fn(arrays)
    if tta not in ("logit_mean", "prob_mean"):
        raise ValueError(f"unknown tta: {tta}")
    axes = {"row": -2, "col": -1}
    total = 0.0
    for _, dims in FLIPS:
        turn = tuple(axes[d] for d in dims)
        out = np.flip(fn(np.flip(arrays, turn)), turn)
        if tta == "prob_mean":
            out = np.exp(out - out.max(1, keepdims=True))
            out = out / out.sum(1, keepdims=True)
        total = total + out
    mean = total / len(FLIPS)
    return np.log(np.maximum(mean, 1e-12)) if tta == "prob_mean" else mean


#: Bytes of blocks that go to a scorer at a time, at most (one block may exceed it).
BATCH_BYTES = 512 << 20


def score_blocks(windows: DataFrame, fn: BlockScorer, size: int, n_bands: int, tta: str | None = None, batch: int = 4, overlap: int = 0, keys: tuple[str, ...] = ("scene_id",), bands: str = "bands") -> DataFrame:
    """Logits per pixel and window from a function of blocks: keys, top, left, row, col, logit0, logit1, error.

    ``windows`` has a row per pixel and window (``assign_windows``). Up to ``batch`` neighbouring windows
    of a row of windows form a group, whose pixels stream into float32 planes (n, bands, size, size) as
    they come, and go to ``fn`` together, ``BATCH_BYTES`` at most; a worker holds these planes and little
    else. Cells without pixel are 0, as at the bottom and right of a small scene.

    If ``fn`` fails, each block of the group is tried alone. The pixels of a block that fails have null
    logits and the text in ``error``, so ``stitch`` knows which pixels lost a window. A pixel whose number
    of bands isn't ``n_bands`` fails its block. ``overlap`` is that of the windows.
    """
    each = max(1, min(batch, BATCH_BYTES // (4 * n_bands * size * size)))
    step = max(1, size - overlap)
    fields = ", ".join(f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "top", "left", "row", "col", "logit0", "logit1", "error"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(size, n_bands, each)
        head: list[pa.Scalar] = []
        for part in batches:
            head = head or [part.column(i)[0] for i in range(len(keys))]
            blocks.add(part)
        for places, arrays, cells, wrong in blocks.lots():
            out = _scores(arrays, fn, tta, wrong)
            for (top, left), at, got in zip(places, cells, out):
                n, failed = len(at), isinstance(got, str)
                logits = [pa.nulls(n, pa.float64())] * 2 if failed else [pa.array(got[k].reshape(-1)[at], pa.float64()) for k in (0, 1)]
                row, col = (at // size + top).astype(np.int32), (at % size + left).astype(np.int32)
                error = pa.repeat(pa.scalar(got if failed else None, pa.string()), n)
                columns = [*(pa.repeat(k, n) for k in head), *(pa.repeat(pa.scalar(x, pa.int32()), n) for x in (top, left)), pa.array(row), pa.array(col), *logits, error]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    lots = windows.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("top", "left", "row", "col")), F.col(bands).cast("array<float>").alias("bands"))
    lots = lots.groupBy(*keys, "top", F.floor(F.ceil(F.col("left") / step) / each).alias("_lot"))
    return lots.applyInArrow(scored, f"{fields}, top int, left int, row int, col int, logit0 double, logit1 double, error string")


class Blocks:
    """The planes of the windows of a group, filled from batches of pixels (keys, top, left, row, col, bands)."""

    def __init__(self, size: int, n_bands: int, each: int = 1):
        self.size, self.n_bands, self.each = size, n_bands, each
        self.number: dict[tuple[int, int], int] = {}
        self.planes: list[np.ndarray] = []
        self.there: list[np.ndarray] = []
        self.wrong: set[int] = set()

    def add(self, part: pa.RecordBatch) -> None:
        top, left, row, col = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("top", "left", "row", "col"))
        bands = part.column(part.schema.get_field_index("bands"))
        sizes = bands.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        fits = sizes == self.n_bands
        values = bands.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.n_bands)
        nth = np.cumsum(fits) - 1
        at = (row - top) * self.size + col - left
        for t, le in sorted(set(zip(top.tolist(), left.tolist()))):
            k = self.number.setdefault((t, le), len(self.number))
            while len(self.there) <= k:
                if len(self.there) % self.each == 0:
                    self.planes.append(np.zeros((self.each, self.n_bands, self.size * self.size), np.float32))
                self.there.append(np.zeros(self.size * self.size, bool))
            own = np.flatnonzero((top == t) & (left == le))
            self.there[k][at[own]] = True
            if not fits[own].all():
                self.wrong.add(k)
            own = own[fits[own]]
            self.planes[k // self.each][k % self.each][:, at[own]] = values[nth[own]].T

    def lots(self) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, list[np.ndarray], list[bool]]]:
        """Places, blocks, cells that have a pixel, and which blocks are wrong, a lot at a time."""
        places = list(self.number)
        for k, planes in enumerate(self.planes):
            own = range(k * self.each, min((k + 1) * self.each, len(places)))
            arrays = planes[: len(own)].reshape(-1, self.n_bands, self.size, self.size)
            yield [places[i] for i in own], arrays, [np.flatnonzero(self.there[i]) for i in own], [i in self.wrong for i in own]


def _scores(arrays: np.ndarray, fn: BlockScorer, tta: str | None, wrong: list[bool]) -> list[np.ndarray | str]:
    """The scores of each block, or what went wrong with it."""
    if not any(wrong):
        try:
            return list(run_blocks(arrays, fn, tta))
        except Exception as e:
            if len(arrays) == 1:
                return [f"{type(e).__name__}: {e}"]
    out: list[np.ndarray | str] = []
    for n, bad in enumerate(wrong):  # find the block that fails
        out += ["unexpected number of bands"] if bad else _scores(arrays[n : n + 1], fn, tta, [False])
    return out


def tta_average(pixels: DataFrame, scorer: Callable[[DataFrame], DataFrame], mode: str | tuple[str, ...], h: int, w: int, keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Score four flips of each tile and average them back: keys, row, col, prob; with several modes a
    column of the name of each.

    ``scorer`` maps a table of pixels (keys, flip, row, col, ...) to one with logit0 and logit1 and
    may look at neighbours within (keys, flip). ``logit_mean`` averages logits before the softmax,
    ``prob_mean`` probabilities after it.
    """
    modes = (mode,) if isinstance(mode, str) else mode
    if unknown := set(modes) - {"logit_mean", "prob_mean"}:
        raise ValueError(f"unknown mode: {sorted(unknown)}")
    size = {"row": h, "col": w}
    place = lambda c, dims: (size[c] - 1 - F.col(c) if c in dims else F.col(c)).cast("int").alias(c)
    turns = F.array(*(F.struct(F.lit(name).alias("flip"), place("row", dims), place("col", dims)) for name, dims in FLIPS))
    turned = pixels.withColumn("_turn", F.explode(turns)).drop("row", "col", "flip").select("*", "_turn.*").drop("_turn")
    scored = scorer(turned)  # one scan, a row for each flip
    back = F.array(*(F.struct(F.lit(name).alias("flip"), place("row", dims), place("col", dims)) for name, dims in FLIPS))
    at = F.filter(back, lambda t: t["flip"] == F.col("flip"))[0]
    rows = scored.select(*keys, at.alias("_at"), "logit0", "logit1")
    l0, l1 = F.avg("logit0"), F.avg("logit1")
    means = {"logit_mean": softmax_water(l0, l1), "prob_mean": F.avg(softmax_water(F.col("logit0"), F.col("logit1")))}
    out = rows.select(*keys, "_at.row", "_at.col", "logit0", "logit1").groupBy(*keys, "row", "col")
    return out.agg(*(means[m].alias("prob" if isinstance(mode, str) else m) for m in modes))


def features(kind: str, bands: Column | str = "bands", n_s1: int = 3) -> Column:
    """The bands that a model looks at: ``s1`` or ``s1aef``."""
    if kind not in ("s1", "s1aef"):
        raise ValueError(f"unknown features: {kind}")
    bands = F.col(bands) if isinstance(bands, str) else bands
    return F.slice(bands, 1, n_s1) if kind == "s1" else bands


@dataclass(frozen=True)
class PixelModel:
    """A fitted classifier of single pixels as a function from its bands to the log odds of water.

    Scoring is a Column expression: no model object goes to the tasks, and Catalyst prunes and pushes
    filters as for any other.
    """

    kind: str
    log_odds: Callable[[Column], Column]

    def probability(self, bands: Column) -> Column:
        """The probability of water; ``bands`` are all bands of a pixel."""
        score = self.log_odds(bands)
        return F.when(score >= 0, 1 / (1 + F.exp(-score))).otherwise(F.exp(score) / (1 + F.exp(score)))


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _literals(values: Iterable[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _gaussian(rows: DataFrame) -> Callable[[Column], Column]:
    """Log odds of a Gaussian naive Bayes model: moments of each band by class, in one pass."""
    from pyspark.ml.stat import Summarizer

    stats = rows.groupBy("label").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s"))
    found = {int(r["label"]): r["s"] for r in stats.collect()}  # a row per class
    if set(found) != {0, 1}:
        raise ValueError("both classes are needed")
    total, parts = sum(s["count"] for s in found.values()), {}
    for c, s in found.items():
        variance = np.maximum(s["variance"].toArray() * (s["count"] - 1) / s["count"], 1e-6)
        parts[c] = (s["mean"].toArray(), 1 / (2 * variance), math.log(s["count"] / total) - 0.5 * float(np.log(variance).sum()))

    def log_odds(bands: Column) -> Column:
        def likelihood(c: int) -> Column:
            mean, weight, start = parts[c]
            apart = F.zip_with(bands, _literals(mean), lambda x, m: (x - m) * (x - m))
            return F.lit(start) - _sum_of(F.zip_with(apart, _literals(weight), lambda d, w: d * w))

        return likelihood(1) - likelihood(0)

    return log_odds


def _tree(node, bands: Column) -> Column:  # noqa: ANN001
    """A node of a fitted tree as nested conditions."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(bands, F.lit(split.featureIndex())) <= split.threshold(), _tree(node.leftChild(), bands)).otherwise(_tree(node.rightChild(), bands))


def fit_pixel_classifier(pixels: DataFrame, kind: str = "s1aef", label: str = "label", seed: int = 0, model: str = "logistic") -> PixelModel:
    """A classifier of single pixels, trained on ``pixels`` (bands, label 0 or 1) over all of them.

    ``model`` is ``logistic`` (MLlib), ``trees`` (MLlib's boosted trees) or ``gaussian`` (naive Bayes, whose
    variances are at least 1e-6); what was fitted becomes a Column expression. Pixels without label don't count.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = pixels.where(F.col(label).isNotNull()).select(array_to_vector(features(kind).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    own = lambda bands: features(kind, bands)
    if model == "gaussian":
        log_odds = _gaussian(rows)
        return PixelModel(kind, lambda bands: log_odds(own(bands)))
    if model == "logistic":
        fitted = LogisticRegression(maxIter=30, regParam=1e-3).fit(rows)
        weights, start = fitted.coefficients.toArray(), float(fitted.intercept)
        return PixelModel(kind, lambda bands: _sum_of(F.zip_with(own(bands), _literals(weights), lambda x, w: x * w)) + start)
    if model == "trees":
        fitted = GBTClassifier(seed=seed, maxIter=10).fit(rows)
        trees = list(zip(fitted.treeWeights, fitted.trees))
        return PixelModel(kind, lambda bands: 2 * sum((_tree(t._java_obj.rootNode(), own(bands)) * float(w) for w, t in trees), F.lit(0.0)))
    raise ValueError(f"unknown model: {model}")


def predict_pixels(fitted: PixelModel, pixels: DataFrame, bands: str = "bands") -> DataFrame:
    """``pixels`` with ``prob``, the classifier's probability of water."""
    return pixels.withColumn("prob", fitted.probability(F.col(bands)))


def compare_features(train: DataFrame, held: DataFrame, kinds: tuple[str, ...] = ("s1", "s1aef"), label: str = "label", model: str = "logistic", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same classifier with radar alone and with the embedding, measured on held-out pixels.

    Returns the sweeps of thresholds, ``eval_mode`` being the features, and the best threshold of each.
    """
    sweeps = [threshold_sweep(predict_pixels(fit_pixel_classifier(train, k, label, seed, model), held), mode=k, truth=label) for k in kinds]
    both = union_sweeps(*sweeps)
    return both, best_threshold(both)
