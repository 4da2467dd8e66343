"""Column functions: cleaning, masking, normalising, scoring and metrics of pixels.

All of them stay in the JVM. Arrays hold the bands of a pixel in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written for missing probabilities at export only.
NODATA = -9999.0


def is_bad(x: Column) -> Column:
    """Null, NaN or infinite."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def clean_nonfinite(x: Column) -> Column:
    """NaN and infinities become 0; null stays null. Clean before comparing: NaN is above all numbers."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def clean_bands(bands: Column) -> Column:
    """``clean_nonfinite`` for each band; a null band becomes 0 too."""
    return F.transform(bands, lambda x: F.when(is_bad(x), F.lit(0.0)).otherwise(x.cast("double")))


def binarize_label(x: Column, threshold: float = 0.5) -> Column:
    """1 above the threshold, else 0, after cleaning."""
    return (clean_nonfinite(x.cast("double")) > threshold).cast("int")


def remap_class(x: Column, water: int = 0) -> Column:
    """The source's water class becomes 1, any other 0; null stays null."""
    return F.when(x == water, 1).when(x.isNotNull(), 0)


def validity(s1: Column, s1_mask: Column, aef: Column | None = None, aef_mask: Column | None = None, nodata: float | None = None) -> Column:
    """Whether a pixel counts: both masks set, every band finite, no embedding band equal to ``nodata``.

    One bad band of either source makes the pixel invalid in both.
    """
    valid = (s1_mask != 0) & ~F.exists(s1, is_bad)
    if aef is not None:
        worse = (lambda x: is_bad(x) | (x == nodata)) if nodata is not None else is_bad
        valid = valid & ~F.exists(aef, worse)
        if aef_mask is not None:
            valid = valid & (aef_mask != 0)
    return F.coalesce(valid, F.lit(False))


def fill_invalid(bands: Column, valid: Column, mean: Column) -> Column:
    """All bands of an invalid pixel become the band means, so 0 after normalising."""
    return F.when(valid, bands).otherwise(mean)


def stack_bands(s1: Column, aef: Column | None = None) -> Column:
    """Radar bands, then embedding bands."""
    s1 = s1.cast("array<double>")
    return s1 if aef is None else F.concat(s1, aef.cast("array<double>"))


def split_bands(bands: Column, n_s1: int = 3) -> tuple[Column, Column]:
    """The first ``n_s1`` bands and the rest."""
    return F.slice(bands, 1, n_s1), F.slice(bands, n_s1 + 1, F.greatest(F.size(bands) - n_s1, F.lit(0)))


def normalize(bands: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std per band."""
    return F.zip_with(F.zip_with(bands, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def mask_probability(prob: Column, valid: Column) -> Column:
    """Null where invalid."""
    return F.when(valid, prob)


def dot(bands: Column, weights: list[float]) -> Column:
    """Sum of bands times weights, in band order."""
    row = F.array(*(F.lit(float(w)) for w in weights))
    return F.aggregate(F.zip_with(bands, row, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def project_bands(aef: Column, weights: list[list[float]]) -> Column:
    """A linear map without bias: one value per row of ``weights``."""
    table = F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in weights))
    return F.transform(table, lambda row: F.aggregate(F.zip_with(aef, row, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))


def softmax_water(other: Column, water: Column) -> Column:
    """Probability of water from two logits, safe for large ones."""
    top = F.greatest(other, water)
    return F.exp(water - top) / (F.exp(other - top) + F.exp(water - top))


def argmax_water(other: Column, water: Column) -> Column:
    """1 if water's logit is greater; a tie is other."""
    return (water > other).cast("int")


def binary_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Metrics from confusion counts, 0 where nothing counts.

    ``dice`` and ``jaccard`` are means over both classes; the first three look at water alone.
    """
    one = F.lit(1)
    ratio = lambda a, b: a / F.greatest(b, one)
    iou, other_iou = ratio(tp, tp + fp + fn), ratio(tn, tn + fp + fn)
    dice, other_dice = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "water_iou": iou,
        "dice": (other_dice + dice) / 2,
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "jaccard": (other_iou + iou) / 2,
    }


def draw(seed: Column | str | int, *keys: Column, lot: str = "") -> Column:
    """A whole number below 2**28 from md5 of the seed and keys: the same on every run and engine."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = F.concat_ws(":", seed.cast("string"), *([F.lit(lot)] if lot else []), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(parts), 1, 7), 16, 10).cast("bigint")


def uniform(seed: Column | str | int, *keys: Column, lot: str = "") -> Column:
    """``draw`` as a number from 0, below 1."""
    return draw(seed, *keys, lot=lot) / float(1 << 28)


def hidden_path(path: Column) -> Column:
    """Whether a part of a relative path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
