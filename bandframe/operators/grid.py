"""Windows, blocks, flips, crops and augmentation of pixel tables.

Pixels have a key (``tile`` or ``scene_id``), row and col. Everything is arithmetic on coordinates
followed by equi-joins and grouped sums; no range join, no task that holds a whole scene.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandframe.functions.columns import draw, normalize, uniform

#: Quarter turns and flips of test-time augmentation (fixed values): name and flipped dimensions.
FLIPS = (("identity", ()), ("horizontal", ("col",)), ("vertical", ("row",)), ("both", ("row", "col")))


def starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of windows along one dimension: a step apart, the last flush with the edge.

    A dimension shorter than the window has one start, 0.
    """
    step = max(1, size - overlap)
    last = F.greatest(length - size, F.lit(0)).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def plan_windows(grids: DataFrame, size: int, overlap: int) -> DataFrame:
    """All windows of each grid: the columns of ``grids`` with top, left, h, w."""
    rows = grids.withColumn("top", F.explode(starts(F.col("height"), size, overlap)))
    rows = rows.withColumn("left", F.explode(starts(F.col("width"), size, overlap)))
    return rows.withColumn("h", F.least(F.lit(size), F.col("height"))).withColumn("w", F.least(F.lit(size), F.col("width")))


def starts_over(at: Column, length: Column, size: int, overlap: int) -> Column:
    """The starts of the windows that cover one coordinate, computed and not searched."""
    step = max(1, size - overlap)
    last = F.greatest(length - size, F.lit(0)).cast("int")
    low = F.greatest(F.ceil((at - size + 1) / F.lit(step)), F.lit(0)).cast("int")
    high = F.least(F.floor(at / F.lit(step)), F.floor(last / F.lit(step))).cast("int")
    regular = F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (k * step).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(regular, F.when(at >= last, F.array(last)).otherwise(F.array().cast("array<int>"))))


def assign_windows(pixels: DataFrame, size: int, overlap: int, height: Column | int, width: Column | int) -> DataFrame:
    """A row per pixel and window that holds it, with top and left: about (size / step)**2 rows a pixel."""
    h, w = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    rows = pixels.withColumn("top", F.explode(starts_over(F.col("row"), h, size, overlap)))
    return rows.withColumn("left", F.explode(starts_over(F.col("col"), w, size, overlap)))


def stitch(windows: DataFrame, keys: tuple[str, ...] = ("scene_id",), logits: tuple[str, ...] = ("logit0", "logit1")) -> DataFrame:
    """Mean logits of each pixel over the windows that scored it.

    Grouped by pixel, not by scene: sums combine before the shuffle and no task holds a scene. If the
    windows have an ``error``, so has the result, beside ``failed``, the number of windows that a pixel lost;
    one that lost all has null logits. Every pixel of the windows stays.
    """
    lost = [F.count("error").cast("int").alias("failed"), F.min("error").alias("error")] if "error" in windows.columns else []
    return windows.groupBy(*keys, "row", "col").agg(*(F.avg(c).alias(c) for c in logits), *lost)


def to_blocks(windows: DataFrame, size: int, n_bands: int, keys: tuple[str, ...] = ("scene_id",), bands: str = "bands") -> DataFrame:
    """One row per window, packed: keys, top, left, block, cells; for storing. ``unpack_block`` reads it.

    ``block`` is float32 planes (bands, size, size) in binary; ``cells`` a bit per cell (row by row) that
    tells which have a pixel. Others are 0, as at the bottom and right of small scenes. Pixels stream into
    the planes, so a task holds one block. Pixels with another number of bands than ``n_bands`` count as
    absent.
    """
    from bandframe.operators.score import Blocks

    names = [*keys, "top", "left", "block", "cells"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, head = Blocks(size, n_bands), []
        for part in batches:
            head = head or [part.column(i)[0] for i in range(len(keys))]
            fits = pc.fill_null(pc.equal(pc.list_value_length(part.column("bands")), n_bands), False)
            blocks.add(part.filter(fits))
        for [place], arrays, [cells], _ in blocks.lots():
            there = np.zeros(size * size, np.uint8)
            there[cells] = 1
            columns = [*(pa.repeat(k, 1) for k in head), *(pa.array([x], pa.int32()) for x in place), pa.array([arrays.tobytes()], pa.binary()), pa.array([np.packbits(there).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys)
    rows = windows.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("top", "left", "row", "col")), F.col(bands).cast("array<float>").alias("bands"))
    return rows.groupBy(*keys, "top", "left").applyInArrow(packed, f"{fields}, top int, left int, block binary, cells binary")


def unpack_block(block: bytes, cells: bytes, size: int, n_bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The planes (bands, size, size) of a packed block, and where it has pixels."""
    there = np.unpackbits(np.frombuffer(cells, np.uint8), count=size * size).reshape(size, size).astype(bool)
    return np.frombuffer(block, np.float32).reshape(n_bands, size, size), there


def flip(df: DataFrame, dims: tuple[str, ...], h: Column | int, w: Column | int) -> DataFrame:
    """Mirror local coordinates; its own inverse."""
    size = {"row": h, "col": w}
    return reduce(lambda d, c: d.withColumn(c, size[c] - 1 - F.col(c)), dims, df)


def rot90(df: DataFrame, k: Column | int, h: int, w: int) -> DataFrame:
    """``k`` quarter turns, each moving the last column to the first row."""
    k = F.pmod(k if isinstance(k, Column) else F.lit(k), F.lit(4))
    r, c = F.col("row"), F.col("col")
    row = F.when(k == 1, w - 1 - c).when(k == 2, h - 1 - r).when(k == 3, c).otherwise(r)
    col = F.when(k == 1, r).when(k == 2, w - 1 - c).when(k == 3, h - 1 - r).otherwise(c)
    return df.select("*", row.alias("_row"), col.alias("_col")).drop("row", "col").withColumnsRenamed({"_row": "row", "_col": "col"})


def random_crop(tiles: DataFrame, size: int, seed: int, epoch: int, h: int, w: int, key: str = "tile") -> DataFrame:
    """One window of ``size`` per tile and epoch, its place drawn from the key; local coordinates."""
    if h < size or w < size:
        raise ValueError(f"a crop of {size} exceeds tiles of {h} x {w}")
    k = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)))
    top = F.pmod(draw(k, F.col(key), lot="top"), F.lit(h - size + 1)).cast("int")
    left = F.pmod(draw(k, F.col(key), lot="left"), F.lit(w - size + 1)).cast("int")
    rows = tiles.withColumn("_top", top).withColumn("_left", left)
    rows = rows.where(F.col("row").between(F.col("_top"), F.col("_top") + size - 1) & F.col("col").between(F.col("_left"), F.col("_left") + size - 1))
    return rows.withColumn("row", F.col("row") - F.col("_top")).withColumn("col", F.col("col") - F.col("_left")).drop("_top", "_left")


def random_flip_rot(crops: DataFrame, seed: int, size: int, key: str = "tile") -> DataFrame:
    """Mirror columns with probability a half, then 0 to 3 quarter turns, drawn from the key."""
    mirror = F.pmod(draw(seed, F.col(key), lot="flip"), F.lit(2)) == 1
    rows = crops.withColumn("col", F.when(mirror, size - 1 - F.col("col")).otherwise(F.col("col")))
    turns = F.pmod(draw(seed, F.col(key), lot="turns"), F.lit(4))
    return rot90(rows, turns, size, size)


def gather(crops: DataFrame, wanted: DataFrame, key: str = "tile", bands: str = "bands") -> DataFrame:
    """Pixels of ``wanted`` (key, row, col, y, x: where to look) from the crop, each between its four
    neighbours, labels from the nearest. Places outside add nothing.

    Four neighbours explode to rows that are equi-joined; at most four vectors come together again for a
    pixel and are summed with their weights in a fixed order.
    """
    y0, x0 = F.floor("y"), F.floor("x")
    dy, dx = F.col("y") - y0, F.col("x") - x0
    corner = lambda n, i, j, wt: F.struct(F.lit(n).alias("n"), (y0 + i).cast("int").alias("row"), (x0 + j).cast("int").alias("col"), wt.alias("wt"))
    corners = F.array(corner(0, 0, 0, (1 - dy) * (1 - dx)), corner(1, 0, 1, (1 - dy) * dx), corner(2, 1, 0, dy * (1 - dx)), corner(3, 1, 1, dy * dx))
    asks = wanted.select(F.col(key), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.explode(F.filter(corners, lambda n: n["wt"] > 0)).alias("_n"))
    asks = asks.select(key, "to_row", "to_col", "_n.n", "_n.row", "_n.col", "_n.wt")
    hits = asks.join(crops.select(key, "row", "col", F.col(bands).cast("array<double>").alias("_bands")), [key, "row", "col"])
    parts = hits.groupBy(key, "to_row", "to_col").agg(F.array_sort(F.collect_list(F.struct("n", "wt", "_bands"))).alias("_parts"))
    weighted = lambda p: F.transform(p["_bands"], lambda b: b * p["wt"])
    rest = F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0)))
    total = F.aggregate(rest, weighted(F.get("_parts", F.lit(0))), lambda acc, p: F.zip_with(acc, p["_bands"], lambda a, b: a + b * p["wt"]))
    return parts.select(key, F.col("to_row").alias("row"), F.col("to_col").alias("col"), total.alias(bands))


#: Bytes of bands of a crop that are worked out at a time.
CHUNK_BYTES = 16 << 20
#: Pixels that a part of crops has, about: 35 MB to sort at 67 bands.
PART_PIXELS = 1 << 16
#: Up to so many parts Spark writes what a task sends straight to files; beyond, the task sorts it all in memory.
UNSORTED_PARTS = 200
#: From the parameters of a crop and its rows and columns to where its bands (y, x) and its label (y, x) lie.
Places = Callable[[dict[str, float], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def crop_parts(crops: DataFrame) -> int:
    """In how many parts crops are dealt out, by a count of their pixels.

    Parts that Spark merges are small when compressed; crops that share bands compress so well that one sort
    would hold a growing share of them. There are at most ``UNSORTED_PARTS``, or the session's number for shuffles if that
    is more; beyond, parts grow with the input.
    """
    spark = crops.sparkSession
    most = max(UNSORTED_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-crops.count() // PART_PIXELS)))


def resample(crops: DataFrame, size: int, params: dict[str, Column], places: Places, key: str = "tile", bands: str = "bands", keep_empty: bool = True, parts: int | None = None) -> DataFrame:
    """Each cell of a crop anew: bands between the four neighbours of a place, the label from the nearest pixel.

    One shuffle by crop into ``parts`` (``crop_parts``, if not told); ``params`` depend on the key alone. Pixels stream into one plane of ``size`` x ``size``,
    all that a worker holds, and cells leave in chunks. Places outside and absent pixels add nothing to bands and
    give label 0; a cell that has no neighbour at all is 0, or left out unless ``keep_empty``. A null band
    stays null in cells that look at it.
    """
    fields, names = {c: crops.schema[c].dataType.simpleString() for c in (key, "label")}, list(params)

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crop, head, given = _Crop(size), None, {}
        for part in batches:
            if head is None and part.num_rows:
                head, given = part.column(0)[0], {p: part.column(5 + i)[0].as_py() for i, p in enumerate(names)}
            crop.add(part)
        step = max(1, CHUNK_BYTES // (8 * max(crop.n_bands, 1)))
        for at in (np.arange(k, min(k + step, size * size)) for k in range(0, size * size, step)):
            row, col = at // size, at % size
            y, x, near_y, near_x = places(given, row, col)
            values, holes, seen = crop.between(y, x)
            labels = crop.nearest(near_y, near_x)
            if not keep_empty:
                values, labels, row, col, at = values[seen], labels[seen], row[seen], col[seen], at[seen]
                holes = holes[seen] if holes is not None else None
            flat = pa.array(values.reshape(-1), pa.float64(), mask=holes.reshape(-1) if holes is not None else None)
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * crop.n_bands)
            columns = [pa.repeat(head, len(at)), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.ListArray.from_arrays(ends, flat), pa.array(labels).cast(crop.label_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "row", "col", bands, "label"])

    rows = crops.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(bands).cast("array<double>").alias(bands), "label", *(c.alias(f"_{p}") for p, c in params.items()))
    rows = rows.repartition(parts or crop_parts(crops), key)
    return rows.groupBy(key).applyInArrow(resampled, f"{key} {fields[key]}, row int, col int, {bands} array<double>, label {fields['label']}")


class _Crop:
    """The pixels of one crop, filled from batches (key, row, col, bands, label, ...)."""

    def __init__(self, size: int):
        self.size, self.n_bands, self.label_type = size, 0, None
        self.values = np.zeros((size * size, 0))
        self.holes: np.ndarray | None = None
        self.there = np.zeros(size * size, bool)
        self.labels: np.ndarray | None = None

    def add(self, part: pa.RecordBatch) -> None:
        row, col = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        part = part.filter(pa.array((row >= 0) & (row < self.size) & (col >= 0) & (col < self.size)))
        at = part.column(1).to_numpy().astype(np.int64) * self.size + part.column(2).to_numpy()
        bands, labels = part.column(3), part.column(4)
        if self.labels is None:
            self.label_type = labels.type
            self.labels = np.zeros(self.size * self.size, np.float64 if pa.types.is_floating(labels.type) else np.int64)
        self.labels[at] = pc.fill_null(labels, 0).to_numpy(zero_copy_only=False)
        self.there[at] = True
        lengths = pc.fill_null(bands.value_lengths(), 0).to_numpy(zero_copy_only=False)
        if len(lengths) and (most := int(lengths.max())) > self.n_bands:
            self._widen(most, at)
        flat = bands.flatten()
        if flat.null_count == 0 and (lengths == self.n_bands).all():
            self.values[at] = flat.to_numpy().reshape(-1, self.n_bands)
            return
        cell, band = np.repeat(at, lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, int)])
        if self.holes is None:
            self.holes = np.zeros(self.values.shape, bool)
        self.holes[at] = True  # where a pixel has fewer bands than others they are null
        self.holes[cell, band] = flat.is_null().to_numpy(zero_copy_only=False)
        self.values[cell, band] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)

    def _widen(self, n_bands: int, own: np.ndarray) -> None:
        """Room for more bands than the pixels so far have, whose others are null."""
        before, old = self.there.copy(), self.n_bands
        before[own] = False
        self.values = np.concatenate([self.values, np.zeros((len(self.there), n_bands - old))], 1)
        if self.holes is not None or before.any():
            holes = np.zeros(self.values.shape, bool)
            holes[:, :old] = False if self.holes is None else self.holes
            holes[before, old:] = True
            self.holes = holes
        self.n_bands = n_bands

    def between(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Bands at places, which of them are null, and which places have a neighbour; neighbours in a fixed order."""
        y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        dy, dx = y - y0, x - x0
        total, seen = np.zeros((len(y), self.n_bands)), np.zeros(len(y), bool)
        holes = np.zeros(total.shape, bool) if self.holes is not None else None
        for i, j, weight in ((0, 0, (1 - dy) * (1 - dx)), (0, 1, (1 - dy) * dx), (1, 0, dy * (1 - dx)), (1, 1, dy * dx)):
            at, there = self._at(y0 + i, x0 + j)
            there &= weight > 0
            total[there] += self.values[at[there]] * weight[there, None]
            if holes is not None:
                holes[there] |= self.holes[at[there]]
            seen |= there
        return total, holes, seen

    def nearest(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Labels at places, 0 where there is no pixel."""
        at, there = self._at(y.astype(np.int64), x.astype(np.int64))
        return np.where(there, self.labels[at], 0)

    def _at(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (row >= 0) & (row < self.size) & (col >= 0) & (col < self.size)
        at = np.where(inside, row * self.size + col, 0)
        return at, inside & self.there[at]


def scale_jitter(crops: DataFrame, size: int, low: float, high: float, seed: int, key: str = "tile", bands: str = "bands", parts: int | None = None) -> DataFrame:
    """Resize each crop by a factor drawn from low to high, then cut or pad to ``size`` again.

    Scaled sides are ``max(32, round(size * factor))``. Bands are interpolated between pixel
    centres with edges repeated, labels are nearest. A larger crop is cut at a drawn place; a
    smaller one is placed at one, bands mirrored around it and labels 0.
    """
    factor = low + uniform(seed, F.col(key), lot="scale") * (high - low)
    side = F.greatest(F.lit(32), F.bround(factor * size).cast("int"))
    room = F.abs(side - size) + 1
    params = {"side": side, "oy": F.pmod(draw(seed, F.col(key), lot="jitter_top"), room).cast("int"), "ox": F.pmod(draw(seed, F.col(key), lot="jitter_left"), room).cast("int")}

    def places(given: dict[str, float], row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        side, ratio, sign = given["side"], float(size) / given["side"], 1 if given["side"] > size else -1
        turn = max(2 * (side - 1), 1)
        at = [i + sign * given[o] for i, o in ((row, "oy"), (col, "ox"))]
        folded = [np.minimum(i % turn, turn - i % turn) for i in at]  # mirrored around the first and last line, which aren't repeated
        centres = [np.clip((i + 0.5) * ratio - 0.5, 0.0, size - 1.0) for i in folded]
        inside = (at[0] >= 0) & (at[0] < side) & (at[1] >= 0) & (at[1] < side)
        return *centres, *(np.where(inside, np.minimum(np.floor(i * ratio), size - 1), -1) for i in at)

    return resample(crops, size, params, places, key, bands, keep_empty=False, parts=parts)


def rotate_small(crops: DataFrame, size: int, max_deg: float, p: float, seed: int, key: str = "tile", bands: str = "bands", parts: int | None = None) -> DataFrame:
    """Turn each crop with probability ``p`` by an angle up to ``max_deg`` either way, about its centre.

    Bands are interpolated and labels nearest; what comes from outside is 0.
    """
    angle = F.when(uniform(seed, F.col(key), lot="turn_p") < p, (uniform(seed, F.col(key), lot="angle") * 2 - 1) * max_deg).otherwise(0.0)
    mid = (size - 1) / 2

    def places(given: dict[str, float], row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        dy, dx, sin, cos = row - mid, col - mid, given["sin"], given["cos"]
        y, x = np.round(sin * dx + cos * dy + mid, 9), np.round(cos * dx - sin * dy + mid, 9)
        return y, x, np.rint(y), np.rint(x)

    return resample(crops, size, {"sin": F.sin(F.radians(angle)), "cos": F.cos(F.radians(angle))}, places, key, bands, parts=parts)


def radar_jitter(crops: DataFrame, gain: float, bias: float, seed: int, n_s1: int = 3, key: str = "tile", bands: str = "bands") -> DataFrame:
    """Radar bands times 1 +- gain plus +- bias, one draw per crop."""
    g = 1 + (uniform(seed, F.col(key), lot="gain") * 2 - 1) * gain
    b = (uniform(seed, F.col(key), lot="bias") * 2 - 1) * bias
    out = F.transform(bands, lambda x, i: F.when(i < n_s1, x * F.col("_g") + F.col("_b")).otherwise(x))
    return crops.withColumn("_g", g).withColumn("_b", b).withColumn(bands, out).drop("_g", "_b")


def normals(n: Column, *parts: Column | str) -> Column:
    """``n`` draws from the normal distribution, the same on every run and engine.

    An md5 of the parts and a number gives four uniform draws of 28 bits, and these four normal ones
    (Box and Muller, 1958).
    """
    hashes = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda g: F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts), g.cast("string"))))
    unit = lambda h, k: (F.conv(F.substring(h, 1 + 7 * k, 7), 16, 10).cast("double") + 0.5) / float(1 << 28)
    pair = lambda h, k: F.struct(F.sqrt(-2 * F.log(unit(h, k))).alias("r"), (2 * math.pi * unit(h, k + 1)).alias("a"))
    pairs = F.flatten(F.transform(hashes, lambda h: F.array(pair(h, 0), pair(h, 2))))
    return F.slice(F.flatten(F.transform(pairs, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"])))), F.lit(1), n)


def add_noise(crops: DataFrame, std: float, p: float, seed: int | str, key: str = "tile", bands: str = "bands") -> DataFrame:
    """Gaussian noise on every band of the crops chosen with probability ``p``.

    The noise comes from a hash of key, place and band, so a replay on other partitions is the same.
    """
    on = uniform(seed, F.col(key), lot="noise_p") < p
    drawn = normals(F.size(bands), f"{seed}:noise", *(F.col(c).cast("string") for c in (key, "row", "col")))
    return crops.withColumn(bands, F.when(on, F.zip_with(bands, drawn, lambda x, z: x + std * z)).otherwise(F.col(bands)))


def training_table(pixels: DataFrame, stats: tuple[list[float], list[float]], *, size: int, h: int, w: int, seed: int, epoch: int, scale: tuple[float, float] = (1.0, 1.0), rotate: tuple[float, float] = (0.0, 0.0), radar: tuple[float, float] = (0.0, 0.0), noise: tuple[float, float] = (0.0, 0.0), key: str = "tile") -> DataFrame:
    """Training pixels of one epoch: a crop per tile, augmented and normalised.

    ``pixels`` has key, row, col, bands, label. Steps whose range is nothing are left out.
    """
    draw_seed = f"{seed}:{epoch}"
    rows = random_crop(pixels, size, seed, epoch, h, w, key)
    rows = random_flip_rot(rows, draw_seed, size, key)
    resized, turned = scale != (1.0, 1.0), rotate[0] > 0 and rotate[1] > 0
    parts = crop_parts(rows) if resized or turned else None  # counted once: a whole crop has as many pixels when resized
    if resized:
        rows = scale_jitter(rows, size, *scale, draw_seed, key, parts=parts)
    if turned:
        rows = rotate_small(rows, size, *rotate, draw_seed, key, parts=parts)
    if radar != (0.0, 0.0):
        rows = radar_jitter(rows, *radar, draw_seed, key=key)
    if noise[0] > 0 and noise[1] > 0:
        rows = add_noise(rows, *noise, draw_seed, key)
    return validation_table(rows, stats)


def validation_table(pixels: DataFrame, stats: tuple[list[float], list[float]]) -> DataFrame:
    """Whole tiles, normalised and not augmented."""
    mean, std = (F.array(*(F.lit(float(x)) for x in s)) for s in stats)
    return pixels.withColumn("bands", normalize(F.col("bands"), mean, std))
