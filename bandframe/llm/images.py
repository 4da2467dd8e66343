"""Copies of images by local descriptors: cropped or edited copies meet in Hamming tables and must
agree on one similarity transform."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandframe.llm.components import link_buckets
from bandframe.llm.store import cut, drop, shuffles_freed, tidy

#: Pyramid steps, patch radius, binary tests, directions, and tables with the bits of each.
SCALES, RADIUS, TESTS, TURNS, TABLES, TABLE_BITS = tuple(1.13**-k for k in range(7)), 7, 256, 64, 6, 40
#: How far apart the ends of tests lie: standard deviation and greatest distance from the corner. Tests over
#: short distances tell few corners from others; these part unrelated pictures with half the bits.
SPREAD, REACH = 8, 12
#: Bits that may differ between two places that match, and pixels that a place may be off.
NEAR, OFF = 56, 2.5
#: Bits that may differ between two places for a key that both have to be a sign of a copy: ``NEAR`` and some to spare;
#: and for one that is nearly sure.
SIGN, SURE = NEAR + 8, NEAR - 16
#: Places that must agree: so many, and this part of those of the image that has fewer.
NEEDED, PART = 5, 0.15
#: Buckets of so many images give a row for each pair; in larger ones tasks compare the places.
SMALL = 32
#: Places that come together in a task by their keys, places of one key of which pairs are told apart, and places that are compared there.
BLOCK, TOLD, RUN = 1 << 16, 256, 1 << 13
#: Pairs that get the places of both images at a time, if there aren't more images than that.
PAIRS_AT_ONCE = 1 << 16
#: Pixels of images that are described in one go.
LOT = 1 << 16
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", TESTS // 8)])
#: A place on its way to those of the same key: its image, the bytes of all places of that, and its tests.
SENT = np.dtype([("node", "<i8"), ("weight", "<i4"), ("bits", "u1", TESTS // 8)])
MEMBERS = "bucket long, part int, node long, weight long"


def _pattern(seed: int = 7) -> np.ndarray:
    """The tests, turned into each direction: (turn, test, end, coordinate) as whole offsets."""
    pairs = np.clip(np.random.default_rng(seed).normal(0, SPREAD, (TESTS, 2, 2)), -REACH, REACH)
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.cos(angle), -np.sin(angle), np.sin(angle), np.cos(angle)], 1).reshape(TURNS, 2, 2)
    return np.rint(np.einsum("tij,nej->tnei", turn, pairs)).astype(np.int64)


PATTERN = _pattern()
#: Pixels that a turned test reaches beyond those that corners keep from the edge.
BEYOND = int(abs(PATTERN).max()) - RADIUS
#: Which tests each table reads.
READS = [np.sort(np.random.default_rng(100 + t).choice(TESTS, TABLE_BITS, replace=False)) for t in range(TABLES)]


def _padded(images: np.ndarray, r: int) -> np.ndarray:
    """Images (..., row, col) with their edges repeated r times."""
    h, w = images.shape[-2:]
    out = np.empty((*images.shape[:-2], h + 2 * r, w + 2 * r))
    out[..., r:-r, r:-r] = images
    out[..., :r, r:-r], out[..., -r:, r:-r] = images[..., :1, :], images[..., -1:, :]
    out[..., :r], out[..., -r:] = out[..., r : r + 1], out[..., -r - 1 : -r]
    return out


def _box(images: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r+1 of images (..., row, col), edges repeated."""
    s, k, (h, w) = _padded(images, r + 1), 2 * r + 1, images.shape[-2:]
    np.cumsum(s, axis=-2, out=s)
    np.cumsum(s, axis=-1, out=s)
    out = s[..., k : k + h, k : k + w] - s[..., :h, k : k + w]
    out -= s[..., k : k + h, :w]
    out += s[..., :h, :w]
    return out


def _greatest(images: np.ndarray) -> np.ndarray:
    """The greatest value within two pixels of each, in rows and columns, of images (n, row, col)."""
    n, h, w = images.shape
    s = np.full((n, h + 4, w + 4), -np.inf)
    s[:, 2:-2, 2:-2] = images
    two = np.maximum(s[:, :-1], s[:, 1:])
    rows = np.maximum(np.maximum(two[:, :h], two[:, 2 : 2 + h]), s[:, 4:])
    two = np.maximum(rows[..., :-1], rows[..., 1:])
    return np.maximum(np.maximum(two[..., :w], two[..., 2 : 2 + w]), rows[..., 4:])


def _resized(images: np.ndarray, scale: float) -> np.ndarray:
    """Images at a smaller scale, each pixel between its four neighbours."""
    if scale == 1.0:
        return images
    h, w = (max(1, int(n * scale)) for n in images.shape[-2:])
    y, x = np.minimum(np.arange(h) / scale, images.shape[-2] - 1), np.minimum(np.arange(w) / scale, images.shape[-1] - 1)
    i, j = y.astype(int), x.astype(int)
    i2, j2 = np.minimum(i + 1, images.shape[-2] - 1), np.minimum(j + 1, images.shape[-1] - 1)
    rows = images[..., i, :] * (1 - (y - i))[:, None] + images[..., i2, :] * (y - i)[:, None]
    return rows[..., j] * (1 - (x - j)) + rows[..., j2] * (x - j)


def points(images: np.ndarray) -> list[np.ndarray]:
    """Corners of images of one shape (n, row, col) at several scales, with direction and binary tests.

    A corner is the greatest Harris response within two pixels, above a hundredth of the image's
    greatest. Its direction points to the centre of mass of its patch, and the tests compare
    smoothed pixels in a pattern turned to it, those of the edge where it reaches over. Corners nearer to
    the edge than the patch are left.
    """
    out, owner = [], []
    dy, dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = np.hypot(dy, dx) <= RADIUS
    dy, dx = dy[disc], dx[disc]
    for scale in SCALES:
        level = _resized(images.astype(float), scale)
        h, w = level.shape[1:]
        if min(h, w) <= 2 * RADIUS + 2:
            continue
        gy, gx = np.gradient(level, axis=(1, 2))
        a, b, c = (_box(g, 2) for g in (gx * gx, gy * gy, gx * gy))
        harris = a * b - c * c - 0.05 * (a + b) ** 2
        top = (harris == _greatest(harris)) & (harris > 0.01 * harris.max(axis=(1, 2), keepdims=True)) & (harris > 0)
        top[:, :RADIUS], top[:, -RADIUS:], top[:, :, :RADIUS], top[:, :, -RADIUS:] = False, False, False, False
        n, ys, xs = np.nonzero(top)
        patches = level.reshape(-1)[((n * h + ys) * w + xs)[:, None] + dy * w + dx]
        angle = np.arctan2((patches * dy).sum(1), (patches * dx).sum(1))
        soft = _padded(_box(level, 2), BEYOND)
        tall, wide = soft.shape[1:]
        corner = ((n * tall + ys + BEYOND) * wide + xs + BEYOND)[:, None]
        ends = (PATTERN[..., 1] * wide + PATTERN[..., 0])[np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS]
        soft = soft.reshape(-1)
        found = np.zeros(len(ys), POINT)
        found["x"], found["y"], found["scale"], found["angle"] = xs / scale, ys / scale, scale, angle
        found["bits"] = np.packbits(soft[corner + ends[..., 0]] < soft[corner + ends[..., 1]], axis=1)
        out.append(found)
        owner.append(n)
    if not out:
        return [np.zeros(0, POINT)] * len(images)
    every, of = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return np.split(every[order], np.cumsum(np.bincount(of, minlength=len(images)))[:-1])


def agreement(one: np.ndarray, two: np.ndarray, least: float = 0) -> int:
    """Places of two images that match and agree on one similarity transform; 0 if fewer than ``least`` match.

    Matches are mutually nearest places within ``NEAR`` bits. Each match proposes the turn, scale
    and shift that it implies; its consensus is the matches that land within ``OFF`` pixels.
    """
    if not len(one) or not len(two):
        return 0
    a, b = (np.ascontiguousarray(p["bits"]).view("<u8").T.copy() for p in (one, two))
    far = np.zeros((len(one), len(two)), np.uint16)
    for x, y in zip(a, b):
        far += np.bitwise_count(x[:, None] ^ y)
    if (far.min(1) <= NEAR).sum() < least:
        return 0
    best, back = far.argmin(1), far.argmin(0)
    each = np.arange(len(one))
    k = np.flatnonzero((back[best] == each) & (far[each, best] <= NEAR))
    p, q = one[k], two[best[k]]
    if len(k) < max(2, least):
        return 0
    turn, size = q["angle"] - p["angle"], p["scale"] / q["scale"]
    z, t = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    factor = size * np.exp(1j * turn)
    landed = factor[:, None] * (z[None] - z[:, None]) + t[:, None]
    return int((abs(landed - t[None]) <= OFF).sum(1).max())


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether enough places of two images agree for one to be a copy of the other."""
    least = max(NEEDED, PART * min(len(one), len(two)))
    return agreement(one, two, least) >= least


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, POINT)] * batch.num_rows
        shapes: dict[tuple[int, int], list[int]] = {}
        raw = [batch.column(c).to_pylist() for c in ("width", "height", "pixels")]
        for i, (w, h, pixels) in enumerate(zip(*raw)):
            if pixels is not None and w and h and len(pixels) == w * h:
                shapes.setdefault((h, w), []).append(i)
        for (h, w), rows in shapes.items():
            step = max(1, LOT // (h * w))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                images = np.stack([np.frombuffer(raw[2][i], np.uint8).reshape(h, w) for i in part])
                for i, p in zip(part, points(images)):
                    found[i] = p
        n = pa.array([len(p) for p in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("node"), n, pa.array([p.tobytes() for p in found], pa.binary())], names=["print", "node", "n", "points"])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits mixed one to one (Steele et al., 2014), so that any of their bits serve as a hash."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _read(bits: np.ndarray, t: int) -> np.ndarray:
    """The tests that a table reads, as a number for each place."""
    wide, at = np.zeros((len(bits), 8), np.uint8), READS[t]
    wide[:, : TABLE_BITS // 8] = np.packbits(bits[:, at >> 3] >> (7 - at % 8).astype(np.uint8) & 1, axis=1)
    return wide.view("<u8")[:, 0]


def table_keys(found: np.ndarray, image: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per table the distinct keys of the places of images, whose numbers (rising) are given, as (image, key)."""
    for t in range(TABLES):
        key = _mixed(_read(found["bits"], t) | np.uint64(t << 56))
        order = np.lexsort((key, image))
        key, of = key[order], image[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        yield of[new], key[new].view(np.int64)


@tidy
def _dealt(batches: Iterator[pa.RecordBatch], t: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """The places of images by blocks of the keys of a table: a row for each block of some images."""
    for whole in batches:
        for k in range(0, whole.num_rows, 4096):
            batch = whole.slice(k, 4096)
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in raw])
            found, image = np.frombuffer(b"".join(raw), POINT), np.repeat(np.arange(len(raw)), sizes // POINT.itemsize)
            rows = np.empty(len(found), SENT)
            rows["node"], rows["weight"], rows["bits"] = batch.column(0).to_numpy()[image], sizes[image], found["bits"]
            block = (_mixed(_read(rows["bits"], t)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            numbers, start = np.unique(block[order], return_index=True)
            parts = [x.tobytes() for x in np.split(rows[order], start[1:])] if len(rows) else []
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(parts, pa.binary())], names=["block", "places"])


def _groups(near: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The least of n things that each is connected to, where ``near`` gives a matrix for some things and others."""
    of, left = np.arange(n), np.arange(n)
    while len(left):
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                hit |= near(front[k : k + 64], left).any(0)
            front, left = left[hit], left[~hit]
            of[front] = first
    return of


def _signs(rows: np.ndarray, t: int) -> Iterator[pa.RecordBatch]:
    """Members of the buckets of a table, from all places with some keys.

    The places of a key make a bucket for each group that is connected by places within ``SURE`` bits or of
    one image, and one for each pair of other images with places within ``SIGN`` bits. Those of more than ``TOLD``
    make one for each group that is connected by the latter, those of more than ``RUN`` one.
    """
    words, node, key = np.ascontiguousarray(rows["bits"]).view("<u8"), rows["node"], _read(rows["bits"], t)

    def apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The bits by which places differ, 0 in one image, for the numbers of places (..., a) and (..., b)."""
        one, two = one[..., :, None], two[..., None, :]
        return np.bitwise_count(words[one] ^ words[two]).sum(-1, dtype=np.uint16) * (node[one] != node[two])

    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0][: len(order)])
    size = np.diff(np.r_[start, len(order)])
    places, groups, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)]
    for m in np.unique(size[size > 1]):
        runs = order[start[size == m][:, None] + np.arange(m)]
        if m > TOLD:
            of = np.array([_groups(lambda a, b: apart(run[a], run[b]) <= SIGN, m) if m <= RUN else np.zeros(m, int) for run in runs])  # noqa: B023
            places.append(runs.ravel())
            groups.append(of.ravel())
            continue
        for some in np.array_split(runs, -(-runs.size * m >> 20)):
            far, now = apart(some, some), np.broadcast_to(np.arange(m), some.shape)
            while (now != (then := np.where(far <= SURE, now[:, None], m).min(2))).any():
                now = then
            places.append(some.ravel())
            groups.append(now.ravel())
            r, i, j = np.nonzero((far <= SIGN) & (now[:, :, None] < now[:, None]))
            pairs.append(np.stack([some[r, i], some[r, j]]))
    at, group, both = np.concatenate(places), np.concatenate(groups), np.concatenate(pairs, axis=1)
    bucket = key[at].view(np.int64) | group << TABLE_BITS | t << 56
    ends = np.sort(node[both], axis=0).view(np.uint64)
    bucket, at = np.concatenate([bucket, *[_mixed(ends[0] ^ _mixed(ends[1])).view(np.int64)] * 2]), np.concatenate([at, *both])
    order = np.lexsort((node[at], bucket))
    bucket, at = bucket[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (node[at[1:]] != node[at[:-1]])
    bucket, at = bucket[new], at[new]
    _, back, many = np.unique(bucket, return_inverse=True, return_counts=True)
    bucket, at = bucket[many[back] > 1], at[many[back] > 1]
    columns = [pa.array(bucket), pa.array(np.full(len(at), t, np.int32)), pa.array(node[at]), pa.array(rows["weight"][at].astype(np.int64))]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "node", "weight"])


def _met(t: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What finds the members of buckets among the places of a block.

    Places of a key that has more than ``RUN`` are passed on as they come, so it holds a block without those.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, common, most = np.zeros(0, SENT), np.zeros(0, np.uint64), 4 * BLOCK
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                held = np.concatenate([held, np.frombuffer(b"".join(batch.column("places")[k : k + 256].to_pylist()), SENT)])
                if len(held) <= most:
                    continue
                key = _read(held["bits"], t)
                found, n = np.unique(key, return_counts=True)
                common = np.union1d(common, found[n > RUN])
                out = np.isin(key, common)
                yield _passed(held[out], t)
                held = held[~out]
                most = max(4 * BLOCK, 2 * len(held))
        out = np.isin(_read(held["bits"], t), common)
        yield _passed(held[out], t)
        yield from _signs(held[~out], t)

    return met


def _passed(rows: np.ndarray, t: int) -> pa.RecordBatch:
    """Members of the buckets of common keys."""
    bucket = _read(rows["bits"], t).view(np.int64) | t << 56
    columns = [pa.array(bucket), pa.array(np.full(len(rows), t, np.int32)), pa.array(rows["node"]), pa.array(rows["weight"].astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "node", "weight"])


def copies(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Which pairs of images, given by their places, are copies."""
    hubs, members = ([np.frombuffer(x, POINT) for x in side] for side in (one, two))
    return np.array([[alike(a, b) for b in members] for a in hubs]).reshape(len(one), len(two))


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (batch.column(c).to_pylist() for c in ("points_u", "points_v"))
        keep = [alike(np.frombuffer(a, POINT), np.frombuffer(b, POINT)) for a, b in zip(one, two)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def bucket_members(own: DataFrame) -> list[DataFrame]:
    """Members of buckets (bucket, part, node, weight) by each table, written, of images (node, n, points)."""
    blocks, found = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // BLOCK)), []
    for t in range(TABLES):  # one after the other: the tests of all places are exchanged each time
        dealt = own.select("node", "points").mapInArrow(partial(_dealt, t=t, blocks=blocks), "block long, places binary")
        found.append(cut(dealt.groupBy("block").applyInArrow(_met(t), MEMBERS), "members"))
    return found


def _verified(pairs: DataFrame, own: DataFrame, at_once: int) -> DataFrame:
    """The pairs (u, v) that are copies, written.

    A pair takes the places of both images along. There may be many times more pairs than images, so
    they come in lots of about ``at_once``, and what a lot exchanged is deleted before the next. A lot has a part
    of the u and a part of the v, so that the places of all images are exchanged by the root of the lots.
    """
    pairs = cut(pairs, "pairs")
    lots = max(1, -(-pairs.count() // at_once))
    mine = lambda node, k, n: F.pmod(F.xxhash64(node), F.lit(n)) == k
    one, two = (own.select(F.col("node").alias(x), F.col("points").alias(f"points_{x}")) for x in "uv")
    found, wide = [], ceil(sqrt(lots))
    tall = -(-lots // wide)
    for i in range(tall):
        across = lots // tall + (i < lots % tall)
        for j in range(across):
            lot = pairs.where(mine("u", i, tall) & mine("v", j, across)).join(one.where(mine("u", i, tall)), "u").join(two.where(mine("v", j, across)), "v")
            found.append(cut(lot.select("u", "v", "points_u", "points_v").mapInArrow(_agreed, "u long, v long"), "agreed"))
    drop(pairs)
    return reduce(DataFrame.unionAll, found)


def image_copies(images: DataFrame) -> DataFrame:
    """Components of images of which one is a cropped or edited copy of another.

    ``images`` has image_id, width, height, pixels (grey bytes, row by row). Returns image_id,
    n_points, component_id (least id) and kept (id = component_id).

    Equal images are one class, told by a 256-bit hash, and described once. Two places share a key if
    they agree in the ``TABLE_BITS`` tests of one of ``TABLES`` tables. The places of a table come together in
    blocks by their keys, one table after the other, and those of a key that differ in at most ``SIGN`` bits
    make a bucket of their images (``_signs``). Unrelated images share keys by chance, mostly of
    places that differ in more tests than a match may, and those tell nothing of copies. Each bucket's
    first image is compared with the others, then in rounds the images that aren't yet connected (see
    ``link_buckets``): a row for each pair in buckets of ``SMALL`` images, within tasks in larger ones, so
    a mark that very many pictures share gives rows for copies only. Compared are mutual nearest places,
    which must agree on turn, scale and shift (``alike``); pairs get their places in lots of about as many
    as there are images, so what is exchanged at a time grows with the images only. A copy whose places share no key is missed: the
    tests measure recall on crops, noise and edits against a comparison of all pairs.

    Null pixels are no copy of anything. Pixels that don't fill width times height have no places and
    are only linked to equal values. Rows with equal ids are one node; the least of their images by
    hash stands for it. Rows with a null id have a null component and are kept. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = images.select(F.col("image_id").cast("bigint").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    parts = F.concat_ws(",", F.coalesce("width", F.lit(-1)), F.coalesce("height", F.lit(-1)), F.coalesce(F.sha2("pixels", 256), F.lit("none")))
    rows = rows.withColumn("print", parts)
    with shuffles_freed(images.sparkSession):
        prints = cut(rows.select("id", "print", F.col("pixels").isNotNull().alias("filled")), "prints")
        classes = cut(prints.where("id IS NOT NULL AND filled").groupBy("print").agg(F.min("id").alias("node")), "classes")
        chosen = classes.groupBy("node").agg(F.min("print").alias("chosen"))
        own = rows.withColumnRenamed("id", "node").join(chosen, "node").where("print = chosen").dropDuplicates(["node"])
        own = cut(own.select("print", "node", "width", "height", "pixels").mapInArrow(_described, "print string, node long, n long, points binary"), "described")
        tables = bucket_members(own)
        members = reduce(DataFrame.unionAll, tables)
        at_once = max(PAIRS_AT_ONCE, own.count())

        def verify(pairs: DataFrame) -> DataFrame:
            return _verified(pairs, own, at_once)

        sketch = lambda nodes: own.select("node", F.col("points").alias("sketch")).join(nodes, "node").select("node", "sketch")
        found = link_buckets(members, sketch, lambda one, two, part: copies(one, two), verify, small=SMALL)
        for table in tables:
            drop(table)
        named = classes.join(found, "node", "left").join(own.select("node", "n"), "node", "left")
        named = cut(named.select("print", "n", F.coalesce("component", "node").alias("component")), "named")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return prints.select("id", "print").join(named, "print", "left").select(
        F.col("id").alias("image_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_points"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


SIDE, CELLS = 64, 16


def picture(vector: list[float] | None) -> np.ndarray | None:
    """A grey picture of a vector: cells that mix two of its values each, joined smoothly."""
    v = np.array([x or 0.0 for x in vector or []], float)
    if not len(v):
        return None
    r, c = np.mgrid[:CELLS, :CELLS]
    cells = v[(r * CELLS + c) % len(v)] + v[(7 * r + 3 * c + 5) % len(v)] * (1 - 2 * ((r + c) % 2))
    cells = np.kron(cells / (abs(cells).max() or 1.0), np.ones((SIDE // CELLS,) * 2))
    return np.clip(128 + 100 * _box(cells, 1) / 9, 0, 255).astype(np.uint8)


def edited(image: np.ndarray) -> np.ndarray:
    """A copy without its margins, darker and flatter."""
    return np.clip(image[5:-3, 4:-6] * 0.8 + 20, 0, 255).astype(np.uint8)


def warped(image: np.ndarray, scale: float = 1.0, degrees: float = 0.0) -> np.ndarray:
    """A copy resized or turned about its centre, between its pixels."""
    h, w = image.shape
    a, (rows, cols) = np.radians(degrees), (int(h * scale), int(w * scale))
    y, x = np.mgrid[:rows, :cols]
    y, x = y - (rows - 1) / 2, x - (cols - 1) / 2
    sy, sx = (np.cos(a) * y - np.sin(a) * x) / scale + (h - 1) / 2, (np.sin(a) * y + np.cos(a) * x) / scale + (w - 1) / 2
    inside = (sy >= 0) & (sy <= h - 1) & (sx >= 0) & (sx <= w - 1)
    sy, sx = np.clip(sy, 0, h - 1.001), np.clip(sx, 0, w - 1.001)
    i, j = sy.astype(int), sx.astype(int)
    b, c, f = sy - i, sx - j, image.astype(float)
    out = (1 - b) * ((1 - c) * f[i, j] + c * f[i, j + 1]) + b * ((1 - c) * f[i + 1, j] + c * f[i + 1, j + 1])
    return np.clip(np.where(inside, out, 0), 0, 255).astype(np.uint8)


#: The edits of planted copies, in turn.
PLANTED = (edited, lambda m: warped(m, 0.85), lambda m: warped(m, 0.75), lambda m: warped(m, 1.0, 10), lambda m: np.ascontiguousarray(np.rot90(m)))


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            image = picture(vector)
            out.append((2 * i, image))
            if i % 4 == 0 and image is not None:
                out.append((2 * i + 1, PLANTED[i // 4 % len(PLANTED)](image)))
        sizes = [im.shape if im is not None else (None, None) for _, im in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in out], pa.int64()), pa.array([w for _, w in sizes], pa.int32()), pa.array([h for h, _ in sizes], pa.int32()), pa.array([im if im is None else im.tobytes() for _, im in out], pa.binary())],
            names=["image_id", "width", "height", "pixels"],
        )


def pictures(embeddings: DataFrame) -> DataFrame:
    """A table of images drawn from vectors: 2 * vec_id, and for every fourth a copy after it (``PLANTED``)."""
    rows = embeddings.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_pictures, "image_id long, width int, height int, pixels binary")
