"""Copies of images by local descriptors: multiscale corners, orientation-normalised binary tests, Hamming tables,
geometric consensus.

Images are grey: a width and one byte a pixel, row by row. At each scale all corners (Harris, one a 3 x 3
neighbourhood) get an angle by the centroid of their patch and BITS binary tests rotated by it. Images go in blocks of
about BLOCK corners, and every block of the stated queries meets every block of images. There corners are joined over
TABLES Hamming tables, each keyed by KEY of the tests drawn at random: corners that agree in a key and differ in NEAR bits at
most match. Corners that differ in 8, 16 or 24 bits meet with chances of 0.97, 0.44 and 0.1, so copies of thirty corners
whose descriptors change by up to about 20 bits still get their votes. A match tells a rotation and a change of scale by its corners' angles and scales; matches that tell
much the same vote together: any two give a similarity (scale, rotation, shift), and those of the others that it moves to
within SLACK pixels of their place agree with it. Images with VOTES agreeing corners are copies.

Images that are equal byte for byte form one class and are compared once; its members are joined to the answers.

Defined results: null, empty or misshapen images, and null ids - take no part; flat images - no corners, no copies;
repeated rows count once; images of any size are described whole; of transforms with as many votes the largest numbers
win; extra columns do not matter; empty table - empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, cut
from .components import components

BITS = 256
NEAR = 24
VOTES = 5
BLOCK = 32768
TABLES = 16
KEY = 48  # bits of a table's key
SEEN = 20  # bits of a slot of the tables that tell which keys the queries have
ASKED = 131_072  # corners of a block of queries
MEET = 1_000_000  # pairs of corners that are looked at together
PAIRS = 20_000  # and pairs of images that are voted on together
SLACK = 3.0
TURNS = 24
RADIUS = 10
SCALES = (1, 2)
_rng = np.random.default_rng(20)
TESTS = np.clip(np.round(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2))), -RADIUS + 3, RADIUS - 3)
_y, _x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
KEYS = np.stack([_rng.choice(BITS, KEY, replace=False) for _ in range(TABLES)])
DISC = (_x**2 + _y**2 <= RADIUS**2).astype(np.float32)


def _blur(a: np.ndarray) -> np.ndarray:
    """3 x 3 binomial filter of a stack of images."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (1, 1)
        b = np.pad(a, pad, mode="edge")
        n = a.shape[axis]
        a = (b.take(range(n), axis) + 2 * b.take(range(1, n + 1), axis) + b.take(range(2, n + 2), axis)) / 4
    return a


#: A corner: its image, its place in full-size pixels, its scale, angle and tests.
CORNER = np.dtype([("id", "<i8"), ("y", "<f4"), ("x", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", (BITS // 8,))])


def describe(images: np.ndarray) -> list[np.ndarray]:
    """The corners of each of a stack of equal-sized images, without ids."""
    out = [[np.zeros(0, CORNER)] for _ in images]
    for scale in SCALES:
        a = images.astype(np.float32)
        h, w = (x // scale * scale for x in a.shape[1:])
        a = a[:, :h, :w].reshape(len(a), h // scale, scale, w // scale, scale).mean(axis=(2, 4))
        if min(a.shape[1:]) < 2 * RADIUS + 2:
            continue
        a = _blur(a)
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = _blur(_blur(gx * gx)), _blur(_blur(gy * gy)), _blur(_blur(gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
        around = np.pad(r, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        top = np.max([around[:, i : i + r.shape[1], j : j + r.shape[2]] for i in range(3) for j in range(3)], axis=0)
        inner = np.where((inner >= top[:, RADIUS:-RADIUS, RADIUS:-RADIUS]) & (inner > 1e-3), inner, 0)
        image, y, x = np.nonzero(inner)
        y, x = y + RADIUS, x + RADIUS
        patch = a[image[:, None, None], y[:, None, None] + _y, x[:, None, None] + _x] * DISC
        angle = np.arctan2((patch * _y).sum(axis=(1, 2)), (patch * _x).sum(axis=(1, 2)))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        ty = np.rint(TESTS[None, :, :, 0] * c + TESTS[None, :, :, 1] * s).astype(int)
        tx = np.rint(TESTS[None, :, :, 1] * c - TESTS[None, :, :, 0] * s).astype(int)
        level = a[image[:, None, None], y[:, None, None] + ty, x[:, None, None] + tx]
        own = np.zeros(len(image), CORNER)
        own["y"], own["x"] = (y + 0.5) * scale - 0.5, (x + 0.5) * scale - 0.5
        own["scale"], own["angle"], own["bits"] = scale, angle, np.packbits(level[:, :, 0] < level[:, :, 1], axis=1)
        for rows, part in zip(out, np.split(own, np.searchsorted(image, range(1, len(images)))), strict=True):
            rows.append(part)
    return [np.concatenate(rows) for rows in out]


def _blocks(images: DataFrame) -> DataFrame:
    """(corners): one row a block of whole images, as bytes of CORNER. images: id, width, grey."""

    def run(batches):
        have, n = [], 0
        for batch in batches:
            shapes: dict[tuple[int, int], list] = {}
            for i, w, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shapes.setdefault((len(g) // w, w), []).append((i, np.frombuffer(g, np.uint8)))
            for shape, rows in shapes.items():
                step = max(1, min(64, 2**18 // (shape[0] * shape[1])))
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    for (i, _), own in zip(part, describe(np.stack([g for _, g in part]).reshape(-1, *shape)), strict=True):
                        own["id"] = i
                        if n and n + len(own) > BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array([b"".join(have)], pa.binary())], names=["corners"])
                            have, n = [], 0
                        have.append(own.tobytes())
                        n += len(own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(have)], pa.binary())], names=["corners"])

    return images.mapInArrow(run, "corners binary")


def _keys(corners: np.ndarray) -> np.ndarray:
    """TABLES rows of keys."""
    bits = np.ascontiguousarray(np.unpackbits(corners["bits"], axis=1).T)
    packed = np.zeros((TABLES, len(corners), 8), np.uint8)
    for table, at in zip(packed, KEYS, strict=True):
        table[:, : KEY // 8] = np.packbits(bits[at], axis=0).T
    return packed.view(np.uint64)[:, :, 0]


def _merged(blocks: DataFrame) -> DataFrame:
    """Small blocks put together."""

    def run(batches):
        have, size = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if have and size + len(x) > ASKED * CORNER.itemsize:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(have)], pa.binary())], names=["corners"])
                    have, size = [], 0
                have.append(x)
                size += len(x)
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(have)], pa.binary())], names=["corners"])

    return blocks.mapInArrow(run, "corners binary")


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SEEN)).astype(np.int64)


class Tables:
    """The corners of a block of queries, by key."""

    def __init__(self, corners: np.ndarray):
        self.corners, keys = corners, _keys(corners)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)
        self.words = np.ascontiguousarray(corners["bits"]).view(np.uint64)
        self.seen = np.zeros((TABLES, 2**SEEN), bool)
        for seen, own in zip(self.seen, keys, strict=True):
            seen[_slots(own)] = True

    def matches(self, other: np.ndarray):
        """(i of other, j of own) of the corners that match, for parts of other that hold its images whole."""
        keys, words = _keys(other), np.ascontiguousarray(other["bits"]).view(np.uint64)
        low, high = np.zeros((2, TABLES, len(other)), np.int64)
        for table, key in enumerate(keys):
            # most keys are none of the queries', which a table of bits tells faster than a search
            some = np.flatnonzero(self.seen[table][_slots(key)])
            low[table, some], high[table, some] = (np.searchsorted(self.keys[table], key[some], side) for side in ("left", "right"))
        image = np.flatnonzero(np.concatenate(([True], other["id"][1:] != other["id"][:-1], [True]))) if len(other) else np.zeros(1, np.int64)
        met = np.concatenate(([0], np.cumsum((high - low).sum(axis=0))))[image]
        cuts = np.unique(np.concatenate(([0, len(image) - 1], np.searchsorted(met, np.arange(MEET, met[-1], MEET)))))
        for a, b in zip(image[cuts[:-1]], image[cuts[1:]], strict=True):
            pairs = [np.zeros(0, np.int64)]
            for order, lo, hi in zip(self.order, low[:, a:b], high[:, a:b], strict=True):
                n = hi - lo
                i = np.repeat(np.arange(a, b), n)
                j = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                at = i * len(self.corners) + j
                pairs.append(at[np.bitwise_count(words[i] ^ self.words[j]).sum(axis=1, dtype=np.int64) <= NEAR])
            at = np.unique(np.concatenate(pairs))
            yield at // len(self.corners), at % len(self.corners)


def agreement(p: np.ndarray, q: np.ndarray) -> tuple[int, float, float, float, float]:
    """(votes, scale, angle, dy, dx) of the similarity from corners q to p, given match by match, that most corners agree with.

    Votes count a corner of either side once. The similarity fits the agreeing matches best."""
    zp, zq = p["x"] + 1j * p["y"].astype(np.float64), q["x"] + 1j * q["y"].astype(np.float64)
    turn, grow = p["angle"] - q["angle"], p["scale"] / q["scale"]
    best = (0, None)
    for j in range(len(zp)):
        far, to = zq - zq[j], zp - zp[j]
        ok = np.abs(far) > 2 * SLACK
        z = to[ok] / far[ok]
        off = np.angle(z * np.exp(-1j * turn[j]))
        z = z[(np.abs(off) < 2 * np.pi / TURNS) & (np.abs(np.log2(np.abs(z) / grow[j] + 1e-9)) < 0.75)]
        for lo in range(0, len(z), 256):
            near = np.abs(z[lo : lo + 256, None] * far - to) <= SLACK
            most = near.sum(axis=1)
            for k in np.argsort(-most, kind="stable"):
                if most[k] <= best[0]:
                    break
                n = min(len(np.unique(zq[near[k]])), len(np.unique(zp[near[k]])))
                if n > best[0]:
                    best = (n, near[k])
    if not best[0]:
        return 0, 1.0, 0.0, 0.0, 0.0
    x, y = zq[best[1]], zp[best[1]]
    z = np.vdot(x - x.mean(), y - y.mean()) / np.vdot(x - x.mean(), x - x.mean()).real
    shift = y.mean() - z * x.mean()
    return best[0], abs(z), np.angle(z), shift.imag, shift.real


def _groups(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Indexes of the matches of one query and image each that tell much the same rotation and change of scale, where VOTES corners are of them."""
    images, queries = np.unique(p["id"], return_inverse=True), np.unique(q["id"], return_inverse=True)[1]
    pair, many = np.unique(queries * len(images[0]) + images[1], return_inverse=True, return_counts=True)[1:]
    enough = np.flatnonzero(many[pair] >= VOTES)
    enough = enough[np.argsort(pair[enough], kind="stable")]
    pair = np.unique(pair[enough], return_inverse=True)[1]
    ends = np.searchsorted(pair, np.arange(0, pair.max(initial=-1) + 1 + PAIRS, PAIRS))
    return [enough[a:b][own] for a, b in zip(ends[:-1], ends[1:], strict=True) for own in _agreeing(p[enough[a:b]], q[enough[a:b]], i[enough[a:b]], j[enough[a:b]], pair[a:b] - pair[a])]


def _agreeing(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
    """_groups() for a bounded number of pairs, numbered from 0."""
    sector = np.floor((p["angle"] - q["angle"]) % (2 * np.pi) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
    octave = np.rint(np.log2(p["scale"] / q["scale"])).astype(np.int64) + len(SCALES)
    cell = (pair * (2 * len(SCALES) + 1) + octave) * TURNS
    many = np.bincount(cell + sector, minlength=(pair.max() + 1) * (2 * len(SCALES) + 1) * TURNS).reshape(-1, TURNS)
    hot = (many + np.roll(many, 1, axis=1) + np.roll(many, -1, axis=1) >= VOTES).reshape(-1)
    out, where, which = [], [], []
    for step in (-1, 0, 1):
        to = cell + (sector + step) % TURNS
        at = np.flatnonzero(hot[to])
        where.append(at)
        which.append(to[at])
    where, which = np.concatenate(where), np.concatenate(which)
    order = np.lexsort((where, which))
    where, which = where[order], which[order]
    for own in np.split(where, np.flatnonzero(np.diff(which)) + 1):
        if len(own) and min(len(set(i[own].tolist())), len(set(j[own].tolist()))) >= VOTES:
            out.append(own)
    return out


def _met(pairs: DataFrame) -> DataFrame:
    """(query, class, votes, scale, angle, dy, dx) of the copies in pairs of blocks (asked, corners)."""

    def run(batches):
        held, tables = None, None
        for batch in batches:
            found = []
            for left, right in zip(*batch.columns, strict=True):
                if held != left.as_py():
                    held = left.as_py()
                    tables = Tables(np.frombuffer(held, CORNER))
                a, b = np.frombuffer(right.as_buffer(), CORNER), tables.corners
                for i, j in tables.matches(a):
                    p, q = a[i], b[j]
                    for own in _groups(p, q, i, j) if len(p) else ():
                        best = agreement(p[own], q[own])
                        if best[0] >= VOTES:
                            found.append((int(q["id"][own[0]]), int(p["id"][own[0]]), *map(float, best)))
            kinds = [pa.int64()] * 2 + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["query", "class", "votes", "scale", "angle", "dy", "dx"])

    return pairs.mapInArrow(run, "query long, class long, votes double, scale double, angle double, dy double, dx double")


def sound(images: DataFrame) -> DataFrame:
    """(id, width, grey) of the images that take part."""
    v = columns(images, "id", "width", "grey").select(F.col("id").cast("long").alias("id"), F.col("width").cast("int").alias("width"), "grey")
    return v.where("id is not null and width > 0 and octet_length(grey) > 0 and octet_length(grey) % width = 0")


def copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """Per query image and copy of it: query_id, id, votes (agreeing corners), dy, dx (shift in steps of 4 pixels), scale, angle (degrees) from the query to the image."""
    rows = sound(images)
    named = cut(rows.select("id", F.xxhash64("width", "grey").alias("key")).distinct())
    heads = named.groupBy("key").agg(F.min("id").alias("id"))
    first = rows.withColumn("key", F.xxhash64("width", "grey")).join(heads, ["id", "key"]).select(F.col("key").alias("id"), "width", "grey")
    left = cut(_blocks(sound(queries)))
    parts = (left.agg(F.sum(F.octet_length("corners"))).first()[0] or 0) // (ASKED * CORNER.itemsize) + 1
    left = _merged(left.coalesce(parts)).withColumnRenamed("corners", "asked")
    # the stated queries, in blocks, against the blocks of all images
    met = _met(left.crossJoin(cut(_blocks(first))))
    best = met.groupBy("query", "class").agg(F.max(F.struct("votes", "scale", "angle", "dy", "dx")).alias("m"))
    step = lambda v: (F.floor(F.round(F.col(v), 3) / 4) + 1).alias(v[2:])
    shape = [F.round("m.scale", 2).alias("scale"), F.round(F.degrees("m.angle")).cast("int").alias("angle")]
    return best.join(named.withColumnRenamed("key", "class"), "class").select(F.col("query").alias("query_id"), "id", F.col("m.votes").cast("long").alias("votes"), step("m.dy"), step("m.dx"), *shape).distinct()


def by_image(pairs: DataFrame) -> DataFrame:
    """One row an image of copies(): id, class_id (smallest id that links lead to), n_links (queries that it is a copy of), and of the
    query with most votes (ties: the smallest) query_id, votes, dy, dx, scale, angle. Groups of copies thus take a row a member."""
    pairs = cut(pairs)
    best = F.max_by(F.struct("query_id", "votes", "dy", "dx", "scale", "angle"), F.struct("votes", -F.col("query_id"), "dy", "dx", "scale", "angle"))
    rows = pairs.groupBy("id").agg(F.count_distinct("query_id").alias("n_links"), best.alias("b"))
    groups = components(pairs, "query_id", "id").withColumnRenamed("vertex", "id")
    return rows.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("class_id"), "n_links", "b.*")


def pictures(rows: DataFrame, tile: int = 8, crop: tuple[int, int] = (0, 0), gain: float = 1.0, offset: float = 0.0, turns: int = 0, times: int = 1) -> DataFrame:
    """(id, width, grey): a square of tiles, one a component of `v`, then cropped at the top and left, turned by quarters, enlarged, and regraded."""

    def run(batches):
        for batch in batches:
            out = {"id": [], "width": [], "grey": []}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side = int(len(v or ()) ** 0.5)
                level = np.array((v or [])[: side * side], np.float64)
                if not side or not np.isfinite(level).all():
                    continue
                a = np.kron(level.reshape(side, side), np.ones((tile, tile)))[crop[0] :, crop[1] :]
                a = np.kron(np.rot90(a, turns), np.ones((times, times)))
                grey = np.clip(np.rint((128 + 400 * a) * gain + offset), 0, 255).astype(np.uint8)
                out["id"].append(i)
                out["width"].append(grey.shape[1])
                out["grey"].append(grey.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["width"], pa.int32()), pa.array(out["grey"], pa.binary())], names=list(out))

    return rows.select("id", "v").mapInArrow(run, "id long, width int, grey binary")
