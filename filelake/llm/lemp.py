"""Hard negatives by coordinate pruning: length buckets with sorted coordinate lists, feasible ranges, exact scores.

A bucket is a block of vectors of one label and similar length. For each coordinate it holds the order of its
vectors by that coordinate of their unit vectors. A score of at least t asks of a unit vector that its coordinates
lie near the anchor's: for the anchor's FOCUS largest coordinates these ranges are looked up in the lists, and only
vectors within all of them are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, prepare, written

#: Vectors of a bucket, and its least number before a change of length ends it; anchors of a block; buckets of a slot.
BUCKET, LEAST, ANCHORS, SLOT = 4096, 256, 1024, 8
#: A bucket's lengths are within this factor of its longest. Coordinates that are looked up for an anchor.
LENGTHS, FOCUS = 0.8, 5

_BUCKETS = pa.schema([("dim", pa.int32()), ("bucket", pa.int64()), ("label", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("data", pa.binary()), ("lists", pa.binary()), ("home", pa.binary())])
_BUCKETS_DDL = "dim int, bucket long, label long, longest double, ids binary, data binary, lists binary, home binary"
_HOME = np.dtype([("at", "<i4"), ("least", "<f8")])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place; minus infinity is no score."""
    if len(scores) > k:
        scores = np.where(scores >= np.partition(scores, -k)[-k], scores, -np.inf)
    at = np.flatnonzero(scores > -np.inf)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _units(data: np.ndarray) -> np.ndarray:
    length = np.sqrt((data * data).sum(axis=1))
    return data / np.where(length > 0, length, 1)[:, None]


def _pack(every: int, k: int, scale: float, size: int):
    least = min(LEAST, size // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (dim, label, length, vec_id, embedding) as buckets. Each anchor learns from its own bucket a
        score that k others of its label reach."""
        base, n, key, held = TaskContext.get().partitionId() << 32, 0, None, []

        def bucket():
            nonlocal n
            held.sort(key=lambda r: r[0])
            ids, data = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            home = []
            for at in np.flatnonzero(ids % every == 0):
                score = data @ data[at]
                score[at] = -np.inf
                home.append((at, np.partition(score, -k)[-k] if len(ids) > k else -np.inf))
            lists = np.argsort(_units(data), axis=0, kind="stable").T.astype("<i4")
            row = (*key, ids.tobytes(), data.astype("<f8").tobytes(), lists.tobytes(), np.array(home, _HOME).tobytes())
            n += 1
            held.clear()
            return _rows(_BUCKETS, [(row[0], base + n, *row[1:])])

        for batch in bounded(batches):
            for dim, label, length, vec_id, v in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).to_numpy(zero_copy_only=False), strict=True):
                if held and ((dim, label) != key[:2] or len(held) >= size or len(held) >= least and length < LENGTHS * key[2]):
                    yield bucket()
                if not held:
                    key = (dim, label, length)
                held.append((vec_id, np.floor(np.asarray(v, np.float64) * scale)))
        if held:
            yield bucket()

    return run


def _bucket(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], "<f8").reshape(len(ids), row["dim"]), np.frombuffer(row["lists"], "<i4").reshape(row["dim"], len(ids))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("dim", pa.int32()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("least", pa.float64()), ("v", pa.binary())])
    for batch in bounded(batches, 1):
        for row in batch.to_pylist():
            ids, data, _ = _bucket(row)
            home = np.frombuffer(row["home"], _HOME)
            for i in range(0, len(home), ANCHORS):
                h = home[i : i + ANCHORS]
                yield _rows(schema, [(row["dim"], int(ids[a]), row["label"], float(t), data[a].tobytes()) for a, t in h])


def _blocks(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of anchors, a list of at most ANCHORS of one dimension at a time."""
        held: dict[int, list] = {}

        def block(dim):
            rows = held.pop(dim)
            return pa.RecordBatch.from_pylist([{"dim": dim} | {x: [r[x] for r in rows] for x in names}], schema=schema)

        schema = None
        for batch in bounded(batches):
            kinds = {f.name: f.type for f in batch.schema}
            schema = pa.schema([("dim", pa.int32())] + [(x, pa.list_(kinds[x])) for x in names])
            for row in batch.to_pylist():
                held.setdefault(row["dim"], []).append(row)
                if len(held[row["dim"]]) >= ANCHORS:
                    yield block(row["dim"])
        for dim in list(held):
            yield block(dim)

    return run


class Lists:
    """A bucket, ready for look-ups."""

    def __init__(self, row: dict):
        self.ids, self.data, self.order = _bucket(row)
        self.units = _units(self.data)
        self.longest = math.sqrt((self.data * self.data).sum(axis=1).max(initial=0))

    def feasible(self, anchor: np.ndarray, least: float) -> np.ndarray:
        """Places, in order, of all vectors that may score `least` with the anchor."""
        n, length = len(self.ids), math.sqrt(anchor @ anchor)
        if least < 0 or least == -np.inf:
            return np.arange(n)
        if not length or not self.longest:
            return np.arange(n if least <= 0 else 0)
        t = least / (length * self.longest)
        if t > 1 + 1e-9:
            return np.arange(0)
        t, unit = min(t, 1.0), anchor / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        ranges = []
        for f in focus:
            u = float(unit[f])
            away = math.sqrt(max(0.0, (1 - u * u) * (1 - t * t)))
            low = -1.0 if u < -t else u * t - away
            high = 1.0 if u > t else u * t + away
            column = self.units[self.order[f], f]
            i, j = np.searchsorted(column, low - 1e-9, "left"), np.searchsorted(column, high + 1e-9, "right")
            ranges.append((j - i, f, i, j, low, high))
        ranges.sort(key=lambda r: r[0])
        _, f, i, j, _, _ = ranges[0]
        found = np.sort(self.order[f][i:j])
        for _, f, _, _, low, high in ranges[1:]:
            x = self.units[found, f]
            found = found[(x >= low - 1e-9) & (x <= high + 1e-9)]
        return found


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):  # a row is a tile
            for row in batch.to_pylist():
                mine = [i for i, x in enumerate(row["a_label"]) if x == row["label"]]
                lists, out = Lists(row) if mine else None, []
                for i in mine:
                    anchor = np.frombuffer(row["v"][i], "<f8")
                    at = lists.feasible(anchor, row["least"][i])
                    score = lists.data[at] @ anchor
                    score[(lists.ids[at] == row["anchor_id"][i]) | (score < row["least"][i])] = -np.inf
                    for b in _best(score, k):
                        out.append((row["anchor_id"][i], int(lists.ids[at[b]]), int(score[b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            for row in batch.to_pylist():
                theirs = [i for i, x in enumerate(row["a_label"]) if x != row["label"]]
                lists, out = Lists(row) if theirs else None, []
                for i in theirs:
                    anchor, pairs = np.frombuffer(row["v"][i], "<f8"), row["pairs"][i]
                    at = lists.feasible(anchor, min(low * p["positive_score"] / 100 for p in pairs))
                    score = lists.data[at] @ anchor
                    for p in pairs:
                        fit = (low * p["positive_score"] <= 100 * score) & (100 * score <= high * p["positive_score"])
                        for b in _best(np.where(fit, score, -np.inf), k):
                            out.append((row["anchor_id"][i], p["positive_id"], p["positive_score"], int(lists.ids[at[b]]), int(score[b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _tiles(buckets: DataFrame, anchors: DataFrame, names: list[str]) -> DataFrame:
    """Every bucket beside every block of anchors of its dimension. Anchors, the few, are sent to each slot of SLOT
    buckets; a bucket is sent once."""
    slots = max(1, math.ceil(buckets.count() / SLOT))
    kinds = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in anchors.select(*names).schema)
    tasks = max(1, math.ceil(anchors.count() / ANCHORS))
    blocks = written(anchors.coalesce(tasks).mapInArrow(_blocks(names), f"dim int, {kinds}"), "anchors")
    sent = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    dealt = buckets.select("dim", "label", "ids", "data", "lists", F.pmod(F.xxhash64("bucket"), F.lit(slots)).alias("slot"))
    return sent.join(dealt, ["dim", "slot"])


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, bucket: int = BUCKET
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are rows whose vec_id is
    divisible by `every`; an anchor's positives its `positives` best other rows of the same label; for each of them
    the `negatives` best rows of other labels whose score lies between low and high hundredths of the positive's.

    vectors: vec_id, embedding, label. Each component x counts as floor(scale * x); scores are integers, exact
    below 2**53, ties go to the smaller vec_id. Rows with a null vec_id, label or vector, or with an empty vector or
    any null, NaN or infinite component take no part. Rows that repeat a vec_id are one: the least label, then the
    least vector stays. Vectors of different dimension never meet. Anchors without other rows of their label, and
    pairs without a fitting row, give no row. Copies of a vector are vectors like others; no bucket grows with them."""
    prepare(vectors.sparkSession)
    sound = F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & (F.size("embedding") > 0)
    clean = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    clean = clean.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale)))
    clean = written(clean.select(F.size("embedding").alias("dim"), "label", length.alias("length"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vectors")
    order = ["dim", "label", F.desc("length"), "vec_id"]
    buckets = written(clean.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(every, positives, scale, bucket), _BUCKETS_DDL), "buckets")

    anchors = written(buckets.where(F.length("home") > 0).mapInArrow(_anchor_rows, "dim int, anchor_id long, label long, least double, v binary"), "anchor_rows")
    anchors = anchors.withColumnRenamed("label", "a_label")
    tiles = _tiles(buckets, anchors, ["anchor_id", "a_label", "least", "v"])
    best = tiles.mapInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    place = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
    pairs = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs"))  # at most `positives`
    known = written(anchors.join(pairs, "anchor_id").select("dim", "anchor_id", "a_label", "v", "pairs"), "positives")

    tiles = _tiles(buckets, known, ["anchor_id", "a_label", "v", "pairs"])
    found = tiles.mapInArrow(_negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
