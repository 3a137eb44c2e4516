"""MinHash near-dedup: universal hash minima, bands, signature check, full-set check, components.

Work on classes of equal shingle sets, so thousands of exact copies cost one class. Within a band's
bucket every member is first tried against the bucket's hub; members that this leaves in different
components are then tried against each other, where sizes and bitmaps of their sets allow a link. So a bucket
of n near copies costs about n pairs, and no link between different sets of a shared bucket that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, bloom_hits, bounded, prepare, slices, text_bytes, written
from .components import components
from .words import STEP, U, as_long, mix, shingles, stream, words

#: 32 bands of 4 minima: a pair at similarity 0.75 shares no bucket with probability 4e-6.
BANDS, ROWS = 32, 4
#: Estimated similarity below which a pair is not checked on full sets: over five standard errors below 0.75.
SURE = 0.54
_A, _B = stream(BANDS * ROWS, 101) | U(1), stream(BANDS * ROWS, 202)
_BLOCK = 1024
MAP_WORDS = 16


def minima(keys: np.ndarray) -> np.ndarray:
    """For each universal function (a x + b) / 2**32 its least value over keys."""
    least = np.full(BANDS * ROWS, 2**32 - 1, U)
    with np.errstate(over="ignore"):
        for i in range(0, len(keys), _BLOCK):
            np.minimum(least, ((keys[None, i : i + _BLOCK] * _A[:, None] + _B[:, None]) >> U(32)).min(axis=1), out=least)
    return least


def _bitmap(own: np.ndarray) -> np.ndarray:
    """MAP_WORDS words of 64 bits in which each shingle of a set sets one."""
    bits = np.zeros(64 * MAP_WORDS, bool)
    bits[((own >> U(40)) & U(64 * MAP_WORDS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        data, offs = text_bytes(batch.column(1))
        count, k1, k2, sums, maps = [], [], [], [], []
        for i, j in slices(offs):
            keys, off = shingles(words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            for d in range(j - i):
                own = np.unique(keys[off[d] : off[d + 1]])
                with np.errstate(over="ignore"):
                    k1.append(own.sum(dtype=U))
                    k2.append(mix(own + U(77)).sum(dtype=U))
                count.append(len(own))
                sums.append(minima(own))
                maps.append(_bitmap(own))
        m = np.array(sums, U).reshape(len(count), BANDS * ROWS)
        with np.errstate(over="ignore"):
            cut = m.reshape(-1, BANDS, ROWS)
            band = mix((cut * STEP[:ROWS]).sum(axis=2, dtype=U) + np.arange(1, BANDS + 1, dtype=U) * STEP[40])
        sig = np.ascontiguousarray((m & U(0xFFFF)).astype(np.uint16))
        flat = pa.array(as_long(band.reshape(-1)))
        ends = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(count, np.int64)), pa.array(as_long(np.array(k1, U))), pa.array(as_long(np.array(k2, U))), pa.ListArray.from_arrays(ends, flat), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(maps, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "k1", "k2", "bands", "sig", "map"],
        )


def _sets(filtered, log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filtered.value
        for batch in bounded(batches):
            ids = batch.column(0).drop_null().to_numpy() if batch.column(0).null_count else batch.column(0).to_numpy()
            hit = np.zeros(batch.num_rows, bool)
            valid = ~np.asarray(batch.column(0).is_null())
            hit[valid] = bloom_hits(bits, log2, ids)
            batch = batch.filter(pa.array(hit))
            data, offs = text_bytes(batch.column(1))
            for i, j in slices(offs):
                keys, off = shingles(words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                sets = [as_long(np.unique(keys[off[d] : off[d + 1]])) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "keys"])

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose signatures agree often enough."""
    for batch in batches:
        n = batch.num_rows
        if n:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) for c in (2, 3))
            keep = pa.array((one == two).mean(axis=1) >= SURE)
            yield batch.select([0, 1]).filter(keep)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (u, v) of classes those with 100 * intersection >= 75 * union: first by signature, then on full sets."""
    sig = classes.select("cls", "sig")
    tried = pairs.join(sig.toDF("u", "one"), "u").join(sig.toDF("v", "two"), "v").select("u", "v", "one", "two")
    near = written(tried.mapInArrow(_agree, "u long, v long").distinct(), "near")
    ends = near.select(F.col("u").alias("doc_id")).union(near.select("v")).distinct()
    sets = _whole(ends, docs)
    both = near.join(sets.toDF("u", "one"), "u").join(sets.toDF("v", "two"), "v")
    shared = F.size(F.array_intersect("one", "two"))
    linked = both.select("u", "v", shared.alias("n"), (F.size("one") + F.size("two")).alias("total"))
    return linked.where("n > 0 and 100L * n >= 75L * (total - n)").select("u", "v").distinct()


def _whole(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, keys: the sets of the documents in ids (doc_id)."""
    spark = ids.sparkSession
    bits, log2 = bloom(ids, "doc_id")
    found = docs.select("doc_id", "text").mapInArrow(_sets(spark.sparkContext.broadcast(bits), log2), "doc_id long, keys array<long>")
    return written(found.join(ids, "doc_id", "left_semi"), "sets")


def _apart(shared: DataFrame, part: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes of one bucket in different components that can have similarity 0.75, each from
    the first bucket that it shares.

    Only buckets whose members the stars left in several components are looked at. Sizes and bitmaps are bounds
    on the sets themselves, so no link is lost: each bit in which two bitmaps differ takes a shingle that only
    one of the sets has. They leave few pairs of a crowded bucket, for members that pass them are nearly all
    linked and so in one component already."""
    placed = shared.join(part.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("component", "cls").alias("component"))
    placed = written(placed, "placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    open_ = written(placed.join(split, "bucket", "left_semi"), "open")
    held = classes.select("cls", F.col("n_shingles").alias("n"), "map", "bands")
    earlier = F.slice("bands", F.lit(1), F.array_position("bands", F.col("bucket")).cast("int") - 1)
    one = open_.join(held, "cls").select("bucket", "cls", "component", "n", "map", earlier.alias("earlier"))
    two = one.toDF("bucket", "cls2", "component2", "n2", "map2", "earlier2")
    fits = "cls > cls2 and component <> component2 and 4 * n >= 3 * n2 and 4 * n2 >= 3 * n"
    apart = "7 * (" + " + ".join(f"bit_count(map[{i}] ^ map2[{i}])" for i in range(MAP_WORDS)) + ") <= n + n2"
    pairs = one.join(two, "bucket").where(f"{fits} and {apart} and not arrays_overlap(earlier, earlier2)")
    return written(pairs.select(F.col("cls").alias("u"), F.col("cls2").alias("v")), "rest")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Words are runs of other than ASCII white space, A-Z lower-cased; the set is of distinct five-word
    shingles (fewer words: the whole sequence), each held as a 64-bit hash. Documents whose sets have
    similarity 0.75 or more are linked; component_id is the least doc_id reachable and kept says that it
    is the document's own. Null or empty text: no shingles, linked with nothing. Rows that share a doc_id
    are one document that has every link of its rows. A null doc_id is linked with nothing: component_id
    null, kept. Other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    base = written(docs.mapInArrow(_signed, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary, map array<long>"), "signed")
    some = base.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("map").alias("map"), F.first("n_shingles").alias("n_shingles")), "classes")
    copies = some.select("k1", "k2", "doc_id").join(classes.select("k1", "k2", "cls"), ["k1", "k2"]).where("doc_id <> cls").select(F.col("doc_id").alias("u"), F.col("cls").alias("v"))

    members = written(classes.select("cls", F.explode("bands").alias("bucket")).distinct(), "members")
    # A bucket's hub is its member with most company over all its buckets: of copies that were each changed
    # on their own it is the text they were made from, which links them when they do not link each other.
    size = written(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    company = written(members.join(size, "bucket"), "company")
    weight = written(company.groupBy("cls").agg(F.sum("n").alias("weight")), "weights")
    weighed = written(company.join(weight, "cls").select("bucket", "cls", "weight"), "weighed")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("cls")).alias("neg"))).alias("top")).select("bucket", (-F.col("top.neg")).alias("hub"))
    shared = written(weighed.drop("weight").join(written(hubs, "hubs"), "bucket"), "shared")
    star = shared.where("cls <> hub").select(F.col("cls").alias("u"), F.col("hub").alias("v")).distinct()
    first = written(_links(star, classes, docs), "links")

    second = _links(_apart(shared, written(components(first), "part"), classes), classes, docs)

    found = written(components(copies.union(first).union(second)), "components")
    out = base.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
