"""Benchmark decontamination: windows of item words found in documents by their rarest word.

A window must be contained whole, so the necessary prefix of its words, ordered by rarity over all
documents, is one word. Documents' words are joined to windows by that word; the word's place in the
window and the document's ends bound where the window can stand; there all its words are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, prepare, slices, text_bytes
from .words import ALNUM, STEP, U, as_long, mix, words

WINDOW = 10
#: Characters of items that one pass over the documents carries; a larger set takes several passes.
PASS_CHARS = 8_000_000
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


@dataclass
class Items:
    """Windows of one pass. Groups, ordered by the rarest word, are at most WINDOW * (WINDOW + 1) / 2 of a word."""

    anchor: np.ndarray  # of each group the rarest word's hash, ascending
    at: np.ndarray  # its place in the window
    size: np.ndarray
    key: np.ndarray  # of each window a hash of its group and words, ascending
    row: np.ndarray  # hashes of all words, zeros behind short windows
    item: np.ndarray  # index into ids
    ids: list[str]
    spots: np.ndarray  # which low 16 bits of a word's hash occur in anchor


def _windows(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(item, words, row of word hashes, names) of the distinct windows of items; all in arrays."""
    rows = [(str(r[0]), r[1]) for r in rows if r[0] is not None and r[1]]
    ids = sorted({r[0] for r in rows})
    raw = [r[1].encode() for r in rows]
    w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), ALNUM)
    have = np.diff(w.off)
    count = np.where(have > 0, np.maximum(have - WINDOW, 0) + 1, 0)
    text = np.repeat(np.arange(len(rows)), count)
    start = np.arange(count.sum()) + np.repeat(w.off[:-1] - (np.cumsum(count) - count), count)
    size = np.minimum(have, WINDOW)[text]
    padded = np.concatenate([w.hash, np.zeros(WINDOW, U)])
    row = np.stack([np.where(size > j, padded[start + j], U(0)) for j in range(WINDOW)], axis=1) if len(start) else np.zeros((0, WINDOW), U)
    place = {x: i for i, x in enumerate(ids)}
    item = np.array([place[r[0]] for r in rows], np.int64)[text]
    keyed = np.column_stack([item.astype(U), size.astype(U), row])
    kept = np.unique(keyed, axis=0, return_index=True)[1] if len(keyed) else np.zeros(0, np.int64)
    return item[kept], size[kept], row[kept], ids


def _tally(vocabulary):
    """How often each word of vocabulary stands in the documents: one sum per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for batch in bounded(batches):
            data, offs = text_bytes(batch.column(0))
            for i, j in slices(offs):
                h = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM).hash
                h = h[_spots(known)[(h & U(0xFFFF)).astype(np.int64)]]
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                total += np.bincount(at[known[at] == h], minlength=len(known))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(known[hit])), pa.array(total[hit])], names=["word", "n"])

    return run


def _spots(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(hashes & U(0xFFFF)).astype(np.int64)] = True
    return out


def _find(w, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of every occurrence of a window, and the distinct (text, item) of them. A word
    is tried once for each place and size that windows give it, whatever number of windows it anchors."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(items.spots[(w.hash & U(0xFFFF)).astype(np.int64)])
    low, high = np.searchsorted(items.anchor, w.hash[at], "left"), np.searchsorted(items.anchor, w.hash[at], "right")
    have = high - low
    if not have.sum():
        return none, none, none, none, none
    group = np.repeat(low - np.concatenate([[0], np.cumsum(have)[:-1]]), have) + np.arange(have.sum())
    word = np.repeat(at, have)
    text = np.searchsorted(w.off, word, "right") - 1
    start, size = word - items.at[group], items.size[group]
    sound = (start >= w.off[text]) & (start + size <= w.off[text + 1])
    group, start, size, text = group[sound], start[sound], size[sound], text[sound]
    padded = np.concatenate([w.hash, np.zeros(WINDOW, U)])
    seen = lambda j: np.where(size > j, padded[start + j], U(0))
    key = _key(group, [seen(j) for j in range(WINDOW)])
    spot = np.searchsorted(items.key, key, "left")
    ok = spot < len(items.key)
    ok[ok] = items.key[spot[ok]] == key[ok]
    start, size, text, spot = start[ok], size[ok], text[ok], spot[ok]
    for j in range(WINDOW):  # each word for itself
        ok = seen(j) == items.row[spot, j]
        start, size, text, spot = start[ok], size[ok], text[ok], spot[ok]
    pairs = np.unique(np.column_stack([text, spot]), axis=0)
    many = np.searchsorted(items.key, items.key[pairs[:, 1]], "right") - pairs[:, 1]
    held = np.repeat(pairs[:, 1] - np.cumsum(many) + many, many) + np.arange(many.sum())
    named = np.unique(np.column_stack([np.repeat(pairs[:, 0], many), items.item[held]]), axis=0)
    return text, start, size, named[:, 0], named[:, 1]


def _key(group: np.ndarray, row: list[np.ndarray]) -> np.ndarray:
    """A window's words and its group as one hash."""
    with np.errstate(over="ignore"):
        total = mix(group.astype(U) + U(1))
        for j, x in enumerate(row):
            total = total + x * STEP[j]
        return mix(total)


def _grouped(anchor: np.ndarray, at: np.ndarray, n: np.ndarray, row: np.ndarray, item: np.ndarray, ids: list[str]) -> Items:
    """Windows by (anchor, its place, number of words), each group's by the hash of their words."""
    order = np.lexsort((n, at, anchor))
    anchor, at, n, row, item = anchor[order], at[order], n[order], row[order], item[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1]) | (n[1:] != n[:-1])
    key = _key(np.cumsum(new) - 1, list(row.T))
    by_key = np.argsort(key, kind="stable")
    return Items(anchor[new], at[new], n[new], key[by_key], row[by_key], item[by_key], ids, _spots(anchor))


def _scan(shared, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in bounded(batches):
            hits, found = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            count = np.zeros(batch.num_rows, np.int64)
            data, offs = text_bytes(batch.column(1))
            for i, j in slices(offs):
                w = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
                count[i:j] = np.diff(w.off)
                text, start, size, holder, item = _find(w, items)
                open_at = np.bincount(start, minlength=len(w.hash) + 1) - np.bincount(start + size, minlength=len(w.hash) + 1)
                hit = np.flatnonzero(np.cumsum(open_at) > 0)  # windows stay within their text
                owner = np.searchsorted(w.off, hit, "right") - 1
                for d in np.unique(text):
                    hits[i + d] += (hit[owner == d] - w.off[d]).tolist()
                    found[i + d] += [items.ids[x] for x in item[holder == d]]
            if last:
                yield _digest(batch.column(0), count, hits, found)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hits", "items"])

    return run


def _digest(doc_id: pa.Array, n_words: np.ndarray, hits: list[list[int]], found: list[list[str]]) -> pa.RecordBatch:
    n_hit, names = [len(set(x)) for x in hits], [sorted(set(x)) for x in found]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": doc_id,
            "n_words": pa.array(n_words),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(x) for x in names], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
            "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_()),
        }
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    benchmark: item_id, text. Words are runs of ASCII letters and digits (A-Z lower-cased) and of all
    characters beyond ASCII. Windows are WINDOW consecutive words of an item; an item of fewer is one
    window, one without words none. Null texts have no words; items of null item_id have no name and are
    left out; rows that repeat an item_id add windows to it; repeated documents are each judged. Items are
    taken in passes of about PASS_CHARS characters, each a narrow step over all documents, so the size of
    what is broadcast is bounded. Words are compared as 64-bit hashes, each of a window's for itself."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / PASS_CHARS))
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        item, n, row, ids = _windows(rows)
        known = np.unique(row[row != 0])
        tallied = docs.select("text").mapInArrow(_tally(spark.sparkContext.broadcast(known)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas() if len(known) else None
        rarity = np.zeros(len(known), np.int64)
        if tallied is not None and len(tallied):
            rarity[np.searchsorted(known, tallied["word"].to_numpy(np.int64).view(U))] = tallied["n"]
        # The rarest word of each window; ties go to the lesser hash. Places behind a short window never win.
        place = np.minimum(np.searchsorted(known, row), max(0, len(known) - 1))
        behind = np.arange(WINDOW) >= n[:, None]
        cost = np.where(behind, np.iinfo(np.int64).max, rarity[place]) if len(row) else np.zeros((0, WINDOW), np.int64)
        least = cost == cost.min(axis=1, keepdims=True) if len(row) else cost.astype(bool)
        at = np.where(least & ~behind, place, len(known)).argmin(axis=1) if len(row) else np.zeros(0, np.int64)
        anchor = row[np.arange(len(row)), at]
        shared = spark.sparkContext.broadcast(_grouped(anchor, at, n, row, item, ids))
        last = k == passes - 1
        out = out.mapInArrow(_scan(shared, last), DIGEST if last else "doc_id long, text string, n_words long, hits array<long>, items array<string>")
    return out
