"""Line dedup as an exact set-similarity join.

Lines of equal word sets form a class, led by its first line. Classes meet by the words of their prefixes,
rarest first, under length, positional and bitmap filters. That is a semi join: it passes on the rows of
(word, class) that have any partner, not the pairs; a second one, over what is left, keeps those that have one
with which no earlier word is shared. The rows that are left of a word are dealt out in tiles of a
bounded number of whole sets; a product of 0/1 matrices gives all intersections of a tile, and for each class it
passes on its number of links and the earliest line among them. So a line of thousands of changed copies makes
rows in proportion to its copies, and no link is lost. A line goes if an earlier one, in order of
(doc_id, line number), has a set of similarity SIMILARITY or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bloom, bloom_hits, bounded, prepare, slices, text_bytes, written
from .words import NOT_SPACE, U, Words, as_long, mix, words

#: Jaccard similarity in hundredths from which lines match.
SIMILARITY = 80
#: Counters that rarity is read from: words share them by hash, so the table has one fixed size.
COUNTERS = 1 << 21
_SLOT = U(COUNTERS - 1)
#: Marks that tell words which stand once in all documents from others; words share them by hash too.
MARKS = 1 << 25
#: Sets on each side of a tile, and words that one matrix product takes.
TILE, COLUMNS = 512, 4096
#: Sets of a tile from which a matrix product is cheaper than counting its common words one by one.
DENSE = 48


def _lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each line in data (one more than lines), and the index of each text's first line. A text has
    one line more than line feeds; a line keeps the feed that ends it."""
    feeds = np.flatnonzero(data == 10) + 1
    # A text's own end closes its last line, even behind a feed.
    ends = np.concatenate([feeds, offs[1:]])
    ends.sort(kind="stable")
    first = np.concatenate([[0], np.searchsorted(feeds, offs[1:], "right") + np.arange(1, len(offs))])
    return np.concatenate([[0], ends]).astype(np.int64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counters and marks, by parts: (part, n) with part from 0 for counters and below 0 for marks."""
    total, seen = np.zeros(COUNTERS, np.int64), np.zeros(MARKS, np.uint8)
    for batch in bounded(batches):
        data, offs = text_bytes(batch.column(0))
        for i, j in slices(offs):
            w = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], NOT_SPACE)
            total += np.bincount((w.hash & _SLOT).astype(np.int64), minlength=COUNTERS)
            mark, times = np.unique(_mark(w.hash), return_counts=True)
            seen[mark] = np.minimum(2, seen[mark] + times)
    for i in range(0, COUNTERS, _PART):
        if total[i : i + _PART].any():
            yield _counted(i // _PART, total[i : i + _PART].astype(np.uint32))
    for i in range(0, MARKS, 4 * _PART):
        if seen[i : i + 4 * _PART].any():
            yield _counted(-1 - i // (4 * _PART), seen[i : i + 4 * _PART])


_PART = 1 << 16


def _mark(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> U(24)) & U(MARKS - 1)).astype(np.int32)


def _counted(part: int, n: np.ndarray) -> pa.RecordBatch:
    """Marks are 0 to 2, so four share a byte."""
    if part < 0:
        n = n.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["part", "n"])


def _counts(part: int, n: bytes) -> np.ndarray:
    if part >= 0:
        return np.frombuffer(n, np.uint32).astype(np.int64)
    packed = np.frombuffer(n, np.uint8)
    return np.stack([packed >> 2 * k & 3 for k in range(4)], axis=1).reshape(-1).astype(np.int64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the counters, or marks, that a task has for each part."""
    total: dict[int, np.ndarray] = {}
    for batch in bounded(batches, 16):
        for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = _counts(part, n)
            total[part] = total[part] + own if part in total else own
    for part, n in sorted(total.items()):
        yield _counted(part, np.minimum(n, 2**32 - 1).astype(np.uint32) if part >= 0 else np.minimum(n, 2).astype(np.uint8))


def rarity(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rare, often): for each counter the binary logarithm, in eighths, of the words of all documents that fall on
    it; and a bit for each mark that words fall on twice or more.

    Sums meet in two steps (a task's, then those of 16 salts). COUNTERS words and MARKS quarter bytes reach the driver."""
    ddl = "part int, n binary"
    own = docs.select("text").mapInArrow(_count, ddl)
    half = own.withColumn("salt", F.spark_partition_id() % 16).repartition(F.col("part"), F.col("salt")).select("part", "n").mapInArrow(_add, ddl)
    rows = half.repartition(F.col("part")).mapInArrow(_add, ddl).toPandas()
    out, often = np.zeros(COUNTERS, np.int64), np.zeros(MARKS, bool)
    for part, n in zip(rows["part"], rows["n"], strict=True):
        if part >= 0:
            out[part * _PART : (part + 1) * _PART] = _counts(part, n)
        else:
            at = (-1 - part) * 4 * _PART
            often[at : at + 4 * _PART] = _counts(part, n) > 1
    return np.minimum(255, np.round(8 * np.log2(out + 1))).astype(np.uint8), np.packbits(often, bitorder="little")


def _prefix(size: np.ndarray) -> np.ndarray:
    """Words of each set that must hold one of any matching set's prefix; 0 for a set too small (three words
    at 80) to have a match but its equals."""
    return np.where(size * (100 - SIMILARITY) >= SIMILARITY, size + (-SIMILARITY * size // 100) + 1, 0)


def _sets(w: Words, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text, rarest first and then by hash, all texts at once; and their number."""
    of = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    rarity_of = rare[(w.hash & _SLOT).astype(np.int64)]
    # One key of text, rarity and the upper bits of the hash; where keys of different words meet, the whole hash decides.
    key = of.astype(U) << U(44) | rarity_of.astype(U) << U(36) | w.hash >> U(28)
    order = np.argsort(key)
    own, key = w.hash[order], key[order]
    if len(w.off) > 1 << 20 or ((key[1:] == key[:-1]) & (own[1:] != own[:-1])).any():
        order = np.lexsort((w.hash, rarity_of, of))
        own = w.hash[order]
    of = of[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    return own[fresh], np.bincount(of[fresh], minlength=len(w.off) - 1)


def _names(own: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k1, k2) of each set that begins at begin."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(own, begin), np.add.reduceat(mix(own + U(77)), begin)


MAP = ["map0", "map1"]
#: Sets of at most so many words have one bitmap of 64 bits, larger ones two.
FOLDED = 64
_PREFIXED = "doc_id long, line int, k1 long, k2 long, n int, size int, prefix array<long>, map0 long, map1 long"


def _bitmaps(own: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Words of 64 bits for each set that begins at begin, in which each element of it turns one bit."""
    bit = (own >> U(40)) & U(127)
    one = U(1) << (bit & U(63))
    low, high = (np.bitwise_xor.reduceat(np.where(bit >> U(6) == U(m), one, U(0)), begin) for m in range(2))
    return [np.where(size <= FOLDED, low ^ high, low), np.where(size <= FOLDED, U(0), high)]


def _prefixed(shared):
    """Lines with words. n is the number of a class's lines in the slice, on the first of them, which alone has a
    prefix; 0 on others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, often = shared.value
        for batch in bounded(batches):
            data, offs = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in slices(offs):
                raw = data[offs[i] : offs[j]]
                cut, first = _lines(raw, offs[i : j + 1] - offs[i])
                doc = np.repeat(np.arange(i, j), np.diff(first))
                line = np.arange(len(doc)) - np.repeat(first[:-1], np.diff(first))
                own, size = _sets(words(raw, cut, NOT_SPACE), rare)
                keep = np.flatnonzero(size)
                if not len(keep):
                    continue
                size, id_, line = size[keep], ids[doc[keep]], line[keep]
                begin = np.cumsum(size) - size
                k1, k2 = _names(own, begin)
                order = np.lexsort((line, id_, k2, k1))
                lead = np.flatnonzero(np.concatenate([[True], (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])]))
                n = np.zeros(len(keep), np.int32)
                n[order[lead]] = np.diff(np.append(lead, len(keep)))
                take = np.where(n > 0, _prefix(size), 0)
                rarest = own[_gather(begin, take)]
                # A word that stands once in all documents joins nothing: 0 holds its place.
                mark = _mark(rarest)
                rarest = np.where(often[mark >> 3] >> (mark & 7).astype(np.uint8) & 1, rarest, U(0))
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(as_long(rarest)))
                maps = [pa.array(as_long(np.where(n > 0, m, U(0)))) for m in _bitmaps(own, begin, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(id_, pa.int64()), pa.array(line.astype(np.int32)), pa.array(as_long(k1)), pa.array(as_long(k2)), pa.array(n), pa.array(size.astype(np.int32)), prefix, *maps],
                    names=["doc_id", "line", "k1", "k2", "n", "size", "prefix", *MAP],
                )

    return run


#: Bits of a spot: a line's number, and above it the lower bits of its k1, which tell lines of a repeated doc_id apart.
_LINE, _TAG = 0xFFFFFFFF, 0xFFFF


def _whole_sets(shared):
    """Sets, rarest word first, of the lines whose name is in two filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, one, two = shared.value
        for batch in bounded(batches):
            data, offs = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in slices(offs):
                raw = data[offs[i] : offs[j]]
                cut, first = _lines(raw, offs[i : j + 1] - offs[i])
                doc = np.repeat(np.arange(i, j), np.diff(first))
                line = np.arange(len(doc)) - np.repeat(first[:-1], np.diff(first))
                name = ids[doc] ^ (line << 40)
                hit = np.flatnonzero(bloom_hits(*one, name) & bloom_hits(*two, ~name))
                if not len(hit):
                    continue
                # Only the lines that are hit are cut into words.
                own_cut = np.concatenate([[0], np.cumsum(cut[hit + 1] - cut[hit])])
                picked = raw[_gather(cut[hit], np.diff(own_cut))]
                own, size = _sets(words(picked, own_cut, NOT_SPACE), rare)
                hit, size = hit[size > 0], size[size > 0]
                if not len(hit):
                    continue
                off = np.concatenate([[0], np.cumsum(size)])
                spot = line[hit] | (_names(own, off[:-1])[0] & U(_TAG)).astype(np.int64) << 32
                sets = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(as_long(own)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[hit]], pa.int64()), pa.array(spot), sets], names=["doc_id", "spot", "words"])

    return run


def linked(sets: list[np.ndarray], word: int) -> np.ndarray:
    """Which sets (ordered lists that all hold word) match, as far as word is the first that two have in common."""
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    early = at < at[flat == word][row]
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[code]
    common = np.zeros((len(sets), len(sets)), np.float32)
    before = np.zeros_like(common)
    for low in range(0, int(column.max()) + 1, COLUMNS):
        for out, chosen in ((common, True), (before, early)):
            k = np.flatnonzero((column >= low) & (column < low + COLUMNS) & chosen)
            if len(k):
                used, place = np.unique(column[k], return_inverse=True)
                held = np.zeros((len(sets), len(used)), np.float32)
                held[row[k], place] = 1
                out += held @ held.T
    link = (100 * common >= SIMILARITY * (size[:, None] + size[None, :] - common)) & (before == 0)
    np.fill_diagonal(link, False)
    return link


_FOUND = "k1 long, k2 long, n_links long, other_id long, other_line int"


@dataclass
class Tiles:
    """Rows of whole tiles, in order of (tile, doc_id, line)."""

    tile: np.ndarray
    word: np.ndarray
    cross: np.ndarray  # whether the row's tile has two sides
    side: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    size: np.ndarray
    flat: np.ndarray  # all words, row by row

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of two lines, on two sides where the tile has two."""
        return ((self.doc[a] != self.doc[b]) | (self.line[a] != self.line[b])) & ~(self.cross[a] & (self.side[a] == self.side[b]))


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at begin."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _pairs(t: Tiles, rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (a, b) of the tiles of `rows`, which are small: common words are counted pair by pair, all
    tiles at once."""
    size = t.size[rows]
    flat, row = t.flat[_gather(begin[rows], size)], np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    early = at < at[flat == t.word[rows][row]][row]
    tile = t.tile[rows]
    count = np.bincount(tile - tile[0])
    count = count[count > 0]
    of = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(count * count) - count * count
    # Runs of equal (tile, word), rows ascending in each; every later entry of a run makes a pair with an earlier one.
    order = np.lexsort((flat, of[row]))
    flat, row, early = flat[order], row[order], early[order]
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (of[row[1:]] != of[row[:-1]])])
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(flat)))
    later = np.repeat(start + run, run) - np.arange(len(flat)) - 1
    one, two = np.repeat(np.arange(len(flat)), later), _gather(np.arange(len(flat)) + 1, later)
    a, b = row[one], row[two]
    slot = base[of[a]] + place[a] * count[of[a]] + place[b]
    n = int((count * count).sum())
    common, before = np.bincount(slot, minlength=n), np.bincount(slot[early[one] & early[two]], minlength=n)
    hit = np.flatnonzero((common > 0) & (before == 0))
    of_hit = np.searchsorted(base, hit, "right") - 1
    first = (np.cumsum(count) - count)[of_hit]
    a, b = first + (hit - base[of_hit]) // count[of_hit], first + (hit - base[of_hit]) % count[of_hit]
    good = 100 * common[hit] >= SIMILARITY * (size[a] + size[b] - common[hit])
    return rows[a[good]], rows[b[good]]


def _links(t: Tiles) -> pa.RecordBatch | None:
    begin = np.cumsum(t.size) - t.size
    n = np.bincount(t.tile, minlength=t.tile[-1] + 1)
    one, two = [], []
    small = np.flatnonzero((n[t.tile] > 1) & (n[t.tile] < DENSE))
    if len(small):
        a, b = _pairs(t, small, begin)
        one.append(a), two.append(b)
    for g in np.flatnonzero(n >= DENSE):
        rows = np.flatnonzero(t.tile == g)
        a, b = np.nonzero(np.triu(linked([t.flat[begin[r] : begin[r] + t.size[r]] for r in rows], t.word[rows[0]])))
        one.append(rows[a]), two.append(rows[b])
    if not one:
        return None
    a, b = np.concatenate(one), np.concatenate(two)
    sound = t.may_link(a, b)
    a, b = a[sound], b[sound]
    links = np.bincount(a, minlength=len(t.tile)) + np.bincount(b, minlength=len(t.tile))
    least = np.full(len(t.tile), len(t.tile))
    np.minimum.at(least, a, b)
    np.minimum.at(least, b, a)
    hit = np.flatnonzero(links)
    other = least[hit]
    k1, k2 = (as_long(k[hit]) for k in _names(t.flat.view(U), begin))
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(links[hit]), pa.array(t.doc[other]), pa.array(t.line[other].astype(np.int32))], names=["k1", "k2", "n_links", "other_id", "other_line"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each class in a tile: rows (word, lo, hi, side, doc_id, spot, words), those of a tile together.
    Tiles of two sides hold the pairs between these alone. A task holds one slice of rows and an open tile."""
    rest = None

    def ready(table: pa.Table, whole: bool):
        table = table.combine_chunks()
        word, lo, hi, side, doc, spot = (table.column(c).to_numpy() for c in range(6))
        line = spot & _LINE
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        end = len(word) if whole else int(np.flatnonzero(new)[-1])
        if not end:
            return table, None
        lists = table.column(6).chunk(0)
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        tile = np.cumsum(new)[:end] - 1
        order = np.lexsort((line[:end], doc[:end], tile))
        size = np.diff(offs)[order].astype(np.int64)
        held = Tiles(tile[order], word[order], (lo != hi)[order], side[order], doc[order], line[order], size, flat[_gather(offs[:-1][order].astype(np.int64), size)])
        return table.slice(end), _links(held)

    for batch in bounded(batches, 4 * BATCH_ROWS):
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            rest, out = ready(table if rest is None else pa.concat_tables([rest, table]), False)
            if out is not None and out.num_rows:
                yield out
    if rest is not None and rest.num_rows:
        out = ready(rest, True)[1]
        if out is not None and out.num_rows:
            yield out


def matching_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, links): every line with words as (doc_id, line, k1, k2, n), k1 and k2 naming its class and n as of
    _prefixed, and for each class that matches others without being equal (k1, k2, least, n_links): the least first
    line of the others, and their number."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    rare, often = rarity(docs)
    base = written(docs.mapInArrow(_prefixed(spark.sparkContext.broadcast((rare, often))), _PREFIXED), "lines")
    # A class has one row a slice, so that dealing them out before they are grouped sorts them but once.
    classes = base.where("n > 0").repartition("k1", "k2").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line")).alias("first"), *[F.first(c).alias(c) for c in ("size", "prefix", *MAP)])
    spot = F.shiftleft(F.col("k1").bitwiseAND(F.lit(_TAG)), 32).bitwiseOR(F.col("first.line").cast("long")).alias("spot")
    mine = classes.select("first.doc_id", spot, "size", *MAP, F.posexplode("prefix").alias("at", "word")).where("word <> 0")
    # Of this longest table, size and place share a column.
    mine = mine.select("word", "doc_id", "spot", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("pos"), *MAP)

    # One table under two names, so that both sides of the join read one shuffle.
    one, two = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"two.{c}"))
    size, at = (lambda of: F.shiftright(of("pos"), 32)), (lambda of: of("pos").bitwiseAND(F.lit(0xFFFFFFFF)))
    both = size(one) + size(two)
    need = F.ceil(both * SIMILARITY / (100.0 + SIMILARITY) - 1e-9)
    fits = (size(one) * 100 >= size(two) * SIMILARITY) & (size(two) * 100 >= size(one) * SIMILARITY)
    # At a pair's first common word at most these many are left to share, for words stand in one order.
    left = F.least(size(one) - at(one), size(two) - at(two))
    # Each bit in which two sets' bitmaps differ takes a word that only one of them has. Bitmaps of 64 bits are folded ones.
    differ = lambda m: one(m).bitwiseXOR(two(m))
    whole = (size(one) > FOLDED) & (size(two) > FOLDED)
    apart = F.when(whole, F.bit_count(differ(MAP[0])) + F.bit_count(differ(MAP[1]))).otherwise(F.bit_count(differ(MAP[0]).bitwiseXOR(differ(MAP[1]))))
    close = apart * (100 + SIMILARITY) <= both * (100 - SIMILARITY)
    other = (one("doc_id") != two("doc_id")) | (one("spot").bitwiseAND(F.lit(_LINE)) != two("spot").bitwiseAND(F.lit(_LINE)))
    partner = (one("word") == two("word")) & close & other & fits & (left >= need)
    open_ = mine.alias("one").join(mine.alias("two"), partner, "left_semi")
    # The word of a class's row before this one; where two rows have it in common, this is not their pair's first.
    own = Window.partitionBy("doc_id", "spot", F.shiftright("pos", 32), *MAP).orderBy("pos")
    open_ = written(open_.select("*", F.lag("word").over(own).alias("before")), "meeting")
    # No pair of a word has it as its first where all rows have the same word before; else rows are tried against each
    # other, unless the word is crowded: that would take time with the square of its rows.
    first = open_.groupBy("word").agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.count("before").alias("known"), F.count("*").alias("n")).where("known < n or lo <> hi").select("word", "n")
    open_ = open_.join(first, "word")
    few = open_.where(F.col("n") <= TILE)
    few = few.alias("one").join(few.alias("two"), partner & F.coalesce(one("before") != two("before"), F.lit(True)), "left_semi")
    names = ["word", "doc_id", "spot"]
    open_ = written(few.select(*names).unionByName(open_.where(F.col("n") > TILE).select(*names)).distinct(), "open")

    name = F.col("doc_id").bitwiseXOR(F.shiftleft(F.col("spot").bitwiseAND(F.lit(_LINE)), 40))
    ends = written(open_.select(name.alias("name")).distinct().select("name", F.bitwise_not("name").alias("turned")), "ends")
    filters = bloom(ends, "name"), bloom(ends, "turned")
    found = docs.mapInArrow(_whole_sets(spark.sparkContext.broadcast((rare, *filters))), "doc_id long, spot long, words array<long>")
    # Rows that repeat a doc_id may put several sets behind one line: each is judged, but not against the other.
    sets = found.repartition("doc_id", "spot").dropDuplicates(["doc_id", "spot", "words"])
    crowded = open_.groupBy("word").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    dealt = open_.join(crowded, "word", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    side = F.pmod(F.xxhash64("doc_id", "spot"), F.col("tiles")).cast("int")
    dealt = dealt.select("word", "doc_id", "spot", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("facing"))
    dealt = dealt.select("word", F.least("side", "facing").alias("lo"), F.greatest("side", "facing").alias("hi"), "side", "doc_id", "spot")
    dealt = dealt.join(sets, ["doc_id", "spot"]).where(F.array_contains("words", F.col("word"))).select("word", "lo", "hi", "side", "doc_id", "spot", "words")
    tiles = dealt.repartition("word", "lo", "hi").sortWithinPartitions("word", "lo", "hi")
    links = tiles.mapInArrow(_tiles, _FOUND).groupBy("k1", "k2").agg(F.min(F.struct(F.col("other_id").alias("doc_id"), F.col("other_line").alias("line"))).alias("least"), F.sum("n_links").alias("n_links"))
    return base.select("doc_id", "line", "k1", "k2", "n"), written(links, "links")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, n_links of each line that goes: one whose class has an earlier line or a link to a
    class that has; n_links counts the linked classes."""
    lines, links = matching_lines(docs)
    firsts = lines.where("n > 0").repartition("k1", "k2").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.sum("n").alias("n"))
    known = firsts.join(links, ["k1", "k2"], "left").where("n > 1 or least is not null")
    known = written(known.select("k1", "k2", F.least("first", F.coalesce("least", "first")).alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    gone = lines.drop("n").join(known, ["k1", "k2"]).where(F.struct("doc_id", "line") > F.col("least"))
    return gone.select("doc_id", "line", "n_links")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, text for each row of docs (doc_id, text).

    Lines are what line feeds part; words are runs of other than ASCII white space, A-Z lower-cased, held
    as 64-bit hashes. Lines without words stay and match nothing. text is the text without the lines that
    went, null if it was null (it has no lines). Rows that repeat a doc_id number their lines alike: of
    equal (doc_id, line) the first does not remove the other, and a line that goes from one goes from all.
    Rows of null doc_id come back whole and match nothing. Other columns are not read."""
    gone = written(repeated_lines(docs).groupBy("doc_id", "line").agg(F.max("n_links").alias("n_links")), "gone")
    # Texts that lose nothing stay where they are; only those that a filter of doc_ids catches are joined.
    filtered = docs.sparkSession.sparkContext.broadcast(bloom(gone.select("doc_id").distinct(), "doc_id"))

    @F.arrow_udf("boolean")
    def caught(ids: pa.Array) -> pa.Array:
        known = ~np.asarray(ids.is_null())
        known[known] = bloom_hits(*filtered.value, ids.drop_null().to_numpy())
        return pa.array(known)

    marked = docs.select("doc_id", "text", caught("doc_id").alias("caught"))
    gone = gone.groupBy("doc_id").agg(F.collect_list("line").alias("gone"), F.sum("n_links").alias("n_links"))
    whole = marked.where("not caught").select("doc_id", "text", F.lit(0).alias("n_removed"), F.lit(None).cast("long").alias("n_links"), F.col("text").alias("kept"))
    gone_ = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    parts = F.split("text", "\n")
    # A difference of sets of places: a text of many lines, of which many go, takes time in proportion.
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), gone_)
    kept = F.when(F.col("text").isNull() | (F.size(gone_) == 0), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get("all", i)), "\n"))
    less = marked.where("caught").join(gone.hint("shuffle_hash"), "doc_id", "left").withColumn("all", parts).select("doc_id", "text", F.size(gone_).alias("n_removed"), "n_links", kept.alias("kept"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return less.unionByName(whole).select("doc_id", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("kept").alias("text"))
