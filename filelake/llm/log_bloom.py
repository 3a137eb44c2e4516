"""Scores of texts by an n-gram model whose quantised counts lie in a log-frequency Bloom filter.

An n-gram of count c has level 1 + floor(log2 c) and is put in once for each level up to its own; its level is read
by probing level after level until a miss. The filter is made of segments, one for each bucket of hashes, each
built from that bucket's exact counts, so it grows with the corpus. No task and no driver holds all of it: texts are
written in chunks once, each distinct n-gram of a chunk is sent to its segment, and the segment's answers, levels and
the exact counts of words that the base score needs, are sent back to the chunk. So every text is read twice and every
key is sent once, however many segments there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, prepare, slices, text_bytes, written
from .words import SPACES, mix, stream, words

U = np.uint64
#: Bytes of a chunk's texts, and its n-grams, at most but for one longer text; bits for each level of an n-gram.
PART_BYTES, HELD, BITS = 8 << 20, 1 << 21, 12
#: n-grams of a bucket, about; levels, and steps of probabilities, that are told apart.
BUCKET, LEVELS, STEPS = 1 << 20, 64, 256
#: Binary logarithm of the buckets whose keys are sent as one row; answers that are passed on at once; how hard texts are compressed.
CELL, ANSWERS, ZSTD = 2, 512, 6
#: The most that shorter n-grams leave to longer ones, so that no token is certain.
MOST = 0.999
_END, _TIMES, _LEVEL, *_SALT = stream(12, 71)
_TIMES |= U(1)

_CHUNKS = "chunk long, held_out boolean, ids array<long>, sizes array<long>, texts binary"
_BLOCKS = "bucket int, words boolean, n long, keys binary, counts binary"
_SENT = "chunk long, " + _BLOCKS
_SEGMENTS = "bucket int, segment binary, n_words long, n_tokens long, by_level array<long>, chunk long, words boolean, levels binary, counts binary"
_STATE = "doc_id long, held_out boolean, n_tokens long, levels binary, base double, known long"


def _batch(ddl: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in ddl.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, each text closed by the end, and the offset of each text's first."""
    w = words(data, offs)
    off = w.off + np.arange(len(w.off))
    h = np.full(off[-1], _END, U)
    h[np.arange(len(w.hash)) + np.repeat(np.arange(len(offs) - 1), np.diff(w.off))] = w.hash
    return h, off


def ngrams(h: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for 1 up to order. What stands before a text is one end; an n-gram
    that would begin before that has key 0, which is counted nowhere."""
    first = off[:-1]
    with np.errstate(over="ignore"):
        keys = [mix(h + _SALT[0])]
        before, place = h, np.arange(len(h)) - np.repeat(first, np.diff(off))
        for k in range(2, order + 1):
            last = np.empty_like(before)
            last[0:1], last[1:] = _END, before[:-1]
            last[first] = _END if k == 2 else 0
            own = mix(last * _TIMES + h + _SALT[k - 1])
            if k > 2:
                own[place < k - 2] = 0
            keys.append(own)
            before = own
    return keys


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, without the planes that are zero."""
    x = np.ascontiguousarray(x.astype("<u8"))
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8")[:, 0]


def _chunked(order: int, part_bytes: int):
    """Texts to chunks, either all learnt from or all held out, each one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, number = pa.Codec("zstd", compression_level=ZSTD), TaskContext.get().partitionId() << 40
        held: dict[bool, tuple[list, list, list, list]] = {x: ([], [], [], [0]) for x in (False, True)}

        def row(out: bool):
            nonlocal number
            ids, sizes, texts, n = held[out]
            chunk = (number, out, pa.concat_arrays(ids).to_pylist(), np.concatenate(sizes).tolist(), codec.compress(b"".join(texts), asbytes=True))
            held[out], number = ([], [], [], [0]), number + 1
            return _batch(_CHUNKS, [[x] for x in chunk])

        for batch in bounded(batches):
            outs = batch.column("held_out").to_numpy(zero_copy_only=False)
            for out in (False, True):
                own = batch.filter(pa.array(outs == out))
                data, offs = text_bytes(own.column("text"))
                for i, j in slices(offs):
                    part = data[offs[i] : offs[j]]
                    size = max((np.count_nonzero(SPACES[part]) + j - i) * order / HELD, len(part) / part_bytes)  # a text has at most a word more than spaces
                    if held[out][0] and held[out][3][0] + size > 1:
                        yield row(out)
                    ids, sizes, texts, n = held[out]
                    ids.append(own.column("doc_id").slice(i, j - i))
                    sizes.append(np.diff(offs[i : j + 1]))
                    texts.append(part.tobytes())
                    n[0] += size
        for out in (False, True):
            if held[out][0]:
                yield row(out)

    return run


def _chunk_keys(row: dict, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of the tokens of a chunk's texts, and the keys of the n-grams that end at each token."""
    offs = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
    data = np.frombuffer(pa.decompress(row["texts"], int(offs[-1]), "zstd"), np.uint8)
    off, keys = [np.zeros(1, np.int64)], []
    for i, j in slices(offs):
        h, own = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        off.append(own[1:] + off[-1][-1])
        keys.append(ngrams(h, own, order))
    return np.concatenate(off), [np.concatenate(x) for x in zip(*keys, strict=True)]


def _counted(order: int, log2: int, cell: int):
    """Chunks to their distinct n-grams: rows of a cell of 2**cell buckets, sorted keys as differences. Those of held-out
    chunks, which are asked for only, have no counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            row = batch.to_pylist()[0]
            first, *more = _chunk_keys(row, order)[1]
            out = []
            for is_words, part in ((True, [first]), (False, more)):
                if not part:
                    continue
                keys, counts = np.unique(np.concatenate(part), return_counts=True)
                keys, counts = keys[keys > 0], counts[keys > 0]
                at = (keys >> U(64 - log2 + cell)).astype(np.int64)
                cuts = np.searchsorted(at, np.arange((1 << (log2 - cell)) + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    i, j = cuts[b], cuts[b + 1]
                    bucket = int(b) << cell
                    planes = _planes(np.diff(keys[i:j], prepend=U(bucket) << U(64 - log2)))
                    out.append((row["chunk"], bucket, is_words, int(j - i), planes, None if row["held_out"] else _planes(counts[i:j])))
            if out:
                yield _batch(_SENT, list(zip(*out, strict=True)))

    return run


def _spots(keys: np.ndarray, level: int, sizes: np.ndarray | U) -> tuple[np.ndarray, np.ndarray]:
    """The word of a segment, and four of its bits, for a level of an n-gram."""
    with np.errstate(over="ignore"):
        g = mix(keys + U(level) * _LEVEL)
    bits = U(0)
    for i in range(4):
        bits = bits | (U(1) << ((g >> U(6 * i)) & U(63)))
    return (((g >> U(32)) * sizes) >> U(32)).astype(np.int64), bits


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def count_of(levels: np.ndarray) -> np.ndarray:
    """The mean of the counts of a level; none for level 0."""
    return np.where(levels > 0, 1.5 * np.exp2(levels - 1.0) - 0.5, 0.0)


def _built(log2: int, cell: int = 0):
    """Sorted rows of cells to the segments of their buckets, and to the answers to each chunk: the levels that its keys
    have in the filter, in their order, and the exact counts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def summed(rows: list[dict], start: U) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not rows:
                return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys = np.concatenate([np.cumsum(_numbers(r["keys"]), dtype=U) + start for r in rows])
            counts = np.concatenate([np.zeros(r["n"], U) if r["counts"] is None else _numbers(r["counts"]) for r in rows]).astype(np.int64)
            keys, inverse = np.unique(keys, return_inverse=True)
            return keys, np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64), inverse

        def segments():
            first = held[0]["bucket"]
            start = U(first) << U(64 - log2)
            asked = {x: [r for r in held if r["words"] == x] for x in (True, False)}
            held.clear()
            found = {x: summed(rows, start) for x, rows in asked.items()}
            buckets = {x: (keys >> U(64 - log2)).astype(np.int64) - first for x, (keys, _, _) in found.items()}
            made, out = [], []
            for b in range(1 << cell):
                plain, more = (tuple(c[(buckets[x] == b) & (found[x][1] > 0)] for c in found[x][:2]) for x in (True, False))
                keys, levels = np.concatenate([plain[0], more[0]]), level_of(np.concatenate([plain[1], more[1]]))
                if not len(keys):
                    continue
                bits_of = np.zeros(max(1, -(-int(levels.sum()) * BITS // 64)), U)
                for level in range(1, int(levels.max(initial=0)) + 1):
                    word, bits = _spots(keys[levels >= level], level, U(len(bits_of)))
                    np.bitwise_or.at(bits_of, word, bits)
                made.append((first + b, bits_of.tobytes()))
                out.append((*made[-1], len(plain[0]), int(plain[1].sum()), np.bincount(level_of(plain[1]), minlength=LEVELS).tolist(), None, None, None, None))
            part = Part(log2, [(b, len(x)) for b, x in made] or [(first, 0)], made)
            for is_words, rows in asked.items():
                keys, counts, inverse = found[is_words]
                levels = part.levels(keys)
                ends = np.cumsum([r["n"] for r in rows])
                for r, j in zip(rows, ends, strict=True):
                    own = inverse[j - r["n"] : j]
                    if r.get("chunk") is not None:
                        out.append((first, None, None, None, None, r["chunk"], is_words, levels[own].tobytes(), _planes(counts[own]) if is_words else None))
            for i in range(0, len(out), ANSWERS):
                yield _batch(_SEGMENTS, list(zip(*out[i : i + ANSWERS], strict=True)))

        for batch in bounded(batches):
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield from segments()
                held.append(row)
        if held:
            yield from segments()

    return run


class Part:
    """Segments of consecutive buckets. rows may be an iterator; sizes: the bytes of each bucket's segment."""

    def __init__(self, log2: int, sizes: list[tuple[int, int]], rows: Iterable[tuple[int, bytes]]):
        self.log2, self.first, self.last = log2, sizes[0][0], sizes[-1][0]
        self.sizes = np.zeros(self.last - self.first + 1, U)
        self.sizes[[b - self.first for b, _ in sizes]] = [n // 8 for _, n in sizes]
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.words = np.zeros(int(self.sizes.sum()), U)
        for bucket, data in rows:
            at = self.starts[bucket - self.first]
            self.words[at : at + len(data) // 8] = np.frombuffer(data, U)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: 0 for one that is not of this part, or was never put in (but for false hits)."""
        out = np.zeros(len(keys), np.uint8)
        bucket = (keys >> U(64 - self.log2)).astype(np.int64)
        at = np.flatnonzero((bucket >= self.first) & (bucket <= self.last) & (keys > 0))
        sizes, starts = self.sizes[bucket[at] - self.first], self.starts[bucket[at] - self.first]
        at, sizes, starts = at[sizes > 0], sizes[sizes > 0], starts[sizes > 0]
        for level in range(1, LEVELS):
            if not len(at):
                break
            word, bits = _spots(keys[at], level, sizes)
            hit = (self.words[starts + word] & bits) == bits
            at, sizes, starts = at[hit], sizes[hit], starts[hit]
            out[at] = level
        return out


def _answered(order: int, whole: float):
    """A chunk's texts, and behind them its answers by bucket, to the levels of each text's n-grams and its base score
    without unknown words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def placed(keys: np.ndarray, *answers: np.ndarray) -> list[np.ndarray]:
            """Answers to the chunk's distinct keys in their order, as answers to each key; 0 for key 0, that of none."""
            by_key = np.argsort(keys)
            in_order = keys[by_key]
            own = np.cumsum(np.diff(in_order, prepend=U(0)) > 0, dtype=np.int32)
            if len(own) and own[-1] != len(answers[0]):
                raise ValueError(f"{own[-1]} n-grams of a chunk have {len(answers[0])} answers")
            out = [np.empty(len(keys), x.dtype) for x in answers]
            for x, values in zip(out, answers, strict=True):
                x[by_key] = np.concatenate([np.zeros(1, values.dtype), values])[own]
            return out

        def texts():
            chunk, *answers = held
            held.clear()
            off, keys = _chunk_keys(chunk, order)
            asked = {x: [r for r in answers if r["words"] == x] for x in (True, False)}
            levels = {x: np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r["levels"], np.uint8) for r in rows]]) for x, rows in asked.items()}
            counts = np.concatenate([_numbers(r["counts"]) for r in asked[True]]).astype(np.int64)
            worth = np.where(counts > 0, np.log10((counts + 0.5) / whole), np.nan)  # none for an unknown word
            found, worth = placed(keys.pop(0), levels[True], worth)
            is_known = ~np.isnan(worth)
            base, known = np.add.reduceat(np.where(is_known, worth, 0.0), off[:-1]), np.add.reduceat(is_known, off[:-1], dtype=np.int64)
            del worth, is_known, answers, asked
            found = [found, *(np.split(placed(np.concatenate(keys), levels[False])[0], order - 1) if order > 1 else [])]
            del keys
            ids, n = chunk["ids"], np.diff(off)
            for i in range(0, len(n), ANSWERS):
                own = slice(i, i + ANSWERS)  # a text's levels: all of its words, then of its bigrams, and so on
                flat = [b"".join(x[j:k].tobytes() for x in found) for j, k in zip(off[:-1][own], off[1:][own], strict=True)]
                yield _batch(_STATE, [ids[own], [chunk["held_out"]] * len(flat), n[own], flat, base[own], known[own]])

        for batch in bounded(batches):
            for row in batch.to_pylist():
                if held and row["chunk"] != held[0]["chunk"]:
                    yield from texts()
                held.append(row)
        if held:
            yield from texts()

    return run


class Model:
    """Interpolated probabilities from levels. shares[k][l]: the weight of n-grams of k + 2 words after a context of
    level l; what is left goes to the next shorter ones."""

    def __init__(self, total: float, distinct: int, shares: list[np.ndarray]):
        self.total, self.distinct, self.shares = total, distinct, shares

    def ratio(self, context: np.ndarray, own: np.ndarray, less: int) -> np.ndarray:
        below, above = count_of(context) - less, count_of(own) - less
        return np.clip(np.where(below > 0, above / np.where(below > 0, below, 1), 0.0), 0.0, 1.0)

    def words(self, levels: np.ndarray, less: int = 0) -> np.ndarray:
        return (np.maximum(count_of(levels) - less, 0.0) + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def probability(self, levels: np.ndarray, contexts: np.ndarray, order: int, less: int = 0) -> np.ndarray:
        """levels[k], contexts[k]: of the n-gram of k + 1 words at a token, and of its words but the last. less: 1
        leaves the token itself out of the counts."""
        p = self.words(levels[0], less)
        for k in range(1, order):
            share = self.shares[k - 1][contexts[k]]
            p = share * self.ratio(contexts[k], levels[k], less) + (1 - share) * p
        return p


def _levels(batch: pa.RecordBatch, order: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, levels of contexts, offsets of a batch of texts. ends: the level of the end, the first context."""
    n = batch.column("n_tokens").to_numpy()
    off = np.concatenate([[0], np.cumsum(n)])
    flat = np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint8)
    place = np.arange(off[-1]) - np.repeat(off[:-1], n) + np.repeat(off[:-1] * order, n)
    levels = np.stack([flat[place + k * np.repeat(n, n)] for k in range(order)]).astype(np.int64)
    contexts = np.zeros_like(levels)
    for k in range(1, order):
        contexts[k][1:] = levels[k - 1][:-1]
        contexts[k][off[:-1]] = ends if k == 1 else 0
    return levels, contexts, off


def _cells(order: int, model: Model, ends: int):
    """Tokens of the training texts by (level of context, level of n-gram, step of the shorter ones' probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            levels, contexts, _ = _levels(batch, model_order, ends)
            p = model.probability(levels[: order - 1], contexts[: order - 1], order - 1, less=1)
            step = np.minimum((-10 * np.log10(p)).astype(np.int64), STEPS - 1)
            cell, n = np.unique((contexts[order - 1] * LEVELS + levels[order - 1]) * STEPS + step, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    model_order = len(model.shares) + 1
    return run


def fitted(cells: np.ndarray, n: np.ndarray, model: Model, rounds: int = 40) -> np.ndarray:
    """Weights by context level that make the tokens most likely when each is left out of the counts itself
    (expectation-maximisation)."""
    context, own, step = cells // (LEVELS * STEPS), cells // STEPS % LEVELS, cells % STEPS
    ratio, p = model.ratio(context, own, 1), 10 ** (-(step + 0.5) / 10)
    share = np.full(LEVELS, 0.5)
    share[0] = 0.0
    total = np.bincount(context, weights=n, minlength=LEVELS)
    for _ in range(rounds):
        s = share[context]
        mine = s * ratio
        part = np.bincount(context, weights=n * mine / np.maximum(mine + (1 - s) * p, 1e-300), minlength=LEVELS)
        share = np.minimum(np.where(total > 0, part / np.maximum(total, 1), 0.0), MOST)
    return share


def _scored(order: int, model: Model, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            levels, contexts, off = _levels(batch, order, ends)
            score = np.add.reduceat(np.log10(model.probability(levels, contexts, order)), off[:-1]) if batch.num_rows else np.zeros(0)
            kept = [batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "known", "base")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=["doc_id", "held_out", "n_tokens", "known", "base", "score"])

    return run


def score_texts(docs: DataFrame, order: int = 2, fold: int = 1, part_bytes: int = PART_BYTES, frequent: int = 0, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs (doc_id, text).

    The model is learnt from all rows but those whose crc32(doc_id as text) modulo 5 is `fold`, the held-out ones; a
    null doc_id counts as the empty text, so it is learnt from. Tokens are words, A-Z lower-cased, and an end for
    each text; a null or empty text is the end alone. Repeated rows are learnt from, and scored, each for itself.
    base_score is that of exact word counts with half a count added. score is the log10 probability of the text by
    interpolated n-grams of up to `order` words, from levels of the filter: counts are known to within their level,
    and an n-gram that was never seen is taken for a seen one in about one case of fifty. Without training texts
    every word has the same probability. No text is cut; the filter's size follows the corpus. part_bytes:
    of a chunk's texts. frequent bounded a broadcast that is gone; it is taken still and changes nothing."""
    spark = docs.sparkSession
    prepare(spark)
    out_of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == fold
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out_of.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = plain.where("not held_out").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = max(2, (int(size) * order // (5 * bucket)).bit_length())
    cell = min(CELL, log2 - 2)

    chunks = written(plain.mapInArrow(_chunked(order, part_bytes), _CHUNKS), "chunks")
    sent = chunks.mapInArrow(_counted(order, log2, cell), _SENT)
    segments = written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_built(log2, cell), _SEGMENTS), "filter")
    sums = segments.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    distinct, total = sums[0] or 0, sums[1] or 0
    whole = total + 0.5 * (distinct + 1)
    by_level = np.zeros(LEVELS, np.int64)
    for r in segments.select(F.posexplode("by_level").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():
        by_level[r["level"]] = r["n"]
    end = mix(np.array([_END]) + _SALT[0])
    at = int(end[0] >> U(64 - log2))
    own = segments.where((F.col("bucket") == at) & F.col("segment").isNotNull()).select("segment").first()
    ends = int(Part(log2, [(at, len(own[0]))], [(at, own[0])]).levels(end)[0]) if own else 0

    answers = segments.where("chunk is not null").select("chunk", "bucket", "words", "levels", "counts")
    asked = chunks.unionByName(answers, allowMissingColumns=True)  # a chunk itself has no bucket, so it comes first
    state = written(asked.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_answered(order, whole), _STATE), "levels")

    even = by_level @ count_of(np.arange(LEVELS))  # all tokens, by the counts that levels stand for
    model = Model(float(even), distinct, [np.zeros(LEVELS) for _ in range(order - 1)])
    for k in range(2, order + 1):
        cells = state.where("not held_out").mapInArrow(_cells(k, model, ends), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        model.shares[k - 2] = fitted(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), model)

    scored = state.mapInArrow(_scored(order, model, ends), "doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + (F.col("n_tokens") - F.col("known")) * F.log10(F.lit(0.5 / whole))).alias("base_score"),
        "score",
    )
