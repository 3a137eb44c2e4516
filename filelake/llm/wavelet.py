"""Token files: documents as token ids in wavelet matrices.

A file holds the documents of one range of doc_ids as blocks, one Parquet row each, written by Spark's
own committed writer. A block is a wavelet matrix over whole documents: one bit-plane per bit of an id,
most significant first, each with running counts of its ones, so that access, rank, count and select
work on the planes alone. A block closes at the first document's end past BLOCK_TOKENS.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, prepare, written

END_ID = 2
BLOCK_TOKENS = 1 << 20
#: Bits between two stored counts of ones.
STRIDE = 512
#: Bytes of pieces of text and their ids that a worker keeps, in each of two generations; longer pieces than
#: LONG_PIECE are not kept.
KEPT_BYTES, LONG_PIECE = 128 << 20, 256
#: The same bytes where other stages have used the worker's memory (lean), and the binary logarithm of the bits that tell
#: whether a piece was met before: there one that is met once is not kept.
LEAN_BYTES, MET_LOG2 = 64 << 20, 23
#: What an entry costs besides its text and ids.
_ENTRY = 180

BLOCK_SCHEMA = (
    "shard int, block int, start long, n_tokens long, bits int, doc_ids array<long>, starts array<long>, "
    "lengths array<long>, zeros array<long>, planes array<binary>, ones array<binary>"
)


class WaveletMatrix:
    """Planes of n ids below 2**bits."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ones: list[bytes]):
        self.n, self.zeros, self.bits = n, list(zeros), len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ones = [np.frombuffer(o, np.uint32) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now, planes, zeros, ones = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            rest = np.zeros(-(-len(packed) // (STRIDE // 8)) * (STRIDE // 8), np.uint8)
            rest[: len(packed)] = np.bitwise_count(packed)
            counts = np.concatenate([[0], np.cumsum(rest.reshape(-1, STRIDE // 8).sum(axis=1, dtype=np.uint32))])
            low = np.compress(~bit, now)
            planes.append(packed.tobytes())
            zeros.append(len(low))
            ones.append(counts.astype(np.uint32).tobytes())
            now = np.concatenate([low, np.compress(bit, now)])
        return cls(len(ids), planes, zeros, ones)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // STRIDE
        whole = self.planes[level][block * STRIDE // 8 : i >> 3]
        part = int(self.planes[level][i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ones[level][block]) + int(np.bitwise_count(whole).sum()) + part.bit_count()

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the copies of value among the first i ids stand in the last order."""
        if value < 0 or value >> self.bits:
            return 0, 0
        low, high = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            if value >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, i: int) -> int:
        """Copies of value among the first i ids."""
        low, high = self._range(value, i)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) copy of value, or -1."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            return -1
        i = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the last plane's order back to the first's."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty_like(now), self.zeros[level]
            # Places by number are faster than by mask, but for planes of nearly one value.
            mixed = self.n < 16 * min(zeros, self.n - zeros)
            off, on = (np.flatnonzero(~bit), np.flatnonzero(bit)) if mixed else (~bit, bit)
            above[off] = now[:zeros]
            above[on] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = above
        return now


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from 256."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
_SPACE, _ID = BYTE_LETTERS[32], attrgetter("id")
#: Fixed pattern: the words that a byte-level pre-tokenizer finds in ASCII text.
ASCII_WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


#: Marks a word that no space stands before; texts that hold it are left to the library.
START = "\1"


class Untrusted(Exception):
    """A piece of text that could be joined to its neighbours."""


class Pieces(dict):
    """Ids of pieces of text; a piece that is not held yet is learnt, and kept, or if lean, kept when it
    is met again. All that is kept is counted: beyond `most` bytes
    the generation before is let go, and what is held now takes its place, even within a text."""

    def __init__(self, learn: Callable[[str], bytes], most: int, lean: bool = False):
        self.learn, self.most = learn, most
        self.old: dict[str, bytes] = {}
        self.bytes, self.met = 0, bytearray(1 << (MET_LOG2 - 3)) if lean else None

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) > LONG_PIECE:
            return
        if self.met is not None and piece not in self.old:
            spot = hash(piece) & ((1 << MET_LOG2) - 1)
            if not self.met[spot >> 3] >> (spot & 7) & 1:
                self.met[spot >> 3] |= 1 << (spot & 7)
                return
        if self.bytes > self.most:
            self.old = dict(self)
            self.clear()
            self.bytes, self.met = 0, self.met and bytearray(len(self.met))
        self[piece] = ids
        self.bytes += 4 * len(piece) + len(ids) + _ENTRY

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        self.keep(piece, ids)
        return ids


class Encoder:
    """Ids of whole texts by a tokenizers file, encoding each distinct piece of text once.

    A byte-level pre-tokenizer never joins text across a single space between two other characters (the
    space begins the next word), nor a single line feed between two and either of them, nor a letter and a stop
    or comma, nor white space that ends a text and what stands before it. So a text's ids are those of its pieces, one after the other. Pieces that touch other
    white space at a cut are not trusted: their texts are cut only at single spaces and not remembered."""

    def __init__(self, path: str, lean: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.feed = re.compile(r"(?<=\S)\n(?=\S)")
        # A run of letters is one word to such a pre-tokenizer, so the library's model can take it as it is.
        plain = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word = self.tokenizer.model.tokenize if plain and not any(x.isalpha() for x in self.added) else None
        self.stops = dict(zip(".,", self._by_library([".", ","]), strict=True))
        self.line_end = self._by_library(["\n"])[0]
        self.pieces = Pieces(self._learn, LEAN_BYTES if lean else KEPT_BYTES, lean)

    def _by_library(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _by_model(self, run: str) -> bytes:
        """Ids of one word of the pre-tokenizer."""
        letters = (run if run.isascii() else run.encode().decode("latin-1")).translate(BYTE_LETTERS)
        return array("I", map(_ID, self.word(letters))).tobytes()

    def _parts(self, piece: str) -> bytes | None:
        """Ids of a piece of ASCII text, word by word; None where only the library's own cuts are trusted."""
        if not piece.isascii() or any(x in piece for x in self.added):
            return None
        ids, held = [], self.pieces
        for run in ASCII_WORDS.findall(piece):
            key = run[1:] if run[0] == " " else START + run
            own = held.get(key, held.old.get(key)) if len(key) > 1 or key.isalnum() else None
            if own is None:
                own = self._by_model(run)
                if len(key) > 1:
                    held.keep(key, own)
            ids.append(own)
        return b"".join(ids)

    def _learn(self, piece: str) -> bytes:
        """Ids of a piece: a word behind a space, a word without one (marked by START), or a line feed."""
        if self.word and piece.isascii():
            # The usual pieces: letters, which stand for themselves, and maybe a stop.
            if piece.isalpha():
                return array("I", map(_ID, self.word(_SPACE + piece))).tobytes()
            if piece[-1:] in self.stops and piece[:-1].isalpha():
                return self.pieces[piece[:-1]] + self.stops[piece[-1]]
        if piece == "\n":
            return self.line_end
        x = piece[1:] if piece[:1] == START else " " + piece
        if not x or x == " " or x[1:2].isspace() or x[-1].isspace():
            raise Untrusted
        if not self.word:
            return self._by_library([x])[0]
        stop = self.stops.get(x[-1])
        body = x[:-1] if stop else x
        if not body.removeprefix(" ").isalpha():
            ids = self._parts(x)
            return self._by_library([x])[0] if ids is None else ids
        return self.pieces[piece[:-1]] + stop if stop else self._by_model(x)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        get, out = self.pieces.__getitem__, []
        for x in texts:
            body = x.rstrip(" \t\n\r")
            size = len(body)
            try:
                if START in body:
                    raise Untrusted
                if "\n" in body:
                    body = self.feed.sub(f" \n {START}", body)
                raw = b"".join(map(get, (START + body).split(" "))) if body else b""
                if size < len(x):
                    raw += self._by_library([x[size:]])[0]
            except Untrusted:
                first, *rest = self.cut.split(x)
                raw = b"".join(self._by_library([first, *[" " + p for p in rest]]))
            out.append(raw)
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str | None, lean: bool = False) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if (path, lean) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path, lean] = Encoder(path, lean)
    return _encoders[path, lean]


def _pack(path: str | None, end_id: int, lean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path, lean), TaskContext.get().partitionId()
        bits = max(coder.vocabulary - 1, end_id, 1).bit_length()
        held, ids, lengths, size, block, start = [], [], [], 0, 0, 0
        end = np.uint32(end_id).tobytes()

        def close():
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), np.uint32), bits)
            ends = np.cumsum(lengths)
            row = [shard, block, start, size, bits, held, list(ends - lengths), lengths, matrix.zeros, [p.tobytes() for p in matrix.planes], [o.tobytes() for o in matrix.ones]]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for batch in bounded(batches, 64):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, own in zip(batch.column(0).to_pylist(), coder.encode(texts), strict=True):
                held.append(doc)
                ids += (own, end)
                lengths.append(len(own) // 4 + 1)
                size += lengths[-1]
                if size >= BLOCK_TOKENS:
                    yield close()
                    block, start = block + 1, start + size
                    held, ids, lengths, size = [], [], [], 0
        if held:
            yield close()

    return run


_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ones", pa.list_(pa.binary()))]
)


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, lean: bool = False) -> DataFrame:
    """Write docs (doc_id, text) as token files in ascending doc_id order; the files, as blocks.

    One file per range of doc_ids. Null text: no ids but the end id. Null doc_ids come first; rows of one
    doc_id are ordered by their text. tokenizer: a file that the tokenizers library reads. lean: workers
    keep fewer pieces of text, so they take less memory and more time."""
    spark = docs.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ranged = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    return written(ranged.mapInArrow(_pack(tokenizer, end_id, lean), BLOCK_SCHEMA), "tokens")


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, WaveletMatrix(row["n_tokens"], row.pop("planes"), row["zeros"], row.pop("ones"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, matrix in matrices(batches):
        ids = matrix.decode().astype("<u4")
        crc = [zlib.crc32(ids[s : s + n]) for s, n in zip(row["starts"], row["lengths"], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([row["shard"]] * len(crc), pa.int32()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "local": pa.array(np.array(row["starts"], np.int64) + row["start"]),
                "n_tokens": pa.array(row["lengths"], pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
        )


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone. start adds the tokens of
    earlier files to the place in its own; that running sum is over one row per file."""
    size = files.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = size.select("shard", before.alias("first"))
    docs = files.mapInArrow(_read, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(first, "shard").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def count_token(files: DataFrame, token: int) -> DataFrame:
    """shard, block, n: copies of a token id in each block, by rank on the planes."""

    def run(batches):
        for row, matrix in matrices(batches):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]], pa.int32()), "block": pa.array([row["block"]], pa.int32()), "n": pa.array([matrix.count(token)], pa.int64())})

    return files.mapInArrow(run, "shard int, block int, n long")


def find_token(files: DataFrame, token: int) -> DataFrame:
    """doc_id, at: every occurrence of a token id, at counted from its document's first token; by select on the
    planes, without decoding a block."""

    def run(batches):
        for row, matrix in matrices(batches):
            starts = np.array(row["starts"], np.int64)
            place = np.array([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
            for i in range(0, len(place), 1 << 16):
                own = place[i : i + (1 << 16)]
                doc = np.searchsorted(starts, own, "right") - 1
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([row["doc_ids"][d] for d in doc], pa.int64()), "at": pa.array(own - starts[doc])})

    return files.mapInArrow(run, "doc_id long, at long")


def tokens_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, at, token for each row of wanted (doc_id, at) that a document has, by access on the planes.

    Places are gathered per block: a block meets only those of its own documents."""
    places = files.select("shard", "block", F.explode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("d"))
    places = places.select("shard", "block", F.col("d.doc_ids").alias("doc_id"), F.col("d.starts").alias("first"), F.col("d.lengths").alias("length"))
    asked = wanted.select("doc_id", "at").join(places, "doc_id").where("at >= 0 and at < length")
    asked = asked.groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "at", (F.col("first") + F.col("at")).alias("place"))).alias("asked"))

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                _, matrix = next(matrices(iter([one.select(names[:-1])])))
                rows = one.column(len(names) - 1)[0].as_py()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "at": pa.array([r["at"] for r in rows], pa.int64()), "token": pa.array([matrix.access(r["place"]) for r in rows], pa.int64())})

    return files.join(asked, ["shard", "block"]).mapInArrow(run, "doc_id long, at long, token long")


def token_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, lean: bool = False) -> DataFrame:
    """Encode docs into token files and return what read_documents() finds in them."""
    files = write_tokens(docs, tokenizer, end_id, lean)
    return read_documents(files)
