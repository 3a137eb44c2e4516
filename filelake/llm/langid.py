"""Language identification as inference of a mixture of languages in each document.

Each language is a distribution over hashed byte trigrams of letters. A document's language proportions
are the maximum of its mixture likelihood, found by expectation-maximisation; of the nested sets of its
likeliest languages the one of least penalised likelihood (BIC) is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded, prepare, slices, text_bytes, written

#: Hashed trigrams; labelled documents of each language that the model is fitted on (a hash-chosen sample).
BUCKETS, SAMPLE = 1 << 15, 4000
#: Sizes up to which sets of languages are tried in any case; larger ones only while some text gains by them.
SET = 4
#: Languages for which a slice of SLICE_BYTES is meant: with more of them slices are shorter, so that grams times
#: languages, and with them a task's memory, stay the same.
SLICE_LANGUAGES = 4
STEPS, SMOOTH = 12, 0.5
UNKNOWN = "und"
#: Quartile ranges below the median fit from which a text is held to be in no learnt language.
FAR = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters keep their bytes, all else is one space.
_LETTER = np.where([b >= 128 or 97 <= b <= 122 for b in range(256)], np.arange(256), 32)[_LOWER].astype(np.uint32)
_MAYBE_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams, and the text of each; runs of other than letters count as one space, and a space
    stands before and behind each text."""
    n = len(offs) - 1
    x = np.full(len(data) + 2 * n, 32, np.uint32)
    shift = 2 * np.arange(n) + 1
    x[np.arange(len(data)) + np.repeat(shift, np.diff(offs))] = _LETTER[data]
    text = np.repeat(np.arange(n), np.diff(offs) + 2)
    keep = (x != 32) | np.concatenate([[True], (x[:-1] != 32) | (text[:-1] != text[1:])])
    x, text = x[keep], text[keep]
    if len(x) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    key = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    whole = text[:-2] == text[2:]
    return key[whole], text[:-2][whole]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in bounded(batches):
        langs = batch.column(0).to_pylist()
        data, offs = text_bytes(batch.column(1))
        for i, j in slices(offs):
            key, text = grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            own = np.array(langs[i:j], object)[text] if len(text) else []
            for lang in set(langs[i:j]):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if len(text):
                    total[lang] += np.bincount(key[own == lang], minlength=BUCKETS)
    for lang, n in total.items():
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(n[hit])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> Model:
    """Fit on SAMPLE rows or so of each language of labelled (doc_id, lang, text), chosen by a hash of
    doc_id and the text's length. Rows of null lang are not used; every other label is a language. What reaches
    the driver has at most BUCKETS rows for each language, as the model itself."""
    labelled = labelled.where("lang is not null")
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.where(draw < F.element_at(share, F.col("lang")))
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(r["lang"] for r in sizes)
    n = np.zeros((BUCKETS, len(languages)))
    n[counts["bucket"].to_numpy(), [languages.index(x) for x in counts["lang"]]] = counts["n"]
    return Model(languages, np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32))


def _em(log_p: np.ndarray, count: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text; its grams are rows of log_p from first[text] on."""
    text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(count))))
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        joint = p * share[text]
        joint *= (count / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, first, axis=0)
        share /= share.sum(axis=1, keepdims=True)
    like = np.add.reduceat(count * (np.log((p * share[text]).sum(axis=1)) + top[:, 0]), first)
    return share, like


def infer(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts that have grams, their proportions over the chosen language sets, their log-likelihood per gram)."""
    key, text = grams(data, offs)
    if not len(key) or not model.languages:
        return np.zeros(0, np.int64), np.zeros((0, len(model.languages))), np.zeros(0)
    both, count = np.unique(text.astype(np.uint64) << np.uint64(16) | key, return_counts=True)
    texts, first = np.unique(both >> np.uint64(16), return_index=True)
    log_p = model.log_p[(both & np.uint64(0xFFFF)).astype(np.int64)].astype(np.float64)
    count, total = count.astype(np.float64), np.add.reduceat(count, first).astype(np.float64)
    n = len(model.languages)
    full, like = _em(log_p, count, first, np.ones((len(texts), n)))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best = best_cost = None
    for size in range(1, n + 1):
        share, like_now = (full, like) if size == n else _em(log_p, count, first, np.where(rank < size, 1.0, 1e-12))
        cost = -2 * like_now + (size - 1) * np.log(total + 1)
        better = np.ones(len(texts), bool) if best is None else cost < best_cost
        if size > SET and not better.any():
            break
        best = share if best is None else np.where(better[:, None], share, best)
        like = like_now if best_cost is None else np.where(better, like_now, like)
        best_cost = cost if best_cost is None else np.minimum(cost, best_cost)
    return texts.astype(np.int64), best, like / total


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in bounded(batches):
            lang = np.full(batch.num_rows, UNKNOWN, object)
            score, fit_, mixed = np.zeros(batch.num_rows), np.zeros(batch.num_rows), [""] * batch.num_rows
            spread, n_bytes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            data, offs = text_bytes(batch.column(1))
            values = batch.column(1)
            for i, j in slices(offs, max(1, SLICE_BYTES * SLICE_LANGUAGES // max(SLICE_LANGUAGES, len(model.languages)))):
                texts, share, like = infer(model, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for t, s, x in zip(texts.tolist(), share, like.tolist(), strict=True):
                    own = data[offs[i + t] : offs[i + t + 1]]
                    ascii_letter = bool(((own | 32) - 97 < 26).any())
                    if ascii_letter or any(c.isalpha() for c in values[i + t].as_py() or ""):
                        k = int(s.argmax())
                        lang[i + t], score[i + t], fit_[i + t] = model.languages[k], min(1.0, float(s[k])), x
                        mixed[i + t] = ",".join(model.languages[m] for m in np.flatnonzero(s > 0.01))
                        spread[i + t], n_bytes[i + t] = -float((s * np.log(np.maximum(s, 1e-12))).sum()), len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array(fit_), pa.array(mixed, pa.string()), pa.array(spread), pa.array(n_bytes)], names=["doc_id", "lang", "lang_pred", "score", "log_likelihood", "languages", "spread", "n_bytes"])

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id's digits, modulo 5, is 0. Null: false."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def inferred(docs: DataFrame) -> DataFrame:
    """doc_id, lang (as given), lang_pred, score, log_likelihood, languages, spread (entropy of the
    proportions in nats), n_bytes; see identify()."""
    spark = docs.sparkSession
    prepare(spark)
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    shared = spark.sparkContext.broadcast(fit(marked.where("not held_out").select("doc_id", "lang", "text")))
    return marked.select("doc_id", "text", "lang").mapInArrow(_predict(shared), "doc_id long, lang string, lang_pred string, score double, log_likelihood double, languages string, spread double, n_bytes long")


def foreign(found: DataFrame) -> Column:
    """Of rows of inferred(), which are in no learnt language: none found, or a fit far below that of the
    documents that are found in the language that they are labelled with.

    A mixture of languages loses up to the entropy of its proportions a gram against its languages alone,
    so that is given back. The range has two parts, FAR quartile ranges each: that of the fits, and that of
    their deviations times the root of the length, for short texts scatter more. A range over all such
    documents, in one row; they themselves are never foreign, and without any only texts without a language are."""
    fit_ = F.col("log_likelihood") + F.col("spread")
    own = found.where((F.col("lang") == F.col("lang_pred")) & (F.col("lang_pred") != UNKNOWN)).select(fit_.alias("fit"), F.sqrt("n_bytes").alias("root"))
    q = F.percentile_approx("fit", [0.25, 0.5, 0.75], 10000)
    low, mid, high = own.agg(q.alias("q")).first()["q"] or (0.0, 0.0, float("inf"))
    scaled = (F.col("fit") - mid) * F.col("root")
    a, b = own.agg(F.percentile_approx(scaled, [0.25, 0.75], 10000).alias("q")).first()["q"] or (0.0, 0.0)
    learnt = F.coalesce(F.col("lang") == F.col("lang_pred"), F.lit(False))
    return (F.col("lang_pred") == UNKNOWN) | ~learnt & (fit_ < mid - FAR * ((high - low) + (b - a) / F.sqrt(F.greatest("n_bytes", F.lit(1)))))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, log_likelihood, languages for each row of docs (doc_id, text, lang).

    The model is fitted on text and non-null lang of documents that are not held out (those of null doc_id
    are used); see fit(). lang_pred is the language of largest proportion in the document's chosen set,
    score that proportion, languages the set. A text that is null or has no letter, or any if there is
    nothing to learn from: und, 0. Repeated rows are each predicted alike; other columns are not read."""
    return inferred(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "log_likelihood", "languages")
