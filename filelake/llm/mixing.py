"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bounded, prepare, slices, text_bytes, written
from .words import NOT_SPACE, U, words

#: Topics, each a fixed share of the vocabulary; a document's is the one it leans to most. They stand in where
#: documents carry no topic of their own.
TOPICS = 8
#: Exponents that temper each margin's token shares into its targets where none are given (1: as they are, 0: all equal).
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Share of all tokens that the sample is to hold.
BUDGET = 0.6
#: Largest difference of a margin from its target at which fitting ends, and change of it that counts as standstill.
CLOSE, STILL = 1e-6, 1e-9
#: Rounds after which fitting ends with what it has; the error that is left is told.
ROUNDS = 500
#: The same for bounded raking, and the difference at which it ends.
BOUND_ROUNDS, BOUND_CLOSE = 40, 1e-5
#: Share of its weight that a value asks of its other cells where its full cells give all of it already.
LEAST = 0.01
MARGINS = ("source", "lang", "topic")


def _topics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        data, offs = text_bytes(batch.column(1))
        tokens, topic = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
        for i, j in slices(offs):
            w = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], NOT_SPACE)
            n = np.diff(w.off)
            tokens[i:j] = n
            kind = (w.hash >> U(61)).astype(np.int64)  # three bits: TOPICS
            # Long words carry the topic; a text without any is judged by all its words.
            weight = np.where(w.end - w.start >= 6, 1.0, 1e-6)
            text = np.repeat(np.arange(j - i), n)
            topic[i:j] = np.bincount(text * TOPICS + kind, weights=weight, minlength=(j - i) * TOPICS).reshape(-1, TOPICS).argmax(axis=1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3)), pa.array(topic), pa.array(tokens)], names=["doc_id", "source", "lang", "topic", "tokens"])


def topics(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens: words of each whole text and its topic: column `topic` of docs, if that
    is named, else the one that most of its long words fall to (ties to the smaller number; no words: 0).
    Null source or lang: ''; null topic: -1."""
    prepare(docs.sparkSession)
    named = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), *([F.coalesce(F.col(topic).cast("int"), F.lit(-1)).alias("own")] if topic else []))
    ddl = "doc_id long, source string, lang string, topic int, tokens long"
    if not topic:
        return named.mapInArrow(_topics, ddl)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            made = next(_topics(iter([batch.select([0, 1, 2, 3])])))
            yield made.set_column(3, "topic", batch.column(4))

    return named.mapInArrow(counted, ddl)


def targets(cells: DataFrame, margin: str) -> DataFrame:
    """The margin's target shares where none are given: its token shares, tempered."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    return own.select(margin, F.pow("t", F.lit(TEMPER[margin])).alias("target"))


def _shares(wanted: DataFrame, cells: DataFrame, margin: str) -> DataFrame:
    """Targets of the values that cells have, summing to 1; a value without a target has 0."""
    have = cells.select(margin).distinct()
    kept = have.join(wanted.groupBy(margin).agg(F.sum("target").alias("target")), margin, "left").select(margin, F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(0.0)).alias("target"))
    total = kept.agg(F.sum("target")).first()[0]
    if total == 0:
        raise ValueError(f"no {margin} of the documents has a target")
    return kept.withColumn("target", F.col("target") / F.lit(total or 1.0))


def _aimed(cells: DataFrame, aim: dict[str, DataFrame], name: str) -> DataFrame:
    """Cells with the target of each of their values, aim_<margin>, so that a round joins nothing but its factors."""
    for m in MARGINS:
        cells = cells.join(aim[m].select(m, F.col("target").alias(f"aim_{m}")), m)
    return written(cells, name)


def _round(now: DataFrame) -> tuple[DataFrame, float | None]:
    """(the cells of a round, written; the largest difference from a target, seen as they are written)."""
    seen = Observation()
    now = written(now.observe(seen, F.max(F.greatest(*[f"off_{m}" for m in MARGINS])).alias("off")), "cells")
    return now, seen.get["off"]


def rake(cells: DataFrame, wanted: dict[str, DataFrame] | None = None) -> tuple[DataFrame, float]:
    """(cells with weight, error). Cells: source, lang, topic, tokens; weights are the shares nearest to the token
    shares, in relative entropy, whose margins are the targets, and error is the largest difference that is left.
    Margins that no weights can meet together (cells without tokens stay empty) leave an error above CLOSE.

    wanted: for a margin its targets (value, target), in any scale; a margin without is tempered. Cells of no
    tokens are left out. Cells are joined with each margin's factors and written once a round, whatever their number."""
    cells = written(cells.where("tokens > 0"), "sums")
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    if not total:
        return now, 0.0
    now = _aimed(now, {m: _shares((wanted or {}).get(m, targets(cells, m)), cells, m) for m in MARGINS}, "cells")
    last, own = None, [f"{x}_{m}" for x in ("off", "aim") for m in MARGINS]
    for _ in range(ROUNDS):
        for m in MARGINS:
            have = now.groupBy(m).agg(F.sum("weight").alias("have"), F.first(f"aim_{m}").alias("target"))
            factor = have.select(m, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("factor"), F.abs(F.col("target") - F.col("have")).alias(f"off_{m}"))
            now = now.drop(f"off_{m}").join(factor, m).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        now, off = _round(now)
        if off < CLOSE or last is not None and abs(off - last) < STILL:
            return now.drop(*own), off
        last = off
    return now.drop(*own), last


def _attainable(cells: DataFrame, margin: str) -> DataFrame:
    """margin value, target, now_full: what its cells that are not full are to give together. Of the value's weight,
    what its full cells give is taken off, but for LEAST of it; no value gives more than it has, and what it lacks goes to the others in
    proportion, in turn, until no more are cut. now_full: the value gives all that it has."""
    sums = [F.sum("weight").alias("ask"), F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("given"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("cap"))).alias("room")]
    values = written(cells.groupBy(margin).agg(*sums).withColumn("base", F.greatest(F.col("ask") * LEAST, F.col("ask") - F.col("given"))), "attainable")
    given, base = values.agg(F.sum("given"), F.sum("base")).first()
    scale, cut = (1 - given) / base if base else 0.0, -1
    while True:  # from here on the scale only rises, so a value that is cut stays so and the loop ends
        over = F.col("base") * scale >= F.col("room") * (1 - 1e-12)
        row = values.agg(F.coalesce(F.sum(F.when(over, F.col("room"))), F.lit(0.0)), F.sum(F.when(~over, F.col("base"))), F.count_if(over)).first()
        if not row[1] or row[2] <= cut:
            break
        cut, scale = row[2], max(scale, (1 - given - row[0]) / row[1])
    return values.select(margin, F.least(F.col("base") * scale, F.col("room")).alias("target"), (over & (F.col("room") > 0)).alias("now_full"))


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with prob, at most 1, by bounded raking: expected tokens are the budget's share of all, and their margins
    are those of the weights, with the cells that reach 1 held there. cells: those of rake().

    A value that asks for more tokens than it has gets all of them, and the others share what is missing in
    proportion; such cells are set apart first, as no finite factor fills them. Each step solves one margin for the
    cells below their bound, so a round is a join with each margin's factors. Fitting ends at BOUND_CLOSE, at
    standstill or after BOUND_ROUNDS; margins() tells what is left."""
    cells = written(cells, "weights")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total or budget >= 1:
        return cells.withColumn("prob", F.lit(1.0))
    now = cells.withColumns({"cap": F.col("tokens") / F.lit(budget * total), "free": F.col("weight"), "full": F.lit(False)})
    prob = lambda df: df.withColumn("prob", F.when(F.col("full"), 1.0).otherwise(F.least(F.lit(1.0), F.col("free") / F.col("cap")))).drop("cap", "free", "full")
    if not now.agg(F.count_if(F.col("free") > F.col("cap"))).first()[0]:
        return prob(now)
    while True:  # each turn fills cells, or is the last
        aim = {m: written(_attainable(now, m), "targets") for m in MARGINS}
        if not any(aim[m].where("now_full").limit(1).count() for m in MARGINS):
            break
        for m in MARGINS:
            now = now.join(aim[m].select(m, "now_full"), m).withColumn("full", F.col("full") | F.col("now_full")).drop("now_full")
        now = written(now, "cells")
    done, now = now.where("full"), now.where("not full")
    below, last = F.col("free") < F.col("cap"), None
    now = _aimed(now, aim, "cells")
    for _ in range(BOUND_ROUNDS if now.limit(1).count() else 0):
        for m in MARGINS:
            room = F.max(F.try_divide("cap", "free")).alias("room")  # a cell of no weight has none
            have = now.groupBy(m).agg(F.coalesce(F.sum(F.when(below, F.col("free"))), F.lit(0.0)).alias("free"), F.coalesce(F.sum(F.when(~below, F.col("cap"))), F.lit(0.0)).alias("held"), room, F.first(f"aim_{m}").alias("target"))
            rest, whole = F.col("target") - F.col("held"), F.col("free") + F.col("held")
            # A Newton step; kept tokens are concave in the factor, so it never passes the factor that is sought from above.
            lower = F.when(F.col("free") > 0, F.lit(1.0)).otherwise(F.col("room")) * F.col("target") / whole
            factor = F.when(whole <= 0, 1.0).when(rest <= 0, F.when(whole > F.col("target"), lower).otherwise(1.0)).when(F.col("free") <= 0, 1.0).otherwise(rest / F.col("free"))
            now = now.drop(f"off_{m}").join(have.select(m, factor.alias("factor"), F.abs(F.col("target") - whole).alias(f"off_{m}")), m)
            # A held cell's own value goes on above its bound, so that it comes back where other margins lower it.
            now = now.withColumn("free", F.col("free") * F.col("factor")).drop("factor")
        now, off = _round(now)
        if off < BOUND_CLOSE or last is not None and abs(off - last) < STILL:
            break
        last = off
    # The budget is held also where the margins contradict each other: one factor for all cells below their bound.
    goal, scale = 1 - (done.agg(F.sum("cap")).first()[0] or 0.0), 1.0
    for _ in range(BOUND_ROUNDS):
        over = F.col("free") * scale >= F.col("cap")
        low, held = (x or 0.0 for x in now.agg(F.sum(F.when(~over, F.col("free"))), F.sum(F.when(over, F.col("cap")))).first())
        if not low or abs(low * scale + held - goal) < 1e-12:
            break
        scale = (goal - held) / low if goal > held else scale * goal / (low * scale + held)
    return prob(now.withColumn("free", F.col("free") * scale).drop(*[f"{x}_{m}" for x in ("off", "aim") for m in MARGINS]).unionByName(done))


def margins(cells: DataFrame) -> DataFrame:
    """margin, value, weight, expected: of each value the share that was aimed at and that of the tokens which
    sampling by prob is expected to keep; they differ where a value has fewer tokens than it is to give, and by the
    error of fitting. cells: those of calibrated()."""
    out = None
    for m in MARGINS:
        own = cells.select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), "weight", (F.col("tokens") * F.col("prob")).alias("kept"))
        out = own if out is None else out.unionByName(own)
    total = cells.agg(F.sum(F.col("tokens") * F.col("prob"))).first()[0] or 1.0
    return out.groupBy("margin", "value").agg(F.sum("weight").alias("weight"), (F.sum("kept") / F.lit(total)).alias("expected"))


def mix(docs: DataFrame, budget: float = BUDGET, wanted: dict[str, DataFrame] | None = None, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, prob, kept, margin_error for each row of docs (doc_id, text, source, lang).

    kept: a hash of doc_id, spread over [0, 1), is below prob, so a run repeats itself and rows of one
    doc_id and cell go together. A document without tokens (null or empty text) has prob 1: it costs
    nothing. Null doc_ids draw alike. wanted and margin_error: see rake(). Topic, if docs has such a column, is
    read only where it is named; other columns are not read."""
    rows = written(topics(docs, topic), "topics")
    cells, error = rake(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), wanted)
    prob = written(calibrated(cells, budget).select(*MARGINS, "prob"), "probs")
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 40)) / float(1 << 40)
    out = rows.join(prob, list(MARGINS), "left").withColumn("prob", F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("prob")))
    return out.select("doc_id", *MARGINS, "tokens", "prob", (draw < F.col("prob")).alias("kept"), F.lit(error).alias("margin_error"))
