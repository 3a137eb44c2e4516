"""A registry of analyzers: what supports a file runs on it, what is known is reused, what fails fails alone.

Facts are long rows, one per (file, analyzer). A file's content is read once, whatever number of analyzers it needs,
and not at all where all its facts are known.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .facts import archive_facts, fact_tasks, image_size, parser_of, pdf_facts, reuse_facts, sniff_type

#: Files whose contents a task holds at once.
_ROWS = 16
_RESULT = "struct<analyzer string, facts_json string, status string, message string>"


@dataclass(frozen=True)
class Analyzer:
    """One way to tell facts. supports: a condition on a file's metadata. Either native, a map<string,string> from the
    column content (null: nothing to tell, and never an error, for it shares the job), or function, from bytes to a
    dict (None: nothing to tell); what a function raises is that file's and that analyzer's failure alone."""

    id: str
    version: str
    supports: Callable[[], Column]
    native: Callable[[Column], Column] | None = None
    function: Callable[[bytes], dict | None] | None = None


def _texts(struct: Column, *names: str) -> Column:
    """The fields that are not null, as a map of texts; null if none."""
    pairs = F.array_compact(F.array(*[F.when(struct[n].isNotNull(), F.struct(F.lit(n).alias("k"), struct[n].cast("string").alias("v"))) for n in names]))
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def _walked(data: bytes) -> dict | None:
    parse = parser_of(data)
    return parse(data) if parse else None


def _extension(*names: str) -> Callable[[], Column]:
    return lambda: F.lower("extension").isin(*names)


#: What the library can tell by itself.
ANALYZERS = (
    Analyzer("file-type", "1", lambda: F.lit(True), native=lambda c: _texts(sniff_type(c, F.lit(None).cast("string")), "mime_type", "source")),
    Analyzer("image-size", "1", _extension("png", "gif", "bmp", "webp"), native=lambda c: _texts(image_size(c), "width", "height")),
    Analyzer("pdf", "1", _extension("pdf"), native=lambda c: _texts(pdf_facts(c), "pages", "title", "author", "created", "modified")),
    Analyzer("archive", "1", _extension("zip"), native=lambda c: _texts(archive_facts(c, F.lit("zip")), "archive_type", "entries", "directory_bytes")),
    Analyzer("media-tags", "1", _extension("jpg", "jpeg", "tif", "tiff", "wav", "mp3"), function=_walked),
)


def analysis_tasks(files: DataFrame, analyzers: tuple[Analyzer, ...] = ANALYZERS) -> DataFrame:
    """record_id, root_id, signature, analyzer, version: what is to be known of observed files, by metadata alone."""
    if len({a.id for a in analyzers}) < len(analyzers):
        raise ValueError("an analyzer is registered in one version at a time")
    each = F.array_compact(F.array(*[F.when(a.supports(), F.struct(F.lit(a.id).alias("analyzer"), F.lit(a.version).alias("version"))) for a in analyzers]))
    return fact_tasks(files).select("record_id", "root_id", "signature", F.inline(each))


def _run(functions: dict[str, Callable[[bytes], dict | None]]):
    def outcome(name: str, function: Callable[[bytes], dict | None], data: bytes) -> dict:
        row = {"analyzer": name, "facts_json": None, "status": "unavailable", "message": None}
        try:
            facts = function(data)
            if facts is not None:
                text = {str(k): str(v) for k, v in sorted(facts.items())}
                row |= {"facts_json": json.dumps(text, ensure_ascii=False, separators=(",", ":")), "status": "completed"}
        except Exception as e:  # noqa: BLE001 - this file's and this analyzer's failure alone
            row |= {"status": "failed", "message": f"{type(e).__name__}: {e}"[:200]}
        return row

    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("analyzer", "facts_json", "status", "message")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                found = []
                for todo, data in zip(part.column("todo").to_pylist(), part.column("content"), strict=True):
                    wanted = [x for x in todo if x in functions]
                    held = (data.as_py() or b"") if wanted else b""
                    found.append([outcome(x, functions[x], held) for x in wanted])
                yield pa.RecordBatch.from_arrays([part.column("record_id"), part.column("told"), pa.array(found, kind)], names=["record_id", "told", "found"])

    return run


def extract_facts(files: DataFrame, prior: DataFrame, analyzers: tuple[Analyzer, ...] = ANALYZERS) -> DataFrame:
    """record_id, root_id, signature, analyzer, version, status (completed, unavailable, failed), facts_json, message,
    reused: one row for each observed file and each analyzer that supports it.

    files: file rows with signature and content (binary). prior: rows as this gives them, with analyzed_at; completed
    ones of the same analyzer, version and signature are reused, of the same record, else the newest of the root.
    Failed and unavailable ones are tried again. One job reads each content once for all that is still to be known,
    and the contents of files of which all is known stay where they are: they meet only ids of the rest. Null
    content counts as empty."""
    ship(files.sparkSession)
    done = reuse_facts(analysis_tasks(files.drop("content"), analyzers), prior.where("status = 'completed'"))
    columns = ["record_id", "root_id", "signature", "analyzer", "version"]
    none = F.lit(None).cast("string")
    known = done.where("reused").select(*columns, F.lit("completed").alias("status"), "facts_json", none.alias("message"), "reused")

    rest = done.where("not reused")
    todo = rest.groupBy("record_id").agg(F.collect_set("analyzer").alias("todo"))  # at most all analyzers
    content = F.coalesce("content", F.lit(b""))
    rows = files.select("record_id", content.alias("content")).join(todo, "record_id")
    native = [a for a in analyzers if a.native]
    told = []
    for a in native:
        facts = F.to_json(a.native(F.col("content")))
        row = F.struct(F.lit(a.id).alias("analyzer"), facts.alias("facts_json"), F.when(facts.isNull(), "unavailable").otherwise("completed").alias("status"), none.alias("message"))
        told.append(F.when(F.array_contains("todo", a.id), row))
    functions = {a.id: a.function for a in analyzers if a.function}
    told_column = F.array_compact(F.array(*told)) if told else F.array()
    rows = rows.select("record_id", F.when(F.exists("todo", lambda x: x.isin(*functions)), F.col("content")).alias("content"), "todo", told_column.cast(f"array<{_RESULT}>").alias("told"))
    out = rows.mapInArrow(_run(functions), f"record_id string, told array<{_RESULT}>, found array<{_RESULT}>")
    out = out.select("record_id", F.inline(F.concat("told", "found")))
    fresh = rest.select(*columns).join(out, ["record_id", "analyzer"]).select(*columns, "status", "facts_json", "message", F.lit(False).alias("reused"))
    return known.unionByName(fresh)


def analysis_counts(facts: DataFrame) -> DataFrame:
    """record_id, n_results, n_failed, n_unavailable, as classification wants them."""
    n = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("failed", "unavailable")}
    return facts.groupBy("record_id").agg(F.count("*").alias("n_results"), *n.values())
