"""Each stage's decisions against the operators' results, and the pipeline's end."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from filelake.llm.near_dup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r["doc_id"] for r in near_duplicates(docs).where("not kept").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        gone = {r["doc_id"] for r in docs.select("doc_id").subtract(out.select("doc_id")).collect()}
        if name == "near_dedup":
            assert gone == copies
        if name == "language_id":
            assert not gone
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert len(out) > 20 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))


def test_mixtures_stay_and_languages_not_learnt_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {}
    for r in docs.orderBy("doc_id").where("n_chars > 1000").collect():
        text.setdefault(r["lang"], r["text"][:1000])
    assert len(text) == 4
    langs = sorted(text)
    rows = [(-1, " ".join(text[x] for x in langs[:3])), (-2, " ".join(text[x] for x in langs)), (-3, "Быстрая коричневая лиса прыгает через ленивую собаку у реки. " * 20), (-5, "12 ..")]
    rows += [(-6, text[langs[0]][:40]), (-7, text[langs[1]][500:520])]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language_id(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more), SF)
    assert {r["doc_id"] for r in out.where("doc_id < 0").collect()} == {-1, -2, -6, -7}
    assert out.where("doc_id >= 0").count() == docs.count()


def test_odd_rows_in_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80").withColumns({"kept": F.lit("x"), "gone_id": F.lit("y"), "topic": F.lit("z")})
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = min(i for i, t in text.items() if len(t.split()) > 60)
    words = [f"q{i}x" for i in range(60)]
    rows = [(None, " ".join(words) + " " + item), (None, text[first]), (None, " ".join(reversed(words))), (first, text[first]), (900, None), (900, None), (901, "")]
    more = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], docs.schema)
    odd = docs.unionByName(more)
    out = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, df in out.items():
        assert df.columns == odd.columns, name
        stage = dict(corpus_pipeline.STAGES)[name]
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    texts = {name: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()] for name, df in out.items()}
    near = texts["near_dedup"]
    assert near.count((first, text[first])) == 2 and (None, text[first]) not in near and (None, rows[2][1]) in near and near.count((900, None)) == 2
    clean = texts["decontamination"]
    assert (None, rows[0][1]) not in clean and (None, rows[2][1]) in clean and (901, "") in clean
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    held = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert sorted(map(str, clean)) == sorted(str((i, t)) for i, t in [*text.items(), *rows] if not held(low(t)))
    ids = [i for i, _ in texts["mixing"]]
    assert ids.count(900) == 2 and ids.count(901) == 1 and ids.count(first) in (0, 2)
    assert not {900, 901} & {i for i, _ in texts["language_id"]}
    assert corpus_pipeline.tokens(spark, odd.limit(0), SF).count() == 0


def test_tokens_stage_against_the_library(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    want, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.tokens(spark, docs, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
