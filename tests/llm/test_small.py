"""Defined results for nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelake.llm import common, licenses, line_dedup, mixing, pii, topk, warc, wavelet, words
from filelake.llm.components import components
from filelake.llm.decontam import decontaminate
from filelake.llm.langid import identify
from filelake.llm.near_dup import near_duplicates

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DDL)


LONG = " ".join(f"w{i % 997}" for i in range(30000))
ROWS = [(1, "One two three four five six seven."), (2, "one two three four five six seven."), (3, None), (4, ""), (5, "a b"), (6, "A B"), (7, LONG), (8, LONG + " tail"), (9, " \n "), (9, " \n "), (None, "one two three four five six seven."), (10, "é 　 ñ" * 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS)


def test_near_duplicates(spark, docs):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 7, False), (9, 9, True), (None, None, True), (10, 10, True)}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_chain_of_near_copies(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(100 + k, " ".join(base[: 200 - 12 * k] + [f"n{k}{i}" for i in range(12 * k)])) for k in range(6)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    link = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in link:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows)).collect()} == comp


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (None, 1), (4, 5), (2, 3)], "u long, v long")
    assert {r["node"]: r["component"] for r in components(e.where("u is not null")).collect()} == {5: 2, 4: 2, 3: 2, 9: 8}
    assert components(e.limit(0)).count() == 0


def test_kept_pieces_are_counted(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(wavelet, "KEPT_BYTES", 1 << 20)
    coder, tok = wavelet.Encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    for i in range(40):  # a million runs, most of them new, joined by slashes; then as words, one text at a time
        joint = "/".join(f"{x:x}" for x in rng.integers(1 << 40, size=25_000))
        text = joint if i % 2 else joint.replace("/", " ")
        (ids,) = coder.encode([text])
        if i < 4:
            assert np.frombuffer(ids, np.uint32).tolist() == tok.encode(text, add_special_tokens=False).ids
        size = sum(4 * len(k) + len(v) for held in (coder.pieces, coder.pieces.old) for k, v in held.items())
        assert 0 < coder.pieces.bytes < (1 << 20) + 4096 and size < (2 << 20) + 8192


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = wavelet.token_documents(docs).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.token_documents(docs.limit(0)).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 50000, 3000) % 97 * 500
    m = wavelet.WaveletMatrix.build(ids, 16)
    assert (m.decode() == ids).all()
    for i in (0, 1, 511, 512, 513, 2999):
        assert m.access(i) == ids[i] and m.rank(int(ids[5]), i) == (ids[:i] == ids[5]).sum()
    at = np.flatnonzero(ids == ids[7])
    assert [m.select(int(ids[7]), k) for k in range(len(at))] == at.tolist()
    assert m.count(49999) == 0 and m.select(49999, 0) == -1 and m.count(1 << 20) == 0


def test_encoder_cuts_are_safe():
    import random

    import public_tokenizers

    c = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", " ", "\n", "é", "1", ".", ",", "'s", "\t", "\xa0", "\x1c", "  ", "ok", "<|endoftext|>"]) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for t, got in zip(texts, c.encode(texts), strict=True):
        assert list(np.frombuffer(got, np.uint32)) == c.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_tokens_are_found_in_the_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    ids = {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [2] for r in d.collect()}
    files = wavelet.write_tokens(d)
    token = sorted(x for own in ids.values() for x in own)[1000]
    want = {(i, k) for i, own in ids.items() for k, x in enumerate(own) if x == token}
    assert {tuple(r) for r in wavelet.find_token(files, token).collect()} == want
    assert wavelet.count_token(files, token).agg(F.sum("n")).first()[0] == len(want)
    places = [(i, k) for i, own in ids.items() for k in (0, len(own) // 2, len(own) - 1)]
    asked = spark.createDataFrame([*places, (next(iter(ids)), 10**9), (-1, 0)], "doc_id long, at long")
    assert {tuple(r) for r in wavelet.tokens_at(files, asked).collect()} == {(i, k, ids[i][k]) for i, k in places}


def test_top_k(spark):
    rows = [(i, [((i * 7) % 5) / 4, ((i * 3) % 4) / 4]) for i in range(120)] + [(50, [9.0, 9.0]), (200, None), (201, [1.0, None]), (202, [float("nan"), 1.0]), (250, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vec = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and x == x for x in v):
            vec[i] = min(vec.get(i, v), v)
    want = set()
    for q in [i for i in vec if i % 50 == 0]:
        f = lambda v: [int(np.floor(256 * x)) for x in v]
        scored = sorted((-sum(a * b for a, b in zip(f(vec[q]), f(vec[c]), strict=True)), c) for c in vec if c != q and len(vec[c]) == len(vec[q]))[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(e, candidates=16, queries=2).collect()}
    assert got == want
    assert topk.top_k(e.limit(0)).count() == 0


def test_base_spans():
    text = "x a.b@c-d.e.f, @no a@b@c.d 1.2.3.4.5 300.1.1.1 +1 (555) 010-9999 4111 1111 1111 1111 1234567890123456"
    got = pii.find(text)
    assert [text[a:b] for a, b in got["email"]] == ["a.b@c-d.e.f", "b@c.d"]
    assert [text[a:b] for a, b in got["ip"]] == ["1.2.3.4"]
    # The number of the card follows a blank and digits of the phone: one match of too many digits, so dropped.
    assert got["phone"] == [] and pii.find("+1 (555) 010-9999, 4111 1111 1111 1111")["phone"] == [(0, 17)]
    assert pii.find("pay 4111-1111 1111 1111 now")["card"] == [(4, 23)]


def test_deobfuscation():
    cases = [
        ("mail jane.doe at example dot com now", "email", "jane.doe at example dot com"),
        ("mail jane [at] example [dot] com.", "email", "jane [at] example [dot] com"),
        ("mail jane(at)mail.example.com ok", "email", "jane(at)mail.example.com"),
        ("mail jаne@exаmple.com ok", "email", "jаne@exаmple.com"),
        ("mail ｊａｎｅ＠ｅｘ．ｃｏｍ ok", "email", "ｊａｎｅ＠ｅｘ．ｃｏｍ"),
        ("mail ja​ne@example.com ok", "email", "ja​ne@example.com"),
        ("call plus one five five five zero one two three four five six now", "phone", "plus one five five five zero one two three four five six"),
        ("ip １９２.168.0.1 here", "ip", "１９２.168.0.1"),
        ("ip 192 dot 168 DOT 0 dot 1 here", "ip", "192 dot 168 DOT 0 dot 1"),
        ("ip 192[.]168[.]0[.]1 here", "ip", "192[.]168[.]0[.]1"),
        ("ip 10 (punkt) 20.30 PUNTO 40.", "ip", "10 (punkt) 20.30 PUNTO 40"),
        ("MAIL JANE AT EXAMPLE DOT COM NOW", "email", "JANE AT EXAMPLE DOT COM"),
        ("CARD FOUR ONE ONE ONE 1111 1111 1111 ok", "card", "FOUR ONE ONE ONE 1111 1111 1111"),
    ]
    for text, kind, want in cases:
        base, spans = pii.all_spans(text)
        assert [text[a:b] for a, b in spans[kind] if (a, b) not in base[kind]] == [want], (text, spans)
        assert set(base[kind]) <= set(spans[kind])
    for clean in ("meet at noon on the dot of one", "un dos tres y ya", "élan à Noël", ""):
        assert not any(pii.all_spans(clean)[1].values())


def test_spelled_digits_between_any_marks():
    for text in ("call +49 five five five 1234567; thanks", "PLUS VIER NEUN FÜNF DREI ZWEI 1234567", "“+49 five five five 1234567”", "x/+49 five five five 1234567!", "+49 fıve ſix five 1234567"):
        assert pii.all_spans(text)[1]["phone"], text
        low = pii._lower(text)
        assert pii._RUN.search(text) and pii._may_run(low), text
    assert pii._may_run("plusfive, 1 five_five") and not pii._may_run("five five, x five")
    assert pii.find("0" * 5000 + "1.2.3.4")["ip"] == [(0, 5007)]


def test_personal_data_rows(spark, docs):
    got = pii.personal_data(docs)
    assert got.count() == len(ROWS) and got.where("spans <> ''").count() == 0
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "TWO three four-five"), (2, " ".join(f"w{i}" for i in range(40, 55))), (3, None), (4, "..."), (None, "a b"), (2, "a b")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate(docs, bench).collect()}
    assert (1, 7, 4, 1, True) in got and (3, 0, 0, 0, False) in got and (5, 2, 2, 1, True) in got and (None, 7, 4, 1, True) in got
    hits = 15 * (30000 // 997)
    assert any(r[0] == 7 and r[1] == 30000 and r[2] in (hits, hits + 15) for r in got)
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_crowded_anchor(spark):
    """Twenty thousand windows share their rarest word; a text is full of it."""
    import time

    from filelake.llm import decontam

    rng = np.random.default_rng(2)
    texts = [" ".join([f"c{x}" for x in rng.integers(50, size=4)] + ["frame"] + [f"c{x}" for x in rng.integers(50, size=5)]) for _ in range(20_000)]
    item, n, row, ids = decontam._windows([(f"i{k:05d}", t) for k, t in enumerate(texts)])
    frame = words.words(np.frombuffer(b"frame", np.uint8), np.array([0, 5]), words.ALNUM).hash[0]
    at = (row == frame).argmax(axis=1)
    items = decontam._grouped(np.full(len(row), frame), at, n, row, item, ids)
    text = ("frame " * 1500 + texts[7] + " frame").encode()
    w = words.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words.ALNUM)
    began = time.time()
    got = decontam._find(w, items)
    assert time.time() - began < 1
    same = {f"i{k:05d}" for k, t in enumerate(texts) if t == texts[7]}
    assert set(got[1].tolist()) == {1500} and {ids[x] for x in got[4]} == same


def test_decontamination_in_passes(spark, docs, monkeypatch):
    from filelake.llm import decontam

    bench = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate([("one", "two"), ("two", "three"), ("six", "seven"), ("a", "b")])], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate(docs, bench).na.fill(-1).collect()))
    monkeypatch.setattr(decontam, "PASS_CHARS", 8)
    assert sorted(map(tuple, decontaminate(docs, bench).na.fill(-1).collect())) == whole


def test_line_dedup(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"{a}\nx y\n\nunique words stand here alone"), (2, f"{a} lambda\nX  Y\n\nother"), (3, None), (4, ""), (5, "\n\n"), (None, a), (6, "kappa iota theta eta zeta epsilon delta gamma beta ALPHA")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.drop_repeated_lines(documents(spark, rows)).collect()}
    assert got[1] == (4, 0, rows[0][1]) and got[2] == (4, 2, "\nother") and got[3] == (0, 0, None)
    assert got[5] == (3, 0, "\n\n") and got[6] == (1, 1, "") and got[None] == (1, 0, a)
    assert line_dedup.drop_repeated_lines(documents(spark, rows).limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(200)
    seen, want = [], {}
    lines = [(r["doc_id"], n, frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))) for r in sorted(d.collect(), key=lambda r: r["doc_id"]) for n, line in enumerate(r["text"].split("\n"))]
    for i, n, s in lines:
        if s:
            gone = any(5 * len(s & t) >= 4 * len(s | t) for t in seen if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)))
            want.setdefault(i, []).extend([n] if gone else [])
            seen.append(s)
    got = {}
    for r in line_dedup.repeated_lines(d).select("doc_id", "line").distinct().collect():
        got.setdefault(r["doc_id"], []).append(r["line"])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_line_dedup_link_counts(spark):
    # Lines 1 and 2 share no word but behind 105 of their own, each of which line 3 or 4 has too: more than
    # a row of the join carries. Lines 10 to 29 are changed copies of one text, many of them linked.
    common, one, two = ([f"{k}{i}" for i in range(n)] for k, n in (("c", 895), ("a", 105), ("b", 105)))
    rows = [(1, " ".join(common + one)), (2, " ".join(common + two)), (3, " ".join([*one, *common, *(f"d{i}" for i in range(300))])), (4, " ".join(two + [f"e{i}" for i in range(20)]))]
    rows += [(10 + i, " ".join(f"{'z' * (j % (i + 2) == 0 and j < 12)}t{j}" for j in range(40))) for i in range(20)]
    sets = {i: frozenset(t.split()) for i, t in rows}
    want = {}
    for i, a in sets.items():
        links = {b for b in sets.values() if b != a and 5 * len(a & b) >= 4 * len(a | b)}
        if any(sets[j] == a or sets[j] in links for j in sets if j < i):
            want[i] = len(links)
    assert want[2] == 1 and len(want) > 10
    got = {r["doc_id"]: r["n_links"] for r in line_dedup.repeated_lines(documents(spark, rows)).collect()}
    assert got == want


def test_line_dedup_rows_meet_at_their_first_word(spark, monkeypatch):
    """Ten pairs of changed copies share one word behind a rarer one of their own: only that one's rows go on."""
    tables = {}
    monkeypatch.setattr(line_dedup, "written", lambda df, name: tables.setdefault(name, common.written(df, name)))
    own = [[f"o{i}x{j}" for j in range(15)] for i in range(10)]
    rows = [(2 * i + k, " ".join([f"s{i}", "shared", *own[i], *[f"once{i}"] * k])) for i in range(10) for k in (0, 1)]
    rows.append((99, " ".join(w for o in own for w in o for _ in range(30))))
    got = {r["doc_id"]: r["n_links"] for r in line_dedup.repeated_lines(documents(spark, rows)).collect()}
    assert got == {2 * i + 1: 1 for i in range(10)}
    assert tables["open"].count() == 20


def test_line_dedup_sets_and_bitmaps():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    hashes[1::2] = hashes[::2] ^ np.uint64(1 << 22)  # equal in all that the short key has of them
    off = np.concatenate([[0], np.sort(rng.integers(0, 4000, 60)), [4000]])
    hashes[off[3] : off[4]] = hashes[off[3]] if off[4] > off[3] else 0
    rare = rng.integers(0, 3, line_dedup.COUNTERS).astype(np.uint8)
    own, size = line_dedup._sets(words.Words(off, off, hashes, off), rare)
    want = [sorted(set(hashes[a:b].tolist()), key=lambda h: (rare[h % line_dedup.COUNTERS], h)) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert size.tolist() == [len(x) for x in want] and own.tolist() == [h for x in want for h in x]
    # No bitmap tells two sets further apart than they are, folded or not.
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    for one, two in ((base[:60], base[3:68]), (base[:150], base[9:160]), (base[:64], base[:65])):
        (a0, b0), (a1, b1) = line_dedup._bitmaps(np.concatenate([one, two]), np.array([0, len(one)]), np.array([len(one), len(two)]))
        folded = min(len(one), len(two)) <= line_dedup.FOLDED
        apart = bin(int(a0 ^ a1 ^ b0 ^ b1)).count("1") if folded else bin(int(a0 ^ b0)).count("1") + bin(int(a1 ^ b1)).count("1")
        assert apart <= len(set(one.tolist()) ^ set(two.tolist()))


def solve(kept, goal):
    """The least factor whose kept share is the goal, or the largest tried."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < goal - 1e-12 else (low, mid)
    return high


def test_bounded_raking_holds_the_budget(spark, monkeypatch):
    """Full cells of one margin leave others nothing they can meet together: the budget holds all the same."""
    monkeypatch.setattr(mixing, "BOUND_ROUNDS", 4)
    loads = {("a", "x", 0): (100, 0.5), ("a", "y", 1): (300, 0.1), ("b", "x", 1): (400, 0.15), ("b", "y", 0): (200, 0.25)}
    made = spark.createDataFrame([(*k, n, w) for k, (n, w) in loads.items()], "source string, lang string, topic int, tokens long, weight double")
    got = {tuple(r[:3]): r["prob"] for r in mixing.calibrated(made, 0.4).select(*mixing.MARGINS, "prob").collect()}
    assert max(got.values()) == 1.0 and min(got.values()) > 0 and abs(sum(loads[k][0] * p for k, p in got.items()) - 400) < 1e-3
    # One cell is full; the others take what it lacks, in proportion, and margins that can be met are met.
    one = made.withColumn("lang", F.lit("x")).withColumn("topic", F.lit(0)).withColumn("source", F.concat("source", "tokens"))
    got = {r["tokens"]: r["prob"] for r in mixing.calibrated(one, 0.4).collect()}
    assert got[100] == 1.0 and all(abs(got[n] * n - 300 * w / 0.5) < 1e-3 for n, w in ((300, 0.1), (400, 0.15), (200, 0.25)))


def test_mixing(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cells = mixing.topics(d).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    wanted = {"lang": spark.createDataFrame([("en", 5.0), ("de", 1.0), ("es", 1.0), ("fr", 3.0), ("xx", 9.0)], "lang string, target double")}
    raked, error = mixing.rake(cells, wanted)
    got = {tuple(r[:3]): (r["tokens"], r["weight"]) for r in raked.select(*mixing.MARGINS, "tokens", "weight").collect()}
    assert error < mixing.CLOSE
    # Brute force: the same fitting cell by cell.
    total = sum(n for n, _ in got.values())
    weight, aim = {k: n / total for k, (n, _) in got.items()}, []
    for i, m in enumerate(mixing.MARGINS):
        t = {}
        for k, (n, _) in got.items():
            t[k[i]] = t.get(k[i], 0) + n
        t = {"en": 5.0, "de": 1.0, "es": 1.0, "fr": 3.0} if m == "lang" else {v: n ** mixing.TEMPER[m] for v, n in t.items()}
        aim.append({v: x / sum(t.values()) for v, x in t.items()})
    for _ in range(300):
        for i in range(3):
            have = {}
            for k, x in weight.items():
                have[k[i]] = have.get(k[i], 0) + x
            weight = {k: x * aim[i][k[i]] / have[k[i]] for k, x in weight.items()}
    assert all(abs(weight[k] - w) < 1e-5 for k, (_, w) in got.items())
    for i in range(3):
        for v, share in aim[i].items():
            assert abs(sum(w for k, (_, w) in got.items() if k[i] == v) - share) < 1e-5
    # Sampling: the budget holds; where no cell is cut the margins are the targets.
    loose = mixing.margins(mixing.calibrated(raked, 0.01)).collect()
    assert all(abs(r["weight"] - r["expected"]) < 1e-9 for r in loose)
    # Bounded: cells that are full are held, and the margins are met all the same, as far as a value has tokens.
    bounded = mixing.calibrated(raked, 0.3)
    met = mixing.margins(bounded).collect()
    own = {(m, str(r[0])): r[1] for m in mixing.MARGINS for r in bounded.groupBy(m).agg(F.sum("tokens") / F.lit(0.3 * total)).collect()}
    for m in mixing.MARGINS:
        rows = [(r["weight"], own[m, r["value"]], r["expected"]) for r in met if r["margin"] == m]
        f = solve(lambda f: sum(min(most, f * ask) for ask, most, _ in rows), 1.0)  # noqa: B023
        assert all(abs(min(most, f * ask) - told) < 10 * mixing.BOUND_CLOSE for ask, most, told in rows)
    assert mixing.calibrated(raked, 1.0).agg(F.min("prob")).first()[0] == 1.0
    monkeypatch.setattr(mixing, "BOUND_ROUNDS", 2)  # what follows asks for the budget and odd rows alone
    p = mixing.mix(d).toPandas()
    assert abs((p.tokens * p.prob).sum() / p.tokens.sum() - mixing.BUDGET) < 1e-6 and p.prob.between(0, 1).all()
    odd = documents(spark, ROWS).withColumn("topic", F.lit("clash")).withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(odd).count() == len(ROWS) and mixing.mix(odd.where("text is null")).first()["kept"]
    assert mixing.mix(odd.limit(0)).count() == 0
    own = mixing.mix(d.withColumn("mine", F.col("doc_id") % 3), topic="mine").select("topic").distinct().collect()
    assert sorted(r[0] for r in own) == [0, 1, 2]


def _contract_spans(text):
    """The contract's own patterns, tried from left to right."""
    out = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        double = [2 * int(c) for c in digits[-2::-2]]
        if 16 <= len(digits) <= 19 and (sum(int(c) for c in digits[-1::-2]) + sum(x // 10 + x % 10 for x in double)) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def test_base_spans_against_brute_force():
    import random

    rng = random.Random(5)
    bits = ["a", "b.c", "@", ".", "1", "25", "300", "+", " ", "-", "(", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+49 30 1234567", "é", "\n", "0" * 30]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += ["x " + "0" * 5000 + ".1.1.1", "9" * 6000, "1." * 3000, "+" + "1" * 40, "+12345678 " + "a@" * 2000 + "b.c"]
    found = 0
    for text in texts:
        want = _contract_spans(text)
        assert pii.find(text) == want, text[:80]
        base, spans = pii.all_spans(text)
        assert base == want and all(set(want[k]) <= set(spans[k]) for k in want)
        found += sum(map(len, want.values()))
    assert found > 1500


def test_personal_data_frame(spark, docs):
    import hashlib

    for r in pii.personal_data(docs.withColumn("n_email", F.lit("clash"))).collect():
        texts = [t or "" for i, t in ROWS if i == r["doc_id"]]
        told = [_contract_spans(t) for t in texts]
        joined = [",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in x[k]) for x in told]
        assert r["base_sha256"] in [hashlib.sha256(x.encode()).hexdigest() for x in joined]
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    import hashlib

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    long = next(t for t in texts.values() if len(low(t)) > 60)
    items = [(str(r["item_id"]), r["text"]) for r in b.collect()] + [("10000", "the"), ("10001", " ".join(low(long)[20:45])), ("10002", None), ("10003", "..."), ("10001", " ".join(low(long)[:12])), ("10004", "a a a a a a a a a a a a")]
    texts |= {-1: None, -2: "A a, a a a a a a a a a a a a", -3: "", -4: " ".join(low(long)[30:45])}
    windows = {}
    for name, text in items:
        q = low(text)
        n = min(10, len(q))
        for k in range(len(q) - n + 1 if q else 0):
            windows.setdefault(tuple(q[k : k + n]), set()).add(name)
    want = {}
    for i, t in texts.items():
        w, hits, names = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hits |= set(range(at, at + n))
                    names |= own
        want[i] = (len(w), len(hits), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hits))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate(docs, bench).collect()}
    assert got == want and sum(x[4] for x in want.values()) > 5
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0 and decontaminate(docs.limit(0), bench).count() == 0


def test_license_scores_against_brute_force(spark):
    import math
    from collections import Counter

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    files = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    found = licenses.candidates(files)
    rows = [(r["path"], r["rank"], r["text"]) for r in found.collect()]
    bags = {t: Counter(t.split(" ")) for _, _, t in rows}
    df = Counter(w for b in bags.values() for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df[w])) + 1
    vec = lambda b: {w: n * idf(w) for w, n in b.items()}
    known = [(r["license"], vec(Counter(x for x in r["text"].split(" ") if x))) for r in licenses.templates(spark).collect()]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for path, rank, text in rows:
        v = vec(bags[text])
        for name, t in known:
            s = round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6)
            if s >= licenses.LEAST:
                key = (name == licenses.WEAK, rank, -s)
                if path not in want or key < want[path][0]:
                    want[path] = (key, name)
    got = {r["path"]: r["score"] for r in licenses.match(found).collect()}
    assert got.keys() == want.keys() and len(got) > 3
    assert all(abs(got[p] + want[p][0][2]) < 2e-6 for p in got)


def test_carried_columns_do_not_clash(spark):
    files = spark.createDataFrame([("a/LICENSE", "MIT License", 1, "c")], "path string, text string, license int, below string")
    with pytest.raises(ValueError):
        licenses.scan(files, "license")
    assert licenses.scan(files, "below").columns == ["below", "path", "license", "score", "origin", "origin_path"]


def test_captures_against_brute_force(spark):
    import base64
    import hashlib

    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(9001, "u", None), (9002, None, ""), (9003, "v", "é\r\n\r\nWARC/1.1\r\n"), (9004, "v", "é\r\n\r\nWARC/1.1\r\n")], p.schema)
    p = p.unionByName(more).unionByName(p.where("page_id < 5").withColumn("page_id", F.col("page_id") + 500)).withColumn("revisit", F.lit("clash"))
    rows = {r["page_id"]: (r["html"] or "").encode() for r in p.collect()}
    top = {}
    for i, body in rows.items():
        top[body] = max(i, top.get(body, i))
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top[b] == i else "revisit", None if top[b] == i else top[b]) for i, b in rows.items()}
    got = warc.captures(p).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    assert all((r["response"] is None) == (r["record_type"] == "revisit") and r["request"]["record_id"] and r["n_metadata"] == 1 for r in got)
    assert warc.captures(p.limit(0)).count() == 0


def test_no_session_setting_is_left_behind(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    one, two = wavelet.token_documents(d), identify(d)
    assert spark.conf.get(key) == before
    spark.conf.set(key, "7")
    try:
        first = sorted(map(tuple, one.collect()))
        spark.conf.set(key, "10000")
        assert sorted(map(tuple, one.collect())) == first and two.count() == 40
    finally:
        spark.conf.set(key, before)


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.95
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(documents(spark, ROWS + [(11, "12 ..")])).collect()}
    assert got[3] == ("und", 0) and got[4] == ("und", 0) and got[11] == ("und", 0) and got[1][0] == "en"
    nothing = documents(spark, ROWS).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(nothing).collect()} == {"und"} and identify(nothing.limit(0)).count() == 0


def test_licenses(spark):
    rows = [("p/LICENSE", "Licensed under the Apache License, Version 2.0."), ("p/a/b/f.py", "x = 1"), ("p/a/g.py", "code\nThis work is licensed under the GNU General Public License, version 3.\nmore"), ("q/f", None), (None, "Licensed under CC BY-NC 4.0."), ("top", ""), ("p/a/COPYING", "nothing of the kind"), ("q/f", None)]
    got = {(r["path"], r["license"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("p/LICENSE", "Apache-2.0", "own"), ("p/a/b/f.py", "Apache-2.0", "inherited"), ("p/a/g.py", "GPL-3.0", "own"), ("q/f", None, "none"), (None, None, "none"), ("top", None, "none"), ("p/a/COPYING", "Apache-2.0", "inherited")}
    assert licenses.scan(spark.createDataFrame(rows, "path string, text string").limit(0)).count() == 0


def test_license_headers_and_files(spark):
    gnu = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version {} of the License, or", "(at your option) any later version."]
    mit = licenses.HEADERS["MIT"][0]
    rows = [(f"gpl{v}.py", "\n".join("# " + x for x in ["Copyright 2020 A. Body"] + gnu).format(v) + "\nx = 1") for v in (2, 3)]
    rows += [(f"plain{v}.txt", "\n".join(gnu).format(v)) for v in (2, 3)]
    rows += [("wrap.c", "// Copyright 2020 A. Body\n// This work is licensed under the GNU General Public\n// License, version 3.\nint x;")]
    rows += [("spdx1.c", "/* SPDX-License-Identifier: MIT */\nint x;"), ("spdx2.c", "// SPDX-License-Identifier: GPL-3.0-only"), ("spdx3.c", "// SPDX-License-Identifier: EPL-2.0")]
    rows += [("m/LICENSE", "Copyright (c) 2020 A. Body. All rights reserved.\n\n" + mit.replace(" the ", " the\n")), ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\nEveryone may copy."), ("p.c", "// Copyright Foo. All rights reserved.")]
    got = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"gpl2.py": "GPL-2.0", "gpl3.py": "GPL-3.0", "plain2.txt": "GPL-2.0", "plain3.txt": "GPL-3.0", "wrap.c": "GPL-3.0", "spdx1.c": "MIT", "spdx2.c": "GPL-3.0", "spdx3.c": None, "m/LICENSE": "MIT", "g/COPYING": "GPL-2.0", "p.c": "Proprietary"}


def test_warc(spark):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nx"
    rows = [(1, "http://a/x", "same"), (5, "http://a/y", "same"), (3, None, "same"), (2, "http://a/z", trap), (4, "http://a/ b\n", None), (6, "http://e", ""), (None, "http://n", "same"), (7, "u", "é" * 5000), (7, "u", "é" * 5000)]
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"], r["n_requests"]) for r in warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, 4, "revisit", 5, 1), (1, 4, "revisit", 5, 1), (2, len(trap), "response", None, 1), (3, 4, "revisit", 5, 1), (4, 0, "revisit", 6, 1), (5, 4, "response", None, 1), (6, 0, "response", None, 1), (7, 10000, "response", None, 2), (7, 10000, "response", None, 2)]
    assert warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_words():
    texts = ["Ab c", "", "  x", "abcd c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t) for t in texts])
    w = words.words(data, offs)
    assert np.diff(w.off).tolist() == [2, 0, 1, 2] and w.hash[1] == w.hash[4] and w.hash[0] != w.hash[3]
    alone = words.words(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    assert alone.hash[0] == w.hash[0]


def test_disguises_of_all_kinds_are_found_where_they_stand():
    """Generated disguises between clean words: every one is told with its exact span, and nothing else."""
    rng = random.Random(11)
    names = "zero one two three four five six seven eight nine".split()
    spell = lambda digits, k: " ".join(names[int(c)] if i in k else c for i, c in enumerate(digits))

    def grouped(groups, n):
        """Groups of digits of which the last n digits of one are spelled."""
        at = rng.randrange(len(groups))
        return " ".join((f"{g[:-n]} " if g[:-n] else "") + " ".join(names[int(c)] for c in g[-n:]) if i == at else g for i, g in enumerate(groups))

    made = {
        "email": lambda: rng.choice(["{}{}{} at mail{}example{}org", "{}{}{} [at] mail{}example{}org", "{}{}{}(at)mail{}example{}org", "{}{}{} @ mail{}example{}org", "{}{}{} arroba mail{}example{}org"]).format("jo", rng.choice([".", " dot ", " [dot] "]), "doe", rng.choice([" dot ", " (dot) ", " punkt "]), rng.choice([".", " dot "])),
        "ip": lambda: rng.choice([" dot ", " [dot] ", ".", " punto "]).join(spell(n, {0} if i == 0 else rng.sample(range(len(n)), rng.randint(0, len(n)))) for i, n in enumerate(["192", "16", "0", "7"])),
        "card": lambda: grouped(["4111", "1111", "1111", "1111"], rng.randint(1, 4)),
        "phone": lambda: "+" + grouped(["49", "555", "123"], rng.randint(1, 2)) + " 4567",
    }
    for kind in pii.KINDS:
        for _ in range(60):
            hidden = made[kind]()
            text = f"Über das; {hidden} ; and so on"
            base, spans = pii.all_spans(text)
            assert spans[kind] == [(10, 10 + len(hidden))], (kind, hidden, spans)
            assert not any(base.values()) and not any(v for k, v in spans.items() if k != kind), (hidden, spans)
    for clean in ("call +1 (948) 555-4042 ein zu", "un 4111 1111 1111 1111 un", "one two three, 12 or 2023", "three of 10 2 300 4", "look at dot", "one.two", "a at b", "v 1.2.3.four.5.6"):
        base, spans = pii.all_spans(clean)
        assert spans == base, (clean, spans)


def test_long_texts_with_a_disguise_take_time_in_proportion():
    for text in (".".join(["a" * 64] * 15000) + " dot x", "a" * 10**6 + " dot x", " " * 10**6 + " dot x @ b", "x@" * 300_000 + " dot y", "a at " * 100_000 + " dot b", "[at] " * 100_000 + "a dot b", "7" * 10**6 + " one dot two"):
        began = time.time()
        pii.all_spans(text)
        assert time.time() - began < 5, text[:20]
    text = ".".join(["a" * 64] * 15000) + " at mail dot org"
    assert pii.all_spans(text)[1]["email"]


def test_a_text_of_many_lines_of_which_half_go(spark):
    many = "\n".join(f"only{i} here{i} so{i}" if i % 2 else f"twice{i} it{i} comes{i}" for i in range(30_000))
    first = "\n".join(many.split("\n")[::2])
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame([(1, first), (2, many), (3, None), (4, "")], "doc_id long, text string")).collect()}
    assert got[1]["text"] == first and got[2]["text"] == "\n".join(many.split("\n")[1::2]) and got[2]["n_removed"] == 15_000
    assert got[3]["text"] is None and got[4]["text"] == ""


def test_lean_pieces():
    """Pieces that are met once are not kept, and the ids are the same."""
    import public_tokenizers

    plain, lean = (wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"), x) for x in (False, True))
    texts = [f"word once{i}x, again{i % 50} 12-{i}.\n end" for i in range(2000)]
    assert plain.encode(texts) == lean.encode(texts) == plain.encode(texts) == lean.encode(texts[:1000]) + lean.encode(texts[1000:])
    lean, kept = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True), len(plain.pieces)
    lean.encode(texts)
    assert "again7" in lean.pieces and "once7x" not in lean.pieces and 10 * len(lean.pieces) < kept


def test_a_round_joins_only_factors(spark, monkeypatch):
    """A round of fitting is one written table of three broadcast factors; its error is seen while it is written."""
    seen, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    cells = spark.createDataFrame([("a", "x", 0, 5), ("b", "x", 1, 7), ("b", "y", 0, 11)], "source string, lang string, topic int, tokens long")
    _, error = mixing.rake(cells)
    plan = [p for n, p in seen if n == "cells"][-1]
    assert error > 0 and len(seen) == 3 and plan.count("Join Inner") == 7
