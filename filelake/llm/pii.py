"""Personal data with offset-preserving deobfuscation.

Two transducers rewrite a text and keep, for each character they write, the source span it stands for:
one maps look-alike characters and digits of other scripts to ASCII and drops invisible ones, the other
rewrites spelled digits and disguised "at" and "dot". The kinds are then sought in the result and their
spans mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, prepare

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that is followed by no dot, or by too few parts, fails from each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: around each @ the longest local part before it and the domain behind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind; matches that fail their test are dropped, without another try inside them."""
    out = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# Letters of other scripts that look like ASCII ones, and characters without width.
_CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅ", "aeopcyxijsdhqwABEKMHOPCTXYIJS", strict=True))
_GREEK = dict(zip("οανρτυχκιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavptuxkiABEZHIKMNOPTYX", strict=True))
_MARKS = dict(zip("․。．﹒＠﹫‐‑‒–−﹣－＋﹢    ", "....@@-------++    ", strict=True))
_INVISIBLE = "​‌‍⁠﻿­"


def _alike() -> dict[int, str]:
    out = {ord(k): v for k, v in (_CYRILLIC | _GREEK | _MARKS).items()}
    out |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}
    for block in (range(0x1D400, 0x1D800), range(0x2460, 0x2474), range(0x2080, 0x208A), range(0x2070, 0x207A)):
        for c in block:
            to = unicodedata.normalize("NFKC", chr(c))
            if len(to) == 1 and to.isascii() and to.isalnum():
                out.setdefault(c, to)
    for c in range(0x600, 0xABFF):
        if (d := unicodedata.digit(chr(c), None)) is not None:
            out.setdefault(c, str(d))
    return out


ALIKE = _alike()
_ODD = frozenset(map(chr, ALIKE)) | frozenset(_INVISIBLE)
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")

# How "at", "dot", "plus" and digits are spelled in the languages covered.
_AT = "at|arroba|ät|chez|arobase"
_DOT = "dot|punkt|punto|point"
_DIGITS = {
    "0": "zero oh null cero zéro nul",
    "1": "one eins ein uno un une",
    "2": "two zwei zwo dos deux",
    "3": "three drei tres trois",
    "4": "four vier cuatro quatre",
    "5": "five fünf fuenf cinco cinq",
    "6": "six sechs seis",
    "7": "seven sieben siete sept",
    "8": "eight acht ocho huit",
    "9": "nine neun nueve neuf",
}
SPELLED = {w: d for d, names in _DIGITS.items() for w in names.split()}
_NAMES = "|".join(sorted(SPELLED, key=len, reverse=True))
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_SPACED_DOT = rf"(?<![ \t])(?:{_OPEN}(?:{_DOT}|\.){_CLOSE}|[ \t]+(?:{_DOT})[ \t]+)"
_LABEL = r"[A-Za-z0-9-]{1,63}"
#: A disguised address is sought from its "at": the local part to the left, in the reversed text, and a domain to the
#: right, with a disguised dot or, behind brackets, a true one. A local part has up to nine pieces of 64 characters.
_AT_MARK = re.compile(rf"@|(?<=[ \t\[({{<])(?:{_AT})(?=[ \t\])}}>])", re.IGNORECASE)
_DOT_BACK = rf"(?:{_CLOSE}(?:{'|'.join(x[::-1] for x in _DOT.split('|'))}|\.){_OPEN}|[ \t]+(?:{'|'.join(x[::-1] for x in _DOT.split('|'))})[ \t]+)"
_LOCAL_BACK = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}(?:(?:\.|{_DOT_BACK})[A-Za-z0-9_%+-]{{1,64}}){{0,8}}", re.IGNORECASE)
_BRACKET_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|{_SPACED_DOT}){_LABEL}){{1,8}}", re.IGNORECASE)
_SPACED_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|{_SPACED_DOT}){_LABEL})*{_SPACED_DOT}{_LABEL}(?:(?:\.|{_SPACED_DOT}){_LABEL}){{0,8}}", re.IGNORECASE)
_DOT_IN = re.compile(_SPACED_DOT, re.IGNORECASE)
#: Two to 41 spelled digits or pieces of digits in a row.
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ ,.-]{{0,2}})?(?:(?:{_NAMES}|[0-9]+)(?:[ ,.()-]{{1,3}}|(?!\w))){{1,40}}(?:{_NAMES}|[0-9]+)(?!\w)", re.IGNORECASE)
#: Four numbers, of which digits may be spelled, with a dot, bare or disguised, between each two.
_PART = rf"(?:{_NAMES}|[0-9]{{1,3}})(?:[ -](?:{_NAMES}|[0-9])){{0,2}}"
_SPELLED_IP = re.compile(rf"(?<![\w.]){_PART}(?:(?:\.|{_SPACED_DOT}){_PART}){{3}}(?!\w|\.\w|{_SPACED_DOT}\w)", re.IGNORECASE)
_NAME = re.compile(rf"(?<![^\W\d_])(?:{_NAMES})(?![^\W\d_])", re.IGNORECASE)
_PLUS = re.compile(r"plus[ ,.-]{0,2}", re.IGNORECASE)
#: Cheap tests that a text must pass before the costly patterns are tried.
_BRACKETS = re.compile(rf"[\[({{<][ \t]*(?:{_AT}|@|{_DOT}|\.)[ \t]*[\])}}>]", re.IGNORECASE)
_DOTS = frozenset(_DOT.split("|"))
_DOT_WORDS = [f" {x} ".encode() for x in _DOT.split("|")]
_SPACED = bytes.maketrans(b"\t\r\n,.()-", b"        ")
_WORD = re.compile(r"[^\W_]+")
#: Four numbers with a dot, bare or disguised, between each two.
_NUMBERS = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\.|{_SPACED_DOT})[0-9]{{1,3}}){{3}}(?![\w])", re.IGNORECASE)


def _lower(text: str) -> str:
    """Lower case, by character; letters that re.IGNORECASE holds equal to i and s become these."""
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


def _may_mail(text: str, low: bytes) -> bool:
    if any(x in low for x in _DOT_WORDS):
        return True
    return ("[" in text or "(" in text or "{" in text or "<" in text) and _BRACKETS.search(text) is not None


def _may_spell(low: str) -> tuple[bool, bool]:
    """Whether a text may have a run of digits, and an IP address, with spelled digits: a name of a digit, and three of
    them or eight digits for a run, four pieces for an address, with nothing but marks (and words for dots) between."""
    pieces = _WORD.findall(low)
    if SPELLED.keys().isdisjoint(pieces) and "plus" not in low:
        return False, False
    run = ip = False
    names = digits = parts = spelled = 0
    for x in pieces:
        if x.startswith("plus"):  # a run may begin in it
            names, digits, x = 0, 0, x[4:]
        if x in SPELLED:
            names, digits, parts, spelled = names + 1, digits + 1, parts + 1, spelled + 1
        elif x.isdigit():
            digits, parts = digits + len(x), parts + 1
        elif x:
            names = digits = 0
            if x not in _DOTS:
                parts = spelled = 0
        run = run or names >= 3 or (names > 0 and digits >= 8)
        ip = ip or (spelled > 0 and parts >= 4)
    return run, ip


def _may_run(low: str) -> bool:
    """True of all texts in which _RUN finds what is used."""
    return _may_spell(low)[0]


@dataclass
class Written:
    """A text and, piece by piece, where it stands in its source: (place, source start, source end)."""

    text: str
    place: list[int]
    source: list[tuple[int, int, bool]]  # True: character for character

    def back(self, start: int, end: int) -> tuple[int, int]:
        def piece(i):
            k = bisect_right(self.place, i) - 1
            a, b, same = self.source[k]
            return (a + i - self.place[k], a + i - self.place[k] + 1) if same else (a, b)

        return piece(start)[0], piece(end - 1)[1]


def rewrite(text: str, changes: list[tuple[int, int, str]]) -> Written:
    """Put each change (start, end, new) in its place; changes are in order and do not overlap."""
    out, place, source, last, size = [], [], [], 0, 0
    for start, end, new in [*changes, (len(text), len(text), "")]:
        for piece, span in ((text[last:start], (last, start, True)), (new, (start, end, False))):
            if piece:
                out.append(piece)
                place.append(size)
                source.append(span)
                size += len(piece)
        last = end
    return Written("".join(out), place, source)


def _mails(text: str) -> Iterator[tuple[int, int, str]]:
    """What to change in disguised addresses: their at, and the dots of both parts. Each mark is tried once."""
    back, size, last = text[::-1], len(text), 0
    for m in _AT_MARK.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1] in " \t":
            a -= 1
        while b < size and text[b] in " \t":
            b += 1
        bracketed = a > last and text[a - 1] in "[({<" and b < size and text[b] in "])}>"
        if bracketed:
            a, b = a - 1, b + 1
            while a > last and text[a - 1] in " \t":
                a -= 1
            while b < size and text[b] in " \t":
                b += 1
        elif m[0] != "@" and (a == m.start() or b == m.end()):
            continue
        domain = (_BRACKET_DOMAIN if bracketed else _SPACED_DOMAIN).match(text, b)
        local = domain and _LOCAL_BACK.match(back, size - a, size - last)
        if local:
            start = size - local.end()
            yield a, b, "@"
            for i, part in ((start, text[start:a]), (b, domain[0])):
                yield from ((d.start() + i, d.end() + i, ".") for d in _DOT_IN.finditer(part))
            last = domain.end()


def _addresses(text: str) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """Start, end and changes of IP addresses with spelled digits; each number becomes its digits."""
    for m in _SPELLED_IP.finditer(text):
        if not _NAME.search(m[0]):
            continue
        dots = [d.span() for d in re.finditer(rf"{_SPACED_DOT}|\.", m[0], re.IGNORECASE)]
        edges = [0, *[i for d in dots for i in d], len(m[0])]
        parts = [(a, b, re.sub("[ -]", "", _NAME.sub(lambda n: SPELLED[_lower(n[0])], m[0][a:b]))) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        if all(p.isdecimal() and int(p) <= 255 for _, _, p in parts):
            changes = sorted(parts + [(a, b, ".") for a, b in dots])
            yield m.start(), m.end(), [(m.start() + a, m.start() + b, new) for a, b, new in changes]


def _disguises(text: str) -> list[tuple[int, int, str]]:
    found, low = [], _lower(text)
    may_run, may_ip = _may_spell(low)
    if _may_mail(text, low.encode().translate(_SPACED)):
        found += _mails(text)
        for m in _NUMBERS.finditer(text):
            found += [(d.start() + m.start(), d.end() + m.start(), ".") for d in _DOT_IN.finditer(m[0])]
    if may_run:
        for m in _RUN.finditer(text):
            names = list(_NAME.finditer(m[0]))
            digits = sum(c.isdigit() for c in _NAME.sub("0", m[0]))
            if not names or digits < 8:
                continue
            pieces = [(n.start(), n.end(), SPELLED[_lower(n[0])]) for n in names]
            if p := _PLUS.match(m[0]):
                pieces.insert(0, (0, p.end(), "+"))
            # Between two digits of a run other marks than those the kinds allow become a space.
            marks = [(x.start(), x.end(), " ") for x in re.finditer(r"(?<=\S)(?:[,.] ?| [,.]|[ -]{2,3})(?=\S)", m[0]) if not any(a < x.end() and x.start() < b for a, b, _ in pieces)]
            changes = sorted(pieces + marks)
            # One or two names count where only they complete a number: prose has them beside figures and numbers.
            whole, bare = find(rewrite(m[0], changes).text), find(m[0])
            if len(names) < 3 and (bare["card"] or bare["phone"] or not (whole["card"] or whole["phone"])):
                continue
            found += [(m.start() + a, m.start() + b, new) for a, b, new in changes]
    if may_ip:
        for start, end, changes in _addresses(text):
            found = [c for c in found if c[1] <= start or end <= c[0]] + changes
    out, last = [], 0
    for a, b, new in sorted(found):
        if a >= last:
            out.append((a, b, new))
            last = b
    return out


def deobfuscated(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans, in the source, of what the transducers bring to light; empty for texts without disguises."""
    odd = not text.isascii() and not _ODD.isdisjoint(set(text))
    first = rewrite(text.translate(ALIKE), [(m.start(), m.end(), "") for m in _HIDDEN.finditer(text)]) if odd else rewrite(text, [])
    changes = _disguises(first.text)
    if not changes and first.text == text:
        return {}
    second = rewrite(first.text, changes)
    out = {}
    for kind, spans in find(second.text).items():
        mapped = []
        for start, end in spans:
            a, b = second.back(start, end)
            a, b = first.back(a, b)
            mapped.append((a, b))
        out[kind] = mapped
    return out


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, base spans and those that deobfuscation adds). An added span lies in no base span of its kind."""
    base, more = find(text), {}
    for kind, spans in deobfuscated(text).items():
        more[kind] = [s for s in spans if not any(a <= s[0] and s[1] <= b for a, b in base[kind])]
    return base, {k: sorted(base[k] + more.get(k, [])) for k in KINDS}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        both = [all_spans(x or "") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column(0)}
            | {f"n_{k}": pa.array([len(b[k]) for b, _ in both], pa.int64()) for k in KINDS}
            | {
                "base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both], pa.string()),
                "spans": pa.array([joined(a) for _, a in both], pa.string()),
                "n_added": pa.array([sum(map(len, a.values())) - sum(map(len, b.values())) for b, a in both], pa.int64()),
            }
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs (doc_id, text).

    The counts and base_sha256 are of what stands in the text as it is; spans also has what is disguised,
    as code points of the source, end exclusive. A disguised local part is of at most nine pieces of 64 characters, a
    domain behind a bracketed at of nine labels, a run of spelled digits of 41 pieces; one or two
    spelled digits beside what is a card or phone number without them are not taken into it. Null and empty texts have none; rows are independent, so
    null or repeated doc_ids and other columns make no difference."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
