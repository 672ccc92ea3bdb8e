"""Personal data in whole texts, with offset-preserving deobfuscation.

Base detectors find e-mail addresses, IP addresses, card and phone numbers as written. The method
then runs transducers over the text, each of which maps every character that it writes to the source
characters that it read: homoglyphs and compatibility forms become ASCII and invisible characters
vanish; bracketed or spelled "at", "dot" and "plus" become signs; runs of spelled digits become digits. The same
detectors read the normalised text, and spans whose source reads otherwise, because a character of
it was rewritten or left out, are mapped back to source offsets. Base spans stay; an added span is never
inside another span of its kind. A plain spoken "at" before a host with written dots needs evidence: the
host ends in a known suffix (``SUFFIXES``) and the word before is none that English puts there
(``BEFORE_AT``); "look at example.com" stays as it is. With a spelled "dot" that word alone decides.

Offsets are code points, ends exclusive. Cases: a null text is empty and has no spans; long runs of
digits or address characters take linear time; ties are ordered by kind; an empty table gives an empty
one. Rows, repeated ones too, and columns are kept; a column of the input that is named like an added
one (in any case) is replaced by it.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelmill.llm.common import ddl, small_batches, without
from pixelmill.llm.shingles import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
ANY = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base detectors, by start, then kind."""
    if not ANY.search(text):
        return []
    out = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = DIGITS.sub("", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Look-alike letters of Cyrillic and Greek, and look-alike signs.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "·": ".", "∙": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "➕": "+", "ⓐ": "@",
    " ": " ", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = frozenset("­​‌‍⁠﻿")
NUMBER = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
WORDS = "|".join(sorted(NUMBER, key=len, reverse=True))
SPELLED = re.compile(rf"(?i)(?<!\w)(?:{WORDS})(?:[\s,.-]{{1,3}}(?:{WORDS}))+(?!\w)")
ONE_WORD = re.compile(rf"(?i){WORDS}")
SIGN = re.compile(
    r"(?i)(?:(?<!\s)\s++)?[(\[{<]\s*(?:(?P<at>at|arroba|@)|(?P<dot>dot|punto|punkt|point|\.))\s*[)\]}>]\s*"
    r"|&#0*64;|&commat;|&#x0*40;|(?P<dot2>&#0*46;|&period;|&#x0*2e;)"
)
SPOKEN = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])(?P<at>[ \t]+at[ \t]+)(?=[A-Za-z0-9-]+(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)(?P<host>[A-Za-z0-9-]+(?:(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)+)")
DOT = re.compile(r"(?i)[ \t]+dot[ \t]+")
# Suffixes of hosts that a plain spoken "at" may name, and words that stand before "at" in prose.
SUFFIXES = frozenset(
    "com org net edu gov mil int info biz name mobi aero app dev io ai co me tv cc eu us uk ca au nz ie de at ch fr es pt it nl be lu dk se no fi pl cz sk hu ro bg gr"
    " ru ua tr il in cn jp kr hk sg tw br mx ar cl za example test".split()
)
BEFORE_AT = frozenset(
    "a about again all am an and are arrive arrived as available aim aimed back based be been began begin being book both bought buy came check click come data did do done down"
    " each end ended even ever everyone files find for found free from get go going good had has have he held her here him his home host hosted i is it its join just laugh laughed"
    " live lived located look looked looking looks lot made me meet meeting meets met more most much my new news no not now of off on one online only open or order our out over"
    " page place posted price published read register run see seen she shop shouted site sites sold some start started stay stayed still stop stopped store study that the them"
    " then there they these things this those time to today tomorrow up us visit visited was watch we website well went were what when where which while who will with work"
    " worked working works yell yesterday you your".split()
)
PLUS = re.compile(rf"(?i)(?<!\w)plus[ \t]+(?=[0-9]|(?:{WORDS})\b)")
# What the characters' transducer reads.
ODD = re.compile(r"[^\x00-\x7f¡-¬®-¶¸-ɏ‘-‟…€]")
BRACKET = re.compile(r"[(\[{<&]")  # in all that SIGN finds
AT = re.compile(r"(?i)[ \t]at[ \t]")  # in all that SPOKEN finds
LOOSE = re.compile(r"(?<![0-9A-Za-z])(?=[OoIl|0-9 -]*[OoIl|])[0-9OoIl|](?:[\x20-]?[0-9OoIl|]){11,18}(?![0-9A-Za-z])")
LONE = re.compile(r"(?<![0-9OoIl|])[OoIl|](?![0-9OoIl|])")  # a separator or a word rather than a digit
LETTER_DIGIT = str.maketrans("OoIl|", "00111")


class Tape:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a string; each of its characters stands for all that was read."""
        text, start, end, at = [], [], [], 0
        for a, b, s in edits:
            if a < at:
                continue
            text.append(self.text[at:a] + s)
            start += self.start[at:a] + [self.start[a]] * len(s)
            end += self.end[at:a] + [self.end[b - 1]] * len(s)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start = start + self.start[at:]
        self.end = end + self.end[at:]


def characters(tape: Tape) -> None:
    edits = []
    for m in ODD.finditer(tape.text):
        c = m.group()
        s = "" if c in INVISIBLE else LOOKALIKE.get(c) or unicodedata.normalize("NFKC", c)
        if s != c and all(" " <= x <= "~" for x in s):
            edits.append((*m.span(), s))
    tape.rewrite(edits)


def address(text: str, m: re.Match) -> bool:
    """Whether a spoken "at" joins a mailbox and a host rather than two words of a sentence."""
    start = at = m.start("at")
    while start and at - start < 64 and text[start - 1] in LOCAL:
        start -= 1
    if text[start:at].lower() in BEFORE_AT:
        return False
    return bool(DOT.search(m["host"])) or m["host"].rpartition(".")[2].lower() in SUFFIXES


def signs(tape: Tape) -> None:
    tape.rewrite([(*m.span(), "." if m["dot"] or m["dot2"] else "@") for m in SIGN.finditer(tape.text)])
    edits = []
    for m in SPOKEN.finditer(tape.text):
        if address(tape.text, m):
            edits.append((*m.span("at"), "@"))
            edits += [(x.start(), x.end(), ".") for x in DOT.finditer(tape.text, *m.span("host"))]
    tape.rewrite(edits)
    tape.rewrite([(*m.span(), "+") for m in PLUS.finditer(tape.text)])


def digits(tape: Tape) -> None:
    edits = []
    for m in SPELLED.finditer(tape.text):
        words = list(ONE_WORD.finditer(tape.text, *m.span()))
        for k, w in enumerate(words):
            stop = words[k + 1].start() if k + 1 < len(words) else w.end()
            edits.append((w.start(), stop, NUMBER[w.group().lower()]))
    tape.rewrite(edits)


def rewritten(text: str) -> bool:
    """Whether any of the transducers has something to rewrite."""
    return bool(
        ODD.search(text) or BRACKET.search(text) and SIGN.search(text) or AT.search(text) and SPOKEN.search(text)
        or PLUS.search(text) or SPELLED.search(text)
    )


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by start, then kind."""
    base = base_spans(text)
    added: list[Span] = []
    if rewritten(text):
        tape = Tape(text)
        for step in (characters, signs, digits):
            step(tape)
        for kind, a, b in base_spans(tape.text):
            source = tape.start[a], tape.end[b - 1]
            if tape.text[a:b] != text[slice(*source)]:
                added.append((kind, *source))
    for m in LOOSE.finditer(text):
        raw = m.group()
        d = DIGITS.sub("", raw.translate(LETTER_DIGIT))
        if not LONE.search(raw) and sum(c.isdigit() for c in raw) >= 10 and 12 <= len(d) <= 19 and luhn(d):
            added.append(("card", *m.span()))
    taken = {k: [s for s in base if s[0] == k] for k in KINDS}
    for s in dict.fromkeys(added):
        if not any(t[1] <= s[1] and s[2] <= t[2] for t in taken[s[0]]):
            taken[s[0]].append(s)
    return base, sorted((s for own in taken.values() for s in own), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kinds in it."""
    out, at, end, kinds = [], 0, -1, []
    for kind, a, b in [*spans, ("", len(text) + 1, 0)]:
        if kinds and a >= end:
            out.append(f"[{'/'.join(dict.fromkeys(kinds)).upper()}]")
            at, kinds = end, []
        if not kinds:
            out.append(text[at:a])
            at = end = a
        kinds.append(kind)
        end = max(end, b)
    return "".join(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, *, text_col: str = "text", mask: bool = False) -> DataFrame:
    """``docs`` with base_spans and spans; with ``mask``, ``docs`` with the personal data of the text masked."""
    small_batches(docs.sparkSession)
    docs = docs if mask else without(docs, ["base_spans", "spans"], text_col)
    names = docs.columns
    at = names.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for big in batches:
            for b in slices(big, text_col):
                texts = b.column(at).to_pylist()
                found = [all_spans(t or "") for t in texts]
                if mask:
                    clean = [t if t is None else masked(t, s[1]) for t, s in zip(texts, found, strict=True)]
                    yield b.set_column(at, text_col, pa.array(clean, pa.string()))
                else:
                    cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], kind) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, "base_spans", "spans"])

    if mask:
        return docs.mapInArrow(run, docs.schema)
    return docs.mapInArrow(run, f"{ddl(docs)}, base_spans {SPANS}, spans {SPANS}")
