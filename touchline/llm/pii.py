"""Operator 6, PII: offset-preserving deobfuscation.

Base spans are found in the text as it stands. A text with any sign of disguise then goes through transducers that write a normalised text and keep, for each piece of it, the
source piece it stands for: homoglyphs, other digits and other spaces become ASCII, invisible characters vanish, runs of spelled digits (short ones too, where digits, + or other runs adjoin) become
digits, letters among digits (O, l) too, ``(at)``/``[dot]``/`` at .. dot ``/``_at_``, entities and spaced-out signs become ``@`` and ``.``. Identifiers found there are mapped back to source characters; those that don't lie within a base span are added, with the same kinds. So a base span that is
only a part of a disguised identifier stays, and the whole one stands beside it.

Null text counts as empty: no spans. Rows are scanned each by itself, whole; every step is linear in the text. Repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Task, documents, prepare, scan

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
#: Chains of 16 digits or more; shorter ones fail by their length anyway.
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FOUR = re.compile(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's leftmost non-overlapping matches, found from each @: its local part is the run before it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no match can reach over this @
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(x - 9 if (x := 2 * int(d)) > 9 else x for d in digits[-2::-2])) % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _FOUR.search(text) or "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
    if _FOUR.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


# --- Transducers -------------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@",
}
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+", "dot": ".", "point": ".", "dash": "-"}
INVISIBLE = "­​‌‍⁠﻿"


def _plain(c: str) -> str:
    """What a character stands for; itself, if it is no disguise."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    n = ord(c)
    if 0xFF01 <= n <= 0xFF5E:  # full width
        return chr(n - 0xFEE0)
    if n > 127 and unicodedata.category(c) == "Zs":
        return " "
    if n > 127 and unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    if 0x1D400 <= n <= 0x1D7FF:  # mathematical letters
        k = unicodedata.normalize("NFKC", c)
        return k if k.isascii() else c
    return c


_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z])(?:{_WORDS})(?:[\x20,-]{{1,2}}(?:{_WORDS})){{6,}}(?![A-Za-z])", re.IGNORECASE | re.ASCII)
_ONE = re.compile(rf"{_WORDS}", re.IGNORECASE | re.ASCII)
_WORD = re.compile(rf"(?<![A-Za-z])(?:{_WORDS})(?![A-Za-z])", re.IGNORECASE | re.ASCII)
#: What may stand between spelled digits of a run, and between a run and what adjoins it.
_WITHIN, _BETWEEN = re.compile(r"[\x20,-]{1,2}"), re.compile(r"[\x20,().-]{0,4}")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9+][\x20,().-]{0,4}\Z"), re.compile(r"[\x20,().-]{0,4}[0-9]")
_BRACKETED = re.compile(r"\x20{0,3}[\[({<]\x20{0,3}(at|@|dot|\.)\x20{0,3}[\])}>]\x20{0,3}", re.IGNORECASE | re.ASCII)
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\x20at\x20|_at_)(?=[A-Za-z0-9-])", re.IGNORECASE | re.ASCII)
#: Endings of domains that may stand after a dot with spaces around it; in prose, such a dot ends a sentence.
ENDINGS = "com org net edu gov info biz io co uk de fr es it nl ch at se no pl eu us ca au br in jp cn ru me dev app ai".split()
_FAR_DOT = rf"\x20\.\x20(?=(?:[a-z0-9-]{{1,63}}\x20?\.\x20?){{0,4}}(?:{'|'.join(ENDINGS)})(?![A-Za-z0-9]))"
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:\x20dot\x20|{_FAR_DOT}|_dot_)(?=[A-Za-z0-9._%+-])", re.IGNORECASE | re.ASCII)
#: Signs as mark-up and addresses write them, and an @ with spaces around it, where a domain of letters follows.
_ENTITY = re.compile(r"&(?:#0{0,4}64|#x0{0,4}40|commat);|%40|(&(?:#0{0,4}46|#x0{0,4}2e|period);|%2e)", re.IGNORECASE | re.ASCII)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\x20{1,2}@\x20{0,2}|@\x20{1,2})(?=[A-Za-z0-9-]{1,63}(?:(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2}|" + _FAR_DOT + "))", re.IGNORECASE | re.ASCII)
#: Digits among which letters stand for some.
_LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]{2,}(?![A-Za-z0-9])", re.ASCII)
_LABEL = re.compile(r"[A-Za-z0-9-]+")


class Mapped:
    """A normalised text, and for its pieces (start here, start and end in the source) what they stand for. Plain pieces map character by character."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.here, self.there, at, n = [], [], [], 0, 0
        for a, b, new in [*edits, (len(text), len(text), "")]:
            if at < a:
                parts.append(text[at:a])
                self.here.append(n)
                self.there.append((at, None))
                n += a - at
            if new:
                parts.append(new)
                self.here.append(n)
                self.there.append((a, b))
                n += len(new)
            at = b
        self.text = "".join(parts)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of [a, b)."""
        i, j = bisect_right(self.here, a) - 1, bisect_right(self.here, b - 1) - 1
        start, end = self.there[i], self.there[j]
        return (start[0] if start[1] is not None else start[0] + a - self.here[i]), (end[1] if end[1] is not None else end[0] + b - self.here[j])


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), p) for m in re.finditer(r"[^\x00-\x7f]", text) if (p := _plain(m[0])) != m[0]]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Each word of a run becomes a digit or sign; what stands between is dropped."""
    out = []
    for run in _SPELLED_RUN.finditer(text):
        for m in _ONE.finditer(text, *run.span()):
            at = out[-1][1] if out and out[-1][1] > run.start() else m.start()
            if at < m.start():
                out.append((at, m.start(), ""))
            out.append((m.start(), m.end(), SPELLED[m[0].lower()]))
    return out


def short_spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """The same for runs of any length, where digits, + or other runs adjoin (seven words or more together, if there are no digits)."""
    runs: list[list[re.Match]] = []
    for m in _WORD.finditer(text):
        if runs and _WITHIN.fullmatch(text, runs[-1][-1].end(), m.start()):
            runs[-1].append(m)
        else:
            runs.append([m])
    out, k = [], 0
    while k < len(runs):
        first = k
        while k + 1 < len(runs) and _BETWEEN.fullmatch(text, runs[k][-1].end(), runs[k + 1][0].start()):
            k += 1
        k += 1
        group = runs[first:k]
        start, end = group[0][0].start(), group[-1][-1].end()
        before, after = bool(_DIGIT_BEFORE.search(text, max(0, start - 5), start)), bool(_DIGIT_AFTER.match(text, end))
        if not before and not after and sum(map(len, group)) < 7:
            continue
        words = [(m, j == len(run) - 1) for run in group for j, m in enumerate(run)]
        sign = lambda m: SPELLED[m[0].lower()] in ".-"
        while words and not before and sign(words[0][0]):
            words.pop(0)
        while words and not after and sign(words[-1][0]):
            words.pop()
        for j, (m, last) in enumerate(words):
            new = SPELLED[m[0].lower()]
            a, b = m.span()
            if new in ".-" and j == 0:  # a sign joins what adjoins it
                a -= len(_spaces_before(text, a))
            if new in ".-+" and j == len(words) - 1:
                b = _SPACES.match(text, b).end()
            out.append((a, b, new))
            if j < len(words) - 1 and (not last or new in ".-+" or sign(words[j + 1][0])):
                out.append((b, words[j + 1][0].start(), ""))
    return out


def lettered_digits(text: str) -> list[tuple[int, int, str]]:
    """O and o for 0, I and l for 1, in words of digits."""
    return [(m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1") for m in _LETTERED.finditer(text) if any(c in "0123456789" for c in m[0]) for k, c in enumerate(m[0]) if c in "OoIl"]


_SPACES = re.compile(r"\x20{0,4}")


def _spaces_before(text: str, at: int) -> str:
    return text[max(0, at - 4) : at][len(text[max(0, at - 4) : at].rstrip(" ")) :]


def at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """Bracketed forms wherever they stand; bare dots in the labels on both sides of an @ of any form; a bare at where a domain follows and one of its dots, or of the dots before it, is disguised."""
    out = [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(text)]
    out += [(m.start(), m.end(), "." if m[1] else "@") for m in _ENTITY.finditer(text)] if "&" in text or "%" in text else []
    out += [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(text)] if "@" in text else []
    out.sort()
    out = [x for k, x in enumerate(out) if k == 0 or x[0] >= out[k - 1][1]]
    bare = [m.span() for m in _BARE_DOT.finditer(text)]
    if not bare and not out:
        return []
    brackets = [(a, b) for a, b, new in out if new == "."]
    after, before = dict(brackets) | dict(bare), {b: a for a, b in (*brackets, *bare)}
    is_bare, used = dict(bare), set()
    starts = [a for a, _, _ in out]
    any_over = lambda at: (k := bisect_right(starts, at)) > 0 and out[k - 1][1] > at  # noqa: E731  an @ that stands in a form above
    ats = sorted([(a, b, False) for a, b, new in out if new == "@"] + [(m.start(), m.end(), False) for m in re.finditer("@", text) if not any_over(m.start())] + [(*m.span(), True) for m in _BARE_AT.finditer(text)])
    local_of = {a for a, b, _ in ats if (m := _LABEL.match(text, b)) and (m.end() in after or text[m.end() : m.end() + 1] == ".")}
    for a, b, bare_at in ats:
        right, left, dots, at = [], [], 0, b
        while m := _LABEL.match(text, at):
            at = m.end()
            if at in after and _LABEL.match(text, after[at]):
                right.append(at)
                at = after[at]
            elif text[at : at + 1] == "." and _LABEL.match(text, at + 1):
                at += 1
            else:
                break
            dots += 1
        if at in local_of:  # what stands last is the local part before the next @, which has a domain
            while right:
                dots -= 1
                used.add(x := right.pop())
                if x in is_bare:
                    break
        if not dots:
            continue
        at = a
        while at > 0:
            start = at
            while at > 0 and text[at - 1] in _LOCAL:
                at -= 1
            if at == start or at not in before or before[at] in used:
                break
            at = before[at]
            left.append(at)
        if bare_at:
            if not right and not left:
                continue
            out.append((a, b, "@"))
        new = [x for x in (*left, *right) if x in is_bare and x not in used]
        used.update(new)
        out += [(x, is_bare[x], ".") for x in new]
    out.sort()
    return [x for k, x in enumerate(out) if k == 0 or x[0] >= out[k - 1][1]]


def disguised(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in the source, of identifiers found after normalising; none within another of its kind.

    Homoglyphs go first. Spelled digits are taken as they stand, by long runs and by short ones, and the at and dot forms of each of these; what any of the texts shows counts, so no reading hides another."""
    found: set[tuple[int, int, int]] = set()

    def collect(chain: list[Mapped]) -> list[Mapped]:
        for k, a, b in identifiers(chain[-1].text):
            for m in reversed(chain):
                a, b = m.source(a, b)
            found.add((k, a, b))
        return chain

    chain: list[Mapped] = []
    if not text.isascii() and (edits := homoglyphs(text)):
        chain = collect([Mapped(text, edits)])
    now, tried = chain[-1].text if chain else text, []
    forms = [(chain, now)]
    for f in (spelled_digits, short_spelled_digits, lettered_digits):
        if (edits := f(now)) and edits not in tried:
            tried.append(edits)
            longer = collect([*chain, Mapped(now, edits)])
            forms.append((longer, longer[-1].text))
    for chain, now in forms:
        if edits := at_and_dot(now):
            collect([*chain, Mapped(now, edits)])
    out, reach = [], {}
    for k, a, b in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if b > reach.get(k, -1):
            out.append((k, a, b))
            reach[k] = b
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by kind, then start."""
    if not text:
        return [], []
    base = identifiers(text)
    more = disguised(text)
    if more and base:
        by_start = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in by_start], list(accumulate((b for _, b in by_start), max))
        more = [x for x in more if not (i := bisect_right(starts, x[1])) or reach[i - 1] < x[2]]
    return base, sorted({*base, *more})


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def masked(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in angle brackets; of spans that overlap, the union goes, under the first one's kind."""
    found = sorted((a, b, k) for k, a, b in spans(text)[1])
    if not found:
        return text
    out, at, merged = [], 0, []
    for a, b, k in found:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
        else:
            merged.append((a, b, k))
    for a, b, k in merged:
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _scan(ids: list, texts: list) -> dict:
    out = {"doc_id": ids, **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": [], "n_spans": []}
    for t in texts:
        base, every = spans(t)
        for i, k in enumerate(KINDS):
            out[f"n_{k}"].append(sum(x[0] == i for x in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(every))
        out["n_spans"].append(len(every))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points), n_spans (all of them) of each row."""
    return scan(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", _scan)


class _Mask:
    def __init__(self, at: int):
        self.at = at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(self.at, b.schema.field(self.at), pa.array([masked(t) for t in b.column(self.at).to_pylist()], b.schema.field(self.at).type))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in its texts replaced by its kind. All other columns, of whatever name and type, go through as they are."""
    prepare(docs.sparkSession)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow can't name columns that hold a dot
    return plain.mapInArrow(Task(_Mask(docs.columns.index(text_col)), __name__), plain.schema).toDF(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
