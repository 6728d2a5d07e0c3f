"""Operator 2, secret scans: base patterns, and probabilistic automata inferred from labelled credentials.

Base spans come from three fixed patterns. For the rest, one automaton a credential format is inferred (ALERGIA): a prefix tree of labelled credentials, whose states are merged
when Hoeffding's bound finds their next-symbol and stop frequencies compatible. One more is inferred from labelled strings that are no credentials. Every candidate, that is every maximal run of
SHORTEST characters or more, whether of token characters or of base64 ones, wherever it stands (also without the dots and dashes around it), is scored by each automaton: log2 of its likelihood under the
format, less that under uniform characters. Merged states forget how long texts are, so the examples' lengths give a format's likelihood of the run's length, against LENGTHS even ones; beyond the examples'
lengths it falls off as the square of the length, and never to nothing: no length is cut off. A format takes part if at most MISSES of the run's symbols are unseen where they stand.

A candidate that is only a piece of a longer run of token and base64 characters, or of base64 wrapped over lines, could have been cut out of it in many ways: the log2 of their number is taken off its score. So the
letters between the signs of an encoded image are no credential, while a token in a path, whose prefix weighs more than that, is one.

Where the best format's score is BITS or more above those of no credential and of random data (even characters of an alphabet, any length) and above 0, it adds a span of its name; of added spans that overlap, the one of the higher score stays.

Labels are (format, text) pairs, "" for no format; ``find_secrets`` takes any. Those taken by default are made from public descriptions of formats, by a fixed seed: ``EXAMPLES`` a format, of all
prefixes and lengths that it may have, and as many strings of each ordinary kind (names, paths, addresses, times, versions, identifiers).

Null text counts as empty: no spans. Rows are scanned each by itself, whole; repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scan

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A whole run is one match of + or none at all, so asking for the length within the pattern drops the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: runs of token characters, and of base64 ones.
CANDIDATES = (re.compile(r"[A-Za-z0-9_.-]{20,}"), re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"))
#: What a candidate may be a piece of: a run of either kind of characters, or lines of base64 as they are wrapped (60 or more, and what follows).
RUN, WRAPPED = re.compile(r"[A-Za-z0-9_.+/-]{20,}={0,2}"), re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{60,}+(?:\r?\n[A-Za-z0-9+/]++)+={0,2}")
SHORTEST, BITS, EXAMPLES, ALPHA, FLOOR, MISSES, LENGTHS = 20, 6.0, 300, 0.05, 2e-3, 2, 512

_UP, _LOW, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UP + _LOW + _DIGIT
_URL, _BASE64, _HEX = _ALNUM + "_-", _ALNUM + "+/", _DIGIT + "abcdef"
#: The formats, as public descriptions have them: literal texts (one of them), characters and how many (least, most), or characters and one of some numbers. A signature's length is its algorithm's.
FORMATS = {
    "aws": [(_BASE64, 40, 40)],
    "azure": [(_BASE64, 86, 86), "=="],
    "digitalocean": [["dop_v1_", "doo_v1_", "dor_v1_"], (_HEX, 64, 64)],
    "docker": ["dckr_pat_", (_URL, 27, 27)],
    "github": [["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], (_ALNUM, 36, 40)],
    "github_pat": ["github_pat_", (_ALNUM, 22, 22), "_", (_ALNUM, 59, 59)],
    "gitlab": [["glpat-", "gldt-", "glrt-"], (_URL, 20, 26)],
    "google": ["AIza", (_URL, 35, 35)],
    "huggingface": ["hf_", (_UP + _LOW, 34, 34)],
    "jwt": ["eyJ", (_URL, 15, 120), ".eyJ", (_URL, 20, 600), ".", (_URL, [43, 64, 86, 342, 683])],
    "npm": ["npm_", (_ALNUM, 36, 36)],
    "openai": [["sk-", "sk-proj-", "sk-svcacct-"], (_URL, 40, 160)],
    "pypi": ["pypi-AgEIcHlwaS5vcmc", (_URL, 70, 200)],
    "sendgrid": ["SG.", (_URL, 22, 22), ".", (_URL, 43, 43)],
    "slack": [["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], (_DIGIT, 10, 13), "-", (_DIGIT, 10, 13), "-", (_ALNUM, 24, 32)],
    "shopify": [["shpat_", "shpca_", "shppa_", "shpss_"], (_HEX, 32, 32)],
    "stripe": [["sk_live_", "sk_test_", "rk_live_", "rk_test_", "pk_live_", "pk_test_"], (_ALNUM, 24, 99)],
    "twilio": [["SK", "AC"], (_HEX, 32, 32)],
}
#: Parts of ordinary strings.
SYLLABLES = "an ar ber con data del di el en er for gen in ing is kom la li lo ma men mi na nis no or pre ra re ri ro sche se sta ta te ter ti tion to un ver".split()
ENDINGS = "com org net io html json py txt gz png log js css md xml".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _of(r: random.Random, letters: str, n: int) -> str:
    return "".join(r.choice(letters) for _ in range(n))


#: Ordinary strings that are long enough to be candidates.
ORDINARY = {
    "name": lambda r: r.choice("-_.").join(_word(r) for _ in range(r.randint(3, 7))),
    "mixed": lambda r: "".join(_word(r) + r.choice("-_.") for _ in range(r.randint(3, 6))) + _word(r),
    "compound": lambda r: "".join(_word(r) for _ in range(r.randint(3, 6))),
    "camel": lambda r: "".join(_word(r).capitalize() for _ in range(r.randint(3, 6))),
    "constant": lambda r: "_".join(_word(r).upper() for _ in range(r.randint(3, 6))),
    "path": lambda r: "/" * r.randint(0, 1) + "/".join(_word(r) for _ in range(r.randint(4, 8))),
    "host": lambda r: "www." * r.randint(0, 1) + ".".join(_word(r) for _ in range(r.randint(3, 5))) + "." + r.choice(ENDINGS),
    "file": lambda r: "_".join(_word(r) for _ in range(r.randint(2, 4))) + f"-{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}." + r.choice(ENDINGS),
    "time": lambda r: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-{r.randint(0, 59):02}.{r.randint(0, 999999):06}Z",
    "number": lambda r: r.choice("-.").join(_of(r, _DIGIT, r.randint(3, 12)) for _ in range(r.randint(2, 6))),
    "uuid": lambda r: "-".join(_of(r, _DIGIT + "abcdef", n) for n in (8, 4, 4, 4, 12)),
    "hash": lambda r: _of(r, _DIGIT + "abcdef", r.choice([32, 40, 56, 64, 96, 128])),
    "HASH": lambda r: _of(r, _DIGIT + "ABCDEF", r.choice([32, 40, 56, 64, 96, 128])),
    "rule": lambda r: r.choice("-_.=") * r.randint(20, 80),
}


def example(parts: list, r: random.Random) -> str:
    def one(p) -> str:
        if isinstance(p, str):
            return p
        if isinstance(p, list):
            return r.choice(p)
        return _of(r, p[0], r.choice(p[1]) if isinstance(p[1], list) else r.randint(p[1], p[2]))

    return "".join(map(one, parts))


def ordinary(kind: str, r: random.Random) -> str:
    while True:
        if len(s := ORDINARY[kind](r)) >= SHORTEST:
            return s


def labelled(n: int = EXAMPLES, seed: str = "labelled") -> list[tuple[str, str]]:
    """(format, text) pairs: n of each format, and n of each ordinary kind (format "")."""
    out = []
    for kind, parts in FORMATS.items():
        r = random.Random(f"{seed} {kind}")
        out += [(kind, example(parts, r)) for _ in range(n)]
    for kind in ORDINARY:
        r = random.Random(f"{seed} {kind}")
        out += [("", ordinary(kind, r)) for _ in range(n)]
    return out


class Automaton:
    """A probabilistic automaton: for each state, visits, stops, and (next state, visits) by symbol."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.n, self.stop, self.to = [0], [0], [{}]
        lengths = sorted(map(len, words)) or [0]
        self.longest, self.shortest = lengths[-1], lengths[0]
        #: lengths fall into eight spans or fewer; in each, all are as likely
        self.span = max(1, -(-(lengths[-1] - lengths[0] + 1) // 8))
        seen = [0] * ((lengths[-1] - lengths[0]) // self.span + 1)
        for n in lengths:
            seen[(n - lengths[0]) // self.span] += 1
        self.lengths = [math.log2(max(k / len(lengths), FLOOR) / self.span * LENGTHS) for k in seen]
        for w in words:
            s = 0
            self.n[0] += 1
            for c in w:
                t, k = self.to[s].get(c, (None, 0))
                if t is None:
                    t = len(self.n)
                    self.n.append(0)
                    self.stop.append(0)
                    self.to.append({})
                self.to[s][c] = t, k + 1
                s = t
                self.n[s] += 1
            self.stop[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha)) if alpha else 0.0
        if alpha:
            self._infer()
        self._weigh()

    def _differ(self, k1: int, n1: int, k2: int, n2: int) -> bool:
        return abs(k1 / n1 - k2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.n[a], self.n[b]
            if self._differ(self.stop[a], na, self.stop[b], nb):
                return False
            for c in self.to[a].keys() | self.to[b].keys():
                (x, p), (y, q) = self.to[a].get(c, (None, 0)), self.to[b].get(c, (None, 0))
                if self._differ(p, na, q, nb):
                    return False
                if x is not None and y is not None and x != y and self.n[x] > 1 and self.n[y] > 1:
                    todo.append((x, y))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.stop[a] += self.stop[b]
            for c, (y, q) in self.to[b].items():
                x, p = self.to[a].get(c, (None, 0))
                self.to[a][c] = (y if x is None else x), p + q
                if x is not None:
                    todo.append((x, y))

    def _infer(self) -> None:
        red, tried = [0], True
        while tried:
            tried = False
            kept = set(red)
            for s in red:
                blue = next(((c, t) for c, (t, _) in sorted(self.to[s].items()) if t not in kept), None)
                if blue:
                    c, t = blue
                    tried = True
                    # the parent first: random stretches become loops
                    for r in [s, *(x for x in reversed(red) if x != s)]:
                        if self.compatible(r, t):
                            self.to[s][c] = r, self.to[s][c][1]
                            self._fold(r, t)
                            break
                    else:
                        red.append(t)
                    break

    def _weigh(self) -> None:
        """Bits of each step and stop, for the states that are left; the tree goes."""
        number, todo = {0: 0}, [0]
        for s in todo:
            for t, _ in self.to[s].values():
                if t not in number:
                    number[t] = len(todo)
                    todo.append(t)
        self.states = len(todo)
        # given that the word goes on: its length has a likelihood of its own
        self.steps = [{c: (number[t], math.log2(max(k / (self.n[s] - self.stop[s]), FLOOR)) + UNIFORM) for c, (t, k) in self.to[s].items()} for s in todo]
        del self.n, self.stop, self.to

    def length_bits(self, n: int) -> float:
        k = (n - self.shortest) // self.span
        if 0 <= k < len(self.lengths):
            return self.lengths[k]
        return math.log2(FLOOR / self.span * LENGTHS) - 2 * math.log2(max(n / max(self.longest, 1), 1))

    def bits(self, word: str, misses: int = MISSES, even: float = math.inf) -> float:
        """log2 P(word) here, less that under uniform characters and lengths; an unseen symbol counts as FLOOR and leaves the state. -inf for more than ``misses`` of those.

        Symbols beyond the longest example's length count for ``even`` each at most: what random data would get, so that the examples' chance frequencies don't add up along a run of any length."""
        return self.length_bits(len(word)) + self.step_bits(word, misses, even)

    def step_bits(self, word: str, misses: int, even: float = math.inf) -> float:
        s, out, steps, known = 0, 0.0, self.steps, self.longest
        for i, c in enumerate(word):
            step = steps[s].get(c)
            if step is None:
                misses -= 1
                if misses < 0:
                    return -math.inf
                out += math.log2(FLOOR) + UNIFORM
            else:
                s, b = step
                out += b if i < known or b < even else even
        return out


UNIFORM = math.log2(len(_ALNUM) + 6)
#: What random data is written in: such strings are as likely as any, given their characters, whatever their length.
ALPHABETS = tuple((re.compile(f"[{chars}]*"), math.log2(size)) for chars, size in (("0-9", 10), ("0-9a-f", 16), ("0-9A-F", 16), ("A-Za-z0-9+/", 64), ("A-Za-z0-9_-", 64)))


def even_bits(word: str) -> float:
    """log2 P(word) under even characters of the smallest alphabet that has them, less that under all of them."""
    return len(word) * (UNIFORM - min((b for p, b in ALPHABETS if p.fullmatch(word)), default=UNIFORM))


def infer(labels: Iterable[tuple[str, str]]) -> dict[str, Automaton]:
    """An automaton for each format of the labels, by name; "" is that of no credential."""
    texts: dict[str, list[str]] = {}
    for kind, text in labels:
        if text:
            texts.setdefault(kind or "", []).append(text)
    return {k: Automaton(texts[k]) for k in sorted(texts)}


@lru_cache(1)
def automata() -> dict[str, Automaton]:
    """Those of the default labels; the driver infers them, once, and sends them out."""
    return infer(labelled())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _wholes(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of what candidates may be pieces of, in order. Wrapped base64 counts as one with all its lines."""
    starts, ends = [], []
    wrapped = [m.span() for m in WRAPPED.finditer(text)]
    k = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(wrapped) and wrapped[k][1] <= a:
            k += 1
        if k < len(wrapped) and wrapped[k][0] < b:
            a, b = min(a, wrapped[k][0]), max(b, wrapped[k][1])
        starts.append(a)
        ends.append(b)
    return starts, ends


def apart(spans: list[tuple[float, str, int, int]]) -> list[tuple[int, str, int]]:
    """Of spans (score, kind, start, end), those that are left when the best go first and what overlaps them goes: (start, kind, end), sorted. Only spans that hang together are held against each other."""
    out: list[tuple[int, str, int]] = []
    spans = sorted(spans, key=lambda x: x[2:])
    i = 0
    while i < len(spans):
        j, reach = i + 1, spans[i][3]
        while j < len(spans) and spans[j][2] < reach:
            reach = max(reach, spans[j][3])
            j += 1
        kept: list[tuple[int, int, str]] = []
        for _, kind, a, b in sorted(spans[i:j], key=lambda x: (-x[0], *x[2:])):
            k = bisect_right(kept, (a, math.inf, ""))
            if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
                kept.insert(k, (a, b, kind))
        out += [(a, kind, b) for a, b, kind in kept]
        i = j
    return out


def more_spans(text: str, found: dict[str, Automaton]) -> list[tuple[int, str, int]]:
    """(start, format, end) of the spans that the automata add, sorted."""
    scored: dict[tuple[int, int], tuple[float, str]] = {}
    starts, ends = _wholes(text)
    for pattern in CANDIDATES:
        for m in pattern.finditer(text):
            inner = m[0].strip("._-")
            for word, a in {(m[0], m.start()), (inner, m.start() + m[0].find(inner))}:
                if len(word) < SHORTEST or (a, a + len(word)) in scored:
                    continue
                even = even_bits(word.rstrip("="))
                each = even / len(word)
                best = max(((f.bits(word, MISSES, each), k) for k, f in found.items() if k), default=(-math.inf, ""))
                if best[0] < BITS:
                    continue
                # how many pieces the whole has; what is left of it without the dots and dashes around it is no piece
                k = bisect_right(starts, a) - 1
                x, y = starts[k], ends[k]
                more = 0.0 if len(text[x:y].strip("._-=")) <= len(word.strip("._-=")) else math.log2((y - x) * (y - x + 1) / 2)
                best = best[0] - more, best[1]
                none = max(even, found[""].step_bits(word, len(word)) if "" in found else 0.0)
                if best[0] >= BITS and best[0] - none >= BITS:
                    scored[a, a + len(word)] = best
    return apart([(score, kind, a, b) for (a, b), (score, kind) in scored.items()])


def joined(spans: list[tuple[int, int, int]], names: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


class _Scan:
    def __init__(self, found: dict[str, Automaton]):
        self.found, self.names = found, (*KINDS, *(k for k in sorted(found) if k))

    def __call__(self, ids: list, texts: list) -> dict:
        out = {"doc_id": ids, "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        number = {k: i for i, k in enumerate(self.names)}
        for t in texts:
            t = t or ""
            base = base_spans(t)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            more = [(a, number[k], b) for a, k, b in more_spans(t, self.found)]
            out["spans"].append(joined(sorted({*base, *more}), self.names))
        return out


def find_secrets(docs: DataFrame, labels: Iterable[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points) of each row. labels: (format, text) of labelled strings, a bounded list in the driver."""
    found = automata() if labels is None else infer(labels)
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return scan(two, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", _Scan(found))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
