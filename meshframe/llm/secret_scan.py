"""Secret scans: fixed patterns, and a battery of randomness tests over every other long token.

A candidate is a run of at least MIN_RUN letters, digits and +/_=- that no pattern covers, cut at
patterns inside it, at = but for padding, and, as no encoding has both +/ and -_, at whichever of
these leaves the less natural pieces. Its encoding is inferred from the characters it holds. Three tests ask whether it could be uniform
over that encoding's alphabet: chi-squared on the symbol counts, Wald-Wolfowitz runs about the
alphabet's middle, and lag-one serial correlation; Fisher's method joins their p-values, and a
candidate that fails them is ordinary text. The likelihood ratio of the uniform alphabet against
natural text is an e-value, whose inverse bounds the p-value of "this is natural text"; a
Benjamini-Hochberg step over the document's candidates, with weights in proportion to their
lengths, controls the share of false discoveries.

Odd cases: a null or empty text has no spans; equal rows give equal rows; an empty table gives
none; texts of any length are scanned whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

# The patterns, the least lengths, and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+\Z)?")
SIDES = tuple(re.compile(rf"[A-Za-z0-9{x}]{{20,}}(?:=+\Z)?") for x in ("+/", "_-"))

#: Encodings from the narrowest on; the first whose alphabet holds a candidate is taken for it.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
# Per cent of a-z in European prose.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)


# Per cent of steps from lower case, upper case, digits and signs to each of these in
# words and identifiers.
STEPS = ((90, 4, 4, 2), (42, 50, 5, 3), (10, 5, 80, 5), (50, 20, 25, 5))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _natural() -> tuple[dict[str, float], dict[str, float]]:
    """log-probabilities of characters in their class, and of each two characters' classes."""
    own = {chr(97 + i): math.log(x / sum(LETTERS)) for i, x in enumerate(LETTERS)}
    own |= {c.upper(): v for c, v in own.items()} | {c: math.log(0.1) for c in "0123456789"} | {c: math.log(0.2) for c in "+/_=-"}
    return own, {a + b: math.log(STEPS[_class(a)][_class(b)] / 100) for a in own for b in own}


_LOG, _STEP = _natural()


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_upper(x: float, k: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    return 0.5 * math.erfc(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) / math.sqrt(2))


def battery(codes: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for symbols coded 0 to size - 1."""
    n = len(codes)
    cells = max(2, min(size, n // 5))
    counts = np.bincount(codes * cells // size, minlength=cells)
    expected = n * np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    chi = _chi2_upper(float(((counts - expected) ** 2 / expected).sum()), cells - 1)
    up = codes >= size // 2
    a, b = int(up.sum()), int(n - up.sum())
    if not a or not b:
        runs = 2.0 * 0.5**n
    else:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _normal_two_sided((1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(max(var, 1e-9)))
    x = codes - codes.mean()
    power = float((x * x).sum())
    serial = _normal_two_sided(float((x[1:] * x[:-1]).sum()) / power * math.sqrt(n)) if power else 0.0
    return chi, runs, serial


def fisher(ps: tuple[float, ...]) -> float:
    """Joint p-value of independent tests."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term, total = 1.0, 0.0
    for i in range(len(ps)):
        total += term
        term *= half / (i + 1)
    return min(1.0, math.exp(-half) * total)


@lru_cache(maxsize=200_000)
def examine(run: str, least: float = 1e-3) -> float:
    """p-value of the claim that a run is natural text; 1 where the battery calls it non-random."""
    body = run.rstrip("=")
    held = set(body)
    code = next((code for _, letters, code in _SETS if held <= letters), None)
    if code is None or len(body) < MIN_RUN:
        return 1.0
    ratio = -len(body) * math.log(len(code)) - sum(map(_LOG.__getitem__, body)) - sum(_STEP[body[i : i + 2]] for i in range(len(body) - 1))
    if held.isdisjoint("0123456789") and (body.islower() or body.isupper() or body.istitle()):
        ratio -= math.log(1e6)  # one word of letters: natural text has very many more of them
    if ratio <= 0:
        return 1.0
    codes = np.array([code[c] for c in body])
    return math.exp(-ratio) if fisher(battery(codes, len(code))) >= least else 1.0


def discoveries(runs: list[str], rate: float = 1e-3) -> list[bool]:
    """Which runs are random: Benjamini-Hochberg over length-weighted p-values."""
    ps = [examine(r) for r in runs]
    m, total = len(runs), sum(map(len, runs))
    weighted = [p * total / (m * len(r)) for p, r in zip(ps, runs)]
    order = sorted(range(m), key=weighted.__getitem__)
    kept = max((k for k, i in enumerate(order, 1) if weighted[i] <= rate * k / m and ps[i] < 1), default=0)
    chosen = set(order[:kept])
    return [i in chosen for i in range(m)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, unordered."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out


def candidates(run: str, inner: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of a run that are tested, where inner are those of the patterns in it."""
    out, at = [], 0
    for a, b in [*sorted(inner), (len(run), len(run))]:
        for m in PIECE.finditer(run[at:a]) if a - at >= MIN_RUN else ():
            first, piece = at + m.start(), m[0]
            found = [(0, len(piece))]
            if re.search("[+/]", piece) and re.search("[_-]", piece):
                found = min(([x.span() for x in side.finditer(piece)] for side in SIDES), key=lambda c: min((examine(piece[x:y]) for x, y in c), default=1.0))
            out += [(first + x, first + y) for x, y in found]
        at = max(at, b)
    return out


def spans(text: str | None) -> tuple[list, list]:
    """(kind, start, end) of the patterns' spans and of all spans, in order; code points, end
    exclusive."""
    text = text or ""
    base, runs = base_spans(text), []
    for m in RUN.finditer(text):
        at, run = m.start(), m[0]
        inner = [("access", at + x.start(), at + x.end()) for x in ACCESS.finditer(run)]
        inner += [("hex", at + x.start(), at + x.end()) for x in HEX.finditer(run)]
        base += inner
        runs += [(at + a, at + b, run[a:b]) for a, b in candidates(run, [(a - at, b - at) for _, a, b in inner])]
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base.sort(key=order)
    held = [x for x in base if x[0] == "assign"]
    runs = [r for r in runs if not any(a < r[1] and r[0] < b for _, a, b in held)]
    found = discoveries([r[2] for r in runs]) if runs else []
    more = [("random", a, b) for (a, b, _), ok in zip(runs, found) if ok]
    return base, sorted(base + more, key=order)


def joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of each row, the latter as arrays of (kind, start, end)."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            both = [spans(t) for t in pdf["text"]]
            as_rows = lambda k: [[{"kind": a, "start": b, "end": c} for a, b, c in x[k]] for x in both]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": as_rows(0), "spans": as_rows(1)})

    span = "array<struct<kind:string,start:long,end:long>>"
    found = common.id_text(docs, "doc_id", "text").mapInPandas(run, f"doc_id string, base {span}, spans {span}")
    return common.id_back(found, docs, "doc_id")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
