"""Secret scans: fixed patterns plus a randomness test battery with length-aware false-discovery control.

Candidates of the battery are runs of [A-Za-z0-9+/_-], with trailing '=' as padding, of 20 code points or more that no pattern
covers; an inner '=' parts a name from its value. A candidate's encoding is the smallest alphabet that holds it: hex, letters,
base32 or base36 of one case, base64 (also in its URL form). Symbols count by their rank in ordinary writing, and three tests look
at the ranks: chi-squared over classes of ranks, runs above and below the middle, lag-one serial correlation. Each test has two
null hypotheses:

* ordinary writing: the symbols' shares, how often neighbours change sides and how they correlate, as fitted to the
  document's own text outside the candidates, with a prior for short ones. Fisher's method combines the three P values, and a
  weighted Benjamini-Hochberg step over the document's candidates decides on them, with weights in proportion to the bits that
  a token could hold (length x log2 of the alphabet): long tokens are easier to accept at the same expected
  share of false discoveries. Words vary more than independent letters do, so chi-squared is divided by SPREAD.
* independent uniform symbols: an accepted token must also pass each test as random, at level ALPHA for the three together.

Runs of digits are numbers and no candidates.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import arrow_map, ids_and_text

KINDS = ("assign", "access", "hex")
#: Fixed patterns; a match that is too short is dropped after matching.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Runs that may hold candidates, and the candidates in a run: '=' is padding at its end and a separator elsewhere.
MIN_TOKEN = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+$)?")
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": (DIGITS + "abcdef", DIGITS + "ABCDEF"),
    "letters": (LETTERS, LETTERS.upper()),
    "base32": (LETTERS + "234567", LETTERS.upper() + "234567"),
    "base36": (LETTERS + DIGITS, LETTERS.upper() + DIGITS),
    "base64": (LETTERS + LETTERS.upper() + DIGITS + "+/", LETTERS + LETTERS.upper() + DIGITS + "-_"),
}
#: Shares of the letters in English writing, in per mille, a to z; a capital, digit or sign for so many small letters.
ENGLISH = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
CAPITAL, DIGIT, SIGN = 0.03, 4.0, 1.0

#: Level of the randomness tests, expected share of false discoveries, spread of words, weight of the prior in symbols.
ALPHA, FALSE_SHARE, SPREAD, PRIOR = 0.01, 0.003, 1.2, 300


def _share(c: str) -> float:
    return ENGLISH[ord(c) - 97] if "a" <= c <= "z" else CAPITAL * ENGLISH[ord(c) - 65] if "A" <= c <= "Z" else DIGIT if c in DIGITS else SIGN


class Alphabet:
    """Ranks of an encoding's symbols, the commonest in writing first, by byte (-1: none of them)."""

    def __init__(self, name: str, symbols: str):
        self.name, self.size, self.symbols = name, len(symbols), frozenset(symbols)
        order = sorted(symbols, key=lambda c: (-_share(c if name == "base64" else c.lower()), c))
        self.rank = np.full(256, -1, np.int64)
        for r, c in enumerate(order):
            # writing in either case says how common a letter is, where the alphabet has one case only
            self.rank[[ord(c)] if name == "base64" else [ord(c.lower()), ord(c.upper())]] = r
        self.prior = np.array([_share(c if name == "base64" else c.lower()) for c in order], float)
        self.prior /= self.prior.sum()

    def fitted(self, text: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Shares of the ranks in a text's bytes, how often neighbours change sides, and their correlation."""
        ranks = self.rank[text]
        counts = np.bincount(ranks[ranks >= 0], minlength=self.size)
        shares = (counts + PRIOR * self.prior) / (counts.sum() + PRIOR)
        upper = shares[self.size // 2 :].sum()
        together = (ranks[:-1] >= 0) & (ranks[1:] >= 0)
        a, b = ranks[:-1][together], ranks[1:][together]
        n = len(a)
        change = (((a >= self.size // 2) != (b >= self.size // 2)).sum() + PRIOR * 2 * upper * (1 - upper)) / (n + PRIOR)
        both = np.corrcoef(a, b)[0, 1] if n > 2 and a.std() and b.std() else 0.0
        return shares, float(change), float(both * n / (n + PRIOR))


KNOWN = [Alphabet(name, symbols) for name, kinds in ALPHABETS.items() for symbols in kinds]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(token: str) -> Alphabet | None:
    """The smallest alphabet that holds the token without its padding; none for digits alone."""
    symbols = set(token.rstrip("="))
    if symbols <= set(DIGITS):
        return None
    return min((a for a in KNOWN if symbols <= a.symbols), key=lambda a: a.size, default=None)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the regularised incomplete gamma function's series or fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 300):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, scale * h)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(ranks: np.ndarray, shares: np.ndarray, spread: float) -> float:
    """P value of the counts of at most 8 classes of neighbouring ranks, each with an expected count of two or more."""
    n = len(ranks)
    seen = np.bincount(ranks, minlength=len(shares))
    classes = max(2, min(8, n // 4))
    counts, expected, got, due = [], [], 0.0, 0.0
    for c, e in zip(seen.tolist(), (shares * n).tolist(), strict=True):
        got, due = got + c, due + e
        if due >= max(2.0, n / classes * 0.999):
            counts.append(got)
            expected.append(due)
            got = due = 0.0
    if due and expected and due < 2:
        counts[-1] += got
        expected[-1] += due
    elif due:
        counts.append(got)
        expected.append(due)
    if len(counts) < 2:
        return 1.0
    return chi2_tail(sum((c - e) ** 2 / e for c, e in zip(counts, expected, strict=True)) / spread, len(counts) - 1)


def battery(ranks: np.ndarray, shares: np.ndarray, change: float | None, both: float, spread: float) -> tuple[float, float, float]:
    """P values of shares, runs and serial correlation; change None: runs as the token's own numbers above and below the middle give them."""
    n = len(ranks)
    chi = chi_squared(ranks, shares, spread)
    high = ranks >= len(shares) // 2
    changes, above = int((high[1:] != high[:-1]).sum()), int(high.sum())
    if change is None and above and above < n:
        mean = 2 * above * (n - above) / n
        variance = mean * (mean - 1) / (n - 1)
        runs = normal_two_sided((changes - mean) / math.sqrt(variance)) if variance > 0 else 1.0
    elif change is None:
        runs = 2.0 ** (1 - n)
    else:
        change = min(max(change, 0.02), 0.98)
        runs = normal_two_sided((changes - (n - 1) * change) / math.sqrt(spread * (n - 1) * change * (1 - change)))
    off = ranks - ranks.mean()
    total = float((off * off).sum())
    serial = normal_two_sided((float((off[1:] * off[:-1]).sum()) / total + 1 / n - both) * math.sqrt(n / spread)) if total else 2.0 ** (1 - n)
    return chi, runs, serial


def fisher(ps: tuple[float, ...]) -> float:
    return chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, taken: list[tuple[int, int, str]]):
    """(start, end, token) of runs that no span of taken covers; both are in order, so they are walked together."""
    closed, at = merged(taken), 0
    for run in RUN.finditer(text):
        for m in CANDIDATE.finditer(run[0]):
            start, end = run.start() + m.start(), run.start() + m.end()
            while at < len(closed) and closed[at][1] <= start:
                at += 1
            if end - start >= MIN_TOKEN and (at == len(closed) or closed[at][0] >= end):
                yield start, end, m[0]


def random_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float, float]]:
    """(start, end, random-<encoding>, P under randomness, weighted P under ordinary writing) of the accepted tokens."""
    found = [(start, end, token, kind) for start, end, token in candidates(text, taken) if (kind := encoding(token))]
    if not found:
        return []
    rest, at = [], 0
    for a, b in merged(sorted([*taken, *((f[0], f[1], "") for f in found)])):
        rest.append(text[at:a])
        at = b
    plain = np.frombuffer(" ".join([*rest, text[at:]]).encode("utf-8", "replace"), np.uint8)
    known, scored = {}, []
    bits = [len(f[2].rstrip("=")) * math.log2(f[3].size) for f in found]
    mean = sum(bits) / len(bits)
    for f, b in zip(found, bits, strict=True):
        kind = f[3]
        if kind not in known:
            known[kind] = kind.fitted(plain)
        ranks = kind.rank[np.frombuffer(f[2].rstrip("=").encode(), np.uint8)]
        scored.append((fisher(battery(ranks, *known[kind], SPREAD)) * mean / b, f[0], f[1], kind, ranks))
    scored.sort(key=lambda x: x[:3])
    passed = max((i for i, x in enumerate(scored, 1) if x[0] <= FALSE_SHARE * i / len(scored)), default=0)
    out = []
    for q, start, end, kind, ranks in scored[:passed]:
        p = min(1.0, 3 * min(battery(ranks, np.full(kind.size, 1 / kind.size), None, 0.0, 1.0)))
        if p >= ALPHA:
            out.append((start, end, f"random-{kind.name}", p, q))
    return sorted(out)


FOUND = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_assign", LongType()),
        StructField("n_access", LongType()),
        StructField("n_hex", LongType()),
        StructField("base_sha256", StringType()),
        StructField("spans", StringType()),
        StructField("found", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("p_random", DoubleType()), StructField("p_text", DoubleType())]))),
    ]
)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets per row of docs, in code points, with the tests' P values for tokens that the battery adds.

    Null texts are empty; empty texts have no spans; repeated rows and null ids give a row each; an empty table gives
    none; other columns are not read.
    """

    def run(rows):
        for doc_id, data in rows:
            text = data.decode("utf-8", "replace")
            base = base_spans(text)
            extra = random_spans(text, base)
            spans = sorted([*base, *(e[:3] for e in extra)], key=lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else len(KINDS)))
            counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
            found = [dict(kind=k, start=a, end=b, p_random=None, p_text=None) for a, b, k in base] + [dict(kind=k, start=a, end=b, p_random=p, p_text=q) for a, b, k, p, q in extra]
            yield doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), found

    return arrow_map(ids_and_text(docs, id_col, text_col), run, FOUND)
