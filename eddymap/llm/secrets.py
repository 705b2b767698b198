"""Secret scan: fixed patterns, and a battery of randomness tests for tokens that no pattern knows.

A candidate is a long run of token characters outside the fixed spans.  Its encoding (hex, base32 or
base64) is inferred from its characters, which become positions in that alphabet.  Three tests ask
whether they look drawn at random: chi-squared for equal use of eighths of the alphabet, the runs test
around its middle, and the correlation of neighbours.  Fisher's method combines the three p-values.
Random tokens have p-values spread evenly over (0, 1), ordinary ones heap up at 0; so per length class
the random ones are counted from the upper half, and the cut is put where at most ``q`` of what lies
above it is expected to be ordinary.  The histogram behind the cuts covers every document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, cut, rows_of

# The patterns and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
BINS = 100

_PLACES = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns, in order."""
    spans = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, dof: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return math.erfc(z / math.sqrt(2)) / 2


def places(token: str) -> tuple[str, list[int], int]:
    """Inferred encoding, positions of the characters in its alphabet, and the alphabet's size.

    Padding is cut off; the URL-safe forms of two characters count as the plain ones; upper-case hex
    is hex.
    """
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if body.upper() == body and all(c in "0123456789ABCDEF" for c in body):
        body = body.lower()
    for name, index in _PLACES:
        if all(c in index for c in body):
            return name, [index[c] for c in body], len(index)
    raise ValueError(f"not a token: {token!r}")


def p_random(token: str) -> float:
    """Combined p-value of the three tests; near 0 means not random.  All digits count as ordinary."""
    _, values, size = places(token)
    n = len(values)
    if n < 16 or token.isdigit():
        return 0.0
    cells = [0] * 8
    for v in values:
        cells[v * 8 // size] += 1
    chi = sum((c - n / 8) ** 2 for c in cells) * 8 / n
    upper = [2 * v >= size for v in values]
    ups = sum(upper)
    downs = n - ups
    if not ups or not downs:
        return 0.0
    runs = 1 + sum(a != b for a, b in zip(upper, upper[1:]))
    mean = 1 + 2 * ups * downs / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    mid = sum(values) / n
    power = sum((v - mid) ** 2 for v in values)
    serial = sum((a - mid) * (b - mid) for a, b in zip(values, values[1:])) / power if power else 1.0
    tails = (_chi_tail(chi, 7), _normal_tail((runs - mean) / math.sqrt(spread) if spread > 0 else 9.0),
             _normal_tail(serial * math.sqrt(n)))
    half = -sum(math.log(max(p, 1e-300)) for p in tails)  # half of Fisher's statistic, 6 degrees of freedom
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """``(start, end, length class, p)`` of the tokens that touch no fixed span."""
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if not any(s < b and a < e for s, _, e in spans):
            found.append((a, b, int(math.log2(b - a)), p_random(m[0])))
    return found


_FOUND = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>,"
          " found array<struct<start: int, stop: int, klass: int, p: double>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base_sha256", pa.string()), ("base", pa.list_(pa.string())),
        ("found", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("klass", pa.int32()), ("p", pa.float64())]))),
    ])
    for _, (ids, texts) in rows_of(batches):
        out = []
        for doc_id, text in zip(ids, texts):
            text = text or ""
            spans = base_spans(text)
            told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
            out.append({
                "doc_id": doc_id, **{f"n_{KINDS[k]}": sum(s[1] == k for s in spans) for k in range(3)},
                "base_sha256": hashlib.sha256(",".join(told).encode()).hexdigest(), "base": told,
                "found": [dict(zip(("start", "stop", "klass", "p"), c)) for c in candidates(text, spans)],
            })
        yield pa.RecordBatch.from_pylist(out, schema)


def cuts(counts: dict[tuple[int, int], int], q: float) -> dict[int, int]:
    """The lowest bin accepted in each length class; classes without a random token are left out.

    ``counts`` has the candidates per class and p-value bin.  If all tokens in the upper half are
    random, twice their number is the number of random ones, spread evenly.
    """
    lowest = {}
    for klass in {k for k, _ in counts}:
        at = [counts.get((klass, b), 0) for b in range(BINS)]
        random_per_bin = 2 * sum(at[BINS // 2:]) / BINS
        above = 0
        for b in range(BINS - 1, -1, -1):
            above += at[b]
            if random_per_bin and above - random_per_bin * (BINS - b) <= q * above:
                lowest[klass] = b
    return lowest


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` per row of ``docs``.

    ``spans`` lists fixed and added (``random``) spans as ``kind:start:end`` in code points.  The
    driver receives one count per length class (at most 32) and p-value bin (100).

    A null text is empty and has no spans; rows may repeat; an empty table gives no rows; other
    columns are ignored; equal starts are ordered by kind.
    """
    bounded_batches(docs.sparkSession)
    scanned = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                  .mapInArrow(_scan, _FOUND), "secret-candidates")
    bin_of = F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int")
    counts = scanned.select(F.explode("found").alias("c")).groupBy(F.col("c.klass").alias("klass"), bin_of.alias("bin")).count()
    lowest = cuts({(r["klass"], r["bin"]): r["count"] for r in counts.collect()}, q)
    taken = F.filter("found", lambda c: F.exists(F.array(*[
        (c["klass"] == k) & (c["p"] >= b / BINS) for k, b in lowest.items()]), lambda x: x) if lowest else F.lit(False))
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    parsed = F.transform("base", lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("a"), number[F.split(s, ":")[0]].alias("b"), s.alias("c")))
    added = F.transform(taken, lambda c: F.struct(
        c["start"].alias("a"), F.lit(KINDS.index("random")).alias("b"),
        F.concat(F.lit("random:"), c["start"].cast("string"), F.lit(":"), c["stop"].cast("string")).alias("c")))
    return scanned.select(
        F.col("doc_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(F.array_sort(F.concat(parsed, added)), lambda s: s["c"]), ",").alias("spans"),
        F.size(taken).cast("long").alias("n_random"))
