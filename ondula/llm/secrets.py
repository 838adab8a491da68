"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens with control of false discoveries by length.

A token's encoding is inferred from its characters; its symbols are tested for a uniform alphabet (chi-squared), for runs about the
alphabet's middle and for serial correlation, and the three p-values are combined by Fisher's method. For random tokens the combined p-value is
uniform, for ordinary ones it lies near 0. So, among all tokens of an encoding and length class in the corpus, secrets of base spans included, those with p over a half tell how many
random ones there are, and from that follows the lowest level at which the expected share of ordinary tokens stays within bounds.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import written

#: The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
_MENTIONED = ("passw", "secret", "token", "api")

KINDS = ("assign", "access", "hex", "random")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
LENGTHS = (16, 20, 28, 40, 64)
BINS = 100
#: Expected share of ordinary tokens among those reported, per encoding and length class.
FALSE_SHARE = 0.1
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_VALUES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(m in low for m in _MENTIONED):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token; None for words: letters of one case, or a capital before small letters."""
    t = token.rstrip("=").replace("-", "+").replace("_", "/")
    digits, upper, lower = (any(p(c) for c in t) for p in (str.isdigit, str.isupper, str.islower))
    if not digits and not (upper and lower and not t[1:].islower()):
        return None
    if t.isdigit():
        return None
    low = t.lower() if not (upper and lower) else t
    for name in ("hex", "base32", "base36", "base62", "base64"):
        if set(t if name == "base32" else low) <= _VALUES[name].keys():
            return name
    return None


def uniform_p(token: str, name: str) -> float:
    """The combined p-value of the three tests that the token is uniformly random over its alphabet."""
    t = token.rstrip("=").replace("-", "+").replace("_", "/")
    t = t.lower() if name in ("hex", "base36") else t
    values = [_VALUES[name][c] for c in t]
    n, k = len(values), len(_VALUES[name])
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    square = k / n * sum(c * c for c in counts.values()) - n
    even = math.erfc((square - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)) / math.sqrt(2)) / 2
    runs = 1 + sum((a < k / 2) != (b < k / 2) for a, b in zip(values, values[1:]))
    run = math.erfc(abs(runs - (n + 1) / 2) / math.sqrt((n - 1) / 4) / math.sqrt(2))
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / spread / math.sqrt(n - 1)
    follow = math.erfc(abs(serial) / math.sqrt(2))
    x = -sum(math.log(max(p, 1e-300)) for p in (even, run, follow))
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2))


def stratum(name: str, length: int) -> int:
    return list(ALPHABETS).index(name) * len(LENGTHS) + sum(length >= low for low in LENGTHS[1:])


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin of the p-value) of tokens with an encoding that no base span overlaps."""
    out = []
    for m in TOKEN.finditer(text):
        name = encoding(m[0])
        if name and not any(a < m.end() and m.start() < b for _, a, b in base):
            out.append((*m.span(), stratum(name, len(m[0])), min(BINS - 1, int(uniform_p(m[0], name) * BINS))))
    return out


def judged(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, float | None, int | None, int | None]]:
    """(encoding, combined p-value, stratum, bin) of the secret in each base span; nothing where it has no encoding."""
    out = []
    for kind, start, end in base:
        token = ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]
        name = encoding(token)
        p = uniform_p(token, name) if name else None
        out.append((name, p, stratum(name, len(token)), min(BINS - 1, int(p * BINS))) if name else (None,) * 4)
    return out


def levels(histogram: dict[tuple[int, int], int]) -> dict[int, int]:
    """For each stratum the lowest bin from which tokens are reported; BINS if none is."""
    out = {}
    for s in {s for s, _ in histogram}:
        counts = [histogram.get((s, b), 0) for b in range(BINS)]
        random = 2 * sum(counts[BINS // 2:])
        out[s] = BINS
        for b in range(BINS // 2 + 1):
            above = sum(counts[b:])
            if random and above and 1 - (1 - b / BINS) * random / above <= FALSE_SHARE:
                out[s] = b
                break
    return out


_FOUND = ("base array<struct<kind: int, start: int, end: int, encoding: string, p: double, stratum: int, bin: int>>, tokens array<struct<start: int, end: int, stratum: int, bin: int>>")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``spans`` and ``verdicts``.

    ``spans`` is an array of (start, kind, end) by start, then kind (its place in ``KINDS``), code points, end exclusive. ``verdicts`` has the battery's view of each
    base span: (start, kind, end, encoding, p, random), where ``random`` tells whether p passes the level of its encoding and length class and is 0.01 or more; encoding and p are null, and
    random is false, where the secret has no encoding (words, or characters of no alphabet). Base spans stay whatever the verdict.

    Null and empty texts have none. Whole texts are read, once; the findings are written, the p-values of all tokens of the corpus are counted (a table
    of fixed size: encodings x length classes x bins), and the levels from it decide on each token. A token that repeats is counted
    as often as it occurs. An empty table gives an empty result. Kept columns called ``spans`` or ``verdicts`` are
    replaced.
    """
    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        base, tokens = [], []
        for t in texts:
            own = base_spans(t or "")
            base.append([{"kind": KINDS.index(k), "start": a, "end": b, "encoding": v[0], "p": v[1], "stratum": v[2], "bin": v[3]}
                         for (k, a, b), v in zip(own, judged(t or "", own))])
            tokens.append([dict(zip(("start", "end", "stratum", "bin"), c)) for c in candidates(t or "", own)])
        return pd.DataFrame({"base": base, "tokens": tokens})

    rows = written(docs.select(*keep, found(F.col(text)).alias("__found")))
    seen = F.concat(F.transform("__found.tokens", lambda t: F.struct(t["stratum"].alias("stratum"), t["bin"].alias("bin"))),
                    F.transform(F.filter("__found.base", lambda t: t["bin"].isNotNull()), lambda t: F.struct(t["stratum"].alias("stratum"), t["bin"].alias("bin"))))
    counts = rows.select(F.explode(seen).alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    level = levels({(r[0], r[1]): r[2] for r in counts})
    lowest = F.create_map(*[F.lit(x) for pair in sorted(level.items()) for x in pair]) if level else F.create_map(F.lit(-1), F.lit(BINS))
    added = F.filter("__found.tokens", lambda t: t["bin"] >= lowest[t["stratum"]])

    def span(kind: Column, x: Column) -> Column:
        return F.struct(x["start"].alias("start"), kind.cast("int").alias("kind"), x["end"].alias("end"))

    everything = F.concat(F.transform("__found.base", lambda x: span(x["kind"], x)), F.transform(added, lambda x: span(F.lit(3), x)))
    def verdict(x: Column) -> Column:
        passed = F.coalesce((x["bin"] >= lowest[x["stratum"]]) & (x["bin"] > 0), F.lit(False))
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["encoding"].alias("encoding"), x["p"].alias("p"), passed.alias("random"))

    out = rows.withColumn("spans", F.array_sort(everything)).withColumn("verdicts", F.transform("__found.base", verdict))
    return out.select(*[c for c in keep if c not in ("spans", "verdicts")], "spans", "verdicts")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
