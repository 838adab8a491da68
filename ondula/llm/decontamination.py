"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items reads every text once.

Texts and items are normalised to words (ASCII letters lowered; words are runs of digits, letters and anything beyond ASCII). The automaton's
symbols are numbered words, so it has one node for a word of a window and a text is one pass over its words. Hits are mapped back to code
points of the original text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

WINDOW = 10
#: Characters of benchmark text in one automaton. A larger benchmark is read in several, each over all texts.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RESULT = "n_words long, hit array<int>, spans array<struct<start: int, end: int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Machine:
    """The automaton, the numbers of the words in it, and the items of each window."""

    automaton: ahocorasick.Automaton
    numbers: dict[bytes, int]


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Machine:
    """Items without words have no windows; windows of an item without an id count as hits, but name no item."""
    numbers: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            owners.setdefault(tuple(ids[i:i + window]), set()).update([] if item is None else [item])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, own in owners.items():
        automaton.add_word(key, (len(key), tuple(own)))
    if owners:
        automaton.make_automaton()
    return Machine(automaton, numbers)


def scan(text: str | None, machine: Machine) -> tuple[int, list[int], list[tuple[int, int]], list[str]]:
    """(number of words, hit words, their spans in code points, end exclusive, ids of the items with a window here)."""
    words = words_of(text)
    if not words or not machine.numbers:
        return len(words), [], [], []
    number = machine.numbers.get
    marks = None
    items: set[str] = set()
    for end, (length, own) in machine.automaton.iter(tuple([number(w, 0) for w in words])):
        marks = marks or bytearray(len(words))
        marks[end - length + 1:end + 1] = b"\x01" * length
        items.update(own)
    if marks is None:
        return len(words), [], [], []
    hit = [w for w, mark in enumerate(marks) if mark]
    return len(words), hit, merged(text, hit), sorted(items)


def merged(text: str, hit: Sequence[int]) -> list[tuple[int, int]]:
    """The spans of the words numbered ``hit`` (ascending) in ``text``, neighbours as one."""
    at = [m.span() for m in _WORD.finditer(text)]
    spans: list[tuple[int, int]] = []
    for k, w in enumerate(hit):
        if k and hit[k - 1] == w - 1:
            spans[-1] = spans[-1][0], at[w][1]
        else:
            spans.append(at[w])
    return spans


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _merged(text: pd.Series, hit: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in merged(t or "", h)] for t, h in zip(text, hit)])


_BUILT: dict[str, Machine] = {}


def _column(items: list[tuple[str | None, str | None]], df: DataFrame, window: int):
    sent, name = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(_RESULT)
    def found(text: pd.Series) -> pd.DataFrame:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = build(sent.value, window)
        rows = [scan(t, _BUILT[name]) for t in text]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "hit": [r[1] for r in rows],
                             "spans": [[{"start": a, "end": b} for a, b in r[2]] for r in rows], "items": [r[3] for r in rows]})

    return found


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` (merged, code points of the original text) and ``items`` (ids as strings, each once).

    A null or empty text has no words and no hits; so has every text if the benchmark is empty. Items may repeat an id or a text. Columns of ``docs``
    with the new names are replaced. The benchmark is the query set: it is cut into blocks of ``block_chars`` characters, one at a time reaches
    the driver and then the tasks. With one block no row of ``docs`` is shuffled; with more, each block's hits are joined by the text's digest,
    and spans are those of all hits together.
    """
    named = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))

    def load(k: int) -> list[tuple[str | None, str | None]]:
        return sorted(((r[0], r[1]) for r in named.where(block == k).collect()), key=lambda r: (r[0] or "", r[1] or ""))

    if n == 1:
        return _spread(docs.withColumn("__found", _column(load(0), docs, window)(F.col(text))))
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    texts = docs.select(digest.alias("__md5"), F.col(text).alias("__text"))
    hits = None
    for k in range(n):
        part = texts.select("__md5", _column(load(k), docs, window)("__text").alias("f")).where(F.size("f.hit") > 0).distinct()
        hits = part if hits is None else hits.unionByName(part)
    gathered = hits.groupBy("__md5").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"f.{c}")))).alias(c) for c in ("hit", "items")])
    nothing = _column([], docs, window)(F.col(text))
    joined = docs.withColumn("__md5", digest).withColumn("__none", nothing).join(gathered.select("__md5", F.struct("hit", "items").alias("__hits")), "__md5", "left")
    joined = joined.withColumn("__spans", F.when(F.col("__hits").isNotNull(), _merged(F.when(F.col("__hits").isNotNull(), F.col(text)), F.coalesce("__hits.hit", F.array().cast("array<int>")))))
    both = F.struct(F.col("__none.n_words"), F.coalesce("__hits.hit", "__none.hit").alias("hit"), F.coalesce("__spans", "__none.spans").alias("spans"),
                    F.coalesce("__hits.items", "__none.items").alias("items"))
    return _spread(joined.withColumn("__found", both).drop("__md5", "__none", "__hits", "__spans"))


def _spread(df: DataFrame) -> DataFrame:
    def of(name: str) -> Column:
        return F.col(f"__found.{name}")

    return (df.withColumn("n_words", of("n_words")).withColumn("n_hit", F.size(of("hit")).cast("long"))
            .withColumn("spans", of("spans")).withColumn("items", of("items")).drop("__found"))
