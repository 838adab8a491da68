"""Token counts: batches of about equal bytes are encoded in Arrow functions that return lengths only.

Byte-level tokenizers first cut a text by a pattern into words, numbers, runs of other characters and white space, and no token spans such a cut.
So a long text may be encoded in pieces that end at cuts which the pattern makes whatever follows, and the lengths add up to that of the
whole. Pieces of many texts are packed into batches by their bytes: one huge text and ten thousand short ones cost memory alike.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import BROADCAST_BYTES, text_or_empty

#: Bytes of a batch; code points after which a text is cut at the next safe boundary.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 14
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

def _between(*ends: int) -> str:
    """The inside of a character class from the first and last code points of its ranges."""
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(ends[::2], ends[1::2]))


#: White space of any Unicode version, and controls: never in front of a boundary.
_BLANK = _between(0, 0x20, 0x7F, 0xA0, 0x1680, 0x1680, 0x180E, 0x180E, 0x2000, 0x200F, 0x2028, 0x202F, 0x205F, 0x2064, 0x3000, 0x3000, 0xFEFF, 0xFEFF)
#: Letters of Chinese and Japanese, and the stops and commas of their texts.
_LETTER, _STOP = _between(0x3041, 0x3096, 0x30A1, 0x30FA, 0x4E00, 0x9FFF), _between(0x3001, 0x3002, 0xFF0C, 0xFF0C)
#: Boundaries that the pattern makes on its own account: before white space; between letters and digits; before a mark that follows them.
_SAFE = re.compile(rf"(?<=[^{_BLANK}])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
                   rf"|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{{-~])|(?<=[{_LETTER}])(?=[{_STOP}])")


def pieces(text: str, special: tuple[str, ...] = (), size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in parts of ``size`` code points or more that end at safe boundaries, none of them within a string of ``special``."""
    start, at = 0, size
    while at < len(text) and (cut := _SAFE.search(text, at)):
        at = cut.start()
        if any(text.find(s, max(start, at - len(s) + 1), at + len(s) - 1) >= 0 for s in special):
            at += 1
            continue
        yield text[start:at]
        start, at = at, at + size
    yield text[start:]


def _byte_level(spec: dict) -> bool:
    """Whether a tokenizer file cuts by ``PATTERN`` alone, so that texts may be encoded in pieces."""
    first = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens") or [])
    return plain and not spec.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first["add_prefix_space"]


def encoder(name: str, data: bytes) -> tuple[Callable[[list[str]], list[int]], tuple[str, ...] | None]:
    """(function from texts to numbers of tokens, special strings that no cut may divide, or None where texts must stay whole)."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        own = Tokenizer.from_str(data.decode())
        own.no_truncation()
        own.no_padding()
        spec = json.loads(data)
        special = tuple(t["content"] for t in spec.get("added_tokens") or [])
        return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)], special if _byte_level(spec) else None
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        processor = SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(e) for e in processor.encode(texts, num_threads=1)], None
    if name.endswith(".tiktoken"):
        import base64

        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts], ()
    raise ValueError(f"no library for {name}: .json, .model or .tiktoken")


def lengths(texts: pa.Array, encode: Callable[[list[str]], list[int]], special: tuple[str, ...] | None, size: int = PIECE_CHARS) -> np.ndarray:
    """Tokens of each text; null texts have none."""
    total = np.zeros(len(texts), np.int64)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        np.add.at(total, owner, encode(batch))
        batch.clear()
        owner.clear()

    for row, value in enumerate(texts):
        text = value.as_py()
        if not text:
            continue
        for piece in (text,) if special is None else pieces(text, special, size):
            batch.append(piece)
            owner.append(row)
            held += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if held >= BATCH_BYTES:
                flush()
                held = 0
    if batch:
        flush()
    return total


_LOADED: dict[str, tuple] = {}


def token_count(text: Column, df: DataFrame, path: str) -> Column:
    """The number of tokens of ``text`` in rows of ``df``, by the tokenizer file at ``path`` on the driver, which is sent to the tasks."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > BROADCAST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; the bound is {BROADCAST_BYTES}")
    sent, name, kind = df.sparkSession.sparkContext.broadcast(data), uuid.uuid4().hex, os.path.basename(path)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = encoder(kind, sent.value)
        return pa.array(lengths(texts, *_LOADED[name]), pa.int64())

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` names a vocabulary: ``.json`` for tokenizers, ``.model`` for sentencepiece, ``.tiktoken`` for tiktoken. No tokens are added for the
    begin or end; strings of special tokens inside a text count as the library's default has it, texts are neither cut off nor padded. Null and
    empty texts have 0 bytes and tokens. Long texts are split only where the file's own rules make a cut, else they are encoded whole;
    a run of letters without any boundary stays in one piece. Nothing is shuffled; rows may repeat; columns with the new names are replaced.
    """
    out = docs.withColumn("n_bytes", F.octet_length(text_or_empty(text)).cast("long")).withColumn("n_tokens", token_count(F.col(text), docs, path))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
