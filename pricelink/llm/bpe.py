"""Byte-level BPE with the tiktoken library: encode whole texts to ids, decode ids to raw bytes.

A text is encoded as the library would encode it in one call, without special tokens. Long texts are first cut
at safe boundaries, so that memory and time of a call stay bounded: the split pattern has no match that goes on
from a non-space character into a white-space character, and its only look-ahead sits behind white space; so
each place where white space follows non-space always starts a new match, and a cut there changes no token.

Null texts count as empty and give no ids. A stretch without any safe boundary stays one piece, however long.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters of a text that go to the tokenizer in one call, unless no safe boundary follows.
PIECE_CHARS = 200_000
#: White space as the tokenizer has it: Unicode's, without U+001C to U+001F, which Python's \s holds too.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The tokenizer of a rank file, made once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts of a text at the first safe boundary after each `limit` characters."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(tokenizer, text: str | None, limit: int = PIECE_CHARS) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    return b"".join(tokenizer.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes() for p in pieces(text, limit))


def decode_ids(tokenizer, ids: bytes | None) -> bytes:
    if not ids:
        return b""
    return tokenizer.decode_bytes(memoryview(ids).cast("I").tolist())


def encoded(text: Column, path: str, pattern: str, limit: int = PIECE_CHARS) -> Column:
    """Ids as binary (four bytes each, little-endian)."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load(path, pattern)
        for batch in batches:
            yield pd.Series([encode_text(tokenizer, t, limit) for t in batch], dtype=object)

    return run(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes of ids that `encoded` gave; null or empty ids give no bytes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load(path, pattern)
        for batch in batches:
            yield pd.Series([decode_ids(tokenizer, x) for x in batch], dtype=object)

    return run(ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", limit: int = PIECE_CHARS) -> DataFrame:
    """Adds `ids` (binary) and `n_tokens` (long). One pass over the rows, no shuffle; rows, their other columns and
    repeats stay as they are. An empty table gives an empty table."""
    small_batches(docs.sparkSession)
    return docs.withColumn("ids", encoded(F.col(text), path, pattern, limit)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary), the bytes of `ids`."""
    return tokens.withColumn("decoded", decoded(F.col(ids), path, pattern))
