"""Exact deduplication with composable polynomial fingerprints.

Texts are equal if they are identical without their white space. A fingerprint is the number of bytes and two
polynomials of the bytes, modulo two primes below 2**31. Pieces are hashed apart and combine by length-shifted
arithmetic, H(ab) = H(a) * B**len(b) + H(b); so a huge text is cut into chunks that are hashed in as many tasks,
and its chunks' hashes, each shifted by the length that follows it, add up by a plain sum.

Rows with equal fingerprints are then compared, chunk by chunk, with the first text of their group: a join on
(fingerprint, chunk number) streams the chunks of all members past those of that one text, so that no task holds a
group or a whole text. A text that differs from the first one (a collision) goes by its SHA-256 instead.

Of equal texts the row with the most code points in the original, then the smallest doc_id, stays (null ids last);
if that row is repeated, one of the repeats. Null counts as empty, and empty texts are equal. Repeated rows are
counted together and given back one by one. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import left_out, may_meet, text_or_empty, without_spaces, written

PRIMES = (2147483647, 2147483629)
BASE = 1000003
#: Bytes in a chunk, and from how many on a text's chunks go to different tasks.
CHUNK = 1 << 16
HUGE = 1 << 22
#: Rows of a group that are compared in one task; the first text is sent to as many tasks as the group needs.
COMPARED = 256


def power(base: int, n: int, prime: int) -> int:
    return pow(base, int(n), prime)


_powers: dict[int, np.ndarray] = {}


def powers(prime: int) -> np.ndarray:
    """B**(CHUNK-1), ..., B, 1: the factors of a chunk's bytes."""
    if prime not in _powers:
        out, x = np.empty(CHUNK, np.uint64), 1
        for i in range(CHUNK - 1, -1, -1):
            out[i], x = x, x * BASE % prime
        _powers[prime] = out
    return _powers[prime]


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """The two polynomials of up to CHUNK bytes. A product stays below 2**39, their sum below 2**55."""
    values = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return tuple(int(values @ powers(p)[CHUNK - len(values) :]) % p for p in PRIMES)


def combine(pieces: Iterator[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """The fingerprint of a text from (hash, length) of its pieces in order."""
    total = [0, 0]
    for found, length in pieces:
        total = [(t * power(BASE, length, p) + h) % p for t, h, p in zip(total, found, PRIMES)]
    return tuple(total)


def text_hash(data: bytes) -> tuple[int, int]:
    return combine((chunk_hash(data[i : i + CHUNK]), len(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK))


HASHES = "struct<h1: long, h2: long>"


def whole_hashes(data: Column) -> Column:
    """Hashes of whole texts."""

    @F.pandas_udf(HASHES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([text_hash(b) for b in batch], columns=["h1", "h2"], dtype="int64")

    return run(data)


def shifted_hashes(chunk: Column, after: Column) -> Column:
    """Hashes of chunks, each shifted by the length that follows it in its text."""

    @F.pandas_udf(HASHES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pieces, lengths in batches:
            rows = [[h * power(BASE, n, p) % p for h, p in zip(chunk_hash(c), PRIMES)] for c, n in zip(pieces, lengths)]
            yield pd.DataFrame(rows, columns=["h1", "h2"], dtype="int64")

    return run(chunk, after)


def chunks(data: Column, n_bytes: Column) -> Column:
    """Array of (number, chunk) of binary data; an empty text has no chunk."""
    n = F.ceil(n_bytes / F.lit(CHUNK)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("number"), F.substring(data, i * CHUNK + 1, F.lit(CHUNK)).alias("chunk")))


KEY = ["doc_id", "n_chars", "n_bytes", "sha"]
PRINT = ["h1", "h2", "n_bytes"]


def keyed(docs: DataFrame) -> DataFrame:
    """The key of a row's text, and its bytes without white space."""
    plain = without_spaces(F.col("text")).cast("binary")
    return docs.select("doc_id", F.length(text_or_empty(F.col("text"))).cast("long").alias("n_chars"), plain.alias("data")).select("doc_id", "n_chars", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"), "data")


def fingerprinted(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """KEY columns, h1, h2 and `copies` for each distinct (doc_id, text)."""
    rows = keyed(docs)
    small = rows.where(F.col("n_bytes") < huge).withColumn("h", whole_hashes(F.col("data"))).select(*KEY, "h.h1", "h.h2")
    small = small.groupBy(*KEY, "h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    cut = rows.where(F.col("n_bytes") >= huge).select(*KEY, F.inline(chunks(F.col("data"), F.col("n_bytes"))))
    dealt = cut.repartition("sha", "number")
    after = F.col("n_bytes") - F.col("number") * CHUNK - F.octet_length("chunk")
    hashed = dealt.withColumn("h", shifted_hashes(F.col("chunk"), after)).groupBy(*KEY, "number").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("copies"))
    sums = [F.pmod(F.sum(F.col(f"h.h{i + 1}")), F.lit(p)).alias(f"h{i + 1}") for i, p in enumerate(PRIMES)]
    return small.unionByName(hashed.groupBy(*KEY).agg(*sums, F.max("copies").alias("copies")))


def differing(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, sha) of rows whose text differs from the first text of their group. `groups` (a written table): one row for
    each distinct (doc_id, text) of groups of two or more of these, with PRINT, KEY, `leads` (true for the first one) and
    `salts`. Only texts whose id may be one of a group's are moved."""
    rows = keyed(may_meet(docs, F.col("doc_id"), groups, F.col("doc_id"))[1])
    wanted = groups.select(*[F.col(c).alias(f"_{c}") for c in KEY], "h1", "h2", "leads", "salts")
    same = F.lit(True)
    for c in KEY:
        same = same & rows[c].eqNullSafe(F.col(f"_{c}"))
    cut = rows.join(wanted, same).select("doc_id", "sha", "n_bytes", "h1", "h2", "leads", "salts", F.inline(chunks(F.col("data"), F.col("n_bytes"))))
    place = [*PRINT, "number", "salt"]
    first = cut.where("leads").dropDuplicates([*PRINT, "number"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in [*place, "chunk"]])
    others = cut.where(~F.col("leads")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), F.col("salts")))
    on = F.lit(True)
    for c in place:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return others.join(first, on & (F.col("chunk") != F.col("_chunk"))).select("doc_id", "sha").distinct()


def classes(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """One row for each distinct (doc_id, text): KEY, copies, keep_id, group_size, and `wins` (of its class)."""
    prints = written(fingerprinted(docs, huge), "fingerprints")
    leads = prints.groupBy(*PRINT).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n_chars", "sha")).alias("lead"), F.sum("copies").alias("n"), F.count(F.lit(1)).alias("n_keys"))
    many = leads.where("n_keys > 1").select(*[F.col(c).alias(f"_{c}") for c in PRINT], "lead", "n_keys")
    on = F.lit(True)
    for c in PRINT:
        on = on & (F.col(c) == F.col(f"_{c}"))
    is_lead = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("n_chars") == F.col("lead.n_chars")) & (F.col("sha") == F.col("lead.sha"))
    groups = written(prints.join(many, on).select(*KEY, "h1", "h2", is_lead.alias("leads"), F.ceil(F.col("n_keys") / COMPARED).cast("long").alias("salts")), "groups")
    odd = written(differing(docs, groups), "differing").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.lit(True).alias("odd"))
    tagged = prints.join(odd, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    tagged = tagged.select(*KEY, "h1", "h2", "copies", F.when(F.col("odd"), F.col("sha")).otherwise("").alias("other"))
    best = tagged.groupBy(*PRINT, "other").agg(F.min(F.struct((-F.col("n_chars")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))).alias("best"), F.sum("copies").alias("group_size"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in [*PRINT, "other"]], "best", "group_size")
    joined = tagged.join(best, on & (F.col("other") == F.col("_other")))
    wins = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.minus"))
    return joined.select(*KEY, "copies", F.col("best.doc_id").alias("keep_id"), "group_size", wins.alias("wins"))


def exact_groups(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    each = classes(docs, huge).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """The rows that stay, with the columns of `docs`. Rows that go are known by doc_id, length and SHA-256 of the text;
    of a winner that is repeated one row stays. Only rows whose id may be that of such a row are shuffled."""
    each = classes(docs, huge).where("not wins or copies > 1")
    touched = written(each.select(F.col("doc_id").alias("id"), F.concat_ws(":", "n_chars", "sha").alias("key"), F.col("wins").alias("stays")), "touched")
    plain = F.sha2(without_spaces(F.col("text")).cast("binary"), 256)
    return left_out(docs, F.concat_ws(":", F.length(text_or_empty(F.col("text"))), plain), touched)
