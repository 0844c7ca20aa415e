"""Language identification with a linear-chain conditional random field over words.

Every word (run of letters) gets a label; its evidence is the sum of weights of its character n-grams with word
borders (so affixes too) and of the word itself (lexicon), all hashed into one table. Learned transitions tie
neighbouring words, and forward-backward gives each word's distribution over languages, so a text that switches
language is labelled word by word. A document's language is the one with the largest share of its words; the share
is the score.

Training reads a bounded sample: at most TRAIN_ROWS rows of each language by a hash of the id (fewer where there are so
many languages that TRAIN_TOTAL rows are not enough), TRAIN_CHARS characters of each, in TRAIN_PIECES pieces from all
over the text. It starts from the row's language for each word, then relabels words by forward-backward (rows hold
foreign passages), and fits weights and transitions by the gradient of the conditional likelihood. Every language with a
labelled row is learned.

A null text, or one without letters, is `und` with score 0. With no labelled rows all texts are `und`. Texts are read
whole: short ones side by side, a long one in pieces that hand the forward and the backward vector on, so memory is
bounded by the piece (smaller for many languages), whatever the text's length. Repeated rows and other columns stay as
they are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, spare, unit_hash

#: Bounds on the training sample: rows of each language, rows in all (but 10 of each language), characters of each row,
#: and the pieces that these come from.
TRAIN_ROWS = 300
TRAIN_TOTAL = 6_000
TRAIN_CHARS = 2_000
TRAIN_PIECES = 4
SLOTS = 1 << 17
ORDERS = (2, 3, 4)
PIECE_CHARS = 1 << 18
BLOCK = 64
ROUNDS = (15, 15)
RATE = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (SLOTS + 1, languages); the last row is zero
    change: np.ndarray  # transitions, log scale
    first: np.ndarray  # of the first word, log scale


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower case (if that is one code point)."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
    return letter, lower


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def features(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, starts): slots of the features at each position (one row an order and one for the word), and where
    each word's positions start. Positions run over the letters of a word and the border before it."""
    letter, lower = tables()
    is_letter = letter[code]
    before = np.concatenate(([False], is_letter[:-1]))
    opens = is_letter & ~before
    n = int(opens.sum())
    if not n:
        return np.zeros((len(ORDERS) + 1, 0), np.int32), np.zeros(0, np.int64)
    kept = np.flatnonzero(is_letter)
    word = np.cumsum(opens)[kept] - 1
    place = np.arange(len(kept)) + word + 1
    line = np.full(len(kept) + n + 1, 1, np.uint64)
    line[place] = lower[code[kept]]
    border = np.ones(len(line), bool)
    border[place] = False
    starts = np.flatnonzero(border)[:-1]
    size = len(line) - 1
    padded = np.concatenate((line, np.ones(max(ORDERS), np.uint64)))
    edge = np.concatenate((border, np.ones(max(ORDERS), bool)))
    out = np.full((len(ORDERS) + 1, size), SLOTS, np.int32)
    key, ok = padded[:size].copy(), np.ones(size, bool)
    for k in range(1, max(ORDERS)):
        if k > 1:
            ok &= ~edge[k - 1 : k - 1 + size]
        key = key * np.uint64(0x100000001B3) + padded[k : k + size]
        if k + 1 in ORDERS:
            mixed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
            out[ORDERS.index(k + 1)] = np.where(ok, mixed.astype(np.int32), SLOTS)
    offset = np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))
    powers = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
    whole = np.add.reduceat(line[:size] * powers[offset % 64], starts)
    out[-1, starts] = ((whole * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 17)).astype(np.int32)
    return out, starts


def evidence(weights: np.ndarray, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Summed weights of each word."""
    if not len(starts):
        return np.zeros((0, weights.shape[1]), weights.dtype)
    total = np.add.reduceat(weights[slots[0]], starts, axis=0)
    for row in slots[1:-1]:
        total += np.add.reduceat(weights[row], starts, axis=0)
    return total + weights[slots[-1, starts]]


def softened(rows: np.ndarray) -> np.ndarray:
    return np.exp(rows - rows.max(axis=-1, keepdims=True))


def opening(change: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The vector before a text, which the first transition turns into `first`."""
    return np.linalg.lstsq(np.exp(change).T, np.exp(first), rcond=None)[0]


def marginals(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray, first: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Each word's distribution over labels, for sequences of the given lengths laid end to end. Sequences are cut
    into blocks; a block's transfer matrix tells what it does to any start, so all blocks run side by side. With
    `before` and `after` (the vectors on both sides of one sequence, a piece of a text), also the forward vector at its
    end and the backward vector at its start."""
    k = scores.shape[1]
    lengths = lengths[lengths > 0]
    n_blocks = -(-lengths // BLOCK)
    seq = np.repeat(np.arange(len(lengths)), n_blocks)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, n_blocks) + nth * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, n_blocks) - nth * BLOCK)
    at = begin[:, None] + np.minimum(np.arange(BLOCK), size[:, None] - 1)
    inside = np.arange(BLOCK) < size[:, None]
    emit = softened(scores.astype(np.float64))[at]
    move = np.exp(change)
    total = len(seq)

    def step(vector: np.ndarray, t: int) -> np.ndarray:
        new = (vector @ move) * emit[:, t][(slice(None),) + (None,) * (vector.ndim - 2)]
        new /= new.sum(axis=tuple(range(1, new.ndim)), keepdims=True)
        return np.where(inside[:, t].reshape((-1,) + (1,) * (vector.ndim - 1)), new, vector)

    transfer = np.repeat(np.eye(k)[None], total, axis=0)
    for t in range(BLOCK):
        transfer = step(transfer, t)
    left, right = np.empty((total, k)), np.empty((total, k))
    deepest = int(n_blocks.max()) if total else 0
    heads = np.cumsum(n_blocks) - n_blocks
    vector = np.repeat((opening(change, first) if before is None else before)[None], len(lengths), axis=0)
    for b in range(deepest):
        on = np.flatnonzero(n_blocks > b)
        here = heads[on] + b
        left[here] = vector[on]
        new = np.einsum("bi,bij->bj", vector[on], transfer[here])
        vector[on] = new / np.abs(new).sum(axis=1, keepdims=True)
    vector = np.repeat((np.ones(k) if after is None else after)[None], len(lengths), axis=0)
    for b in range(deepest - 1, -1, -1):
        on = np.flatnonzero(n_blocks > b)
        here = heads[on] + b
        right[here] = vector[on]
        new = np.einsum("bij,bj->bi", transfer[here], vector[on])
        vector[on] = new / np.abs(new).sum(axis=1, keepdims=True)
    ahead = np.empty((total, BLOCK, k))
    vector = left
    for t in range(BLOCK):
        vector = step(vector, t)
        ahead[:, t] = vector
    out = np.empty((total, BLOCK, k))
    behind = right
    both = np.zeros((k, k)) if pairs else None
    for t in range(BLOCK - 1, -1, -1):
        live = inside[:, t][:, None]
        out[:, t] = ahead[:, t] * behind
        seen = emit[:, t] * behind
        if pairs and t:
            joint = ahead[:, t - 1][:, :, None] * move * seen[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            both += (joint * live[:, :, None]).sum(axis=0)
        back = seen @ move.T
        behind = np.where(live, back / np.abs(back).sum(axis=1, keepdims=True), behind)
    flat = np.maximum(out[inside], 0)
    flat /= flat.sum(axis=1, keepdims=True)
    if before is not None:
        return flat, ahead[-1, size[-1] - 1], behind[0]
    return (flat, both) if pairs else flat


def fit(texts: list[str], labels: list[str]) -> Model:
    """Weights and transitions from rows of text with a language each."""
    langs = sorted(set(labels))
    k = len(langs)
    found = [features(codes(t)) for t in texts]
    rows = [i for i, (_, s) in enumerate(found) if len(s)]
    if not rows or k < 2:
        return Model(langs, np.zeros((SLOTS + 1, max(k, 1)), np.float32), np.zeros((max(k, 1),) * 2), np.zeros(max(k, 1)))
    shift = np.cumsum([0] + [found[i][0].shape[1] for i in rows])
    slots = np.concatenate([found[i][0] for i in rows], axis=1)
    starts = np.concatenate([found[i][1] + shift[j] for j, i in enumerate(rows)])
    lengths = np.array([len(found[i][1]) for i in rows])
    target = np.repeat([langs.index(labels[i]) for i in rows], lengths)
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, slots.shape[1])))
    weights, squares = np.zeros((SLOTS + 1, k), np.float32), np.full((SLOTS + 1, k), 1e-3)
    stay = np.log(np.where(np.eye(k, dtype=bool), 0.95, 0.05 / max(1, k - 1)))
    change, first = stay.copy(), np.full(k, -np.log(k))
    inner = np.ones(len(starts), bool)
    inner[np.cumsum(lengths) - lengths] = False
    where = np.flatnonzero(inner)
    for turn, rounds in enumerate(ROUNDS):
        if turn:
            target = marginals(evidence(weights, slots, starts), lengths, change, first).argmax(axis=1)
            seen = np.full((k, k), 0.5)
            np.add.at(seen, (target[where - 1], target[where]), 1)
            change = np.log(seen / seen.sum(axis=1, keepdims=True))
        goal = np.eye(k)[target]
        for _ in range(rounds):
            scores = evidence(weights, slots, starts)
            if turn:
                guess, both = marginals(scores, lengths, change, first, pairs=True)
            else:
                guess = softened(scores)
                guess /= guess.sum(axis=1, keepdims=True)
            error = goal - guess
            for j in range(k):
                each = error[word, j]
                slope = sum(np.bincount(row, each, SLOTS + 1) for row in slots) / len(starts) - 1e-7 * weights[:, j]
                squares[:, j] += (slope * 1e3) ** 2
                weights[:, j] += RATE * slope * 1e3 / np.sqrt(squares[:, j])
            weights[SLOTS] = 0
            if turn:
                # both holds the pairs within blocks; compare with the same pairs of the labels
                blocks = np.concatenate([np.arange(n) % BLOCK for n in lengths])
                mine = np.flatnonzero(blocks)
                seen = np.zeros((k, k))
                np.add.at(seen, (target[mine - 1], target[mine]), 1)
                change += RATE * (seen - both) / np.maximum(50, both.sum(axis=1, keepdims=True))
                change -= np.log(np.exp(change).sum(axis=1, keepdims=True))
    return Model(langs, weights.astype(np.float32), change, first)


def word_ends(code: np.ndarray, chars: int) -> Iterator[np.ndarray]:
    """Pieces of a text of about `chars` characters that end outside of words."""
    letter, start = tables()[0], 0
    while start < len(code):
        end = min(len(code), start + chars)
        while end < len(code) and letter[code[end]] and letter[code[end - 1]]:
            end += 1
        yield code[start:end]
        start = end


def piece_chars(k: int) -> int:
    """Characters in a piece: for k languages, the transfer matrices of its blocks take 64 MB at most."""
    return max(1 << 12, min(PIECE_CHARS, (3 << 30) // (k * k)))


def long_text(model: Model, text: str) -> np.ndarray | None:
    """The mean distribution of a text's words, piece by piece: forward vectors are kept at the ends of pieces, then the
    pieces are gone through backwards."""
    parts = list(word_ends(codes(text), piece_chars(len(model.langs))))
    vector = opening(model.change, model.first)
    lefts = []
    for i in range(len(parts)):
        lefts.append(vector)
        found = evidence(model.weights, *features(parts[i]))
        if len(found):
            vector = marginals(found, np.array([len(found)]), model.change, model.first, before=vector, after=np.ones(len(vector)))[1]
    total, n, vector = np.zeros(len(vector)), 0, np.ones(len(vector))
    for left, part in zip(lefts[::-1], parts[::-1]):
        found = evidence(model.weights, *features(part))
        if len(found):
            each, _, vector = marginals(found, np.array([len(found)]), model.change, model.first, before=left, after=vector)
            total, n = total + each.sum(axis=0), n + len(each)
    return total / n if n else None


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return names, scores
    most = piece_chars(len(model.langs))
    group, chars = [], 0

    def give(i: int, mean: np.ndarray) -> None:
        names[i], scores[i] = model.langs[int(mean.argmax())], float(min(1.0, mean.max()))

    def flush() -> None:
        nonlocal group, chars
        if group:
            found = evidence(model.weights, *features(codes("\n".join(texts[i] for i in group))))
            lengths = np.array([n_words(texts[i]) for i in group])
            if lengths.sum():
                each = marginals(found, lengths, model.change, model.first)
                filled = np.flatnonzero(lengths)
                ends = np.cumsum(lengths[filled])
                means = np.add.reduceat(each, ends - lengths[filled], axis=0) / lengths[filled][:, None]
                for j, m in zip(filled, means):
                    give(group[j], m)
        group, chars = [], 0

    for i, text in enumerate(texts):
        if text and len(text) > most:
            mean = long_text(model, text)
            if mean is not None:
                give(i, mean)
        elif text:
            if chars + len(text) > most:
                flush()
            group.append(i)
            chars += len(text)
    flush()
    return names, scores


def n_words(text: str) -> int:
    is_letter = tables()[0][codes(text)]
    return int((is_letter & ~np.concatenate(([False], is_letter[:-1]))).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample_of(text: Column, chars: int, pieces: int = TRAIN_PIECES) -> Column:
    """A text of up to `chars` characters; of a longer one, as many in pieces spread evenly from its start to its end."""
    each = chars // pieces
    gap = (F.length(text) - each) / max(1, pieces - 1)
    cut = F.concat_ws("\n", *[text.substr((F.lit(1) + F.floor(gap * i)).cast("int"), F.lit(each)) for i in range(pieces)])
    return F.when(F.length(text) <= chars, text).otherwise(cut)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on the labelled documents that are not held out; only the bounded sample reaches the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().collect()
    rows = max(min(10, rows), min(rows, TRAIN_TOTAL // max(1, len(counts))))
    u = unit_hash(F.lit("langid"), F.col("doc_id"))
    few = [r["lang"] for r in counts if r["count"] <= 2 * rows]
    wanted = F.col("lang").isin(few)
    for r in counts:
        if r["count"] > 2 * rows:
            wanted = wanted | ((F.col("lang") == r["lang"]) & (u < 2 * rows / r["count"]))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "id"))
    best = known.where(wanted).select("lang", sample_of(F.col("text"), chars).alias("text"), u.alias("u"), F.col("doc_id").alias("id"))
    found = best.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("lang", "nth").collect()
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score. One pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = predict(shared.value, batch.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = spare(docs.columns, "_found")
    return docs.withColumn(found, run(F.col(text))).withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(found)
