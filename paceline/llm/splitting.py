"""Splitting of oversized texts at natural boundaries (pointer doubling).

The encoding gives each token of an oversized text the level of the break before it. A table holds for
every boundary its farthest legal successor within reach; then the table of successors is squared:
after k rounds it jumps 2**k cuts, and the set of reached cuts, which starts at the first one, doubles
with each round, until every jump ends. Both run over the arrays of whole Arrow batches of texts, so
no token is ever a shuffled row.

Let n be the limit and o the overlap. A piece holds the tokens [c - o, next(c)) of a cut c, the first
piece begins at 0 (the virtual cut o), and next(c) is at most c + n - o. It is the end of the text if
within reach, else the farthest line or sentence end, else the farthest word start, else the farthest
token that starts a character, else (with steps shorter than a character) the farthest token.

Null, empty and small texts give no piece rows. Rows with equal key and text are split once. A piece
whose first token lies inside a character begins its text with the next whole character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm import bpe

# Marks that end a sentence when white space follows, and those that need none.
SENTENCE_END = r"[.!?…؟۔।॥։።]+[\"'”’»)\]]*$"
FULL_WIDTH_END = r"[。！？｡]+[」』”’）]*$"
LINE_END = r"[\n\r\x{2028}\x{2029}]"

END, NATURAL, WORD, CHARACTER, NONE = 4, 3, 2, 1, 0
CUT_NAMES = {END: "end", NATURAL: "sentence", WORD: "word", CHARACTER: "character"}


def _levels(all_words: Column, ids: Column, starts_char: Column) -> Column:
    """For each token of the text the level of the break before it."""

    def of_word(x: Column, i: Column) -> Column:
        before, here = F.get(all_words, i - 1), F.get(all_words, i)
        natural = F.regexp_like(before, F.lit(LINE_END)) & ~F.regexp_like(here, F.lit(f"^{LINE_END}"))
        natural |= F.regexp_like(before, F.lit(FULL_WIDTH_END)) | (F.regexp_like(before, F.lit(SENTENCE_END)) & F.regexp_like(here, F.lit(rf"^[{bpe.WHITE_SPACE}]")))
        first = F.when(natural, NATURAL).otherwise(WORD)
        return bpe.let(first, lambda f: F.transform(x, lambda t, j: F.when(j == 0, f).when(F.get(starts_char, t) == 1, CHARACTER).otherwise(NONE)))

    return F.flatten(F.transform(ids, of_word))


def successors(level: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """The farthest legal successor of each boundary. ``level`` holds the texts one after another, each with its
    end as a last entry; ``end`` is the place of that entry."""
    n = len(level)
    at = np.arange(n)
    size = -(-n // step) * step + step
    best = np.zeros(size, np.int64)
    best[:n] = np.where(level > NONE, level.astype(np.int64) * size + at, 0)
    best = best.reshape(-1, step)
    upto, onward = np.maximum.accumulate(best, 1).ravel(), np.maximum.accumulate(best[:, ::-1], 1)[:, ::-1].ravel()
    far = np.maximum(onward[at + 1], upto[at + step])
    return np.where(end - at <= step, end, np.where(far > 0, far % size, at + step))


def reached(succ: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The cuts on the way from ``first`` to ``last``, which are their own successors: by squaring the table."""
    on, jump = np.zeros(len(succ), bool), succ
    on[first] = True
    while (jump[first] != last).any():
        on[jump[on]] = True
        jump = jump[jump]
    on[jump[on]] = True
    on[last] = False
    return np.flatnonzero(on)


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 32, path: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """The pieces of every text above ``limit`` tokens: (key, piece_no from 1, start_token, n_tokens,
    cut, ids); ``cut`` tells at what the piece ends. See the module for the rule."""
    step = limit - overlap
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")
    starts = [int(not 0x80 <= (p[:1] or b" ")[0] < 0xC0) for p in bpe.load_vocab(path).pieces]
    rows = df.select(F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("_t")).where(F.octet_length("_t") > limit)
    coded = bpe.encode(rows, "_t", path, ids="_w", by_word=True).withColumn("ids", F.flatten("_w"))
    coded = bpe.where_encoded(coded, F.size("ids") > limit)
    flags = bpe.literal({"f": bpe.array(starts)})
    coded = coded.withColumn("_l", bpe.let(flags, lambda b: _levels(F.col("words"), F.col("_w"), b["f"])))
    coded = coded.select("_k", "_h", "ids", "_l").dropDuplicates(["_k", "_h"])
    names = pa.array([CUT_NAMES.get(i, "character") for i in range(END + 1)])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(b.column("ids").value_lengths(), np.int64)
            end = np.cumsum(n + 1) - 1
            first = end - n
            level = np.full(end[-1] + 1, END, np.int64)
            inner = np.ones(len(level), bool)
            inner[end] = False
            level[inner] = b.column("_l").flatten().to_numpy(zero_copy_only=False)
            succ = successors(level, np.repeat(end, n + 1), step)
            at = reached(succ, first + overlap, end)
            doc = np.searchsorted(end, at)
            number = np.arange(len(at)) - np.searchsorted(doc, doc) + 1
            begin, size = at - overlap, succ[at] - at + overlap
            offsets = np.concatenate([[0], np.cumsum(size)])
            flat = np.repeat(begin - doc - offsets[:-1], size) + np.arange(offsets[-1])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), b.column("ids").flatten().take(pa.array(flat)))
            columns = [b.column("_k").take(pa.array(doc)), *(pa.array(v.astype(np.int32)) for v in (number, begin - first[doc], size)), names.take(pa.array(level[succ[at]])), ids]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece_no", "start_token", "n_tokens", "cut", "ids"])

    return coded.mapInArrow(cuts, f"`{key}` {coded.schema['_k'].dataType.simpleString()}, piece_no int, start_token int, n_tokens int, cut string, ids array<int>")


def with_text(pieces: DataFrame, path: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """``pieces`` with the text of their ids in place of the ids."""
    whole = F.regexp_replace(bpe.joined(F.col("ids"), path), "^(?:[89AB][0-9A-F])+", "")
    return pieces.withColumn("text", F.decode(F.unhex(whole), "UTF-8")).drop("ids")
