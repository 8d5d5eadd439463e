"""Byte-level BPE as Spark column expressions (no Python on the rows).

The vocabulary is read from a public tokenizer file whose path is a parameter. Its merges become a
literal rank map: a row-displacement table in two flat arrays, so that one lookup of a pair is two
array reads. A word is folded with higher-order functions: the array of its byte tokens and the array
of its pair ranks are carried along, and every step replaces the leftmost pair of least rank (a whole
run of it when both halves are equal; all its places at once where there are ``BULK`` or more).

The literals are compact arrays without a text form, which the driver would hold with every plan.

A word is folded in segments: it is cut before a character when no token of the vocabulary holds the
end of the character before it and its first byte (``segment_pattern``), for no merge can cross that
place. So unbroken runs of most scripts fall into single characters.

Frequent words are folded once: ``frequent_words`` counts all distinct words of the corpus and their
segments, keeps the ``MAX_WORDS`` most frequent (a fixed bound) with their ids, and they become a
second literal table that is probed by hash inside the row. All others are folded where they stand. So
the encoding itself needs no shuffle; only the counts of distinct words are shuffled, after partial
aggregation.

Nulls and empty texts have the empty list of ids. Special-token strings are ordinary text.
"""

from __future__ import annotations

import functools
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCAB = os.environ.get("PACELINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")

#: Bound of the literal table of frequent words, and the longest word that it takes, in characters.
MAX_WORDS = 32_768
MAX_WORD_CHARS = 32

#: Slots of the literal table for each of its words: of two words in one slot the more frequent stays.
SLOTS = 8

#: From so many places of the least rank on, all are merged in one step.
BULK = 64

#: A rank above every token id: "this pair does not merge".
NO_MERGE = 1 << 30

#: Above every token id.
TOKEN_SPAN = 1 << 20

# The white space of the split pattern (the Unicode property White_Space).
WHITE_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# The split pattern of the tokenizer, white space spelt out because \s is ASCII in Java.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocab:
    """byte_ids[b]: id of byte b; offset, merges: the displacement table, where the pair (l, r) has
    l * 2**20 + its new id at merges[offset[l] + r]; pieces[i]: the bytes of token i."""

    byte_ids: list[int]
    offset: list[int]
    merges: list[int]
    pieces: list[bytes]


@functools.lru_cache(maxsize=4)
def load_vocab(path: str = DEFAULT_VOCAB) -> Vocab:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, letters = model["vocab"], _byte_letters()
    pieces = [b""] * (max(ids.values()) + 1)
    for word, i in ids.items():
        pieces[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
    rights: dict[int, list[tuple[int, int]]] = {}
    last = -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        new = ids[left + right]
        if new <= last:
            raise ValueError("the ids of the merges must ascend with their ranks")
        last = new
        rights.setdefault(ids[left], []).append((ids[right], new))
    if len(pieces) >= TOKEN_SPAN:
        raise ValueError(f"the vocabulary must have fewer than {TOKEN_SPAN} tokens")
    return Vocab([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], *_displace(rights, len(pieces)), pieces)


def _displace(rows: dict[int, list[tuple[int, int]]], n: int) -> tuple[list[int], list[int]]:
    """First-fit row displacement: entry (row, col) lies at offset[row] + col."""
    size = 16 * n + (1 << 16)
    free = np.ones(size, bool)
    offset = np.zeros(n, np.int64)
    merges = np.zeros(size, np.int64)
    top, first = 0, 0
    for row in sorted(rows, key=lambda r: (-len(rows[r]), r)):
        cols = np.array([c for c, _ in rows[row]])
        lo, width = max(0, first - int(cols.min())), 1 << 14
        while True:
            fits = np.ones(width, bool)
            for c in cols:
                fits &= free[lo + c : lo + c + width]
            if fits.any():
                break
            lo += width
        offset[row] = lo + int(fits.argmax())
        span = offset[row] + cols
        free[span] = False
        merges[span] = [row * TOKEN_SPAN + v for _, v in rows[row]]
        top = max(top, int(span.max()))
        while not free[first]:
            first += 1
    return offset.tolist(), merges[: top + 1].tolist()


def literal(columns: dict[str, pa.Array]) -> Column:
    """A struct literal of one-row columns. Its arrays are taken from a row in Spark's own compact layout: array
    functions of PySpark would box every number, and each plan would hold the numbers as text."""
    spark = SparkSession.active()
    one = spark.createDataFrame(pa.table(columns))._jdf
    row, types, jvm = one.queryExecution().executedPlan().executeCollect()[0], one.schema().fields(), spark._jvm
    make = lambda i: jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.getArray(i).copy(), types[i].dataType())
    return F.struct(*(Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(make(i))).alias(c) for i, c in enumerate(columns)))


def array(values, kind: pa.DataType = pa.int32()) -> pa.Array:
    """One array value from a list."""
    return pa.array([values], pa.list_(kind))


def tables(vocab: Vocab) -> Column:
    """The rank map as one literal; it is bound once in an expression, so that the plan holds it once."""
    return literal({"offset": array(vocab.offset), "merges": array(vocab.merges, pa.int64()), "bytes": array(vocab.byte_ids)})


@functools.lru_cache(maxsize=4)
def segment_pattern(path: str = DEFAULT_VOCAB) -> str:
    """The pattern of a segment: characters up to the next place that no token of the vocabulary crosses."""
    before: dict[int, set[str]] = {lead: set() for lead in range(0xC2, 0xF5)}
    open_ = set()  # lead bytes that follow the end of an unknown character in some token
    for piece in load_vocab(path).pieces:
        for i in range(1, len(piece)):
            if piece[i] in before and 0x80 <= piece[i - 1] < 0xC0:
                j = i - 1
                while j >= 0 and 0x80 <= piece[j] < 0xC0:
                    j -= 1
                try:
                    before[piece[i]].add(piece[max(j, 0) : i].decode())
                except UnicodeDecodeError:
                    open_.add(piece[i])
    spans: dict[frozenset, list[str]] = {}
    for lead, chars in before.items():
        more = 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
        low = (lead & (0x3F >> more)) << 6 * more
        span = rf"\x{{{max(low, (0, 0x80, 0x800, 0x10000)[more]):x}}}-\x{{{min(low + (1 << 6 * more) - 1, 0x10FFFF):x}}}"
        if lead not in open_:
            spans.setdefault(frozenset(chars), []).append(span)
    escape = lambda chars: "".join(rf"\x{{{ord(c):x}}}" for c in sorted(chars))
    cut = "|".join(rf"(?=[{''.join(s)}])(?<=[^\x00-\x7F{escape(chars)}])" for chars, s in spans.items())
    return rf"[\s\S](?:(?!{cut})[\s\S])*+" if cut else r"[\s\S]++"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text by the tokenizer's split pattern; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SPLIT_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _bytes(word: Column) -> Column:
    """The UTF-8 bytes of a word as integers, from its code points."""

    def of(ch: Column) -> Column:
        def utf8(c: Column) -> Column:
            low = lambda k: F.shiftright(c, k).bitwiseAND(F.lit(63)) + 128
            return (
                F.when(c < 0x80, F.array(c))
                .when(c < 0x800, F.array(F.shiftright(c, 6) + 192, low(0)))
                .when(c < 0x10000, F.array(F.shiftright(c, 12) + 224, low(6), low(0)))
                .otherwise(F.array(F.shiftright(c, 18) + 240, low(12), low(6), low(0)))
            )

        return let(F.ascii(ch), utf8)

    chars = F.split(word, "")
    return F.when(F.octet_length(word) == F.length(word), F.transform(chars, F.ascii)).otherwise(F.flatten(F.transform(chars, of)))


def fold(word: Column, table: Column) -> Column:
    """The token ids of one word: ranked merges folded over its bytes."""
    none = F.lit(NO_MERGE)

    def rank(left: Column, right: Column) -> Column:
        new = F.get(table["merges"], F.get(table["offset"], left) + right) - left.cast("long") * TOKEN_SPAN
        return let(new, lambda x: F.when((x > 0) & (x < TOKEN_SPAN), x.cast("int")).otherwise(none))

    def step(s: Column, _: Column) -> Column:
        t, r = s["t"], s["r"]

        def everywhere(m: Column) -> Column:
            taken = F.transform(t, lambda x, i: F.when(F.get(r, i) == m, m).when((i > 0) & (F.get(r, i - 1) == m), -1).otherwise(x))
            return let(F.filter(taken, lambda x: x >= 0), start)

        def merged(b: Column) -> Column:
            p, run = b["p"], b["run"]
            head, tail = F.slice(t, 1, p - 1), F.slice(t, p + 2 * run, F.size(t))
            new = F.array_repeat(b["m"], run)
            join = lambda x: F.coalesce(x, none)
            inner = F.array_repeat(rank(b["m"], b["m"]), run - 1)
            left = F.when(p > 1, F.array(join(rank(F.get(t, p - 2), b["m"])))).otherwise(F.array().cast("array<int>"))
            right = F.array(join(rank(b["m"], F.get(t, p - 1 + 2 * run))))
            return F.struct(
                F.concat(head, new, tail).alias("t"),
                F.concat(F.slice(r, 1, F.greatest(p - 2, F.lit(0))), left, inner, right, F.slice(r, p + 2 * run, F.size(r))).alias("r"),
            )

        def least(m: Column) -> Column:
            def at(p: Column) -> Column:
                equal = F.get(t, p - 1) == F.get(t, p)
                same = let(F.array_position(F.transform(F.slice(r, p, F.size(r)), lambda x: x == m), F.lit(False)).cast("int"), lambda i: F.when(i == 0, F.size(r) - p + 1).otherwise(i - 1))
                run = F.when(equal, F.floor((same + 1) / 2).cast("int")).otherwise(F.lit(1))
                one = let(F.struct(m.alias("m"), p.alias("p"), run.alias("run")), merged)
                many = (F.size(r) >= BULK) & ~equal
                return F.when(F.when(many, F.size(r) - F.size(F.array_remove(r, m)) >= BULK).otherwise(False), everywhere(m)).otherwise(one)

            return F.when(m == none, s).otherwise(let(F.array_position(r, m).cast("int"), at))

        return let(F.array_min(r), least)

    def start(t: Column) -> Column:
        return F.struct(t.alias("t"), F.transform(t, lambda x, i: rank(x, F.get(t, i + 1))).alias("r"))

    tokens = F.transform(_bytes(word), lambda b: F.get(table["bytes"], b))
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), let(tokens, start), step, lambda s: s["t"])


def segments(word: Column, path: str = DEFAULT_VOCAB) -> Column:
    return F.regexp_extract_all(word, F.lit(segment_pattern(path)), F.lit(0))


def frequent_words(df: DataFrame, text: str, path: str = DEFAULT_VOCAB, limit: int = MAX_WORDS) -> pa.Table:
    """(word, hash, ids): the most frequent words of the whole corpus, and segments by the number of the distinct
    words that have them, with their ids: at most ``limit`` rows come to the driver."""
    counted = df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").count()
    cut = F.when(F.octet_length("word") > F.length("word"), segments(F.col("word"), path)).otherwise(F.array().cast("array<string>"))
    whole = F.array(F.struct(F.col("word").alias("word"), F.col("count").alias("n")))
    parts = F.when(F.size("cut") > 1, F.transform("cut", lambda s: F.struct(s.alias("word"), F.lit(1).cast("long").alias("n"))))
    both = counted.withColumn("cut", cut).select(F.explode(F.concat(whole, F.coalesce(parts, F.slice(whole, 1, 0)))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.length("word") <= MAX_WORD_CHARS)).orderBy(F.desc("n"), "word").limit(limit)
    # as many tasks as slots: the folds of one task would take most of the time
    best = best.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return best.select("word", "n", F.xxhash64("word").alias("hash"), let(tables(load_vocab(path)), lambda t: fold(F.col("word"), t)).alias("ids")).toArrow()


def lexicon(found: pa.Table) -> Column:
    """The frequent words as one literal hash table: the word of slot h is names[h], its ids are ids[h]."""
    slots = SLOTS << max(0, found.num_rows - 1).bit_length()
    order = np.lexsort((found.column("hash").to_numpy(), -found.column("n").to_numpy()))
    at, first = np.unique(found.column("hash").to_numpy()[order] & (slots - 1), return_index=True)
    row = np.full(slots, -1, np.int64)
    row[at] = order[first]
    take = pa.array(row, mask=row < 0)
    names, ids = (found.column(c).combine_chunks().take(take) for c in ("word", "ids"))
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, slots], pa.int32()), a)
    return literal({"names": one(names), "ids": one(ids), "mask": array([slots - 1], pa.int64())})


def known(word: Column, lex: Column) -> Column:
    """The ids of a word of the lexicon; null for any other word."""
    return let(F.xxhash64(word).bitwiseAND(F.get(lex["mask"], F.lit(0))).cast("int"), lambda h: F.when(F.get(lex["names"], h) == word, F.get(lex["ids"], h)))


def encode(df: DataFrame, text: str = "text", path: str = DEFAULT_VOCAB, ids: str = "ids", by_word: bool = False) -> DataFrame:
    """``df`` with the token ids of column ``text`` in a new column (of its words, if ``by_word``: an
    array of arrays beside the column ``words``). Null and empty texts have an empty list."""
    found = frequent_words(df, text, path)

    def of(b: Column) -> Column:
        t, lex = b["t"], b["lex"]

        def rare(w: Column) -> Column:
            parts = F.flatten(F.transform(segments(w, path), lambda s: F.coalesce(known(s, lex), fold(s, t))))
            return F.when(F.octet_length(w) == F.length(w), fold(w, t)).otherwise(parts)

        every = F.transform(F.col("words") if by_word else words(F.col(text)), lambda w: F.coalesce(known(w, lex), rare(w)))
        return every if by_word else F.flatten(every)

    rows = df.withColumn("words", words(F.col(text))) if by_word else df
    return rows.withColumn(ids, let(F.struct(tables(load_vocab(path)).alias("t"), lexicon(found).alias("lex")), of))


def where_encoded(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` evaluated after the encoding. A plain filter on the ids would be pushed below
    their projection, and every text would be encoded a second time for it; row marks prevent that."""
    return df.withColumn("_mark", F.monotonically_increasing_id()).where(condition & (F.col("_mark") >= 0)).drop("_mark")


def joined(ids: Column, path: str = DEFAULT_VOCAB) -> Column:
    """The bytes of token ids, concatenated, as hexadecimal digits."""
    every = literal({"p": array(load_vocab(path).pieces, pa.binary())})
    return let(every, lambda t: F.array_join(F.transform(ids, lambda i: F.hex(F.get(t["p"], i))), ""))


def decode(ids: Column, path: str = DEFAULT_VOCAB) -> Column:
    """The text of token ids: their binary pieces, concatenated."""
    return F.decode(F.unhex(joined(ids, path)), "UTF-8")
