"""Raw sample lines: loaded rows and rejects with a reason, by structural indexing.

A record is ``sample_id TAB dimension_1,...,dimension_d,site``. Any field may stand in double quotes,
inside which commas, TABs and line breaks are text and ``""`` is one quote. Arrow batches of lines are
indexed as one byte buffer: the running parity of quotes tells which commas and TABs separate, these
and the record ends cut the fields, and counts and types are checked on whole arrays. No Python code
runs for a single line, and nothing is shuffled.

Each line gives one row. Its ``reason`` is null if it loads, else the first that holds of ``quoting``,
``columns`` and ``value``. A null or empty line fails with ``columns``. Repeated lines each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

QUOTE, COMMA, TAB = 0x22, 0x2C, 0x09

# The accepted spellings.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
IDENTIFIER = r"^[0-9]{1,18}$"

#: Longer numbers are parsed one by one, so that one long field does not widen a whole array.
SHORT = 40


def _buffer(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all lines and the offsets of the lines in them."""
    lines = pc.fill_null(lines.cast(pa.large_string()), "")
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an array of strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[index])))


def _doubles(texts: pa.Array, ok: np.ndarray) -> np.ndarray:
    """Numbers of the valid spellings; NaN elsewhere."""
    out = np.full(len(texts), np.nan)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    short, long = np.flatnonzero(ok & (size <= SHORT)), np.flatnonzero(ok & (size > SHORT))
    if len(short):
        out[short] = np.array(texts.take(pa.array(short)).to_pylist(), dtype=f"S{SHORT}").astype(np.float64)
    for i in long:
        out[i] = float(texts[int(i)].as_py())
    return out


def index_lines(lines: pa.Array, dimensions: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The reason of each line (0 none, 1 quoting, 2 columns, 3 value) and the columns of all lines."""
    raw, at = _buffer(lines)
    n, begin, end = len(at) - 1, at[:-1], at[1:]
    quote = raw == QUOTE
    count = np.concatenate([[0], np.cumsum(quote)])
    line = np.repeat(np.arange(n), end - begin)
    outside = (count[:-1] - count[begin][line]) % 2 == 0
    sep = np.flatnonzero(outside & ((raw == COMMA) | (raw == TAB)))

    # fields of all lines: every line starts one, every separator the next
    owner = np.concatenate([np.arange(n), line[sep]])
    start = np.concatenate([begin, sep + 1])
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    stop = np.concatenate([start[1:] - 1, [0]]) if len(start) else start
    final = np.concatenate([owner[1:] != owner[:-1], [True]]) if n else np.zeros(0, bool)
    stop[final] = end[owner[final]]

    quotes = count[stop] - count[start]
    opens = np.zeros(len(start), bool)
    full = stop > start
    opens[full] = quote[start[full]]
    closes = np.zeros(len(start), bool)
    closes[full] = quote[stop[full] - 1]
    broken = (quotes > 0) & ~(opens & closes & (quotes % 2 == 0))
    # quotes inside a field stand in adjacent pairs: the 2nd and 3rd, the 4th and 5th, ...
    where = np.flatnonzero(quote)
    field = np.searchsorted(start, where, side="right") - 1
    rank = count[where] - count[start[field]] if len(where) else where
    inner = (rank % 2 == 1) & (rank < quotes[field] - 1) if len(where) else np.zeros(0, bool)
    unpaired = np.flatnonzero(inner)
    unpaired = unpaired[where[np.minimum(unpaired + 1, len(where) - 1)] != where[unpaired] + 1]
    broken[field[unpaired]] = True

    reason = np.zeros(n, np.int8)
    reason[np.unique(owner[broken])] = 1
    tabs = np.bincount(line[sep[raw[sep] == TAB]], minlength=n)
    tab = np.full(n, -1, np.int64)
    tab[line[sep[raw[sep] == TAB]]] = sep[raw[sep] == TAB]
    commas = sep[raw[sep] == COMMA]
    after = np.bincount(line[commas[commas > tab[line[commas]]]], minlength=n)
    reason[(reason == 0) & ((tabs != 1) | (after != dimensions))] = 2

    rows = np.flatnonzero(reason == 0)
    behind = start > tab[owner]
    tail = np.flatnonzero(behind & (reason[owner] == 0))  # the fields after the TAB, d + 1 for each line
    s, e = (x[tail].reshape(len(rows), dimensions + 1) for x in (start, stop))

    def texts(s: np.ndarray, e: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        quoted = np.zeros(len(s), bool)
        some = e > s
        quoted[some] = quote[s[some]]
        return _gather(raw, s + quoted, e - quoted), quoted

    ids = pc.utf8_trim(texts(begin[rows], tab[rows])[0], " ")
    ok = pc.match_substring_regex(ids, IDENTIFIER).to_numpy(zero_copy_only=False)
    values = np.full((dimensions, n), np.nan)
    for j in range(dimensions):
        text = pc.utf8_trim(texts(s[:, j], e[:, j])[0], " ")
        values[j, rows] = _doubles(text, pc.match_substring_regex(text, NUMBER).to_numpy(zero_copy_only=False))
        ok &= np.isfinite(values[j, rows])
    reason[rows[~ok]] = 3
    site, quoted = texts(s[:, dimensions], e[:, dimensions])
    site = pc.if_else(pa.array(quoted), pc.replace_substring(site, '""', '"'), site)

    good = rows[ok]
    place = np.full(n, -1, np.int64)
    place[good] = np.flatnonzero(ok)
    at_row = pa.array(place, mask=place < 0)
    columns = {"sample_id": pc.cast(pc.if_else(pa.array(ok), ids, "0"), pa.int64()).take(at_row)}
    bad = reason > 0
    columns |= {f"dimension_{j + 1}": pa.array(values[j], mask=bad) for j in range(dimensions)}
    return reason, columns | {"site": site.cast(pa.string()).take(at_row)}


REASONS = pa.array([None, "quoting", "columns", "value"])


def parse_lines(df: DataFrame, key: str = "line_id", line: str = "line", dimensions: int = 12) -> DataFrame:
    """(key, reason, sample_id, dimension_1.., site): one row for each line of ``df``; the values are
    null where a reason stands."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, reason string, sample_id long, " + ", ".join(f"dimension_{j + 1} double" for j in range(dimensions)) + ", site string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reason, columns = index_lines(batch.column(1), dimensions)
            columns = {key: batch.column(0), "reason": REASONS.take(pa.array(reason)), **columns}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.select(key, line).mapInArrow(run, schema)


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def rejected(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    return parsed.where("reason is not null").select(key, "reason")
