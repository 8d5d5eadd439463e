import math
import random
import re

import pyarrow as pa

from paceline.sources.delimited import index_lines, loaded, parse_lines, rejected

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def by_hand(line):
    line = line or ""
    fields, seps, i = [], [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    text, j = text + '"', j + 1
                else:
                    text += line[j]
                j += 1
            i = j + 1
            if i < len(line) and line[i] not in ",\t":
                return "quoting"
        else:
            j = i
            while i < len(line) and line[i] not in ",\t":
                i += 1
            text = line[j:i]
            if '"' in text:
                return "quoting"
        fields.append(text)
        if i >= len(line):
            break
        seps.append(line[i])
        i += 1
    if seps.count("\t") != 1 or len(seps) - seps.index("\t") != 13:
        return "columns"
    values = [f.strip(" ") for f in fields[:-1]]
    if seps[0] != "\t" or not re.fullmatch("[0-9]{1,18}", values[0]):
        return "value"
    if not all(re.fullmatch(NUMBER, v) and math.isfinite(float(v)) for v in values[1:]):
        return "value"
    return (int(values[0]), *map(float, values[1:]), fields[-1])


def test_against_a_parser_by_hand():
    random.seed(3)
    base = "1\t" + ",".join(["1.5"] * 12) + ",x"

    def changed():
        s = list(base)
        for _ in range(random.randint(1, 3)):
            i = random.randrange(len(s))
            s[i : i + random.randint(0, 1)] = random.choice(['"', '""', "e5", " ", "+", ".", "\n", "é", '"1"', ",", "e999", "", "\t"])
        return "".join(s)

    lines = [None, "", base, '"', "\t", base.replace("x", '"a,""b""\t\n"'), base.replace("1.5", "0" * 300 + "1.5")] + [changed() for _ in range(3000)]
    reasons, columns = index_lines(pa.array(lines, pa.string()), 12)
    values = list(zip(*[c.to_pylist() for c in columns.values()]))
    for line, reason, got in zip(lines, reasons, values):
        want = by_hand(line)
        if isinstance(want, str):
            assert [None, "quoting", "columns", "value"][reason] == want and set(got) == {None}
        else:
            assert reason == 0 and got == want


def test_tables(spark):
    df = spark.createDataFrame([(1, "7\t" + "1," * 12 + "s", 5), (1, "7\t" + "1," * 12 + "s", 5), (None, "x", 6)], "line_id long, line string, reason int")
    parsed = parse_lines(df)
    assert loaded(parsed).count() == 2 and [tuple(r) for r in rejected(parsed).collect()] == [(None, "columns")]
    assert parse_lines(df.limit(0)).count() == 0
