import csv
import re

import pytest

from lodeworks.operators import bad_rows as B

NUM = re.compile(r"\s*[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?\s*")
WHOLE = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', re.S)


def brute(lines):
    out = set()
    for key, no, line in lines:
        if no == 1:
            continue
        line = line or ""
        if not WHOLE.fullmatch(line):
            out.add((key, "quoting"))
            continue
        cells = next(csv.reader([line.replace("\n", "\x03").replace("\r", "\x04")]), [""])
        if len(cells) != 13:
            out.add((key, "column_count"))
            continue
        v, c = cells[7], cells[11]
        if v.strip() and not NUM.fullmatch(v):
            out.add((key, "bad_value"))
        if c.strip() and not (NUM.fullmatch(c) and 0 <= float(c.replace(",", ".")) <= 1):
            out.add((key, "bad_confidence"))
    return out


def row(value="1", confidence="0.5", **more):
    cells = ["x"] * 13
    cells[7], cells[11] = value, confidence
    return ",".join(cells)


LINES = [
    row(), row("abc"), row("1e5", "1.5"), row('"1,5"', '"0,5"'), row("NaN", "nan"), row(" 2 ", " "), row("1_0"), row("1.2.3", "-0.1"), row("", ""), row() + ",extra", "a,b", "", '"', '""', 'a"b' + "," * 12,
    '"x' + "," * 12, '"x"y' + "," * 12, '"a""b"' + "," * 12, '"a,b\nc"' + "," * 12, '"",' * 12 + '""', "," * 12, "\x01,\x02" + "," * 11, '"\x01,"' + "," * 12, "x" * 50_000 + "," * 12, '""""' * 3000 + "," * 12, None,
]


def test_lines_against_the_csv_module(spark):
    rows = [(0, 1, "header")] + [(i + 1, i + 2, line) for i, line in enumerate(LINES)]
    df = spark.createDataFrame(rows, "line_id bigint, line_no int, line string")
    got = [(r.row_id, r.reason) for r in B.line_faults(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_cells_are_those_of_the_csv_module(spark):
    df = spark.createDataFrame([(i, 2, x) for i, x in enumerate(LINES)], "line_id bigint, line_no int, line string")
    for r in B.parsed_lines(df).collect():
        if r.cells is not None and LINES[r.line_id]:
            want = next(csv.reader([LINES[r.line_id].replace("\n", "\x03")]))
            assert r.cells == [w.replace("\x03", "\n") for w in want], r.line_id


def test_rows_and_clean_rows(spark):
    data = [(1, "5", "0.5"), (2, "x", "2"), (3, None, None), (4, "1,5", "1"), (5, " ", "0%"), (5, " ", "0%")]
    df = spark.createDataFrame([(*d, "extra", "clash") for d in data], "row_id bigint, value string, confidence string, reason string, origin string")
    faults = sorted((r.row_id, r.reason) for r in B.row_faults(df).collect())
    assert faults == [(2, "bad_confidence"), (2, "bad_value"), (5, "bad_confidence"), (5, "bad_confidence")]
    assert sorted((r.row_id, r.value, r.confidence) for r in B.clean_rows(df).collect()) == [(1, 5.0, 0.5), (3, None, None), (4, 1.5, 1.0)]
    assert B.row_faults(df.limit(0)).count() == 0 and B.clean_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("1,5", 1.5), (" +2e-3 ", 0.002), ("1_0", None), (".5", None), ("5.", None), ("", None), (None, None), ("١", None)])
def test_number_rule(spark, text, want):
    from pyspark.sql import functions as F

    from lodeworks.functions.numbers import parse_number, to_number

    assert parse_number(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t"))).first()[0] == want
