"""The recovering CSV reader."""

import random
import re

import pytest

from titleforge.sources.recovering_csv import BrokenQuote, Grammar, header_fields, parse_files, parse_lines

ONE = Grammar(ends_at_line=False)


@pytest.mark.parametrize(
    ("text", "fields"),
    [("a,Yes", ["a", "Yes"]), ('"a,b",No', ["a,b", "No"]), ('"a""b\nc",No', ['a"b\nc', "No"]), ("", [""]), (",", ["", ""]), ('"",x', ["", "x"]), ("a\nb,Yes", ["a\nb", "Yes"])],
)
def test_records(text, fields):
    assert ONE.record(text) == (fields, len(text))


@pytest.mark.parametrize(("text", "at"), [('"a,Yes', 0), ('"a"b,Yes', 3), ('a"b,Yes', 1), (' "a",Yes', 1), ('Yes,"a', 4), ('"a" ,No', 3)])
def test_broken_quotes_are_located(text, at):
    with pytest.raises(BrokenQuote) as e:
        ONE.record(text)
    assert e.value.at == at


def test_round_trip_of_random_records():
    rng = random.Random(1)
    for _ in range(300):
        fields = ["".join(rng.choice('ab",\n é') for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 4))]
        text = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
        assert ONE.record(text)[0] == fields


def test_header_without_mark():
    assert header_fields("﻿title,label") == ["title", "label"] and header_fields(None) == []


def test_lines(spark):
    lines = spark.createDataFrame(
        [(1, 1, "a,Yes"), (2, 1, '"a,Yes'), (3, 1, "a"), (4, 1, "NA,Yes"), (5, 1, "a,yes"), (6, 2, " No ,　b ,acct"), (7, 1, None), (8, 9, "a,Yes"), (9, 1, ""), (10, 1, "x" * 50_000 + ",No"), (1, 1, "a,Yes")],
        "row_id long, file_id int, raw string",
    ).selectExpr("*", "raw AS title", "1 AS label")  # columns whose names clash
    files = spark.createDataFrame([(1, "title,label"), (2, "﻿label,title,account")], "file_id int, header string")
    got = {(r.row_id, r.title and r.title[:5], r.label, r.account, r.reason) for r in parse_lines(lines, files).collect()}
    assert got == {
        (1, "a", "Yes", None, None), (2, None, None, None, "quoting"), (3, None, None, None, "columns"), (4, None, None, None, "value"), (5, None, None, None, "value"), (6, "b", "No", "acct", None),
        (7, None, None, None, "columns"), (8, None, None, None, "columns"), (9, None, None, None, "columns"), (10, "xxxxx", "No", None, None),
    }
    assert parse_lines(lines, files).count() == 11 and parse_lines(lines.limit(0), files).count() == 0


def test_files(spark):
    df = spark.createDataFrame([("f", '﻿title,label\na,Yes\n"b,No\nc,No\nd\n'), ("g", None), ("h", "")], "file_name string, text string")
    rows = sorted((r.line_no, r.title, r.reason) for r in parse_files(df).collect())
    assert rows == [(2, "a", None), (3, None, "quoting"), (4, "c", None), (5, None, "columns")]


def whole(texts: dict[str, str]) -> list[tuple]:
    """The same by one pass over each file, trying every line start anew: the meaning of the range-wise reader."""
    from titleforge.sources.recovering_csv import value_fault

    grammar, out = Grammar(ends_at_line=True), []
    for name, text in texts.items():
        lines = [x for x in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text.lstrip("﻿")) if x]
        names = header_fields(lines[0].strip()) if lines else []
        at = 1
        lost = False
        while at < len(lines):
            rest = "".join(lines[at:])
            try:
                values, end = grammar.record(rest)
                size, total = 0, 0
                while total < end:
                    total += len(lines[at + size])
                    size += 1
                fault = "columns" if len(values) != len(names) else value_fault(names, values)
            except BrokenQuote:
                values, size, fault = [], 1, "quoting"
            if lost and fault:
                at += 1
                continue
            lost = fault == "quoting"
            named = {} if fault else {k: v.strip() for k, v in zip(reversed(names), reversed(values))}
            out.append((name, at + 1, named.get("title"), named.get("label"), fault))
            at += size
    return sorted(out, key=str)


PARTS = ["a,Yes\n", '"b\nc",No\n', '"b,No\n', 'x"y,Yes\n', "only\n", "NA,Yes\n", '"p ""q""\r\nr",Yes\r\n', '","\n', '"\n', 'z,"No"\n', '"k\n\n\nl,m",No\n', "\n", 'e","f\n', "u,Yes,3\n"]


@pytest.mark.parametrize(("seed", "ranges", "most"), [(k, 1 + k * 5 % 13, [1 << 20, 0][k % 2]) for k in range(12)])
def test_ranges_read_as_one_pass_does(spark, monkeypatch, seed, ranges, most):
    from titleforge.sources import recovering_csv

    inner = recovering_csv.recover
    monkeypatch.setattr(recovering_csv, "recover", lambda *a, **k: inner(*a, **k, most_ahead=most))
    rng = random.Random(seed)
    texts = {f"f{k}": "title,label\n" + "".join(rng.choices(PARTS, k=rng.choice([0, 3, 30, 60]))) for k in range(4)} | {"g": '"never closed\n' + "a,Yes\n" * 30, "h": "", "i": "﻿label,title\rNo,last"}
    df = spark.createDataFrame([*texts.items(), ("none", None)], "file_name string, text string")
    got = sorted(((r.file_name, r.line_no, r.title, r.label, r.reason) for r in recovering_csv.parse_files(df, ranges=ranges).collect()), key=str)
    assert got == whole(texts)


def test_faults_are_located(spark):
    df = spark.createDataFrame([("f", 'title,label\n"a\nb,\n"c",No\nd,Yes\ne,"Yes\n')], "file_name string, text string")
    rows = sorted((r.line_no, r.reason, r.error_line, r.error_at) for r in parse_files(df, ranges=3).collect())
    assert rows == [(2, "quoting", 2, 1), (4, None, None, None), (5, None, None, None), (6, "quoting", 0, 2)]
    assert parse_files(df.limit(0)).count() == 0
