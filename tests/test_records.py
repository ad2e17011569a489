"""Records with line breaks in quoted cells: the same at any split size, against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from strom.sources import feeds
from strom.sources.records import read_records

SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture(params=[None, 100, 1000])
def split(spark, request):
    yield from _split_at(spark, request.param)


@pytest.fixture
def tiny_split(spark):
    yield from _split_at(spark, 7)


def _split_at(spark, size):
    if size:
        for key, value in zip(SETTINGS, (size, 1, 1)):
            spark.conf.set(key, str(value))
    yield size
    for key in SETTINGS:
        spark.conf.unset(key)


def cells(records, width):
    parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), {"sep": ";", "quote": '"', "escape": '"'})
    return [tuple(c or "" for c in r.c) for r in records.select("_file", "_at", parsed.alias("c")).orderBy("_file", "_at").collect()]


def test_records_at_any_split_size(spark, split, tmp_path):
    draw = random.Random(5)
    made = ("", "x", "a\nb", "\n\n", 'say "hi"', "semi;colon", '"', "Straße\n\"q\";\n", "long " * 20, "plain", 'in 5"', ";")
    want = []
    for name, rows in (("a.csv", 30), ("b.csv", 3), ("c.csv", 0)):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=";", lineterminator="\n")
        for _ in range(rows):
            want.append(row := tuple(["k"] + draw.choices(made, k=3)))
            writer.writerow(row)
        (tmp_path / name).write_bytes(out.getvalue().encode())
    records = read_records(spark, str(tmp_path))
    assert cells(records, 4) == want


def test_odd_quotes_and_line_ends(spark, tiny_split, tmp_path):
    """Quotes within unquoted cells and behind closing ones are plain characters; a cell never closed runs to the end of its file."""
    text = 'a;5" pipe;c\r\n"x"y;"p\r\nq";z\r\n\r\n;;""\r\nb;"";"""\n"""\r\n"never;closed\nto the\nend'
    (tmp_path / "odd.csv").write_bytes(text.encode())
    found = [r.record for r in read_records(spark, str(tmp_path)).orderBy("_at").collect()]
    assert found == ['a;5" pipe;c', '"x"y;"p\r\nq";z', "", ';;""', 'b;"";"""\n"""', '"never;closed\nto the\nend']


def test_long_cell_of_quotes(spark, tmp_path):
    (tmp_path / "long.csv").write_text('a;"' + '""' * 100_000 + '\n";b\n' + "c;" * 5_000 + "\n")
    found = [len(r.record) for r in read_records(spark, str(tmp_path)).orderBy("_at").collect()]
    assert found == [200_007, 10_000]


def test_register_at_any_split_size(spark, split, tmp_path):
    columns = list(feeds.REGISTER_COLUMNS)
    lines = ["﻿Register", "Letzte Aktualisierung vom: 01.09.2026", "Hinweis;;", ";".join(columns)]
    for i in range(20):
        cell = dict.fromkeys(columns, "") | {"Ladeeinrichtungs-ID": f"ID{i}", "Betreiber": f'"Werk {i}\nGmbH; ""Co"""', "Public Key6": "k"}
        lines.append("ID;short" if i % 10 == 3 else ";".join(cell[c] for c in columns))
    (tmp_path / "r.csv").write_text("\n".join([*lines, ";;", ""]), encoding="utf-8")
    good, skipped = feeds.read_register_csv(spark, str(tmp_path))
    assert {(r["Ladeeinrichtungs-ID"], r["Betreiber"]) for r in good.collect()} == {(f"ID{i}", f'Werk {i}\nGmbH; "Co"') for i in range(20) if i % 10 != 3}
    assert [(r.skipped_rows, r.rows) for r in skipped.collect()] == [(2, 20)]
