"""Ranges of CSV files against Spark's multi-line reader, split at every place."""

import random

import pytest
from pyspark.sql import types as T

from tagspace.sources import csv_ranges, files

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()),
                       T.StructField("at", T.TimestampNTZType()), T.StructField("more", T.StringType())])


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def sample_file(rows, seed, end="\n"):
    r = random.Random(seed)
    parts = ["a", "é", " ", '"', '""', ",", "\n", "\n\n", "x,y", "#t", 'he said "no"', "\n,\n"]
    out = ["id,text,at,more"]
    for i in range(rows):
        text = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        more = r.choice(["", "plain", 'in"side', "a b", quoted("line\nbreak"), quoted("")])
        number = str(i) if i % 9 else "none"
        out.append(f"{number},{quoted(text)},2020-01-{i % 28 + 1:02d} 10:00:00,{more}")
        if i % 13 == 0:
            out.append("")  # a blank line is no record
        if i % 17 == 0:
            out.append(f"{i},short")
    return end.join(out) + (end if seed % 2 else "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [16, 100, 1000, 1 << 20])
def test_equals_the_multi_line_reader(spark, tmp_path, range_bytes):
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text(sample_file(26, k), newline="")
    want = rows_of(files.read_csv(spark, str(tmp_path), SCHEMA))
    got = csv_ranges.read_csv_ranges(spark, str(tmp_path), SCHEMA, range_bytes=range_bytes)
    assert rows_of(got) == want and len(want) == 2 * 26 + 2 * 2
    if range_bytes == 1000:
        assert csv_ranges.text_lines(spark, str(tmp_path), range_bytes).rdd.getNumPartitions() > 3


def test_every_place_of_one_record(spark, tmp_path):
    """Ranges of 1, 2, ... bytes: the edges fall on every byte of quotes, escapes and breaks."""
    (tmp_path / "f.csv").write_text('id,text,at,more\n1,"a""\n"",""\n\nb",,z\n\n2,"""",,"\n"\n3,q"r,,\n', newline="")
    want = rows_of(files.read_csv(spark, str(tmp_path), SCHEMA))
    assert len(want) == 3
    for n in (1, 2, 3, 5, 7, 20, 50):
        assert rows_of(csv_ranges.read_csv_ranges(spark, str(tmp_path), SCHEMA, range_bytes=n)) == want


def test_windows_line_ends_separators_and_no_header(spark, tmp_path):
    (tmp_path / "w.csv").write_text('1;"a\r\nb";2020-01-01 10:00:00;x\r\n\r\n2;c;;"y;z"\r\n', newline="")
    for n in (3, 10, 1000):
        got = rows_of(csv_ranges.read_csv_ranges(spark, str(tmp_path), SCHEMA, header=False, sep=";", range_bytes=n))
        assert [(r[0], r[1], r[3]) for r in got] == [(1, "a\r\nb", "x"), (2, "c", "y;z")]


def test_empty_unclosed_and_long(spark, tmp_path):
    (tmp_path / "a.csv").write_text("", newline="")
    (tmp_path / "b.csv").write_text("id,text,at,more\n", newline="")
    assert csv_ranges.read_csv_ranges(spark, str(tmp_path), SCHEMA, range_bytes=5).count() == 0
    (tmp_path / "c.csv").write_text("id,text,at,more\n1," + quoted("long\nline " * 2_000) + ",,\n2,x,,\n", newline="")
    (tmp_path / "d.csv").write_text('id,text,at,more\n3,"never closed\n4,x,,', newline="")
    (tmp_path / "e.csv").write_text('"id\n2",text,at,more\n5,"k",,\n', newline="")  # a header of two lines
    want = rows_of(files.read_csv(spark, str(tmp_path), SCHEMA))
    assert {r[0] for r in want} == {1, 2, 3, 5}
    for n in (50, 9000, 1 << 20):
        assert rows_of(csv_ranges.read_csv_ranges(spark, str(tmp_path), SCHEMA, range_bytes=n)) == want


def test_small_ranges_do_not_make_as_many_tasks(spark, tmp_path):
    """F8: a task reads several ranges."""
    (tmp_path / "f.csv").write_text(sample_file(400, 1), newline="")
    want = rows_of(files.read_csv(spark, str(tmp_path), SCHEMA))
    assert csv_ranges.text_lines(spark, str(tmp_path), 64).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert rows_of(csv_ranges.read_csv_ranges(spark, str(tmp_path), SCHEMA, range_bytes=64)) == want
