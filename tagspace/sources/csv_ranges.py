"""CSV with quoted line breaks, read by many tasks.

A quoted field may hold line breaks, so a task that begins in the middle of a file cannot tell
whether its first line begins a record. Lines are therefore read by the splittable text source, and

1. each byte range says where it would end, outside or inside a quoted field, for either state it may
   begin in (one small row per range);
2. these functions are chained along each file, which gives every range its true state;
3. each range forms the records that begin and end in it; a record that runs on past its range is put
   together from the pieces of its ranges (at most one piece begins and one ends in a range);
4. Spark's CSV parser (``from_csv``) parses the records.

Quotes count only where a field begins, and a doubled quote inside a quoted field is one quote, as in
the multi-line reader. What follows a closing quote belongs to the field up to the next separator or
the end of the line. Blank lines between records are no records; one ``\\r`` before a record's end
is part of the line end. A file that ends inside a quoted field ends its last record, without a line
break at the file's end. Files are UTF-8; a compressed file is one range.

The ranges of both passes must be the same: they are pinned in a session of the reader's own, so that
neither later settings nor the number of executors change them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspace.session import cut_lineage

#: Tasks, for each core of the session, that ranges of a given size are read by at least.
TASKS_PER_CORE = 4

_PIECES = "file string, owner long, start long, first boolean, text string"


class LineStates:
    """Whether a line ends inside a quoted field, for a line that begins a record or goes on in one."""

    def __init__(self, sep: str = ",", quote: str = '"'):
        q, s = re.escape(quote), re.escape(sep)
        body = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
        field = f"(?:{q}{body}{q}[^{s}]*+|[^{q}{s}][^{s}]*+|)"
        opened = f"(?:{field}{s})*+{q}{body}"
        self.quote = quote
        self._outside = re.compile(opened, re.S)
        self._inside = re.compile(f"{body}(?:{q}[^{s}]*+{s}{opened})?", re.S)

    def after(self, line: str, inside: bool) -> bool:
        return (self._inside if inside else self._outside).fullmatch(line) is not None


def text_lines(spark: SparkSession, path: str, range_bytes: int | None = None,
               where: Column | None = None) -> DataFrame:
    """(value, file, start): lines and the byte range that each begins in; of the folders that
    ``where``, on their partition columns, picks."""
    most = range_bytes or spark.conf.get("spark.sql.files.maxPartitionBytes")
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    own.conf.set("spark.sql.files.minPartitionNum", "1")  # else the number of executors counts
    lines = own.read.option("lineSep", "\n").text(path)
    lines = lines if where is None else lines.where(where)
    name = f"csv_lines_{uuid.uuid4().hex}"
    lines.select("value", F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("start")).createGlobalTempView(name)
    out = spark.table(f"global_temp.{name}")  # the caller's settings hold for all but the ranges
    spark.catalog.dropGlobalTempView(name)
    if range_bytes is None:
        return out
    # ranges may be small, and tasks need not: a task reads several, one after the other
    plain = spark.read.option("lineSep", "\n").text(path)
    tasks = (plain if where is None else plain.where(where)).rdd.getNumPartitions()
    return out.coalesce(max(1, tasks, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, pa.Array]]:
    """(file, start, lines) of consecutive lines of one range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column(2).to_numpy()
        files = batch.column(1).dictionary_encode()
        ids = files.indices.to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])]))
        for a, b in zip(edge, np.append(edge[1:], batch.num_rows), strict=True):
            yield files.dictionary[int(ids[a])].as_py(), int(starts[a]), batch.column(0).slice(a, b - a)


def range_ends(lines: DataFrame, states: LineStates) -> DataFrame:
    """(file, start, outside, inside, left): whether the range ends inside a quoted field if it
    begins outside, or inside one; and whether it is outside at any time if it begins inside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        for file, start, values in _ranges(batches):
            if (file, start) != at:
                at = file, start
                found.append([file, start, False, True, False])
            row = found[-1]
            for line in values.filter(pc.match_substring(values, states.quote)).to_pylist():
                row[2], row[3] = states.after(line, row[2]), states.after(line, row[3])
                row[4] |= not row[3]
        cols = list(zip(*found, strict=True)) or [[]] * 5
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=["file", "start", "outside", "inside", "left"])

    return lines.mapInArrow(run, "file string, start long, outside boolean, inside boolean, left boolean")


def chained(ends: list) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """(begins inside, owner, ends inside) of every range, from ``range_ends`` rows. The owner of a
    range that begins inside is the range in which its first record began."""
    out, file, inside, owner = {}, None, False, 0
    for r in sorted(ends, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, owner = r["file"], False, r["start"]
        end = r["inside"] if inside else r["outside"]
        out[file, r["start"]] = inside, owner if inside else r["start"], end
        if not inside or r["left"]:
            owner = r["start"]  # the record that is open at the end began here
        inside = end
    return out


def _records(batches: Iterator[pa.RecordBatch], states: LineStates,
             known: dict) -> Iterator[tuple[tuple[str, int, int, bool, bool], list[str]]]:
    """((file, owner, start, first, whole), records): records that begin and end in the range, or
    one piece of a record that does not; ``first`` where the file's first record is the first."""
    at: tuple[str, int] | None = None
    inside, begun, seen, held = False, True, False, []

    def out(records: list[str], whole: bool) -> Iterator[tuple]:
        nonlocal seen
        if records:
            own = at[1] if whole or begun else known[at][1]
            yield (at[0], own, at[1], at[1] == 0 and not seen and begun, whole), records
            seen = seen or any(r not in ("", "\r") for r in records)

    for file, start, values in _ranges(batches):
        if (file, start) != at:
            if held:
                yield from out(["\n".join(held)], False)
            at, held, seen = (file, start), [], False
            if at not in known:
                raise RuntimeError(f"{file} was split otherwise when its quotes were counted")
            inside = known[at][0]
            begun = not inside  # whether the record that is open began in this range
        lines = values.to_pylist()
        quoted = np.flatnonzero(pc.match_substring(values, states.quote).to_numpy(zero_copy_only=False)).tolist()
        done: list[str] = []
        plain = 0
        for k in [*quoted, len(lines)]:
            (held if inside else done).extend(lines[plain:k])  # lines without quotes change nothing
            plain = k + 1
            if k == len(lines):
                break
            after = states.after(lines[k], inside)
            if not inside and not after:
                done.append(lines[k])
            elif inside and after:
                held.append(lines[k])
            elif after:
                held, begun = [lines[k]], True
            else:
                text = "\n".join([*held, lines[k]])
                held = []
                if begun:
                    done.append(text)
                else:  # the end of a record that began in an earlier range
                    yield from out([text], False)
                    begun = True
            inside = after
        yield from out(done, True)
    if held:
        yield from out(["\n".join(held)], False)


def _whole_records(lines: DataFrame, states: LineStates, known, header: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, first, whole), records in _records(batches, states, known.value):
            if whole:
                if first and header:
                    filled = next((k for k, r in enumerate(records) if r not in ("", "\r")), len(records))
                    records = records[filled + 1:]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["record"])

    return lines.mapInArrow(run, "record string")


def _joined_records(lines: DataFrame, states: LineStates, known, header: bool) -> DataFrame:
    """Records that begin in one range and end in another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(*place[:4], records[0]) for place, records in _records(batches, states, known.value) if not place[4]]
        cols = list(zip(*found, strict=True)) or [[]] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=[x.split()[0] for x in _PIECES.split(", ")])

    pieces = F.sort_array(F.collect_list(F.struct("start", "text")))
    rows = (lines.mapInArrow(run, _PIECES).groupBy("file", "owner")
            .agg(F.max("first").alias("first"), pieces.alias("pieces")))
    return (rows.where(~F.col("first") if header else F.lit(True))
            .select(F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("record")))


def records(spark: SparkSession, path: str, header: bool = True, sep: str = ",", quote: str = '"',
            range_bytes: int | None = None, where: Column | None = None) -> DataFrame:
    """(record): the text of every record of the CSV files, without their headers."""
    states = LineStates(sep, quote)
    lines = text_lines(spark, path, range_bytes, where)
    # one row per byte range, as many as the driver lists when it plans the scan
    known = chained(range_ends(lines, states).collect())
    shared = spark.sparkContext.broadcast(known)
    out = _whole_records(lines, states, shared, header)
    torn = [(file, start) for (file, start), (inside, _, ends) in known.items() if inside or ends]
    if torn:
        # only ranges that a record crosses the edge of are read again, before any Python
        places = spark.createDataFrame(torn, "file string, start long")
        crossed = lines.join(F.broadcast(places), ["file", "start"], "left_semi")  # keeps the lines' order
        out = out.unionByName(cut_lineage(_joined_records(crossed.select("value", "file", "start"), states, shared, header)))
    ended = F.when(F.col("record").endswith("\r"), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    return out.select(ended.alias("record")).where(F.col("record") != "")


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, sep: str = ",",
                    quote: str = '"', range_bytes: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows of ``schema`` from CSV files, as the multi-line reader gives them, in many tasks."""
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "multiLine": "true"}
    fields = schema if isinstance(schema, str) else schema.simpleString()
    parsed = F.from_csv("record", F.lit(fields), options).alias("row")
    return records(spark, path, header, sep, quote, range_bytes, where).select(parsed).select("row.*")
