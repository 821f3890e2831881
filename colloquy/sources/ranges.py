"""Reading one large JSON list or CSV file in many tasks.

Neither format says in the middle of a file what state a reader is in there:
inside a string or a quoted cell, how deep in brackets, in which dialogue.  So
a file is read in two passes, in byte ranges (Spark's input splits).

1. Every range is scanned on its own for each state it may begin in, and
   yields a state map: the state it ends in, and what it adds to the counts of
   dialogues and turns.  Maps are one row a range; composing them in file order
   with window functions gives each range the state it really begins in.
2. Every range is scanned again from that state and cut into records.  Only
   records that cross the end of a range leave as pieces, which are joined by
   the range that the record began in; all others never move.  (This pass runs
   for the whole records and for the pieces, which costs a scan and saves
   writing or moving all of them.)

The text source does the cutting into ranges: with ``}`` (JSON) or line feed
(CSV) as line separator, a range is extended to the next such byte, wherever
its end falls: inside a string, an escape or a character of several bytes.
Neither byte is ever escaped by a backslash, nor part of a longer character.

A broadcast here has one row an input split, a list that the driver holds in
any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, prepare

_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[[ord(c) for c in '"[]{}']] = True
_OPENS = np.zeros(256, np.int64)
_OPENS[[ord(c) for c in "[{"]] = 1
_OPENS[[ord(c) for c in "]}"]] = -1
_LIST, _OBJECT, _OBJECT_END = ord("["), ord("{"), ord("}")


def ranged_session(spark: SparkSession, range_bytes: int | None) -> SparkSession:
    """The session itself, or one of the same application whose file reads are cut every ``range_bytes``."""
    if range_bytes is None:
        return spark
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(range_bytes))
    prepare(own)
    return own


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Rows (file, block, value) of a text cut at ``separator``; a range is (file, block), its rows come in order."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """(values of ``columns``, values) of neighbouring rows that agree in ``columns``; a range may take several."""
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in columns]))
        values = batch.column("value").to_pylist()
        begin = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[begin]:
                yield keys[begin], values[begin:k]
                begin = k


# ---------------------------------------------------------------------- JSON
def brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(position, byte, inside) of all brackets, and the parity of quotes.

    ``inside`` is 1 for a bracket within a string, if the data begins outside
    of one; if it begins inside, it is the other way round.
    """
    raw = np.frombuffer(data, np.uint8)
    pos = np.flatnonzero(_STRUCTURE[raw])
    kind = raw[pos]
    quotes = pos[kind == _QUOTE]
    # a quote after an odd number of backslashes is escaped; few quotes have any
    marks = quotes[(quotes > 0) & (raw[np.maximum(quotes - 1, 0)] == _BACKSLASH)]
    escaped = []
    for p in marks.tolist():
        at = p - 1
        while at >= 0 and raw[at] == _BACKSLASH:
            at -= 1
        if (p - 1 - at) % 2:
            escaped.append(p)
    if escaped:
        real = ~np.isin(pos, np.array(escaped))
        pos, kind = pos[real], kind[real]
    quote = kind == _QUOTE
    parity = np.cumsum(quote) & 1
    return pos[~quote], kind[~quote], parity[~quote], int(quote.sum() & 1)


class _Profile:
    """State map of a range that begins in (1) or outside (0) a string; depths are relative to its begin."""

    def __init__(self, begins: int):
        self.begins, self.quotes, self.depth = begins, 0, 0
        self.seen: dict[int, list[int]] = {}  # relative depth: lists opened, objects one deeper, those after the last list

    def add(self, pos, kind, inside, parity):
        mine = (inside ^ self.quotes) == self.begins
        step = _OPENS[kind[mine]]
        before = self.depth + np.cumsum(step) - step
        lists, objects = before[kind[mine] == _LIST], before[kind[mine] == _OBJECT] - 1
        at_list, at_object = pos[mine][kind[mine] == _LIST], pos[mine][kind[mine] == _OBJECT]
        for r in set(lists.tolist()) | set(objects.tolist()):
            have = self.seen.setdefault(r, [0, 0, 0])
            opened, held = at_list[lists == r], at_object[objects == r]
            have[0] += len(opened)
            have[1] += len(held)
            have[2] = int((held > opened[-1]).sum()) if len(opened) else have[2] + len(held)
        self.depth += int(step.sum())
        self.quotes ^= parity


def _json_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(key, profiles):
        return [(*key, p.begins, p.quotes, p.depth, r, *counts) for p in profiles
                for r, counts in (p.seen or {0: (0, 0, 0)}).items()]

    def batch(out):
        kinds = [pa.string()] + [pa.int64()] * 8
        names = ["file", "block", "begins", "quotes", "depth", "r", "lists", "objects", "after"]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    current, profiles = None, []
    for key, values in _runs(batches, ["file", "block"]):
        if key != current:
            if current is not None:
                yield batch(rows(current, profiles))
            current, profiles = key, [_Profile(0), _Profile(1)]
        found = brackets(b"}".join(values) + b"}")
        for p in profiles:
            p.add(*found)
    if current is not None:
        yield batch(rows(current, profiles))


def json_ranges(chunks: DataFrame) -> DataFrame:
    """One row a range: (file, block, inside, depth, conv, turn) at its begin, and (inside_end, depth_end).

    ``conv`` dialogues have been opened before it, and ``turn`` turns of the
    last of them.
    """
    maps = chunks.mapInArrow(_json_maps, "file string, block bigint, begins bigint, quotes bigint, depth bigint, "
                                         "r bigint, lists bigint, objects bigint, after bigint")
    one = maps.groupBy("file", "block").agg(
        F.max("quotes").alias("quotes"),
        *[F.max(F.when(F.col("begins") == s, F.col("depth"))).alias(f"d{s}") for s in (0, 1)],
        F.collect_list(F.struct("begins", "r", "lists", "objects", "after")).alias("seen"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    at = one.withColumn("inside", so_far("quotes") % 2)
    at = at.withColumn("adds", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    at = at.withColumn("start", so_far("adds"))
    mine = F.get(F.filter("seen", lambda x: (x["begins"] == F.col("inside")) & (x["r"] == 1 - F.col("start"))), F.lit(0))
    at = at.select("file", "block", "inside", F.col("start").alias("depth"),
                   ((F.col("inside") + F.col("quotes")) % 2).alias("inside_end"),
                   (F.col("start") + F.col("adds")).alias("depth_end"),
                   *[F.coalesce(mine[k], F.lit(0)).alias(k) for k in ("lists", "objects", "after")])
    at = at.withColumns({"conv": so_far("lists"), "begun": so_far("objects")})
    # turns that had begun in the file when the last dialogue was opened
    opened = F.when(F.col("lists") > 0, F.col("begun") + F.col("objects") - F.col("after"))
    at = at.withColumn("opened", opened)
    since = F.coalesce(F.last("opened", ignorenulls=True).over(before), F.lit(0))
    return at.select("file", "block", "inside", "depth", "conv", (F.col("begun") - since).alias("turn"), "inside_end",
                     "depth_end")


def _json_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "conv", "turn", "whole", "body"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    current, held, begun_here = None, None, True
    for key, values in _runs(batches, ["file", "block", "inside", "depth", "conv", "turn"]):
        out = []
        if key != current:
            if held is not None:  # the turn goes on in the next range
                out.append((*current[:2], conv, turn, False, b"".join(held)))
            current = key
            inside, depth, conv, turn = key[2], key[3], key[4] - 1, key[5]
            held, begun_here = None, True
            if depth > 2:  # within a turn that an earlier range began
                held, begun_here, turn = [], False, turn - 1
        data = b"}".join(values) + b"}"
        pos, kind, flags, parity = brackets(data)
        real = (flags ^ inside) == 0
        pos, kind = pos[real], kind[real]
        step = _OPENS[kind]
        before = depth + np.cumsum(step) - step
        event = ((kind == _LIST) & (before == 1)) | ((kind == _OBJECT) & (before == 2)) | (
            (kind == _OBJECT_END) & (before == 3))
        start = 0
        for p, k in zip(pos[event].tolist(), kind[event].tolist()):
            if k == _LIST:
                conv, turn = conv + 1, 0
            elif k == _OBJECT:
                held, start, begun_here = [], p, True
            elif held is not None:
                held.append(data[start:p + 1])
                out.append((*current[:2], conv, turn, begun_here, b"".join(held)))
                held, turn = None, turn + 1
        if held is not None:
            held.append(data[start:])
        inside, depth = inside ^ parity, depth + int(step.sum())
        yield batch(out)
    if held is not None:
        yield batch([(*current[:2], conv, turn, False, b"".join(held))])


def read_json_turns(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Rows (file, conv, turn, body) of files that each hold one JSON list of lists of objects.

    ``conv`` and ``turn`` count from 0 in file order, ``body`` is the JSON text
    of an object, whatever its fields.  A file whose brackets or strings do not
    close is an error.  An empty list, or a file of white space, has no rows.
    """
    own = ranged_session(spark, range_bytes)
    chunks = _chunks(own, path, "}")
    ranges = materialize(json_ranges(chunks), "json-ranges")
    # the reader cannot tell that the last piece of a file has no brace behind it, and counts one too many
    last = ranges.groupBy("file").agg(F.max(F.struct("block", "inside_end", "depth_end")).alias("z"))
    broken = last.filter("z.inside_end <> 0 OR z.depth_end <> -1").limit(5).collect()
    if broken:
        raise ValueError("not one closed JSON list: " + ", ".join(r["file"] for r in broken))
    begin = ranges.select("file", "block", "inside", "depth", "conv", "turn")
    placed = chunks.join(F.broadcast(begin), ["file", "block"])
    cut = placed.mapInArrow(_json_turns, "file string, block bigint, conv bigint, turn bigint, whole boolean, body string")
    pieces = cut.filter(~F.col("whole")).groupBy("file", "conv", "turn").agg(
        F.array_sort(F.collect_list(F.struct("block", "body"))).alias("p"))
    joined = pieces.select("file", "conv", "turn", F.array_join(F.transform("p", lambda x: x["body"]), "").alias("body"))
    return cut.filter("whole").select("file", "conv", "turn", "body").unionByName(joined)


# ----------------------------------------------------------------------- CSV
# A cell is quoted if a quote is its first character; a doubled quote stands for one.
_CELL = re.compile(rb'"[^"]*(?:""[^"]*)*("?)[^,]*(?:,|\Z)|[^,]*(?:,|\Z)')
_CLOSING = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")[^,]*(,|\Z)')


def line_state(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside (or outside) a quoted cell ends inside one."""
    if b'"' not in line:
        return inside
    at = 0
    if inside:
        close = _CLOSING.match(line)
        if not close:
            return True
        at = close.end()
        if not close.group(1):
            return False
    while at < len(line):
        cell = _CELL.match(line, at)
        if cell.group(1) == b"":
            return True  # quoted and not closed on this line
        if cell.end() == len(line):
            break
        at = cell.end()
    return False


def _csv_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(key, states):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64())] +
                                          [pa.array([int(s)], pa.int64()) for s in states],
                                          names=["file", "block", "end0", "end1"])

    current, states = None, None
    for key, values in _runs(batches, ["file", "block"]):
        if key != current:
            if current is not None:
                yield batch(current, states)
            current, states = key, [False, True]
        for line in values:
            if b'"' in line:
                states = [line_state(line, s) for s in states]
    if current is not None:
        yield batch(current, states)


def csv_ranges(chunks: DataFrame) -> DataFrame:
    """One row a range: (file, block, inside, opened) at its begin; ``opened``: the range that began the open record.

    A map of the two states either keeps them, swaps them or leads both to one;
    a state is that of the last map of the third kind before, swapped as often
    as the second kind came since.
    """
    maps = chunks.mapInArrow(_csv_maps, "file string, block bigint, end0 bigint, end1 bigint")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = ((F.col("end0") == 1) & (F.col("end1") == 0)).cast("bigint")
    at = maps.withColumn("swapped", F.sum(swaps).over(to_here) % 2)
    at = at.withColumn("set", F.when(F.col("end0") == F.col("end1"), (F.col("end0") + F.col("swapped")) % 2))
    at = at.withColumn("inside", (F.coalesce(F.last("set", ignorenulls=True).over(before), F.lit(0))
                                  + F.coalesce(F.lag("swapped").over(order), F.lit(0))) % 2)
    return at.select("file", "block", "inside")


def _csv_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "first", "part", "record"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    # a record that ends in its range is 'whole'; the others are 'head', 'middle' and 'tail'
    current, held, inside, earlier, first = None, [], False, False, False
    for key, values in _runs(batches, ["file", "block", "inside"]):
        out = []
        if key != current:
            if held:
                out.append((*current[:2], first, "middle" if earlier else "head", b"\n".join(held)))
            current, held, inside = key, [], bool(key[2])
            earlier, first = inside, key[1] == 0
        for line in values:
            inside = line_state(line, inside)
            held.append(line)
            if not inside:
                out.append((*current[:2], first, "tail" if earlier else "whole", b"\n".join(held)))
                held, earlier, first = [], False, False
        yield batch(out)
    if held:
        yield batch([(*current[:2], first, "middle" if earlier else "head", b"\n".join(held))])


def read_csv_records(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Rows (record) of CSV files with a header line: one record each, header and empty lines left out.

    Quoted cells may hold line feeds, commas and doubled quotes; a quote
    elsewhere than at a cell's begin is an ordinary character.  A carriage
    return before the line feed that ends a record goes.  A record that is still
    open at the end of its file ends there.
    """
    own = ranged_session(spark, range_bytes)
    chunks = _chunks(own, path, "\n")
    ranges = materialize(csv_ranges(chunks), "csv-ranges")
    cut = chunks.join(F.broadcast(ranges), ["file", "block"]).mapInArrow(
        _csv_records, "file string, block bigint, first boolean, part string, record string")
    # the pieces of a record lie between its head and the next one in file order
    pieces = cut.filter("part <> 'whole'")
    order = Window.partitionBy("file").orderBy("block", F.col("part") == "head").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("opened", F.last(F.when(F.col("part") == "head", F.col("block")), ignorenulls=True).over(order))
    joined = pieces.groupBy("file", "opened").agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"), F.max("first").alias("first")).select(
        "first", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    every = cut.filter("part = 'whole'").select("first", "record").unionByName(joined)
    record = F.regexp_replace("record", r"\r\z", "")
    return every.filter(~F.col("first")).select(record.alias("record")).filter("record <> ''")
