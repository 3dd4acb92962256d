"""Large files as frames: HL7v2 messages and entries of FHIR bundles, read by many tasks a file.

Spark's text reader splits a file into byte ranges at any separator of records; here the separator is what a frame may begin or end with ("MSH|", "}"). Whether it does depends on what comes before, which another task
reads. So there are three steps, as for a prefix sum:

1. each range says in a few numbers what it does to the state it starts with (a string open or not, how deep in brackets; whether a line has ended), whatever that state is;
2. the ranges' start states follow by a running sum over the ranges of a file, and go to the tasks (a few numbers a range of maxPartitionBytes; files are read in groups beyond MOST_RANGES ranges);
3. each range, read again with its state, gives its frames. The pieces of a frame that lies in several ranges are put together by a small aggregation.

Numbers of frames count through the file, so ids do not depend on how it was split. Anything that Spark can read will do, and a compressed file is one range.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import IngestError
from ..functions.shared import folder, settle

MOST_RANGES, SLICE = 1_000_000, 1 << 20

#: k: number of the frame in its range; part: 0 for a whole frame, 1, 2 and 3 where it begins, goes through and ends in a range, -1 for what the range says at its end; mine: whether it is one (null: as the range before says).
_FRAMES = "file long, uri string, range long, k long, part int, mine boolean, text string, before long, own long, open boolean"


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value (without the separator), the file, and the range that it was read from; in order within a range."""
    m = F.col("_metadata")
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(m["file_path"].alias("uri"), F.xxhash64(m["file_path"]).alias("file"), m["file_block_start"].alias("range"), m["file_size"].alias("bytes"), F.coalesce("value", F.lit("")).alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[tuple, Iterator[list[str]]]]:
    """((file, uri, range, bytes), lists of successive pieces of about `most` characters) for each range; a range is gone through once."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("file", "uri", "range", "bytes", "value")), strict=True)

    source, ahead = rows(), []
    ahead.append(next(source, None))
    while ahead[0] is not None:
        key = ahead[0][:4]

        def lists():
            held, size = [], 0
            while ahead[0] is not None and ahead[0][:4] == key:  # noqa: B023
                held.append(ahead[0][4])
                size += len(held[-1])
                ahead[0] = next(source, None)
                if size >= most:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        yield key, lists()


class _Messages:
    """Frames begin with MSH| at the start of a line. The state is whether a line has ended."""

    separator = "MSH|"
    ends = ("\n", "\r", "\x85", "\u2028", "\u2029")

    @classmethod
    def summary(cls, lists: Iterator[list[str]]) -> dict:
        last, size, n = "", 0, 0
        for values in lists:
            n += len(values)
            size += sum(len(v.encode()) for v in values)
            last = values[-1]  # where it is empty, what came before it is "MSH|", which ends no line
        return {"size": size, "n": n, "odd": last.endswith(cls.ends), "up0": 0, "up1": 0}

    @staticmethod
    def states(ranges: DataFrame) -> DataFrame:
        """s: 2 at a file's start, 1 where a frame begins, 0 where that of the range before goes on; goes_on: whether the next range goes on with this one's last."""
        w = Window.partitionBy("file").orderBy("range")
        before = F.lag("odd").over(w)
        s = F.when(before.isNull(), 2).when(before, 1).otherwise(0)
        return ranges.withColumn("s", s).withColumn("depth", F.lit(0)).withColumn("goes_on", ~F.col("odd") & F.lead("range").over(w).isNotNull())

    @classmethod
    def _runs(cls, lists: Iterator[list[str]], s: int) -> Iterator[tuple[bool, str]]:
        """(whether it begins here, text) of successive frames."""
        begun, now = s > 0, []
        for values in lists:
            for v in values:
                if not now:
                    now = [v] if s == 2 else [cls.separator, v]
                elif now[-1].endswith(cls.ends):
                    yield begun, "".join(now)
                    begun, now = True, [cls.separator, v]
                else:
                    now += [cls.separator, v]
        yield begun, "".join(now)

    @classmethod
    def frames(cls, lists: Iterator[list[str]], state: tuple) -> Iterator[tuple]:
        (s, _, goes_on), k, ahead = state, 0, None
        for run in itertools.chain(cls._runs(lists, s), [None]):
            if ahead is not None:
                (begun, text), open_ = ahead, run is None and goes_on
                if text.strip(" ") or open_ or not begun:
                    yield k, (1 if open_ else 0) if begun else (2 if open_ else 3), True, text, 0
                    k += begun
            ahead = run
        yield k, -1, None, None, 0


class _Entries:
    """Frames are the objects of the top-level array "entry" (subclasses: of another name). The state is whether a string is open, how deep in brackets we are, and, by a second running sum, whether the second level is that array."""

    separator = "}"
    _escape = re.compile(rb"\\.", re.S)
    _key = re.compile(rb'"entry"\s*:\s*$')
    _kind = re.compile(rb'"resourceType"\s*:\s*"([^"\\]*)"')

    @classmethod
    def _levels(cls, raw: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """(+1 or -1 at each bracket outside strings, else 0; what is inside strings; whether one is open at the end)."""
        plain = np.frombuffer(cls._escape.sub(b"__", raw), np.uint8)
        quoted = np.cumsum(plain == 34, dtype=np.int64) + in_string & 1
        inside = quoted.astype(bool)
        step = np.where(inside, 0, ((plain == 123) | (plain == 91)).astype(np.int8) - ((plain == 125) | (plain == 93)).astype(np.int8))
        return step, inside, bool(quoted[-1]) if len(quoted) else in_string

    @classmethod
    def summary(cls, lists: Iterator[list[str]]) -> dict:
        odd, ups, size, n = False, [0, 0], 0, 0
        for values in lists:
            n += len(values)
            raw = ("}".join(values) + "}").encode()
            size += len(raw) - len(values)  # without separators
            # Both start states at once: what is inside strings for one is outside for the other.
            step, _, end = cls._levels(raw, odd)
            other, _, _ = cls._levels(raw, not odd)
            ups[0] += int(step.sum())
            ups[1] += int(other.sum())
            odd = end
        return {"size": size, "n": n, "odd": odd, "up0": ups[0], "up1": ups[1]}

    @staticmethod
    def states(ranges: DataFrame) -> DataFrame:
        w = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        s = F.coalesce(F.sum(F.col("odd").cast("int")).over(w), F.lit(0)) % 2
        up = F.when(F.col("s") == 0, F.col("up0")).otherwise(F.col("up1"))
        return ranges.withColumn("s", s.cast("int")).withColumn("depth", F.coalesce(F.sum(up).over(w), F.lit(0)).cast("int")).withColumn("goes_on", F.lit(False))

    @classmethod
    def frames(cls, lists: Iterator[list[str]], state: tuple) -> Iterator[tuple]:
        s, depth, _ = state
        in_string, mine, k, held, before = bool(s), None, 0, [], 0
        open_, begun, named = depth >= 3, False, None
        for values in lists:
            raw = ("}".join(values) + "}").encode()
            step, _, in_string = cls._levels(raw, in_string)
            level = depth + np.cumsum(step, dtype=np.int64)
            if named is None and (level < 2).any() and (found := cls._kind.search(np.frombuffer(raw, np.uint8)[level < 2].tobytes())):
                named = found[1].decode()
            at = np.flatnonzero(step)
            now, turn = level[at], step[at]
            # What opens the second level, and what opens and ends the third.
            seconds, starts, ends = at[(now == 2) & (turn > 0)], at[(now == 3) & (turn > 0)], at[(now == 2) & (turn < 0)]
            events = sorted([(int(i), 0) for i in seconds] + [(int(i), 1) for i in starts] + [(int(i) + 1, 2) for i in ends])
            since = 0
            for i, kind in events:
                if kind == 0:
                    mine = raw[i : i + 1] == b"[" and bool(cls._key.search(raw, max(0, i - 200), i))
                elif kind == 1:
                    open_, begun, since = True, True, i
                elif open_:
                    held.append(raw[since:i])
                    if mine is not False or not begun:
                        yield k, 0 if begun else 3, mine if begun else None, b"".join(held).decode(), 0
                    k, before = k + (begun and mine is not False), before + (begun and mine is None)
                    open_, held = False, []
            if open_:
                held.append(raw[since:])
            depth = int(level[-1]) if len(level) else depth
        if open_:
            yield k, 1 if begun else 2, mine if begun else None, b"".join(held).decode(), 0
            k, before = k + (begun and mine is not False), before + (begun and mine is None)
        yield k, -1, mine, named, before


class _LogEntries(_Entries):
    _key = re.compile(rb'"entries"\s*:\s*$')


class _Records(_Entries):
    _key = re.compile(rb'"records"\s*:\s*$')


_ARRAYS = {"entry": _Entries, "entries": _LogEntries, "records": _Records}


def _summaries(pieces: DataFrame, kind: type) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, uri, start, size), lists in _by_range(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "uri": uri, "range": start, "bytes": size, **kind.summary(lists)}])

    return settle(pieces.mapInArrow(task, "file long, uri string, range long, bytes long, size long, n long, odd boolean, up0 long, up1 long"))


def _read(pieces: DataFrame, kind: type, states: dict) -> DataFrame:
    shared = pieces.sparkSession.sparkContext.broadcast(states)
    names = [f.split()[0] for f in _FRAMES.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, uri, start, _), lists in _by_range(batches):
            out, size, last = [], 0, 0
            for k, part, mine, text, before in kind.frames(lists, shared.value[file, start]):
                out.append((file, uri, start, k, part, mine, text, before, k, last == 1))
                last, size = part, size + len(text or "")
                if size > SLICE or len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return pieces.mapInArrow(task, _FRAMES)


def frames(spark: SparkSession, path: str, kind: type) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uri, n, text of every frame; what was summed up of every range; file and name of what the file says it is)."""
    pieces = _pieces(spark, path, kind.separator)
    ranges = settle(kind.states(_summaries(pieces, kind)))
    groups = -(-ranges.count() // MOST_RANGES) or 1
    found = None
    for g in range(groups):
        own = lambda df, g=g: df.where(F.pmod(F.col("file"), F.lit(groups)) == g) if groups > 1 else df
        states = {(r["file"], r["range"]): (r["s"], r["depth"], r["goes_on"]) for r in own(ranges).select("file", "range", "s", "depth", "goes_on").collect()}
        read = settle(_read(own(pieces), kind, states))
        found = read if found is None else found.union(read)

    # What a range could not know: whether the array it starts in is the entries', and how many frames come before.
    back = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where("part = -1").withColumn("mine_before", F.coalesce(F.last("mine", ignorenulls=True).over(back), F.lit(False)))
    count = F.col("own") - F.when(F.col("mine_before"), 0).otherwise(F.col("before"))
    ends = settle(ends.select("file", "range", "mine_before", "before", F.coalesce(F.sum(count).over(back), F.lit(0)).alias("offset"), F.when(F.col("open"), F.col("range")).alias("opens")))
    ends = settle(ends.withColumn("owner", F.last("opens", ignorenulls=True).over(back)))
    rows = found.where("part >= 0").drop("before", "own", "open").join(ends, ["file", "range"])
    n = F.col("offset") + F.col("k") - F.when(F.col("mine").isNull() | F.col("mine_before"), 0).otherwise(F.col("before"))
    whole = rows.where((F.col("part") == 0) & F.coalesce("mine", "mine_before")).select("uri", n.alias("n"), "text")
    # A frame over several ranges: its first piece says where it began, the others belong to the last range before them that left one open.
    split = rows.where("part > 0").withColumn("at", F.when(F.col("part") == 1, F.col("range")).otherwise(F.col("owner")))
    first = F.when(F.col("part") == 1, F.struct(n.alias("n"), F.coalesce("mine", "mine_before").alias("mine")))
    glued = split.groupBy("file", "uri", "at").agg(F.max(first).alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "text"))), lambda x: x["text"]), "").alias("text"))
    named = found.where("part = -1").groupBy("file").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.col("range"))).alias("name"))
    return whole.union(glued.where("f.mine").select("uri", "f.n", "text")), ranges, named


def messages(spark: SparkSession, path: str) -> DataFrame:
    """uri, n and text of every HL7v2 message of the files: from a line that starts with MSH| to the next; what comes before a file's first is one too unless it is blank."""
    return frames(spark, path, _Messages)[0]


def objects(spark: SparkSession, path: str, array: str, fields: str) -> DataFrame:
    """n and the fields of every object in the top-level array of JSON files; it raises if a file's brackets or strings are not closed, or, when read, if an object is no JSON.

    Objects go through a table of texts, because only Spark's file reader gives a string field that holds JSON as it is spelt (from_json makes 1.5 of 1.50)."""
    rows, files = entries(spark, path, array)
    if bad := files.where(~F.col("ok")).count():
        raise IngestError(f"{bad} file(s) in {path} hold no JSON")
    at = folder(spark)
    text = F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit(',"e":'), F.col("text"), F.lit("}"))
    # The separator is a character that JSON has nowhere; objects may have line ends between their parts.
    rows.select(text.alias("value")).write.option("lineSep", "\x1e").option("compression", "gzip").text(at)
    read = spark.read.schema(StructType().add("n", "long").add("e", StructType.fromDDL(fields))).option("lineSep", "\x1e").json(at)
    return read.where(F.coalesce("n", F.raise_error(F.lit(f"{path} holds an object that is no JSON")).cast("long")) >= 0).select("n", "e.*")


def entries(spark: SparkSession, path: str, array: str = "entry") -> tuple[DataFrame, DataFrame]:
    """(uri, n and text of every object in the files' top-level array; uri, ok and name of every file: whether brackets and strings are closed at its end, and its top-level resourceType)."""
    out, ranges, named = frames(spark, path, _ARRAYS[array])
    up: Column = F.when(F.col("s") == 0, F.col("up0")).otherwise(F.col("up1"))
    # Where a file does not end with a separator, its last piece has none, and one bracket was counted that is not there.
    files = ranges.groupBy("file", "uri").agg(F.sum(up).alias("up"), (F.sum(F.col("size") + F.col("n")) - F.max("bytes")).alias("more"), (F.sum(F.col("odd").cast("int")) % 2).alias("open"), F.sum("n").alias("n"))
    more = F.greatest("more", F.lit(0))
    ok = (F.col("up") + more == 0) & (F.col("open") == 0) & (F.col("n") > more)
    return out, files.join(named, "file", "left").select("uri", ok.alias("ok"), "name")
