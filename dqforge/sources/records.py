"""CSV records of text files, read in many slices.

A quoted field may hold line breaks, so whether a line starts inside one depends on all
lines before it.  Every line is a function from "inside a quoted field or not" at its
start to the same at its end: it keeps the state, turns it round, or fixes it.  Such
functions compose, so each slice of a file is read for both start states at once; the
functions of a file's slices -- one row a slice -- are composed in file order and give
each slice its true start.  No slice waits for another, and a file of many splits is read
by as many tasks.

Lines stay in the slice they were read in: a second read joins the lines of a record
there.  Only records that run over the end of a slice are shuffled, one row a slice.

Quotes follow RFC 4180: a field is quoted if a quote opens it; a doubled quote inside is
a quote; a quote further inside an unquoted field is an ordinary character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLOSED, _OPENS = r'(^|,)"[^"]*"[^,]*', r'(^|,)"'


def ends_open(line: Column) -> Column:
    """Whether a line that starts outside ends inside a quoted field."""
    single = F.replace(line, F.lit('""'), F.lit(""))
    return F.regexp_replace(single, _CLOSED, "$1").rlike(_OPENS)


def line_ends_open(line: str, inside: bool) -> bool:
    """The same for one line of pasted text."""
    single = ('"' + line if inside else line).replace('""', "")
    return re.search(_OPENS, re.sub(_CLOSED, r"\1", single)) is not None


_EFFECTS = "_file string, _start long, out int, into int, marks_out long, marks_in long, begins boolean"
_RECORDS = "_file string, _slice int, _pos long, value string, _before long, _record int"


def _states(out: np.ndarray, into: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """Whether each line starts inside, and the state after the last."""
    turned = np.cumsum(out > into)
    fixed = np.maximum.accumulate(np.where(out == into, np.arange(len(out)), -1))
    after = np.where(fixed >= 0, out[fixed] + turned - turned[fixed], start + turned) & 1
    return np.concatenate([[start], after[:-1]]), int(after[-1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """``(file, start of the slice)`` with its lines; a batch may hold several slices."""
    for b in batches:
        if b.num_rows == 0:
            continue
        f, at = b["_file"], b["_start"].to_numpy()
        new = (at[1:] != at[:-1]) | pc.not_equal(f[1:], f[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:]):
            yield (f[i].as_py(), int(at[i])), b.slice(i, j - i)


def _bits(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b[name].to_numpy(zero_copy_only=False).astype(np.int64)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice: its end state and marked lines for both start states, and whether a record
    begins in it if it starts inside."""
    def row():
        (file, at), (s0, s1), (m0, m1) = key, state, marks
        return pa.RecordBatch.from_pylist([{"_file": file, "_start": at, "out": s0, "into": s1, "marks_out": m0, "marks_in": m1, "begins": begins}], schema)

    schema = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("out", pa.int32()), ("into", pa.int32()), ("marks_out", pa.int64()), ("marks_in", pa.int64()), ("begins", pa.bool_())])
    key = None
    for k, b in _runs(batches):
        if k != key:
            if key is not None:
                yield row()
            key, state, marks, begins = k, (0, 1), (0, 0), False
        out, into, marked = (_bits(b, c) for c in ("_out", "_in", "_mark"))
        (i0, s0), (i1, s1) = (_states(out, into, s) for s in state)
        marks = marks[0] + int(marked[i0 == 0].sum()), marks[1] + int(marked[i1 == 0].sum())
        state, begins = (s0, s1), begins or bool((i1 == 0).any())
    if key is not None:
        yield row()


def _plan(effects: list, one_text: bool) -> dict:
    """Slice -> (place, starts inside, marked lines before it, place where the record open at its start
    begins, whether the next slice goes on with its last record)."""
    out, text, went = {}, None, None
    for n, e in enumerate(sorted(effects, key=lambda e: (e["_file"], e["_start"]))):
        if n == 0 or (e["_file"] != text and not one_text):
            inside, before, record, went = 0, 0, None, None
        text, key = e["_file"], (e["_file"], e["_start"])
        if inside and went is not None:
            out[went][4] = True
        out[key], went = [n, inside, before, record if inside else None, False], key
        if not inside or e["begins"]:
            record = n
        before += e["marks_in"] if inside else e["marks_out"]
        inside = e["into"] if inside else e["out"]
    return out


def _reader(plan: dict, name: str | None, parts: bool):
    """Records of the slices: whole ones, or (``parts``) what other slices hold the rest of."""
    schema = pa.schema([("_file", pa.string()), ("_slice", pa.int32()), ("_pos", pa.int64()), ("value", pa.string()), ("_before", pa.int64()), ("_record", pa.int32())])

    def rows(key, pos, value, before, record=None):
        n = len(pos)
        place = plan[key][0]
        return pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(name or key[0], pa.string()), n), pa.repeat(pa.scalar(place, pa.int32()), n), pa.array((place << 33) + np.asarray(pos, np.int64)),
            value.cast(pa.string()), pa.array(np.asarray(before, np.int64)), pa.repeat(pa.scalar(record, pa.int32()), n)], schema=schema)

    def held_row(key, held, record):
        if (record is not None) != parts:
            return None
        text = "\n".join(x for v in held[2] for x in v.to_pylist())
        return rows(key, [held[0]], pa.array([text], pa.string()), [held[1]], record)

    def at_end(key, held, begun):
        """The record still open at the end of a slice."""
        if held is None:
            return None
        place, _, _, record, goes_on = plan[key]
        return held_row(key, held, (place if goes_on else None) if begun else record)

    def read(batches):
        key = held = None
        for k, b in _runs(batches):
            if k != key:
                if (last := at_end(key, held, begun) if key else None) is not None:
                    yield last
                if k not in plan:
                    raise RuntimeError(f"the slices of {k[0]} changed between two reads")
                key, row, (_, state, before, record, _) = k, 0, plan[k]
                begun = not state                           # the open record began in this slice
                held = (0, before, []) if state else None
            value = b["value"]
            inside, after = _states(_bits(b, "_out"), _bits(b, "_in"), state)
            begins = np.flatnonzero(inside == 0)
            marked = np.where(inside == 0, _bits(b, "_mark"), 0)
            counts = before + np.cumsum(marked) - marked
            first = int(begins[0]) if len(begins) else b.num_rows
            if held is not None:
                held[2].append(value.slice(0, first))
                if len(begins) or not after:
                    if (done := held_row(key, held, None if begun else record)) is not None:
                        yield done
                    held = None
            if len(begins):
                begun = True
                whole = begins[:-1] if after else begins
                if after:
                    at = int(begins[-1])
                    held = (row + at, int(counts[at]), [value.slice(at)])
                if len(whole) and not parts:
                    offsets = np.append(whole, begins[-1] if after else b.num_rows)
                    lines = value if offsets[-1] - offsets[0] == len(whole) else None
                    text = value.slice(first, len(whole)) if lines is not None else pc.binary_join(
                        pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), value), "\n")
                    yield rows(key, row + whole, text, counts[whole])
            row, before, state = row + b.num_rows, before + int(marked.sum()), after
        if (last := at_end(key, held, begun) if key else None) is not None:
            yield last

    return read


def csv_records(spark: SparkSession, path: str, mark: Column | None = None, one_text: bool = False) -> DataFrame:
    """``_file, _slice, _pos, value, _before``: the records of all files under ``path``, line breaks inside
    quoted fields kept; ``_pos`` is unique and ascends by file and place in it.  ``_before`` counts the lines
    outside quotes before the record, in its file, for which ``mark`` (a condition on ``value``) holds.

    ``one_text``: the files, by name, are the parts of one text (as Spark writes a sorted one); records may
    run from one to the next, and ``_file`` is ``path``.

    One read of the files finds the slices' start states; reads of the result take the slices as they are."""
    value = F.col("value")
    quoted = value.contains('"')                            # most lines need no pattern
    lines = spark.read.text(path).select(
        F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"), "value",
        F.when(quoted, ends_open(value)).otherwise(False).alias("_out"),
        F.when(quoted, ends_open(F.concat(F.lit('"'), value))).otherwise(True).alias("_in"),
        (F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))).alias("_mark"))
    plan = _plan(lines.drop("value").mapInArrow(_effects, _EFFECTS).collect(), one_text)    # one row a slice
    name = path if one_text else None
    whole = lines.mapInArrow(_reader(plan, name, False), _RECORDS).drop("_record")
    if not any(inside for _, inside, *_ in plan.values()):
        return whole
    parts = lines.mapInArrow(_reader(plan, name, True), _RECORDS).groupBy("_record").agg(
        F.min_by("_file", "_pos").alias("_file"), F.min_by("_slice", "_pos").alias("_slice"), F.min("_pos").alias("_pos"),
        F.array_sort(F.collect_list(F.struct("_pos", "value"))).alias("_lines"), F.min_by("_before", "_pos").alias("_before"))
    return whole.unionByName(parts.select("_file", "_slice", "_pos", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"), "_before"))
