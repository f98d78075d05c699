"""Bulk parse of tab-separated records that sets failing rows apart, with a reason.

Blocks of records under one header are parsed by the Arrow CSV reader. A block in which
anything fails is halved until the failing records are alone in blocks of a few lines, and
only those are read by the strict scanner that names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines per join block: no (file, block) key can hold more.
BLOCK_LINES = 4096
#: Blocks of so many lines are read strictly, line by line: a bulk parse costs as much.
STRICT_LINES = 32
DECIMAL = r"^(?: *[+-]?[0-9]+(?:\.[0-9]+)? *)?$"
#: Patterns of the line contract, by table and field (RE2 and Python read them alike).
VALUE_RULES: dict[str, dict[str, str]] = {
    "TASK": {"task_id": r"^[0-9]{1,18}$", "total_float_hr_cnt": DECIMAL},
    "TASKPRED": {"lag_hr_cnt": DECIMAL},
}
WELL_QUOTED = r'^%R(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*$'

RESULT = "line_id long, file_id string, line_no int, tab string, fields array<string>, vals array<string>, reason string"


def record_lines(lines: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """``%R`` lines of ``tables`` with the table and field names that govern them.

    Header lines are few: a window over them alone gives line ranges, which meet the record
    lines in an equi-join on (file, block of lines), so that a huge file is spread over as
    many keys as it has blocks. Null lines, and records before any ``%T``, are left out.
    """
    text = F.regexp_replace(F.col("line"), r"\r$", "")
    kind = F.substring_index(text, "\t", 1)
    base = lines.select("line_id", "file_id", "line_no", text.alias("line"), kind.alias("kind"))
    by_file = Window.partitionBy("file_id").orderBy("line_no")
    heads = base.where(F.col("kind").isin("%T", "%F", "%E")).dropDuplicates(["file_id", "line_no"])
    rest = F.split(F.col("line"), "\t")
    heads = (
        heads.withColumn("parts", F.transform(F.slice(rest, 2, 1_000_000), lambda x: F.trim(x)))
        .withColumn("tab", F.last(F.when(F.col("kind") == "%T", F.element_at(F.concat("parts", F.array(F.lit(""))), 1)).when(F.col("kind") == "%E", F.lit("")), ignorenulls=True).over(by_file))
        .withColumn("until", F.lead("line_no").over(by_file))
        .where(F.col("tab").isin(*tables))
    )
    ends = lines.groupBy("file_id").agg(F.max("line_no").alias("file_end"))
    spans = (
        heads.join(ends, "file_id")
        .select(
            "file_id", "tab",
            F.when(F.col("kind") == "%F", F.col("parts")).otherwise(F.array().cast("array<string>")).alias("fields"),
            F.col("line_no").alias("_from"),
            F.coalesce(F.col("until"), F.col("file_end") + 1).alias("_until"),
        )
        .withColumn("_blk", F.explode(F.sequence(F.floor(F.col("_from") / BLOCK_LINES), F.floor(F.col("_until") / BLOCK_LINES))))
    )
    records = base.where(F.col("kind") == "%R").drop("kind").withColumn("_blk", F.floor(F.col("line_no") / BLOCK_LINES))
    inside = (F.col("line_no") > F.col("_from")) & (F.col("line_no") < F.col("_until"))
    return records.join(spans, ["file_id", "_blk"]).where(inside).select("line_id", "file_id", "line_no", "tab", "fields", "line")


def scan_strictly(line: str) -> list[str] | None:
    """Values of one record, or None if its quotes are broken."""
    vals: list[str] = []
    at, end = 2, len(line)
    while at < end:
        at += 1  # the tab
        if at < end and line[at] == '"':
            piece, at = [], at + 1
            while True:
                stop = line.find('"', at)
                if stop < 0:
                    return None
                piece.append(line[at:stop])
                if line.startswith('""', stop):
                    piece.append('"')
                    at = stop + 2
                    continue
                at = stop + 1
                break
            if at < end and line[at] != "\t":
                return None
            vals.append("".join(piece))
        else:
            stop = line.find("\t", at)
            stop = end if stop < 0 else stop
            if '"' in line[at:stop]:
                return None
            vals.append(line[at:stop])
            at = stop
    return vals


def _bulk(lines: pa.Array, fields: list[str], rules: Mapping[str, str]) -> list[pa.Array] | None:
    """Columns of a block of well-quoted records, or None if any record in it fails."""
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer()
    names = [str(i) for i in range(len(fields) + 1)]
    try:
        table = pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 16, len(data) + 2)),
            parse_options=pacsv.ParseOptions(delimiter="\t", newlines_in_values=False, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if table.num_rows != len(lines):
        return None
    cols = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns[1:]]
    for name, rule in rules.items():
        if name in fields and not pc.all(pc.match_substring_regex(cols[fields.index(name)], rule)).as_py():
            return None
    return cols


def _rows_of(cols: list[pa.Array], n: int) -> pa.Array:
    """Columns of ``n`` records as one list of values for each record."""
    if not cols:
        return pa.array([[]] * n, pa.list_(pa.string()))
    by_row = np.arange(len(cols) * n).reshape(len(cols), n).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(cols)), pa.concat_arrays(cols).take(pa.array(by_row)))


def _strict(lines: pa.Array, fields: list[str], rules: Mapping[str, str]) -> Iterator[tuple[list[str] | None, str | None]]:
    """(values, reason) of each record, read by the strict scanner."""
    checks = [(fields.index(n), re.compile(r[1:-1]).fullmatch) for n, r in rules.items() if n in fields]
    for line in lines.to_pylist():
        vals = scan_strictly(line)
        if vals is None:
            yield None, "quoting"
        elif len(vals) != len(fields):
            yield vals, "columns"
        else:
            yield vals, "value" if any(not fits(vals[i]) for i, fits in checks) else None


Piece = tuple[np.ndarray, pa.Array, pa.Array]


def _parse(lines: pa.Array, quoted: np.ndarray, at: np.ndarray, fields: list[str], rules: Mapping[str, str], keep: str) -> Iterator[Piece]:
    """Pieces (places, values, reasons) of the records that ``keep`` asks for, in order."""
    if len(lines) <= STRICT_LINES:
        told = [(i, v, r) for i, (v, r) in zip(at, _strict(lines, fields, rules), strict=True) if keep == "all" or (r is None) == (keep == "good")]
        if told:
            yield np.array([i for i, _, _ in told]), pa.array([v for _, v, _ in told], pa.list_(pa.string())), pa.array([r for _, _, r in told], pa.string())
        return
    cols = _bulk(lines, fields, rules) if quoted.all() else None
    if cols is not None:
        if keep != "bad":
            yield at, _rows_of(cols, len(lines)), pa.nulls(len(lines), pa.string())
        return
    half = len(lines) // 2
    yield from _parse(lines[:half], quoted[:half], at[:half], fields, rules, keep)
    yield from _parse(lines[half:], quoted[half:], at[half:], fields, rules, keep)


def parse_records(records: DataFrame, rules: Mapping[str, Mapping[str, str]] = VALUE_RULES, keep: str = "all") -> DataFrame:
    """Every record of ``records`` once, parsed, with ``reason`` null or the first failure.

    ``records``: line_id, file_id, line_no, tab, fields, line (as by :func:`record_lines`).
    Reasons, the first that applies: ``quoting``, ``columns`` (number of values), ``value``.
    A record with broken quotes has null ``vals``. ``keep``: all, good or bad rows. Repeated
    rows count each time; null lines are left out; extra columns of the input are ignored; an
    empty input gives none.
    """
    plain = {t: dict(r) for t, r in rules.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, lines = batch.column("head").cast(pa.string()).dictionary_encode(), batch.column("line").cast(pa.string())
            codes, quoted = heads.indices.to_numpy(), np.asarray(pc.match_substring_regex(lines, WELL_QUOTED))
            for code, head in enumerate(heads.dictionary.to_pylist()):
                tab, *fields = head.split("\t")
                rows = np.flatnonzero(codes == code)
                pieces = [*_parse(lines.take(pa.array(rows)), quoted[rows], rows, fields, plain.get(tab, {}), keep)]
                if not pieces:
                    continue
                at = pa.array(np.concatenate([p[0] for p in pieces]))
                same = pa.array(np.zeros(len(at), dtype=np.int32))
                part = batch.take(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("line_id"), part.column("file_id").cast(pa.string()), part.column("line_no").cast(pa.int32()), pa.array([tab], pa.string()).take(same),
                        pa.array([fields], pa.list_(pa.string())).take(same), pa.concat_arrays([p[1] for p in pieces]), pa.concat_arrays([p[2] for p in pieces]),
                    ],
                    names=["line_id", "file_id", "line_no", "tab", "fields", "vals", "reason"],
                )

    head = F.array_join(F.concat(F.array("tab"), "fields"), "\t")
    return records.where(F.col("line").isNotNull()).select("line_id", "file_id", "line_no", head.alias("head"), "line").mapInArrow(run, RESULT)


def rejected(lines: DataFrame, tables: tuple[str, ...] = ("TASK", "TASKPRED")) -> DataFrame:
    """``line_id`` and ``reason`` of the records that break the line contract."""
    return parse_records(record_lines(lines, tables), keep="bad").select("line_id", "reason")


def loaded(lines: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    """Valid records of one table; a column absent from a file's header is ``''``."""
    rows = parse_records(record_lines(lines, (table,)), keep="good")
    at = lambda c: F.array_position("fields", F.lit(c)).cast("int")
    pick = [F.coalesce(F.when(at(c) > 0, F.get(F.col("vals"), at(c) - 1)), F.lit("")).alias(c) for c in columns]
    return rows.select("line_id", "file_id", "line_no", *pick)
