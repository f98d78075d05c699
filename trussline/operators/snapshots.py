"""Changes between consecutive full snapshots, by a merge over key ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.exprs import STATUS_LABELS
from trussline.operators.common import blank_trim, key_of, salted_join

# Abbreviated month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

RESULT = "proj_id string, task_code string, snap_no int, kind string, old_status string, new_status string, old_end string, new_end string"


def status_meaning(c: Column | str) -> Column:
    """Status code in lower case, for a code or its label; null for blank."""
    low = F.lower(key_of(c))
    labels = {v.lower(): k.lower() for k, v in STATUS_LABELS.items()}
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[low], low)


def minute_meaning(c: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm`` of a year-first or month-name date; other text in lower case; null for blank."""
    low = F.lower(key_of(c))
    clock = r"(?:[t ]+(\d{1,2}):(\d{2})(?::\d{2}(?:\.\d+)?)?)?z?$"
    first, named = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){clock}", rf"^(\d{{1,2}})[-/. ]([a-z]{{3}})[a-z]*[-/., ]+(\d{{4}}){clock}"
    american = rf"^([a-z]{{3}})[a-z]*[-/. ]+(\d{{1,2}})[-/., ]+(\d{{4}}){clock}"
    two = lambda x: F.lpad(F.when(x == "", "0").otherwise(x), 2, "0")
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])

    def told(rule: str, y: int, m: int, d: int, name: bool) -> Column:
        g = lambda i: F.regexp_extract(low, rule, i)
        month = number[g(m)] if name else two(g(m))
        return F.concat(g(y), F.lit("-"), month, F.lit("-"), two(g(d)), F.lit(" "), two(g(4)), F.lit(":"), two(g(5)))

    plain = low.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2})?$")
    return F.coalesce(F.when(plain, F.substring(low, 1, 16)).when(low.rlike(first), told(first, 1, 2, 3, False)).when(low.rlike(named), told(named, 3, 2, 1, True)).when(low.rlike(american), told(american, 3, 1, 2, True)), low)


def snapshot_changes(snaps: DataFrame) -> DataFrame:
    """Added, removed and changed tasks between consecutive snapshots of each project.

    A task is (proj_id, task_code), trimmed and in upper case; rows lacking either are no
    tasks. Within a snapshot the row with the latest ``loaded_at`` counts (of equal times the
    greatest values; a null time is the earliest). Snapshots are consecutive for a project if
    it has rows in both and in none between; its first gives no changes. Rows are range-
    partitioned and sorted by task once, so a large project is spread over many ranges, and
    each range is read as a merge: one pointer stands on the task's row in the older snapshot
    and one on its row in the newer. Only two rows are held at any time.
    """
    upper = lambda c: F.upper(key_of(c))
    rows = snaps.select(
        upper("proj_id").alias("proj_id"), upper("task_code").alias("task_code"), "snap_no", "loaded_at",
        status_meaning("status_code").alias("status"), minute_meaning("target_end_date").alias("end"),
    ).where(F.col("proj_id").isNotNull() & F.col("task_code").isNotNull() & F.col("snap_no").isNotNull())
    by_project = Window.partitionBy("proj_id").orderBy("snap_no")
    delivered = rows.select("proj_id", "snap_no").distinct().select("proj_id", "snap_no", F.row_number().over(by_project).alias("nth"), F.lead("snap_no").over(by_project).alias("next_no"))
    placed = salted_join(rows, delivered, ["proj_id", "snap_no"], None, F.col("task_code"), "inner", salts=16)
    ranged = placed.repartitionByRange("proj_id", "task_code").sortWithinPartitions(
        "proj_id", "task_code", "snap_no", F.col("loaded_at").desc_nulls_last(), F.col("status").desc(), F.col("end").desc()
    )
    return ranged.select("proj_id", "task_code", "snap_no", "nth", "next_no", "status", "end").mapInArrow(_merge, RESULT)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Older and newer pointer over rows sorted by task and snapshot, a batch of pairs at a time.

    The newer pointer stands on every row once, the older one on the row before it; the last
    row of a batch waits for the next.
    """
    names = ["proj_id", "task_code", "snap_no", "kind", "old_status", "new_status", "old_end", "new_end"]
    waiting: pa.Table | None = None

    def told(rows: pa.Table, kind: str, snap: str, old: pa.Table | None, new: pa.Table | None) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            none = pa.nulls(rows.num_rows, pa.string())
            pick = lambda t, c: none if t is None else t[c]
            cols = [rows["proj_id"], rows["task_code"], rows[snap], pa.array([kind], pa.string()).take(pa.array(np.zeros(rows.num_rows, dtype=np.int32))), pick(old, "status"), pick(new, "status"), pick(old, "end"), pick(new, "end")]
            yield from pa.table(cols, names=names).combine_chunks().to_batches()

    def gone(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(pc.is_valid(rows["next_no"]))
        yield from told(rows, "removed", "next_no", rows, None)

    def came(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(pc.greater(rows["nth"], 1))
        yield from told(rows, "added", "snap_no", None, rows)

    def same(a: pa.Table, b: pa.Table, *columns: str) -> pa.ChunkedArray:
        """Row by row whether the columns agree, nulls with nulls."""
        out = pa.chunked_array([pa.array(np.ones(a.num_rows, dtype=bool))])
        for c in columns:
            equal = pc.fill_null(pc.equal(a[c], b[c]), False)
            out = pc.and_(out, pc.or_(equal, pc.and_(pc.is_null(a[c]), pc.is_null(b[c]))))
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        first = waiting is None
        rows = rows if first else pa.concat_tables([waiting, rows])
        # Of the deliveries of one snapshot the first counts.
        again = same(rows[1:], rows[:-1], "proj_id", "task_code", "snap_no")
        rows = pa.concat_tables([rows[:1], rows[1:].filter(pc.invert(again))])
        old, new = rows[:-1], rows[1:]
        if first:
            yield from came(rows[:1])
        step = pc.and_(same(old, new, "proj_id", "task_code"), pc.equal(new["nth"], pc.add(old["nth"], 1)))
        moved = pc.and_(step, pc.invert(same(old, new, "status", "end")))
        yield from told(new.filter(moved), "changed", "snap_no", old.filter(moved), new.filter(moved))
        yield from gone(old.filter(pc.invert(step)))
        yield from came(new.filter(pc.invert(step)))
        waiting = rows[-1:]
    if waiting is not None:
        yield from gone(waiting)
