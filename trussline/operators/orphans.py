"""References whose target is missing, deleted or loaded later, for keys of any width."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.operators.common import salted_join


def orphan_references(
    refs: DataFrame,
    keys: DataFrame,
    columns: Mapping[str, str],
    since: str,
    spread: str,
    match: str = "simple",
    hot: Column | None = None,
    always: Sequence[str] = (),
) -> DataFrame:
    """``refs`` rows with a failing reference, plus its ``kind``.

    ``columns`` maps each referring column to the key column it names; both are blank-trimmed
    with null for blank. ``keys`` also holds ``key_since`` (first load) and ``key_deleted``.
    References are grouped by the mask of their null columns and each mask meets the keys on
    its non-null columns only. ``match`` states what a partly null reference means:

    * ``simple``: it is not checked;
    * ``full``: it is wrong in itself, kind ``partial``;
    * ``partial``: some key must agree on the non-null columns.

    A reference that is null throughout is never checked. kind is the first that applies of
    ``missing``, ``deleted`` (every agreeing key is deleted) and ``late`` (every live agreeing
    key was first loaded after ``refs[since]``; a null time is not late). ``hot`` marks the
    frequent keys, over the referring columns; their rows are salted by ``spread``.
    ``always`` names referring columns that are never null and need no mask.
    Repeated rows come out as often as they occur; empty tables give no rows or ``missing``.
    """
    names = [*columns]
    masked = [c for c in names if c not in always]
    parts: list[DataFrame] = []
    for mask in product([True, False], repeat=len(masked)):
        if not any(mask):
            continue
        whole = all(mask)
        if not whole and match == "simple":
            continue
        own = refs.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() if m else F.col(c).isNull() for c, m in zip(masked, mask, strict=True)]))
        if not whole and match == "full":
            parts.append(own.withColumn("kind", F.lit("partial")))
            continue
        used = [c for c in names if c in always or mask[masked.index(c)]]
        targets = keys.select(*[F.col(columns[c]).alias(c) for c in used], "key_since", "key_deleted").dropna(subset=used)
        targets = targets.groupBy(*used).agg(
            F.min(F.when(~F.col("key_deleted"), F.col("key_since"))).alias("_since"), F.min("key_deleted").alias("_deleted"), F.count(F.lit(1)).alias("_there")
        )
        is_hot = hot if whole else None
        joined = own.join(targets, used, "left") if is_hot is None else salted_join(own, targets, used, is_hot, F.col(spread))
        kind = F.when(F.col("_there").isNull(), "missing").when(F.col("_deleted"), "deleted").when(F.col("_since") > F.col(since), "late")
        parts.append(joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*refs.columns, "kind"))
    return reduce(DataFrame.unionByName, parts)


def records(df: DataFrame, key: str, *carry: str) -> DataFrame:
    """One row per blank-trimmed key: first load, whether deleted, and the first delivery's values.

    Rows without a key are no records.
    """
    from trussline.operators.common import key_of

    vals = F.min_by(F.struct(*[F.col(c) for c in carry]), F.struct("loaded_at", *carry)).alias("_v") if carry else None
    rows = df.select(key_of(key).alias("rec"), "loaded_at", "delete_date", *[key_of(c).alias(c) for c in carry]).where(F.col("rec").isNotNull())
    out = rows.groupBy("rec").agg(F.min("loaded_at").alias("first_load"), F.max(F.col("delete_date").isNotNull()).alias("deleted"), *([vals] if carry else []))
    return out.select("rec", "first_load", "deleted", *[F.col(f"_v.{c}").alias(c) for c in carry])


def schedule_orphans(task: DataFrame, taskpred: DataFrame, projwbs: DataFrame, calendar: DataFrame) -> DataFrame:
    """Failing references of TASKPRED and TASK: ref_field, rec_id, month, kind.

    The three target tables form one key set with the composite key (table, id), so that one
    salted join serves all four reference columns. Frequent targets (a calendar that a third
    of all tasks use) are found by a bounded sketch over the raw columns first.
    """
    from trussline.operators.common import hot_values, key_of

    tasks, preds = records(task, "task_id", "wbs_id", "clndr_id"), records(taskpred, "task_pred_id", "task_id", "pred_task_id")

    def fields(df: DataFrame, **of: tuple[str, str]) -> DataFrame:
        """Long form, one row per reference column; ``of``: column = (name, target table)."""
        each = F.inline(F.array(*[F.struct(F.lit(n).alias("ref_field"), F.lit(t).alias("target"), F.col(c).alias("ref")) for c, (n, t) in of.items()]))
        return df.where(~F.col("deleted")).select(F.col("rec").alias("rec_id"), "first_load", each)

    refs = fields(preds, task_id=("taskpred.task_id", "task"), pred_task_id=("taskpred.pred_task_id", "task")).unionByName(
        fields(tasks, wbs_id=("task.wbs_id", "projwbs"), clndr_id=("task.clndr_id", "calendar"))
    )
    target = lambda df, t: df.select(F.lit(t).alias("key_table"), F.col("rec").alias("key"), F.col("first_load").alias("key_since"), F.col("deleted").alias("key_deleted"))
    keys = target(tasks, "task").unionByName(target(records(projwbs, "wbs_id"), "projwbs")).unionByName(target(records(calendar, "clndr_id"), "calendar"))
    of_task = hot_values(task.select(key_of("wbs_id").alias("projwbs"), key_of("clndr_id").alias("calendar")), ["projwbs", "calendar"])
    of_pred = hot_values(taskpred.select(key_of("pred_task_id").alias("p"), key_of("task_id").alias("t")), ["p", "t"])
    frequent = {**of_task, "task": [*of_pred["p"], *of_pred["t"]]}
    hot = reduce(lambda a, b: a | b, [(F.col("target") == t) & F.col("ref").isin(v) for t, v in frequent.items() if v], F.lit(False))
    return orphan_references(refs.where(F.col("ref").isNotNull()), keys, {"target": "key_table", "ref": "key"}, "first_load", "rec_id", hot=hot, always=("target",))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Failing references per referring column, kind and month of the record's first load."""
    return orphans.groupBy("ref_field", "kind", F.date_format("first_load", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
