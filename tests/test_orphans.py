from datetime import datetime

from pyspark.sql import functions as F

from trussline.operators.common import hot_values, salted_join
from trussline.operators.orphans import orphan_references, schedule_orphans

D = [datetime(2025, 1, d) for d in range(1, 10)]
REC = "loaded_at timestamp, delete_date timestamp"


def test_kinds_blanks_padding_and_repeats(spark):
    task = spark.createDataFrame([(" 1", "W1 ", "C1", D[2], None), ("1", "W1", "C1", D[5], None), ("2", "W9", " ", D[2], None), ("3", "W2", None, D[2], D[3]), ("4", "W3", "C2", D[0], None), ("5", "W2", "C1", None, None)], f"task_id string, wbs_id string, clndr_id string, {REC}")
    pred = spark.createDataFrame([("p1", "1", "3", D[0], None), ("p2", "1", "\t2", D[4], None), ("p3", "", "7", D[4], None), (None, "8", "8", D[4], None)], f"task_pred_id string, task_id string, pred_task_id string, {REC}")
    wbs = spark.createDataFrame([("W1", D[0], None), ("W2", D[0], D[1]), ("W2", D[0], None), ("W3", D[1], None)], f"wbs_id string, {REC}")
    cal = spark.createDataFrame([("C1", D[0], None)], f"clndr_id string, {REC}")
    got = {(r.ref_field, r.rec_id, r.kind) for r in schedule_orphans(task, pred, wbs, cal).collect()}
    assert got == {
        ("taskpred.task_id", "p1", "late"), ("taskpred.pred_task_id", "p1", "deleted"), ("taskpred.pred_task_id", "p3", "missing"),
        ("task.wbs_id", "2", "missing"), ("task.wbs_id", "4", "late"), ("task.clndr_id", "4", "missing"), ("task.wbs_id", "5", "deleted"),
    }


def test_empty_tables(spark):
    none = lambda cols: spark.createDataFrame([], f"{cols}, {REC}")
    assert schedule_orphans(none("task_id string, wbs_id string, clndr_id string"), none("task_pred_id string, task_id string, pred_task_id string"), none("wbs_id string"), none("clndr_id string")).count() == 0


def test_match_semantics_of_composite_keys(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "z"), (4, None, None), (5, "b", "x")], "rec int, u string, v string").withColumn("at", F.lit(None).cast("timestamp"))
    keys = spark.createDataFrame([("a", "x"), ("a", "y")], "ku string, kv string").withColumns({"key_since": F.lit(D[0]), "key_deleted": F.lit(False)})
    run = lambda m: {(r.rec, r.kind) for r in orphan_references(refs, keys, {"u": "ku", "v": "kv"}, "at", "rec", m).collect()}
    assert run("simple") == {(5, "missing")}
    assert run("full") == {(5, "missing"), (2, "partial"), (3, "partial")}
    assert run("partial") == {(5, "missing"), (3, "missing")}


def test_salted_join_equals_a_plain_one_with_a_hot_key(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("4", 3)], "k string, v int")
    hot = hot_values(left, ["k"])["k"]
    assert hot == ["hot"]
    got = salted_join(left, right, ["k"], F.col("k").isin(hot), F.col("id"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
