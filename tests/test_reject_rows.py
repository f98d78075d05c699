import random

from hypothesis import given, settings
from hypothesis import strategies as st

from trussline.operators import reject_rows as R

SCHEMA = "line_id long, file_id string, line_no int, line string, reason string"


def lines(spark, rows, file="F"):
    return spark.createDataFrame([(i, file, i, r, "clash") for i, r in enumerate(rows)], SCHEMA)


def reasons(df):
    return {r["line_id"]: r["reason"] for r in R.rejected(df).collect()}


HEAD = ["ERMHDR\t24", "%T\tTASK", "%F\ttask_id\ttask_name\ttotal_float_hr_cnt"]


def test_reasons_in_order_and_repeated_rows(spark):
    rows = HEAD + ["%R\t1\ta\t8", "%R\tx\ta", '%R\tx\ta"\t8', "%R\t1\ta\t8d", "%R\t1\t\t", '%R\t"2"\t"a\tb ""q"""\t -8.5 ', "%R\t1\ta\t8d", "%R\t1\ta\t8\r", None, "", "\r", "%E", "%R\t9"]
    assert reasons(lines(spark, rows)) == {4: "columns", 5: "quoting", 6: "value", 9: "value"}


def test_rows_before_fields_have_no_columns(spark):
    assert reasons(lines(spark, ["%T\tTASK", "%R\t1", "%F\ttask_id", "%R\t1"])) == {1: "columns"}


def test_loaded_rows_and_absent_column(spark):
    got = R.loaded(lines(spark, HEAD + ["%R\t1\t\"a\"\"b\"\t8", "%R\tz\ta\t8"]), "TASK", ("task_id", "task_name", "cstr_type2")).collect()
    assert [(r.task_id, r.task_name, r.cstr_type2) for r in got] == [("1", 'a"b', "")]


def test_empty_table(spark):
    assert reasons(lines(spark, [])) == {}


def test_long_file_over_many_blocks_bisects_like_the_strict_scanner(spark):
    rng = random.Random(1)
    body = [rng.choice(["%R\t{0}\tname {0}\t8", '%R\t{0}\t"n\t{0}"\t', "%R\t{0}\tn\t8\t9", '%R\t{0}\tn"\t8', "%R\t{0}\tn\t8h"] if rng.random() < 0.1 else ["%R\t{0}\tname\t8"]).format(i) for i in range(9000)]
    got = reasons(lines(spark, HEAD + body))
    want = {}
    for i, line in enumerate(body, len(HEAD)):
        v = R.scan_strictly(line)
        if v is None:
            want[i] = "quoting"
        elif len(v) != 3:
            want[i] = "columns"
        elif not v[2].replace("8", "").strip() == "":
            want[i] = "value"
    assert got == want


def test_very_long_value(spark):
    assert reasons(lines(spark, HEAD + ["%R\t1\t" + "x" * 2_000_000 + "\t8"] * 12)) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a"\t ', max_size=6), min_size=1, max_size=5))
def test_strict_scanner_reads_what_was_quoted(values):
    line = "%R\t" + "\t".join('"' + v.replace('"', '""') + '"' for v in values)
    assert R.scan_strictly(line) == values
