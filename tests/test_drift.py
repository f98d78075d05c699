import json

from trussline.operators import drift as R

S = "feed_code string, file_no int, row_no int, payload string, name string"


def feed(spark, files):
    rows = [("F", no, i, p if isinstance(p, (str, type(None))) else json.dumps(p), "clash") for no, recs in files.items() for i, p in enumerate(recs)]
    return spark.createDataFrame(rows, S)


def changes(spark, files):
    return sorted((r.file_no, r.field_name, r.kind) for r in R.schema_changes(feed(spark, files)).collect())


def test_added_removed_renamed_retyped(spark):
    files = {
        1: [{"task_id": str(i), "a": i, "b": "x", "n": None, "f": 1.0} for i in range(10)],
        2: [{"task_id": str(i), "A": i if i else 99, "b": True, "n": 3, "f": 1, "c": "q"} for i in range(10)],
        4: [{"task_id": str(i), "A": i} for i in range(10)] + [{"task_id": "1", "A": 1}],
    }
    assert changes(spark, files) == [(2, "A", "renamed"), (2, "b", "retyped"), (2, "c", "added"), (2, "f", "retyped"), (4, "b", "removed"), (4, "c", "removed"), (4, "f", "removed"), (4, "n", "removed")]


def test_no_common_task_or_type_is_no_rename(spark):
    assert changes(spark, {1: [{"task_id": "1", "a": 1}], 2: [{"task_id": "2", "z": 1}]}) == [(2, "a", "removed"), (2, "z", "added")]
    assert changes(spark, {1: [{"task_id": "1", "a": 1}], 2: [{"task_id": "1", "z": "1"}]}) == [(2, "a", "removed"), (2, "z", "added")]


def test_two_renames_at_once_are_matched_one_to_one(spark):
    files = {1: [{"task_id": str(i), "a": i, "b": i % 3} for i in range(20)], 2: [{"task_id": str(i), "y": i % 3, "z": i} for i in range(20)]}
    assert changes(spark, files) == [(2, "y", "renamed"), (2, "z", "renamed")]


def test_broken_null_and_empty_payloads(spark):
    assert changes(spark, {1: [None, "", "{", {"task_id": "1"}], 2: [{"task_id": "1", "a": 1}]}) == [(2, "a", "added")]
    assert changes(spark, {}) == []


def test_unified_follows_renames(spark):
    files = {n: [{"task_id": str(i), name: i} for i in range(5)] for n, name in ((1, "a"), (2, "b"), (3, "c"))}
    rows = R.unified(feed(spark, files)).collect()
    assert len(rows) == 15
    assert all(set(r.fields) == {"task_id", "a"} for r in rows)


def test_a_reused_name_is_a_field_of_its_own(spark):
    files = {1: ["a"], 2: ["b"], 3: ["a", "b"], 4: ["a"], 5: ["a", "b"]}
    told = {"1a": 0, "2b": 0, "3a": 100, "3b": 0, "4a": 100, "5a": 100, "5b": 200}
    made = {n: [{"task_id": str(i)} | {f: i + told[f"{n}{f}"] for f in names} for i in range(5)] for n, names in files.items()}
    got = {(r.file_no, r.row_no): {k: int(v) for k, v in r.fields.items() if k != "task_id"} for r in R.unified(feed(spark, made)).collect()}
    want = {1: {"a": 0}, 2: {"a": 0}, 3: {"a@3": 100, "a": 0}, 4: {"a@3": 100}, 5: {"a@3": 100, "a": 200}}
    assert got == {(n, i): {k: v + i for k, v in x.items()} for n, x in want.items() for i in range(5)}


def test_any_number_of_renames_is_followed(spark):
    rows = R.unified(feed(spark, {n: [{"task_id": "1", f"f{n}": 7}] for n in range(1, 81)})).collect()
    assert len(rows) == 80 and all(r.fields == {"task_id": "1", "f1": "7"} for r in rows)


def test_flooding_prefers_like_names_and_types_without_values():
    s = R.flood([("crt_path_num", ["integer"]), ("note", ["string"])], [("crt_path_no", ["integer"]), ("remark", ["string"])], {})
    assert s["crt_path_num", "crt_path_no"] > max(s["crt_path_num", "remark"], s["note", "crt_path_no"])


def test_flooding_decides_between_equal_values(spark):
    """Three new names hold the old name's values: the one that is like it is the rename."""
    files = {1: [{"task_id": str(i), "crt_path_num": i} for i in range(10)], 2: [{"task_id": str(i), "aa": i, "crt_path_no": i, "zz": i} for i in range(10)]}
    assert changes(spark, files) == [(2, "aa", "added"), (2, "crt_path_no", "renamed"), (2, "zz", "added")]


def test_columns_have_the_united_type(spark):
    payloads = [(1, '{"task_id": 1, "a": 1, "b": 2, "c": true, "d": "x", "e": null}'), (2, '{"task_id": "2", "a": 3, "b": 2.5, "c": "no", "d": null, "extra": [1]}')]
    raw = spark.createDataFrame([("F", n, n, p) for n, p in payloads], "feed_code string, file_no int, row_no int, payload string")
    got = R.wide(raw, ["a", "b", "c", "d", "e", "nope"])
    assert dict(got.dtypes) == {"feed_code": "string", "file_no": "int", "row_no": "int", "task_id": "string", "a": "bigint", "b": "double", "c": "string", "d": "string", "e": "string", "nope": "string", "other_fields": "string"}
    assert [tuple(r)[3:] for r in got.orderBy("file_no").collect()] == [("1", 1, 2.0, "true", "x", None, None, "{}"), ("2", 3, 2.5, "no", None, None, None, '{"extra":"[1]"}')]
    assert R.wide(raw.limit(0), ["a"]).count() == 0
