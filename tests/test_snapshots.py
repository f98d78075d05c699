from datetime import datetime

from trussline.operators.snapshots import minute_meaning, snapshot_changes, status_meaning

S = "snap_no int, proj_id string, task_code string, status_code string, target_end_date string, loaded_at timestamp, kind string"
T = [datetime(2025, 1, d) for d in range(1, 9)]


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], S)
    return sorted((r.proj_id, r.task_code, r.snap_no, r.kind) for r in snapshot_changes(df).collect())


def test_added_removed_changed_and_gaps(spark):
    rows = [
        (1, "p", "A", "TK_Active", "2026-01-02 08:00", T[0]), (1, "p", "B", None, "", T[0]), (1, "p", "C", "TK_Active", None, T[0]),
        (3, " P", "a ", "in progress", "02-Jan-2026 08:00:30", T[0]), (3, "p", "B", "", None, T[0]), (3, "p", "D", "x", None, T[0]),
        (4, "p", "A", "Complete", "2026/1/2 8:00", T[0]), (4, "p", "C", "TK_Active", None, T[0]), (4, "p", "B", None, "2026-1-2T08:00:00", T[0]),
        (2, "q", "A", "TK_Active", None, T[0]), (9, "q", "A", "TK_Complete", None, T[1]), (9, "q", "A", "TK_Active", None, T[2]),
        (9, "q", None, "x", None, T[0]), (9, None, "A", "x", None, T[0]),
    ]
    assert changes(spark, rows) == [("P", "A", 4, "changed"), ("P", "B", 4, "changed"), ("P", "C", 3, "removed"), ("P", "C", 4, "added"), ("P", "D", 3, "added"), ("P", "D", 4, "removed")]


def test_empty_and_single_snapshot(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "p", "A", "x", "y", T[0])]) == []


def test_meanings(spark):
    dates = ["2026-01-02 03:04", "2026/1/2 3:04", "02-Jan-2026 03:04", "Jan 2, 2026 03:04", "2026-01-02T03:04:59Z", "2026-01-02", "soon", " ", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(dates)], "i int, x string").orderBy("i").select(minute_meaning("x")).collect()]
    assert got == ["2026-01-02 03:04"] * 5 + ["2026-01-02 00:00", "soon", None, None]
    got = [r[0] for r in spark.createDataFrame([("Not Started",), (" tk_active",), ("",)], "x string").select(status_meaning("x")).collect()]
    assert got == ["tk_notstart", "tk_active", None]


def test_large_random_snapshots_match_brute_force(spark):
    import random

    rng = random.Random(4)
    rows, held = [], {}
    for s in range(1, 6):
        for p in "pqr":
            if rng.random() < 0.3:
                continue
            snap = {f"T{i}": rng.choice(["TK_Active", "TK_Complete"]) for i in range(200) if rng.random() < 0.8}
            held.setdefault(p, []).append((s, snap))
            rows += [(s, p, c, v, None, T[0]) for c, v in snap.items()]
    want = []
    for p, snaps in held.items():
        for (_, a), (s, b) in zip(snaps, snaps[1:]):
            want += [(p.upper(), c, s, "added" if c not in a else "removed" if c not in b else "changed") for c in a.keys() | b.keys() if a.get(c) != b.get(c)]
    assert changes(spark, rows) == sorted(want)
