import random

import pytest

from trussline.operators import hierarchy as H

S = "wbs_id string, parent_wbs_id string, id string, path string"


def brute(links):
    out = {}
    for x in links:
        seen, y = [], x
        while y is not None and y not in seen:
            seen.append(y)
            y = links[y]
        out[x] = ("cycle", min(seen[seen.index(y) :])) if y is not None else ("path", tuple(reversed(seen)))
    return out


@pytest.mark.parametrize("limit", [10**6, 3])
def test_random_forests_with_cycles(spark, limit):
    rng = random.Random(limit)
    ids = [f"N{i:03d}" for i in range(150)]
    raw = {x: rng.choice([None, "", "gone", *ids[:i], *ids[:i], *(ids if rng.random() < 0.03 else ids[max(0, i - 1) : i])]) for i, x in enumerate(ids)}
    rows = [(f" {x}", p and f"{p}\t", "clash", None) for x, p in raw.items()] + [(ids[0], raw[ids[0]], None, None), (None, ids[0], None, None)]
    want = brute({x: p if p in raw else None for x, p in raw.items()})
    got = H.hierarchy(spark.createDataFrame(rows, S), "wbs_id", "parent_wbs_id", max_component=limit)
    kept = {r.id: ("cycle", r.cycle_id) if r.cycle_id else ("path", tuple(r.path)) for r in got.collect()}
    assert kept == want
    assert all(r.depth == len(r.path) - 1 and r.root == r.path[0] for r in got.collect() if r.path)
    below = {(r.id, r.below_id) for r in H.descendants(got).collect()}
    assert below == {(a, x) for x, (k, p) in want.items() if k == "path" for a in p[:-1]}


def test_long_chain_self_loop_and_empty(spark):
    chain = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, None, None) for i in range(700)] + [("s", "s", None, None), ("t", "s", None, None)]
    got = {r.id: r for r in H.hierarchy(spark.createDataFrame(chain, S), "wbs_id", "parent_wbs_id").collect()}
    assert got["c0699"].depth == 699 and got["t"].cycle_id == "s" and not got["t"].on_cycle and got["s"].on_cycle
    assert H.hierarchy(spark.createDataFrame([], S), "wbs_id", "parent_wbs_id").count() == 0


@pytest.mark.parametrize("limit", [10**6, 3])
def test_pairs_around_cycles(spark, limit):
    rng = random.Random(7)
    ids = [f"N{i:03d}" for i in range(120)]
    links = {x: rng.choice([None, *ids[:i], *ids[max(0, i - 2) : i]]) for i, x in enumerate(ids)}
    ring = [f"R{i}" for i in rng.sample(range(9), 9)]
    links |= dict(zip(ring, [*ring[1:], ring[0]])) | {"s": "s", "t": "s", "u": "t", "h0": ring[4], "h1": "h0", "h2": "h1", "h3": ring[8], "a": "b", "b": "a"}
    want = set()
    for x in links:
        seen, y = [], x
        while y is not None and y not in seen:
            seen.append(y)
            y = links[y]
        want |= {(a, x, n) for n, a in enumerate(seen) if n}
    tree = H.hierarchy(spark.createDataFrame([(x, p, None, None) for x, p in links.items()], S), "wbs_id", "parent_wbs_id", max_component=limit)
    got = [(r.id, r.below_id, r.levels) for r in H.all_below(tree, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_cycles_with_long_tails(spark, shuffled):
    """Tails whose ids are below those of their cycle, and cycles of many lengths."""
    rng = random.Random(12)
    links, n = {}, 0
    for length, tail in ((1, 40), (2, 0), (37, 90), (64, 3), (5, 5)):
        ring = [f"Z{n + i:04d}" for i in range(length)]
        n += length
        if shuffled:
            rng.shuffle(ring)
        links |= dict(zip(ring, [*ring[1:], ring[0]], strict=True))
        last = ring[length // 2]
        for i in range(tail):
            x = f"A{n + i:04d}" if i % 2 else f"Z{9999 - n - i}"
            links[x], last = last, x
        n += tail
    got = {r.id: r.cycle_id for r in H.hierarchy(spark.createDataFrame([(x, p, None, None) for x, p in links.items()], S), "wbs_id", "parent_wbs_id").collect()}
    assert got == {x: low for x, (_, low) in brute(links).items()}
