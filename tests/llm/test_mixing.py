"""Mixing: targets against the rule carried out step by step, and what is taken against the contract."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.llm import mixing


def _targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; those above their limit stop there and the excess goes to the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not above:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= above


def _docs(spark, rows):
    df = spark.createDataFrame([(i, s, t) for i, s, t in rows], "doc_id long, source string, text string")
    return df.selectExpr("*", "1 as nth", "2 as `first`", "3 as index", "'x' as block", "4 as size")


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mix(spark, block):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        source = rng.choice(["a", "a", "a", "b", "B", "é", "中", None, "tiny"])
        words = rng.choice([0, 1, 3, 20, 200]) if source != "tiny" else 1
        rows.append((i if i % 50 else None, source, " ".join(["w"] * words) if words else rng.choice([None, "", " \n"])))
    rows += [rows[5]] * 3
    docs = _docs(spark, rows)
    got = mixing.mix(docs, block=block).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    by = {}
    for r in got:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    expected = {}
    for s in sizes:
        key = sizes[s], round(want[s], 6)
        expected[key] = expected.get(key, 0) + round(want[s])
    assert set(by) == set(expected)
    for key, part in by.items():
        assert abs(sum(r.taken for r in part) - expected[key]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, block=block).collect()), key=str)


def test_slots_are_a_permutation(spark):
    rows = [(i, "abc"[i % 3], "w " * (i % 40)) for i in range(200)]
    per = mixing.targets(mixing.sized(_docs(spark, rows)))
    got = mixing.slots(per, block=5, shard_slots=64).collect()
    places = [(r.shard, r.place) for r in got]
    assert len(set(places)) == len(places)
    assert sorted(s * 64 + p for s, p in places) == list(range(len(places)))
    counts = {}
    for r in got:
        counts[r.shard, r.nth] = counts.get((r.shard, r.nth), 0) + 1
    drawn = mixing.shard_counts(mixing.goals(per, 5, 0), 0, 64).collect()
    assert counts == {(r.shard, r.nth): r["count"] for r in drawn}
    for nth in range(3):  # no block is taken more often than there are passes
        size = next(r.source_size for r in per.collect() if r.nth == nth)
        mine = [r for r in got if r.nth == nth]
        assert all(0 <= r["index"] < -(-size // 5) and 0 < r.words <= r.length for r in mine)
        times = {}
        for r in mine:
            times[r["index"]] = times.get(r["index"], 0) + 1
        assert max(times.values()) - min(times.values()) <= 1 or min(times.values()) == 0
    shards = {r.shard for r in got}
    assert len(shards) > 1 and all(len({r.nth for r in got if r.shard == s}) == 3 for s in shards if s < max(shards))


@pytest.mark.parametrize("most", [2, 3])
def test_what_is_taken_is_what_the_slots_hold(spark, most):
    """Word by word: documents packed in Python, each slot's words counted for the document that each stands in."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "b", None]), " ".join(["w"] * rng.choice([0, 1, 4, 9, 60]))) for i in range(150)]
    docs = _docs(spark, rows)
    sizes = mixing.sized(docs).cache()
    per = mixing.targets(sizes, most=most)
    owner = {}
    for r in mixing.packed(sizes, per).collect():
        for word in range(r["first"], r["first"] + r.size):
            assert owner.setdefault((r.nth, word), r.doc_id) == r.doc_id
    want, shards, seen = {}, {}, {}
    for r in mixing.slots(per, block=7, shard_slots=16).collect():
        for word in range(r["index"] * 7, r["index"] * 7 + r.words):
            d = owner[r.nth, word]
            want[d] = want.get(d, 0) + 1
            shards[d] = min(r.shard, shards.get(d, r.shard))
            seen.setdefault(d, set()).add((r.shard, r.place))
    got = mixing.mix(docs, block=7, shard_slots=16, most=most).collect()
    assert {r.doc_id: r.taken for r in got if r.taken} == want and len({r.first_shard for r in got}) > 2
    assert {r.doc_id: r.first_shard for r in got if r.taken} == shards
    assert {r.doc_id: r.slots for r in got if r.taken} == {d: len(x) for d, x in seen.items()}
    assert all(r.taken <= most * r.size for r in got)


def test_walk_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = spark.range(n).select(mixing._walk(F.col("id"), F.lit(n).cast("long"), F.lit(7)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_nothing_to_mix(spark):
    assert mixing.mix(_docs(spark, [(1, "a", None)]).limit(0)).count() == 0
    only = mixing.mix(_docs(spark, [(1, "a", None), (2, None, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in only] == [(0, 0, 0.0)] * 2
