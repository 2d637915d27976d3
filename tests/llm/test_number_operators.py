"""Percentiles, packing and mixing against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphquilt.llm import mixing, packing, percentiles
from graphquilt.llm.tokens import encoding

SCHEMA = "id long, timestamp double, tool string, latency_ms double, result_size long, v string"


def brute(values, p):
    v = sorted(values)
    pos = (len(v) - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    return v[lo] + (v[hi] - v[lo]) * (pos - lo)


@pytest.fixture
def log(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        tool = rng.choice(["hot"] * 6 + ["a", "b", None])
        lat = 7.0 if tool == "b" else rng.choice([None, float("nan"), 0.0, -1.5, rng.lognormvariate(3, 2)])
        rows.append((i, 1735689600.0 + 3600 * (i % 100), tool, lat, rng.choice([0, i, 2**60 + i, None]), "clash"))
    rows += rows[:50]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_exact_percentiles(log, spark):
    rows, df = log
    want = defaultdict(list)
    for r in set(map(str, rows)) and {r[0]: r for r in rows}.values():
        if r[3] is not None and not math.isnan(r[3]):
            want[("latency_ms", r[2])].append(r[3])
        if r[4] is not None:
            want[("result_size", r[2])].append(r[4])
    got = percentiles.exact(percentiles.values(df), ["tool"]).collect()
    assert len(got) == len(want) * len(percentiles.PERCENTILES)
    for r in got:
        v = sorted(want[(r.metric, r.tool)])
        assert r.n == len(v)
        assert r.value == pytest.approx(brute(v, r.p), rel=1e-12)
        if r.metric == "result_size":
            assert r.lower_exact == v[math.floor((len(v) - 1) * r.p)]
    assert percentiles.report(df.limit(0)).count() == 0


def test_merged_summaries_keep_their_bound(log):
    _, df = log
    v = percentiles.values(df)
    est = percentiles.estimate(percentiles.merge(percentiles.summary(v, ["tool", "day"]), ["tool"]), ["tool"])
    ex = {(r.metric, r.tool, r.p): r for r in percentiles.exact(v, ["tool"]).collect()}
    for r in est.collect():
        e = ex[(r.metric, r.tool, r.p)]
        assert abs(r.value - e.lower_stat) <= r.relative_error * abs(e.lower_stat) + 1e-9 and r.n == e.n


def brute_best_fit(sizes, caps):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if b[0] >= s]
        if fit:
            b = min(fit, key=lambda x: x[0])
        else:
            b = [caps[-1], []]
            bins.append(b)
        b[0] -= s
        b[1].append(s)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_histogram_plan_equals_best_fit_decreasing(sizes):
    hist = defaultdict(int)
    for s in sizes:
        hist[s] += 1
    placed, bins = packing.plan(dict(hist), [40])
    assert sum(b[1] - b[0] for b in bins) == len(brute_best_fit(sizes, [40]))
    assert sum((b[1] - b[0]) * b[3] for b in bins) == sum(sizes)
    check(packing.with_capacity(placed, bins), hist)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=100))
def test_variable_capacities_hold_their_contents(sizes):
    hist = defaultdict(int)
    for s in sizes:
        hist[s] += 1
    placed, bins = packing.plan(dict(hist), [16, 32, 64])
    assert all(b[2] in (16, 32, 64) and b[3] <= b[2] and (b[2] == 16 or b[3] > b[2] // 2 or b[3] > 16) for b in bins)
    check(packing.with_capacity(placed, bins), hist)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 96), max_size=80))
def test_capacities_are_chosen_jointly(sizes):
    hist = defaultdict(int)
    for s in sizes:
        hist[s] += 1
    caps = [16, 40, 64, 96]
    unused = lambda bins: sum((hi - lo) * (cap - used) for lo, hi, cap, used, _ in bins)
    placed, bins = packing.joint(dict(hist), caps)
    check(packing.with_capacity(placed, bins), hist)
    for k in range(4):
        for choice in combinations(caps[:-1], k):
            assert unused(bins) <= unused(packing.plan(dict(hist), [*choice, 96], caps)[1])
    # no more waste than bins of one size that shrink
    assert unused(bins) <= unused(packing.plan(dict(hist), [96], caps)[1])


def check(rows, hist):
    """Every item is placed once, no bin overflows, offsets do not overlap."""
    used = defaultdict(list)
    seen = defaultdict(set)
    for size, r0, r1, b0, per, slot, off, cap in rows:
        for r in range(r0, r1):
            assert r not in seen[size]
            seen[size].add(r)
            b = b0 + (r - r0) // per
            used[b].append((off + ((r - r0) % per) * size, size, slot + (r - r0) % per, cap))
    assert {k: len(v) for k, v in seen.items()} == {k: v for k, v in hist.items() if v}
    for items in used.values():
        items.sort()
        at = 0
        for off, size, _, cap in items:
            assert off == at and off + size <= cap
            at += size
        assert sorted(x[2] for x in items) == list(range(len(items)))


def test_pack_places_every_document(spark):
    enc = encoding()
    rng = random.Random(2)
    texts = ["", None, "word " * 700] + ["word " * rng.randint(1, 60) for _ in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, "alone", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, position string")
    p = packing.pack(df, 100).collect()
    tokens = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)} | {None: len(enc.encode_ordinary("alone"))}
    got = defaultdict(int)
    for r in p:
        got[r.doc_id] += r.n_tokens
    assert dict(got) == tokens
    fill = defaultdict(int)
    for r in p:
        fill[r.container] += r.n_tokens
    assert max(fill.values()) <= 100 and len({(r.container, r.position) for r in p}) == len(p)
    assert {r.doc_id for r in p if r.piece} == {i for i, n in tokens.items() if n > 100}
    total = sum(tokens.values())
    assert len([c for c, n in fill.items() if n]) <= math.ceil(total / 100) * 1.1 + 1
    assert packing.pack(df.limit(0), 100).count() == 0
    by_length = packing.pack(df, [64, 256, 1024], size=F.length("text")).collect()
    length = {i: len(t or "") for i, t in enumerate(texts)} | {None: 5}
    have = defaultdict(int)
    for r in by_length:
        have[r.doc_id] += r.n_tokens
    assert dict(have) == length and {r.capacity for r in by_length} <= {64, 256, 1024}
    assert packing.pack(df.where("doc_id = 0"), 100).count() == 1


def test_budgets_pass_shortages_to_siblings_first():
    got = mixing.budgets([("a/x", 1.0), ("a/y", 1.0), ("b", 2.0)], {"a/x": 10.0, "a/y": 1000.0, "b": 1000.0}, 400.0)
    assert got == pytest.approx({"a/x": 10.0, "a/y": 190.0, "b": 200.0})
    assert mixing.budgets([("a", 1.0), ("gone", 1.0)], {"a": 50.0}) == pytest.approx({"a": 50.0, "gone": 0.0})
    assert mixing.budgets([("a", 1.0)], {}) == {}
    full = mixing.budgets([("a", 3.0), ("b", 1.0)], {"a": 30.0, "b": 5.0}, 1e9)
    assert full == pytest.approx({"a": 30.0, "b": 5.0})


def test_draw_meets_shares_and_caps(spark):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randint(1, 30), "big", "clash") for i in range(400)] + [(1000 + i, "word " * rng.randint(1, 30), "small", "clash") for i in range(40)]
    rows += [(5000, None, "big", "c"), (5001, "", "big", "c"), (5002, "text", None, "c"), (5003, "text", "unlisted", "c"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.3, 2), (None, 1.0, 1), ("neg", -1.0, 1), ("big", None, None)], "source string, weight double, max_repeat int")
    drawn, shares = mixing.draw(df, t)
    d = drawn.collect()
    assert len({r.doc_id for r in d}) == len(d)
    assert all(r.repeats <= (1 if r.source == "big" else 3) for r in d)
    s = {r.source: r for r in shares.collect()}
    assert s["small"].share == pytest.approx(0.5, abs=0.02) and s["big"].share == pytest.approx(0.5, abs=0.02) and s["none"].drawn_tokens == 0
    assert sum(r.n_tokens * r.repeats for r in d if r.source == "small") == s["small"].drawn_tokens <= s["small"].budget
    assert s["small"].budget - s["small"].drawn_tokens <= 31
    again, _ = mixing.draw(df.repartition(7), t)
    assert sorted((r.doc_id, r.repeats) for r in again.collect()) == sorted((r.doc_id, r.repeats) for r in d)
    none, sh = mixing.draw(df.limit(0), t)
    assert none.count() == 0 and sh.where("drawn_tokens > 0").count() == 0
    assert mixing.draw(df, t.limit(0))[0].count() == 0
