"""The sparse matching and its margins against exhaustive search."""

import random
import time

import numpy as np
import pytest

from loomtrack.operators import handoffs, matching


def exhaustive(rows, skip=None):
    """(total gain, number of pairs) of a best matching, by trying all."""

    def go(i, used):
        if i == len(rows):
            return 0.0, 0
        best = go(i + 1, used)
        for b, g in rows[i].items():
            if b not in used and (i, b) != skip:
                gain, n = go(i + 1, used | {b})
                if gain + g > best[0]:
                    best = gain + g, n + 1
        return best

    return go(0, frozenset())


@pytest.mark.parametrize("seed", range(8))
def test_totals_with_and_without_each_pair(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        rows = [{b: rng.choice([rng.random() / 2, round(rng.random() / 2, 1) + 1e-12]) for b in range(m) if rng.random() < 0.6} for _ in range(n)]
        found = matching.Matching(rows)
        assert len({b for _, b in found.pairs}) == len(found.pairs)
        total = sum(rows[a][b] for a, b in found.pairs)
        assert total == pytest.approx(exhaustive(rows)[0], abs=1e-9)
        for a, b in found.pairs:
            loss, _ = found.loss_without(a, 99.0)
            assert loss == pytest.approx(total - exhaustive(rows, (a, b))[0], abs=1e-9)
            assert found.loss_without(a, loss - 1e-6) is None


def dense_rule(edges, least, margin):
    """The margin rule by definition, with one exhaustive matching for each chosen pair."""
    best = {}
    for a, b, s in edges:
        if s >= least:
            best[a, b] = max(s, best.get((a, b), s))
    rows = [{b: s - least + 1e-12 for (x, b), s in best.items() if x == a} for a in sorted({a for a, _ in best})]
    lefts = sorted({a for a, _ in best})
    pairs = {(lefts[i], b) for i, b in matching.Matching(rows).pairs}
    total, unclear = sum(best[p] for p in pairs), set()
    for a, b in pairs:
        s = best[a, b]
        others = [t for (x, y), t in best.items() if y == b and x != a]
        if others and abs(s - max(others)) < margin:
            unclear.add(b)
        for (x, y), t in best.items():
            if x == a and y != b and abs(s - t) < margin:
                unclear |= {b, y}
        gain, n = exhaustive(rows, (lefts.index(a), b))
        if total - (gain + n * least) < margin:
            unclear.add(b)
    clear = {a: best[a, b] for a, b in pairs if b not in unclear}
    for (a, b), t in best.items():
        if b not in {y for _, y in pairs} and a in clear and abs(clear[a] - t) < margin:
            unclear.add(b)
    return pairs, unclear


@pytest.mark.parametrize("seed", range(6))
def test_margins_against_the_definition(seed):
    rng = random.Random(100 + seed)
    for _ in range(120):
        edges = [(f"o{a}", f"i{b}", rng.uniform(0.4, 1.0)) for a in range(rng.randint(1, 4)) for b in range(rng.randint(1, 4)) if rng.random() < 0.7]
        out = matching.assign(edges, 0.48, 0.08)
        pairs, unclear = dense_rule([(a, int(b[1:]), s) for a, b, s in edges], 0.48, 0.08)
        assert {(a, int(b[1:])) for a, b, _, chosen, _ in out if chosen} == pairs
        assert {int(b[1:]) for _, b, _, _, ambiguous in out if ambiguous} == unclear


def test_goldens():
    pairs = lambda rows: {(a, b) for a, b, _, chosen, _ in rows if chosen}
    edges = [(0, 0, 0.95), (0, 1, 0.80), (1, 0, 0.80), (1, 1, 0.10)]
    assert pairs(matching.assign(edges, 0.48, 0.08)) == {(0, 1), (1, 0)}
    assert matching.assign([(0, 0, 0.47), (0, 1, None), (0, 2, float("nan"))], 0.48, 0.08) == [] == matching.assign([], 0.48, 0.08)
    assert all(unclear for *_, unclear in matching.assign([(0, 0, 0.85), (0, 1, 0.84), (1, 0, 0.84), (1, 1, 0.85)], 0.48, 0.08))
    # one outgoing, two incoming: the loser is a close rival, and so both are unclear
    assert matching.assign([(0, 0, 0.90), (0, 1, 0.85)], 0.48, 0.08) == [(0, 0, 0.90, True, True), (0, 1, 0.85, False, True)]
    assert matching.assign([(0, 0, 0.90), (0, 1, 0.60)], 0.48, 0.08) == [(0, 0, 0.90, True, False)]
    assert matching.assign([(0, 0, 0.7), (0, 0, 0.9)], 0.48, 0.08) == [(0, 0, 0.9, True, False)]


def test_a_long_contest_stays_sparse():
    rng = random.Random(5)
    edges = [(a, (a + d) % 1500, rng.uniform(0.5, 1.0)) for a in range(1500) for d in (0, 1, 7)]  # 4,500 candidates in one group
    began = time.time()
    out = matching.assign(edges, 0.48, 0.08)
    assert time.time() - began < 60 and len({a for a, *_ in out}) > 1400
    small = [(a, b % 120, s) for a, b, s in edges if a < 120]
    gain = np.zeros((120, 120))
    for a, b, s in small:
        gain[a, b] = max(gain[a, b], s - 0.48 + 1e-12)
    total = sum(gain[a, b] for a, b in handoffs._solve(gain))
    assert sum(s - 0.48 for _, _, s, chosen, _ in matching.assign(small, 0.48, 0.08) if chosen) == pytest.approx(total, abs=1e-6)


def test_matching_of_tables(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.5), ("b", 2, 0.6), ("c", 3, 0.7), ("d", 4, 0.3), ("e", 5, None), ("c", 3, 0.6)]
    out = handoffs.judge_candidates(spark.createDataFrame(rows, "l string, r long, score double"), "l", "r")
    assert {tuple(r) for r in out.collect()} == {("a", 1, 0.9, True, False), ("b", 2, 0.6, True, False), ("c", 3, 0.7, True, False)}
    assert handoffs.judge_candidates(out.limit(0).select("l", "r", "score"), "l", "r").count() == 0


def test_a_score_at_its_limit_links(spark):
    """Scores that are 0.9 but for their rounding error link, those below do not."""
    rows = spark.createDataFrame([("a", 0.9), ("b", 0.8999999999999999), ("c", 0.9000000000000001), ("d", 0.89999), ("e", None)], "id string, score double")
    assert sorted(r.id for r in handoffs.linked(rows, 0.9).collect()) == ["a", "b", "c"]
