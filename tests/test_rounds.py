"""Components and chains: rounds by all tasks only for what is too large for one, and the same results either way."""

import random

import pytest

from factlattice.operators import reach


def counted(monkeypatch):
    seen = []
    real = reach.settled
    monkeypatch.setattr(reach, "settled", lambda df: seen.append(1) or real(df))
    return seen


def test_ring_in_few_rounds(spark, monkeypatch):
    """A ring's colours go round it: as many rounds as it has members, if each cost jobs."""
    seen = counted(monkeypatch)
    ring = spark.createDataFrame([(f"m{k:03d}", f"m{(k + 1) % 40:03d}") for k in range(40)] + [("x", "m000"), ("y", "y")], "src string, dst string")
    assert {tuple(r) for r in reach.strong(ring).collect()} == {(f"m{k:03d}", "m000") for k in range(40)} | {("y", "y")}
    assert len(seen) < 12


@pytest.mark.parametrize("few", [0, 5])
def test_large_as_small(spark, monkeypatch, few):
    dice = random.Random(5)
    edges = spark.createDataFrame([(f"m{dice.randrange(30)}", f"m{dice.randrange(30)}") for _ in range(40)], "src string, dst string")
    anchors = edges.selectExpr("explode(array(src, dst)) as sym").distinct().selectExpr("sym", "length(sym) as weight")
    rows = lambda: (sorted(map(tuple, reach.strong(edges).collect())), sorted(map(str, reach.longest_chain(anchors, edges).collect())))
    want = rows()
    assert want[0]
    monkeypatch.setattr(reach, "FEW", few)
    assert rows() == want


def test_ready_edges_are_not_written_again(spark, monkeypatch):
    seen = counted(monkeypatch)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a")], "seed string, sym string")
    rows = sorted(map(tuple, reach.reach(edges, seeds, None, ready=True).collect()))
    # The start and three levels, the last of them empty.
    assert rows == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)] and len(seen) == 4


@pytest.mark.parametrize("few", [20, 150])
def test_dense_graphs_are_folded(spark, monkeypatch, few):
    """A part of the edges shows most of the components, by all tasks (20) or in one (150); the rest is as without folds."""
    dice = random.Random(9)
    rows = [(f"m{g}{dice.randrange(15):02}", f"m{g}{dice.randrange(15):02}") for g in range(3) for _ in range(150)] + [("m000", "m100"), ("in", "m000"), ("m200", "out"), ("x", "x"), ("y", "x")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    want = sorted(map(tuple, reach.strong(edges).collect()))
    assert len({s for _, s in want}) == 4 and len(want) > 40
    monkeypatch.setattr(reach, "FEW", few)
    symbols = edges.selectExpr("explode(array(src, dst, 'more')) as sym")
    assert sorted(map(tuple, reach.strong(edges, symbols).collect())) == want
    left, folds = reach._folded(reach._coded(edges)[1])
    assert folds and left.count() < 100
