"""Chains, hierarchies and cycles longer than any bound that operators once had."""

from factlattice.operators import graph, reach


def test_deep_dispatch_and_types(spark):
    chain = [(f"t{k:02}", f"t{k + 1:02}") for k in range(14)]
    types = spark.createDataFrame(chain, "type_id string, related_id string")
    assert {(r.ancestor, r.depth) for r in graph.closure(types).where("type_id = 't00'").collect()} == {(f"t{k:02}", k) for k in range(15)}
    dispatch = spark.createDataFrame([(*c, "override") for c in chain], "source_member string, target_member string, kind string")
    got = {(r.src, r.dst) for r in graph.mined_dispatch(dispatch).collect()}
    assert got == {(f"t{a:02}", f"t{b:02}") for a in range(15) for b in range(a + 1, 15)}


def test_long_cycle_and_chain(spark):
    n = 54
    ring = spark.createDataFrame([(f"r{k:02}", f"r{(k + 1) % n:02}") for k in range(n)], "src string, dst string")
    assert {(r.cycle, r.sym) for r in reach.cycles(ring, ring.where("src = 'r00'")).collect()} == {("r00", f"r{k:02}") for k in range(n)}


def test_chain_degrees(spark):
    n = 24
    line = spark.createDataFrame([(f"c{k:02}", f"c{k + 1:02}") for k in range(n - 1)] + [("x", "y"), ("y", "x")], "src string, dst string")
    anchors = spark.createDataFrame([(f"c{k:02}", 1) for k in range(n)] + [("x", 1), ("y", 1)], "sym string, weight int")
    got = {r.sym: r.degree for r in reach.longest_chain(anchors, line).collect()}
    assert got == {f"c{k:02}": n - k for k in range(n)} | {"x": -1, "y": -1}
    try:
        reach.longest_chain(anchors, line, 5)
    except reach.BudgetExceeded:
        return
    raise AssertionError("partial degrees were returned")
