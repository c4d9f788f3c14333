"""Instantiations as nodes, on a worked example."""

from pyspark.sql import functions as F

from factlattice.operators import generics, graph, reach


def test_materialised(spark):
    """Main calls Run<Order>; Run<T> forwards T to Save<T> from its lambda, and calls an unresolved and an open callee."""
    edges = spark.createDataFrame([
        ("Main", "Run", "invocation", 1, None, [], ["C:Order"]), ("Main", "Save", "invocation", 2, None, [], ["C:Other"]),
        ("Run", "Run~λ0", "methodGroup", 3, None, None, None), ("Run~λ0", "Save", "invocation", 4, "Repo<T,Order>", [], ["M:0"]),
        ("Run", "Odd", "invocation", 5, "T", [], ["?"]), ("Run", "Plain", "invocation", 6, "Tx", None, None), ("Save", "Save", "invocation", 7, "T", [], ["M:7"]),
    ], "src string, dst string, kind string, line int, receiver_type string, declaring array<string>, own array<string>")
    instances = spark.createDataFrame([("Run", [], ["Order"], {"T": "Order", "Order": "T"}), ("Save", [], ["Order"], {"T": "Order"})] * 2, "method string, declaring array<string>, own array<string>, types map<string,string>")
    got = sorted((r.src, r.dst, r.line, r.receiver_type) for r in generics.materialised(edges, instances).collect())
    run, save, inner = "Run~mono⟨;Order⟩", "Save~mono⟨;Order⟩", "Run~λ0~mono⟨;Order⟩"
    assert got == sorted([
        ("Main", run, 1, None), ("Main", "Save", 2, None), ("Run", "Run~λ0", 3, None), ("Run~λ0", "Save", 4, "Repo<T,Order>"), ("Run", "Odd", 5, "T"),
        ("Run", "Plain", 6, "Tx"), ("Save", "Save", 7, "T"), (run, inner, 3, None), (inner, save, 4, "Repo<Order,T>"), (run, "Odd", 5, "Order"),
        (run, "Plain", 6, "Tx"), (save, "Save", 7, "Order"),
    ])
    shaped = generics.materialised(edges.where("line <> 2 and line <> 7"), instances)
    known = reach.reach_from(shaped, spark.createDataFrame([("Main",)], "sym string"))
    assert {r.sym: r.depth for r in graph.collapsed(known).collect()} == {"Main": 0, "Run": 1, "Run~λ0": 2, "Odd": 2, "Plain": 2, "Save": 3}


def test_resolved(spark):
    rows = spark.createDataFrame([(["C:A", "M:0", "T:1"],), (["M:1"],), (["?"],), (["T:x"],), ([],), (None,)], "t array<string>")
    a = lambda *x: F.array(*map(F.lit, x))
    got = [r[0] for r in rows.select(generics.resolved(F.col("t"), a("D", "E"), a("F"))).collect()]
    assert got == [["A", "F", "E"], None, None, None, [], []]
