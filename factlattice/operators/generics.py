"""Generic instantiations as nodes of the call graph, and back.

Bindings are arrays of tokens: ``C:type`` is concrete, ``M:n`` and ``T:n`` forward the caller's n-th argument of its own or
of its declaring type, anything else is unresolved. A node's id is the method's, ``~mono`` and its two bindings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAMBDA = "~λ"


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def resolved(tokens: Column, declaring: Column, own: Column) -> Column:
    """The types that tokens stand for within a caller of these bindings; null if one of them stands for none."""
    def one(t):
        at = F.regexp_extract(t, "^[MT]:([0-9]{1,9})$", 1).try_cast("int")
        return F.when(F.startswith(t, F.lit("C:")), F.substring(t, 3, 1 << 30)).when(F.startswith(t, F.lit("M:")), F.get(own, at)).when(F.startswith(t, F.lit("T:")), F.get(declaring, at))

    types = F.transform(F.coalesce(tokens, _none()), one)
    return F.when(~F.exists(types, lambda x: x.isNull()), types)


def node(method: Column, declaring: Column, own: Column) -> Column:
    return F.concat(method, F.lit("~mono⟨"), F.array_join(declaring, ","), F.lit(";"), F.array_join(own, ","), F.lit("⟩"))


def _bound(method: Column, declaring: Column, own: Column) -> Column:
    """The node of a callee with resolved bindings; null if they aren't, or if it has none."""
    return F.when(F.size(declaring) + F.size(own) > 0, node(method, declaring, own))


def substituted(name: Column, types: Column) -> Column:
    """name with each of its identifiers that types maps replaced, all at once."""
    parts = F.regexp_extract_all(name, F.lit(r"([\w.]+|[^\w.]+)"), F.lit(1))
    return F.when(name.isNotNull(), F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(types, p), p)), ""))


def materialised(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """(src, dst, kind, line, receiver_type): the edges, and for each instance a clone of its method's and its lambdas' edges.

    edges: those columns, and declaring and own, the callee's binding tokens. instances: (method, declaring, own, types) with
    concrete bindings and a map from type parameters to types. A concrete callee that is an instance is replaced by it; a
    clone's callee is too, once its tokens are resolved in the instance; a clone refers to its own method's clones of lambdas.
    Callees that are no instance stay as they are. Three equi-joins, on methods and on node ids; no group is gathered.
    """
    made = instances.select("method", F.col("declaring").alias("i_declaring"), F.col("own").alias("i_own"), "types").dropDuplicates(["method", "i_declaring", "i_own"])
    ids = made.select(node(F.col("method"), F.col("i_declaring"), F.col("i_own")).alias("id"))
    no = _none()
    plain = edges.withColumn("to", _bound(F.col("dst"), resolved(F.col("declaring"), no, no), resolved(F.col("own"), no, no)))
    rows = edges.withColumn("owner", F.substring_index("src", LAMBDA, 1))
    rows = rows.join(made, rows["owner"] == made["method"])
    inner = (F.col("kind") == "methodGroup") & F.startswith("dst", F.concat("method", F.lit(LAMBDA)))
    to = _bound(F.col("dst"), resolved(F.col("declaring"), F.col("i_declaring"), F.col("i_own")), resolved(F.col("own"), F.col("i_declaring"), F.col("i_own")))
    clones = rows.select(
        node(F.col("src"), F.col("i_declaring"), F.col("i_own")).alias("src"),
        F.when(inner, node(F.col("dst"), F.col("i_declaring"), F.col("i_own"))).otherwise(F.col("dst")).alias("dst"), "kind", "line",
        substituted(F.col("receiver_type"), F.col("types")).alias("receiver_type"), F.when(~inner, to).alias("to"),
    )
    both = plain.select("src", "dst", "kind", "line", "receiver_type", "to").unionByName(clones)
    both = both.join(ids, both["to"] == ids["id"], "left")
    return both.select("src", F.coalesce("id", "dst").alias("dst"), "kind", "line", "receiver_type")
