"""What several text operators share: tables in the shared folder, and distributed components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators' word patterns know it.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factlattice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there.

    Tables go when the application ends, or earlier by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattice-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes a table of ``stored`` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        where, fs = _hadoop_path(df.sparkSession, path)
        fs.delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for each node of the edges (a, b): root is the least node it is connected with.

    Alternating star contraction: each step hangs a node's larger, then its smaller, neighbours under its
    least neighbour, by an aggregation and an equi-join. Rounds grow with the logarithm of the nodes. No
    step gathers a group; hubs are pre-aggregated, and their joins can be split. Roots have no row.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = _digest(now)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.a", "e.b").where("a <> b").distinct())
        dropped(now)
        now, before = after, seen
        seen = _digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return spark.read.schema(now.schema).parquet(now._stored_at).select(F.col("a").alias("node"), F.col("b").alias("root")) if seen[0] else now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n local nodes and edges between positions a and b: each node's least reachable position."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, zero: int, join) -> Column:
    """For each value of an array of longs, all those before it joined by an associative function; zero for the first.

    In blocks of about the root of its size, so that what an aggregation copies to grow its result stays small: the work
    grows with the 1.5th power of the array, where one aggregation over all of it would square it.
    """
    start = F.struct(F.lit(zero).cast("long").alias("at"), F.expr("cast(array() as array<long>)").alias("out"))

    def scan(rows: Column, own) -> Column:
        return F.aggregate(rows, start, lambda acc, x: F.struct(join(acc["at"], own(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocks(v: Column) -> Column:
        k = F.ceil(F.sqrt(F.size(v))).cast("int")
        count = F.ceil(F.size(v) / k).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda c: scan(F.slice(v, c * k + 1, k), lambda x: x))
        whole = let(parts, lambda p: F.zip_with(p, scan(p, lambda x: x["at"])["out"], lambda part, at: F.transform(part["out"], lambda x: join(at, x))))
        return F.when(F.size(v) <= 32, scan(v, lambda x: x)["out"]).otherwise(F.flatten(whole))

    return let(values, blocks)


def spans_of(text: Column, pattern: str | Column, reach: int = 0) -> Column:
    """The leftmost non-overlapping matches of a pattern in a text, as an array of (s, e, bs, be, v, left, right): start
    and end in code points and in bytes, the match, and at most reach code points between it and its neighbours.

    The lengths of the gaps between matches and of the matches give the positions, by running sums.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))

    def placed(x: Column) -> Column:
        gaps, found = x["gaps"], x["found"]
        add = lambda a, b: a + b
        points = before(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: (F.length(g) + F.length(v)).cast("long")), 0, add)
        octets = before(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: (F.octet_length(g) + F.octet_length(v)).cast("long")), 0, add)
        rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("v"), F.slice(gaps, 2, F.size(found)).alias("r"), points.alias("p"), octets.alias("o"))
        return F.transform(rows, lambda y: F.struct(
            (y["p"] + F.length(y["g"])).cast("int").alias("s"), (y["p"] + F.length(y["g"]) + F.length(y["v"])).cast("int").alias("e"),
            (y["o"] + F.octet_length(y["g"])).cast("int").alias("bs"), (y["o"] + F.octet_length(y["g"]) + F.octet_length(y["v"])).cast("int").alias("be"),
            y["v"].alias("v"), F.right(y["g"], F.lit(reach)).alias("left"), F.left(y["r"], F.lit(reach)).alias("right"),
        ))

    none = F.expr("cast(array() as array<struct<s:int,e:int,bs:int,be:int,v:string,left:string,right:string>>)")
    return let(both, lambda x: F.when(F.size(x["found"]) == 0, none).otherwise(placed(x)))


def cut_out(text: Column, cuts: Column) -> Column:
    """A text with the spans of cuts, structs (s, ..., bs, be, to) in the order of s, replaced by their to.

    Overlapping spans become one, named by the first. By byte positions, which cost nothing to go to, and running maxima.
    """
    def made(x: Column) -> Column:
        spans, raw = x["spans"], x["raw"]
        ends = before(F.transform(spans, lambda y: y["be"].cast("long")), 0, lambda a, b: F.greatest(a, b))
        parts = F.zip_with(spans, ends, lambda y, at: F.when(y["bs"] >= at, F.concat(F.substr(raw, (at + 1).cast("int"), (y["bs"] - at).cast("int")), F.encode(y["to"], "UTF-8"))).otherwise(F.lit(b"")))
        tail = F.array_max(F.transform(spans, lambda y: y["be"]))
        return F.concat(F.array_join(F.transform(parts, lambda p: p.cast("string")), ""), F.substr(raw, tail + 1, F.octet_length(raw)).cast("string"))

    return let(F.struct(cuts.alias("spans"), text.cast("binary").alias("raw")), lambda x: F.when(F.size(x["spans"]) == 0, text).otherwise(made(x)))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of structs with s, ord, kind, e, by start and then kind."""
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["ord"].alias("ord"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
