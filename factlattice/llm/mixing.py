"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w: u from a hash of its id and text, w its quality weight, from its words and from the share
of letters in them. Sorted by key within a source, the documents are a weighted sample without replacement in every
prefix, so a budget takes a prefix. Whole epochs come first, then the prefix that comes nearest to what is left of the
target. Rows that agree in source, id and text have one key: they are one row with a count until the end, where they are
dealt out again in parts.

The sort is by key buckets: a bucket is a range of keys, so a hot source has many; running sums are taken inside a
bucket, over the buckets of a shelf, and over the shelves' totals. Light documents have larger keys, so equal steps of a key's rank under the weights
that the source has bound the buckets: each holds about as many documents, whatever share of them is light.

Defined results: null text has size 0; null source is a source of its own, last; a null doc_id has a key as any
other; repeated rows are documents each; an empty table gives an empty result; a mix of no words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, stored

#: Documents in a key bucket, about; buckets on a shelf; equal rows that one task deals out.
BUCKET, SHELF, PART = 500, 1024, 4096
#: Steps of the quality weight.
STEPS = 32
#: At most so many times its source's words are a target.
EPOCHS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight in steps up to 1: fragments count less, up to 64 words, and so do texts of few letters."""
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    solid = F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    share = F.when(solid > 0, letters / solid).otherwise(F.lit(0.0))
    return F.greatest(F.lit(1.0), F.round(STEPS * F.least(size / 64.0, F.lit(1.0)) * F.coalesce(share, F.lit(0.0)))) / float(STEPS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes (source, source_size, more) with target: all words dealt by weight, EPOCHS times a source's size at most.

    The deal's level is the least at which the targets make up the whole: sources reach their limit in the
    order of limit over weight, so running sums over that order give it without a loop.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(EPOCHS)))
    # Sources before this one in the order are at their limit; the rest share by weight.
    order = W.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("rest_w", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    rows = rows.withColumn("whole", F.sum("source_size").over(every).cast("double"))
    rows = rows.withColumn("level", (F.col("whole") - F.col("full")) / F.col("rest_w"))
    # The first source whose limit isn't reached at its level sets the level of all after it.
    rows = rows.withColumn("stop", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(every))
    target = F.least(F.col("most"), F.coalesce(F.col("stop.level") * F.col("w"), F.col("most")))
    return rows.select(*sizes.columns, target.alias("target"))


def text_key(seed: int = 17) -> Column:
    """What a row's place in the sample is drawn from."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def rank(key: Column) -> Column:
    """The share of a source's documents that is expected below a key, by the source's weights; it never falls as keys grow."""
    above = F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + x["n"] * F.exp(-key * x["weight"]))
    return F.greatest(F.lit(0.0), 1.0 - above / F.col("n"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, taken) for each row of docs.

    Only sizes and hashes are shuffled, never texts. Reruns agree: the keys come from the rows themselves.
    """
    text = F.col("text")
    rows = docs.select("doc_id", "source", words(text).alias("size"), text_key(seed).alias("text_key"), quality(text, words(text)).alias("weight"))
    rows = stored(rows.groupBy("doc_id", "source", "size", "text_key", "weight").agg(F.count(F.lit(1)).alias("copies")))
    levels = rows.groupBy("source", "weight").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n"))
    sizes = levels.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("weight", "n"))).alias("levels"))
    aims = targets(sizes, weights).withColumnRenamed("source", "_source")
    u = (F.shiftrightunsigned("text_key", 11).cast("double") + 0.5) / F.lit(float(2**53))
    rows = rows.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("key", -F.log(u) / F.col("weight"))
    rows = rows.withColumn("bucket", F.floor(rank(F.col("key")) * F.ceil(F.col("n") / float(BUCKET)))).withColumn("shelf", F.floor(F.col("bucket") / F.lit(SHELF))).drop("levels", "weight")
    rows = stored(rows)
    every = F.col("size") * F.col("copies")
    upto = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "shelf", "bucket").agg(F.sum(every).alias("held"))
    shelves = buckets.groupBy("source", "shelf").agg(F.sum("held").alias("held"))
    shelves = shelves.select(F.col("source").alias("s_source"), F.col("shelf").alias("s_shelf"), F.coalesce(F.sum("held").over(upto(["source"], "shelf")), F.lit(0)).alias("below"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("held").over(upto(["source", "shelf"], "bucket")), F.lit(0)))
    buckets = buckets.join(shelves, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shelf") == F.col("s_shelf")))
    buckets = buckets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.col("below") + F.col("before")).alias("earlier"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(every).over(inside), F.lit(0)))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - epochs * F.col("source_size") - F.col("earlier") - F.col("before")
    # The document at the edge goes in if that ends nearer to the target.
    more = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("copies"), F.floor(left / F.col("size") + 0.5)))).otherwise(F.lit(0))
    rows = rows.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", epochs.alias("epochs"), more.alias("more"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / F.lit(PART)).cast("int")))).repartition("text_key", "part")
    first = F.col("part").cast("long") * PART
    rows = rows.withColumn("nth", F.explode(F.sequence(first, F.least(first + PART, F.col("copies")) - 1)))
    taken = F.col("size") * (F.col("epochs") + (F.col("nth") < F.col("more")).cast("long"))
    return rows.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The contract's columns, one row per row of docs."""
    return mixed(docs, **how).select("doc_id", "size", "source_size", "target", "taken")
