"""Edits as a stream: each batch replaces all rows of the files that it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import path_of, written


def overlaid(base: DataFrame, edits: DataFrame) -> DataFrame:
    """base without the rows of edited files, and the edits' rows: no row of an older generation stays."""
    return base.join(edits.select("file_path").distinct(), "file_path", "left_anti").unionByName(edits.select(*base.columns))


def latest(edits: DataFrame) -> DataFrame:
    """Of each file the rows of its last generation."""
    last = edits.groupBy("file_path").agg(F.max("generation").alias("generation"))
    return edits.join(last, ["file_path", "generation"])


class Conflict(Exception):
    """Another writer has published since: take its generation and edit that."""


class LiveFacts:
    """A fact table that follows a stream of edits.

    Rows lie in buckets by a hash of their file. A generation is a manifest, a file named by its number that tells which
    folder holds each bucket and which batch of which stream made it: an edit writes the buckets of its files only. The
    manifest is created and never overwritten, so that of two writers who go on from one generation the second fails
    (compare and swap), and it is written last, so that what is half done is never read. A batch that a restarted
    stream runs again is found in the manifests, wherever the generations have got to by then.
    """

    BUCKETS = 16

    def __init__(self, spark: SparkSession, folder: str, base: DataFrame | None = None):
        """Begins with a base, or, without one, goes on from the last generation in the folder."""
        self.spark, self.folder = spark, folder
        if base is not None:
            self.schema = base.schema
            self.revision = -1
            self._publish(0, self._written(base, list(range(self.BUCKETS))), "", -1)
        else:
            self.revision = max(self._numbers())
            self.schema = T.StructType.fromJson(self._manifest(self.revision)["schema"])

    def _path(self, name: str):
        return path_of(self.spark, f"{self.folder}/{name}")

    def _numbers(self) -> list[int]:
        where, fs = self._path("manifests")
        return [int(n.split(".")[0]) for n in (s.getPath().getName() for s in fs.listStatus(where)) if n.endswith(".json")]

    def _manifest(self, revision: int) -> dict:
        where, fs = self._path(f"manifests/{revision:010}.json")
        with_ = fs.open(where)
        try:
            return json.loads(bytes(with_.readAllBytes()).decode())
        finally:
            with_.close()

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64("file_path"), F.lit(self.BUCKETS)).cast("int"))

    def _written(self, rows: DataFrame, buckets: list[int]) -> dict[str, str]:
        """The rows, all of the buckets given, in a new folder; where each bucket lies."""
        name = f"data-{uuid.uuid4().hex}"
        self._bucketed(rows).write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        return {str(b): name for b in buckets}

    def _publish(self, revision: int, where: dict[str, str], stream: str, batch: int) -> None:
        path, fs = self._path(f"manifests/{revision:010}.json")
        text = json.dumps({"buckets": where, "stream": stream, "batch": batch, "schema": self.schema.jsonValue()})
        try:
            out = fs.create(path, False)
        except Py4JJavaError as error:
            raise Conflict(f"generation {revision} is there already") from error
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.revision = revision

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders: dict[str, list[int]] = {}
        for b, name in manifest["buckets"].items():
            if buckets is None or int(b) in buckets:
                folders.setdefault(name, []).append(int(b))
        out = self.spark.createDataFrame([], self.schema)
        for name, own in folders.items():
            rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.folder}/{name}")
            out = out.unionByName(rows.where(F.col("_bucket").isin(*own)).select(*self.schema.names))
        return out

    def snapshot(self, revision: int | None = None) -> DataFrame:
        """The rows of a generation, the last one that this reader knows if none is named."""
        return self._read(self._manifest(self.revision if revision is None else revision))

    def apply(self, edits: DataFrame, batch: int, stream: str = "") -> bool:
        """One burst of edits as one generation on top of the one that this writer knows; false for a batch that is in already.

        Raises Conflict if another writer has published on it; refresh() takes that up.
        """
        for revision in sorted(self._numbers(), reverse=True):
            known = self._manifest(revision)
            if stream and known["stream"] == stream:
                if known["batch"] >= batch:
                    return False
                break
        before, new = self._manifest(self.revision), latest(edits)
        # As many numbers as buckets come to the driver.
        touched = [r["_bucket"] for r in self._bucketed(new.select("file_path")).select("_bucket").distinct().collect()]
        if touched:
            rows = overlaid(self._read(before, touched), new.select(*self.schema.names))
            before["buckets"].update(self._written(rows, touched))
        self._publish(self.revision + 1, before["buckets"], stream, batch)
        return True

    def refresh(self) -> int:
        self.revision = max(self._numbers())
        return self.revision

    def follow(self, edits: DataFrame, checkpoint: str, on_batch: Callable[[int], None] | None = None):
        """Follows a stream; the checkpoint names it, so that its batches count from where they did before a restart."""
        def each(batch: DataFrame, number: int) -> None:
            self.refresh()
            self.apply(batch, number, checkpoint)
            if on_batch:
                on_batch(number)

        return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dirty_projects(changed: DataFrame, depends: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """Projects to look at again: those of the changed files and all that depend on them."""
    from ..operators.reach import reach_from, reversed_edges

    return reach_from(reversed_edges(depends), changed.select("sym"), max_depth).select("sym").distinct()


class Declined(Exception):
    """Some projects are owed a look: the live facts can't answer exactly, and don't answer in part."""


class LiveHost:
    """Answers over live facts, exact or none.

    depends (src, dst) says which project uses which. An edit makes the projects of its files owed; where the surface of a
    project changes, what others can see of it, all that depend on it are owed too. What is owed stays so until it is
    settled, after which answers are given again. Answers are kept for the generation that they were asked of.
    """

    def __init__(self, facts: LiveFacts, depends: DataFrame, project: Column, surface: list[str]):
        """project tells a row's project; surface names the columns that others can see."""
        self.facts, self.depends, self.project, self.surface = facts, depends, project, surface
        self.owed: set[str] = set()
        self.known: dict[tuple[int, str], DataFrame] = {}

    def surfaces(self, revision: int) -> DataFrame:
        """(sym, mark) of each project: an order-independent digest of what others can see."""
        rows = self.facts.snapshot(revision).select(self.project.alias("sym"), *self.surface).distinct()
        own = F.sha2(F.to_json(F.struct(*(F.col(c) for c in self.surface))), 256)
        bits = lambda at: F.conv(F.substring(own, at, 15), 16, 10).cast("long")
        return rows.groupBy("sym").agg(*(F.bit_xor(bits(15 * k + 1)).alias(f"x{k}") for k in range(4)), F.count(F.lit(1)).alias("n")).select("sym", F.struct("x0", "x1", "x2", "x3", "n").alias("mark"))

    def edit(self, edits: DataFrame, batch: int, stream: str = "") -> bool:
        """Applies a burst; its projects, and those that its changed surfaces reach, are owed from then on."""
        before = self.facts.revision
        if not self.facts.apply(edits, batch, stream):
            return False
        files = edits.select("file_path").distinct()
        both = self.facts.snapshot(before).unionByName(self.facts.snapshot())
        changed = both.join(files, "file_path", "left_semi").select(self.project.alias("sym")).distinct()
        old, new = self.surfaces(before), self.surfaces(self.facts.revision)
        seen = old.select("sym", F.col("mark").alias("a")).join(new.select("sym", F.col("mark").alias("b")), "sym", "full_outer").where("not (a <=> b)").select("sym")
        # As many rows as projects are owed come to the driver.
        self.owed |= {r["sym"] for r in changed.union(dirty_projects(seen, self.depends, None)).distinct().collect()}
        return True

    def settle(self, projects: list[str] | None = None) -> None:
        """The projects given, or all that are owed, have been looked at again."""
        self.owed -= set(self.owed if projects is None else projects)

    def ask(self, name: str, question: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The answer to a question about the facts, kept for this generation; Declined while anything is owed."""
        if self.owed:
            raise Declined(f"owed a look: {', '.join(sorted(self.owed))}")
        key = (self.facts.revision, name)
        if key not in self.known:
            self.known = {k: v for k, v in self.known.items() if k[0] == key[0]}
            self.known[key] = written(question(self.facts.snapshot()))
        return self.known[key]
