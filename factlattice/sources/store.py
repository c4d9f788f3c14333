"""Stores: the fact tables of one index run and what is derived from them, published as a whole and chosen by name.

A folder holds one directory per store. A store is written beside its place and renamed into it, so a reader sees all of
it or nothing; LATEST names the last one published. Results are kept by store, rules and query.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as rulebook
from .facts import SCHEMA_VERSION, Facts, check_schema

#: Derived tables, and the column that look-ups in each go by: rows of a key lie together, so statistics prune files.
DERIVED = {"call_edges": "src", "dispatch_edges": "hub", "nodes": "sym"}
KEYS = {"methods": "symbol_id", "refs": "enclosing", "field_access": "enclosing", "effect_events": "enclosing"}


class NoStore(Exception):
    """No store, or more than one, goes by this name."""


class Stores:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _at(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def names(self) -> list[str]:
        """Published stores; a folder holds as many as there were index runs."""
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory())
        return sorted(n for n in found if not n.startswith("_"))

    def runs(self) -> DataFrame:
        """The meta rows of all stores, newest first."""
        kind = "store_id string, index_version int, rules_hash string, created_at string"
        paths = [self._at(n, "meta") for n in self.names()]
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.orderBy(F.desc("created_at"), "store_id")

    def publish(self, store_id: str, facts: Facts, created_at: str, rules: dict = rulebook.DEFAULT, derived: dict[str, DataFrame] | None = None) -> None:
        """Writes all tables, renames them into place and points LATEST at them. A store is never overwritten."""
        if store_id.startswith("_") or "/" in store_id or store_id in self.names():
            raise NoStore(f"{store_id} is taken or no name for a store")
        beside = self._at(f"_tmp-{uuid.uuid4().hex}")
        tables = {f.name: getattr(facts, f.name) for f in fields(Facts)} | (derived or {})
        for name, df in tables.items():
            self._write(df, f"{beside}/{name}", {**KEYS, **DERIVED}.get(name))
        meta = [(store_id, SCHEMA_VERSION, rulebook.fingerprint(rules), created_at)]
        self.spark.createDataFrame(meta, "store_id string, index_version int, rules_hash string, created_at string").coalesce(1).write.parquet(f"{beside}/meta")
        if not self._fs.rename(self._path(beside), self._path(self._at(store_id))):
            raise NoStore(f"{store_id} was published meanwhile")
        out = self._fs.create(self._path(self._at("_LATEST")), True)
        out.write(bytearray(store_id.encode()))
        out.close()

    def _write(self, df: DataFrame, path: str, key: str | None, mode: str = "errorifexists") -> None:
        if key:
            df = df.repartition(key).sortWithinPartitions(key)
        df.write.mode(mode).parquet(path)

    def choose(self, ref: str = "LATEST") -> str:
        """The id of the store that a reference names: LATEST, an id, or the beginning of just one."""
        if ref == "LATEST":
            where = self._path(self._at("_LATEST"))
            if not self._fs.exists(where):
                raise NoStore("nothing is published")
            stream = self._fs.open(where)
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        found = [n for n in self.names() if n == ref] or [n for n in self.names() if n.startswith(ref)]
        if len(found) != 1:
            raise NoStore(f"{ref} names {len(found)} stores")
        return found[0]

    def table(self, name: str, ref: str = "LATEST") -> DataFrame:
        return self.spark.read.parquet(self._at(self.choose(ref), name))

    def read(self, ref: str = "LATEST") -> Facts:
        """A store's facts as plans, if it has this build's schema."""
        store = self.choose(ref)
        check_schema(self.table("meta", store))
        return Facts(**{f.name: self.spark.read.parquet(self._at(store, f.name)) for f in fields(Facts)})

    def merge(self, ref: str, facts: Facts) -> None:
        """Adds another solution's facts to a store of this build's schema; results kept for it go."""
        store = self.choose(ref)
        check_schema(self.table("meta", store))
        for f in fields(Facts):
            self._write(getattr(facts, f.name), self._at(store, f.name), KEYS.get(f.name), "append")
        self.purge(store)

    def kept(self, ref: str, query: str, make: Callable[[Facts], DataFrame], rules: dict = rulebook.DEFAULT) -> DataFrame:
        """A query's result, from what is kept for the same store, rules and query, else made and kept."""
        store = self.choose(ref)
        key = hashlib.sha256(f"{rulebook.fingerprint(rules)}|{query}".encode()).hexdigest()
        path = self._at("_kept", store, key)
        if not self._fs.exists(self._path(f"{path}/_SUCCESS")):
            make(self.read(store)).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def purge(self, store: str) -> None:
        self._fs.delete(self._path(self._at("_kept", store)), True)


def rendered(df: DataFrame, path: str, form: str = "tsv") -> None:
    """Rows as text files, in their order: tab-separated with a header, or a JSON object a line."""
    if form == "tsv":
        df.write.option("sep", "\t").option("header", True).csv(path)
    elif form == "json":
        df.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no such form: {form}")
