"""Hazards: co-occurrence and order of accesses and effects, within methods and along the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import docid
from .reach import nearest, strong


def race_windows(access: DataFrame) -> DataFrame:
    """(enclosing, cell, file_path, write_line, read_file, read_line, type, confidence, reason): writes of static cells
    that a read in the same method precedes, by line, with the earliest such read.

    The earliest read of a method and cell is the one wanted if it stands before the write at all, so reads are
    aggregated before the join and the join has one row per write. Static constructors run once and can't race. Cells
    of a thread are contexts to check. A getter, constructor or init method, or one write of a cell named as an
    instance, initialises lazily; that is safe, and left out, if the write is the last of the method under a lock and
    the cell is volatile. Of the rest, a transaction around both lowers the confidence.
    """
    rows = access.where(F.array_contains(F.split("modifiers", " "), "static") & F.col("enclosing").isNotNull())
    reads = rows.where("access = 'read'").groupBy("enclosing", "cell").agg(F.min(F.struct(F.col("line"), F.col("file_path"), F.col("transaction_held"))).alias("r"))
    writes = rows.where("access = 'write'").groupBy("enclosing", "cell", "file_path", "line").agg(*(F.bool_or(c).alias(c) for c in ("lock_held", "transaction_held", "thread_static")), F.bool_or(F.array_contains(F.split("modifiers", " "), "volatile")).alias("volatile"))
    count = writes.groupBy("enclosing", "cell").agg(F.count(F.lit(1)).alias("writes"))
    locked = rows.where("lock_held").groupBy("enclosing").agg(F.max("line").alias("last_locked"))
    pairs = writes.join(reads, ["enclosing", "cell"]).where("r.line < line").join(count, ["enclosing", "cell"]).join(locked, "enclosing", "left")
    own, cell = docid.member(F.col("enclosing")), F.lower(F.ltrim(docid.member(F.col("cell")), F.lit("_")))
    pairs = pairs.where(own != "#cctor")
    init = F.startswith(own, F.lit("get_")) | (own == "#ctor") | F.contains(F.lower(own), F.lit("init"))
    lazy = ~F.col("thread_static") & (init | ((F.col("writes") == 1) & cell.isin("instance", "initialised", "initialized")))
    safe = lazy & F.col("lock_held") & F.col("volatile") & (F.col("line") >= F.col("last_locked"))
    pairs = pairs.where(~F.coalesce(safe, F.lit(False)))
    bracketed = F.col("r.transaction_held") & F.col("transaction_held")
    pick = lambda thread, init_locked, init_bare, held, bare: F.when(F.col("thread_static"), thread).when(lazy & F.col("lock_held"), init_locked).when(lazy, init_bare).when(bracketed, held).otherwise(bare)
    return pairs.select(
        "enclosing", "cell", "file_path", F.col("line").alias("write_line"), F.col("r.file_path").alias("read_file"), F.col("r.line").alias("read_line"),
        pick("thread_local_context", "lazy_init_race", "lazy_init_race", "race_window", "race_window").alias("type"), pick("low", "low", "low", "medium", "high").alias("confidence"),
        pick("thread_static_context", "lazy_init_in_lock", "lazy_init_shape", "in_transaction", "no_isolation").alias("reason"),
    )


def dual_writes(effects: DataFrame, systems: dict[str, str]) -> DataFrame:
    """(enclosing, systems, sites, line, provider): methods whose writes go to two systems or more, at their last write.

    systems maps provider:operation, or else a provider alone, to a system; what it doesn't name is no write. A
    method's sites are at most its lines.
    """
    if not systems:
        return effects.select("enclosing", F.lit("").alias("systems"), F.lit("").alias("sites"), "line", "provider").where("false")
    known = F.create_map(*(F.lit(x) for pair in systems.items() for x in pair))
    system = F.coalesce(F.try_element_at(known, F.concat("provider", F.lit(":"), "operation")), F.try_element_at(known, F.col("provider")))
    rows = effects.where("enclosing is not null").withColumn("system", system).where("system is not null")
    rows = rows.groupBy("enclosing").agg(F.array_sort(F.collect_set("system")).alias("all"), F.array_sort(F.collect_set(F.struct("line", "file_path"))).alias("at"), F.max(F.struct("line", "provider")).alias("last"))
    sites = F.array_join(F.transform("at", lambda x: F.concat(x["file_path"], F.lit(":"), x["line"].cast("string"))), ",")
    return rows.where(F.size("all") >= 2).select("enclosing", F.array_join("all", "+").alias("systems"), sites.alias("sites"), F.col("last.line").alias("line"), F.col("last.provider").alias("provider"))


def sync_over_async(effects: DataFrame, methods: DataFrame) -> DataFrame:
    """Blocking waits (effects of async_block) in methods that are themselves async."""
    own = methods.where(F.array_contains(F.split("modifiers", " "), "async")).select(F.col("symbol_id").alias("enclosing")).distinct()
    return effects.where("provider = 'async_block'").join(own, "enclosing", "left_semi").select("enclosing", F.col("operation").alias("context"), "file_path", "line")


def static_captures(effects: DataFrame, fields: DataFrame, sources: list[str]) -> DataFrame:
    """Effects in the initialiser of a static field whose resource names a mutable source: read once, kept for good."""
    static = fields.where(F.array_contains(F.split("modifiers", " "), "static")).select(F.col("symbol_id").alias("enclosing")).distinct()
    named = F.lit(False)
    for s in filter(None, sources):
        named = named | F.contains("resource", F.lit(s))
    return effects.where(F.startswith("enclosing", F.lit("F:")) & named).join(static, "enclosing", "left_semi").select("enclosing", "resource", "file_path", "line").distinct()


def excluded(findings: DataFrame, namespaces: list[str]) -> DataFrame:
    """Findings whose enclosing symbol lies in none of the namespaces."""
    off = F.lit(False)
    for n in namespaces:
        off = off | docid.within(docid.bare(F.col("enclosing")), F.lit(n))
    return findings.where(~F.coalesce(off, F.lit(False)))


def grouped(findings: DataFrame) -> DataFrame:
    """(type, n, methods): findings and the methods that have them."""
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("enclosing").alias("methods"))


def missing_companions(anchors: DataFrame, companions: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Anchors (sym, key) from which no companion (sym, key) of the same key is reached; walked back from the companions,
    key by key, so that a row is a key and a node that reaches it."""
    met = nearest(edges, companions.select(F.col("key").alias("seed"), "sym"), max_depth).select(F.col("seed").alias("key"), "sym")
    return anchors.select("sym", "key").distinct().join(met, ["sym", "key"], "left_anti")


def event_cycles(edges: DataFrame, joins: dict[str, str], symbols: DataFrame | None = None) -> DataFrame:
    """(cycle, sym, confidence, deliveries): members of the cycles that a delivery closes, by their least member.

    edges: (src, dst, kind, tag, line), deliveries among them: handoffs whose tag is one of joins. A cycle is low if any
    delivery in it is joined by a heuristic (low), else high. Edges that repeat change nothing. symbols: as strong takes them.
    """
    given = edges.where((F.col("kind") == "handoff") & F.col("tag").isin(*joins))
    scc = strong(edges, symbols)
    ends = given.join(scc.select(F.col("sym").alias("src"), "scc"), "src").join(scc.select(F.col("sym").alias("dst"), F.col("scc").alias("of_dst")), "dst").where("scc = of_dst")
    doubtful = F.col("tag").isin(*(t for t, sure in joins.items() if sure == "low"))
    closed = ends.groupBy("scc").agg(F.bool_or(doubtful).alias("low"), F.countDistinct("src", "dst", "line", "tag").alias("deliveries"))
    return scc.join(closed, "scc").select(F.col("scc").alias("cycle"), "sym", F.when(F.col("low"), "low").otherwise("high").alias("confidence"), "deliveries")


def amplified(events: DataFrame, effects: DataFrame, edges: DataFrame, max_depth: int | None = 6, top: int = 3) -> DataFrame:
    """Looped call sites from which effects are reached: the nearest few of each site, with a confidence by depth.

    The nearest are walked back from the effects, kind by kind. The few are kept by rank within a site's kinds.
    """
    kinds = effects.select(F.struct("provider", "operation").alias("seed"), F.col("enclosing").alias("sym")).distinct()
    near = nearest(edges, kinds, max_depth).select(F.col("sym").alias("enclosing"), "seed.provider", "seed.operation", "depth", "origin")
    best = events.join(near, "enclosing").groupBy("caller", "file_path", "line", "provider", "operation").agg(F.min(F.struct(F.col("depth"), F.col("origin").alias("sym"))).alias("b"))
    order = W.partitionBy("caller", "file_path", "line").orderBy("b", "provider", "operation")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    level = F.when(F.col("b.depth") <= 1, "high").when(F.col("b.depth") <= 4, "medium").otherwise("low")
    return best.select("caller", "file_path", "line", "provider", "operation", F.col("b.depth").alias("depth"), level.alias("confidence"), "rank")


def _loose(sym):
    """A type without arity marks, as the namespace of routes and gates."""
    return F.regexp_replace(sym, r"`+[0-9]+", "")


def _route(path, prefix: str):
    """What follows the prefix, with slashes; null outside the prefix."""
    return F.when(F.startswith(path, F.lit(prefix)), F.replace(F.substring(path, len(prefix) + 1, 1 << 20), F.lit("."), F.lit("/")))


def _below(ancestors: DataFrame, bases: list[str], strict: bool) -> DataFrame:
    return ancestors.where(F.col("ancestor").isin(*bases) & (F.col("depth") >= int(strict))).select(F.col("type_id").alias("containing_symbol_id")).distinct()


def _entries(rows: DataFrame, rule: dict, number: int, route, shown) -> DataFrame:
    requires = F.array(*(F.lit(x) for x in rule["requires"])) if rule["requires"] else F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("route", route).where("route is not null")
    return rows.select(F.lit(number).alias("rule"), F.lit(rule["kind"]).alias("kind"), F.lit(rule["method"]).alias("method"), "route", F.concat(F.lit(f"{rule['kind']} {rule['method']} "), shown).alias("display"), "file_path", "line", requires.alias("requires"), "symbol_id")


def entry_points(methods: DataFrame, attributes: DataFrame, ancestors: DataFrame, rules: dict) -> DataFrame:
    """(kind, method, route, display, file_path, line, requires): of pages, actions and handlers, by the rules' order.

    A page is a concrete type at or below a base: at each of its constructors, else at the type's first line. An action is
    a method of such a type with an attribute (attributes: enclosing, target, file_path, line). A handler is a method
    of a type strictly below a base, or of any for "*", with the names, override, attribute and parameter types that the
    rule wants. A site belongs to the first rule that claims it.
    """
    out, number = [], 0
    tokens = F.split("modifiers", " ")
    member = docid.member(F.col("symbol_id"))
    for rule in rules["pages"]:
        number += 1
        own = methods.join(_below(ancestors, rule["baseTypes"], False), "containing_symbol_id", "left_semi")
        made = own.where(member == "#ctor").select("containing_symbol_id", "symbol_id", "file_path", "line")
        bare = own.groupBy("containing_symbol_id").agg(F.min(F.struct("file_path", "line", "symbol_id")).alias("t"), F.bool_and(F.array_contains(tokens, "abstract")).alias("abstract")).where("not abstract")
        bare = bare.join(made.select("containing_symbol_id").distinct(), "containing_symbol_id", "left_anti").select("containing_symbol_id", F.col("t.symbol_id").alias("symbol_id"), F.col("t.file_path").alias("file_path"), F.col("t.line").alias("line"))
        route = _route(_loose(F.substring("containing_symbol_id", 3, 1 << 20)), rule["namespacePrefix"])
        arguments = F.when(member == "#ctor", F.regexp_extract("symbol_id", r"(\(.*)$", 1)).otherwise("")
        out.append(_entries(made.unionByName(bare), rule, number, route, F.concat("route", arguments)))
    for rule in rules["actions"]:
        number += 1
        hit = F.lit(False)
        for p in rule["attributePrefixes"]:
            hit = hit | F.startswith("target", F.lit(p))
        own = attributes.where(hit & F.startswith("enclosing", F.lit("M:"))).withColumn("containing_symbol_id", F.concat(F.lit("T:"), docid.declaring_type(F.col("enclosing"))))
        own = own.join(_below(ancestors, rule["baseTypes"], False), "containing_symbol_id", "left_semi").withColumnRenamed("enclosing", "symbol_id")
        path = docid.bare(F.col("symbol_id"))
        route = F.concat(_route(docid.declaring_type(F.col("symbol_id")), rule["namespacePrefix"]), F.lit("."), docid.member(F.col("symbol_id")))
        out.append(_entries(own.where(F.startswith(path, F.lit(rule["namespacePrefix"]))), rule, number, route, F.col("route")))
    for rule in rules["classes"]:
        number += 1
        own = methods.where(member != "#ctor")
        if "*" not in rule["baseTypes"]:
            own = own.join(_below(ancestors, rule["baseTypes"], True), "containing_symbol_id", "left_semi")
        if "*" not in rule["handlerMethods"]:
            own = own.where(F.col("name").isin(*rule["handlerMethods"]))
        if rule["requireOverride"]:
            own = own.where("is_override")
        if rule["attributePrefixes"]:
            hit = F.lit(False)
            for p in rule["attributePrefixes"]:
                hit = hit | F.startswith("target", F.lit(p))
            own = own.join(attributes.where(hit).select(F.col("enclosing").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
        if rule["parameterTypes"]:
            types = F.transform(docid.top_level(F.regexp_extract("symbol_id", r"\((.*)\)", 1)), lambda t: F.regexp_extract(t, r"([^. ]+?)(?:[<{].*)?$", 1))
            own = own.where(F.size(F.array_except(F.array(*(F.lit(x) for x in rule["parameterTypes"])), types)) == 0)
        route = F.concat(_loose(F.substring("containing_symbol_id", 3, 1 << 20)), F.lit("."), F.col("name"))
        out.append(_entries(own.where(F.startswith("containing_symbol_id", F.lit("T:"))), rule, number, route, F.col("route")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    columns = [c for c in rows.columns if c not in ("rule", "file_path", "line")]
    best = rows.groupBy("file_path", "line").agg(F.min(F.struct("rule", "route", "symbol_id", "kind", "method", "display", "requires")).alias("x"))
    return best.select(*(F.col(f"x.{c}").alias(c) for c in columns), "file_path", "line")


def activated(entries: DataFrame, deployments: list[dict]) -> DataFrame:
    """entries with ``services``: those that provide any capability that an entry point requires; all if it requires none."""
    lower = lambda xs: F.array(*(F.lit(x.lower()) for x in xs))
    wanted = F.transform("requires", lambda x: F.lower(x))
    served = F.filter(F.array(*(F.when((F.size("requires") == 0) | F.arrays_overlap(wanted, lower(d["provides"])), F.lit(d["service"])) for d in deployments)), lambda s: s.isNotNull())
    return entries.withColumn("services", served)


OFF_GRAPH = ("get_", "set_", "add_", "remove_", "op_")


def dead_code(methods: DataFrame, alive: DataFrame, edges: DataFrame, dispatched: bool = False) -> DataFrame:
    """(symbol_id, tier, reason, callers): methods that nothing alive reaches, by how surely nothing else can.

    Left out: what is called off the graph (constructors, finalisers, accessors, operators), generated and abstract
    methods, and, unless dispatched, overrides and virtual ones. Private is high, public and protected low.
    """
    tokens = F.split("modifiers", " ")
    has = lambda t: F.array_contains(tokens, t)
    off = F.col("name").isin(".ctor", ".cctor", "Finalize")
    for p in OFF_GRAPH:
        off = off | F.startswith("name", F.lit(p))
    rows = methods.where(~has("abstract") & ~off & ~F.col("file_path").rlike(r"\.g\.cs$"))
    if not dispatched:
        rows = rows.where(~has("virtual") & ~F.col("is_override"))
    rows = rows.join(alive.select(F.col("sym").alias("symbol_id")), "symbol_id", "left_anti")
    callers = edges.groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("callers"))
    rows = rows.join(callers, "symbol_id", "left").na.fill(0, ["callers"])
    tier = F.when(has("private"), "high").when(has("public") | has("protected"), "low").otherwise("medium")
    return rows.select("symbol_id", tier.alias("tier"), F.when(F.col("callers") == 0, "uncalled").otherwise("only reached by dead code").alias("reason"), "callers")
