"""Reports over facts: usage, search, hotspots, dispatch fans, and two-store differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import docid


def usage_edges(refs: DataFrame, methods: DataFrame) -> DataFrame:
    """(from_assembly, to_assembly, n, callers) across assemblies."""
    own = methods.select(F.col("symbol_id").alias("enclosing"), F.col("defining_assembly").alias("from_assembly"))
    rows = refs.select("enclosing", F.col("target_assembly").alias("to_assembly")).join(own, "enclosing").where("from_assembly <> to_assembly")
    return rows.groupBy("from_assembly", "to_assembly").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("enclosing").alias("callers"))


def unused(declared: DataFrame, used: DataFrame) -> DataFrame:
    return declared.join(used.select("from_assembly", "to_assembly"), ["from_assembly", "to_assembly"], "left_anti")


def owner(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_path, project): the project of the longest directory that the file lies in.

    A file's directories are few and named by the file: they are listed and joined by equality, with no prefix join.
    """
    parts = F.split("file_path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.select("file_path").distinct().select("file_path", F.explode(dirs).alias("dir")).join(projects, "dir")
    return rows.groupBy("file_path").agg(F.max(F.struct(F.length("dir").alias("n"), F.col("project"))).alias("x")).select("file_path", F.col("x.project").alias("project"))


def modal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; of equals the least."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value))).alias("x"))
    return best.select(group, F.col(f"x.{value}").alias(value))


def search(methods: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Symbols that hold a text in their id or name, without regard to case and with no wildcards; lambdas aside. A top-k report."""
    held = F.contains(F.lower("symbol_id"), F.lit(text.lower())) | F.contains(F.lower("name"), F.lit(text.lower()))
    rows = methods.where(held & ~F.contains("symbol_id", F.lit("~λ")))
    rank = F.when(F.lower("name") == text.lower(), 0).when(F.startswith(F.lower("name"), F.lit(text.lower())), 1).otherwise(2)
    return rows.select("symbol_id", "name", rank.alias("rank")).distinct().orderBy("rank", F.length("symbol_id"), "symbol_id").limit(limit)


def hotspots(edges: DataFrame, methods: DataFrame, effects: DataFrame, hazards: DataFrame, amplifying: DataFrame, fans: DataFrame) -> DataFrame:
    """Per method: callers, callees and their call sites, effect sites, kinds and density, hazard sites and kinds,
    amplifying sites, and its fan of dispatch.

    Each fact is aggregated by method before the join, so the join has one row per method on every side. effects and
    amplifying: (enclosing, provider, operation, resource, file_path, line); hazards: (enclosing, type, file_path, line).
    """
    sites = edges.select("src", "dst", "file_path", "line").distinct()
    into = sites.groupBy(F.col("dst").alias("symbol_id")).agg(F.countDistinct("src").alias("callers"), F.countDistinct("src", "file_path", "line").alias("incoming"))
    from_ = sites.groupBy(F.col("src").alias("symbol_id")).agg(F.countDistinct("dst").alias("callees"), F.countDistinct("dst", "file_path", "line").alias("outgoing"))
    site = F.struct("provider", "operation", "resource", "file_path", "line")
    own = effects.groupBy(F.col("enclosing").alias("symbol_id")).agg(F.countDistinct(site).alias("effect_sites"), F.countDistinct("provider", "operation").alias("effect_kinds"))
    risks = hazards.groupBy(F.col("enclosing").alias("symbol_id")).agg(F.countDistinct("type", "file_path", "line").alias("hazard_sites"), F.countDistinct("type").alias("hazard_kinds"))
    more = amplifying.groupBy(F.col("enclosing").alias("symbol_id")).agg(F.countDistinct(site).alias("amplifying_sites"))
    spread = fans.select(F.col("hub").alias("symbol_id"), "fan", "incoming_unnarrowed", "rank")
    span = F.when((F.col("end_line") >= F.col("line")) & (F.col("line") > 0), F.col("end_line") - F.col("line") + 1).otherwise(1)
    rows = methods.select("symbol_id", span.alias("lines"))
    for side in (into, from_, own, risks, more, spread):
        rows = rows.join(side, "symbol_id", "left")
    return rows.na.fill(0).withColumn("density", F.round(F.col("effect_sites") * 100.0 / F.col("lines"), 6).cast("double"))


def dispatch_fans(edges: DataFrame, hubs: DataFrame, targets: DataFrame, narrowed: DataFrame, types: DataFrame) -> DataFrame:
    """Per hub with two targets or more, the calls whose receiver doesn't narrow them, by why not; rank is fan times calls.

    hubs: (hub, grp); targets: (hub, dst) with groups as hubs; narrowed: (grp, receiver, dst), for the receivers that
    narrow at all; types: (type_id) known. Targets are counted once a group, calls once a hub and receiver.
    """
    fan = hubs.join(targets.groupBy(F.col("hub").alias("grp")).agg(F.countDistinct("dst").alias("fan")).where("fan >= 2"), "grp")
    less = narrowed.groupBy("grp", "receiver").agg(F.countDistinct("dst").alias("left"))
    calls = edges.where("kind <> 'handoff'").groupBy(F.col("dst").alias("hub"), F.col("receiver_type").alias("receiver")).agg(F.count(F.lit(1)).alias("sites")).join(fan, "hub")
    calls = calls.join(less, ["grp", "receiver"], "left").where("left is null or left = fan")
    known = types.select(F.col("type_id").alias("receiver")).distinct().withColumn("known", F.lit(True))
    calls = calls.join(known, "receiver", "left")
    absent = F.coalesce("receiver", F.lit("")) == ""
    base = docid.bare(F.col("receiver")) == docid.declaring_type(F.col("hub"))
    parameter = ~F.contains(docid.bare(F.col("receiver")), F.lit(".")) & F.col("known").isNull()
    cause = F.when(absent, "absent").when(base, "base_typed").when(parameter, "type_parameter").otherwise("external")
    rows = calls.withColumn("cause", cause).groupBy("hub", "fan").agg(F.sum("sites").alias("incoming_unnarrowed"), *(F.coalesce(F.sum(F.when(F.col("cause") == c, F.col("sites"))), F.lit(0).cast("long")).alias(c) for c in ("absent", "base_typed", "type_parameter", "external")))
    return rows.withColumn("rank", F.col("fan") * F.col("incoming_unnarrowed"))


def effect_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(enclosing, provider, operation, change): added, removed and amplified effects between two footprints (n, in_loop)."""
    keys = ["enclosing", "provider", "operation"]
    both = base.select(*keys, F.col("n").alias("b_n"), F.col("in_loop").alias("b_loop")).join(head.select(*keys, F.col("n").alias("h_n"), F.col("in_loop").alias("h_loop")), keys, "full_outer")
    change = F.when(F.col("b_n").isNull(), "added").when(F.col("h_n").isNull(), "removed").when((F.col("h_n") > F.col("b_n")) | (F.col("h_loop") & ~F.col("b_loop")), "amplified")
    return both.select(*keys, change.alias("change")).where("change is not null")


def footprint(effects: DataFrame) -> DataFrame:
    return effects.groupBy("enclosing", "provider", "operation").agg(F.count(F.lit(1)).alias("n"), F.bool_or("in_loop").alias("in_loop"))


def effect_difference(pairs: DataFrame, reach: DataFrame, effects: DataFrame, suffixes: list[str]) -> DataFrame:
    """(label, resource_key, side, categories): keys that only one of two entry points reaches.

    pairs: (label, a, b); reach: (seed, sym) of all of them; effects: (enclosing, provider, operation, resource). Resources
    are compared by their keys; categories are the provider:operation that make a key where it is.
    """
    rows = effects.select(F.col("enclosing").alias("sym"), docid.resource_key(F.col("resource"), suffixes).alias("resource_key"), F.concat("provider", F.lit(":"), "operation").alias("category"))
    found = reach.select("seed", "sym").join(rows.where("resource_key is not null").distinct(), "sym").select("seed", "resource_key", "category").distinct()
    ends = pairs.select("label", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("seed")), F.struct(F.lit("b").alias("side"), F.col("b").alias("seed")))).alias("e")).select("label", "e.*")
    each = ends.join(found, "seed").groupBy("label", "resource_key").agg(F.array_sort(F.collect_set("side")).alias("sides"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return each.where(F.size("sides") == 1).select("label", "resource_key", F.concat(F.get("sides", F.lit(0)), F.lit("_only")).alias("side"), "categories")


def changed_bodies(base: DataFrame, head: DataFrame) -> DataFrame:
    """Symbols whose body differs, or that only one side has."""
    rows = base.select("symbol_id", F.col("body_hash").alias("b")).join(head.select("symbol_id", F.col("body_hash").alias("h")), "symbol_id", "full_outer")
    return rows.where("not (b <=> h)").select("symbol_id")


def reach_changes(base: DataFrame, head: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Per entry point (seed) of both closures (seed, sym): what its reach gained and lost, and why.

    Overloads count as one stem: a stem that is gained and lost is changed. in_place are shared symbols of changed
    (symbol_id) bodies. delta ranks. The cause is a record's shape if four fifths of the stems are accessors, field
    reads or constructors, constructors' signatures if all are constructors.
    """
    ends = base.select("seed").distinct().join(head.select("seed").distinct(), "seed", "left_semi")
    marked = base.select("seed", "sym", F.lit(1).alias("b"), F.lit(0).alias("h")).unionByName(head.select("seed", "sym", F.lit(0).alias("b"), F.lit(1).alias("h")))
    each = marked.join(ends, "seed", "left_semi").groupBy("seed", "sym").agg(F.max("b").alias("b"), F.max("h").alias("h"))
    stems = each.where("b <> h").groupBy("seed", F.substring_index("sym", "(", 1).alias("stem")).agg(F.bool_or(F.col("h") == 1).alias("won"), F.bool_or(F.col("b") == 1).alias("lost"))
    made = F.endswith("stem", F.lit(".#ctor"))
    shape = made | F.startswith("stem", F.lit("R:")) | F.contains("stem", F.lit(".get_")) | F.contains("stem", F.lit(".set_"))
    rows = stems.groupBy("seed").agg(
        F.count_if(F.col("won") & ~F.col("lost")).alias("added"), F.count_if(F.col("lost") & ~F.col("won")).alias("removed"), F.count_if(F.col("won") & F.col("lost")).alias("changed"),
        F.count_if(made).alias("made"), F.count_if(shape).alias("shape"),
    )
    if changed is not None:
        here = each.where("b = 1 and h = 1").join(changed.select(F.col("symbol_id").alias("sym")), "sym", "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("in_place"))
        rows = rows.join(here, "seed", "full_outer").na.fill(0)
    else:
        rows = rows.withColumn("in_place", F.lit(0).cast("long"))
    moved = F.col("added") + F.col("removed") + F.col("changed")
    cause = F.when(moved == 0, F.when(F.col("in_place") > 0, "InPlace").otherwise("Other")).when(F.col("made") == moved, "CtorSig").when(F.col("shape") * 5 >= moved * 4, "RecordShape").otherwise("Other")
    return rows.select("seed", "added", "removed", "changed", "in_place", (moved + F.col("in_place")).alias("delta"), cause.alias("cause"))


def guard_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(src, dst, change) of edges on both sides whose guards, conditions as text, differ as sets of clauses.

    A condition is parsed once, however many edges have it.
    """
    def clauses(rows: DataFrame, name: str) -> DataFrame:
        parsed = rows.select("guard").distinct().select("guard", docid.conjuncts(F.col("guard")).alias("c"))
        each = rows.select("src", "dst", "guard").join(parsed, "guard", "left").select("src", "dst", F.coalesce("c", F.expr("cast(array() as array<string>)")).alias("c"))
        return each.groupBy("src", "dst").agg(F.array_distinct(F.flatten(F.collect_set("c"))).alias(name))

    rows = clauses(base, "b").join(clauses(head, "h"), ["src", "dst"])
    more, less = F.size(F.array_except("h", "b")) > 0, F.size(F.array_except("b", "h")) > 0
    return rows.select("src", "dst", F.when(more & less, "Changed").when(more, "Narrowed").when(less, "Widened").alias("change")).where("change is not null")


def gates(footprint: DataFrame, guards: DataFrame) -> DataFrame:
    """One row: entry points whose effects changed, and guards that got narrower."""
    a = footprint.agg(F.countDistinct("enclosing").alias("effect_changed"))
    b = guards.where("change = 'Narrowed'").agg(F.count(F.lit(1)).alias("narrowed_guards"))
    return a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").drop("_k")


def ranked(rows: DataFrame, group: list[str], order: list, top: int) -> DataFrame:
    """The first rows of each group; no group is gathered beyond what its partial limits leave."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= top).drop("_n")


def digests(methods: DataFrame) -> DataFrame:
    """An order-independent digest of each assembly's symbols: four xors of 60 bits each, a sum of 28 bits, and their number."""
    hash_ = F.sha2(F.concat_ws("|", "symbol_id", "body_hash"), 256)
    bits = lambda at, n: F.conv(F.substring(hash_, at, n), 16, 10).cast("long")
    return methods.groupBy("defining_assembly").agg(*(F.bit_xor(bits(15 * k + 1, 15)).alias(f"x{k}") for k in range(4)), F.sum(bits(58, 7)).alias("s"), F.count(F.lit(1)).alias("n"))


def findings(observed: DataFrame, races: DataFrame, dual: DataFrame, waits: DataFrame, captures: DataFrame) -> DataFrame:
    """All findings as one row type: type, confidence, enclosing, context, detail, line, provider."""
    none = F.lit(None).cast("string")
    at = lambda file, line: F.concat(file, F.lit(":"), line.cast("string"))
    row = lambda type_, sure, context, detail, line, provider: [type_.alias("type"), sure.alias("confidence"), F.col("enclosing"), context.alias("context"), detail.alias("detail"), line.cast("long").alias("line"), provider.alias("provider")]
    c = F.col
    out = observed.select(*row(c("type"), F.lit("high"), c("context"), c("detail"), c("line"), c("provider")))
    out = out.unionByName(races.select(*row(c("type"), c("confidence"), c("cell"), at(c("read_file"), c("read_line")), c("write_line"), F.lit("state"))))
    out = out.unionByName(dual.select(*row(F.lit("dual_write"), F.lit("medium"), c("systems"), c("sites"), c("line"), c("provider"))))
    out = out.unionByName(waits.select(*row(F.lit("sync_over_async"), F.lit("high"), c("context"), docid.member(c("enclosing")), c("line"), F.lit("async_block"))))
    return out.unionByName(captures.select(*row(F.lit("static_init_capture"), F.lit("medium"), c("resource"), c("enclosing"), c("line"), none)))


def classified(files: DataFrame, excluded: list[str]) -> DataFrame:
    """(file_path, status, reason): generated, test, excluded by a pattern, or included."""
    out = F.lit(False)
    for p in excluded:
        out = out | F.col("file_path").rlike(docid.glob(p))
    status = F.when(F.col("file_path").rlike(r"\.g\.cs$"), "generated").when(F.contains("file_path", F.lit("/tests/")), "test").when(out, "excluded").otherwise("included")
    own = F.when(F.col("status") == "generated", "name ends in .g.cs").when(F.col("status") == "test", "lies in a tests folder")
    named = F.coalesce(*(F.when(F.col("file_path").rlike(docid.glob(p)), F.lit(f"matches {p}")) for p in excluded), F.lit(None).cast("string"))
    return files.select("file_path").distinct().select("file_path", status.alias("status")).withColumn("reason", F.when(F.col("status") == "excluded", named).otherwise(own))


def listing(registrations: DataFrame) -> DataFrame:
    """Registrations, each service, implementation and site once."""
    return registrations.select("service", "implementation", "file_path", "line").distinct()


def folded(edges: DataFrame) -> DataFrame:
    """Sibling calls that read the same as one, with how many sites they have and the first of them."""
    return edges.groupBy("src", "dst", "kind", "receiver_type").agg(F.count(F.lit(1)).alias("sites"), F.min("line").alias("line"))


def rebound(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """edges with the type arguments of their call site (src, dst, line): the least where a site has several."""
    one = bindings.groupBy("src", "dst", "line").agg(F.min("type_arguments").alias("type_arguments"))
    return edges.select("src", "dst", "line").distinct().join(one, ["src", "dst", "line"], "left")


def ambiguous(targets: DataFrame, pattern: str) -> DataFrame:
    """Names without parameters that a pattern stands for; more than one wants a choice. targets: (sym)."""
    return targets.where(F.contains(F.lower("sym"), F.lit(pattern.lower()))).select(docid.bare(F.col("sym")).alias("name")).distinct()


def keyed(refs: DataFrame, symbols: DataFrame, column: str) -> DataFrame:
    """References whose key column is one of the symbols (sym); each reference as often as it is there."""
    return refs.join(symbols.select(F.col("sym").alias(column)).distinct(), column, "left_semi")


def loop_depths(sites: DataFrame) -> DataFrame:
    """(enclosing, detail, depth) of the loops in each method, by line spans: 1 and as many as strictly hold it.

    sites: (enclosing, kind, detail, line). A loop's span is that of its sites. Clauses of one query bind
    more and more names; queries of a method whose names contain one another are one family with one span. Loops are
    compared within a method only, and a method has no more of them than lines.
    """
    loops = sites.groupBy("enclosing", "detail").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.bool_or(F.col("kind") == "query").alias("query"))
    bound = F.transform(F.split(F.substring_index("detail", " in ", 1), ","), lambda x: F.trim(x))
    loops = loops.withColumn("names", F.when(F.contains("detail", F.lit(" in ")), bound).otherwise(F.expr("cast(array() as array<string>)")))
    each = loops.groupBy("enclosing").agg(F.array_sort(F.collect_list(F.struct("detail", "lo", "hi", "names", "query"))).alias("l"))
    kin = lambda a, b: a["query"] & b["query"] & (F.size(a["names"]) > 0) & (F.size(b["names"]) > 0) & ((F.size(F.array_except(a["names"], b["names"])) == 0) | (F.size(F.array_except(b["names"], a["names"])) == 0))
    # Families grow by merging each loop with all families that it is kin to; a family is an array of loops.
    zero = F.expr("cast(array() as array<array<struct<detail:string,lo:int,hi:int,names:array<string>,query:boolean>>>)")
    families = F.aggregate("l", zero, lambda acc, x: F.concat(
        F.filter(acc, lambda f: ~F.exists(f, lambda y: kin(x, y))),
        F.array(F.concat(F.flatten(F.filter(acc, lambda f: F.exists(f, lambda y: kin(x, y)))), F.array(x)))))
    spans = F.transform(families, lambda f: F.struct(F.transform(f, lambda y: y["detail"]).alias("details"), F.array_min(F.transform(f, lambda y: y["lo"])).alias("lo"), F.array_max(F.transform(f, lambda y: y["hi"])).alias("hi")))
    each = each.select("enclosing", spans.alias("f"))
    deep = F.transform("f", lambda i: F.struct(i["details"].alias("details"), (F.size(F.filter("f", lambda o: (i["lo"] > o["lo"]) & (i["hi"] <= o["hi"]))) + 1).alias("depth")))
    return each.select("enclosing", F.explode(deep).alias("d")).select("enclosing", F.explode("d.details").alias("detail"), F.col("d.depth").alias("depth"))


def _category(categories: list[dict], field: str, default):
    out = F.lit(default)
    for c in reversed(categories):
        hit = F.lit(True)
        for column, names in (("provider", c.get("providers")), ("operation", c.get("operations"))):
            hit = hit & (F.col(column).isin(*names) if names else F.lit(True))
        out = F.when(hit, F.lit(c.get(field, default))).otherwise(out)
    return out


def buckets(findings: DataFrame, categories: list[dict], least: int = 2, top: int = 50) -> DataFrame:
    """findings (degree, provider, operation, file_path, line; -1 for no bound) in main, separate and recursion, the top of each.

    The first category that a finding matches can drop it, weigh it or set it apart; recursion has no least degree.
    Ranked by degree, no bound first, then weight, kind and site. A top-k report.
    """
    rows = findings.where(~_category(categories, "excluded", False)).withColumn("weight", _category(categories, "weight", 0))
    bucket = F.when(F.col("degree") < 0, "recursion").when(F.col("degree") < least, None).when(_category(categories, "separate", False), "separate").otherwise("main")
    rows = rows.withColumn("bucket", bucket).where("bucket is not null")
    order = [F.when(F.col("degree") < 0, 0).otherwise(1), F.desc("degree"), F.desc("weight"), "provider", "operation", "file_path", "line"]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy(*order))).where(F.col("rank") <= top)


def in_scope(effects: DataFrame, scope: list[dict]) -> DataFrame:
    """Effects that an amplification scope admits; an empty list of providers or operations admits any."""
    hit = F.lit(False)
    for r in scope:
        hit = hit | ((F.col("provider").isin(*r["providers"]) if r["providers"] else F.lit(True)) & (F.col("operation").isin(*r["operations"]) if r["operations"] else F.lit(True)))
    return effects.where(hit)


def chosen(stores: DataFrame, ref: str) -> DataFrame:
    """Stores (store_id, created_at) that a reference names: LATEST, an id, or the beginning of one."""
    if ref == "LATEST":
        return stores.orderBy(F.desc("created_at"), "store_id").limit(1)
    both = stores.withColumn("_exact", F.col("store_id") == ref).where(F.col("_exact") | F.startswith("store_id", F.lit(ref)))
    return both.withColumn("_any", F.max("_exact").over(W.partitionBy(F.lit(0)))).where("_exact or not _any").drop("_exact", "_any")


def at_sites(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """sites (file_path, line, ...) with the members that stand there."""
    return sites.join(methods.select("file_path", "line", "symbol_id").distinct(), ["file_path", "line"]).select(*sites.columns, "symbol_id")


def ends(methods: DataFrame, lambdas: DataFrame) -> DataFrame:
    """(symbol_id, file_path, line, end_line, nested) of methods and of the lambdas in them; no end before its beginning."""
    rows = lambda df, nested: df.select("symbol_id", "file_path", "line", F.greatest("line", "end_line").alias("end_line"), F.lit(nested).alias("nested"))
    return rows(methods, False).unionByName(rows(lambdas, True))


def signatures(methods: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, signature, bindings) of the members that are called with type arguments, and with how many of them."""
    bound = refs.where("type_arguments is not null").groupBy(F.col("target").alias("symbol_id")).agg(F.countDistinct("type_arguments").alias("bindings"))
    return methods.select("symbol_id", F.regexp_extract("symbol_id", r"\((.*)\)", 1).alias("signature")).join(bound, "symbol_id")


def seed_notices(patterns: list[str], names: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, notice, matches): why a walk from a pattern may be empty: it names nothing, or nothing that calls.

    One pass over the names for all patterns, which a user types.
    """
    leads = edges.select(F.col("src").alias("sym")).distinct().withColumn("leads", F.lit(True))
    hit = F.filter(F.array(*(F.when(F.contains(F.lower("sym"), F.lit(p.lower())), F.lit(p)) for p in patterns)), lambda p: p.isNotNull())
    found = names.join(leads, "sym", "left").select(F.explode(hit).alias("pattern"), "leads").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("leads").alias("leads"))
    rows = names.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string").join(found, "pattern", "left")
    notice = F.when(F.col("n").isNull(), "no match").when(F.col("leads") == 0, "no calls out of it").otherwise("found")
    return rows.select("pattern", notice.alias("notice"), F.coalesce("n", F.lit(0)).cast("long").alias("matches"))


def guards_only(guards: DataFrame, footprint: DataFrame, access: DataFrame) -> DataFrame:
    """Guard changes (src, dst, change) of members whose effects stayed as they were, and whether the member writes shared state."""
    quiet = guards.join(footprint.select(F.col("enclosing").alias("src")).distinct(), "src", "left_anti")
    writes = access.where((F.col("access") == "write") & F.array_contains(F.split("modifiers", " "), "static")).select(F.col("enclosing").alias("src")).distinct().withColumn("shared", F.lit(True))
    return quiet.join(writes, "src", "left").select("src", "dst", "change", F.coalesce("shared", F.lit(False)).alias("shared_mutation"))


def entry_footprint(reach: DataFrame, effects: DataFrame) -> DataFrame:
    """(seed, provider, operation, n, in_loop): of each entry point's reach (seed, sym), the members that produce an effect."""
    own = effects.groupBy(F.col("enclosing").alias("sym"), "provider", "operation").agg(F.bool_or("in_loop").alias("in_loop"))
    return reach.select("seed", "sym").join(own, "sym").groupBy("seed", "provider", "operation").agg(F.count(F.lit(1)).alias("n"), F.bool_or("in_loop").alias("in_loop"))


def entry_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(seed, provider, operation, change, delta) between two footprints of the entry points that both have: added, removed,
    or amplified, by more producers or by a loop."""
    keys = ["seed", "provider", "operation"]
    both = base.select(*keys, F.col("n").alias("b_n"), F.col("in_loop").alias("b_loop")).join(head.select(*keys, F.col("n").alias("h_n"), F.col("in_loop").alias("h_loop")), keys, "full_outer")
    ends_ = base.select("seed").distinct().join(head.select("seed").distinct(), "seed", "left_semi")
    change = F.when(F.col("b_n").isNull(), "added").when(F.col("h_n").isNull(), "removed").when((F.col("h_n") > F.col("b_n")) | (F.col("h_loop") & ~F.col("b_loop")), "amplified")
    rows = both.join(ends_, "seed", "left_semi").withColumn("change", change).where("change is not null")
    return rows.select(*keys, "change", (F.coalesce("h_n", F.lit(0)) - F.coalesce("b_n", F.lit(0))).alias("delta"))
