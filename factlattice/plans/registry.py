"""Queries over the adapter's facts, each with the SQL that DuckDB answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import docid
from ..operators import effects as fx
from ..operators import generics, graph, hazards, reach, reports
from ..sources import facts as source
from ..sources import rules as rulebook
from ..streaming import overlay
from .steps import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EDGES = ("edges", """
select distinct enclosing as src, target as dst, ref_kind as kind, file_path, line, loop_kind, receiver_type, delegate_consumer
from refs where enclosing is not null and target_in_source and ref_kind in ('invocation', 'methodGroup', 'ctor')""")
CLOSURE = ("closure", """
select type_id, ancestor, min(depth) as depth from (
  with recursive c(type_id, ancestor, depth) as (
    select x, x, 0 from (select type_id as x from type_relations union select related_id from type_relations) n
    union select c.type_id, r.related_id, c.depth + 1 from c join type_relations r on r.type_id = c.ancestor where c.depth < 10)
  select * from c) x group by type_id, ancestor""")
MINED = ("mined", """
select src, dst, kind from (
  with recursive m(src, dst, kind) as (
    select source_member, target_member, kind from dispatch where kind in ('impl', 'override')
    union select m.src, d.target_member, m.kind from m join dispatch d on d.source_member = m.dst and d.kind = m.kind)
  select distinct src, dst, kind from m where src <> dst) x""")


def _listed(values) -> str:
    return "'" + ",".join(values) + "'"


EFFECT_RULES = ("effect_rules", " union all ".join(
    f"select {k} as rule_no, '{r['provider']}' as provider, '{r['operation']}' as operation, '{r.get('on', 'invocation')}' as on_kind, '{m}' as method, {_listed(r.get('receivers', []))} as receivers, "
    f"{_listed(r.get('declaringTypes', []))} as declaring, {_listed(r.get('declaringTypeBaseTypes', []))} as bases, {_listed(r.get('declaringTypeNameEndsWith', []))} as suffixes, {_listed(r.get('containing', []))} as containing, "
    f"'{r['resource']}' as strategy, {r.get('type_argument_index', 'null')} as t_index, {r.get('argument_index', 'null')} as a_index, {r.get('minArguments', 'null')} as least"
    for k, r in enumerate(rulebook.DEFAULT["effects"]) for m in r["methods"] or [""]))
_WITHIN = "len(list_filter(string_split({}, ','), lambda g: {} = replace(g, 'T:', '') or starts_with({}, concat(replace(g, 'T:', ''), '.')))) > 0"
_SUFFIX = "(suffixes = '' or len(list_filter(string_split(suffixes, ','), lambda g: ends_with(regexp_extract(declared, '([^.]+)$', 1), g))) > 0)"
EFFECTS = ("effects", r"""
select * from (
  select x.*, row_number() over (partition by ref_id order by rule_no) as nth from (
    select r.*, u.* exclude (provider, operation, rule_no), u.rule_no, u.provider, u.operation, regexp_extract(r.target, '^M:(.*)[.][^.]+[(]', 1) as declared, case u.strategy
      when 'receiver_type' then r.receiver_type when 'argument_type' then r.first_type
      when 'declaring_type' then regexp_extract(r.target, '^M:(.*)[.][^.]+[(]', 1)
      when 'type_argument' then case t_index when 0 then regexp_extract(r.type_arguments, '^(Pair<[^>]*>),(.*)$', 1) when 1 then regexp_extract(r.type_arguments, '^(Pair<[^>]*>),(.*)$', 2) end
      when 'argument_name' then case when a_index is null then r.argument when not starts_with(json_extract_string(r.argument_names, '$[1]'), '~') then json_extract_string(r.argument_names, '$[1]') end
      when 'string_argument' then case when a_index is null then r.first_template else json_extract_string(r.argument_templates, '$[1]') end
      when 'string_argument_or_receiver' then coalesce(r.first_template, r.receiver_type)
      when 'http_argument' then coalesce(regexp_extract(rtrim(r.first_template, '/'), '(?:://|^/)(.*)$', 1), r.receiver_type)
      when 'ef_query_root' then coalesce(r.type_arguments, r.receiver_type)
      when 'ef_context_receiver' then r.receiver_type when 'ef_dbset_receiver' then r.receiver_type when 'ef_database_facade' then r.receiver_type end as resource
    from refs r join effect_rules u on u.on_kind = r.ref_kind and (u.method = '' or u.method = r.target_name)
    where r.enclosing is not null and (r.ref_kind <> 'invocation' or not r.in_expression_tree) and (u.least is null or json_array_length(r.argument_names) >= u.least)
      and (u.containing = '' or len(list_filter(string_split(u.containing, ','), lambda g: starts_with(r.enclosing, concat('M:', g, '.')))) > 0)) x
  where resource is not null and case when bases <> '' then exists (select 1 from closure c where c.type_id = concat('T:', declared) and contains(concat(',', bases, ','), concat(',', c.ancestor, ','))) and SUFFIX
    when declaring = '' and receivers = '' then SUFFIX when DECLARING then SUFFIX else RECEIVERS_D or RECEIVERS_R end) y where nth = 1""".replace("SUFFIX", _SUFFIX).replace("DECLARING", "(declaring <> '' and " + _WITHIN.format("declaring", "declared", "declared") + ")")
           .replace("RECEIVERS_D", _WITHIN.format("receivers", "declared", "declared")).replace("RECEIVERS_R", _WITHIN.format("receivers", "replace(receiver_type, 'T:', '')", "replace(receiver_type, 'T:', '')")))


def iterated_sql(rows: str) -> str:
    """rows with loop (its kind, null where a query binds once), lam (in an enumerating lambda) and detail."""
    return f"""
select *, coalesce(loop, case when lam then 'lambda' end) as it_kind, coalesce(case when loop is not null then loop_detail end, case when lam then 'y, z in Select' end, loop) as it_detail from (
  select *, case when loop_kind = 'query' and loop_bind_type = 'Lib.Option' then null else loop_kind end as loop, coalesce(starts_with(outer_calls, 'Lib.Seq'), false) as lam from {rows}) x"""


LOOPED = ("looped", iterated_sql("effects"))
FANOUT = ("fanout", f"""
select distinct enclosing as caller, file_path, line, target as enclosing, it_kind as kind, case when contains(it_detail, ' in ') then regexp_extract(it_detail, ' in (.*)$', 1) else '' end as source
from ({iterated_sql("refs")}) i where ref_kind = 'invocation' and enclosing is not null and not in_expression_tree and target_in_source and it_kind is not null""")
CALLS = ("calls", """
select e.src, e.dst, e.kind, e.file_path, e.line, case when e.line % 3 = 0 then null when e.line % 3 = 1 then m.containing_symbol_id when e.line % 6 = 5 then c.containing_symbol_id else e.receiver_type end as receiver_type
from edges e join methods m on m.symbol_id = e.dst join methods c on c.symbol_id = e.src""")
TARGETS = ("targets", """
select t.hub, t.dst, m.containing_symbol_id as type_id from (select src as hub, dst from mined union select distinct a.symbol_id, b.symbol_id from methods b join closure c on c.type_id = b.containing_symbol_id and c.depth > 0
  join methods a on a.containing_symbol_id = c.ancestor and a.name = b.name where b.is_override and a.symbol_id not in (select src from mined)) t join methods m on m.symbol_id = t.dst""")
NARROWED = ("narrowed", """
select * from (with h as (select distinct c.dst as hub, c.receiver_type as receiver from calls c where starts_with(c.receiver_type, 'T:App') and c.dst in (select hub from targets)),
own as (select distinct h.hub, h.receiver, t.dst from h join targets t on t.hub = h.hub join closure c on c.type_id = t.type_id and c.ancestor = h.receiver),
up as (select h.hub, h.receiver, t.dst, c.depth from h join closure c on c.type_id = h.receiver and c.depth > 0 join targets t on t.hub = h.hub and t.type_id = c.ancestor
  where not exists (select 1 from own where own.hub = h.hub and own.receiver = h.receiver))
select hub, receiver, dst from own union all
select distinct u.hub, u.receiver, u.dst from up u join (select hub, receiver, min(depth) as depth from up group by 1, 2) n on n.hub = u.hub and n.receiver = u.receiver and n.depth = u.depth) z""")
FANS = ("fans", """
select c.dst as hub, f.fan, count(*) as incoming_unnarrowed, count(*) filter (where c.receiver_type is null) as absent, count(*) filter (where c.receiver_type = m.containing_symbol_id) as base_typed, cast(0 as bigint) as type_parameter,
  count(*) filter (where c.receiver_type is not null and c.receiver_type <> m.containing_symbol_id) as external, f.fan * count(*) as rank
from calls c join (select hub, count(distinct dst) as fan from targets group by 1 having count(distinct dst) >= 2) f on f.hub = c.dst join methods m on m.symbol_id = c.dst
left join (select hub, receiver, count(distinct dst) as n from narrowed group by 1, 2) x on x.hub = c.dst and x.receiver = c.receiver_type where c.kind <> 'handoff' and (x.n is null or x.n = f.fan) group by c.dst, f.fan""")


def closure_sql(name: str, seeds: str, edges: str = "edges", depth: int | None = None) -> tuple[str, str]:
    """A table (seed, sym, depth) of least depths; all levels there are, or those of a bound that the question names."""
    return name, f"""
with recursive w(seed, sym, depth) using key (seed, sym) as ({seeds} union (
  select w.seed, e.dst, min(w.depth) + 1 from w join (select distinct src, dst from {edges}) e on e.src = w.sym left join recurring.w k on k.seed = w.seed and k.sym = e.dst
  where k.sym is null{f" and w.depth < {depth}" if depth is not None else ""} group by w.seed, e.dst)) select seed, sym, depth from w"""


def whole(df: DataFrame) -> DataFrame:
    """Integers as longs, so that both engines' results have one type."""
    return df.select(*(F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name) for f in df.schema))


def query(name: str, sql: str | None = None, *more: tuple[str, str]):
    """Registers a query over the facts; sql may name the facts and the further tables."""

    def register(f: Callable[[source.Facts], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return whole(f(source.load(spark, sf_dir)))

        QUERIES[name] = run
        if sql:
            # Effects look types up: their closure comes first.
            SQL[name] = source.with_facts(sql, *((CLOSURE, *(m for m in more if m is not CLOSURE)) if EFFECTS in more else more))
        return f

    return register


SEEDS = "select symbol_id as seed, symbol_id as sym, 0 as depth from methods where part_key <= 6"


def seeds(f: source.Facts) -> DataFrame:
    return f.methods.where("part_key <= 6").select(F.col("symbol_id").alias("seed"), F.col("symbol_id").alias("sym"))


def edges_of(f: source.Facts) -> DataFrame:
    return f.kept("edges", lambda: graph.call_edges(f.refs))


def pairs_of(f: source.Facts) -> DataFrame:
    """Who calls whom, once each: what traversals walk. Call edges aren't made for that where no query has wanted them."""
    return f.kept("pairs", lambda: (edges_of(f) if f.has("edges") else graph.call_rows(f.refs)).select("src", "dst").distinct())


def ancestors_of(f: source.Facts) -> DataFrame:
    return f.kept("ancestors", lambda: graph.closure(f.type_relations))


def mined_of(f: source.Facts) -> DataFrame:
    return f.kept("mined", lambda: graph.mined_dispatch(f.dispatch))


def effects_of(f: source.Facts) -> DataFrame:
    return f.kept("effects", lambda: fx.by_rule(f.refs, rulebook.effect_rules(f.refs.sparkSession), ancestors_of(f)))


def effects_by(f: source.Facts, provider: str) -> DataFrame:
    """The effects of one provider; others aren't made for that where no query has wanted them."""
    if f.has("effects"):
        return effects_of(f).where(F.col("provider") == provider)
    return fx.by_rule(f.refs, rulebook.effect_rules(f.refs.sparkSession), ancestors_of(f), provider)


def observed_of(f: source.Facts) -> DataFrame:
    return f.kept("observed", lambda: fx.observations(effects_of(f)))


def calls_of(f: source.Facts) -> DataFrame:
    """Call edges, some of whose receivers are types of the hierarchy or absent."""
    own = f.methods.select(F.col("symbol_id").alias("dst"), F.col("containing_symbol_id").alias("own"))
    caller = f.methods.select(F.col("symbol_id").alias("src"), F.col("containing_symbol_id").alias("of_caller"))
    receiver = F.when(F.col("line") % 3 == 1, F.col("own")).when(F.col("line") % 6 == 5, F.col("of_caller")).when(F.col("line") % 3 != 0, F.col("receiver_type"))
    return edges_of(f).join(own, "dst").join(caller, "src").withColumn("receiver_type", receiver).drop("own", "of_caller")


def groups_of(f: source.Facts) -> tuple[DataFrame, DataFrame]:
    """Dispatched members and their groups; what each group goes to, with types, the group as hub."""
    made = lambda: graph.dispatch_groups(f.methods, ancestors_of(f), mined_of(f))
    targets = f.kept("group_targets", lambda: graph.typed(made()[1], f.methods))
    # A group whose targets no one declares is none.
    return f.kept("group_hubs", lambda: made()[0].join(targets.select(F.col("hub").alias("grp")).distinct(), "grp", "left_semi").select("hub", "grp")), targets


def narrowed_of(f: source.Facts) -> tuple[DataFrame, DataFrame]:
    """The dispatched members that are called, by receiver and group; what each receiver leaves of a group."""
    hubs, targets = groups_of(f)
    called = f.kept("called_groups", lambda: graph.called_groups(calls_of(f), hubs, ancestors_of(f)))
    return called, f.kept("narrowed_groups", lambda: graph.narrowed_groups(called, targets, ancestors_of(f)))


def fans_of(f: source.Facts) -> DataFrame:
    return reports.dispatch_fans(calls_of(f), *groups_of(f), narrowed_of(f)[1], f.methods.select(F.col("containing_symbol_id").alias("type_id")))


# Scans, projections, filters, search


@query("scan_call_edges", "select src, dst, kind, file_path, cast(line as bigint) as line, loop_kind, receiver_type from edges", EDGES)
def _(f):
    return edges_of(f).select("src", "dst", "kind", "file_path", "line", "loop_kind", "receiver_type")


@query("nodes_union", "select src as sym from edges union select dst from edges union select source_member from dispatch union select target_member from dispatch union select symbol_id from methods", EDGES)
def _(f):
    return graph.nodes(edges_of(f), f.dispatch, f.methods)


@query("docid_parts", """
select symbol_id, regexp_replace(regexp_extract(symbol_id, '^([^(]*)', 1), '^M:', '') as bare, containing_symbol_id as declaring, regexp_extract(symbol_id, '([^.(]+)[(]', 1) as member, cast(1 as bigint) as arity from methods""")
def _(f):
    s = F.col("symbol_id")
    return f.methods.select(s, docid.bare(s).alias("bare"), F.concat(F.lit("T:"), docid.declaring_type(s)).alias("declaring"), docid.member(s).alias("member"), docid.arity(s).alias("arity"))


@query("canonical_symbols", "select symbol_id, min(file_path) as file_path, cast(min(line) as bigint) as line from methods group by symbol_id")
def _(f):
    return graph.canonical(f.methods.unionAll(f.methods)).select("symbol_id", "file_path", "line")


@query("search_symbols", """
select symbol_id, name, cast(case when lower(name) = 'do12' then 0 when starts_with(lower(name), 'do12') then 1 else 2 end as bigint) as rank from methods
where contains(lower(symbol_id), 'do12') or contains(lower(name), 'do12') order by 3, length(symbol_id), symbol_id limit 50""")
def _(f):
    return reports.search(f.methods, "Do12")


@query("find_references", "select distinct target, ref_kind, file_path, cast(line as bigint) as line from refs where target in (select symbol_id from methods where contains(lower(symbol_id), 'n1.t')) and target_in_source and ref_kind = 'read'")
def _(f):
    names = f.methods.where(F.contains(F.lower("symbol_id"), F.lit("n1.t"))).select(F.col("symbol_id").alias("target"))
    return f.refs.where("target_in_source and ref_kind = 'read'").join(names, "target", "left_semi").select("target", "ref_kind", "file_path", "line").distinct()


@query("match_nodes", "select symbol_id as sym from methods where regexp_replace(regexp_extract(symbol_id, '^([^(]*)', 1), '^M:', '') = (select regexp_replace(regexp_extract(min(symbol_id), '^([^(]*)', 1), '^M:', '') from methods where part_key = 3)")
def _(f):
    row = f.methods.where("part_key = 3").agg(F.min(docid.bare(F.col("symbol_id"))).alias("x")).first()
    return graph.matched(f.methods.select(F.col("symbol_id").alias("sym")), row["x"] or "")


@query("runs_listing", "select store_id, cast(run_id as bigint) as run_id, cast(n_files as bigint) as n_files from runs order by created_at desc, store_id")
def _(f):
    return f.runs.orderBy(F.desc("created_at"), "store_id").select("store_id", "run_id", "n_files")


@query("skipped_files", "select distinct file_path, case when regexp_matches(file_path, '[.]g[.]cs$') then 'generated' when regexp_matches(file_path, '^src/N3/[^/]*$') then 'excluded' else 'included' end as status, case when regexp_matches(file_path, '[.]g[.]cs$') then 'name ends in .g.cs' when regexp_matches(file_path, '^src/N3/[^/]*$') then 'matches src/N3/*' end as reason from methods")
def _(f):
    return reports.classified(f.methods, ["src/N3/*"])


@query("assembly_digest", "select defining_assembly, " + ", ".join(f"cast(bit_xor(cast(concat('0x', substr(h, {15 * k + 1}, 15)) as bigint)) as bigint) as x{k}" for k in range(4)) + """,
cast(sum(cast(concat('0x', substr(h, 58, 7)) as bigint)) as bigint) as s, count(*) as n from (select defining_assembly, sha256(concat(symbol_id, '|', body_hash)) as h from methods) m group by defining_assembly""")
def _(f):
    return reports.digests(f.methods)


# Usage


@query("assembly_usage_edges", "select m.defining_assembly as from_assembly, r.target_assembly as to_assembly, count(*) as n, count(distinct r.enclosing) as callers from refs r join methods m on m.symbol_id = r.enclosing where m.defining_assembly <> r.target_assembly group by 1, 2")
def _(f):
    return reports.usage_edges(f.refs, f.methods)


@query("assembly_usage_counts", "select target_assembly, count(*) as n, count(distinct enclosing) as callers from refs group by target_assembly")
def _(f):
    return f.refs.groupBy("target_assembly").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("enclosing").alias("callers"))


DECLARED = "select concat('Asm', a) as from_assembly, concat('Asm', b) as to_assembly from (select distinct p_size % 9 as a from part) x, (select distinct p_size % 9 as b from part) y where a <> b"


@query("unused_references", f"""
select from_assembly, to_assembly from ({DECLARED}) d where not exists (select 1 from refs r join methods m on m.symbol_id = r.enclosing where m.defining_assembly = d.from_assembly and r.target_assembly = d.to_assembly)""")
def _(f):
    spark = f.refs.sparkSession
    names = [f"Asm{k}" for k in range(9)]
    declared = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "from_assembly string, to_assembly string")
    return reports.unused(declared, reports.usage_edges(f.refs, f.methods))


PROJECTS = [("src", "all"), ("src/N1", "one"), ("src/N1/T6.cs", "file"), ("src/N2", "two")]
PROJECTS_SQL = " union all ".join(f"select '{d}' as dir, '{p}' as project" for d, p in PROJECTS)


@query("owner_longest_prefix", f"""
select file_path, project from (select m.file_path, p.project, row_number() over (partition by m.file_path order by length(p.dir) desc) as nth
from (select distinct file_path from methods) m join ({PROJECTS_SQL}) p on m.file_path = p.dir or starts_with(m.file_path, concat(p.dir, '/'))) x where nth = 1""")
def _(f):
    return reports.owner(f.methods, f.refs.sparkSession.createDataFrame(PROJECTS, "dir string, project string"))


@query("modal_assembly", "select namespace, defining_assembly from (select namespace, defining_assembly, row_number() over (partition by namespace order by count(*) desc, defining_assembly) as nth from methods group by 1, 2) x where nth = 1")
def _(f):
    return reports.modal(f.methods, "namespace", "defining_assembly")


# Closures


@query("reach_forward_depth", "select sym, cast(min(depth) as bigint) as depth from w group by sym", EDGES, closure_sql("w", SEEDS))
def _(f):
    return reach.reach_from(pairs_of(f), seeds(f).select("sym"), None, ready=True)


@query("reach_reverse_depth", "select sym, cast(min(depth) as bigint) as depth from w group by sym", EDGES, ("back", "select dst as src, src as dst from edges"), closure_sql("w", SEEDS, "back"))
def _(f):
    return reach.reach_from(reach.reversed_edges(pairs_of(f)), seeds(f).select("sym"), None, ready=True)


@query("multi_seed_reach", "select seed, sym, cast(depth as bigint) as depth from w", EDGES, closure_sql("w", SEEDS))
def _(f):
    return reach.reach(pairs_of(f), seeds(f), None, ready=True)


@query("entry_roots", "select distinct sym from w where not exists (select 1 from edges e where e.dst = w.sym)", EDGES, ("back", "select dst as src, src as dst from edges"), closure_sql("w", SEEDS, "back"))
def _(f):
    edges = pairs_of(f)
    return reach.roots(edges, reach.reach_from(reach.reversed_edges(edges), seeds(f).select("sym"), None, ready=True))


@query("seeds_reach_target", "select seed, bool_or(sym in (select symbol_id from methods where part_key % 10 = 9)) as hit from w group by seed", EDGES, closure_sql("w", SEEDS))
def _(f):
    return reach.seeds_reach(pairs_of(f), seeds(f), f.methods.where("part_key % 10 = 9").select(F.col("symbol_id").alias("sym")), None)


@query("reach_set_sync", "select distinct sym from w", EDGES, ("sync", "select src, dst from edges where kind <> 'methodGroup'"), closure_sql("w", SEEDS, "sync"))
def _(f):
    marked = edges_of(f).select("src", "dst", F.when(F.col("kind") == "methodGroup", "handoff").otherwise(F.col("kind")).alias("kind"))
    return reach.reach_from(graph.cut_handoffs(marked, "SyncCut"), seeds(f).select("sym"), None).select("sym").distinct()


@query("reach_with_tags")
def _(f):
    tagged = edges_of(f).select("src", "dst", F.col("loop_kind").isNotNull().alias("in_loop"), F.when(F.col("kind") == "methodGroup", F.col("delegate_consumer")).alias("tag"), "line")
    return reach.carried(tagged, seeds(f).select("sym"), None)


@query("shortest_path_length", "select cast(min(depth) as bigint) as length from w where sym in (select max(sym) from w)", EDGES, closure_sql("w", "select symbol_id as seed, symbol_id as sym, 0 as depth from methods where part_key = 1"))
def _(f):
    spark = f.refs.sparkSession
    edges = pairs_of(f)
    start = f.methods.where("part_key = 1").first()["symbol_id"]
    known = reach.reach_from(edges, spark.createDataFrame([(start,)], "sym string"), None)
    goal = known.agg(F.max("sym")).first()[0]
    return spark.createDataFrame([(max(0, len(reach.shortest_path(edges, start, goal, None)) - 1),)], "length long")


@query("call_tree")
def _(f):
    root = f.methods.where("part_key = 1").first()["symbol_id"]
    return reach.tree_rows(edges_of(f), root)


@query("type_closure", "select type_id, ancestor, cast(depth as bigint) as depth from closure", CLOSURE)
def _(f):
    return ancestors_of(f)


@query("type_closure_strict", "select type_id, ancestor, cast(depth as bigint) as depth from closure where depth > 0", CLOSURE)
def _(f):
    return ancestors_of(f).where("depth > 0")


@query("project_closure", "select sym, cast(min(depth) as bigint) as depth from w group by sym", ("uses", "select distinct m.defining_assembly as src, r.target_assembly as dst from refs r join methods m on m.symbol_id = r.enclosing where m.defining_assembly < r.target_assembly"), closure_sql("w", "select 'Asm0' as seed, 'Asm0' as sym, 0 as depth", "uses"))
def _(f):
    used = reports.usage_edges(f.refs, f.methods).where("from_assembly < to_assembly").select(F.col("from_assembly").alias("src"), F.col("to_assembly").alias("dst"))
    return reach.reach_from(used, f.refs.sparkSession.createDataFrame([("Asm0",)], "sym string"), None)


# Shaping


@query("redirect_edges", "select distinct enclosing as src, case when starts_with(target, 'M:App.N1.T1.') then concat('M:App.N2.T2.', regexp_extract(target, '([^.(]+)[(]', 1)) else target end as dst, cast(line as bigint) as line from refs where enclosing is not null")
def _(f):
    rules = f.refs.sparkSession.createDataFrame([(r["from"], r["to"]) for r in rulebook.DEFAULT["redirects"]], "from_type string, to_type string")
    return graph.redirected(f.refs, rules)


@query("handoff_classify", "select src, dst, case when kind = 'methodGroup' and delegate_consumer is not null then 'handoff' else kind end as kind, case when kind = 'methodGroup' and delegate_consumer = 'M:Lib.Task.Run' then 'task_run' when kind = 'methodGroup' and delegate_consumer = 'M:Lib.Bus.Subscribe' then 'event_raise' end as tag, cast(line as bigint) as line from edges", EDGES)
def _(f):
    return graph.handoffs(edges_of(f), rulebook.handoff_rules(f.refs.sparkSession).select("consumer", "tag"))


@query("event_handoffs", "select e.src, e.dst, case when e.kind = 'methodGroup' and s.src is not null then 'handoff' else e.kind end as kind, cast(e.line as bigint) as line from edges e left join (select distinct enclosing as src, file_path, line from refs where ref_kind = 'read') s on s.src = e.src and s.file_path = e.file_path and s.line = e.line", EDGES)
def _(f):
    reads = f.refs.where("ref_kind = 'read' and enclosing is not null").select(F.col("enclosing").alias("src"), "file_path", "line")
    return graph.event_marks(edges_of(f), reads)


@query("delivery_edges", """
with p as (select distinct enclosing as src, receiver_type as token from refs where ref_kind = 'write' and enclosing is not null),
h as (select distinct receiver_type as token, target as dst from refs where ref_kind = 'throw')
select p.src, h.dst, p.token, case when c.n = 1 then 'exact' else 'fanout' end as precision from p join h on h.token = p.token join (select token, count(*) as n from h group by token) c on c.token = p.token""")
def _(f):
    producers = f.refs.where("ref_kind = 'write' and enclosing is not null").select(F.col("enclosing").alias("src"), F.col("receiver_type").alias("token"))
    return graph.deliveries(producers, f.refs.where("ref_kind = 'throw'").select(F.col("receiver_type").alias("token"), F.col("target").alias("dst")))


@query("delegate_field_edges", """
select distinct i.enclosing as src, b.enclosing as dst from field_access i join field_access b on b.cell = i.cell and b.access = 'write' and not b.lock_held
where i.access = 'read' and i.cell not in (select cell from field_access where thread_static)""")
def _(f):
    a = f.field_access
    return graph.delegate_fields(a.where("access = 'write' and not lock_held").select(F.col("cell").alias("slot"), F.col("enclosing").alias("dst")), a.where("access = 'read'").select(F.col("cell").alias("slot"), F.col("enclosing").alias("src")), a.where("thread_static").select(F.col("cell").alias("slot")))


@query("traversal_cut", "select distinct src, dst from edges where not starts_with(src, 'M:App.N3.T3')", EDGES)
def _(f):
    return graph.cut(edges_of(f), rulebook.DEFAULT["cuts"]).select("src", "dst").distinct()


@query("external_leaves", """
select distinct enclosing as src, target as dst from refs where enclosing is not null and not target_in_source and ref_kind in ('invocation', 'methodGroup', 'ctor')
and (starts_with(target, 'M:App.N1.T1.') or not starts_with(target, 'M:App.N1.'))""")
def _(f):
    return graph.external_leaves(f.refs, f.refs.sparkSession.createDataFrame([("App.N1.T1",)], "declaring string"), ["App.N1"])


@query("factory_rewrite", "select distinct e.src, coalesce(c.ctor, e.dst) as dst from edges e left join (select concat('T:Lib.S', part_key) as type_id, symbol_id as ctor from methods where part_key < 8) c on c.type_id = e.receiver_type", EDGES)
def _(f):
    made = f.methods.where("part_key < 8").select(F.concat(F.lit("T:Lib.S"), "part_key").alias("type_id"), F.col("symbol_id").alias("ctor"))
    return graph.factories(edges_of(f).select("src", "dst", F.col("receiver_type").alias("type_argument")), made)


@query("instantiations", "select distinct i.target as method, i.receiver_type as binding from refs i join (select target from (select distinct target, receiver_type from refs) x group by target having count(*) <= 50) f on f.target = i.target")
def _(f):
    return graph.instantiations(f.refs.select(F.col("target").alias("method"), F.regexp_replace("receiver_type", "^T:", "").alias("binding")), 50).select("method", F.concat(F.lit("T:"), "binding").alias("binding"))


@query("monomorphized_edges", """
select e.src, coalesce(i.method || '~mono⟨;' || i.k || '⟩', e.dst) as dst, e.kind, cast(e.line as bigint) as line, e.receiver_type from bound e left join inst i on i.method = e.dst and e.token = concat('C:', i.k)
union all select concat(e.src, '~mono⟨;', o.k, '⟩'), coalesce(n.method || '~mono⟨;' || n.k || '⟩', e.dst), e.kind, cast(e.line as bigint), case when e.receiver_type = 'T:Lib.S1' then concat('T:', o.k) else e.receiver_type end
from bound e join inst o on o.method = e.src left join inst n on n.method = e.dst and n.k = case when e.token = 'M:0' then o.k when e.token like 'C:%' then substr(e.token, 3) end
""", ("bound", "select enclosing as src, target as dst, ref_kind as kind, line, receiver_type, case when type_arguments is null then null when line % 3 = 0 then 'M:0' else concat('C:', regexp_extract(type_arguments, 'K[0-9]+')) end as token from refs where enclosing is not null and ref_kind in ('invocation', 'ctor', 'methodGroup')"),
    ("inst", "select distinct dst as method, substr(token, 3) as k from bound where token like 'C:%' and dst in (select dst from bound where token like 'C:%' group by dst having count(distinct token) <= 50)"))
def _(f):
    token = F.when(F.col("line") % 3 == 0, F.lit("M:0")).otherwise(F.concat(F.lit("C:"), F.regexp_extract("type_arguments", "K[0-9]+", 0)))
    edges = f.refs.where(F.col("enclosing").isNotNull() & F.col("ref_kind").isin(*graph.CALLS)).select(
        F.col("enclosing").alias("src"), F.col("target").alias("dst"), F.col("ref_kind").alias("kind"), "line", "receiver_type",
        F.expr("cast(array() as array<string>)").alias("declaring"), F.when(F.col("type_arguments").isNotNull(), F.array(token)).alias("own"),
    )
    sites = edges.where(F.startswith(F.col("own")[0], F.lit("C:"))).select(F.col("dst").alias("method"), F.substring(F.col("own")[0], 3, 1 << 30).alias("binding"))
    made = graph.instantiations(sites).select("method", F.expr("cast(array() as array<string>)").alias("declaring"), F.array("binding").alias("own"), F.create_map(F.lit("Lib.S1"), "binding").alias("types"))
    return generics.materialised(edges, made)


# Dispatch


@query("dispatch_edges_mined", "select src, dst, kind from mined", MINED)
def _(f):
    return mined_of(f)


CHA = """select distinct a.symbol_id as src, b.symbol_id as dst from methods b join closure c on c.type_id = b.containing_symbol_id and c.depth > 0
join methods a on a.containing_symbol_id = c.ancestor and a.name = b.name where b.is_override and a.symbol_id not in (select src from mined)"""


@query("dispatch_edges_cha", CHA, CLOSURE, MINED)
def _(f):
    return graph.cha_dispatch(f.methods, ancestors_of(f), mined_of(f))


@query("dispatch_narrowed", "select hub, receiver, dst from narrowed", EDGES, CLOSURE, MINED, CALLS, TARGETS, NARROWED)
def _(f):
    called, narrowed = narrowed_of(f)
    return graph.paired(called, narrowed, ["grp", "receiver"]).select("hub", "receiver", "dst")


@query("dispatch_fans", "select * from fans", EDGES, CLOSURE, MINED, CALLS, TARGETS, NARROWED, FANS)
def _(f):
    return fans_of(f)


@query("reach_one_hop", """
select sym, dispatched, cast(depth as bigint) as depth from (
  with recursive w(sym, dispatched, depth) using key (sym, dispatched) as (
    select symbol_id, false, 0 from methods where part_key <= 6
    union (select s.dst, s.d, min(w.depth) + 1 from w join (select distinct src, dst, false as d from edges union select distinct src, dst, true from mined) s on s.src = w.sym and not (s.d and w.dispatched)
      left join recurring.w k on k.sym = s.dst and k.dispatched = s.d where k.sym is null group by s.dst, s.d))
  select * from w) x""", EDGES, MINED)
def _(f):
    return reach.one_hop(pairs_of(f), mined_of(f), seeds(f), None)


@query("reach_all_hops", "select sym, cast(min(depth) as bigint) as depth from w group by sym", EDGES, MINED, ("hops", "select src, dst from edges union select src, dst from mined"), closure_sql("w", SEEDS, "hops"))
def _(f):
    hops = pairs_of(f).union(mined_of(f).select("src", "dst"))
    return reach.reach_from(hops, seeds(f).select("sym"), None)


@query("folded_edges", "select src, dst, kind, receiver_type, count(*) as sites, cast(min(line) as bigint) as line from edges group by 1, 2, 3, 4", EDGES)
def _(f):
    return reports.folded(edges_of(f))


@query("edge_bindings", "select e.src, e.dst, cast(e.line as bigint) as line, b.type_arguments from (select distinct src, dst, line from edges) e left join (select enclosing, target, line, min(type_arguments) as type_arguments from refs group by 1, 2, 3) b on b.enclosing = e.src and b.target = e.dst and b.line = e.line", EDGES)
def _(f):
    return reports.rebound(edges_of(f), f.refs.where("enclosing is not null").select(F.col("enclosing").alias("src"), F.col("target").alias("dst"), "line", "type_arguments"))


# Effects and observations


@query("effects_invocation", "select provider, operation, resource, enclosing, file_path, cast(line as bigint) as line from effects", EFFECT_RULES, EFFECTS)
def _(f):
    return effects_of(f).select("provider", "operation", "resource", "enclosing", "file_path", "line")


@query("effects_wrapper", "select distinct 'db' as provider, 'wrapped' as operation, regexp_extract(r.target, '([^.(]+)[(]', 1) as resource, r.enclosing, r.file_path, cast(r.line as bigint) as line from refs r where r.ref_kind = 'invocation' and r.enclosing is not null and not r.in_expression_tree and r.target in (select enclosing from refs where ref_kind = 'invocation' and not in_expression_tree and target_name in ('Do1', 'Do2'))")
def _(f):
    return fx.by_wrapper(f.refs, ["Do1", "Do2"], "db", "wrapped")


def _kind_sql(kind, provider):
    return f"select distinct '{provider}' as provider, '{kind}' as operation, regexp_extract(target, '^M:(.*)[.][^.]+[(]', 1) as resource, enclosing, file_path, cast(line as bigint) as line from refs where ref_kind = '{kind}' and enclosing is not null"


@query("effects_ctor", _kind_sql("ctor", "alloc"))
def _(f):
    return fx.by_kind(f.refs, "ctor", "alloc")


@query("effects_throw", _kind_sql("throw", "throw"))
def _(f):
    return fx.by_kind(f.refs, "throw", "throw")


@query("effects_alloc", """
select 'alloc' as provider, operation, resource, enclosing, file_path, cast(line as bigint) as line, cardinality, shallow_size, case when cardinality <> 'cached_first_use' then loop_kind end as loop_kind,
  case when cardinality <> 'cached_first_use' then loop_detail end as loop_detail from allocations""")
def _(f):
    return fx.by_allocation(f.allocations)


@query("effects_field", "select distinct 'state' as provider, access as operation, cell as resource, enclosing, file_path, cast(line as bigint) as line from field_access where contains(concat(' ', modifiers, ' '), ' static ') and cell in (select cell from field_access where access = 'write')")
def _(f):
    return fx.by_field(f.field_access)


@query("effect_summary", "select provider, operation, count(*) as n from effects group by 1, 2", EFFECT_RULES, EFFECTS)
def _(f):
    return fx.summary(effects_of(f))


@query("effects_selected", "select provider, operation, resource, enclosing from effects where provider = 'db' or (provider = 'http' and operation = 'call')", EFFECT_RULES, EFFECTS)
def _(f):
    return fx.selected(effects_of(f), only=["DB", "http:call"])[0].select("provider", "operation", "resource", "enclosing")


@query("effects_hidden", "select count(*) as hidden from (select distinct regexp_extract(target, '^M:(.*)[.][^.]+[(]', 1) as resource, enclosing, file_path, line from refs where ref_kind = 'throw' and enclosing is not null) x")
def _(f):
    return fx.selected(fx.by_kind(f.refs, "throw", "throw"))[1]


OBSERVED = ("observed", """
select provider, operation, resource, enclosing, file_path, line, unnest.type as type, unnest.context as context, unnest.detail as detail from (
  select provider, operation, resource, enclosing, file_path, line, unnest(list_filter([
    case when it_kind is not null then {'type': 'looped_effect', 'context': it_kind, 'detail': it_detail} end,
    case when starts_with(outer_calls, 'Lib.Parallel') then {'type': 'parallel_fanout', 'context': 'Parallel.ForEach', 'detail': 'Parallel.ForEach'} when lam then {'type': 'parallel_fanout', 'context': 'Parallel.Invoke', 'detail': 'Parallel.Invoke'} end,
    case when starts_with(outer_calls, 'Lib.Policy') then {'type': 'resilience_retry', 'context': 'Policy', 'detail': 'Lib.Policy'} end,
    case when target_name in ('Do3', 'Do4', 'Do18') and catch_type is not null then {'type': 'concurrency_handled', 'context': 'Concurrency', 'detail': catch_type} end,
    case when starts_with(scopes, 'transaction') and provider not in ('db', 'ef') then {'type': 'transaction_spans_effect', 'context': 'transaction', 'detail': 'System.TransactionScope'} end,
    case when scopes is not null and provider <> 'async_block' then {'type': 'lock_held_across_effect', 'context': 'lock', 'detail': case when starts_with(scopes, 'lock') then 'lock' else 'Gate' end} end,
    case when provider in ('queue', 'audit') and contains(type_arguments, 'K3') then {'type': 'unserializable_payload', 'context': 'K3', 'detail': type_arguments} end,
    case when not ((provider in ('db', 'ef') and operation = 'read') or provider = 'http') then null when loop = 'query' and contains(first_template, '/p/') then {'type': 'n_plus_1', 'context': 'p', 'detail': it_detail}
      when loop in ('foreach', 'query') and contains(concat('.', argument, '.'), concat('.', loop_variable, '.')) then {'type': 'n_plus_1', 'context': loop_variable, 'detail': it_detail} end], lambda o: o is not null)) as unnest from looped) x""")
OBSERVING = (EFFECT_RULES, EFFECTS, LOOPED, OBSERVED)
SEEN_SQL = "select provider, operation, resource, enclosing, file_path, cast(line as bigint) as line, type, context, detail from observed where type in "
for _types, _name in (
    ("looped_effect", "obs_looped"), ("parallel_fanout", "obs_parallel_fanout"), ("resilience_retry", "obs_retry"), ("concurrency_handled", "obs_concurrency"),
    ("unserializable_payload", "obs_unserializable"), ("n_plus_1", "obs_n_plus_1"), ("lock_held_across_effect transaction_spans_effect", "obs_resource_span"),
):
    query(_name, SEEN_SQL + "(" + ", ".join(f"'{t}'" for t in _types.split()) + ")", *OBSERVING)(lambda f, t=_types.split(): observed_of(f).where(F.col("type").isin(*t)))


@query("iteration_fanout", "select caller, file_path, cast(line as bigint) as line, enclosing, kind, source from fanout", FANOUT)
def _(f):
    return fx.iteration_fanout(f.refs)


def loops_of(f: source.Facts) -> DataFrame:
    rows = fx.iterated(fx.executed(f.refs)).where("iteration is not null")
    return reports.loop_depths(rows.select("enclosing", F.col("iteration.kind").alias("kind"), F.col("iteration.detail").alias("detail"), "line"))


LOOPS = ("loops", f"""
select a.enclosing, a.detail, count(b.detail) + 1 as depth from SPANS a left join SPANS b on b.enclosing = a.enclosing and b.detail <> a.detail and a.lo > b.lo and a.hi <= b.hi group by a.enclosing, a.detail""".replace(
    "SPANS", f"(select enclosing, it_detail as detail, min(line) as lo, max(line) as hi from ({iterated_sql('refs')}) i where ref_kind = 'invocation' and enclosing is not null and not in_expression_tree and it_kind is not null group by 1, 2)"))


@query("intra_loop_depth", "select enclosing, detail, depth from loops", LOOPS)
def _(f):
    return loops_of(f)


@query("amplify_buckets", """
select bucket, cast(degree as bigint) as degree, provider, operation, file_path, cast(line as bigint) as line, cast(rank as bigint) as rank from (
  select *, row_number() over (partition by bucket order by case when degree < 0 then 0 else 1 end, degree desc, weight desc, provider, operation, file_path, line) as rank from (
    select *, case when provider in ('db', 'ef', 'http') then 2 when provider = 'async_block' then 1 else 0 end as weight, case when degree < 0 then 'recursion' when provider = 'async_block' then 'separate' else 'main' end as bucket from (
      select distinct case when e.line % 17 = 0 then -1 else l.depth end as degree, e.provider, e.operation, e.file_path, e.line from looped e join loops l on l.enclosing = e.enclosing and l.detail = e.it_detail where e.provider <> 'gate') x) y) z where rank <= 20""", EFFECT_RULES, EFFECTS, LOOPED, LOOPS)
def _(f):
    rows = fx.iterated(effects_of(f)).where("iteration is not null").withColumn("detail", F.col("iteration.detail")).join(loops_of(f), ["enclosing", "detail"])
    found = rows.select(F.when(F.col("line") % 17 == 0, -1).otherwise(F.col("depth")).cast("long").alias("degree"), "provider", "operation", "file_path", "line").distinct()
    return reports.buckets(found, rulebook.DEFAULT["amplification"]["categories"], 1, 20).select("bucket", "degree", "provider", "operation", "file_path", "line", "rank")


# Entry points, hazards


ENTRIES = ("entries", """
select * from (select *, row_number() over (partition by file_path, line order by rule, route, symbol_id) as nth from (
  select 1 as rule, 'page' as kind, 'PAGE' as method, replace(substr(containing_symbol_id, 7), '.', '/') as route, 'web' as requires, 'site' as services, file_path, line, symbol_id from (
    select *, row_number() over (partition by containing_symbol_id order by file_path, line, symbol_id) as k, bool_and(contains(modifiers, 'abstract')) over (partition by containing_symbol_id) as off from methods
    where containing_symbol_id in (select type_id from closure where ancestor = 'T:App.N2.T2')) m where k = 1 and not off
  union all
  select 2, 'action', 'POST', concat(replace(regexp_extract(enclosing, '^M:App[.](.*)[.][^.]+[(]', 1), '.', '/'), '.', regexp_extract(enclosing, '([^.(]+)[(]', 1)), 'web,api', 'site,gateway', file_path, line, enclosing from refs
  where ref_kind = 'ctor' and (starts_with(target, 'M:App.N0') or starts_with(target, 'M:App.N3')) and concat('T:', regexp_extract(enclosing, '^M:(.*)[.][^.]+[(]', 1)) in (select type_id from closure where ancestor = 'T:App.N2.T2')
  union all
  select 3, 'handler', 'HANDLE', concat(substr(containing_symbol_id, 3), '.', name), '', 'site,gateway,worker', file_path, line, symbol_id from methods
  where containing_symbol_id in (select type_id from closure where ancestor = 'T:App.I3' and depth > 0) and name in ('Do2', 'Do9', 'Do33')
  union all
  select 4, 'job', 'RUN', concat(substr(containing_symbol_id, 3), '.', name), 'queue', 'worker', file_path, line, symbol_id from methods where containing_symbol_id in (select type_id from closure where ancestor = 'T:App.N1.T1' and depth > 0) and is_override
  union all
  select 5, 'rpc', 'RPC', concat(substr(containing_symbol_id, 3), '.', name), 'API', 'gateway', file_path, line, symbol_id from methods where symbol_id in (select enclosing from refs where ref_kind = 'ctor' and starts_with(target, 'M:App.N4.T4.'))) x) y where nth = 1""")


def entries_of(f: source.Facts) -> DataFrame:
    attributes = f.refs.where("ref_kind = 'ctor' and enclosing is not null").select("enclosing", "target", "file_path", "line")
    return hazards.activated(hazards.entry_points(f.methods, attributes, ancestors_of(f), rulebook.DEFAULT["entryPoints"]), rulebook.DEFAULT["deployments"])


ENTRY_SEEDS = "select distinct symbol_id as seed, symbol_id as sym, 0 as depth from entries"


def entry_seeds(f: source.Facts) -> DataFrame:
    return entries_of(f).select(F.col("symbol_id").alias("sym")).distinct()


for _name, _kinds in (("entry_points_page", ["page"]), ("entry_points_action", ["action"]), ("entry_points_class", ["handler", "job", "rpc"])):
    query(_name, "select kind, method, route, concat(kind, ' ', method, ' ', route) as display, file_path, cast(line as bigint) as line, symbol_id from entries where kind in (" + ", ".join(f"'{k}'" for k in _kinds) + ")", CLOSURE, ENTRIES)(
        lambda f, k=_kinds: entries_of(f).where(F.col("kind").isin(*k)).select("kind", "method", "route", "display", "file_path", "line", "symbol_id"))


@query("entry_point_services", "select kind, route, file_path, cast(line as bigint) as line, requires, services from entries", CLOSURE, ENTRIES)
def _(f):
    return entries_of(f).select("kind", "route", "file_path", "line", F.array_join("requires", ",").alias("requires"), F.array_join("services", ",").alias("services"))


@query("entry_points_handoff", "select distinct dst as method from edges where kind = 'methodGroup' and delegate_consumer is not null", EDGES)
def _(f):
    return graph.handoffs(edges_of(f), rulebook.handoff_rules(f.refs.sparkSession).select("consumer", "tag")).where("kind = 'handoff'").select(F.col("dst").alias("method")).distinct()


RACES = (("static_access", "select * from field_access where contains(concat(' ', modifiers, ' '), ' static ')"), ("races", """
select enclosing, cell, file_path, write_line, read_file, read_line, case when own then 'thread_local_context' when lazy then 'lazy_init_race' else 'race_window' end as type,
  case when own or lazy then 'low' when held and read_held then 'medium' else 'high' end as confidence,
  case when own then 'thread_static_context' when lazy and locked then 'lazy_init_in_lock' when lazy then 'lazy_init_shape' when held and read_held then 'in_transaction' else 'no_isolation' end as reason from (
  select w.*, r.line as read_line, r.file_path as read_file, r.transaction_held as read_held, l.line as last_locked,
    contains(lower(regexp_extract(w.enclosing, '([^.(]+)[(]', 1)), 'init') or (ends_with(w.cell, '._instance') and count(*) over (partition by w.enclosing, w.cell) = 1) as lazy from (
      select enclosing, cell, file_path, line as write_line, bool_or(lock_held) as locked, bool_or(transaction_held) as held, bool_or(thread_static) as own, bool_or(contains(modifiers, 'volatile')) as free from static_access where access = 'write' group by 1, 2, 3, 4) w
    join (select *, row_number() over (partition by enclosing, cell order by line, file_path, transaction_held) as nth from static_access where access = 'read') r on r.enclosing = w.enclosing and r.cell = w.cell and r.nth = 1
    left join (select enclosing, max(line) as line from static_access where lock_held group by 1) l on l.enclosing = w.enclosing) x
where read_line < write_line and not coalesce(not own and lazy and locked and free and write_line >= last_locked, false)"""))
for _type, _name in (("race_window", "hazard_race_window"), ("lazy_init_race", "hazard_lazy_init"), ("thread_local_context", "hazard_thread_local")):
    query(_name, f"select enclosing, cell, file_path, cast(write_line as bigint) as write_line, read_file, cast(read_line as bigint) as read_line, type, confidence, reason from races where type = '{_type}'", *RACES)(lambda f, t=_type: hazards.race_windows(f.field_access).where(F.col("type") == t))


def dual_of(f: source.Facts) -> DataFrame:
    return hazards.dual_writes(f.effect_events, rulebook.DEFAULT["dualWrite"])


DUAL = (("system_writes", "select * from (select *, case when provider = 'purchase' and operation = 'write' then 'db' when provider = 'click' and operation = 'write' then 'queue' when provider = 'signup' then 'search' end as system from effect_events) x where system is not null"), ("dual", """
select g.enclosing, g.systems, t.sites, l.line, l.provider from (select enclosing, string_agg(system, '+' order by system) as systems from (select distinct enclosing, system from system_writes) x group by enclosing having count(*) >= 2) g
join (select enclosing, string_agg(concat(file_path, ':', line), ',' order by line, file_path) as sites from (select distinct enclosing, file_path, line from system_writes) x group by enclosing) t on t.enclosing = g.enclosing
join (select enclosing, line, provider, row_number() over (partition by enclosing order by line desc, provider desc) as nth from system_writes) l on l.enclosing = g.enclosing and l.nth = 1"""))
WAITS = ("waits", "select e.enclosing, e.operation as context, e.file_path, e.line from effects e where e.provider = 'async_block' and e.enclosing in (select symbol_id from methods where contains(concat(' ', modifiers, ' '), ' async '))")
CAPTURES = ("captures", "select distinct enclosing, resource, file_path, line from initialisers where (contains(resource, 'R1') or contains(resource, 'R4')) and enclosing in (select symbol_id from fields where contains(concat(' ', modifiers, ' '), ' static '))")


def captures_of(f: source.Facts) -> DataFrame:
    return hazards.static_captures(f.initialisers, f.fields, rulebook.DEFAULT["staticInitCapture"])


@query("hazard_dual_write", "select enclosing, systems, sites, cast(line as bigint) as line, provider from dual", *DUAL)
def _(f):
    return dual_of(f)


@query("hazard_sync_over_async", "select enclosing, context, file_path, cast(line as bigint) as line from waits", EFFECT_RULES, EFFECTS, WAITS)
def _(f):
    return hazards.sync_over_async(effects_of(f), f.methods)


@query("hazard_static_init", "select enclosing, resource, file_path, cast(line as bigint) as line from captures", CAPTURES)
def _(f):
    return captures_of(f)


KEYED = ("keyed_events", "select *, regexp_extract(resource, '^App[.](R[0-9]+)', 1) as key from effect_events")


@query("hazard_cache_coherence", """
select distinct a.sym, a.key from (select enclosing as sym, key from keyed_events where operation = 'write') a
where not exists (select 1 from w join (select symbol_id, containing_symbol_id from methods) m on m.symbol_id = w.seed where w.sym = a.sym and w.key = a.key)""", EDGES, KEYED, ("w", """
with c as (select distinct enclosing as seed, key from keyed_events where operation = 'invalidate')
select seed, key, seed as sym from c union select c.seed, c.key, e.src from c join edges e on e.dst = c.seed"""))
def _(f):
    keyed = f.effect_events.withColumn("key", docid.resource_key(F.col("resource"), rulebook.DEFAULT["suffixes"]))
    companions = keyed.where("operation = 'invalidate'").select(F.col("enclosing").alias("sym"), "key")
    return hazards.missing_companions(keyed.where("operation = 'write'").select(F.col("enclosing").alias("sym"), "key"), companions, pairs_of(f), 1)


@query("hazard_event_cycle")
def _(f):
    """Call edges aren't made for this where no query has wanted them: both ends of each are methods, as references are."""
    marked = graph.handoffs(edges_of(f) if f.has("edges") else graph.call_rows(f.refs), rulebook.handoff_rules(f.refs.sparkSession))
    return hazards.event_cycles(marked, {r["tag"]: r["delivery"] for r in rulebook.DEFAULT["handoffs"]}, f.methods.select(F.col("symbol_id").alias("sym")))


@query("amplification_degree")
def _(f):
    """Calls in loops: how deep loops may nest along them."""
    looped = fx.iteration_fanout(f.refs).select(F.col("caller").alias("src"), F.col("enclosing").alias("dst")).distinct()
    depths = loops_of(f).groupBy(F.col("enclosing").alias("sym")).agg(F.max("depth").alias("weight"))
    anchors = looped.select(F.explode(F.array("src", "dst")).alias("sym")).distinct().join(depths, "sym", "left").na.fill(0, ["weight"])
    return reach.longest_chain(anchors, looped)


AMPLIFIED = """
select caller, file_path, cast(line as bigint) as line, provider, operation, cast(depth as bigint) as depth, case when depth <= 1 then 'high' when depth <= 4 then 'medium' else 'low' end as confidence, cast(rank as bigint) as rank from (
  select *, row_number() over (partition by caller, file_path, line order by depth, origin, provider, operation) as rank from (
    select distinct v.caller, v.file_path, v.line, w.provider, w.operation, first_value(w.depth) over o as depth, first_value(w.origin) over o as origin
    from fanout v join w on w.sym = v.enclosing window o as (partition by v.caller, v.file_path, v.line, w.provider, w.operation order by w.depth, w.origin)) x) y where rank <= 3"""


@query("cross_method_amplification", AMPLIFIED, EDGES, FANOUT, ("w", """
with recursive w(provider, operation, sym, depth, origin) using key (provider, operation, sym) as (
  select distinct provider, operation, enclosing, 0, enclosing from effect_events union (
  select w.provider, w.operation, e.src, min(w.depth) + 1, min(w.origin) from w join (select distinct src, dst from edges) e on e.dst = w.sym left join recurring.w k on k.provider = w.provider and k.operation = w.operation and k.sym = e.src
  where k.sym is null and w.depth < 6 group by w.provider, w.operation, e.src)) select * from w"""))
def _(f):
    events = fx.iteration_fanout(f.refs).select("caller", "file_path", "line", "enclosing").distinct()
    return hazards.amplified(events, f.effect_events, pairs_of(f), 6)


# Reports, differences, incremental refresh


@query("hotspots", """
select m.symbol_id, cast(case when m.end_line >= m.line and m.line > 0 then m.end_line - m.line + 1 else 1 end as bigint) as lines, coalesce(i.callers, 0) as callers, coalesce(i.incoming, 0) as incoming, coalesce(o.callees, 0) as callees, coalesce(o.outgoing, 0) as outgoing,
  coalesce(e.effect_sites, 0) as effect_sites, coalesce(e.effect_kinds, 0) as effect_kinds, coalesce(h.hazard_sites, 0) as hazard_sites, coalesce(h.hazard_kinds, 0) as hazard_kinds, coalesce(a.amplifying_sites, 0) as amplifying_sites,
  coalesce(d.fan, 0) as fan, coalesce(d.incoming_unnarrowed, 0) as incoming_unnarrowed, coalesce(d.rank, 0) as rank, round(coalesce(e.effect_sites, 0) * 100.0 / (case when m.end_line >= m.line and m.line > 0 then m.end_line - m.line + 1 else 1 end), 6)::double as density
from methods m
left join (select dst, count(distinct src) as callers, count(distinct concat(src, '|', file_path, '|', line)) as incoming from edges group by 1) i on i.dst = m.symbol_id
left join (select src, count(distinct dst) as callees, count(distinct concat(dst, '|', file_path, '|', line)) as outgoing from edges group by 1) o on o.src = m.symbol_id
left join (select enclosing, count(distinct concat(provider, '|', operation, '|', resource, '|', file_path, '|', line)) as effect_sites, count(distinct concat(provider, '|', operation)) as effect_kinds from effects group by 1) e on e.enclosing = m.symbol_id
left join (select enclosing, count(distinct concat(type, '|', file_path, '|', write_line)) as hazard_sites, count(distinct type) as hazard_kinds from races group by 1) h on h.enclosing = m.symbol_id
left join (select enclosing, count(distinct concat(provider, '|', operation, '|', resource, '|', file_path, '|', line)) as amplifying_sites from observed
  where type in ('looped_effect', 'n_plus_1') and (provider in ('db', 'ef') or (provider = 'http' and operation = 'call')) group by 1) a on a.enclosing = m.symbol_id
left join fans d on d.hub = m.symbol_id""", EDGES, CLOSURE, MINED, CALLS, TARGETS, NARROWED, FANS, *OBSERVING, *RACES)
def _(f):
    effects = effects_of(f)
    amplifying = reports.in_scope(observed_of(f).where(F.col("type").isin("looped_effect", "n_plus_1")), rulebook.DEFAULT["amplification"]["scope"])
    risks = hazards.race_windows(f.field_access).select("enclosing", "type", "file_path", F.col("write_line").alias("line"))
    return reports.hotspots(edges_of(f), f.methods, effects, risks, amplifying, fans_of(f))


@query("dead_code", """
select m.symbol_id, case when contains(concat(' ', modifiers, ' '), ' private ') then 'high' when contains(concat(' ', modifiers, ' '), ' public ') then 'low' else 'medium' end as tier,
  case when c.n is null then 'uncalled' else 'only reached by dead code' end as reason, coalesce(c.n, 0) as callers
from methods m left join (select dst, count(*) as n from edges group by 1) c on c.dst = m.symbol_id
where not contains(modifiers, 'abstract') and not contains(modifiers, 'virtual') and not is_override and not regexp_matches(file_path, '[.]g[.]cs$') and symbol_id not in (select sym from w)""", EDGES, CLOSURE, ENTRIES, closure_sql("w", ENTRY_SEEDS))
def _(f):
    return hazards.dead_code(f.methods, reach.reach_from(pairs_of(f), entry_seeds(f), None, ready=True), edges_of(f))


@query("file_effects", "select m.file_path, m.symbol_id, cast(min(w.depth) as bigint) as depth from w join methods m on m.symbol_id = w.sym group by 1, 2", EDGES, ("back", "select dst as src, src as dst from edges"), EFFECT_RULES, EFFECTS, closure_sql("w", "select distinct enclosing as seed, enclosing as sym, 0 as depth from effects where provider = 'queue'", "back"))
def _(f):
    sources = effects_by(f, "queue").select(F.col("enclosing").alias("sym")).distinct()
    known = reach.reach_from(reach.reversed_edges(pairs_of(f)), sources, None, ready=True)
    return f.methods.join(known, F.col("symbol_id") == F.col("sym")).select("file_path", "symbol_id", "depth")


PAIRS = "select 'one' as label, (select max(symbol_id) from methods where part_key = 11) as a, (select max(symbol_id) from methods where part_key = 12) as b union all select 'two', (select max(symbol_id) from methods where part_key = 13), (select max(symbol_id) from methods where part_key = 14)"


@query("effects_diff", """
with found as (select distinct w.seed, e.key, concat(e.provider, ':', e.operation) as category from w join keyed_events e on e.enclosing = w.sym),
x as (select p.label, f.key, p.side, f.category from (select label, 'a' as side, a as seed from pairs union all select label, 'b', b from pairs) p join found f on f.seed = p.seed)
select label, key as resource_key, concat(min(side), '_only') as side, string_agg(distinct category, ',' order by category) as categories from x group by label, key having count(distinct side) = 1""",
       EDGES, KEYED, ("pairs", PAIRS), closure_sql("w", "select a as seed, a as sym, 0 as depth from pairs union select b, b, 0 from pairs", depth=1))
def _(f):
    one = {r["part_key"]: r["symbol_id"] for r in f.methods.where("part_key between 11 and 14").select("part_key", "symbol_id").collect()}
    spark = f.refs.sparkSession
    pairs = spark.createDataFrame([("one", one[11], one[12]), ("two", one[13], one[14])], "label string, a string, b string")
    known = reach.reach(pairs_of(f), spark.createDataFrame([(s, s) for s in one.values()], "seed string, sym string"), 1)
    return reports.effect_difference(pairs, known, f.effect_events, rulebook.DEFAULT["suffixes"])


def _foot(test):
    return f"select enclosing, provider, operation, count(*) as n, bool_or(in_loop) as in_loop from effect_events where {test} group by 1, 2, 3"


@query("impact_footprint", "select * from foot_changes", ("base", _foot("event_id % 2 = 0")), ("head", _foot("event_id % 2 = 1")), ("foot_changes", """
select enclosing, provider, operation, change from (select coalesce(b.enclosing, h.enclosing) as enclosing, coalesce(b.provider, h.provider) as provider, coalesce(b.operation, h.operation) as operation,
  case when b.n is null then 'added' when h.n is null then 'removed' when h.n > b.n or (h.in_loop and not b.in_loop) then 'amplified' end as change
  from base b full outer join head h on h.enclosing = b.enclosing and h.provider = b.provider and h.operation = b.operation) x where change is not null"""))
def _(f):
    return foot_changes_of(f)


@query("impact_entrypoints", "select 'added' as change, route from (select route from h except select route from b) x union all select 'removed', route from (select route from b except select route from h) y", ("b", "select concat('/', symbol_id) as route from methods where part_key % 3 = 0"), ("h", "select concat('/', symbol_id) as route from methods where part_key % 7 = 0"))
def _(f):
    b, h = (f.methods.where(f"part_key % {k} = 0").select(F.concat(F.lit("/"), "symbol_id").alias("route")) for k in (3, 7))
    return h.subtract(b).select(F.lit("added").alias("change"), "route").unionByName(b.subtract(h).select(F.lit("removed").alias("change"), "route"))


@query("impact_reach", """
with x as (select seed, sym, max(b) as b, max(h) as h from (select seed, sym, 1 as b, 0 as h from wb union all select seed, sym, 0, 1 from wh) y group by 1, 2),
m as (select seed, count(*) filter (where h = 1) as added, count(*) filter (where b = 1) as removed from x where b <> h group by 1),
p as (select seed, count(*) as in_place from x join methods on symbol_id = sym where b = 1 and h = 1 and body_hash <> concat('h', part_key * 7 % 999) group by 1)
select coalesce(m.seed, p.seed) as seed, coalesce(added, 0) as added, coalesce(removed, 0) as removed, cast(0 as bigint) as changed, coalesce(in_place, 0) as in_place, coalesce(added, 0) + coalesce(removed, 0) + coalesce(in_place, 0) as delta,
  case when m.seed is null then 'InPlace' else 'Other' end as cause from m full outer join p on p.seed = m.seed""",
       EDGES, ("eb", "select src, dst from edges where line <= 40"), ("eh", "select src, dst from edges where line >= 20"), closure_sql("wb", SEEDS, "eb"), closure_sql("wh", SEEDS, "eh"))
def _(f):
    edges = edges_of(f)
    changed = reports.changed_bodies(f.methods, other_bodies(f))
    return reports.reach_changes(*(reach.reach(settled(edges.where(test).select("src", "dst")), seeds(f), None, ready=True) for test in ("line <= 40", "line >= 20")), changed)


def other_bodies(f: source.Facts) -> DataFrame:
    return f.methods.withColumn("body_hash", F.concat(F.lit("h"), F.col("part_key") * 7 % 999))


GUARD_CHANGES = ("guard_changes", """
select src, dst, change from (select src, dst, case when ((h_y and not b_y) or h_z) and b_y and not h_y then 'Changed' when (h_y and not b_y) or h_z then 'Narrowed' when b_y and not h_y then 'Widened' end as change
from (select src, dst, bool_or(line % 3 = 0) as b_y, bool_or(line % 4 = 0) as h_y, bool_or(line % 5 = 0) as h_z from edges group by 1, 2) x) y where change is not null""")
FOOT_CHANGES = ("foot_changes", """
select enclosing, provider, operation, change from (select coalesce(b.enclosing, h.enclosing) as enclosing, coalesce(b.provider, h.provider) as provider, coalesce(b.operation, h.operation) as operation,
  case when b.n is null then 'added' when h.n is null then 'removed' when h.n > b.n or (h.in_loop and not b.in_loop) then 'amplified' end as change
  from base b full outer join head h on h.enclosing = b.enclosing and h.provider = b.provider and h.operation = b.operation) x where change is not null""")
FOOTPRINTS = (("base", _foot("event_id % 2 = 0")), ("head", _foot("event_id % 2 = 1")), FOOT_CHANGES)


def guards_of(f: source.Facts) -> DataFrame:
    where = "concat('x > ', line % 2, '  /* && */ && (a||b && c)', {})"
    sides = ("case when line % 3 = 0 then '&&y' else '' end", "case when line % 4 = 0 then ' && y // && q' else '' end, chr(10), case when line % 5 = 0 then '&& z' else '' end")
    return reports.guard_changes(*(edges_of(f).selectExpr("src", "dst", where.format(more) + " as guard") for more in sides))


def foot_changes_of(f: source.Facts) -> DataFrame:
    return reports.effect_changes(*(reports.footprint(f.effect_events.where(f"event_id % 2 = {k}")) for k in (0, 1)))


@query("impact_guards", "select * from guard_changes", EDGES, GUARD_CHANGES)
def _(f):
    return guards_of(f)


@query("impact_gates", "select (select count(distinct enclosing) from foot_changes) as effect_changed, (select count(*) from guard_changes where change = 'Narrowed') as narrowed_guards", EDGES, GUARD_CHANGES, *FOOTPRINTS)
def _(f):
    return reports.gates(foot_changes_of(f), guards_of(f))


@query("impact_body_changed", "select symbol_id from methods where body_hash <> concat('h', part_key * 7 % 999)")
def _(f):
    return reports.changed_bodies(f.methods, other_bodies(f))


FOUND = (*OBSERVING, *RACES, *DUAL, WAITS, CAPTURES, ("found", """
select type, 'high' as confidence, enclosing, context, detail, cast(line as bigint) as line, provider from observed
union all select type, confidence, enclosing, cell, concat(read_file, ':', read_line), cast(write_line as bigint), 'state' from races
union all select 'dual_write', 'medium', enclosing, systems, sites, cast(line as bigint), provider from dual
union all select 'sync_over_async', 'high', enclosing, context, regexp_extract(enclosing, '([^.(]+)[(]', 1), cast(line as bigint), 'async_block' from waits
union all select 'static_init_capture', 'medium', enclosing, resource, enclosing, cast(line as bigint), null from captures"""))


def found_of(f: source.Facts) -> DataFrame:
    effects = effects_of(f)
    return reports.findings(observed_of(f), hazards.race_windows(f.field_access), dual_of(f), hazards.sync_over_async(effects, f.methods), captures_of(f))


@query("findings", "select * from found", *FOUND)
def _(f):
    return found_of(f)


@query("finding_groups", "select type, count(*) as n, count(distinct enclosing) as methods from found group by type", *FOUND)
def _(f):
    return hazards.grouped(found_of(f))


@query("findings_outside", "select * from found where not starts_with(enclosing, 'M:App.N1.') and not starts_with(enclosing, 'F:App.S1.')", *FOUND)
def _(f):
    return hazards.excluded(found_of(f), ["App.N1", "App.S1"])


@query("di_listing", "select distinct service, implementation, file_path, cast(line as bigint) as line from registrations")
def _(f):
    return reports.listing(f.registrations)


@query("resource_keys", "select distinct resource, key from keyed_events", KEYED)
def _(f):
    return f.effect_events.select("resource", docid.resource_key(F.col("resource"), rulebook.DEFAULT["suffixes"]).alias("key")).distinct()


@query("stores_selected", "select store_id, cast(run_id as bigint) as run_id from runs where starts_with(store_id, 's1')")
def _(f):
    return reports.chosen(f.runs, "s1").select("store_id", "run_id")


@query("ambiguous_targets", "select distinct regexp_extract(symbol_id, '^M:([^(]*)', 1) as name from methods where contains(lower(symbol_id), 't2.p')")
def _(f):
    return reports.ambiguous(f.methods.select(F.col("symbol_id").alias("sym")), "T2.P")


@query("references_to", "select enclosing, target, ref_kind, file_path, cast(line as bigint) as line from refs where target in (select symbol_id from methods where part_key between 20 and 30)")
def _(f):
    return reports.keyed(f.refs, f.methods.where("part_key between 20 and 30").select(F.col("symbol_id").alias("sym")), "target").select("enclosing", "target", "ref_kind", "file_path", "line")


@query("references_from", "select enclosing, target, ref_kind, file_path, cast(line as bigint) as line from refs where enclosing in (select symbol_id from methods where part_key between 20 and 30)")
def _(f):
    return reports.keyed(f.refs, f.methods.where("part_key between 20 and 30").select(F.col("symbol_id").alias("sym")), "enclosing").select("enclosing", "target", "ref_kind", "file_path", "line")


@query("overlay_snapshot", """
select file_path, symbol_id, cast(line as bigint) as line from methods where file_path not in (select file_path from methods where part_key % 50 = 0)
union all select file_path, symbol_id, cast(line + 1000 as bigint) from methods where part_key % 50 = 0""")
def _(f):
    base = f.methods.select("file_path", "symbol_id", "line")
    edits = f.methods.where("part_key % 50 = 0").select("file_path", "symbol_id", (F.col("line") + 1000).alias("line"))
    return overlay.overlaid(base, edits)


@query("dirty_projects", "select distinct sym from w", ("uses", "select distinct r.target_assembly as src, m.defining_assembly as dst from refs r join methods m on m.symbol_id = r.enclosing where m.defining_assembly < r.target_assembly"), closure_sql("w", "select 'Asm5' as seed, 'Asm5' as sym, 0 as depth", "uses"))
def _(f):
    depends = reports.usage_edges(f.refs, f.methods).where("from_assembly < to_assembly").select(F.col("from_assembly").alias("src"), F.col("to_assembly").alias("dst"))
    return overlay.dirty_projects(f.refs.sparkSession.createDataFrame([("Asm5",)], "sym string"), depends, None)


@query("entry_point_effects", "select e.provider, e.operation, count(*) as n from effects e where e.enclosing in (select sym from w) group by 1, 2", EDGES, CLOSURE, EFFECT_RULES, EFFECTS, ENTRIES, closure_sql("w", ENTRY_SEEDS))
def _(f):
    """What the entry points touch: their closure, and the effects in it."""
    known = reach.reach_from(pairs_of(f), entry_seeds(f), None, ready=True)
    return fx.summary(effects_of(f).join(known.withColumnRenamed("sym", "enclosing"), "enclosing", "left_semi"))


# The rest of the queries, which use the tables above.
from . import inquiries  # noqa: E402,F401
