"""More queries over the adapter's facts: narrowed walks, footprints of entry points, lookups and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generics, graph, reach, reports
from . import registry as r
from .registry import query
from .steps import settled

NARROW_HOPS = ("hops", """
select distinct src, dst from edges union
select c.src, n.dst from calls c join narrowed n on n.hub = c.dst and n.receiver = c.receiver_type union
select c.src, t.dst from calls c join targets t on t.hub = c.dst where not exists (select 1 from narrowed n where n.hub = c.dst and n.receiver = c.receiver_type)""")
NARROWING = (r.EDGES, r.CLOSURE, r.MINED, r.CALLS, r.TARGETS, r.NARROWED, NARROW_HOPS)


def ways_of(f):
    """The narrowed graph: calls, ways into the nodes of dispatch, ways out of them."""
    made = lambda: graph.narrowed_ways(r.calls_of(f), *r.groups_of(f), r.narrowed_of(f)[1])
    return r.pairs_of(f), f.kept("narrowed_into", lambda: made()[0]), f.kept("narrowed_out", lambda: made()[1])


@query("reach_narrowed_forward", "select sym, cast(min(depth) as bigint) as depth from w group by sym", *NARROWING, r.closure_sql("w", r.SEEDS, "hops"))
def _(f):
    edges, into, out = ways_of(f)
    return reach.reach_by(edges, into, out, r.seeds(f).withColumn("seed", F.lit(0))).select("sym", "depth")


@query("reach_narrowed_reverse", "select sym, cast(min(depth) as bigint) as depth from w group by sym", *NARROWING, ("back", "select dst as src, src as dst from hops"), r.closure_sql("w", r.SEEDS, "back"))
def _(f):
    edges, into, out = ways_of(f)
    back = lambda df, a, b: df.select(F.col(a).alias("src" if b == "node" else "node"), F.col(b).alias("node" if b == "node" else "dst"))
    return reach.reach_by(reach.reversed_edges(edges), back(out, "dst", "node"), back(into, "node", "src"), r.seeds(f).withColumn("seed", F.lit(0))).select("sym", "depth")


@query("entry_site_methods", "select e.kind, e.route, e.file_path, cast(e.line as bigint) as line, m.symbol_id from entries e join methods m on m.file_path = e.file_path and m.line = e.line", r.CLOSURE, r.ENTRIES)
def _(f):
    return reports.at_sites(r.entries_of(f).select("kind", "route", "file_path", "line"), f.methods)


LAMBDAS = ("lambdas", "select distinct concat(enclosing, '~λ', line) as symbol_id, file_path, line, line + 1 as end_line from refs where enclosing is not null and starts_with(outer_calls, 'Lib.Seq')")


@query("method_ends", "select symbol_id, file_path, cast(line as bigint) as line, cast(case when end_line >= line then end_line else line end as bigint) as end_line, false as nested from methods union all select symbol_id, file_path, cast(line as bigint), cast(end_line as bigint), true from lambdas", LAMBDAS)
def _(f):
    lambdas = f.refs.where("enclosing is not null and outer_calls like 'Lib.Seq%'").select(F.concat("enclosing", F.lit("~λ"), "line").alias("symbol_id"), "file_path", "line", (F.col("line") + 1).alias("end_line")).distinct()
    return reports.ends(f.methods, lambdas)


@query("generic_signatures", "select m.symbol_id, regexp_extract(m.symbol_id, '[(](.*)[)]', 1) as signature, g.bindings from methods m join (select target, count(distinct type_arguments) as bindings from refs where type_arguments is not null group by 1) g on g.target = m.symbol_id")
def _(f):
    return reports.signatures(f.methods, f.refs)


PATTERNS = ["App.N1", "P3", "App.Nowhere", "T2.P"]


@query("seed_notices", "select p.pattern, case when p.n = 0 then 'no match' when p.leads = 0 then 'no calls out of it' else 'found' end as notice, p.n as matches from (" + " union all ".join(
    f"select '{p}' as pattern, count(*) as n, count(*) filter (where symbol_id in (select src from edges)) as leads from methods where contains(lower(symbol_id), lower('{p}'))" for p in PATTERNS) + ") p", r.EDGES)
def _(f):
    return reports.seed_notices(PATTERNS, f.methods.select(F.col("symbol_id").alias("sym")), r.pairs_of(f))


@query("impact_guards_only", """
select g.src, g.dst, g.change, g.src in (select enclosing from field_access where access = 'write' and contains(concat(' ', modifiers, ' '), ' static ')) as shared_mutation
from guard_changes g where g.src not in (select enclosing from foot_changes)""", r.EDGES, r.GUARD_CHANGES, *r.FOOTPRINTS)
def _(f):
    return reports.guards_only(r.guards_of(f), r.foot_changes_of(f), f.field_access)


@query("allocations_reached", "select operation, resource, enclosing, file_path, cast(line as bigint) as line from allocations where enclosing in (select sym from w)", r.EDGES, r.closure_sql("w", r.SEEDS))
def _(f):
    known = reach.reach_from(r.pairs_of(f), r.seeds(f).select("sym"), None, ready=True).select(F.col("sym").alias("enclosing"))
    return f.allocations.join(known, "enclosing", "left_semi").select("operation", "resource", "enclosing", "file_path", "line")


def _feet(name, edges):
    return name, f"select w.seed, e.provider, e.operation, count(distinct e.enclosing) as n, bool_or(e.in_loop) as in_loop from {edges} w join effect_events e on e.enclosing = w.sym group by 1, 2, 3"


@query("entry_footprint", "select seed, provider, operation, n, in_loop from feet", r.EDGES, r.closure_sql("w", r.SEEDS), _feet("feet", "w"))
def _(f):
    return reports.entry_footprint(reach.reach(r.pairs_of(f), r.seeds(f), None, ready=True), f.effect_events)


@query("impact_entry_footprint", """
select coalesce(b.seed, h.seed) as seed, coalesce(b.provider, h.provider) as provider, coalesce(b.operation, h.operation) as operation,
  case when b.n is null then 'added' when h.n is null then 'removed' else 'amplified' end as change, coalesce(h.n, 0) - coalesce(b.n, 0) as delta
from fb b full outer join fh h on h.seed = b.seed and h.provider = b.provider and h.operation = b.operation
where coalesce(b.seed, h.seed) in (select seed from fb) and coalesce(b.seed, h.seed) in (select seed from fh) and (b.n is null or h.n is null or h.n > b.n or (h.in_loop and not b.in_loop))""",
       r.EDGES, ("eb", "select src, dst from edges where line <= 20"), ("eh", "select src, dst from edges where line >= 10"), r.closure_sql("wb", r.SEEDS, "eb"), r.closure_sql("wh", r.SEEDS, "eh"), _feet("fb", "wb"), _feet("fh", "wh"))
def _(f):
    edges = r.edges_of(f)
    base, head = (reports.entry_footprint(reach.reach(settled(edges.where(test).select("src", "dst")), r.seeds(f), None, ready=True), f.effect_events) for test in ("line <= 20", "line >= 10"))
    return reports.entry_changes(base, head)


@query("source_edges", "select distinct src, dst, kind, cast(line as bigint) as line from bound", ("bound", "select enclosing as src, target as dst, ref_kind as kind, line from refs where enclosing is not null and ref_kind in ('invocation', 'ctor', 'methodGroup')"))
def _(f):
    """The graph with instantiations as nodes, folded back to the source's own members."""
    token = F.when(F.col("line") % 3 == 0, F.lit("M:0")).otherwise(F.concat(F.lit("C:"), F.regexp_extract("type_arguments", "K[0-9]+", 0)))
    edges = f.refs.where(F.col("enclosing").isNotNull() & F.col("ref_kind").isin(*graph.CALLS)).select(
        F.col("enclosing").alias("src"), F.col("target").alias("dst"), F.col("ref_kind").alias("kind"), "line", "receiver_type",
        F.expr("cast(array() as array<string>)").alias("declaring"), F.when(F.col("type_arguments").isNotNull(), F.array(token)).alias("own"),
    )
    sites = edges.where(F.startswith(F.col("own")[0], F.lit("C:"))).select(F.col("dst").alias("method"), F.substring(F.col("own")[0], 3, 1 << 30).alias("binding"))
    made = graph.instantiations(sites).select("method", F.expr("cast(array() as array<string>)").alias("declaring"), F.array("binding").alias("own"), F.create_map(F.lit("Lib.S1"), "binding").alias("types"))
    return graph.source_edges(generics.materialised(edges, made))
