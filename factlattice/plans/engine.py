"""The questions that a user asks of a store, each a composition of operators over its facts and rules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import docid
from ..operators import effects as fx
from ..operators import graph, hazards, reach, reports
from ..sources import rules as rulebook
from ..sources.facts import Facts

#: Columns that hotspots can be ranked by.
AXES = {"callers": "callers", "callees": "callees", "effects": "effect_sites", "density": "density", "hazards": "hazard_sites", "amplification": "amplifying_sites", "dispatch": "rank"}


class Engine:
    """Plans only: nothing is computed before a result is asked for, but for the levels of a traversal."""

    def __init__(self, facts: Facts, rules: dict = rulebook.DEFAULT, mode: str = "SyncCut"):
        wrong = rulebook.problems(rules)
        if wrong:
            raise ValueError("; ".join(wrong))
        self.facts, self.rules, self.mode = facts, rules, mode
        self.spark = facts.methods.sparkSession

    # The shaped graph

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with handoffs marked, those of the mode only, and none out of a cut member."""
        marked = graph.handoffs(graph.call_edges(self.facts.refs), rulebook.handoff_rules(self.spark, self.rules))
        marked = marked.withColumn("precision", F.when(F.col("delivery") == "low", "fanout").otherwise("exact"))
        return graph.cut(graph.cut_handoffs(marked, self.mode), self.rules["cuts"])

    @cached_property
    def ancestors(self) -> DataFrame:
        return self.facts.kept("ancestors", lambda: graph.closure(self.facts.type_relations))

    @cached_property
    def dispatch(self) -> DataFrame:
        return self.facts.kept("targets", lambda: graph.dispatch_targets(self.facts.methods, graph.mined_dispatch(self.facts.dispatch), self.ancestors))

    def graph(self) -> dict[str, DataFrame]:
        """The derived tables of a store."""
        return {"call_edges": graph.call_edges(self.facts.refs), "dispatch_edges": self.dispatch, "nodes": graph.nodes(graph.call_edges(self.facts.refs), self.facts.dispatch, self.facts.methods)}

    @cached_property
    def hops(self) -> DataFrame:
        return self.calls.select("src", "dst").union(self.dispatch.select(F.col("hub").alias("src"), "dst")).distinct()

    @cached_property
    def narrow(self) -> DataFrame:
        """(src, dst) of calls and of what each call may be dispatched to by its receiver."""
        own = graph.call_edges(self.facts.refs).join(self.calls.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        return graph.narrowed_hops(own, self.dispatch, graph.narrowed_calls(own, self.dispatch, self.ancestors))

    def ahead(self, seeds: DataFrame) -> DataFrame:
        """The narrowed graph as seen from start points: what they may be dispatched to themselves has no receiver to narrow it."""
        own = self.dispatch.join(seeds.select(F.col("sym").alias("hub")), "hub", "left_semi").select(F.col("hub").alias("src"), "dst")
        return self.narrow.union(own)

    def seeds(self, pattern: str) -> DataFrame:
        return graph.matched(self.facts.methods.select(F.col("symbol_id").alias("sym")).distinct(), pattern)

    # Traversals

    def reaches(self, pattern: str, max_depth: int = 20) -> DataFrame:
        """(sym, depth) from what a pattern names; a call is dispatched by its receiver, and what that chose not again."""
        seeds = self.seeds(pattern)
        return reach.reach_from(self.ahead(seeds), seeds, max_depth)

    def notices(self, patterns: list[str]) -> DataFrame:
        """Why walks from patterns may be empty."""
        return reports.seed_notices(patterns, self.facts.methods.select(F.col("symbol_id").alias("sym")).distinct(), self.calls)

    def touches(self, pattern: str, max_depth: int = 20, only: list[str] = (), exclude: list[str] = ()) -> DataFrame:
        """Effects in the reach of a pattern, counted by provider and operation."""
        known = self.reaches(pattern, max_depth).select(F.col("sym").alias("enclosing"))
        return fx.summary(self.effects(only, exclude).join(known, "enclosing", "left_semi"))

    def callers(self, pattern: str, max_depth: int = 20, lens: str = "flat") -> DataFrame:
        """(sym, depth) of what reaches a pattern; lens roots: those that nothing calls, entrypoints: those that are entries."""
        known = reach.reach_from(reach.reversed_edges(self.narrow), self.seeds(pattern), max_depth)
        if lens == "roots":
            return known.join(reach.roots(self.narrow, known), "sym", "left_semi")
        if lens == "entrypoints":
            return known.join(self.entrypoints().select(F.col("symbol_id").alias("sym")), "sym", "left_semi")
        return known

    def confirmed(self, pattern: str, max_depth: int | None = 20) -> DataFrame:
        """(seed, hit): roots found backwards, and whether the one-hop rule lets them get there forwards.

        Walked back from the goals in the same rule: a node is known as one that may still dispatch, or as one that
        dispatch chose, which may not. What a goal is reached by in either form counts.
        """
        back = self.callers(pattern, max_depth, "roots").select(F.col("sym").alias("seed"))
        step = lambda df, a, b: df.select(F.concat(F.lit(a), "src").alias("src"), F.concat(F.lit(b), "dst").alias("dst"))
        chosen = self.dispatch.select(F.col("hub").alias("src"), "dst")
        # "c:" stands for a called member, "d:" for one that dispatch chose.
        calls = self.calls.select("src", "dst").distinct()
        steps = step(calls, "c:", "c:").union(step(calls, "d:", "c:")).union(step(chosen, "c:", "d:"))
        goals = self.seeds(pattern).select(F.explode(F.array(F.concat(F.lit("c:"), "sym"), F.concat(F.lit("d:"), "sym"))).alias("sym"))
        met = reach.reach_from(reach.reversed_edges(steps), goals, max_depth).where("sym like 'c:%'").select(F.expr("substring(sym, 3)").alias("seed")).withColumn("hit", F.lit(True))
        return back.join(met, "seed", "left").select("seed", F.coalesce("hit", F.lit(False)).alias("hit"))

    def path(self, start: str, goal: str, max_depth: int = 20) -> list[str]:
        first = self._one(start)
        return reach.shortest_path(self.ahead(self.spark.createDataFrame([(first,)], "sym string")), first, self._one(goal), max_depth)

    def tree(self, pattern: str, max_depth: int = 50, max_nodes: int = 50_000) -> list[tuple[int, int, str, int, str]]:
        return reach.call_tree(self.calls, self._one(pattern), max_depth, max_nodes)

    def _one(self, pattern: str) -> str:
        found = [r["sym"] for r in self.seeds(pattern).orderBy("sym").limit(2).collect()]
        if len(found) != 1:
            raise LookupError(f"{pattern} names {'nothing' if not found else 'more than one symbol, ' + ' and '.join(found) + ' among them'}")
        return found[0]

    # Derivations

    def effects(self, only: list[str] = (), exclude: list[str] = ()) -> DataFrame:
        return fx.selected(fx.by_rule(self.facts.refs, rulebook.effect_rules(self.spark, self.rules), self.ancestors), only, exclude)[0]

    def entrypoints(self, kind: str | None = None) -> DataFrame:
        attributes = self.facts.refs.where("ref_kind = 'ctor' and enclosing is not null").select("enclosing", "target", "file_path", "line")
        rows = hazards.activated(hazards.entry_points(self.facts.methods, attributes, self.ancestors, self.rules["entryPoints"]), self.rules["deployments"])
        return rows.where(F.col("kind") == kind) if kind else rows

    def graph_findings(self) -> DataFrame:
        """Findings along the whole call graph: event cycles, writes without the companion of their key, amplified loops.

        Deliveries are edges here whatever the mode cuts, and no depth bounds a cycle.
        """
        rows = lambda df, type_, sure, context, detail, line, provider: df.select(
            F.lit(type_).alias("type"), sure.alias("confidence"), "enclosing", context.cast("string").alias("context"), detail.cast("string").alias("detail"), line.cast("long").alias("line"), provider.cast("string").alias("provider"))
        none = F.lit(None)
        marked = graph.handoffs(graph.call_edges(self.facts.refs), rulebook.handoff_rules(self.spark, self.rules))
        cycles = hazards.event_cycles(marked, {r["tag"]: r["delivery"] for r in self.rules["handoffs"]}).withColumnRenamed("sym", "enclosing")
        out = rows(cycles, "event_cycle", F.col("confidence"), F.col("cycle"), F.col("deliveries"), none, none)
        edges, effects = self.hops, self.effects()
        keyed = effects.select(F.col("enclosing").alias("sym"), docid.resource_key(F.col("resource"), self.rules["suffixes"]).alias("key"), "operation")
        for rule in self.rules.get("cacheCoherence", []):
            wrote, cleared = (keyed.where(F.col("operation").isin(*rule[side])).select("sym", "key") for side in ("writes", "companions"))
            lost = hazards.missing_companions(wrote, cleared, edges, rule["depth"]).withColumnRenamed("sym", "enclosing")
            out = out.unionByName(rows(lost, "cache_coherence", F.lit("medium"), F.col("key"), F.lit(",".join(rule["companions"])), none, none))
        events = fx.iteration_fanout(self.facts.refs, self.rules).select("caller", "file_path", "line", "enclosing").distinct()
        loops = hazards.amplified(events, reports.in_scope(effects, self.rules["amplification"]["scope"]), edges).withColumnRenamed("caller", "enclosing")
        return out.unionByName(rows(loops, "cross_method_amplification", F.col("confidence"), F.concat("provider", F.lit(":"), "operation"), F.concat("file_path", F.lit(":"), "line"), F.col("line"), F.col("provider")))

    def derive(self, outside: list[str] = ()) -> DataFrame:
        """All findings, those along the call graph among them, but for those in the namespaces given."""
        effects = self.effects()
        found = reports.findings(
            fx.observations(effects, self.rules), hazards.race_windows(self.facts.field_access), hazards.dual_writes(effects, self.rules["dualWrite"]),
            hazards.sync_over_async(effects, self.facts.methods), hazards.static_captures(self.facts.initialisers, self.facts.fields, self.rules["staticInitCapture"]))
        return hazards.excluded(found.unionByName(self.graph_findings()), list(outside))

    def hazards(self, pattern: str, max_depth: int = 20) -> DataFrame:
        """Findings in the reach of a pattern."""
        return self.derive().join(self.reaches(pattern, max_depth).select(F.col("sym").alias("enclosing")), "enclosing", "left_semi")

    def dead(self, pattern: str, max_depth: int | None = None) -> DataFrame:
        return hazards.dead_code(self.facts.methods, reach.reach_from(self.hops, self.seeds(pattern), max_depth), self.calls)

    # Reports

    def dispatch_fans(self) -> DataFrame:
        calls = graph.call_edges(self.facts.refs)
        hubs, groups = graph.dispatch_groups(self.facts.methods, self.ancestors, graph.mined_dispatch(self.facts.dispatch))
        targets = graph.typed(groups, self.facts.methods)
        narrowed = graph.narrowed_groups(graph.called_groups(calls, hubs, self.ancestors), targets, self.ancestors)
        return reports.dispatch_fans(calls, hubs, targets, narrowed, self.facts.methods.select(F.col("containing_symbol_id").alias("type_id")))

    def hotspots(self, axis: str = "effects", top: int = 50) -> DataFrame:
        effects = self.effects()
        seen = fx.observations(effects, self.rules).where(F.col("type").isin("looped_effect", "n_plus_1"))
        risks = hazards.race_windows(self.facts.field_access).select("enclosing", "type", "file_path", F.col("write_line").alias("line"))
        rows = reports.hotspots(graph.call_edges(self.facts.refs), self.facts.methods, effects, risks, reports.in_scope(seen, self.rules["amplification"]["scope"]), self.dispatch_fans())
        return rows.orderBy(F.desc(AXES[axis]), "symbol_id").limit(top)

    def amplify(self, least: int = 2, top: int = 50) -> DataFrame:
        """Effects in loops by how deep their loop is nested in its method, in buckets."""
        rows = fx.iterated(self.effects(), self.rules).where("iteration is not null").withColumn("detail", F.col("iteration.detail")).withColumn("kind", F.col("iteration.kind"))
        depths = reports.loop_depths(rows.select("enclosing", "kind", "detail", "line"))
        found = rows.join(depths, ["enclosing", "detail"]).select(F.col("depth").cast("long").alias("degree"), "provider", "operation", "file_path", "line").distinct()
        return reports.buckets(found, self.rules["amplification"]["categories"], least, top)

    def effects_diff(self, pairs: list[tuple[str, str, str]], max_depth: int | None = None) -> DataFrame:
        """pairs: (label, a, b), each a symbol's id."""
        table = self.spark.createDataFrame(pairs, "label string, a string, b string")
        known = reach.reach(self.hops, table.select(F.explode(F.array("a", "b")).alias("seed")).distinct().select("seed", F.col("seed").alias("sym")), max_depth)
        return reports.effect_difference(table, known, self.effects(), self.rules["suffixes"])

    def impact(self, head: Engine, max_depth: int | None = None) -> DataFrame:
        """What the reach of the entry points of both stores gained and lost in head, largest first."""
        def closure(e: Engine) -> DataFrame:
            return reach.reach(e.hops, e.entrypoints().select(F.col("symbol_id").alias("seed"), F.col("symbol_id").alias("sym")), max_depth)

        changed = reports.changed_bodies(self.facts.methods, head.facts.methods)
        return reports.reach_changes(closure(self), closure(head), changed).orderBy(F.desc("delta"), "seed")

    def footprint(self, max_depth: int | None = None) -> DataFrame:
        """(seed, provider, operation, n, in_loop): effects in the reach of each entry point, by how many members produce them."""
        seeds = self.entrypoints().select(F.col("symbol_id").alias("seed"), F.col("symbol_id").alias("sym")).distinct()
        looped = fx.iterated(self.effects(), self.rules).select("enclosing", "provider", "operation", F.col("iteration").isNotNull().alias("in_loop"))
        return reports.entry_footprint(reach.reach(self.ahead(seeds), seeds, max_depth), looped)

    def footprint_changes(self, head: Engine, max_depth: int | None = None) -> DataFrame:
        """What the entry points of both stores do more, less or in a loop in head."""
        return reports.entry_changes(self.footprint(max_depth), head.footprint(max_depth))

    # Listings

    def symbols(self, text: str, limit: int = 50) -> DataFrame:
        return reports.search(self.facts.methods, text, limit)

    def refs(self, text: str) -> DataFrame:
        return reports.keyed(self.facts.refs, self.facts.methods.where(F.contains(F.lower("symbol_id"), F.lit(text.lower()))).select(F.col("symbol_id").alias("sym")), "target")

    def choices(self, text: str) -> DataFrame:
        return reports.ambiguous(self.facts.methods.select(F.col("symbol_id").alias("sym")), text)

    def usage(self) -> DataFrame:
        return reports.usage_edges(self.facts.refs, self.facts.methods)

    def unused(self, declared: DataFrame) -> DataFrame:
        return reports.unused(declared, self.usage())

    def di(self) -> DataFrame:
        return reports.listing(self.facts.registrations)

    def runs(self) -> DataFrame:
        return self.facts.runs.orderBy(F.desc("created_at"), "store_id")

    def files(self, excluded: list[str] = ()) -> DataFrame:
        return reports.classified(self.facts.methods, list(excluded))

    def providers(self) -> list[tuple[str, str]]:
        return sorted({(r["provider"], r["operation"]) for r in self.rules["effects"]})

    def show(self, pattern: str) -> DataFrame:
        """Where what a pattern names stands."""
        own = graph.canonical(self.facts.methods).join(self.seeds(pattern).select(F.col("sym").alias("symbol_id")), "symbol_id", "left_semi")
        return own.select("symbol_id", docid.bare(F.col("symbol_id")).alias("name"), "file_path", "line", "end_line", "modifiers")
