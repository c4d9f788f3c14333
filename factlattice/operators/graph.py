"""The call graph from references: edges, dispatch, and the shaping steps, each a transform of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import docid
from .reach import reach

CALLS = ("invocation", "methodGroup", "ctor")


def call_edges(refs: DataFrame) -> DataFrame:
    """First-party calls with a caller, one row per call site."""
    return call_rows(refs).distinct()


def call_rows(refs: DataFrame) -> DataFrame:
    """call_edges as the references have them, some more than once: for what doesn't count calls."""
    rows = refs.where(F.col("enclosing").isNotNull() & F.col("target_in_source") & F.col("ref_kind").isin(*CALLS))
    return rows.select(F.col("enclosing").alias("src"), F.col("target").alias("dst"), F.col("ref_kind").alias("kind"), "file_path", "line", "loop_kind", "receiver_type", "delegate_consumer")


def nodes(edges: DataFrame, dispatch: DataFrame, methods: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("sym"))
    more = dispatch.select(F.explode(F.array("source_member", "target_member")).alias("sym"))
    return ends.union(more).union(methods.select("symbol_id")).distinct()


def closure(relations: DataFrame, max_depth: int | None = None, strict: bool = False) -> DataFrame:
    """(type_id, ancestor, depth) over base and interface relations."""
    edges = relations.select(F.col("type_id").alias("src"), F.col("related_id").alias("dst"))
    seeds = edges.select("src").union(edges.select("dst")).distinct().select(F.col("src").alias("seed"), F.col("src").alias("sym"))
    out = reach(edges, seeds, max_depth).select(F.col("seed").alias("type_id"), F.col("sym").alias("ancestor"), "depth")
    return out.where("depth > 0") if strict else out


def mined_dispatch(dispatch: DataFrame, kinds: tuple[str, ...] = ("impl", "override"), max_depth: int | None = None) -> DataFrame:
    """(src, dst, kind): closure of each kind by itself; a step never crosses from one kind to another.

    All kinds go through one walk, each in nodes of its own.
    """
    node = lambda c: F.concat("kind", F.lit("\u001f"), c)
    own = dispatch.where(F.col("kind").isin(*kinds)).select(node("source_member").alias("src"), node("target_member").alias("dst"))
    far = reach(own, own.select(F.col("src").alias("seed"), F.col("src").alias("sym")).distinct(), max_depth).where("depth > 0")
    bare = lambda c: F.substring_index(c, "\u001f", -1)
    return far.select(bare("seed").alias("src"), bare("sym").alias("dst"), F.substring_index("seed", "\u001f", 1).alias("kind"))


def dispatch_groups(methods: DataFrame, ancestors: DataFrame, mined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hub, grp) and (grp, dst): each dispatched member has one group, which lists what all members of it go to.

    A member with a mined edge is a group of its own. Others go to name and arity matches among the overrides of subtypes, and
    share them with all members of that name and arity in their type: listed once a group, not once a member, these grow
    with the members, not with their square.
    """
    with_arity = methods.withColumn("arity", docid.arity(F.col("symbol_id")))
    key = lambda t: F.concat(F.lit("c\u001f"), t, F.lit("\u001f"), "name", F.lit("\u001f"), F.col("arity").cast("string"))
    below = with_arity.where("is_override").select(F.col("symbol_id").alias("dst"), "name", "arity", F.col("containing_symbol_id").alias("type_id"))
    below = below.join(ancestors.where("depth > 0").select("type_id", "ancestor"), "type_id").select(key("ancestor").alias("cls"), "dst").distinct()
    above = with_arity.select(F.col("symbol_id").alias("hub"), key("containing_symbol_id").alias("cls")).where("cls is not null")
    above = above.join(below.select("cls").distinct(), "cls", "left_semi").join(mined.select(F.col("src").alias("hub")).distinct(), "hub", "left_anti")
    # A member that is declared more than once has the targets of all its declarations.
    above = above.groupBy("hub").agg(F.array_join(F.array_sort(F.collect_set("cls")), "\u001e").alias("grp"))
    held = above.select("grp").distinct().select("grp", F.explode(F.split("grp", "\u001e")).alias("cls"))
    own = mined.select(F.concat(F.lit("m\u001f"), "src").alias("grp"), "dst", F.col("src").alias("hub")).distinct()
    return above.select("hub", "grp").unionByName(own.select("hub", "grp").distinct()), held.join(below, "cls").select("grp", "dst").distinct().unionByName(own.select("grp", "dst"))


def paired(left: DataFrame, right: DataFrame, on: list[str], block: int = 4096) -> DataFrame:
    """The join of two sides that each have many rows of a key, as a grid of blocks: no task gets more than about a block
    of either side of a key at once, and what is moved is a block's part of the pairs that come out."""
    rows = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = rows(left, "_nl").join(rows(right, "_nr"), on)
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, on).select(*left.columns, part(left, "_nl").alias("_a"), all_("_nr").alias("_b"))
    b = right.join(sizes, on).select(*right.columns, all_("_nl").alias("_a"), part(right, "_nr").alias("_b"))
    return a.join(b, [*on, "_a", "_b"]).drop("_a", "_b")


def cha_dispatch(methods: DataFrame, ancestors: DataFrame, mined: DataFrame) -> DataFrame:
    """(src, dst): name and arity matches in subtypes, overrides only, for members that have no mined edge.

    All pairs of members and overrides are wanted; each is made once, and none is compared or moved afterwards.
    """
    hubs, targets = dispatch_groups(methods, ancestors, mined)
    cha = F.startswith("grp", F.lit("c\u001f"))
    return paired(hubs.where(cha), targets.where(cha), ["grp"]).select(F.col("hub").alias("src"), "dst")


def narrowed_dispatch(hubs: DataFrame, targets: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(hub, receiver, dst): a receiver's own subtree's targets; without any, those of its nearest ancestor that has one.

    hubs: (hub, receiver); targets: (hub, dst, type_id); a hub may be a group. Targets are listed under the types above
    them, of which each has few, before hubs come in.
    """
    own = targets.join(ancestors.select("type_id", F.col("ancestor").alias("receiver")), "type_id").select("hub", "receiver", "dst").distinct().join(hubs, ["hub", "receiver"], "left_semi")
    rest = hubs.join(own.select("hub", "receiver").distinct(), ["hub", "receiver"], "left_anti")
    up = rest.join(ancestors.where("depth > 0").select(F.col("type_id").alias("receiver"), F.col("ancestor").alias("type_id"), "depth"), "receiver")
    # Which ancestor is the nearest is told by the types that have targets; the targets come in last.
    near = up.join(targets.select("hub", "type_id").distinct(), ["hub", "type_id"], "left_semi").groupBy("hub", "receiver").agg(F.min("depth").alias("depth"))
    return own.unionByName(up.join(near, ["hub", "receiver", "depth"]).join(targets, ["hub", "type_id"]).select("hub", "receiver", "dst").distinct())


def typed(targets: DataFrame, methods: DataFrame) -> DataFrame:
    """Targets of groups (grp, dst) with their types, as (hub, dst, type_id), a group standing for its hubs."""
    return targets.join(methods.select(F.col("symbol_id").alias("dst"), F.col("containing_symbol_id").alias("type_id")), "dst").select(F.col("grp").alias("hub"), "dst", "type_id")


def dispatch_targets(methods: DataFrame, mined: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(hub, dst, type_id): what a member may be dispatched to, whatever the receiver, and the target's type."""
    hubs, targets = dispatch_groups(methods, ancestors, mined)
    return paired(hubs, typed(targets, methods).withColumnRenamed("hub", "grp"), ["grp"]).select("hub", "dst", "type_id")


def called_groups(calls: DataFrame, hubs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(hub, receiver, grp): the dispatched members of calls, for the receivers that the hierarchy knows."""
    known = ancestors.select(F.col("type_id").alias("receiver")).distinct()
    return calls.select(F.col("dst").alias("hub"), F.col("receiver_type").alias("receiver")).distinct().join(known, "receiver", "left_semi").join(hubs, "hub").select("hub", "receiver", "grp")


def narrowed_groups(called: DataFrame, targets: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(grp, receiver, dst): narrowed_dispatch once a group and receiver, for all the group's members.

    called: (hub, receiver, grp); targets: (hub, dst, type_id), the groups as hubs.
    """
    return narrowed_dispatch(called.select(F.col("grp").alias("hub"), "receiver").distinct(), targets, ancestors).withColumnRenamed("hub", "grp")


def narrowed_calls(calls: DataFrame, targets: DataFrame, ancestors: DataFrame) -> DataFrame:
    """narrowed_dispatch for the receivers of calls that the hierarchy knows."""
    known = ancestors.select(F.col("type_id").alias("receiver")).distinct()
    hubs = calls.select(F.col("dst").alias("hub"), F.col("receiver_type").alias("receiver")).distinct().join(known, "receiver", "left_semi")
    return narrowed_dispatch(hubs.join(targets.select("hub").distinct(), "hub", "left_semi"), targets, ancestors)


def narrowed_ways(calls: DataFrame, hubs: DataFrame, targets: DataFrame, narrowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, node) and (node, dst): narrowed_hops but for the members themselves, through a node for each group, or group
    and receiver that narrows it, so that no caller is listed with all its targets. For reach.reach_by.

    targets: (hub, dst, type_id), the groups as hubs; narrowed: (grp, receiver, dst).
    """
    own = calls.select("src", F.col("dst").alias("hub"), F.col("receiver_type").alias("receiver")).distinct().join(hubs, "hub").select("src", "grp", "receiver").distinct()
    less = narrowed.select("grp", "receiver").distinct().withColumn("less", F.lit(True))
    node = F.concat("grp", F.lit("\u001d"), "receiver")
    into = own.join(less, ["grp", "receiver"], "left").select("src", F.when(F.col("less"), node).otherwise(F.col("grp")).alias("node")).distinct()
    out = narrowed.select(node.alias("node"), "dst").unionByName(targets.select(F.col("hub").alias("node"), "dst")).distinct()
    return into, out


def narrowed_hops(calls: DataFrame, targets: DataFrame, narrowed: DataFrame) -> DataFrame:
    """(src, dst): a call's member, and what the call may be dispatched to there: by its receiver where that narrows the
    member, else all of the member's targets. A walk over these, forwards or backwards, never dispatches twice in a row.
    """
    own = calls.select("src", F.col("dst").alias("hub"), F.col("receiver_type").alias("receiver")).distinct()
    by_receiver = own.join(narrowed, ["hub", "receiver"]).select("src", "dst")
    rest = own.join(narrowed.select("hub", "receiver").distinct(), ["hub", "receiver"], "left_anti")
    return own.select("src", F.col("hub").alias("dst")).unionByName(by_receiver).unionByName(rest.join(targets.select("hub", "dst"), "hub").select("src", "dst")).distinct()


def source_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, line) with instantiations ``id~mono...`` folded back to their members, once each."""
    own = lambda c: F.substring_index(c, "~mono", 1).alias(c)
    return edges.select(own("src"), own("dst"), "kind", "line").distinct()


def redirected(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, line): references whose target's bare type matches a rule go to the rule's type instead."""
    bare = refs.withColumn("declaring", docid.declaring_type(F.col("target")))
    rows = bare.join(rules, bare["declaring"] == rules["from_type"], "left")
    to = F.concat(F.lit("M:"), F.col("to_type"), F.lit("."), docid.member(F.col("target")))
    return rows.where(F.col("enclosing").isNotNull()).select(F.col("enclosing").alias("src"), F.coalesce(to, F.col("target")).alias("dst"), "line").distinct()


def handoffs(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges with kind handoff and a tag where a method group goes to a dispatcher of the rules; no edge is lost."""
    rows = edges.join(F.broadcast(rules), (edges["kind"] == "methodGroup") & (edges["delegate_consumer"] == rules["consumer"]), "left")
    more = [c for c in rules.columns if c not in ("consumer", "tag")]
    return rows.select("src", "dst", F.when(F.col("tag").isNotNull(), "handoff").otherwise(F.col("kind")).alias("kind"), "tag", "line", *more)


def cut_handoffs(edges: DataFrame, mode: str) -> DataFrame:
    """SyncCut drops handoffs, AsyncExact keeps those of exact precision, AsyncInclude keeps all."""
    if mode == "SyncCut":
        return edges.where("kind <> 'handoff'")
    if mode == "AsyncExact":
        return edges.where("kind <> 'handoff' or coalesce(precision, 'exact') = 'exact'")
    if mode == "AsyncInclude":
        return edges
    raise ValueError(f"no such handoff mode: {mode}")


def event_marks(edges: DataFrame, event_reads: DataFrame) -> DataFrame:
    """Method groups at a site (src, file_path, line) that reads an event are subscriptions."""
    sites = event_reads.select("src", "file_path", "line").distinct().withColumn("subscribes", F.lit(True))
    rows = edges.join(sites, ["src", "file_path", "line"], "left")
    return rows.select("src", "dst", F.when((F.col("kind") == "methodGroup") & F.col("subscribes"), "handoff").otherwise(F.col("kind")).alias("kind"), "line")


def deliveries(producers: DataFrame, handlers: DataFrame) -> DataFrame:
    """(src, dst, token, precision): producers (src, token) to handlers (dst, token); exact if a token has one handler.

    Counted before the join, whose pairs are made block by block: a busy token is neither gathered nor moved as pairs.
    """
    sole = handlers.select("token", "dst").distinct()
    count = sole.groupBy("token").agg(F.when(F.count(F.lit(1)) == 1, "exact").otherwise("fanout").alias("precision"))
    return paired(producers.select("src", "token").distinct(), sole.join(count, "token"), ["token"]).select("src", "dst", "token", "precision")


def delegate_fields(binds: DataFrame, invokes: DataFrame, escapes: DataFrame) -> DataFrame:
    """(src, dst): who invokes a slot calls what is bound to it, unless the slot escapes.

    Sites that repeat are one before the join: its size goes by the members of a slot, not by their sites.
    """
    safe = binds.select("slot", "dst").distinct().join(escapes.select("slot").distinct(), "slot", "left_anti")
    return paired(invokes.select("src", "slot").distinct(), safe, ["slot"]).select("src", "dst").distinct()


def cut(edges: DataFrame, patterns: list[str]) -> DataFrame:
    """Edges whose caller no cut pattern names: such a node is a leaf."""
    keep = ~F.lit(False)
    for p in patterns:
        keep = keep & ~docid.wildcard(F.col("src"), p)
    return edges.where(keep)


def external_leaves(refs: DataFrame, admitted: DataFrame, denied: list[str]) -> DataFrame:
    """(src, dst) to methods outside the source: those of admitted types, and others not under a denied prefix."""
    rows = refs.where(F.col("enclosing").isNotNull() & ~F.col("target_in_source") & F.col("ref_kind").isin(*CALLS) & F.startswith("target", F.lit("M:")))
    rows = rows.withColumn("declaring", docid.declaring_type(F.col("target"))).join(admitted.withColumn("named", F.lit(True)), "declaring", "left")
    off = F.lit(False)
    for d in denied:
        off = off | docid.within(F.col("declaring"), F.lit(d))
    return rows.where(F.coalesce("named", F.lit(False)) | ~off).select(F.col("enclosing").alias("src"), F.col("target").alias("dst")).distinct()


def factories(edges: DataFrame, constructed: DataFrame) -> DataFrame:
    """Edges to a generic factory with a concrete type argument go to that type's constructors; others stay.

    edges: (src, dst, type_argument); constructed: (type_id, ctor).
    """
    rows = edges.join(constructed, edges["type_argument"] == constructed["type_id"], "left")
    return rows.select("src", F.coalesce("ctor", "dst").alias("dst")).distinct()


def canonical(methods: DataFrame) -> DataFrame:
    """One row per symbol: the first by file, line and modifiers."""
    order = W.partitionBy("symbol_id").orderBy("file_path", "line", "modifiers", "body_hash")
    return methods.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def instantiations(sites: DataFrame, cap: int = 50) -> DataFrame:
    """Concrete instantiations of each method (method, binding); a method with more than cap has none."""
    rows = sites.where(~F.exists(F.split("binding", ","), lambda b: b.rlike("^(M:|T:|\\?)"))).select("method", "binding").distinct()
    few = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap)
    return rows.join(few.select("method"), "method", "left_semi")


def collapsed(rows: DataFrame) -> DataFrame:
    """Instantiations ``id~mono...`` back to their method, at the least depth."""
    return rows.groupBy(F.substring_index("sym", "~mono", 1).alias("sym")).agg(F.min("depth").alias("depth"))


def matched(names: DataFrame, pattern: str) -> DataFrame:
    """Exact ids or qualified names if there are any, else substrings without regard to case."""
    exact = (F.col("sym") == pattern) | (docid.bare(F.col("sym")) == pattern)
    both = names.select("sym", exact.alias("exact")).where(F.col("exact") | F.contains(F.lower("sym"), F.lit(pattern.lower())))
    some = both.agg(F.max("exact").alias("some"))
    return both.join(F.broadcast(some)).where(F.col("exact") | ~F.col("some")).select("sym")
