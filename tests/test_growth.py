"""Work that goes by the rows, not by their pairs; whole trees; tasks that don't grow."""

import random

from factlattice.operators import effects, graph, reach, reports
from factlattice.plans import registry
from factlattice.sources import facts, rules, shared


def dispatched(spark, n):
    """n members of a base type and n overrides in each of two subtypes, all of one name, and calls with receivers."""
    rows = [(f"M:B.Do{k}()", "Do", "T:B", False) for k in range(n)] + [(f"M:{t}.Do{k}()", "Do", f"T:{t}", True) for t in ("C", "D") for k in range(n)]
    methods = spark.createDataFrame(rows, "symbol_id string, name string, containing_symbol_id string, is_override boolean")
    ancestors = graph.closure(spark.createDataFrame([("T:C", "T:B"), ("T:D", "T:B")], "type_id string, related_id string"))
    mined = spark.createDataFrame([("M:B.Do0()", "M:C.Do1()", "impl")], "src string, dst string, kind string")
    dice = random.Random(7)
    calls = [(dice.choice(rows)[0], dice.choice(rows)[0], dice.choice(["T:B", "T:C", "T:D", "T:Out", None]), "invocation") for _ in range(40)]
    return methods, ancestors, mined, spark.createDataFrame(calls, "src string, dst string, receiver_type string, kind string")


def test_groups_are_listed_once(spark):
    methods, ancestors, mined, calls = dispatched(spark, 12)
    hubs, groups = graph.dispatch_groups(methods, ancestors, mined)
    assert hubs.count() == 12 and groups.count() == 24 + 1
    pairs = {(f"M:B.Do{a}()", f"M:{t}.Do{b}()") for a in range(1, 12) for t in ("C", "D") for b in range(12)}
    assert {tuple(r) for r in graph.cha_dispatch(methods, ancestors, mined).collect()} == pairs
    targets = graph.typed(groups, methods)
    all_targets = graph.dispatch_targets(methods, mined, ancestors)
    assert {(r.hub, r.dst) for r in all_targets.collect()} == pairs | {("M:B.Do0()", "M:C.Do1()")}
    called = graph.called_groups(calls, hubs, ancestors)
    narrowed = graph.narrowed_groups(called, targets, ancestors)
    plain = graph.narrowed_calls(calls, all_targets, ancestors)
    assert {tuple(r) for r in called.join(narrowed, ["grp", "receiver"]).select("hub", "receiver", "dst").collect()} == {tuple(r) for r in plain.collect()}
    # Walks through groups meet what walks over pairs do, both ways, at the same depths.
    hops = graph.narrowed_hops(calls, all_targets, plain)
    into, out = graph.narrowed_ways(calls, hubs, targets, narrowed)
    seeds = calls.select("src", "dst").limit(3).select("src").distinct().selectExpr("src as seed", "src as sym")
    rows = lambda df: sorted(map(tuple, df.select("seed", "sym", "depth").collect()))
    assert rows(reach.reach_by(calls, into, out, seeds)) == rows(reach.reach(hops, seeds, None))
    back = reach.reach_by(reach.reversed_edges(calls), out.selectExpr("dst as src", "node"), into.selectExpr("node", "src as dst"), seeds)
    assert rows(back) == rows(reach.reach(reach.reversed_edges(hops), seeds, None))
    fans = {r.hub: (r.fan, r.incoming_unnarrowed) for r in reports.dispatch_fans(calls, hubs, targets, narrowed, methods.selectExpr("containing_symbol_id as type_id")).collect()}
    narrow = {(r.hub, r.receiver): r.n for r in plain.groupBy("hub", "receiver").count().withColumnRenamed("count", "n").collect()}
    want = {}
    for c in calls.collect():
        if c.dst in {a for a, _ in pairs} and narrow.get((c.dst, c.receiver_type), 24) == 24:
            want[c.dst] = (24, want.get(c.dst, (0, 0))[1] + 1)
    assert fans == want and fans


def test_pairs_in_blocks(spark):
    left = spark.createDataFrame([(k % 3, f"l{k}") for k in range(50)], "token int, src string")
    right = spark.createDataFrame([(k % 4, f"r{k}") for k in range(40)], "token int, dst string")
    got = sorted(map(tuple, graph.paired(left, right, ["token"], 4).select("token", "src", "dst").collect()))
    assert got == sorted(map(tuple, left.join(right, "token").collect())) and len(got) == 500


def test_busy_slot(spark):
    """A slot's sites that repeat are one before the join."""
    many = lambda side: spark.range(20_000).selectExpr("'s' as slot", f"concat('{side}', id % 2) as {side}")
    none = spark.createDataFrame([], "slot string")
    made = graph.delegate_fields(many("dst"), many("src"), none)
    assert {tuple(r) for r in made.collect()} == {(f"src{a}", f"dst{b}") for a in (0, 1) for b in (0, 1)}


def plain_tree(calls, root, deepest):
    below = {}
    for s, d, line in sorted(set(calls), key=lambda c: (c[0], c[2], c[1])):
        below.setdefault(s, []).append(d)
    out, done = [], set()

    def visit(sym, depth, parent):
        node, under = len(out), below.get(sym, [])
        why = "" if not under else "AlreadyExpanded" if sym in done else "DepthCapped" if depth >= deepest else ""
        out.append((node, parent, sym, depth, why))
        if under and not why:
            done.add(sym)
            for d in under:
                visit(d, depth + 1, node)

    visit(root, 0, -1)
    return out


def test_whole_tree(spark):
    """More nodes than the limit that a user has by default, none of them cut; and any small tree as a plain walk has it."""
    wide = spark.range(60_000).selectExpr("'r' as src", "concat('n', id) as dst", "cast(id as int) as line")
    rows = reach.tree_rows(wide, "r")
    assert rows.count() == 60_001 and rows.where("truncated <> ''").isEmpty()
    dice = random.Random(3)
    calls = [(f"m{dice.randrange(25)}", f"m{dice.randrange(25)}", dice.randrange(4)) for _ in range(70)]
    edges = spark.createDataFrame(calls, "src string, dst string, line int")
    for deepest in (2, 3, 50):
        assert [tuple(r) for r in reach.tree_rows(edges, "m1", deepest).orderBy("node").collect()] == plain_tree(calls, "m1", deepest)


def test_tasks_by_size(spark):
    conf = spark.conf
    before = {k: conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        shared.fitted(spark, 100 * shared.TASK_BYTES)
        assert conf.get("spark.sql.shuffle.partitions") == "100"
        shared.fitted(spark, 1)
        assert conf.get("spark.sql.shuffle.partitions") == "100" and int(conf.get("spark.sql.files.maxPartitionBytes")) == shared.TASK_BYTES
    finally:
        for k, v in before.items():
            conf.set(k, v)


def references(spark, *rows):
    kinds = "enclosing string, target string, target_name string, ref_kind string, receiver_type string, type_arguments string, first_template string, first_type string, argument string, argument_names string, argument_templates string, in_expression_tree boolean, file_path string, line int, ref_id long"
    made = lambda name, kind, receiver, ref_id: ("M:A.B.C()", f"M:D.E.{name}()", name, kind, receiver, None, None, None, None, None, None, False, "f", 1, ref_id)
    return spark.createDataFrame([made(*r) for r in rows], kinds)


def test_effects_stay_where_they_are(spark):
    """The first rule is told without moving references; only ids that repeat are gathered, to one effect each."""
    given = [
        {"provider": "p", "operation": "any", "on": "throw", "methods": [], "resource": "receiver_type"},
        {"provider": "p", "operation": "named", "on": "throw", "methods": ["Get"], "resource": "declaring_type"},
        {"provider": "p", "operation": "late", "methods": ["Get", "Put"], "resource": "declaring_type"},
        {"provider": "p", "operation": "later", "methods": ["Get"], "resource": "declaring_type"},
        {"provider": "p", "operation": "base", "methods": ["Low"], "declaringTypeBaseTypes": ["T:Base"], "resource": "declaring_type"},
    ]
    table = rules.effect_rules(spark, {"effects": given})
    above = spark.createDataFrame([("T:D.E", "T:Base"), ("T:D.E", "T:Else"), ("T:D.F", "T:Else")], "type_id string, ancestor string")
    rows = [("Get", "throw", "R", 1), ("Get", "throw", None, 2), ("Get", "invocation", None, 3), ("Put", "invocation", None, 4), ("Low", "invocation", None, 5), ("No", "invocation", None, 6), ("No", "throw", "R", 7), ("No", "throw", None, 8)]
    made = effects.by_rule(references(spark, *rows), table, above)
    assert sorted((r.ref_id, r.operation, r.resource) for r in made.collect()) == [(1, "any", "R"), (2, "named", "D.E"), (3, "late", "D.E"), (4, "late", "D.E"), (5, "base", "D.E"), (7, "any", "R")]
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    twice = effects.by_rule(references(spark, ("Get", "throw", None, 1), ("No", "throw", "R", 1), ("Put", "invocation", None, None), ("Put", "invocation", None, None)), table, above)
    assert sorted((r.ref_id or 0, r.operation) for r in twice.collect()) == [(0, "late"), (1, "any")]


def test_parts_without_a_sort(spark):
    """A table in parts is written by a writer a part, unless the user has set how; the rows stay the same."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "3")
        shared.fitted(spark, 1)
        assert spark.conf.get(name) == "3"
        spark.conf.set(name, "0")
        shared.fitted(spark, 1)
        assert spark.conf.get(name) == "16"
        rows = spark.range(200).selectExpr("id", "concat('k', id % 20) as kind")
        assert sorted(map(tuple, shared.written(rows, "kind").collect())) == sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.set(name, before)


def test_references_are_kept_as_numbers(spark, small):
    """No text is moved or written but the kind, and the references are the text's own, with parts that are missing or repeat."""
    part = spark.read.parquet(f"{small}/part.parquet")
    odd = part.where("p_partkey % 10 <> 4").unionByName(part.where("p_partkey % 10 = 5").selectExpr(*(c if c != "p_size" else "if(p_partkey % 20 = 5, null, p_size + 1) as p_size" for c in part.columns)))
    lineitem, held = spark.read.parquet(f"{small}/lineitem.parquet"), []

    def keep(make, *by):
        held.append(make())
        return shared.written(held[0], *by)

    made = facts.references(spark, odd, lineitem, keep)
    assert [f.name for f in held[0].schema if f.dataType.typeName() == "string"] == ["ref_kind"]
    want = spark.sql(facts.REFERENCES.replace("from lineitem", "from {lineitem}").replace("join methods", "join {methods}"), lineitem=lineitem, methods=spark.sql(facts.METHODS.replace("from part", "from {part}"), part=odd))
    assert made.dtypes == want.dtypes and want.count() > 100
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()


def test_what_is_not_asked_for_is_not_made(spark, small, tmp_path):
    """Files that touch a queue need neither all effects nor call edges with their sites; nor do cycles. Results stay the same."""
    (tmp_path / "x").symlink_to(small)
    sf, rows = str(tmp_path / "x"), lambda q: sorted(map(tuple, registry.QUERIES[q](spark, sf).collect()))
    alone = [rows(q) for q in ("file_effects", "hazard_event_cycle")]
    f = facts.load(spark, sf)
    assert f.has("pairs") and not f.has("effects") and not f.has("edges")
    registry.effects_of(f), registry.edges_of(f)
    assert [rows(q) for q in ("file_effects", "hazard_event_cycle")] == alone and alone[0]


def test_effects_of_one_provider(spark):
    """As if all had been made, also where another provider's rule comes first or an id repeats."""
    given = [
        {"provider": "p", "operation": "first", "methods": ["Get"], "resource": "receiver_type"},
        {"provider": "q", "operation": "second", "methods": ["Get", "Put"], "resource": "declaring_type"},
        {"provider": "p", "operation": "third", "methods": ["Low"], "resource": "declaring_type"},
    ]
    table = rules.effect_rules(spark, {"effects": given})
    once = references(spark, ("Get", "invocation", "R", 1), ("Get", "invocation", None, 2), ("Put", "invocation", None, 3), ("Low", "invocation", None, 4))
    twice = once.unionByName(references(spark, ("Get", "invocation", "R", 3)))
    for refs, ids in ((once, [2, 3]), (twice, [2])):
        got = effects.by_rule(refs, table, None, "q")
        assert sorted(r.ref_id for r in got.collect()) == ids and got.exceptAll(effects.by_rule(refs, table).where("provider = 'q'")).isEmpty()
