"""Walks, components, cycles and gates against plain versions of each; live facts through restarts and conflicts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factlattice.operators import effects, hazards, reach
from factlattice.sources import rules
from factlattice.streaming import overlay


def reachable(edges, start):
    out, known, todo = defaultdict(set), {start}, [start]
    for a, b in edges:
        out[a].add(b)
    while todo:
        for b in out[todo.pop()]:
            if b not in known:
                known.add(b)
                todo.append(b)
    return known


@pytest.fixture(scope="module")
def tangle():
    rng = random.Random(3)
    names = [f"n{k:02}" for k in range(60)]
    return sorted({(rng.choice(names), rng.choice(names)) for _ in range(85)} | {("n05", "n05"), ("z1", "z1")})


def test_strong(spark, tangle):
    nodes = {x for e in tangle for x in e}
    ahead = {n: reachable(tangle, n) for n in nodes}
    want = set()
    for n in nodes:
        own = {m for m in ahead[n] if n in ahead[m]}
        if len(own) > 1 or (n, n) in tangle:
            want.add((n, min(own)))
    df = spark.createDataFrame(tangle, "src string, dst string")
    assert {tuple(r) for r in reach.strong(df).collect()} == want and len({s for _, s in want}) >= 2
    assert reach.strong(df.where("src < dst")).count() == 0 and reach.strong(df.limit(0)).count() == 0


def test_nearest(spark, tangle):
    back = [(b, a) for a, b in tangle]
    sources = [("x", "n01"), ("x", "n07"), ("y", "n30"), ("y", "n31")]
    want = {}
    for label in "xy":
        level, known, depth = {s: s for k, s in sources if k == label}, {}, 0
        while level:
            known.update({n: (depth, o) for n, o in level.items()})
            new: dict = {}
            for a, b in back:
                if a in level and b not in known:
                    new[b] = min(new.get(b, level[a]), level[a])
            level, depth = new, depth + 1
        want.update({(label, n): v for n, v in known.items()})
    got = {(r.seed, r.sym): (r.depth, r.origin) for r in reach.nearest(spark.createDataFrame(tangle, "src string, dst string"), spark.createDataFrame(sources, "seed string, sym string")).collect()}
    assert got == want and len(got) > 20


def test_event_cycles(spark):
    """The worked example: three calls, two of them deliveries, make one cycle, as sure as its least sure delivery."""
    kind = "src string, dst string, kind string, tag string, line int"
    joins = {"event_raise": "high", "actor_tell": "low"}
    rows = [("A", "H", "handoff", "event_raise", 10), ("H", "B", "invocation", None, 20), ("B", "A", "handoff", "event_raise", 30), ("A", "x", "handoff", "actor_tell", 1), ("p", "q", "invocation", None, 1), ("q", "p", "invocation", None, 1)]
    got = lambda data: sorted(tuple(r) for r in hazards.event_cycles(spark.createDataFrame(data, kind), joins).collect())
    assert got(rows) == [("A", m, "high", 2) for m in "ABH"]
    assert got([("A", "H", "handoff", "actor_tell", 10), *rows[1:]]) == [("A", m, "low", 2) for m in "ABH"]
    assert got(rows[:2]) == [] and got([("s", "s", "handoff", "event_raise", 1)]) == [("s", "s", "high", 1)]


def gated(spark, rule, target="M:App.Data.OrderRepo.Get(System.Int32)", receiver="T:Lib.Db", ancestors=None, **given):
    kinds = {"enclosing": "string", "target": "string", "target_name": "string", "ref_kind": "string", "receiver_type": "string", "type_arguments": "string", "first_template": "string", "first_type": "string",
             "argument": "string", "argument_names": "string", "argument_templates": "string", "in_expression_tree": "boolean", "file_path": "string", "line": "int", "ref_id": "long"}
    base = {"enclosing": "M:App.Web.Page.Load()", "target": target, "target_name": "Get", "ref_kind": "invocation", "receiver_type": receiver, "in_expression_tree": False, "file_path": "f", "line": 1, "ref_id": 1, **given}
    refs = spark.createDataFrame([tuple(base.get(k) for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    rule = {"provider": "p", "operation": "o", "methods": ["Get"], "resource": "declaring_type", **rule}
    return effects.by_rule(refs, rules.effect_rules(spark, {"effects": [rule]}), ancestors).count() == 1


def test_type_gates(spark):
    """Base before declaring before receiver; the suffix counts unless a receiver gate alone admits the type."""
    above = spark.createDataFrame([("T:App.Data.OrderRepo", "T:App.Base", 2), ("T:App.Data.OrderRepo", "T:App.Data.OrderRepo", 0)], "type_id string, ancestor string, depth int")
    assert gated(spark, {}) and gated(spark, {"declaringTypes": ["App.Data"]}) and not gated(spark, {"declaringTypes": ["App.Dat"]})
    assert gated(spark, {"declaringTypes": ["App.Data"], "declaringTypeNameEndsWith": ["Repo"]})
    assert not gated(spark, {"declaringTypes": ["App.Data"], "declaringTypeNameEndsWith": ["Proxy"], "receivers": ["Lib.Db"]})
    assert gated(spark, {"declaringTypes": ["Other"], "declaringTypeNameEndsWith": ["Proxy"], "receivers": ["T:Lib.Db"]})
    assert gated(spark, {"receivers": ["App.Data"]}, receiver=None) and not gated(spark, {"receivers": ["Lib"]}, receiver=None) and gated(spark, {"receivers": ["Lib"]})
    assert gated(spark, {"declaringTypeBaseTypes": ["T:App.Base"]}, ancestors=above) and not gated(spark, {"declaringTypeBaseTypes": ["T:App.Else"], "receivers": ["Lib.Db"]}, ancestors=above)
    assert not gated(spark, {"declaringTypeBaseTypes": ["T:App.Base"]}) and not gated(spark, {"declaringTypeNameEndsWith": ["Proxy"]})
    assert gated(spark, {"minArguments": 2}, argument_names='["a","b"]') and not gated(spark, {"minArguments": 2}, argument_names='["a"]') and not gated(spark, {"minArguments": 1})
    assert gated(spark, {"on": "throw", "methods": []}, ref_kind="throw") and not gated(spark, {"on": "ctor", "methods": []}, ref_kind="throw") and not gated(spark, {}, ref_kind="ctor")


def test_two_calls_on_a_line(spark):
    """Two calls on one line that differ in nothing but their type arguments are two effects."""
    kinds = "enclosing string, target string, target_name string, ref_kind string, receiver_type string, type_arguments string, first_template string, first_type string, argument string, argument_names string, argument_templates string, in_expression_tree boolean, file_path string, line int"
    row = lambda t: ("M:A.B.C()", "M:D.E.Get()", "Get", "invocation", "T:D.E", t, None, None, None, None, None, False, "f", 1)
    refs = spark.createDataFrame([row("Order"), row("Customer")], kinds)
    rule = {"provider": "p", "operation": "o", "methods": ["Get"], "resource": "type_argument"}
    assert sorted(r.resource for r in effects.by_rule(refs, rules.effect_rules(spark, {"effects": [rule]})).collect()) == ["Customer", "Order"]


def test_live_facts_restart_and_conflict(spark, tmp_path):
    rows = lambda *data: spark.createDataFrame(list(data), "file_path string, symbol_id string, generation int")
    base = rows(("a", "a0", 0), ("b", "b0", 0), ("c", "c0", 0)).drop("generation")
    live = overlay.LiveFacts(spark, f"file://{tmp_path}/live", base)
    read = lambda facts: sorted((r.file_path, r.symbol_id) for r in facts.snapshot().collect())
    assert live.apply(rows(("a", "a1", 1)), 0, "one") and not live.apply(rows(("a", "a1", 1)), 0, "one")
    assert live.apply(rows(("b", "b1", 1)), 1, "one") and live.revision == 2
    # Another stream, whose batches count from 0 again, goes on from where the facts are.
    again = overlay.LiveFacts(spark, f"file://{tmp_path}/live")
    assert again.revision == 2 and again.apply(rows(("c", "c1", 1)), 0, "two") and again.revision == 3
    assert read(again) == [("a", "a1"), ("b", "b1"), ("c", "c1")]
    with pytest.raises(overlay.Conflict):
        live.apply(rows(("a", "a2", 2)), 2, "one")
    assert live.refresh() == 3 and live.apply(rows(("a", "a2", 2)), 2, "one")
    assert read(live) == [("a", "a2"), ("b", "b1"), ("c", "c1")] and live.snapshot(1).where("symbol_id = 'b0'").count() == 1


def test_confirmed(spark, small):
    """A caller is confirmed if a walk of calls, with no two dispatches in a row, leads from it to the goal."""
    from factlattice.plans.engine import Engine
    from factlattice.sources import facts

    engine = Engine(facts.load(spark, small))
    calls, chosen = ({tuple(r) for r in df.collect()} for df in (engine.calls.select("src", "dst"), engine.dispatch.select("hub", "dst")))
    goal = sorted(dst for _, dst in chosen)[0]
    got = {r.seed: r.hit for r in engine.confirmed(goal, None).collect()}
    steps = [((a, s), (b, False)) for a, b in calls for s in (False, True)] + [((a, False), (b, True)) for a, b in chosen]
    for seed, hit in got.items():
        assert hit == bool({(goal, False), (goal, True)} & reachable(steps, (seed, False)))
    assert any(got.values())


def test_live_host(spark, tmp_path):
    """A body's edit owes its own project, a surface's edit all that depend on it; nothing is answered while any is owed."""
    kind = "file_path string, symbol_id string, modifiers string, body_hash string"
    base = spark.createDataFrame([("p1/a", "M:A", "public", "h1"), ("p2/b", "M:B", "public", "h1"), ("p3/c", "M:C", "private", "h1"), ("p4/d", "M:D", "public", "h1")], kind)
    depends = spark.createDataFrame([("p2", "p1"), ("p3", "p2")], "src string, dst string")
    host = overlay.LiveHost(overlay.LiveFacts(spark, f"file://{tmp_path}/live", base), depends, F.substring_index("file_path", "/", 1), ["symbol_id", "modifiers"])
    made = []

    def question(df):
        made.append(1)
        return df.agg(F.count(F.lit(1)).alias("n"))

    assert [host.ask("n", question).first()["n"] for _ in range(2)] == [4, 4] and len(made) == 1
    edit = lambda *row: spark.createDataFrame([(*row, 1)], kind + ", generation int")
    assert host.edit(edit("p1/a", "M:A", "public", "h2"), 0, "s") and host.owed == {"p1"}
    with pytest.raises(overlay.Declined):
        host.ask("n", question)
    host.settle()
    assert host.ask("n", question).first()["n"] == 4 and len(made) == 2
    assert host.edit(edit("p1/a", "M:A2", "public", "h2"), 1, "s") and host.owed == {"p1", "p2", "p3"}
    host.settle(["p1", "p2"])
    with pytest.raises(overlay.Declined, match="p3"):
        host.ask("n", question)
    assert not host.edit(edit("p4/d", "M:D", "public", "h9"), 1, "s") and host.owed == {"p3"}
    host.settle()
    assert host.ask("n", question).first()["n"] == 4


def test_narrowed_hops(spark):
    """A receiver that narrows leads to its targets only; others lead to all; the member itself is always reached."""
    from factlattice.operators import graph

    calls = spark.createDataFrame([("a", "hub", "T1"), ("b", "hub", None), ("c", "plain", "T1")], "src string, dst string, receiver_type string")
    targets = spark.createDataFrame([("hub", "x"), ("hub", "y")], "hub string, dst string")
    narrowed = spark.createDataFrame([("hub", "T1", "x")], "hub string, receiver string, dst string")
    assert sorted(map(tuple, graph.narrowed_hops(calls, targets, narrowed).collect())) == [("a", "hub"), ("a", "x"), ("b", "hub"), ("b", "x"), ("b", "y"), ("c", "plain")]
