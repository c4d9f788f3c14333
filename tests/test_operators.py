"""Operators against plain walks, worked examples, and a rebuilt table."""

import random

import pytest

from factlattice.functions import docid
from factlattice.operators import effects, graph, hazards, reach, reports
from factlattice.sources import facts, rules
from factlattice.streaming import overlay


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)}
    return edges, spark.createDataFrame(sorted(edges), "src string, dst string")


def walk(edges, start, deep):
    known, front = {start: 0}, [start]
    for depth in range(1, deep + 1):
        front = sorted({b for a, b in edges if a in front} - known.keys())
        known.update(dict.fromkeys(front, depth))
    return known


def test_reach_and_paths(spark, drawn):
    edges, df = drawn
    start = max({a for a, _ in edges}, key=lambda a: (len(walk(edges, a, 6)), a))
    names = (start, "n2", "absent")
    seeds = spark.createDataFrame([(s, s) for s in names], "seed string, sym string")
    got = {}
    for r in reach.reach(df, seeds, 6).collect():
        got.setdefault(r.seed, {})[r.sym] = r.depth
    assert got == {s: walk(edges, s, 6) for s in names}
    known = walk(edges, start, 6)
    goal = max(known, key=lambda k: (known[k], k))
    path = reach.shortest_path(df, start, goal, 6)
    assert len(path) == known[goal] + 1 and all(p in edges for p in zip(path, path[1:]))
    assert reach.shortest_path(df, start, start) == [] and reach.shortest_path(df, start, "absent", 3) == []
    with pytest.raises(reach.BudgetExceeded):
        reach.reach(df, seeds, 6, max_nodes=3)


def test_event_cycle(spark):
    """A -> H -> B -> A is one cycle; a chain is none."""
    ring = spark.createDataFrame([("A", "H"), ("H", "B"), ("B", "A"), ("A", "x")], "src string, dst string")
    marked = ring.where("src in ('A', 'B') and dst <> 'x'")
    assert sorted(map(tuple, reach.cycles(ring, marked).collect())) == [("A", "A"), ("A", "B"), ("A", "H")]
    chain = ring.where("src <> 'B'")
    assert reach.cycles(chain, chain).count() == 0


def test_longest_chain(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "p"), ("o", "p")], "src string, dst string")
    anchors = spark.createDataFrame([(k, 2 if k == "b" else 1) for k in "abcopq"], "sym string, weight int")
    got = {r.sym: (r.degree, r.next) for r in reach.longest_chain(anchors, edges).collect()}
    assert got == {"a": (4, "b"), "b": (3, "c"), "c": (1, None), "o": (-1, None), "p": (-1, None), "q": (-1, None)}


def test_call_tree(spark):
    edges = spark.createDataFrame([("r", "b", 2), ("r", "a", 1), ("a", "c", 1), ("b", "a", 1)], "src string, dst string, line int")
    got = [(s, d, w) for _, _, s, d, w in reach.call_tree(edges, "r", 5)]
    assert got == [("r", 0, ""), ("a", 1, ""), ("c", 2, ""), ("b", 1, ""), ("a", 2, "AlreadyExpanded")]


def test_symbol_ids(spark):
    rows = [("M:N.T`1.Do(System.Int32,System.Collections.Dict{A,B})",), ("M:N.T.Go()",), ("M:N.T.Go(A)",)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(docid.arity(df.s), docid.declaring_type(df.s), docid.member(df.s), docid.resource_key(docid.declaring_type(df.s), ["T", "Long"])).collect()
    assert [tuple(r) for r in got] == [(2, "N.T", "Do", "T"), (0, "N.T", "Go", "T"), (1, "N.T", "Go", "T")]
    import re

    assert re.match(docid.glob("src/**/*.cs"), "src/a/b.cs") and re.match(docid.glob("src/**/*.cs"), "src/b.cs") and not re.match(docid.glob("src/*.cs"), "src/a/b.cs")


CALL = "enclosing string, target string, target_name string, ref_kind string, file_path string, line int, receiver_type string, argument string, type_arguments string, first_template string, first_type string, argument_names string, argument_templates string, loop_kind string, loop_detail string, loop_bind_type string, scopes string, outer_calls string, catch_type string, in_expression_tree boolean"


def call(spark, **given):
    base = dict(enclosing="M:A.B.C()", target="M:X.Y.Do8()", target_name="Do8", ref_kind="invocation", file_path="f", line=1, in_expression_tree=False)
    names = [c.split()[0] for c in CALL.split(", ")]
    return spark.createDataFrame([tuple({**base, **given}.get(n) for n in names)], CALL)


def test_first_resolvable_rule_wins(spark):
    """A rule whose resource can't be told gives way to the next; what is quoted isn't called."""
    refs = call(spark, receiver_type="T:Lib.S5", argument="a")
    got = effects.by_rule(refs, rules.effect_rules(spark)).collect()
    assert [(r.provider, r.operation, r.resource) for r in got] == [("queue", "publish", "T:Lib.S5")]
    assert effects.by_rule(call(spark, receiver_type="T:Lib.S5", in_expression_tree=True), rules.effect_rules(spark)).count() == 0


@pytest.mark.parametrize("strategy, index, given, want", [
    ("receiver_type", None, {"receiver_type": "R"}, "R"), ("declaring_type", None, {}, "X.Y"), ("argument_type", None, {"first_type": "int"}, "int"), ("nonsense", None, {"receiver_type": "R"}, None),
    ("type_argument", None, {"type_arguments": "A,B"}, "A,B"), ("type_argument", 1, {"type_arguments": "F<A, (B, C)>, K[,] ,L"}, "K[,]"), ("type_argument", 3, {"type_arguments": "A,B"}, None), ("type_argument", 0, {"type_arguments": "(A, int),B"}, "(A, int)"),
    ("argument_name", None, {"argument": "x.y"}, "x.y"), ("argument_name", 1, {"argument_names": '["a","R.X"]'}, "R.X"), ("argument_name", 0, {"argument_names": '["~a|b"]'}, None), ("argument_name", 0, {"argument_names": "broken"}, None),
    ("string_argument", None, {"first_template": "t"}, "t"), ("string_argument", 1, {"argument_templates": '["a,b",null]'}, None), ("string_argument", 0, {"argument_templates": '["a,b",null]'}, "a,b"),
    ("string_argument_or_receiver", None, {"first_template": " ", "receiver_type": "R"}, "R"), ("string_argument_or_receiver", None, {}, "X.Y"),
    ("http_argument", None, {"first_template": "https://h/p//"}, "h/p"), ("http_argument", None, {"first_template": "/p/q"}, "p/q"), ("http_argument", None, {}, "X.Y"),
    ("ef_query_root", None, {"type_arguments": "E", "receiver_type": "R"}, "E"), ("ef_dbset_receiver", None, {"type_arguments": "E"}, "E"), ("ef_context_receiver", None, {"type_arguments": "E"}, "X.Y"), ("ef_database_facade", None, {"receiver_type": "R"}, "R"),
])
def test_resources(spark, strategy, index, given, want):
    rule = {"provider": "p", "operation": "o", "methods": ["Do8"], "resource": strategy, "type_argument_index": index, "argument_index": index}
    got = effects.by_rule(call(spark, **given), rules.effect_rules(spark, {"effects": [rule]})).collect()
    assert [r.resource for r in got] == ([want] if want is not None else [])


def test_containing_gate(spark):
    rule = {"provider": "p", "operation": "o", "methods": ["Do8"], "resource": "declaring_type", "containing": ["A.B"]}
    table = rules.effect_rules(spark, {"effects": [rule]})
    assert [effects.by_rule(call(spark, enclosing=e), table).count() for e in ("M:A.B.C()", "M:A.Bx.C()")] == [1, 0]


def test_iterations(spark):
    """A query over a single value binds once; a lambda of an enumerating method iterates; names join."""
    lam = "Lib.Seq\x1fSelect\x1fy, z"
    one = lambda **k: effects.iterated(call(spark, **k)).first()["iteration"]
    assert one(loop_kind="query", loop_detail="a, b in xs", loop_bind_type="Lib.Option") is None
    assert one(loop_kind="query", loop_detail="a, b in xs", loop_bind_type="System.Linq.Enumerable").asDict() == {"kind": "query", "detail": "a, b in xs", "names": ["a", "b"], "source": "xs"}
    assert one(loop_kind="foreach", loop_detail="a in xs", outer_calls=lam).asDict() == {"kind": "foreach", "detail": "a in xs", "names": ["a", "y", "z"], "source": "xs"}
    assert one(outer_calls=lam).asDict() == {"kind": "lambda", "detail": "y, z in Select", "names": ["y", "z"], "source": "Select"}
    assert one(outer_calls="Lib.Option\x1fMap\x1fy") is None
    assert one(loop_kind="while").asDict() == {"kind": "while", "detail": "while", "names": [], "source": ""}


def test_loop_depths(spark):
    """Nested spans add up, siblings don't, and the clauses of one query are one loop."""
    rows = [("m", "foreach", "a in xs", k) for k in (1, 20)] + [("m", "foreach", "b in ys", k) for k in (3, 9)] + [("m", "foreach", "c in zs", k) for k in (10, 15)]
    rows += [("q", "query", "p in ps", k) for k in (1, 30)] + [("q", "query", "p, r in ps", k) for k in (4, 20)] + [("q", "foreach", "d in ds", 8)]
    got = {(r.enclosing, r.detail): r.depth for r in reports.loop_depths(spark.createDataFrame(rows, "enclosing string, kind string, detail string, line int")).collect()}
    assert got == {("m", "a in xs"): 1, ("m", "b in ys"): 2, ("m", "c in zs"): 2, ("q", "p in ps"): 1, ("q", "p, r in ps"): 1, ("q", "d in ds"): 2}


def test_conjuncts(spark):
    df = spark.createDataFrame([('a /* && */ &&  (b || c && d) // x\n && s == "p && // q"',), ("a & b",), (" x&&x ",), ("f('\\'', \"\\\"&&\") && k[i && j]",)], "g string")
    got = [r[0] for r in df.select(docid.conjuncts(df.g)).collect()]
    assert got == [["(b || c && d)", "a", 's == "p && // q"'], ["a & b"], ["x"], ["f('\\'', \"\\\"&&\")", "k[i && j]"]]


def test_one_hop(spark):
    """What dispatch has chosen is called from, but isn't dispatched again."""
    calls = spark.createDataFrame([("s", "a"), ("b", "c")], "src string, dst string")
    dispatch = spark.createDataFrame([("a", "b"), ("b", "x"), ("c", "d")], "src string, dst string")
    got = sorted(map(tuple, reach.one_hop(calls, dispatch, spark.createDataFrame([("s",)], "sym string")).collect()))
    assert got == [("a", False, 1), ("b", True, 2), ("c", False, 3), ("d", True, 4), ("s", False, 0)]


def test_races(spark):
    """A read before a write, with the earliest read; static constructors, same lines and safe publishing are none."""
    kind = "cell string, enclosing string, access string, file_path string, line int, lock_held boolean, transaction_held boolean, thread_static boolean, modifiers string"
    rows = []

    def site(cell, enclosing, access, line, lock=False, tx=False, thread=False, more=""):
        rows.append((cell, enclosing, access, "f", line, lock, tx, thread, "public static" + more))

    for enclosing, tx in (("M:A.Go()", False), ("M:A.Held()", True)):
        for line in (3, 5):
            site("F:A.c", enclosing, "read", line, tx=tx)
        site("F:A.c", enclosing, "write", 9, tx=tx)
    site("F:A.c", "M:A.After()", "write", 5), site("F:A.c", "M:A.After()", "read", 9)
    site("F:A.c", "M:A.Same()", "write", 5), site("F:A.c", "M:A.Same()", "read", 5)
    site("F:A.c", "M:A.#cctor()", "read", 1), site("F:A.c", "M:A.#cctor()", "write", 5)
    site("F:A.c", "M:A.get_X()", "read", 1), site("F:A.c", "M:A.get_X()", "write", 5), site("F:A.c", "M:A.get_X()", "write", 7, lock=True)
    site("F:A._instance", "M:A.Once()", "read", 1), site("F:A._instance", "M:A.Once()", "write", 5)
    site("F:A._instance", "M:A.Twice()", "read", 1), site("F:A._instance", "M:A.Twice()", "write", 5), site("F:A._instance", "M:A.Twice()", "write", 6)
    site("F:A.v", "M:A.InitV()", "read", 1), site("F:A.v", "M:A.InitV()", "write", 5, lock=True, more=" volatile")
    site("F:A.t", "M:A.T()", "read", 1, thread=True), site("F:A.t", "M:A.T()", "write", 5, thread=True)
    site("F:A.c", None, "read", 1), site("F:A.c", None, "write", 5)
    got = sorted((r.enclosing[4:], r.write_line, r.read_line, r.type, r.confidence) for r in hazards.race_windows(spark.createDataFrame(rows, kind)).collect())
    assert got == [
        ("Go()", 9, 3, "race_window", "high"), ("Held()", 9, 3, "race_window", "medium"), ("Once()", 5, 1, "lazy_init_race", "low"), ("T()", 5, 1, "thread_local_context", "low"),
        ("Twice()", 5, 1, "race_window", "high"), ("Twice()", 6, 1, "race_window", "high"), ("get_X()", 5, 1, "lazy_init_race", "low"), ("get_X()", 7, 1, "lazy_init_race", "low"),
    ]


def test_reach_changes(spark):
    """Overloads are one stem; shapes of records and constructors are told; a side's own entry points are left out."""
    pairs = lambda *rows: spark.createDataFrame(list(rows), "seed string, sym string")
    base = pairs(("e", "M:A.f(int)"), ("e", "M:A.g()"), ("r", "M:A.get_X()"), ("c", "M:A.#ctor()"), ("p", "M:A.k()"), ("only", "M:A.g()"))
    head = pairs(("e", "M:A.f(long)"), ("e", "M:A.g()"), ("r", "M:A.set_X()"), ("c", "M:A.#ctor(int)"), ("p", "M:A.k()"))
    got = {r.seed: (r.added, r.removed, r.changed, r.in_place, r.cause) for r in reports.reach_changes(base, head, spark.createDataFrame([("M:A.k()",)], "symbol_id string")).collect()}
    assert got == {"e": (0, 0, 1, 0, "Other"), "r": (1, 1, 0, 0, "RecordShape"), "c": (0, 0, 1, 0, "CtorSig"), "p": (0, 0, 0, 1, "InPlace")}


def test_handoff_modes(spark):
    edges = spark.createDataFrame([("a", "b", "invocation", None), ("a", "c", "handoff", "exact"), ("a", "d", "handoff", "fanout")], "src string, dst string, kind string, precision string")
    assert [graph.cut_handoffs(edges, m).count() for m in ("SyncCut", "AsyncExact", "AsyncInclude")] == [1, 2, 3]


def test_rules_and_schema(spark):
    assert rules.cascade({"a": [1], "m": {"x": 1}}, {"a": [2], "m": {"x": 2}}) == {"a": [1, 2], "m": {"x": 2}}
    assert rules.problems({"effects": [{"provider": "p"}]}) and not rules.problems(rules.DEFAULT)
    facts.check_schema(spark.createDataFrame([(facts.SCHEMA_VERSION,)], "index_version int"))
    with pytest.raises(facts.SchemaMismatch):
        facts.check_schema(spark.createDataFrame([(1,)], "index_version int"))


def test_guard_changes(spark):
    kind = "src string, dst string, guard string"
    base = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x && y"), ("a", "d", "x"), ("a", "e", "x&&y"), ("a", "f", None), ("a", "g", "x")], kind)
    head = spark.createDataFrame([("a", "b", "y && x"), ("a", "c", "x"), ("a", "d", "z"), ("a", "e", "y  &&  x"), ("a", "f", "q")], kind)
    assert sorted(map(tuple, reports.guard_changes(base, head).collect())) == [("a", "b", "Narrowed"), ("a", "c", "Widened"), ("a", "d", "Changed"), ("a", "f", "Narrowed")]


def test_live_facts(spark, tmp_path):
    """Edits replayed as a stream end where a rebuilt table does: no row of a replaced file stays."""
    base = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "c")], "file_path string, symbol_id string")
    edits = spark.createDataFrame([("f1", "old", 1), ("f1", "new", 2), ("f3", "d", 1)], "file_path string, symbol_id string, generation int")
    edits.coalesce(1).write.parquet(f"{tmp_path}/edits")
    live = overlay.LiveFacts(spark, f"{tmp_path}/live", base)
    live.follow(spark.readStream.schema(edits.schema).parquet(f"{tmp_path}/edits"), f"{tmp_path}/state").awaitTermination(120)
    assert sorted((r.file_path, r.symbol_id) for r in live.snapshot().collect()) == [("f1", "new"), ("f2", "c"), ("f3", "d")]
    resumed = overlay.LiveFacts(spark, f"{tmp_path}/live")
    assert resumed.revision == live.revision and resumed.snapshot().count() == 3
    resumed.apply(edits, 0)
    assert resumed.snapshot().count() == 3
