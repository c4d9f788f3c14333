"""Stores as they are published and chosen, and the questions of the engine over them."""

import pytest
from pyspark.sql import functions as F

from factlattice.plans import registry
from factlattice.plans.engine import Engine
from factlattice.sources import facts, rules, store


@pytest.fixture(scope="module")
def loaded(spark, small):
    return facts.load(spark, small)


@pytest.fixture(scope="module")
def engine(loaded):
    return Engine(loaded)


def test_stores(spark, loaded, tmp_path):
    """A store is read as it was written, by LATEST, id or beginning; another schema isn't read; results are kept."""
    stores = store.Stores(spark, f"file://{tmp_path}/stores")
    with pytest.raises(store.NoStore):
        stores.choose()
    few = facts.Facts(**{n: getattr(loaded, n).limit(20) for n in facts.Facts.__dataclass_fields__})
    stores.publish("abc1", few, "2024-01-01", derived={"call_edges": spark.createDataFrame([("a", "b")], "src string, dst string")})
    stores.publish("abd2", few, "2024-01-02")
    assert stores.names() == ["abc1", "abd2"] and [r.store_id for r in stores.runs().collect()] == ["abd2", "abc1"]
    assert stores.choose() == "abd2" and stores.choose("abc") == "abc1" and stores.table("call_edges", "abc1").count() == 1
    for wrong in ("ab", "x"):
        with pytest.raises(store.NoStore):
            stores.choose(wrong)
    with pytest.raises(store.NoStore):
        stores.publish("abc1", few, "2024-01-03")
    made = []

    def counted(f):
        made.append(1)
        return f.methods.agg(F.count(F.lit(1)).alias("n"))

    assert [stores.kept("abc1", "n", counted).first()["n"] for _ in range(2)] == [20, 20] and len(made) == 1
    stores.kept("abc1", "n", counted, rules.cascade(rules.DEFAULT, {"cuts": ["X"]}))
    assert len(made) == 2
    stores.merge("abc1", few)
    assert stores.kept("abc1", "n", counted).first()["n"] == 40 and len(made) == 3
    spark.createDataFrame([("abd2", 1)], "store_id string, index_version int").write.mode("overwrite").parquet(f"file://{tmp_path}/stores/abd2/meta")
    with pytest.raises(facts.SchemaMismatch):
        stores.read("abd2")


def test_rendered(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int").coalesce(1)
    store.rendered(rows, f"file://{tmp_path}/t")
    store.rendered(rows, f"file://{tmp_path}/j", "json")
    text = lambda d: "".join(p.read_text() for p in (tmp_path / d).glob("part-*"))
    assert text("t") == "x\ty\na\t1\nb\t\n" and text("j") == '{"x":"a","y":1}\n{"x":"b","y":null}\n'
    with pytest.raises(ValueError):
        store.rendered(rows, f"file://{tmp_path}/z", "xml")


def test_traversals(spark, loaded, engine):
    """Forward and backward closures agree, paths are as long as the depth, and what is called by none is a root."""
    start = loaded.methods.where("part_key = 1").first()["symbol_id"]
    ahead = {r.sym: r.depth for r in engine.reaches(start, 3).collect()}
    assert ahead[start] == 0 and len(ahead) > 3
    goal = min((s for s, d in ahead.items() if d == 2), default=None)
    assert goal and len(engine.path(start, goal, 3)) == 3
    back = {r.sym for r in engine.callers(goal, 3).collect()}
    assert start in back and {r.sym for r in engine.callers(goal, 3, "roots").collect()} <= back
    assert engine.tree(start, 2)[0][2] == start
    with pytest.raises(LookupError):
        engine.path("App.N", goal)
    with pytest.raises(ValueError):
        Engine(loaded, {"effects": [{"provider": "p"}]})


def test_derivations(spark, small, loaded, engine):
    """The engine's effects are the registry's; a store beside itself has no impact; listings hold what they should."""
    want = registry.QUERIES["effect_summary"](spark, small).collect()
    hidden = sum(r["n"] for r in want if r["provider"] in ("alloc", "throw"))
    assert engine.effects().count() == sum(r["n"] for r in want) - hidden
    assert engine.impact(Engine(loaded), 1).count() == 0
    assert [r["rank"] for r in engine.hotspots("dispatch", 5).collect()] == sorted((r["rank"] for r in engine.hotspots("dispatch", 5).collect()), reverse=True)
    assert {r.bucket for r in engine.amplify(1, 5).collect()} <= {"main", "separate", "recursion"}
    assert engine.derive(["App"]).count() == 0 and engine.derive().count() > 0
    assert engine.show("App.N1").count() == engine.choices("App.N1").count() > 1
    assert ("db", "read") in engine.providers() and engine.di().count() > 0 and engine.files().count() > 0
