"""Effects: facts joined with rules, and what is observed about each effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import docid
from ..sources import rules as rulebook

INTRINSIC = ("alloc", "throw")


def _first(*values):
    """The first value that isn't blank."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def resource(rule) -> F:
    """A rule's resource of an invocation; null, and so no effect, where the strategy is unknown or finds nothing."""
    receiver, generic, template = F.col("receiver_type"), F.col("type_arguments"), F.col("first_template")
    declaring = F.col("_declaring")
    name = docid.listed(F.col("argument_names"), rule["argument_index"])
    text = F.when(rule["argument_index"].isNull(), template).otherwise(docid.listed(F.col("argument_templates"), rule["argument_index"]))
    by_strategy = {
        "receiver_type": receiver,
        "declaring_type": declaring,
        "type_argument": F.when(rule["type_argument_index"].isNull(), generic).otherwise(docid.part(generic, rule["type_argument_index"])),
        # A name that is marked as the surface of a composite expression identifies nothing.
        "argument_name": F.when(rule["argument_index"].isNull(), F.col("argument")).when(~F.startswith(name, F.lit("~")), name),
        "argument_type": F.col("first_type"),
        "string_argument": text,
        "string_argument_or_receiver": _first(text, receiver, declaring),
        "http_argument": F.when(template.isNotNull(), docid.http_resource(template)).otherwise(F.coalesce(receiver, declaring)),
        "ef_query_root": _first(generic, receiver, declaring),
        "ef_context_receiver": _first(receiver, declaring),
        "ef_dbset_receiver": _first(receiver, generic, declaring),
        "ef_database_facade": _first(receiver, declaring),
    }
    out = F.lit(None).cast("string")
    for named, value in by_strategy.items():
        out = F.when(rule["strategy"] == named, value).otherwise(out)
    return out


def executed(refs: DataFrame) -> DataFrame:
    """Invocations with a caller that run as code: what is quoted in an expression tree is translated, not called."""
    return refs.where((F.col("ref_kind") == "invocation") & F.col("enclosing").isNotNull() & ~F.col("in_expression_tree"))


def _gated(rule):
    """Whether the rule's type gates admit a row's declaring or receiver type.

    A base gate decides alone: the declaring type is one of the bases or below one. Else a declaring gate that names the
    type, or a namespace of it, decides; else a receiver gate, by the receiver or the declaring type. The declaring type's
    simple name has to end as the rule wants, unless only a receiver gate let it in.
    """
    declaring, receiver = F.col("_declaring"), docid.bare(F.col("receiver_type"))
    suffix = (F.size(rule["suffixes"]) == 0) | F.exists(rule["suffixes"], lambda x: F.endswith(F.substring_index(declaring, ".", -1), x))
    named = F.exists(rule["declaring"], lambda gate: docid.within(declaring, gate))
    received = F.exists(rule["receivers"], lambda gate: docid.within(declaring, docid.bare(gate)) | F.coalesce(docid.within(receiver, docid.bare(gate)), F.lit(False)))
    free = (F.size(rule["declaring"]) == 0) & (F.size(rule["receivers"]) == 0)
    based = F.coalesce(F.arrays_overlap(rule["bases"], F.col("_above")), F.lit(False))
    return F.when(F.size(rule["bases"]) > 0, based & suffix).when(free, suffix).when(named, suffix).otherwise(received)


def _candidates(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with ``_rules``: the rules for a reference's kind that name its member or none, in order; those without any go."""
    rule = F.struct("rule_no", *(c for c in rules.columns if c not in ("rule_no", "on", "method"))).alias("rule")
    listed = lambda df, *by: F.broadcast(df.groupBy(*by).agg(F.array_sort(F.collect_list("rule")).alias(f"_{len(by)}")))
    free = rules.where("method is null").select(F.col("on").alias("_on"), rule)
    named = rules.where("method is not null")
    either = named.select("on", "method").distinct().join(free, F.col("on") == F.col("_on")).select("on", "method", "rule")
    named = named.select("on", "method", rule).unionByName(either)
    rows = rows.join(listed(named, "on", "method"), (F.col("target_name") == F.col("method")) & (F.col("ref_kind") == F.col("on")), "left").drop("on", "method")
    rows = rows.join(listed(free, "_on"), F.col("ref_kind") == F.col("_on"), "left").drop("_on")
    return rows.withColumn("_rules", F.coalesce("_2", "_1")).drop("_1", "_2").where("_rules is not null")


def by_rule(refs: DataFrame, rules: DataFrame, ancestors: DataFrame | None = None, provider: str | None = None) -> DataFrame:
    """One effect per reference, an invocation, construction or throw: of the first rule that matches and whose resource
    can be told.

    Rules are broadcast: there are as many as people have typed. A reference is met with all its rules at once, so that the
    first is chosen where it stands, and none moves. ancestors (type_id, ancestor) serve rules with base gates. A
    reference is known by its ref_id, or, where facts have none, by all its columns. With a provider only its effects are
    returned, and only references that a rule of it may match are looked at, with all their rules.
    """
    runs = (F.col("ref_kind") == "invocation") & ~F.col("in_expression_tree") | F.col("ref_kind").isin("ctor", "throw")
    kinds = refs.where(F.col("ref_kind").isin("invocation", "ctor", "throw"))
    once = "ref_id" not in refs.columns or kinds.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    wanted = lambda df: df if provider is None else df.where(F.col("provider") == provider)
    rows = _candidates(kinds.where(F.col("enclosing").isNotNull() & runs), rules)
    if provider is not None and once:
        rows = rows.where(F.exists("_rules", lambda rule: rule["provider"] == provider))
    rows = rows.withColumn("_declaring", docid.declaring_type(F.col("target")))
    if ancestors is None:
        rows = rows.withColumn("_above", F.lit(None).cast("array<string>"))
    else:
        bases = F.broadcast(rules.select(F.explode("bases").alias("ancestor")).distinct())
        above = ancestors.join(bases, "ancestor", "left_semi").groupBy(F.col("type_id").alias("_type")).agg(F.collect_set("ancestor").alias("_above"))
        rows = rows.join(above, F.concat(F.lit("T:"), "_declaring") == F.col("_type"), "left").drop("_type")
    caller = docid.bare(F.col("enclosing"))
    given = F.size(F.from_json("argument_names", "array<string>"))

    def outcome(rule):
        within = (F.size(rule["containing"]) == 0) | F.exists(rule["containing"], lambda gate: docid.within(caller, gate))
        enough = rule["least_arguments"].isNull() | (F.coalesce(F.when(given >= 0, given), F.lit(0)) >= rule["least_arguments"])
        found = F.when(within & enough & _gated(rule), resource(rule))
        return F.struct(*(rule[c].alias(c) for c in ("rule_no", "provider", "operation")), found.alias("resource"))

    # As a generator's input the outcomes are made once; a filter on them would make them again.
    hits = F.filter(F.transform("_rules", outcome), lambda x: x["resource"].isNotNull())
    found = rows.select(*refs.columns, F.inline(F.slice(hits, 1, 1)))
    if "ref_id" not in refs.columns:
        return wanted(found).distinct()
    if once:
        return wanted(found)
    first = W.partitionBy("ref_id").orderBy("rule_no")
    return wanted(found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))


def by_wrapper(refs: DataFrame, wrapped: list[str], provider: str, operation: str) -> DataFrame:
    """Methods that call one of the named are wrappers; the effect is at their call sites."""
    calls = executed(refs)
    wrappers = calls.where(F.col("target_name").isin(*wrapped)).select(F.col("enclosing").alias("target")).distinct()
    rows = calls.join(wrappers, "target", "left_semi")
    return rows.select(F.lit(provider).alias("provider"), F.lit(operation).alias("operation"), docid.simple_name(F.col("target")).alias("resource"), "enclosing", "file_path", "line").distinct()


def by_kind(refs: DataFrame, kind: str, provider: str) -> DataFrame:
    """Constructor, throw and allocation effects: the target's type is the resource."""
    rows = refs.where((F.col("ref_kind") == kind) & F.col("enclosing").isNotNull())
    return rows.select(F.lit(provider).alias("provider"), F.lit(kind).alias("operation"), docid.declaring_type(F.col("target")).alias("resource"), "enclosing", "file_path", "line").distinct()


def by_field(access: DataFrame) -> DataFrame:
    """Static field effects; reads of a cell that nobody writes are none."""
    rows = access.where(F.array_contains(F.split("modifiers", " "), "static"))
    written = rows.where("access = 'write'").select("cell").distinct()
    rows = rows.join(written, "cell", "left_semi")
    return rows.select(F.lit("state").alias("provider"), F.col("access").alias("operation"), F.col("cell").alias("resource"), "enclosing", "file_path", "line").distinct()


def summary(effects: DataFrame) -> DataFrame:
    return effects.groupBy("provider", "operation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provider", "operation")


def selected(effects: DataFrame, only: list[str] = (), exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Effects by provider or provider:operation, without regard to case; intrinsic ones only if named. And the hidden count."""
    name, full = F.lower("provider"), F.lower(F.concat("provider", F.lit(":"), "operation"))
    some = lambda xs: name.isin(*map(str.lower, xs)) | full.isin(*map(str.lower, xs)) if xs else F.lit(False)
    keep = (some(only) if only else F.lit(True)) & ~some(exclude)
    hidden = keep & F.col("provider").isin(*INTRINSIC) & ~some(only)
    return effects.where(keep & ~hidden), effects.agg(F.count_if(hidden).alias("hidden"))


def by_allocation(allocations: DataFrame) -> DataFrame:
    """The compiler's allocation facts as effects; a delegate that is cached at its first use isn't looped."""
    looped = F.col("cardinality") != "cached_first_use"
    return allocations.select(
        F.lit("alloc").alias("provider"), "operation", "resource", "enclosing", "file_path", "line", "cardinality", "shallow_size",
        F.when(looped, F.col("loop_kind")).alias("loop_kind"), F.when(looped, F.col("loop_detail")).alias("loop_detail"),
    )


OUTER = ["type", "method", "lambda"]
SCOPE = ["kind", "type"]


def _among(value, names):
    return value.isin(*names) if names else F.lit(True)


def _pattern(value, patterns):
    """The first of the patterns that a text holds."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.contains(value, F.lit(p)), p).otherwise(out)
    return out


def _names(text):
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def iterated(rows: DataFrame, rules: dict = rulebook.DEFAULT) -> DataFrame:
    """rows with ``iteration``: kind, detail, names and source of the loop or enumerating lambda around a site; null without one.

    A query over something that isn't enumerated (its bind method's type is not in the rules) binds once: no loop. A loop
    statement names the iteration; the names that a lambda binds join those of the loop.
    """
    known = rules["observations"]["enumerating"]
    types = [t for r in known for t in r["declaringTypes"]]
    every = any(not r["declaringTypes"] for r in known)
    single = F.lit(False) if every else (F.col("loop_kind") == "query") & (F.coalesce("loop_bind_type", F.lit("")) != "") & ~_among(F.col("loop_bind_type"), types or [""])
    rows = rows.withColumn("_outer", docid.packed(F.coalesce("outer_calls", F.lit("")), OUTER))
    rows = rows.withColumn("_loop", F.when(~F.coalesce(single, F.lit(False)), F.col("loop_kind"))).withColumn("_detail", F.when(F.col("_loop").isNotNull(), F.col("loop_detail")))

    def enumerates(o):
        hit = F.lit(False)
        for r in known:
            hit = hit | (_among(o["method"], r["methods"]) & _among(o["type"], r["declaringTypes"]))
        return (F.coalesce(o["lambda"], F.lit("")) != "") & hit

    rows = rows.withColumn("_lambda", F.get(F.filter("_outer", enumerates), F.lit(0)))
    own, given = F.col("_lambda")["lambda"], F.instr(F.col("_detail"), " in ")
    names = F.array_distinct(F.concat(
        F.when(F.col("_loop").isin("foreach", "query") & (given > 1), _names(F.substring(F.col("_detail"), F.lit(1), given - 1))).otherwise(F.expr("cast(array() as array<string>)")),
        F.coalesce(_names(own), F.expr("cast(array() as array<string>)")),
    ))
    detail = F.coalesce("_detail", F.concat(own, F.lit(" in "), F.col("_lambda")["method"]))
    kind = F.coalesce("_loop", F.when(F.col("_lambda").isNotNull(), "lambda"))
    rows = rows.withColumn("iteration", F.when(kind.isNotNull(), F.struct(
        kind.alias("kind"), F.coalesce(detail, kind).alias("detail"), names.alias("names"),
        F.when(F.instr(detail, " in ") > 0, F.trim(F.substring_index(detail, " in ", -1))).otherwise("").alias("source"))))
    return rows.drop("_loop", "_detail", "_lambda").withColumnRenamed("_outer", "outer")


def observations(effects: DataFrame, rules: dict = rulebook.DEFAULT) -> DataFrame:
    """One row per effect and observation: type, context and detail, by the rules and the effect's structural columns."""
    given = rules["observations"]
    rows = iterated(effects, rules).withColumn("scope_list", docid.packed(F.coalesce("scopes", F.lit("")), SCOPE))
    provider, operation, it = F.col("provider"), F.col("operation"), F.col("iteration")

    def seen(test, type_, context, detail):
        return F.when(test, F.struct(F.lit(type_).alias("type"), context.cast("string").alias("context"), detail.cast("string").alias("detail")))

    def first(of):
        return F.coalesce(*of) if of else F.lit(None)

    # Innermost first: the call that matches any rule, named by its first rule.
    def fan(o):
        return first([F.when((o["type"] == r["receiverType"]) & _among(o["method"], r["methods"]), F.concat(F.lit(r["receiver"] + "."), o["method"])) for r in given["parallelFanout"]])

    fanned = F.get(F.filter(F.transform("outer", fan), lambda x: x.isNotNull()), F.lit(0))
    found = [seen(it.isNotNull(), "looped_effect", it["kind"], it["detail"]), seen(fanned.isNotNull(), "parallel_fanout", fanned, fanned)]
    def wraps(r):
        return lambda o: _among(o["method"], r["wrapperMethods"]) & _pattern(o["type"], r["receiverTypePatterns"]).isNotNull()

    def holds(r):
        return lambda s: (s["kind"] == r["scopeKind"]) & (_pattern(s["type"], r["scopeTypePatterns"]).isNotNull() if r["scopeTypePatterns"] else F.lit(True))

    retries = []
    for r in given["resilienceRetry"]:
        call = F.get(F.filter("outer", wraps(r)), F.lit(0))
        retries.append(seen(call.isNotNull(), "resilience_retry", _pattern(call["type"], r["receiverTypePatterns"]), call["type"]))
    caught = []
    for r in given["concurrencyHandled"]:
        pattern = _pattern(F.col("catch_type"), r["catchTypePatterns"])
        caught.append(seen(F.col("target_name").isin(*r["commitMethods"]) & pattern.isNotNull(), "concurrency_handled", pattern, F.col("catch_type")))
    for r in given["resourceSpan"]:
        scope = F.get(F.filter("scope_list", holds(r)), F.lit(0))
        found.append(seen(scope.isNotNull() & ~provider.isin(*(r["excludeProviders"] or [""])), r["type"], F.lit(r["context"]), F.when(scope["type"] == "", r["context"]).otherwise(scope["type"])))
    for r in given["serializationHazard"]:
        pattern = _pattern(F.col("type_arguments"), r["unsupportedTypePatterns"])
        found.append(seen(_among(provider, r["providers"]) & pattern.isNotNull(), "unserializable_payload", pattern, F.col("type_arguments")))
    surfaces = [F.col(c) for c in ("argument", "first_template", "argument_names", "argument_templates")]
    varying = F.get(F.filter(it["names"], lambda n: F.greatest(*(docid.whole_word(c, n) for c in surfaces))), F.lit(0))
    keyed = [seen(_among(provider, r["providers"]) & _among(operation, r["operations"]) & varying.isNotNull(), "n_plus_1", varying, it["detail"]) for r in given["nPlusOne"]]
    found += [first(part) for part in (retries, caught, keyed) if part]
    rows = rows.withColumn("o", F.explode(F.filter(F.array(*found), lambda o: o.isNotNull())))
    return rows.select("provider", "operation", "resource", "enclosing", "file_path", "line", F.col("o.type").alias("type"), F.col("o.context").alias("context"), F.col("o.detail").alias("detail"))


def iteration_fanout(refs: DataFrame, rules: dict = rulebook.DEFAULT) -> DataFrame:
    """Call sites in an iteration as events: the anchor is the site, the enclosing symbol the callee."""
    rows = iterated(executed(refs).where("target_in_source"), rules).where("iteration is not null")
    return rows.select(F.col("enclosing").alias("caller"), "file_path", "line", F.col("target").alias("enclosing"), F.col("iteration.kind").alias("kind"), F.col("iteration.source").alias("source")).distinct()
