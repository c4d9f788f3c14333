"""Rules as data: JSON documents, cascaded, and as tables for joins."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A neutral default set over the vocabulary of the adapter's facts.
DEFAULT = {
    "effects": [
        {"provider": "db", "operation": "read", "methods": ["Do1", "Do2", "Do3"], "receivers": ["T:Lib.S1", "T:Lib.S2", "T:Lib.S3", "T:Lib.S4"], "resource": "receiver_type"},
        {"provider": "db", "operation": "write", "methods": ["Do3", "Do4"], "resource": "declaring_type"},
        {"provider": "http", "operation": "call", "methods": ["Do5", "Do6", "Do7"], "resource": "argument_name"},
        {"provider": "queue", "operation": "send", "methods": ["Do8"], "receivers": ["T:Lib.S5"], "resource": "unknown"},
        {"provider": "queue", "operation": "publish", "methods": ["Do8", "Do9"], "resource": "receiver_type"},
        {"provider": "async_block", "operation": "wait", "methods": ["Do10", "Do11"], "resource": "receiver_type"},
        {"provider": "audit", "operation": "log", "methods": ["Do12"], "containing": ["App.N1", "App.N2"], "resource": "type_argument", "type_argument_index": 0},
        {"provider": "audit", "operation": "tag", "methods": ["Do12"], "resource": "type_argument", "type_argument_index": 1},
        {"provider": "file", "operation": "write", "methods": ["Do13"], "resource": "string_argument_or_receiver"},
        {"provider": "http", "operation": "get", "methods": ["Do14"], "resource": "http_argument"},
        {"provider": "file", "operation": "read", "methods": ["Do15"], "resource": "string_argument", "argument_index": 1},
        {"provider": "file", "operation": "open", "methods": ["Do15"], "resource": "string_argument"},
        {"provider": "ef", "operation": "read", "methods": ["Do16"], "resource": "ef_query_root"},
        {"provider": "ef", "operation": "read", "methods": ["Do17"], "resource": "ef_dbset_receiver"},
        {"provider": "ef", "operation": "commit", "methods": ["Do18"], "resource": "ef_context_receiver"},
        {"provider": "ef", "operation": "raw", "methods": ["Do19"], "resource": "ef_database_facade"},
        {"provider": "gate", "operation": "check", "methods": ["Do20"], "resource": "argument_type"},
        {"provider": "rights", "operation": "check", "methods": ["Do21"], "resource": "argument_name", "argument_index": 1},
        {"provider": "cache", "operation": "get", "methods": ["Do22", "Do23"], "declaringTypes": ["App.N1", "App.N2"], "declaringTypeNameEndsWith": ["1", "2", "7"], "resource": "declaring_type"},
        {"provider": "cache", "operation": "set", "methods": ["Do23", "Do24"], "declaringTypes": ["App.N3"], "receivers": ["T:Lib.S6", "T:Lib.S7"], "resource": "receiver_type"},
        {"provider": "proxy", "operation": "call", "methods": ["Do25", "Do26"], "declaringTypeBaseTypes": ["T:App.N1.T1"], "resource": "declaring_type", "minArguments": 2},
        {"provider": "io", "operation": "open", "on": "ctor", "methods": [], "declaringTypes": ["App.N2.T12", "App.N4"], "declaringTypeNameEndsWith": ["T12", "4"], "resource": "declaring_type"},
        {"provider": "error", "operation": "raise", "on": "throw", "methods": [], "declaringTypeBaseTypes": ["T:App.N3.T3"], "resource": "declaring_type"},
    ],
    "observations": {
        "enumerating": [{"methods": ["Select"], "declaringTypes": ["Lib.Seq"]}, {"methods": [], "declaringTypes": ["System.Linq.Enumerable"]}],
        "parallelFanout": [{"receiverType": "Lib.Parallel", "receiver": "Parallel", "methods": ["ForEach", "Invoke"]}],
        "resilienceRetry": [{"wrapperMethods": ["Execute"], "receiverTypePatterns": ["Pipeline", "Policy"]}],
        "concurrencyHandled": [{"commitMethods": ["Do3", "Do4", "Do18"], "catchTypePatterns": ["Concurrency"]}],
        "resourceSpan": [
            {"type": "transaction_spans_effect", "context": "transaction", "scopeKind": "transaction", "scopeTypePatterns": ["TransactionScope"], "excludeProviders": ["db", "ef"]},
            {"type": "lock_held_across_effect", "context": "lock", "scopeKind": "lock", "scopeTypePatterns": [], "excludeProviders": ["async_block"]},
        ],
        "serializationHazard": [{"providers": ["queue", "audit"], "unsupportedTypePatterns": ["Option", "K3"]}],
        "nPlusOne": [{"providers": ["db", "ef"], "operations": ["read"]}, {"providers": ["http"], "operations": []}],
    },
    "dualWrite": {"purchase:write": "db", "click:write": "queue", "signup": "search"},
    "cacheCoherence": [{"writes": ["write", "set"], "companions": ["get"], "depth": 1}],
    "staticInitCapture": ["R1", "R4"],
    "entryPoints": {
        "pages": [{"kind": "page", "method": "PAGE", "baseTypes": ["T:App.N2.T2"], "namespacePrefix": "App.", "requires": ["web"]}],
        "actions": [{"kind": "action", "method": "POST", "baseTypes": ["T:App.N2.T2"], "attributePrefixes": ["M:App.N0", "M:App.N3"], "namespacePrefix": "App.", "requires": ["web", "api"]}],
        "classes": [
            {"kind": "handler", "method": "HANDLE", "baseTypes": ["T:App.I3"], "handlerMethods": ["Do2", "Do9", "Do33"], "requireOverride": False, "attributePrefixes": [], "parameterTypes": ["Int32"], "requires": []},
            {"kind": "job", "method": "RUN", "baseTypes": ["T:App.N1.T1"], "handlerMethods": ["*"], "requireOverride": True, "attributePrefixes": [], "parameterTypes": [], "requires": ["queue"]},
            {"kind": "rpc", "method": "RPC", "baseTypes": ["*"], "handlerMethods": ["*"], "requireOverride": False, "attributePrefixes": ["M:App.N4.T4."], "parameterTypes": [], "requires": ["API"]},
        ],
    },
    "deployments": [{"service": "site", "provides": ["Web"]}, {"service": "gateway", "provides": ["api", "grpc"]}, {"service": "worker", "provides": ["queue"]}],
    "amplification": {
        "scope": [{"providers": ["db", "ef"], "operations": []}, {"providers": ["http"], "operations": ["call"]}],
        "categories": [{"name": "io", "weight": 2, "providers": ["db", "ef", "http"]}, {"name": "contention", "weight": 1, "separate": True, "providers": ["async_block"]}, {"name": "noise", "excluded": True, "providers": ["gate"]}],
    },
    "handoffs": [{"consumer": "M:Lib.Task.Run", "tag": "task_run", "delivery": "high"}, {"consumer": "M:Lib.Bus.Subscribe", "tag": "event_raise", "delivery": "low"}],
    "redirects": [{"from": "App.N1.T1", "to": "App.N2.T2"}],
    "cuts": ["App.N3.T3*"],
    "suffixes": ["Repository", "Service", "Dto", "Info"],
    "emoji": {"db": "D", "http": "H"},
}


def cascade(*documents: dict) -> dict:
    """Later documents add to lists, at any depth, and override single entries of maps."""
    out: dict = {}
    for document in documents:
        for key, value in document.items():
            if isinstance(value, list):
                out[key] = [*out.get(key, []), *value]
            elif isinstance(value, dict):
                out[key] = cascade(out.get(key, {}), value)
            else:
                out[key] = value
    return out


def load(*paths: str, default: dict = DEFAULT) -> dict:
    return cascade(default, *(json.loads(Path(p).read_text()) for p in paths))


def problems(rules: dict) -> list[str]:
    """What is wrong with a rule set; empty if it can be used."""
    found = []
    for k, rule in enumerate(rules.get("effects", [])):
        for key in ("provider", "operation", "resource", *(["methods"] if rule.get("on", "invocation") == "invocation" else [])):
            if not rule.get(key):
                found.append(f"effects[{k}]: {key} is missing")
        if rule.get("on", "invocation") not in ("invocation", "ctor", "throw"):
            found.append(f"effects[{k}]: no such kind of reference: {rule['on']}")
    return found


def fingerprint(rules: dict) -> str:
    return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()


def effect_rules(spark: SparkSession, rules: dict = DEFAULT) -> DataFrame:
    """One row per rule and member name, or one of no name; rule_no orders the rules. A rule set is small by nature: it is typed by hand."""
    rows = [
        (k, r["provider"], r["operation"], r.get("on", "invocation"), m, r.get("receivers", []), r.get("declaringTypes", []), r.get("declaringTypeBaseTypes", []), r.get("declaringTypeNameEndsWith", []),
         r.get("containing", []), r["resource"], r.get("type_argument_index"), r.get("argument_index"), r.get("minArguments"))
        for k, r in enumerate(rules["effects"]) for m in r.get("methods") or [None]
    ]
    return spark.createDataFrame(rows, "rule_no int, provider string, operation string, on string, method string, receivers array<string>, declaring array<string>, bases array<string>, suffixes array<string>, "
                                 "containing array<string>, strategy string, type_argument_index int, argument_index int, least_arguments int")


def handoff_rules(spark: SparkSession, rules: dict = DEFAULT) -> DataFrame:
    return spark.createDataFrame([(r["consumer"], r["tag"], r["delivery"]) for r in rules["handoffs"]], "consumer string, tag string, delivery string")
