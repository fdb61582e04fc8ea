"""Framework, runtime and data-access topology of source texts: routes, API calls, events, reads and writes.

One pass per text finds the calls by pattern; constants and template strings are followed within a file as far as
they are simple. Linking calls to routes is a join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import next_route
from orrery.operators.relations import match_routes
from orrery.sources.extract import _over

FACTS = "project_id string, path string, fact string, method string, target string, line int"

_CONST = re.compile(r"\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*(?:\"([^\"\n]*)\"|'([^'\n]*)'|`([^`]*)`)")
_ROUTE = re.compile(r"\b(?:app|router|server|fastify|api)\.(get|post|put|patch|delete|all|use)\s*\(\s*(\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|[A-Za-z_$][\w$]*)")
_CLIENT = re.compile(r"\b(?:(fetch)|axios(?:\.(get|post|put|patch|delete))?|(?:api|\w+Api)\.(get|post|put|patch|delete))\s*\(\s*(\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|[A-Za-z_$][\w$]*)")
_EVENT = re.compile(r"\.(?:on|once|addEventListener|subscribe)\s*\(\s*[\"']([\w:.\-]+)[\"']")
_DATA = re.compile(r"\b(?:db|prisma|client|database)\.([A-Za-z_]\w*)\.(\w+)\s*\(")
_DRIZZLE = re.compile(r"\b(?:db|tx)\.(?:(select|insert|update|delete)\s*\([^)]*\))(?:\s*\.from\s*\(\s*(\w+))?|\b(?:db|tx)\.(insert|update|delete)\s*\(\s*(\w+)")
_READS = re.compile(r"^(find|get|select|count|aggregate|query|list|first|exists|groupBy)")
_WRITES = re.compile(r"^(create|update|upsert|delete|insert|save|remove|set)")


def facts_of(text: str, language: str) -> list[tuple[str, str, str, int]]:
    """(fact, method, target, line): route, api_call, handles_event, reads_from and writes_to of a script text."""
    if language not in ("typescript", "javascript"):
        return []
    constants: dict[str, str | None] = {}
    for m in _CONST.finditer(text):
        value = next(g for g in m.groups()[1:] if g is not None)
        constants[m[1]] = None if m[1] in constants and constants[m[1]] != value else value  # two values: none is known

    def resolve(arg: str) -> str | None:
        if arg[0] in "\"'":
            return arg[1:-1]
        if arg[0] == "`":
            parts = re.split(r"\$\{([^}]*)\}", arg[1:-1])
            for i in range(1, len(parts), 2):
                known = constants.get(parts[i].strip())
                parts[i] = known if known is not None else ":param" if i > 1 or parts[0].startswith("/") else ""
            return "".join(parts)
        return constants.get(arg)

    line = lambda at: text.count("\n", 0, at) + 1
    out = []
    for m in _ROUTE.finditer(text):
        to = resolve(m[2])
        if to and to.startswith("/"):
            out.append(("uses_middleware" if m[1] == "use" else "route", m[1], to, line(m.start())))
    for m in _CLIENT.finditer(text):
        to = resolve(m[4])
        if to and to.startswith("/"):
            out.append(("api_call", next((g for g in m.groups()[:3] if g), "get"), to.split("?")[0], line(m.start())))
    for m in _EVENT.finditer(text):
        out.append(("handles_event", "on", m[1], line(m.start())))
    for m in _DATA.finditer(text):
        if _READS.match(m[2]) or _WRITES.match(m[2]):
            out.append(("reads_from" if _READS.match(m[2]) else "writes_to", m[2], m[1], line(m.start())))
    for m in _DRIZZLE.finditer(text):
        verb, to = (m[1], m[2]) if m[1] else (m[3], m[4])
        if to:
            out.append(("reads_from" if verb == "select" else "writes_to", verb, to, line(m.start())))
    return sorted(set(out), key=lambda r: (r[3], r[0], r[2]))


def topology_facts(texts: DataFrame) -> DataFrame:
    return _over(texts, facts_of, FACTS)


def routes(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(project_id, path, route): declared routes and those that files serve by their place; webhooks are told by their path."""
    placed = texts.select("project_id", "path", next_route(F.col("path")).alias("route")).where("route IS NOT NULL")
    declared = facts.where("fact = 'route'").select("project_id", "path", F.col("target").alias("route"))
    return declared.union(placed).distinct().withColumn("webhook", F.lower("route").contains("webhook"))


def link_calls(facts: DataFrame, found: DataFrame) -> DataFrame:
    """(project_id, path, line, request, route, route_file): API calls and the routes of their project that answer them; templates that stay open link to nothing else."""
    calls = facts.where("fact = 'api_call'").select("project_id", "path", "line", F.col("target").alias("request"))
    scoped = lambda c: F.concat(F.lit("/"), "project_id", c)
    m = match_routes(calls.select(scoped(F.col("request")).alias("request")), found.select(scoped(F.col("route")).alias("route")))
    r = found.groupBy("project_id", "route").agg(F.min("path").alias("route_file"))
    j = calls.withColumn("_k", scoped(F.col("request"))).join(m.select(F.col("request").alias("_k"), F.col("route").alias("_r")), "_k")
    return j.withColumn("route", F.expr("substring(_r, length(project_id) + 2)")).join(r, ["project_id", "route"]).select("project_id", "path", "line", "request", "route", "route_file")
