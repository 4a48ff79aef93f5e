"""Workload synthesis: random queries from a join graph, from known join combinations or from templates, and column domains.

A query's random choices depend on the seed and its number only, so a pool is the same at any parallelism. Predicates are drawn
from column domains; of columns that the query's joins equate at most one gets a predicate.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import profile
from quarry.operators.workload import TEMPLATES, WORKLOAD, parse
from quarry.session import ship

Domain = tuple[str, float, float, bool, list[str]]  # kind, least, greatest, integral, values
# How often synthesis draws each comparison, each form of a text predicate, and each number of a template's predicates.
OPS, WEIGHTS = ("=", "!=", ">", "<", ">=", "<="), (1, 7, 7, 7, 7, 7)
TEXT_OPS, TEXT_WEIGHTS = ("=", "!=", "LIKE", "IN"), (1, 13, 13, 13)
NUMBERS, NUMBER_WEIGHTS = (2, 3, 4, 5, 6), (1, 3, 3, 2, 1)


@dataclass
class Spec:
    """What queries are made of; plain data, so it travels to every task."""

    tables: dict[str, str]  # alias -> table
    joins: list[tuple[str, str]]  # pairs of alias.column
    combinations: list[list[tuple[str, str]]]
    filters: list[str]  # alias.column
    n_joins: tuple[list[int], list[int]]  # numbers and how often they occur
    n_filters: tuple[list[int], list[int]]
    domains: dict[str, Domain]
    templates: list[tuple[str, list[str], list[tuple[str, str]], list[str]]] = field(default_factory=list)  # select, aliases, joins, filter columns


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def predicate(rng: random.Random, column: str, domain: Domain, wide: bool) -> str | None:
    """A random predicate; None if the domain is empty. wide: also IN and LIKE, all operators alike."""
    kind, lo, hi, integral, values = domain
    if kind == "numeric":
        op = rng.choice(OPS) if wide else rng.choices(OPS, WEIGHTS)[0]
        return f"{column} {op} {rng.randint(int(lo), int(hi)) if integral else round(rng.uniform(lo, hi), 2)}"
    if not values:
        return None
    op = rng.choices(TEXT_OPS, TEXT_WEIGHTS)[0] if wide else rng.choice(("=", "!="))
    if op == "IN" and len(values) > 2:
        return f"{column} IN ({', '.join(quoted(v) for v in rng.sample(values, rng.randint(2, min(7, len(values) - 1))))})"
    if op == "LIKE":
        return f"{column} LIKE {quoted('%' + rng.choice(values)[:2] + '%')}"
    return f"{column} {'!=' if op == '!=' else '='} {quoted(rng.choice(values))}"


def classes(joins: list[tuple[str, str]]) -> dict[str, str]:
    """Least column of each class of columns that the joins equate."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in joins:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {c: find(c) for c in parent}


def shared(rng: random.Random, spec: Spec, aliases: list[str], joins: list[tuple[str, str]], n: int) -> tuple[list[str], set[str]]:
    """Up to n predicates, all of a table's aliases on one filter column of it, for the tables that have several; and the classes they are on."""
    same, used, out = classes(joins), set(), []
    for name in sorted({spec.tables[a] for a in aliases}):
        own = [a for a in aliases if spec.tables[a] == name]
        known = sorted({c.split(".")[1] for c in spec.filters if spec.tables[c.split(".")[0]] == name})
        domain = {x: d for x in known for a in spec.tables if spec.tables[a] == name and (d := spec.domains.get(f"{a}.{x}"))}
        if len(own) < 2 or not domain:
            continue
        column = rng.choice(sorted(domain))
        for a in own:
            key = same.get(f"{a}.{column}", f"{a}.{column}")
            if len(out) < n and key not in used and (p := predicate(rng, f"{a}.{column}", domain[column], True)):
                used.add(key)
                out.append(p)
    return out, used


def filters(
    rng: random.Random, spec: Spec, aliases: list[str], joins: list[tuple[str, str]], n: int, wide: bool, columns: list[str] | None = None, taken: set[str] = frozenset()
) -> list[str]:
    """Up to n predicates on different classes of the aliases' filter columns, none of them in `taken`."""
    same, used, out = classes(joins), set(taken), []
    free = [c for c in (columns or spec.filters) if c.split(".")[0] in aliases and c in spec.domains]
    rng.shuffle(free)
    for c in free:
        key = same.get(c, c)
        if len(out) < n and key not in used and (p := predicate(rng, c, spec.domains[c], wide)):
            used.add(key)
            out.append(p)
    return out


def connected(rng: random.Random, spec: Spec, n_joins: int) -> tuple[list[str], list[tuple[str, str]]]:
    """Aliases reached breadth first from a random one over the join graph, and one join for each after the first."""
    aliases, joins = [rng.choice(sorted({c.split(".")[0] for j in spec.joins for c in j}))], []
    front = list(aliases)
    while front and len(aliases) <= n_joins:
        here = front.pop(0)
        near = [(a, b) for a, b in spec.joins if here in (a.split(".")[0], b.split(".")[0])]
        rng.shuffle(near)
        for a, b in near:
            other = (b if a.split(".")[0] == here else a).split(".")[0]
            if other not in aliases and len(aliases) <= n_joins:
                aliases.append(other)
                front.append(other)
                joins.append((a, b))
    return aliases, joins


def query(spec: Spec, kind: str, number: int, seed: int) -> str:
    """One query. kind: graph, combination or template."""
    rng = random.Random(f"{kind}:{seed}:{number}")
    select = "COUNT(*)"
    if kind == "graph":
        aliases, joins = connected(rng, spec, rng.choices(*spec.n_joins)[0])
        found = filters(rng, spec, aliases, joins, int(0.5 * rng.choices(*spec.n_filters)[0]) + 1, False)
    elif kind == "combination":
        joins = rng.choice(spec.combinations)
        aliases = sorted({c.split(".")[0] for j in joins for c in j}) or [rng.choice(sorted(spec.tables))]
        found = filters(rng, spec, aliases, joins, rng.choices(*spec.n_filters)[0], False)
    else:
        select, aliases, joins, columns = rng.choice(spec.templates)
        n = rng.choices(NUMBERS, NUMBER_WEIGHTS)[0]
        found, used = shared(rng, spec, aliases, joins, n)
        found += filters(rng, spec, aliases, joins, n - len(found), True, columns + [c for c in spec.filters if c not in columns], used)
    where = [f"{a} = {b}" for a, b in joins] + found
    return f"SELECT {select} FROM {', '.join(f'{spec.tables[a]} AS {a}' for a in aliases)}" + (f" WHERE {' AND '.join(where)}" if where else "")


def pool(spark: SparkSession, spec: Spec, kind: str, n: int, seed: int = 0) -> DataFrame:
    """(query_id, sql) of n queries."""
    ship(spark)
    shared = spark.sparkContext.broadcast(spec)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"query_id": pdf["id"], "sql": [query(shared.value, kind, int(i), seed) for i in pdf["id"]]})

    return spark.range(n).mapInPandas(batches, "query_id long, sql string")


def _side(text: str) -> tuple[str, str]:
    a, b = text.split(" = ")
    return a, b


def _histogram(numbers: list[int]) -> tuple[list[int], list[int]]:
    return sorted(set(numbers)), [numbers.count(n) for n in sorted(set(numbers))]


def specification(spark: SparkSession, sf_dir: str, queries: tuple[str, ...] = WORKLOAD) -> Spec:
    """The parts of a workload with the domains of the driver's tables: a few hundred values a column, on the driver."""
    found = [p for q in queries if (p := parse(spark, q))]
    tables = {alias: name for p in found for name, alias in p.tables}
    by_table: dict[tuple[str, str], Domain] = {}
    names = set(tables.values())
    for r in profile.domain_numeric(spark, sf_dir, names).collect():
        by_table[r["table"], r["column"]] = ("numeric", r["min_num"], r["max_num"], r["is_integral"], [])
    for r in profile.domain_top_freq(spark, sf_dir, names).groupBy("table", "column").agg(F.array_sort(F.collect_list("value")).alias("v")).collect():
        by_table[r["table"], r["column"]] = ("string", 0.0, 0.0, False, r["v"])
    columns = sorted(set().union(*(p.filter_columns for p in found)))
    domains = {c: d for c in columns if (d := by_table.get((tables[c.split(".")[0]], c.split(".")[1])))}
    joins = sorted({tuple(sorted(_side(j))) for p in found for j in p.joins})
    templates = []
    for t in TEMPLATES:
        p = parse(spark, queries[t])
        templates.append((p.select[0].replace("count(1)", "COUNT(*)"), [a for _, a in p.tables], [_side(j) for j in p.joins], sorted(p.filter_columns)))
    return Spec(tables, joins, sorted([_side(j) for j in p.joins] for p in found if p.joins), columns, _histogram([len(p.joins) for p in found]), _histogram([len(p.filter_columns) for p in found]), domains, templates)


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = specification(spark, sf_dir)
    parts = [pool(spark, spec, kind, 40).select(F.lit(kind).alias("kind"), "query_id", "sql") for kind in ("graph", "combination", "template")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {"synth_queries": _pools}
ORACLE_SQL: dict[str, str] = {}
