"""Workload analysis: what the queries of a workload select, join and filter.

Query texts are parsed by Spark's own parser on the driver (a workload is thousands of texts, not data); the parsed parts are
a DataFrame and everything after is DataFrame work. A conjunct is a join if it equates columns of two different sides, by
alias or by table; anything else, OR and NOT groups included, is a filter kept whole. Texts that do not parse are reported
with a null list of tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import sided

#: A workload over the driver's tables: two to five relations, aliases, self joins, every predicate form.
WORKLOAD: tuple[str, ...] = (
    "SELECT COUNT(*) FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 100",
    "SELECT COUNT(*) FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 5000",
    "SELECT COUNT(*) FROM customer AS c, orders AS o WHERE o.o_custkey = c.c_custkey AND c.c_acctbal < 5000",
    "SELECT COUNT(*) FROM orders AS o, lineitem AS l WHERE o.o_orderkey = l.l_orderkey AND l.l_quantity > 10 AND o.o_orderstatus = 'F'",
    "SELECT COUNT(*) FROM orders AS o, lineitem AS l WHERE o.o_orderkey = l.l_orderkey AND l.l_quantity <= 30",
    "SELECT COUNT(*) FROM nation AS n, customer AS c, orders AS o WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey = o.o_custkey AND n.n_name = 'FRANCE'",
    "SELECT COUNT(*) FROM nation AS n, customer AS c, orders AS o WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey = o.o_custkey AND n.n_name != 'FRANCE' AND o.o_totalprice > 1000",
    "SELECT COUNT(*) FROM part AS p, lineitem AS l WHERE l.l_partkey = p.p_partkey AND p.p_size BETWEEN 5 AND 15",
    "SELECT COUNT(*) FROM part AS p, lineitem AS l WHERE l.l_partkey = p.p_partkey AND p.p_brand IN ('Brand#12', 'Brand#23')",
    "SELECT COUNT(*) FROM part AS p, lineitem AS l WHERE l.l_partkey = p.p_partkey AND p.p_type LIKE '%ST%' AND p.p_size > 3",
    "SELECT COUNT(*) FROM supplier AS s, lineitem AS l, nation AS n WHERE l.l_suppkey = s.s_suppkey AND s.s_nationkey = n.n_nationkey AND s.s_acctbal >= 0",
    "SELECT COUNT(*) FROM nation AS n1, nation AS n2, customer AS c, supplier AS s WHERE c.c_nationkey = n1.n_nationkey AND s.s_nationkey = n2.n_nationkey AND n1.n_regionkey = n2.n_regionkey AND n1.n_name = 'GERMANY'",
    "SELECT COUNT(*) FROM customer AS c, supplier AS s, orders AS o, lineitem AS l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey",
    "SELECT COUNT(*) FROM region AS r, nation AS n WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'EUROPE'",
    "SELECT MIN(o.o_totalprice) FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'",
    "SELECT MIN(o.o_totalprice) FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY' AND o.o_orderstatus = 'O'",
    "SELECT COUNT(*) FROM orders AS o WHERE o.o_orderpriority IS NOT NULL AND o.o_totalprice >= 20000",
    "SELECT COUNT(*) FROM lineitem AS l WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F'",
    "SELECT COUNT(*) FROM region AS r, nation AS n, customer AS c, orders AS o, lineitem AS l WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND r.r_name = 'ASIA' AND l.l_discount > 0",
    "SELECT COUNT(*) FROM nation AS n, customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = n.n_nationkey AND n.n_name = 'BRAZIL'",
)
#: Queries of WORKLOAD that serve as templates, by position.
TEMPLATES = (0, 3, 5, 7, 10, 14)


@dataclass
class Parsed:
    """Parts of one query, as text."""

    tables: list[tuple[str, str]] = field(default_factory=list)  # (table, alias)
    select: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    filter_columns: set[str] = field(default_factory=set)


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _columns(expr) -> set[str]:
    if _name(expr) == "UnresolvedAttribute":
        return {expr.sql().replace("`", "")}
    return set().union(*(_columns(c) for c in _children(expr))) if _children(expr) else set()


def parse(spark: SparkSession, sql: str, by: str = "alias") -> Parsed | None:
    """The parts of a select-project-join query; None if it does not parse. by: what tells two sides of a join apart, alias or table."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception:  # the parser's error for the text
        return None
    out, conditions = Parsed(), []

    def walk(node) -> None:
        kind = _name(node)
        if kind == "SubqueryAlias":
            out.tables.append((_children(node)[0].tableName(), node.alias()))
            return
        if kind == "UnresolvedRelation":
            out.tables.append((node.tableName(), node.tableName()))
            return
        if kind in ("Project", "Aggregate"):
            items = node.projectList() if kind == "Project" else node.aggregateExpressions()
            for i in range(items.size()):
                item = items.apply(i)
                out.select.append((_children(item)[0] if _name(item) == "UnresolvedAlias" else item).sql().replace("`", ""))
        if kind == "Filter":
            conditions.append(node.condition())
        if kind == "Join" and node.condition().isDefined():
            conditions.append(node.condition().get())
        for c in _children(node):
            walk(c)

    walk(plan)
    table_of = {alias: name for name, alias in out.tables}

    def side(expr) -> str | None:
        if _name(expr) != "UnresolvedAttribute":
            return None
        owner = expr.sql().replace("`", "").rpartition(".")[0]
        return (owner if by == "alias" else table_of.get(owner, owner)) or None

    def classify(expr) -> None:
        if _name(expr) == "And":
            for c in _children(expr):
                classify(c)
            return
        if _name(expr) == "EqualTo":
            a, b = _children(expr)
            if side(a) and side(b) and side(a) != side(b):
                out.joins.append(f"{a.sql()} = {b.sql()}".replace("`", ""))
                return
        out.filters.append(expr.sql().replace("`", ""))
        out.filter_columns.update(_columns(expr))

    for c in conditions:
        classify(c)
    return out


SCHEMA = "query_id long, sql string, tables array<struct<table:string,alias:string>>, select array<string>, joins array<string>, filters array<string>, filter_columns array<string>"


def parsed(spark: SparkSession, queries: list[tuple[int, str]], by: str = "alias") -> DataFrame:
    """A row of parts for each (query_id, sql)."""
    rows = []
    for i, sql in queries:
        p = parse(spark, sql, by)
        rows.append((i, sql, p.tables, p.select, p.joins, p.filters, sorted(p.filter_columns)) if p else (i, sql, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def workload(spark: SparkSession) -> DataFrame:
    return parsed(spark, list(enumerate(WORKLOAD)))


def pattern_parts(texts: DataFrame) -> DataFrame:
    """(query_id, joins, filter_columns) of (query_id, sql) by patterns alone, without parsing: any number of texts, in Spark.

    A join is two dotted names around `=`, its sides in order; a filter column is a dotted name before an operator whose
    right side is no dotted name. Numbers are no names, and longer operators are tried first."""
    name, op = r"[A-Za-z_]\\w*\\.[A-Za-z_]\\w*", "(?i:!=|<>|>=|<=|=|>|<|LIKE|IN|BETWEEN|IS|NOT)"
    join = F.expr(f"regexp_extract_all(sql, '({name}\\\\s*=\\\\s*{name})', 1)")
    column = F.expr(f"regexp_extract_all(sql, '({name})\\\\s*{op}\\\\s*+(?!{name}|=)', 1)")
    return texts.select("query_id", F.array_sort(F.array_distinct(F.transform(join, sided))).alias("joins"), F.array_sort(F.array_distinct(column)).alias("filter_columns"))


def filter_columns(df: DataFrame) -> DataFrame:
    """Filter columns of each table over all queries, sorted."""
    alias = df.select("query_id", F.explode("tables").alias("t")).select("query_id", "t.table", "t.alias")
    cols = df.select("query_id", F.explode("filter_columns").alias("c")).select("query_id", F.split_part("c", F.lit("."), F.lit(1)).alias("alias"), F.split_part("c", F.lit("."), F.lit(2)).alias("column"))
    return cols.join(alias, ["query_id", "alias"]).groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"))


def alias_map(df: DataFrame) -> DataFrame:
    """Aliases of each table over all queries, sorted."""
    t = df.select(F.explode("tables").alias("t")).select("t.table", "t.alias")
    return t.groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


def alias_table(df: DataFrame) -> DataFrame:
    """The table of each alias over all queries; of an alias of several tables, the last query's."""
    t = df.select("query_id", F.posexplode("tables").alias("place", "t")).select("query_id", "place", "t.table", "t.alias")
    return t.groupBy("alias").agg(F.max_by("table", F.struct("query_id", "place")).alias("table"))


def join_edges(df: DataFrame) -> DataFrame:
    """(alias, other, condition): the join conditions between every two aliases, from either side."""
    c = join_conditions(df).select("condition", *[F.split_part(F.split_part("condition", F.lit("="), F.lit(i)), F.lit("."), F.lit(1)).alias(a) for i, a in ((1, "alias"), (2, "other"))])
    return c.select("alias", "other", "condition").unionByName(c.select(F.col("other").alias("alias"), F.col("alias").alias("other"), "condition")).distinct()


def free_columns(df: DataFrame) -> DataFrame:
    """(query_id, column): the filter columns of a query's tables, over all queries, that the query itself does not filter."""
    by_table = filter_columns(df).select("table", F.explode(F.split("columns", ",")).alias("name"))
    known = df.where(F.col("tables").isNotNull()).select("query_id", "filter_columns", F.explode("tables").alias("t"))
    known = known.join(F.broadcast(by_table.withColumnRenamed("table", "of")), F.col("t.table") == F.col("of"))  # a workload's filter columns are few
    found = known.groupBy("query_id", "filter_columns").agg(F.collect_set(F.concat_ws(".", "t.alias", "name")).alias("available"))
    return found.select("query_id", F.explode(F.array_except("available", "filter_columns")).alias("column"))


def join_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.size("joins").cast("long").alias("n_joins")).agg(F.count("*").alias("n_queries"))


def filter_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.size("filter_columns").cast("long").alias("n_filters")).agg(F.count("*").alias("n_queries"))


def join_conditions(df: DataFrame) -> DataFrame:
    """Distinct join conditions, sides in order."""
    return df.select(F.explode("joins").alias("j")).select(sided(F.col("j")).alias("condition")).distinct()


def join_combinations(df: DataFrame) -> DataFrame:
    """Distinct sets of join conditions of a query, and in how many queries each stands."""
    return df.groupBy(F.array_join(F.array_sort(F.transform("joins", sided)), "&").alias("combination")).agg(F.count("*").alias("n_queries"))


def _key(normalize_sides: bool):
    join = sided if normalize_sides else (lambda j: j)
    aliases = F.array_sort(F.array_distinct(F.transform("tables", lambda t: t["alias"])))
    return aliases.alias("k_tables"), F.col("select").alias("k_select"), F.array_sort(F.array_distinct(F.transform("joins", join))).alias("k_joins")


def template_match(queries: DataFrame, templates: DataFrame, normalize_sides: bool = False) -> DataFrame:
    """For each query the first template with the same tables, select list and joins, and whether its filter columns are the same too.

    An equi-join on normalised keys; sides of a join count as written unless `normalize_sides`."""
    t = templates.select(*_key(normalize_sides), F.col("query_id").alias("template_id"), F.col("filter_columns").alias("template_columns"))
    q = queries.select(*_key(normalize_sides), "query_id", "filter_columns")
    first = t.groupBy("k_tables", "k_select", "k_joins").agg(F.min_by("template_columns", "template_id").alias("template_columns"), F.min("template_id").alias("template_id"))
    return q.join(first, ["k_tables", "k_select", "k_joins"]).select("query_id", "template_id", (F.array_sort("filter_columns") == F.array_sort("template_columns")).alias("same_filters"))


def equivalence_classes(edges: DataFrame) -> DataFrame:
    """(column, class): columns that joins (a, b) equate; the class is its least column. Union-find: a workload's joins are few."""
    spark = edges.sparkSession
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in edges.select("a", "b").distinct().toLocalIterator():
        a, b = find(r["a"]), find(r["b"])
        parent[max(a, b)] = min(a, b)
    return spark.createDataFrame([(x, find(x)) for x in sorted(parent)], "column string, class string")


def _edges(spark: SparkSession) -> DataFrame:
    c = join_conditions(workload(spark))
    return c.select(F.split_part("condition", F.lit("="), F.lit(1)).alias("a"), F.split_part("condition", F.lit("="), F.lit(2)).alias("b"))


def _templates(spark: SparkSession) -> DataFrame:
    return parsed(spark, [(i, WORKLOAD[t]) for i, t in enumerate(TEMPLATES)])


def _pattern_parts(spark: SparkSession) -> DataFrame:
    p = pattern_parts(spark.createDataFrame(list(enumerate(WORKLOAD)), "query_id long, sql string"))
    return p.select("query_id", F.array_join("joins", "&").alias("joins"), F.array_join("filter_columns", ",").alias("filter_columns"))


QUERIES = {
    "workload_filter_columns": lambda s, d: filter_columns(workload(s)),
    "workload_alias_map": lambda s, d: alias_map(workload(s)),
    "workload_alias_table": lambda s, d: alias_table(workload(s)),
    "join_edges": lambda s, d: join_edges(workload(s)),
    "workload_free_columns": lambda s, d: free_columns(workload(s)),
    "workload_join_histogram": lambda s, d: join_histogram(workload(s)),
    "workload_filter_histogram": lambda s, d: filter_histogram(workload(s)),
    "workload_join_conditions": lambda s, d: join_conditions(workload(s)),
    "workload_join_combinations": lambda s, d: join_combinations(workload(s)),
    "template_match": lambda s, d: template_match(workload(s), _templates(s)),
    "workload_pattern_parts": lambda s, d: _pattern_parts(s),
    "join_equivalence_classes": lambda s, d: equivalence_classes(_edges(s)),
}


def _values(texts: list[str]) -> str:
    return ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in enumerate(texts))


_JOIN = r"(\w+\.\w+)\s*=\s*(\w+\.\w+)"
_COLUMN = r"[a-z]\w*\.[a-z]\w*"


def _parts(texts: list[str]) -> str:
    """The workload's parts by pattern matching on its texts: independent of the parser."""
    return f"""SELECT CAST(query_id AS BIGINT) AS query_id, sql, regexp_extract(sql, 'SELECT (.*?) FROM', 1) AS sel,
        list_sort(list_transform(string_split(regexp_extract(sql, 'FROM (.*?) WHERE', 1), ', '), lambda x: regexp_extract(x, ' AS (\\w+)', 1))) AS aliases,
        string_split(regexp_extract(sql, 'FROM (.*?) WHERE', 1), ', ') AS froms,
        list_sort(list_distinct(regexp_extract_all(sql, '{_JOIN}', 0))) AS joins,
        list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_extract(sql, 'WHERE (.*)', 1), '{_JOIN}', '', 'g'), '{_COLUMN}', 0))) AS cols
        FROM (VALUES {_values(texts)}) w(query_id, sql)"""


_W = _parts(list(WORKLOAD))
_T = _parts([WORKLOAD[t] for t in TEMPLATES])
_SIDED = "list_transform(joins, lambda j: array_to_string(list_sort(list_transform(string_split(lower(j), '='), lambda x: trim(x))), '='))"
_EDGES = f"SELECT DISTINCT split_part(c, '=', 1) AS a, split_part(c, '=', 2) AS b FROM (SELECT UNNEST({_SIDED}) AS c FROM ({_W}))"
ORACLE_SQL = {
    "workload_filter_columns": f"""WITH w AS ({_W}), a AS (SELECT query_id, regexp_extract(f, '(\\w+) AS', 1) AS t, regexp_extract(f, ' AS (\\w+)', 1) AS alias FROM (SELECT query_id, UNNEST(froms) AS f FROM w)),
        c AS (SELECT query_id, split_part(x, '.', 1) AS alias, split_part(x, '.', 2) AS col FROM (SELECT query_id, UNNEST(cols) AS x FROM w))
        SELECT t AS "table", array_to_string(list_sort(list_distinct(list(col))), ',') AS "columns" FROM c JOIN a USING (query_id, alias) GROUP BY t""",
    "workload_alias_map": f"""SELECT t AS "table", array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases FROM (SELECT regexp_extract(f, '(\\w+) AS', 1) AS t, regexp_extract(f, ' AS (\\w+)', 1) AS alias FROM (SELECT UNNEST(froms) AS f FROM ({_W}))) GROUP BY t""",
    "workload_alias_table": f"""SELECT alias, ARG_MAX(t, query_id) AS "table" FROM (SELECT query_id, regexp_extract(f, '(\\w+) AS', 1) AS t, regexp_extract(f, ' AS (\\w+)', 1) AS alias FROM (SELECT query_id, UNNEST(froms) AS f FROM ({_W}))) GROUP BY alias""",
    "join_edges": f"SELECT split_part(a, '.', 1) AS alias, split_part(b, '.', 1) AS other, a || '=' || b AS condition FROM ({_EDGES}) UNION SELECT split_part(b, '.', 1), split_part(a, '.', 1), a || '=' || b FROM ({_EDGES})",
    "workload_free_columns": f"""WITH w AS ({_W}), a AS (SELECT query_id, regexp_extract(f, '(\\w+) AS', 1) AS t, regexp_extract(f, ' AS (\\w+)', 1) AS alias FROM (SELECT query_id, UNNEST(froms) AS f FROM w)),
        c AS (SELECT query_id, UNNEST(cols) AS x FROM w), k AS (SELECT DISTINCT t, split_part(x, '.', 2) AS col FROM c JOIN a ON a.query_id = c.query_id AND a.alias = split_part(x, '.', 1))
        SELECT query_id, alias || '.' || col AS "column" FROM a JOIN k USING (t) EXCEPT SELECT query_id, x FROM c""",
    "workload_join_histogram": f"SELECT CAST(len(joins) AS BIGINT) AS n_joins, COUNT(*) AS n_queries FROM ({_W}) GROUP BY 1",
    "workload_filter_histogram": f"SELECT CAST(len(cols) AS BIGINT) AS n_filters, COUNT(*) AS n_queries FROM ({_W}) GROUP BY 1",
    "workload_join_conditions": f"SELECT DISTINCT UNNEST({_SIDED}) AS condition FROM ({_W})",
    "workload_join_combinations": f"SELECT array_to_string(list_sort({_SIDED}), '&') AS combination, COUNT(*) AS n_queries FROM ({_W}) GROUP BY 1",
    "workload_pattern_parts": f"SELECT query_id, array_to_string(list_sort({_SIDED}), '&') AS joins, array_to_string(cols, ',') AS filter_columns FROM ({_W})",
    "template_match": f"SELECT q.query_id, MIN(t.query_id) AS template_id, ARG_MIN(q.cols = t.cols, t.query_id) AS same_filters FROM ({_W}) q JOIN ({_T}) t ON q.aliases = t.aliases AND q.sel = t.sel AND q.joins = t.joins GROUP BY q.query_id",
    "join_equivalence_classes": f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_EDGES}) UNION SELECT b, a FROM ({_EDGES})), reach(col, other) AS (SELECT a, a FROM e UNION SELECT r.col, e.b FROM reach r JOIN e ON r.other = e.a)
        SELECT col AS "column", MIN(other) AS class FROM reach GROUP BY col""",
}
