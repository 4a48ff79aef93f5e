"""Column profiling: catalog, numeric ranges, distinct values, most frequent values, timestamps as epochs.

Every table of the folder is profiled. A table is read once for all its numeric ranges, and once for all its text columns: their values
are unpivoted and counted together, and number of values, value lists and frequencies all derive from those counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import epoch, epoch_of_text, quoted
from quarry.session import table, table_names, written

#: The driver's tables with their columns, for the SQL: name and kind (i integral, d fractional, s text, t timestamp, u none of these).
SCHEMA: dict[str, str] = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:u label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
ALIASES = {
    "r": "region", "n": "nation", "n1": "nation", "n2": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem",
    "e": "events", "d": "documents", "v": "embeddings", "w": "pages", "b": "benchmark", "q": "labels", "t": "conversations",
}
#: Distinct values up to which a text column's domain is all of them; beyond, its most frequent ones, as many.
MOST = 1000


def kind_of(t: T.DataType) -> str:
    """numeric, string, timestamp or unsupported."""
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.NumericType):
        return "numeric"
    return "string" if isinstance(t, (T.StringType, T.CharType, T.VarcharType)) else "unsupported"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, ordinal, column, data_type, kind) of every table of the folder."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for name in table_names(spark, sf_dir)
        for i, f in enumerate(table(spark, sf_dir, name).schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table string, ordinal int, column string, data_type string, kind string")


def numeric_ranges(df: DataFrame, name: str) -> DataFrame:
    """(table, column, is_integral, min_num, max_num) of all numeric columns, in one pass."""
    found = [f for f in df.schema.fields if kind_of(f.dataType) == "numeric"]
    aggs: list[Column] = []
    for f in found:
        aggs += [(F.min(f.name).cast("double") + 0.0).alias(f"lo_{f.name}"), (F.max(f.name).cast("double") + 0.0).alias(f"hi_{f.name}")]
    whole = {f.name: isinstance(f.dataType, T.IntegralType) for f in found}
    parts = [F.struct(F.lit(f.name).alias("column"), F.lit(whole[f.name]).alias("is_integral"), F.col(f"lo_{f.name}").alias("min_num"), F.col(f"hi_{f.name}").alias("max_num")) for f in found]
    return df.agg(*aggs).select(F.lit(name).alias("table"), F.explode(F.array(*parts)).alias("x")).select("table", "x.*")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(table, column, value, n) of all text columns' values, nulls left out, in one pass and one shuffle."""
    found = [f.name for f in df.schema.fields if kind_of(f.dataType) == "string"]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in found])
    return df.select(F.explode(parts).alias("x")).where(F.col("x.value").isNotNull()).groupBy(F.lit(name).alias("table"), F.col("x.column").alias("column"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _tables(spark: SparkSession, sf_dir: str, kind: str, names: set[str] | None = None) -> list[tuple[str, DataFrame]]:
    """The folder's tables, of `names` if given, that have a column of the kind."""
    found = [(t, table(spark, sf_dir, t)) for t in table_names(spark, sf_dir) if names is None or t in names]
    return [(t, df) for t, df in found if any(kind_of(f.dataType) == kind for f in df.schema.fields)]


def domain_numeric(spark: SparkSession, sf_dir: str, names: set[str] | None = None) -> DataFrame:
    return _union([numeric_ranges(df, t) for t, df in _tables(spark, sf_dir, "numeric", names)])


def _counts(spark: SparkSession, sf_dir: str, names: set[str] | None = None) -> DataFrame:
    return _union([value_counts(df, t) for t, df in _tables(spark, sf_dir, "string", names)])


def domain_string_ndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact number of distinct values of each text column."""
    return _counts(spark, sf_dir).groupBy("table", "column").agg(F.count("*").alias("ndv"))


def _small(counts: DataFrame, most: int = MOST) -> DataFrame:
    return counts.groupBy("table", "column").agg(F.count("*").alias("ndv")).where(F.col("ndv") <= most).select("table", "column")


def small_values(counts: DataFrame) -> DataFrame:
    """(table, column, value): every value of the columns that have few of them."""
    return counts.join(F.broadcast(_small(counts)), ["table", "column"], "left_semi").select("table", "column", "value")  # a row a column


def domain_string_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the text columns that have few of them."""
    return small_values(written(_counts(spark, sf_dir), "profile-counts"))


def top_values(counts: DataFrame, most: int = MOST) -> DataFrame:
    """(table, column, value, n): each column's most frequent values, the smaller value first among equals.

    A window with a bounded rank: each task leaves at most `most` rows of a column before the shuffle (WindowGroupLimit)."""
    place = F.row_number().over(Window.partitionBy("table", "column").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("place", place).where(F.col("place") <= most).select("table", "column", "value", "n")


def domain_top_freq(spark: SparkSession, sf_dir: str, names: set[str] | None = None) -> DataFrame:
    """The most frequent values of every text column."""
    return top_values(_counts(spark, sf_dir, names))


def column_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain of each alias's columns: a range of numbers, or values (their number, least and greatest). Tables are profiled once.

    A text column's domain is its most frequent values, which are all of them where they are few."""
    aliases = spark.createDataFrame(list(ALIASES.items()), "alias string, table string")
    numbers = domain_numeric(spark, sf_dir).select("table", "column", F.lit("numeric").alias("kind"), "is_integral", "min_num", "max_num", F.lit(0).cast("long").alias("n_values"), F.lit("").alias("first_value"), F.lit("").alias("last_value"))
    values = domain_top_freq(spark, sf_dir).groupBy("table", "column").agg(F.count("*").alias("n_values"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))
    values = values.select("table", "column", F.lit("string").alias("kind"), F.lit(False).alias("is_integral"), F.lit(0.0).alias("min_num"), F.lit(0.0).alias("max_num"), "n_values", "first_value", "last_value")
    return aliases.join(numbers.unionByName(values), "table").drop("table")


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, column, value, literal, pattern) of the values of columns that have few: as a SQL literal, and as LIKE over its first two characters."""
    v = domain_string_values(spark, sf_dir)
    return v.select("table", "column", "value", quoted(F.col("value")).alias("literal"), quoted(F.concat(F.lit("%"), F.substring("value", 1, 2), F.lit("%"))).alias("pattern"))


def timestamp_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).where(F.col("kind") == "timestamp").select("table", "column")


def timestamp_to_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, column, epoch, n): every timestamp column in whole epoch seconds, and how often each stands in it."""
    parts = []
    for t, df in _tables(spark, sf_dir, "timestamp"):
        for f in df.schema.fields:
            if kind_of(f.dataType) == "timestamp":
                parts.append(df.groupBy(F.lit(t).alias("table"), F.lit(f.name).alias("column"), epoch(F.col(f.name)).alias("epoch")).agg(F.count("*").alias("n")))
    return _union(parts)


def string_to_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text, with and without a readable time, in epoch seconds."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("T?")).otherwise(F.date_format("o_orderdate", " HH:mm:ss")))
    return table(spark, sf_dir, "orders").select("o_orderkey", epoch_of_text(text).alias("epoch"))


def _strings() -> dict[str, list[str]]:
    return {t: [c[:-2] for c in cols.split() if c.endswith(":s")] for t, cols in SCHEMA.items()}


def _sql_counts() -> str:
    parts = [f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS value, COUNT(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cols in _strings().items() for c in cols]
    return " UNION ALL ".join(parts)


def _sql_ranges() -> str:
    parts = []
    for t, cols in SCHEMA.items():
        for c, k in (x.split(":") for x in cols.split()):
            if k in "id":
                parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {'true' if k == 'i' else 'false'} AS is_integral, CAST(MIN({c}) AS DOUBLE) + 0.0::DOUBLE AS min_num, CAST(MAX({c}) AS DOUBLE) + 0.0::DOUBLE AS max_num FROM {t}")
    return " UNION ALL ".join(parts)


def _sql_catalog() -> str:
    names = ", ".join(f"'{t}'" for t in SCHEMA)
    kind = "CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type LIKE '%[]' THEN 'unsupported' ELSE 'numeric' END"
    spark_type = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp_ntz' END"
    return f'SELECT table_name AS "table", CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS "column", {spark_type} AS data_type, {kind} AS kind FROM information_schema.columns WHERE table_name IN ({names})'


_SQL_TOP = f'SELECT "table", "column", value, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value) AS place FROM ({_sql_counts()})) WHERE place <= {MOST}'
_SQL_ALIASES = ", ".join(f"('{a}', '{t}')" for a, t in ALIASES.items())

QUERIES = {
    "catalog_columns": catalog,
    "timestamp_columns": timestamp_columns,
    "domain_numeric": domain_numeric,
    "domain_string_ndv": domain_string_ndv,
    "domain_string_values": domain_string_values,
    "domain_top_freq": domain_top_freq,
    "column_domain": column_domain,
    "timestamp_to_epoch": timestamp_to_epoch,
    "string_to_epoch": string_to_epoch,
    "predicate_literals": literals,
}
ORACLE_SQL = {
    "catalog_columns": _sql_catalog(),
    "timestamp_columns": f"SELECT \"table\", \"column\" FROM ({_sql_catalog()}) WHERE kind = 'timestamp'",
    "domain_numeric": _sql_ranges(),
    "domain_string_ndv": f'SELECT "table", "column", COUNT(*) AS ndv FROM ({_sql_counts()}) GROUP BY ALL',
    "domain_string_values": f'WITH c AS ({_sql_counts()}) SELECT "table", "column", value FROM c WHERE ("table", "column") IN (SELECT ("table", "column") FROM c GROUP BY "table", "column" HAVING COUNT(*) <= {MOST})',
    "domain_top_freq": _SQL_TOP,
    "column_domain": f"""
        SELECT alias, d.* EXCLUDE ("table") FROM (VALUES {_SQL_ALIASES}) a(alias, "table") JOIN (
          SELECT "table", "column", 'numeric' AS kind, is_integral, min_num, max_num, 0 AS n_values, '' AS first_value, '' AS last_value FROM ({_sql_ranges()})
          UNION ALL SELECT "table", "column", 'string', false, 0.0, 0.0, COUNT(*), MIN(value), MAX(value) FROM ({_SQL_TOP}) GROUP BY "table", "column"
        ) d USING ("table")""",
    "timestamp_to_epoch": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c[:-2]}' AS \"column\", CAST(FLOOR(EPOCH({c[:-2]})) AS BIGINT) AS epoch, COUNT(*) AS n FROM {t} GROUP BY 3" for t, cols in SCHEMA.items() for c in cols.split() if c.endswith(":t")
    ),
    "string_to_epoch": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(EPOCH(strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS BIGINT) END AS epoch FROM orders",
}
ORACLE_SQL["predicate_literals"] = f"""SELECT "table", "column", value, '''' || replace(value, '''', '''''') || '''' AS literal, '''%' || replace(substr(value, 1, 2), '''', '''''') || '%''' AS pattern
    FROM ({ORACLE_SQL["domain_string_values"]})"""
