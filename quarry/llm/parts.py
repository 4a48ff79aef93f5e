"""Those parts of the corpus operators' results that SQL can express, as queries of their own beside the same SQL.

Each takes its rows from its operator, over whole tables. What is left out of them (fingerprints, learned verdicts, token ids, edits)
is tested by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, huffman, licenses, quality, sharding, simhash, tokencount
from quarry.session import table


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases' places in every document."""
    return licenses.op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base rule of every document."""
    return quality.op7_quality(spark, sf_dir).drop("kept")


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op8_sharding(spark, sf_dir).select("doc_id", "size", "law")


def sharding_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of every shard."""
    return sharding.op8_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's ids decode to."""
    return bpe.op10_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of every document."""
    return tokencount.op6_token_counts(spark, sf_dir).select("doc_id", "section", "first_char", "n_chars")


def leaks_word_for_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold without an edit."""
    return decontaminate.op3_decontaminate(spark, sf_dir).where("edits = 0").select("doc_id", "item_id", "n_words")


def huffman_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the files."""
    from quarry.operators.ranking import numbered

    return numbered(huffman.op5_huffman(spark, sf_dir).select("doc_id", "start"), "start", name="place").select("doc_id", "place")


def simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same words: how many, and how many fingerprints and components they have."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+", " "))
    key = table(spark, sf_dir, "documents").select("doc_id", F.sha2(words, 256).alias("words"))
    both = simhash.op1_simhash(spark, sf_dir).join(key, "doc_id")
    return both.groupBy("words").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), F.countDistinct("fingerprint").alias("n_fingerprints"), F.countDistinct("component_id").alias("n_components")).drop("words")


QUERIES = {
    "licenses_base": licenses_base,
    "quality_counts": quality_counts,
    "sharding_sizes": sharding_sizes,
    "sharding_shards": sharding_shards,
    "bpe_round_trip": bpe_round_trip,
    "section_spans": section_spans,
    "leaks_word_for_word": leaks_word_for_word,
    "huffman_order": huffman_order,
    "simhash_copies": simhash_copies,
}

_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NOTICE_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = "regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')"
_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, UNNEST(list_filter(range(len(w) - {n - 1}), lambda i: {' AND '.join(f'''w[i + {k + 1}] = '{x}' ''' for k, x in enumerate(phrase.split()))})) AS place FROM d"
    for phrase, label in licenses.BASE.items()
    for n in [len(phrase.split())]
)
ORACLE_SQL = {
    "licenses_base": f"""WITH d AS (SELECT doc_id, {_NOTICE_WORDS} AS w FROM documents), p AS ({_PHRASES}),
        s AS (SELECT doc_id, COUNT(*) AS n, MIN(place) AS a, MAX(place) AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS l FROM p GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_base, a AS first_word, b AS last_word, COALESCE(l, '') AS base_labels FROM d LEFT JOIN s USING (doc_id)""",
    "quality_counts": f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, {_SPACED} AS w, list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
        r AS (SELECT doc_id, UNNEST(range(len(w) - 2)) AS i, w FROM d), g AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM r),
        k AS (SELECT doc_id, COUNT(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY doc_id),
        c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, COALESCE(k.n, 0) AS n_repeat_words FROM d LEFT JOIN k USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "sharding_sizes": "SELECT doc_id, strlen(COALESCE(text, '')) + 8 AS size, 'rows' AS law FROM documents",
    "sharding_shards": """WITH c AS (SELECT CAST(s AS INTEGER) AS shard, n * (s + 1) // 24 - n * s // 24 AS n_rows FROM (SELECT COUNT(*) AS n FROM documents), (SELECT UNNEST(range(24)) AS s))
        SELECT shard, n_rows, CAST(0 AS BIGINT) AS first_slot, n_rows - 1 AS last_slot, n_rows AS n_slots FROM c WHERE n_rows > 0""",
    "bpe_round_trip": "SELECT doc_id, sha256(COALESCE(text, '')) AS decoded_sha256 FROM documents",
    "section_spans": """WITH l AS (SELECT doc_id, UNNEST(x) AS line, generate_subscripts(x, 1) AS k, len(x) AS n FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS x FROM documents)),
        s AS (SELECT doc_id, k, n, length(line) + CASE WHEN k < n THEN 1 ELSE 0 END AS size FROM l)
        SELECT doc_id, CAST(k - 1 AS INTEGER) AS section, CAST(SUM(size) OVER (PARTITION BY doc_id ORDER BY k) - size AS BIGINT) AS first_char, CAST(size AS BIGINT) AS n_chars FROM s WHERE k = 1 OR size > 0""",
    "leaks_word_for_word": f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_NOTICE_WORDS}, ' ') || ' ' AS t FROM documents), b AS (SELECT item_id, {_NOTICE_WORDS} AS w FROM benchmark)
        SELECT doc_id, item_id, CAST(len(w) AS BIGINT) AS n_words FROM d, b WHERE len(w) > 0 AND contains(t, ' ' || array_to_string(w, ' ') || ' ')""",
    "huffman_order": "SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS place FROM documents",
    "simhash_copies": f"""SELECT MIN(doc_id) AS first_id, COUNT(*) AS n_docs, CAST(1 AS BIGINT) AS n_fingerprints, CAST(1 AS BIGINT) AS n_components FROM documents
        GROUP BY trim(regexp_replace({_LOWER}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))""",
}
