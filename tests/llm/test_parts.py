"""The SQL-expressible parts of the corpus operators give DuckDB's rows."""

import os

import duckdb
import pytest

from quarry.llm import parts, registry


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(parts.QUERIES))
def test_part_matches_sql(name, spark, sf_dir, con):
    df = registry.QUERIES[name](spark, sf_dir)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_every_part_has_sql():
    assert set(parts.QUERIES) == set(parts.ORACLE_SQL)


def test_registered_columns(spark, sf_dir):
    """The columns that each query returns, in order."""
    want = {
        "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_decontaminate": ["doc_id", "item_id", "first_word", "n_words", "edits", "item_words"],
        "op4_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op5_huffman": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op6_token_counts": ["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing"],
        "op7_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op10_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    for name, columns in want.items():
        df = registry.QUERIES[name](spark, sf_dir)
        assert df.columns == columns and df.count() >= 0, name
