"""The registered queries of this subpackage over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from shiftspark.llm import queries

COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"], "op2": ["doc_id", "item_id", "containment"],
    "op3": ["doc_id", "first_word", "end_word", "begin", "end"], "op4": ["page_id", "host", "path", "rule", "verdict", "score"],
    "op5": ["doc_id", "size", "source_size", "target", "taken"], "op7": ["page_id", "url", "text", "n_chars"],
    "op8": ["doc_id", "held_out", "score", "predicted"], "op9": ["doc_id", "class_id", "class_size", "kept"],
    "op10": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op12": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
    "op13": ["lang", "source", "part", "item", "value", "rank"],
    "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}


def test_entry_registers_one_query_for_each_operator():
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(queries.ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF_SMALL)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    want = sorted(str([norm(r[rel.columns.index(c)]) for c in df.columns]) for r in rel.fetchall())
    assert sorted(str([norm(v) for v in r]) for r in df.collect()) == want


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q.startswith("op") and q not in queries.ORACLE_SQL])
def test_columns_of_contracts(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    want = COLUMNS.get(name.split("_")[0])
    assert want is None or df.columns == want
