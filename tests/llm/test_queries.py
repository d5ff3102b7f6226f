"""The registered queries over whole small tables: columns as promised, a row for each document, SQL where there is any."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from captionlake.llm import queries as Q

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the shared tables are not here")
COLUMNS = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op2_ann_graph": "query_id rank vec_id score",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_length_histogram": "n_tokens docs docs_at_least tokens_at_least all_docs all_tokens tokens_truncated share_at_most",
    "op5_simhash": "doc_id fingerprint component_id", "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to", "op8_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op9_quality": "doc_id held_out score predicted", "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}
PER_DOCUMENT = ["op1_exact_dedup", "op5_simhash", "op6_bpe", "op8_line_dedup", "op9_quality", "op10_sharding"]


def test_all_are_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(E.queries()) and set(COLUMNS) == set(Q.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    got = Q.queries()[name](spark, str(SF)).toPandas()
    assert list(got.columns) == COLUMNS[name].split()
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    ids = [r[0] for r in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    if name in PER_DOCUMENT:
        assert sorted(got["doc_id"]) == ids
    if name == "op2_ann_graph":
        exact = con.execute("""
            WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0)
            SELECT q.vec_id, e.vec_id FROM q, embeddings e WHERE e.vec_id <> q.vec_id
            QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), e.vec_id) <= 10""").fetchall()
        assert len(got) == len(exact) and len(set(exact) & set(zip(got["query_id"], got["vec_id"], strict=True))) >= 0.9 * len(exact)
    if name == "op10_sharding":
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
    if sql := Q.oracle_sql().get(name):
        want = con.execute(sql).df()
        plain = lambda x: sorted(tuple(map(str, r)) for r in x[sorted(x.columns)].itertuples(index=False))
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
