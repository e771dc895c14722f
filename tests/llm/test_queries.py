"""The registered queries: contract columns, and DuckDB where SQL says the same."""

import duckdb
import pytest

from spoorline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op3_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_pack": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op1_suffix_tree_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op13_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_columns_and_oracles(spark, name):
    out = QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    rows = sorted(map(tuple, out.select(*sorted(out.columns)).collect()), key=repr)
    documents = duck().execute("select count(*) from documents").fetchone()[0]
    if name not in ("op5_pack", "op6_embedding_dedup", "op11_source_divergence", "op13_warc"):
        assert len(rows) == documents
    if name in ORACLES:
        columns = ", ".join(f'"{c}"' for c in sorted(out.columns))
        assert rows == sorted(duck().execute(f"select {columns} from ({ORACLES[name]})").fetchall(), key=repr)


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
