"""The queries that SQL can express against it, and the shape of all of them."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from docaudit.llm.oracles import ORACLES
from docaudit.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(entry.oracle_sql())


CONTRACTS = {
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns(spark, name):
    assert ", ".join(" ".join(t) for t in QUERIES[name](spark, FOLDER).dtypes) == CONTRACTS[name]
