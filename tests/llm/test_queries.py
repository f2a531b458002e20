import pytest

import __spark_entry__

COLUMNS = {
    "op1": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op2": ("documents", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]),
    "op3": (None, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
    "op4": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op5": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op6": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op7": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op8": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op9": ("documents", ["doc_id", "n_shingles", "component_id"]),
    "op10": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op11": ("embeddings", ["vec_id", "code", "error", "label_error", "codebooks_sha256"]),
    "op12": (None, ["item_id", "rank", "doc_id", "score"]),
    "op13": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
}


@pytest.mark.parametrize("op", COLUMNS)
def test_contract(spark, sf_dir, op):
    (name,) = [q for q in __spark_entry__.queries() if q.split("_")[0] == op]
    table, columns = COLUMNS[op]
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert got.columns[: len(columns)] == columns or set(columns) <= set(got.columns)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == "bigint" for c in columns if c in ("doc_id", "page_id", "vec_id", "n_tokens", "start", "n_links", "component_id", "n_shingles", "n_chars", "ids_crc32", "error", "label_error"))
    if table:
        assert got.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
