"""The registered queries of the operators, with their production parameters.

Each applies its operator to the whole table and derives the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import bpe, html_text, jaccard, language, media, near_vectors, packing, ranked_search, secrets, token_files, toxicity, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_by_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(_table(spark, sf_dir, "documents"), fold=3, held_out=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold=5)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.drop("redacted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=5, percent=75)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"), scale=1024, parts=4, entries=256, rounds=4)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


#: The rules of op13: host, beginning of the path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_media_columns": op2_media_columns,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_html_text": op5_html_text,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_near_vectors": op10_near_vectors,
    "op11_vector_codes": op11_vector_codes,
    "op12_ranked_search": op12_ranked_search,
    "op13_url_filter": op13_url_filter,
}

def _vector_codes_sql(rounds: int) -> str:
    """The codebooks' rounds one after another, each a table of assignments and one of entries."""
    nearest = "SELECT p.r, p.part, min((p.norm + c.norm - 2 * list_dot_product(p.v, c.v))::BIGINT * 256 + c.entry) AS best FROM p JOIN c{i} c USING (part) GROUP BY 1, 2"
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)",
        "p AS MATERIALIZED (SELECT r, part, v, list_dot_product(v, v) AS norm FROM (SELECT r, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS v FROM k, range(4) t(part)))",
        "c0 AS MATERIALIZED (SELECT part, r AS entry, v, norm FROM p WHERE r < 256)",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({nearest.format(i=i)})",
            f"m{i} AS MATERIALIZED (SELECT part, entry, list(f ORDER BY place) AS v FROM (SELECT part, best % 256 AS entry, place, floor(sum(val) / count(*)) AS f FROM (SELECT p.part, best, unnest(v) AS val, unnest(range(len(v))) AS place FROM a{i} JOIN p USING (r, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"c{i + 1} AS MATERIALIZED (SELECT part, entry, v, list_dot_product(v, v) AS norm FROM (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, entry)))",
        ]
    steps += [
        f"z AS ({nearest.format(i=rounds)})",
        "w AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM z GROUP BY 1)",
        f"h AS (SELECT sha256(string_agg(val::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS val, unnest(range(len(v))) AS place FROM c{rounds}))",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN w USING (r), h"


#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    # sets of five words, pairs by common ones, links by similarity, what is reachable by links
    "op9_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
    n AS (SELECT doc_id, len(grams) AS n FROM s), g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * common >= 75 * (a.n + b.n - common)), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT root, y FROM reach JOIN edges ON node = x)
    SELECT root AS doc_id, any_value(n) AS n_shingles, min(node) AS component_id FROM reach JOIN n ON root = doc_id GROUP BY root""",
    # every pair by cosine, then what is reachable
    "op10_near_vectors": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(root, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT root, y FROM reach JOIN edges ON node = x), degree AS (SELECT x, count(*) AS n FROM edges GROUP BY 1)
    SELECT root AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(node) AS component_id, root = min(node) AS kept FROM reach LEFT JOIN degree ON root = x GROUP BY root""",
    # codebooks by rounds: distances from scalar products of whole numbers, which doubles hold exactly
    "op11_vector_codes": _vector_codes_sql(rounds=4),
    # every document's score for every item
    "op12_ranked_search": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY 1), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
    x AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score FROM q JOIN c USING (term) JOIN d USING (term) JOIN n USING (doc_id), s GROUP BY 1, 2)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10""",
    "op13_url_filter": r"""WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
    SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id""",
}
