"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk_search

    return topk_search.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=256.0)


def op2_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(common.table(spark, sf_dir, "documents"), shards=24)


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.detect(common.table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_dedup

    return embed_dedup.near_duplicates(common.table(spark, sf_dir, "embeddings"), least_cosine=0.93)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    docs = common.table(spark, sf_dir, "documents")
    store = token_store.write(spark, docs, _vocabulary("word_bpe_49k.json"), common.new_path(spark, "token-store"), end_id=2)
    out = token_store.read(store, token_store.keys_of(docs), digest_only=True)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.linked_groups(common.table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    docs = common.table(spark, sf_dir, "documents")
    return packing.pack_documents(spark, docs, _vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.predict(common.table(spark, sf_dir, "documents"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.select(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    docs = common.table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fill_middle

    return fill_middle.digests(common.table(spark, sf_dir, "documents"), seed=1)


def op12_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import heap_bpe

    return heap_bpe.digests(common.table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic_runs

    return periodic_runs.digests(common.table(spark, sf_dir, "documents"), least=12, repeat_tails=True)


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_label_propagation_sharding, op3_pii_weak_supervision,
                                   op4_embedding_near_dedup, op5_token_store, op6_ngram_jaccard, op7_best_two_fit,
                                   op8_language_id, op9_byte_bpe, op10_quality_resampling, op11_fill_in_middle,
                                   op12_heap_bpe, op13_periodic_runs)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op11_fill_in_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens FROM documents
        ), h AS (
            SELECT *, len(tokens) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t
        ), f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), p AS (
            SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM f
        ) SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
                 CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
                 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op6_ngram_jaccard": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id""",
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        ) SELECT * FROM r WHERE rank <= 5""",
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT vec_id AS x, vec_id AS y FROM v
            UNION
            SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
}
