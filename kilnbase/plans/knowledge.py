"""Knowledge-base queries: pages to text and links, documents to passages, an index and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnbase.functions import text as T
from kilnbase.operators import retrieval
from kilnbase.operators.graph import page_rank
from kilnbase.sources.catalog import load
from kilnbase.sources.scratch import shared_path

from .registry import query

_SQL_TEXT = "html"
for _pattern, _by in T.HTML_STEPS:
    _SQL_TEXT = f"regexp_replace({_SQL_TEXT}, '{_pattern}', '{_by}', 'g')"


@query("SELECT lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, max(n_chars) AS longest FROM documents GROUP BY lang, source")
def kb_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.max("n_chars").alias("longest"))


@query(f"SELECT page_id, md5(trim({_SQL_TEXT})) AS digest, length(trim({_SQL_TEXT})) AS n_chars FROM pages")
def kb_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.html_text(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", body.alias("body")).select("page_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1) AS title FROM pages")
def kb_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def kb_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("href"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^(www|m)\\.', ''), '[?#].*$', ''), '/$', '') AS url_canon FROM pages""")
def kb_url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url_canon"))


@query("""SELECT p.page_id, p.seq, md5(substr(d.text, (p.seq * 450 + 1)::BIGINT, 500)) AS digest FROM documents d JOIN
    (SELECT doc_id AS page_id, unnest(range(0, greatest(length(text) - 1 - 50, 0) // 450 + 1))::INT AS seq FROM documents) p ON d.doc_id = p.page_id""".replace("p.page_id, p.seq", "d.doc_id, p.seq"))
def kb_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.chunks(F.col("text"), 500, 50)).alias("seq", "passage")).select("doc_id", "seq", F.md5("passage").alias("digest"))


_POSTINGS = r"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY doc_id, term"""


def _index(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    """The stored index of `documents`, written once by an application for these files as they are."""
    docs = load(spark, sf_dir, "documents")
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = docs.select(F.xxhash64(file).alias("f")).distinct().agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
    key = spark.sparkContext.applicationId, sf_dir, str(files)
    if key not in _INDEXES:
        built = retrieval.build(docs.select("doc_id", T.words(F.col("text")).alias("words")), shared_path(spark, "index"))
        _INDEXES[key] = built.path
    return retrieval.open_index(spark, _INDEXES[key])


_INDEXES: dict[tuple[str, str, str], str] = {}


@query(f"SELECT doc_id, term, tf, count(*) OVER (PARTITION BY term) AS df FROM ({_POSTINGS})")
def kb_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the stored index, with each term's document frequency.

    Lists meet their term before they are taken apart, and neither side is sorted: a task hashes its terms.
    """
    index = _index(spark, sf_dir)
    lists = index.read("postings").select("term", "held")
    rows = lists.join(index.read("terms").select("term", "df").hint("shuffle_hash"), "term")
    return rows.select("term", "df", F.explode("held").alias("h")).select("h.doc_id", "term", "h.tf", "df")


@query(f"""WITH p AS ({_POSTINGS}), l AS (SELECT doc_id, sum(tf) AS n FROM p GROUP BY doc_id), g AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
    f AS (SELECT term, count(*) AS df FROM p WHERE term IN ('the', 'tion', 'leaux', 'keit', 'ones') GROUP BY term),
    s AS (SELECT p.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
          FROM p JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN g GROUP BY p.doc_id)
    SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 20""")
def kb_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that BM25 ranks highest for a query of five words, read from the stored index."""
    found = retrieval.search(_index(spark, sf_dir), {1: ["the", "tion", "leaux", "keit", "ones"]}, 20)
    return found.select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY conv_id")
def kb_dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("transcript"), F.count("*").alias("turns"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host, html FROM pages)
    SELECT host, href, count(*) AS n FROM (SELECT host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM p) GROUP BY host, href""")
def kb_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges from hosts to the site-relative targets that their pages link to."""
    pages = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1).alias("host"), F.explode(T.html_links(F.col("html"))).alias("href"))
    return pages.groupBy("host", "href").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def kb_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("digest"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT a.vec_id, round(list_inner_product(a.e, b.e), 6) AS dot, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_distance(a.e, b.e), 6) AS l2
    FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def fn_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product, cosine and distance of each vector and the one of the next id."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.join(after, "vec_id").select("vec_id", F.round(T.dot(a, b), 6).alias("dot"), F.round(T.cosine(a, b), 6).alias("cosine"), F.round(T.distance(a, b), 6).alias("l2"))


_EDGES = """e AS MATERIALIZED (SELECT DISTINCT regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages),
    n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), d AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY src),
    r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM n)"""
_RANK_ROUNDS = 3
_STEPS = "".join(f""", r{k} AS MATERIALIZED (SELECT n.node, 0.15 + 0.85 * coalesce(sum(r.rank / d.out), 0) AS rank FROM n LEFT JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) b ON b.dst = n.node
    LEFT JOIN r{k - 1} r ON r.node = b.src LEFT JOIN (SELECT x AS src, count(*) AS out FROM (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e) GROUP BY x) d ON d.src = b.src GROUP BY n.node)""" for k in range(1, _RANK_ROUNDS + 1))


@query(f"WITH {_EDGES}{_STEPS} SELECT node, round(rank, 6) AS rank FROM r{_RANK_ROUNDS}")
def kb_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of hosts and link targets, links taken both ways, after three rounds from equal ranks."""
    pages = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1).alias("src"), F.explode(T.html_links(F.col("html"))).alias("dst"))
    links = pages.unionByName(pages.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return page_rank(links, _RANK_ROUNDS).select("node", F.round("rank", 6).alias("rank"))
