"""A stored inverted index and ranked retrieval that reads as little of it as it must.

Layout. `build` writes three tables below one path. `postings` has a row for each term and block of documents: the documents of the
block that hold the term, their counts and lengths as arrays, and the greatest share of a score that any of them can get from the
term. `terms` has each term's document frequency. `figures`, written last, has the number of documents and their mean length; without
it the index is not complete and `open_index` fails. The first two are partitioned by a hash of the term and sorted by it.

Blocks are the same for all terms: documents of like length (quarters of a power of two), dealt by hash into parts of some `block` each. So a block's
bound for a query is the sum over its terms of weight times the greatest share, and short documents, which score highest, lie together.

Search. The bounds of all blocks of the query's terms come from the postings without their arrays. The `k` blocks of greatest bound
hold at least k documents; the k-th score among them is a floor, and of all other blocks only those whose bound reaches it are scored.

Scale. No list of a frequent term is gathered: a row holds one block. A text goes to its block by its own length alone (only where a doc_id repeats are lengths
joined), a block of texts is counted and turned into its lists at once, and the lists are shuffled by bucket of the term and part of the blocks. Tasks are as many as
the words ask for, so none grows with the table. One doc_id that repeats in very many rows brings them to one task, where they are added as they pass, not gathered. The driver holds a batch of queries, a frequency for each of
their terms and k block numbers for each query, nothing that grows with the index.

Edge cases. Null or empty text, or none but signs: no words, not a document of the index. Repeated doc_ids are one document of all their
words; a null doc_id is one too. Very long texts: whole. No documents: an empty index, no results. A term that no document holds adds nothing, a term
named twice in a query counts once, and fewer than k matching documents give fewer rows. Ties of the rounded score go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnbase.sources.scratch import shared_path

SCHEMAS = {
    "postings": "term string, block long, top double, docs int, held array<struct<doc_id: long, tf: long, n: long>>, bucket int",
    "terms": "term string, df long, bucket int",
}
K1, B = 1.2, 0.75
#: Scores are compared after rounding to so many digits, and bounds with room for as much.
DIGITS = 6
#: A task has the texts, or the lists, of some so many words.
WORDS = 1 << 21


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def share(tf, n, mean: float):
    """What a term adds to a score, before its weight; of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * n / mean))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    docs: int
    mean: float
    buckets: int

    def read(self, table: str, terms: list[str] | None = None) -> DataFrame:
        """`terms` or `postings`, all of it or the given terms' rows: their folders, and in these the pages that may hold them."""
        rows = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}")
        if terms is None:
            return rows
        folders = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term"), self.buckets)).distinct()
        return rows.where(F.col("bucket").isin([r[0] for r in folders.collect()]) & F.col("term").isin(terms))

    def weights(self, queries: dict[int, list[str]]) -> DataFrame:
        """query, term, weight of the terms that the index holds: a row for each term of each query."""
        terms = sorted({t for q in queries.values() for t in q})
        found = {r["term"]: r["weight"] for r in self.read("terms", terms).select(
            "term", F.log(1 + (F.lit(float(self.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight")).collect()}
        rows = [(q, t, found[t]) for q, words in queries.items() for t in sorted(set(words)) if t in found]
        return self.spark.createDataFrame(rows, "query long, term string, weight double")


def word_counts(texts: pa.RecordBatch) -> pa.Table:
    """term, doc_id, n, tf: each text's distinct words, of rows (doc_id, n, words)."""
    words = texts.column("words")
    terms = words.flatten().dictionary_encode()
    size = max(1, len(terms.dictionary))
    keys = pc.list_parent_indices(words).to_numpy().astype(np.int64) * size + terms.indices.to_numpy()
    keys, tf = np.unique(keys, return_counts=True)
    row = pa.array(keys // size)
    return pa.table({"term": terms.dictionary.take(pa.array(keys % size)), "doc_id": texts.column("doc_id").take(row), "n": texts.column("n").take(row), "tf": pa.array(tf, pa.int64())})


def block_postings(block: int, counts: pa.Table, mean: float) -> pa.Table:
    """A row for each term of a block's word counts, in which no document has a term twice."""
    code = counts["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    doc = counts["doc_id"].combine_chunks()
    order = np.lexsort((doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), code))  # a null doc_id comes first
    counts, code = counts.take(pa.array(order)).combine_chunks(), code[order]
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    ends = np.append(begins, len(code)).astype(np.int32)
    doc, tf, n = (counts[c].combine_chunks() for c in ("doc_id", "tf", "n"))
    return pa.table({
        "term": counts["term"].take(pa.array(begins)), "block": pa.array(np.full(len(begins), block, np.int64)),
        "top": pa.array(np.maximum.reduceat(share(tf.to_numpy(), n.to_numpy(), mean), begins)), "docs": pa.array(np.diff(ends)),
        "held": pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([doc, tf, n], names=["doc_id", "tf", "n"]))})


def build(docs: DataFrame, path: str, buckets: int = 64, block: int = 128) -> Index:
    """Writes the index of `docs` (doc_id, words) below `path`."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "words", F.size("words").cast("long").alias("n"))
    # texts without words are left out by their length only after it is known: a filter before would take all texts apart once more
    lengths = texts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 0")
    length_class = F.floor(F.log2(F.col("n")) * 4).cast("long")
    # at most 4 * 63 classes of lengths
    classes = lengths.groupBy(length_class.alias("class")).agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.max("rows").alias("rows")).collect()
    total, words = (sum(c[x] for c in classes) for x in ("docs", "n"))
    mean = words / total if total else 0.0
    repeats = any(c["rows"] > 1 for c in classes)
    if repeats:  # the length of a doc_id is that of all its rows
        whole = lengths.select(F.col("doc_id").alias("of"), F.col("n").alias("all"))
        texts = texts.join(whole, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "words", F.col("all").alias("n"))
    blocks = F.element_at(F.create_map(*[F.lit(x) for c in classes for x in (c["class"], -(-c["docs"] // block))]), length_class) if classes else F.lit(1)
    placed = texts.withColumn("block", F.shiftleft(length_class, 48).bitwiseOR(F.pmod(F.xxhash64("doc_id"), blocks)))

    def lists(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            more = word_counts(batch)
            counts = more if counts is None else pa.concat_tables([counts, more])
            if repeats:  # added as they pass
                counts = counts.group_by(["term", "doc_id", "n"]).aggregate([("tf", "sum")]).rename_columns(["term", "doc_id", "n", "tf"])
        if counts is not None and counts.num_rows:
            yield from block_postings(key[0].as_py(), counts, mean).combine_chunks().to_batches()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // WORDS))
    found = placed.repartition(tasks, "block").groupBy("block").applyInArrow(lists, SCHEMAS["postings"].removesuffix(", bucket int"))
    # dealt by term and, where there are many, part of the blocks: a task has some of one bucket
    parts = max(1, -(-words // (buckets * WORDS)))
    found = found.withColumn("bucket", bucket(F.col("term"), buckets))
    by_term = F.col("bucket"), F.col("term")
    dealt = found.repartitionById(buckets * parts, F.col("bucket") * parts + F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("docs").alias("df")).repartitionByRange(
        *by_term).sortWithinPartitions(*by_term).write.partitionBy("bucket").parquet(f"{path}/terms")
    spark.createDataFrame([(total, mean, buckets)], "docs long, mean double, buckets int").coalesce(1).write.parquet(f"{path}/figures")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that this or an earlier job wrote; fails where it is not complete."""
    row = spark.read.parquet(f"{path}/figures").first()
    return Index(spark, path, row["docs"], row["mean"], row["buckets"])


def bounds(index: Index, weights: DataFrame, terms: list[str]) -> DataFrame:
    """query, block, bound: what no document of the block can exceed. The lists themselves are not read."""
    heads = index.read("postings", terms).select("term", "block", "top")
    return heads.join(F.broadcast(weights), "term").groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))


def scores(index: Index, weights: DataFrame, lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, doc_id, score of the documents of the blocks `wanted` (query, block)."""
    hits = lists.join(F.broadcast(weights), "term").join(wanted, ["query", "block"])
    held = hits.select("query", "weight", F.explode("held").alias("h")).select("query", "weight", "h.*")
    return held.groupBy("query", "doc_id").agg(F.sum(F.col("weight") * share(F.col("tf"), F.col("n"), index.mean)).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest rounded scores of each query, ranked; ties to the smaller doc_id. Each task keeps k rows of a query before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reachable(limits: DataFrame, floor: DataFrame) -> DataFrame:
    """The blocks (query, block) whose bound reaches their query's floor; all blocks of a query that has none."""
    room = F.lit(2 * 10.0**-DIGITS)
    return limits.join(F.broadcast(floor), "query", "left").where(F.col("floor").isNull() | (F.col("bound") + room >= F.col("floor"))).select("query", "block")


def floors(index: Index, weights: DataFrame, limits: DataFrame, terms: list[str], k: int) -> DataFrame:
    """query, floor: the k-th score among the documents of the k blocks of greatest bound; no row where they hold fewer than k."""
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = limits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "block").collect()
    seeds = index.spark.createDataFrame([tuple(r) for r in first], "query long, block long")
    lists = index.read("postings", terms).where(F.col("block").isin(sorted({r["block"] for r in first})))
    return best(scores(index, weights, lists, F.broadcast(seeds)), k).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))


def search(index: Index, queries: dict[int, list[str]], k: int = 20) -> DataFrame:
    """query, rank, doc_id, score: the k documents that BM25 ranks highest for each of a batch of queries."""
    spark, terms = index.spark, sorted({t for q in queries.values() for t in q})
    weights = index.weights(queries)
    kept = shared_path(spark, "index-bounds")
    bounds(index, weights, terms).write.parquet(kept)
    limits = spark.read.parquet(kept)
    floor = spark.createDataFrame([tuple(r) for r in floors(index, weights, limits, terms, k).collect()], "query long, floor double")
    found = best(scores(index, weights, index.read("postings", terms), reachable(limits, floor)), k)
    return found.select("query", "rank", "doc_id", "score")
