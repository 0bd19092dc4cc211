"""Search over chunks and vectors: cosine, BM25, rank fusion, and answers with their evidence."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[a-z0-9_]+"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_search(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest vectors by cosine to one query vector (a literal, so nothing is broadcast); exact, one pass."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(column), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def dense_search_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", rows: int = 4096) -> DataFrame:
    """(query_id, key, score): for every query its k nearest vectors by cosine, ties by the key; exact.

    Both sides are cut into blocks of about ``rows``; each pair of blocks is one product of matrices that gives k rows a query.
    Repeated rows count once per key; rows without a vector, or with one of length zero, have no cosine and no row.
    """
    there = lambda df: df.where(F.col(column).isNotNull() & (dot(F.col(column), F.col(column)) > 0)).select(key, column).dropDuplicates([key])
    v, q = there(vectors), there(queries)
    blocks = lambda df: max(1, -(-df.count() // rows))
    nv, nq = blocks(v), blocks(q)
    mine = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select(key, column, mine(nv).alias("vb"), each(nq).alias("qb"))
    q = q.select(key, column, mine(nq).alias("qb"), each(nv).alias("vb"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": a[key][:0], key: b[key][:0], "score": np.zeros(0)})
        unit = lambda x: (m := np.stack(list(x)).astype("float64")) / np.sqrt((m * m).sum(1, keepdims=True))
        b = b.sort_values(key)
        score = np.round(unit(a[column]) @ unit(b[column]).T, 6)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # stable: ties stay in the order of keys
        n = best.shape[1]
        return pd.DataFrame({"query_id": np.repeat(a[key].to_numpy(), n), key: b[key].to_numpy()[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    kind = dict(vectors.dtypes)[key]
    near = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(nearest, f"query_id {kind}, {key} {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)  # k rows for each block of vectors
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf, size): term frequencies and lengths, counted inside the row."""
    words = F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))
    rows = df.select(key, words.alias("w")).where(F.size("w") > 0)
    return rows.select(key, F.size("w").alias("size"), F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def bm25(df: DataFrame, key: str, column: str, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best texts for a query. Only the query's terms are exploded; the corpus gives two numbers."""
    terms = sorted(set(re.findall(WORD, query.lower())))
    words = F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))
    times = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    rows = df.select(key, words.alias("w")).where(F.size("w") > 0).select(key, F.size("w").alias("size"), *(times(t).alias(f"t{i}") for i, t in enumerate(terms)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        d = stats[f"d{i}"]
        idf = math.log(1 + (stats.n - d + 0.5) / (d + 0.5))
        tf = F.col(f"t{i}")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.lit(stats["mean"] or 1.0)))
    return rows.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def fuse(rankings: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists (key, score)."""
    ranked = [r.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank")) for r in rankings]  # lists of k rows
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.unionByName(r)
    return all_.groupBy(key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score")).orderBy(F.desc("score"), key).limit(k)


def answers(hits: DataFrame, chunks: DataFrame, excerpt: int = 200) -> DataFrame:
    """Hits (uid, score) of chunks as citable answers: file, range, excerpt, score."""
    return hits.join(chunks, "uid").select("uid", "source_file", "line_start", "line_end", F.substring("content", 1, excerpt).alias("excerpt"), "score")


def search_code(nodes: DataFrame, text: str, label: str | None = None, k: int = 20) -> DataFrame:
    """Nodes whose name or text contains a string, names first."""
    out = nodes if label is None else nodes.where(F.col("label") == label)
    t = text.lower()
    named, inside = F.lower("name").contains(t), F.lower("text").contains(t)
    return out.where(named | inside).select("uid", "label", "name", "file", F.when(named, 2).otherwise(1).alias("score")).orderBy(F.desc("score"), "uid").limit(k)


def get_function(graph, name: str, chunks: DataFrame | None = None, include_callers: bool = False) -> DataFrame:
    """Functions of a name; with the chunk that holds their first line, and who calls them, on request."""
    from .chunking import chunk_of_line

    out = graph.node("Function", F.col("name") == name).withColumn("source_file", F.col("file"))
    if chunks is not None:
        out = chunk_of_line(out, chunks)
    if include_callers:
        calls = graph.callers(out).groupBy(F.col("callee").alias("uid")).agg(F.sort_array(F.collect_set("caller")).alias("callers"))
        out = out.join(calls, "uid", "left")
    return out


def route(edges: DataFrame) -> DataFrame:
    """Adds the review route of a confidence: auto from 0.8, review from 0.5, else reject; flagged below 0.6."""
    c = F.col("confidence")
    return edges.withColumns({"route": F.when(c >= 0.8, "auto").when(c >= 0.5, "review").otherwise("reject"), "flagged": c < 0.6})


def versions(rows: DataFrame, key: str = "uid", since: str = "ingested_at", until: str = "deleted_at") -> DataFrame:
    """valid_from and valid_to of each version of a record: a version ends where it is deleted or the next one begins."""
    w = Window.partitionBy(key).orderBy(since)
    return rows.withColumn("valid_from", F.col(since)).withColumn("valid_to", F.least(F.col(until), F.lead(since).over(w)))
