"""Full-text and vector search for many queries at once.

The word index is a postings table ``(doc, term, tf)`` with document lengths and
frequencies; a query table joins it on the term, so a hot term costs its
postings once per query that asks for it.  Ranks and fusion are windows per
query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trigrams, words
from ..session import importable, materialise

K1, B = 1.2, 0.75
RRF = 60
MOST_LITERAL_GRAMS = 2000
DIMS = 512


def postings(docs: DataFrame, key: str, *texts: Column | str) -> DataFrame:
    """``doc, term, tf, doc_len`` over all given text columns together."""
    arrays = [F.coalesce(words(t), F.array().cast("array<string>")) for t in texts]
    d = docs.select(F.col(key).alias("doc"), F.concat(*arrays).alias("_w"))
    x = d.select("doc", F.size("_w").alias("doc_len"), F.explode("_w").alias("term"))
    return x.groupBy("doc", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(posts: DataFrame, queries: DataFrame, conjunctive: bool = True, n_docs: DataFrame | None = None) -> DataFrame:
    """Scores of every (query, doc): ``query, doc, score, n_terms``.

    ``queries`` has ``query, term``.  ``conjunctive`` keeps documents with all of
    a query's terms.  Frequencies and the mean length come from all postings;
    ``n_docs`` (one row ``n, avg_len``) overrides them.
    """
    q = queries.select("query", "term").distinct()
    lens = posts.select("doc", "doc_len").distinct()
    stats = n_docs if n_docs is not None else lens.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"))
    wanted = q.select("term").distinct()
    hit = posts.join(wanted, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    scored = hit.join(df, "term").withColumn("n", stats.select("n").scalar()).withColumn("avg_len", stats.select("avg_len").scalar()).withColumn("w", weight).select("term", "doc", "w")
    # rounded, so that a rank does not hang on the order of a sum
    s = q.join(scored, "term").groupBy("query", "doc").agg(F.round(F.sum("w"), 9).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    if conjunctive:
        need = q.groupBy("query").agg(F.count(F.lit(1)).alias("_need"))
        s = s.join(need, "query").where("n_terms = _need").drop("_need")
    return s


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "query", tie: str = "doc", parts: int = 32) -> DataFrame:
    """The best k per query with ``rank`` from 0; ties by the least key.

    The hits of a query are ranked in ``parts`` by a hash of the document first, so a
    query that hits everything is no single task; k of each part meet in the end.
    """
    order = (F.col(score).desc(), F.col(tie))
    part = F.pmod(F.xxhash64(tie), F.lit(parts))
    near = scored.withColumn("_part", part).withColumn("_near", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("_near") <= k).drop("_part", "_near")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).where(F.col("rank") < k)


def substring_hits(docs: DataFrame, key: str, text: Column | str, queries: DataFrame) -> DataFrame:
    """Documents whose text contains the query text (case-insensitive): ``query, doc, score``.

    Candidates share the rarest trigram of the query, then the text decides; the
    score is the share of the query among the text's length.
    """
    t = F.col(text) if isinstance(text, str) else text
    d = docs.select(F.col(key).alias("doc"), F.lower(t).alias("_t")).where("_t is not null")
    q = queries.select("query", F.lower("text").alias("_q")).where("length(_q) >= 3").distinct()
    qg = q.select("query", "_q", F.explode(trigrams("_q")).alias("gram"))
    # few query trigrams are a literal list, so each text yields only those; many are a join
    wanted = [r.gram for r in qg.select("gram").distinct().limit(MOST_LITERAL_GRAMS + 1).collect()]
    if len(wanted) <= MOST_LITERAL_GRAMS:
        have = F.array_intersect(trigrams("_t"), F.array(*[F.lit(g) for g in wanted])) if wanted else F.array().cast("array<string>")
        grams = d.select("doc", F.explode(have).alias("gram"))
    else:
        grams = d.select("doc", F.explode(trigrams("_t")).alias("gram")).join(qg.select("gram").distinct(), "gram", "left_semi")
    grams = materialise(grams, "grams")
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = qg.join(df, "gram").groupBy("query", "_q").agg(F.min(F.struct("df", "gram")).alias("g"), F.count(F.lit(1)).alias("have"))
    need = qg.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    rare = rare.join(need, "query").where("have = need").select("query", "_q", F.col("g.gram").alias("gram"))
    c = rare.join(grams, "gram").join(d, "doc").where(F.contains(F.col("_t"), F.col("_q")))
    return c.select("query", "doc", (F.length("_q") / F.length("_t")).alias("score"))


def fuse(*ranked: DataFrame, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of lists ``query, doc, rank``: ``query, doc, score``."""
    u = None
    for r in ranked:
        x = r.select("query", "doc", (1.0 / (F.lit(k) + F.col("rank"))).alias("s"))
        u = x if u is None else u.unionByName(x)
    return u.groupBy("query", "doc").agg(F.round(F.sum("s"), 12).alias("score"))


def search(docs: DataFrame, key: str, name: Column, body: Column, queries: DataFrame, limit: int = 15) -> DataFrame:
    """The search cascade: word and substring ranks fused; queries without a hit are retried word by word, then by substring of the key.

    ``queries`` has ``query, text``; returns ``query, doc, rank, score, tier``.
    """
    pool = max(4 * limit, 40)
    posts = materialise(postings(docs, key, name, body), "postings")
    terms = queries.select("query", F.explode(F.array_distinct(words("text"))).alias("term"))
    strict = top_k(bm25(posts, terms), pool)
    sub = top_k(substring_hits(docs, key, F.concat_ws(" ", name, body), queries), pool)
    first = materialise(fuse(strict, sub).withColumn("tier", F.lit(1)), "fused")
    open_q = queries.join(first.select("query").distinct(), "query", "left_anti")
    loose = bm25(posts, terms.join(open_q.select("query"), "query", "left_semi"), conjunctive=False).select("query", "doc", "score").withColumn("tier", F.lit(2))
    still = open_q.join(loose.select("query").distinct(), "query", "left_anti")
    last = substring_hits(docs, key, F.col(key), still).withColumn("tier", F.lit(3))
    return top_k(first.unionByName(loose).unionByName(last), limit)


def hash_vector(tokens: list[str], grams: list[str], dims: int = DIMS) -> np.ndarray:
    """The hashed vector of a text: words weigh 1, character n-grams half, signs from the hash, unit length."""
    v = np.zeros(dims, dtype=np.float32)
    for items, weight in ((tokens, 1.0), (grams, 0.5)):
        for t in items:
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
            v[h % dims] += weight if (h >> 20) & 1 else -weight
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(tokens: Column, grams: Column, dims: int = DIMS) -> Column:
    """Hashed vectors as an array column, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(t: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([hash_vector([] if a is None else list(a), [] if b is None else list(b), dims).tolist() for a, b in zip(t, g, strict=True)])

    return run(tokens, grams)


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, block_rows: int = 32_768) -> DataFrame:
    """Exact top-k cosine neighbours of every query against all rows: ``query, doc, score, rank``.

    Queries go in blocks of at most ``block_rows``, a bound by construction, each
    broadcast to one pass over the vectors where they lie: a task multiplies its
    Arrow batches with the block and keeps k rows per query, so what is shuffled is
    k rows per query and task, never all pairs.  The query itself is left out; ties
    go to the least key.
    """
    spark = vectors.sparkSession
    importable(spark)
    kind = vectors.schema[key].dataType
    out = T.StructType([T.StructField("query", kind), T.StructField("doc", kind), T.StructField("score", T.DoubleType())])
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("qv")).where("query is not null and qv is not null")
    n = max(1, -(-q.count() * 2 // block_rows))
    blocks = materialise(q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n)).cast("int")), "queries")
    docs = vectors.select(F.col(key).alias("doc"), F.col(vector).alias("v")).where("doc is not null and v is not null")
    best = None
    for b in range(n):
        rows = blocks.where(F.col("block") == b).select("query", "qv").collect()
        if not rows:
            continue
        x = np.array([r.qv for r in rows], dtype=np.float64)
        sent = spark.sparkContext.broadcast(([r["query"] for r in rows], x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            want, x = sent.value
            kept: list[list[tuple[float, object]]] = [[] for _ in want]
            cut = np.full(len(want), -np.inf)
            for pdf in batches:
                if not len(pdf):
                    continue
                ids = pdf["doc"].tolist()
                m = np.array(pdf["v"].tolist(), dtype=np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
                for lo in range(0, len(want), 1024):
                    s = np.round(x[lo : lo + 1024] @ m.T, 9)
                    least = cut[lo : lo + 1024]
                    if s.shape[1] > k + 1:
                        least = np.maximum(least, np.partition(s, -(k + 1), axis=1)[:, -(k + 1)])
                    r, c = np.nonzero(s >= least[:, None])
                    for i, j in zip(r.tolist(), c.tolist(), strict=True):
                        kept[lo + i].append((-s[i, j], ids[j]))
                    for i in set(r.tolist()):
                        got = sorted(t for t in kept[lo + i] if t[1] != want[lo + i])[:k]
                        kept[lo + i] = got
                        if len(got) == k:
                            cut[lo + i] = -got[-1][0]
            yield pd.DataFrame([(want[i], d, -s) for i, got in enumerate(kept) for s, d in got], columns=["query", "doc", "score"])

        part = docs.mapInPandas(run, out)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return top_k(spark.createDataFrame([], out), k)
    return top_k(best, k)
