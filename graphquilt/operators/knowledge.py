"""Recorded notes and their verdicts: standing, ranking, recall, diagnosis, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalize_symptom, stem, symptom_tokens, words
from ..session import cut
from .search import bm25, postings, top_k

HALF_LIFE_DAYS = 30.0
LEAST_WEIGHT = 0.125
CLEAR_SHARE = 0.75
PREFERRED_USEFUL = 2
_DAY = 86400.0


def decay(age_seconds: Column, half_life_days: float) -> Column:
    """Weight by age; no half-life means no decay, the future counts as now."""
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0.0)) / (_DAY * half_life_days))


def outcomes(verdicts: DataFrame, now: float, by: list[str], half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """The standing of every target from its verdict events (``verdict, ts, note, corrected_by``).

    A correction no useful verdict follows is ``corrected``; too little weight is
    ``faded``; a clear share of useful weight is ``preferred`` (twice useful) or
    ``useful``, of negative weight ``dead_end``, between them ``contested``.
    """
    ts = F.coalesce("ts", F.lit(0.0))
    v = verdicts.where(F.col("verdict").isin("useful", "dead_end", "corrected")).withColumn("ts", ts).withColumn("_w", decay(F.lit(now) - ts, half_life_days))

    def when(kind: str, x: Column) -> Column:
        return F.when(F.col("verdict") == kind, x)

    a = v.groupBy(*by).agg(
        F.count(when("useful", F.lit(1))).alias("useful"),
        F.count(when("dead_end", F.lit(1))).alias("dead_end"),
        F.count(when("corrected", F.lit(1))).alias("corrected"),
        F.coalesce(F.sum(when("useful", F.col("_w"))), F.lit(0.0)).alias("useful_weight"),
        F.coalesce(F.sum(F.when(F.col("verdict") != "useful", F.col("_w"))), F.lit(0.0)).alias("negative_weight"),
        F.max(when("useful", F.col("ts"))).alias("_last_useful"),
        F.max(when("corrected", F.col("ts"))).alias("_last_corrected"),
        F.max("ts").alias("last_ts"),
        F.max_by(F.coalesce("note", F.lit("")), "ts").alias("last_note"),
        F.max_by("corrected_by", F.when((F.col("verdict") == "corrected") & F.col("corrected_by").isNotNull(), F.col("ts"))).alias("corrected_by"),
    )
    total = F.col("useful_weight") + F.col("negative_weight")
    share = F.col("useful_weight") / total
    status = (
        F.when(F.col("_last_corrected").isNotNull() & (F.col("_last_useful").isNull() | (F.col("_last_useful") <= F.col("_last_corrected"))), "corrected")
        .when(total < LEAST_WEIGHT, "faded")
        .when((share >= CLEAR_SHARE) & (F.col("useful") >= PREFERRED_USEFUL), "preferred")
        .when(share >= CLEAR_SHARE, "useful")
        .when(share <= 1 - CLEAR_SHARE, "dead_end")
        .otherwise("contested")
    )
    return a.withColumn("score", F.col("useful_weight") - F.col("negative_weight")).withColumn("status", status).drop("_last_useful", "_last_corrected")


def outcomes_by_file(verdicts: DataFrame, now: float, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """The same per file of the comma-separated ``file_refs``."""
    files = F.explode(F.filter(F.transform(F.split(F.coalesce("file_refs", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return outcomes(verdicts.withColumn("file", files), now, ["file"], half_life_days)


def rank_factor(status: Column, score: Column) -> Column:
    """Multiplier on relevance: a quarter when corrected, 1 without a standing, else 1 + tanh(score) / 2."""
    return F.when(status == "corrected", 0.25).when(status.isNull() | (status == "faded"), 1.0).otherwise(1.0 + 0.5 * F.tanh(score))


def recency_factor(age_seconds: Column, half_life_days: float, kind: Column, status: Column) -> Column:
    """Decay by a note's own age; standing instructions, glossary entries and confirmed notes do not fade."""
    if half_life_days <= 0:
        return F.lit(1.0)
    exempt = kind.isin("standing_instruction", "glossary") | status.isin("preferred", "useful")
    return F.when(F.coalesce(exempt, F.lit(False)), 1.0).otherwise(decay(age_seconds, half_life_days))


def list_tier(status: Column) -> Column:
    return F.when(status.isin("preferred", "useful"), 0).when(status == "dead_end", 2).when(status == "corrected", 3).otherwise(1)


def tiered_list(notes: DataFrame, standing: DataFrame, limit: int = 10, offset: int = 0, kind: str = "", tag: str = "") -> DataFrame:
    """Notes useful first, corrected last, newest first within a tier."""
    n = notes
    if kind:
        n = n.where(F.col("kind") == kind)
    if tag:
        n = n.where(F.array_contains(_tags(), tag))
    j = n.join(standing.select(F.col("entry_id").alias("id"), "status", "score"), "id", "left")
    return j.withColumn("tier", list_tier(F.col("status"))).orderBy("tier", F.desc("ts"), "id").offset(offset).limit(limit)


def _tags() -> Column:
    return F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), r"[,\s]+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def terms(notes: DataFrame, least: int = 1) -> DataFrame:
    """Tag frequencies, most frequent first."""
    return notes.select(F.explode(_tags()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "term")


def recall(notes: DataFrame, queries: DataFrame, standing: DataFrame | None = None, limit: int = 5, now: float | None = None, recency_half_life: float = 0.0) -> DataFrame:
    """Graded recall of notes for each query: ``query, doc, relevance, tier, ratio, rank``.

    Tier 0 has all words, tier 1 covers the query's stems in part, with words in
    title and tags weighing more than in the body.  Relevance is
    (3 - tier) + ratio / 2 + 0.49 * bm25 / (1 + bm25), times standing and age.
    """
    posts = postings(notes, "id", "title", "body", "tags")
    q = queries.select("query", F.explode(F.array_distinct(words("text"))).alias("term"))
    strict = bm25(posts, q).select("query", "doc", "score", F.lit(0).alias("tier"), F.lit(1.0).alias("ratio"))
    head = notes.select(F.col("id").alias("doc"), F.explode(F.array_distinct(F.transform(F.concat(words(F.coalesce("title", F.lit(""))), words(F.coalesce("tags", F.lit("")))), stem))).alias("s"), F.lit(1.0).alias("w"))
    body = notes.select(F.col("id").alias("doc"), F.explode(F.array_distinct(F.transform(words(F.coalesce("body", F.lit(""))), stem))).alias("s"), F.lit(0.6).alias("w"))
    qs = q.select("query", stem(F.col("term")).alias("s")).distinct()
    cover = qs.join(head.unionByName(body).groupBy("doc", "s").agg(F.max("w").alias("w")), "s").groupBy("query", "doc").agg(F.sum("w").alias("w"))
    need = qs.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    loose = cover.join(need, "query").select("query", "doc", (F.col("w") / F.col("need")).alias("ratio"))
    loose = loose.join(strict.select("query", "doc"), ["query", "doc"], "left_anti")
    scored = loose.join(bm25(posts, q, conjunctive=False).select("query", "doc", "score"), ["query", "doc"], "left").select("query", "doc", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).alias("tier"), "ratio")
    all_hits = strict.unionByName(scored)
    rel = (3 - F.col("tier")) + 0.5 * F.col("ratio") + 0.49 * F.col("score") / (1 + F.col("score"))
    if standing is not None:
        j = all_hits.join(standing.select(F.col("entry_id").alias("doc"), "status", F.col("score").alias("_s")), "doc", "left")
        age = F.lit(0.0)
        if recency_half_life > 0 and now is not None:
            j = j.join(notes.select(F.col("id").alias("doc"), "kind", F.col("ts").alias("_ts")), "doc")
            age = F.lit(now) - F.col("_ts")
            rel = rel * recency_factor(age, recency_half_life, F.col("kind"), F.col("status"))
        all_hits, rel = j, rel * rank_factor(F.col("status"), F.col("_s"))
    out = all_hits.withColumn("relevance", F.round(rel, 6)).select("query", "doc", "relevance", "tier", F.round("ratio", 6).alias("ratio"))
    # beside a confident hit, weak ones are dropped; alone, three of them stay
    best = Window.partitionBy("query")
    out = out.withColumn("_best", F.max("ratio").over(best))
    weak = (F.col("tier") == 1) & (F.col("ratio") < 0.34)
    out = out.where(~weak | (F.col("_best") < 0.34)).drop("_best")
    ranked = top_k(out, limit, "relevance")
    return ranked.where((F.col("rank") < 3) | ~((F.col("tier") == 1) & (F.col("ratio") < 0.34)))


def diagnose(notes: DataFrame, symptoms: DataFrame, least: float = 0.34, limit: int = 8) -> DataFrame:
    """Notes whose recorded symptom is the same or alike: ``query, doc, score, rank``.

    The same normalised symptom scores 1; else the Jaccard share of its words,
    found through shared words only.
    """
    n = notes.where(F.coalesce("symptom", F.lit("")) != "").select(F.col("id").alias("doc"), normalize_symptom("symptom").alias("norm"))
    n = n.withColumn("toks", symptom_tokens(F.col("norm")))
    q = symptoms.select("query", normalize_symptom("text").alias("qnorm")).withColumn("qtoks", symptom_tokens(F.col("qnorm")))
    nt = n.select("doc", F.size("toks").alias("n"), F.explode("toks").alias("t"))
    qt = q.select("query", F.size("qtoks").alias("m"), F.explode("qtoks").alias("t"))
    shared = qt.join(nt, "t").groupBy("query", "doc", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    alike = shared.select("query", "doc", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("score")).where(F.col("score") >= least)
    same = q.join(n, F.col("qnorm") == F.col("norm")).select("query", "doc", F.lit(1.0).alias("score"))
    return top_k(alike.unionByName(same).groupBy("query", "doc").agg(F.max("score").alias("score")), limit)


def supersede_candidates(notes: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of notes of one kind whose title words overlap by ``least``: ``newer, older, score``; found through shared words."""
    t = notes.select("id", "kind", "ts", F.array_distinct(words(F.coalesce("title", F.lit("")))).alias("w")).where("size(w) > 0")
    # only words that few notes have bind a pair: a pair over the threshold shares more than its common words
    x = t.select("id", "kind", "ts", F.size("w").alias("n"), F.explode("w").alias("t"))
    df = x.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("id").orderBy("df", "t")
    keep = F.col("pos") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    prefix = x.join(df, "t").withColumn("pos", F.row_number().over(w)).where(keep).select("id", "kind", "t")
    cand = prefix.alias("a").join(prefix.alias("b"), (F.col("a.t") == F.col("b.t")) & F.col("a.kind").eqNullSafe(F.col("b.kind")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    a, b = t.select(F.col("id").alias("x"), F.col("w").alias("wa"), F.col("ts").alias("ta")), t.select(F.col("id").alias("y"), F.col("w").alias("wb"), F.col("ts").alias("tb"))
    s = cand.join(a, "x").join(b, "y").withColumn("score", jaccard(F.col("wa"), F.col("wb"))).where(F.col("score") >= least)
    newer = (F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("x") > F.col("y")))
    return s.select(F.when(newer, F.col("x")).otherwise(F.col("y")).alias("newer"), F.when(newer, F.col("y")).otherwise(F.col("x")).alias("older"), "score")


def chain_ends(notes: DataFrame) -> DataFrame:
    """The note that finally stands for each superseded one: ``id, current, hops``, by pointer doubling until no pointer moves.

    A note that leads into a circle of notes has no end: ``current`` is null.  Steps
    double each round, so what still moves once they are longer than any chain is on a
    circle.
    """
    p = notes.select("id", F.col("superseded_by").alias("to")).where("to is not null")
    cur = cut(notes.groupBy("id").agg(F.max("superseded_by").alias("to")).select("id", F.coalesce("to", "id").alias("current"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("hops")))
    reach, total = 1, cur.count()
    while True:
        nxt = cur.select(F.col("id").alias("current"), F.col("current").alias("_c"), F.col("hops").alias("_h"))
        step = cut(cur.join(nxt, "current", "left").select("id", F.coalesce("_c", "current").alias("current"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), (F.coalesce("_h", F.lit(0)) > 0).alias("moved")))
        cur, reach = step.select("id", "current", "hops"), 2 * reach
        open_ = step.where("moved")
        if open_.isEmpty():
            break
        if reach > 2 * total:
            circle = open_.select("id", F.lit(True).alias("_circle"))
            cur = cur.join(circle, "id", "left").select("id", F.when(F.col("_circle"), None).otherwise(F.col("current")).alias("current"), F.when(F.col("_circle"), None).otherwise(F.col("hops")).alias("hops"))
            break
    return cur.join(p.select("id").distinct(), "id", "left_semi")


def promote(notes: DataFrame, target: DataFrame) -> DataFrame:
    """Notes copied to another namespace, but for those whose title and body stand there already."""
    key = F.sha2(F.concat_ws("\x00", F.lower(F.trim("title")), F.trim("body")), 256)
    have = target.select(key.alias("_k")).distinct()
    return notes.withColumn("_k", key).dropDuplicates(["_k"]).join(have, "_k", "left_anti").drop("_k")


def entry_list(entries: DataFrame, limit: int | None = None, **where: str) -> DataFrame:
    """Notes or plans of given field values, newest first, then by path."""
    for c, v in where.items():
        e = F.coalesce(F.col(c), F.lit(""))
        entries = entries.where(e != "" if v == "*" else e == v)
    out = entries.orderBy(F.desc("mtime"), "path")
    return out.limit(limit) if limit else out


def dead_ends(notes: DataFrame, standing: DataFrame, limit: int = 20) -> DataFrame:
    """Notes that led nowhere, the worst score first."""
    s = standing.where(F.col("status").isin("dead_end", "corrected")).select(F.col("entry_id").alias("id"), "status", "score", "last_ts", "last_note")
    return notes.join(s, "id").orderBy("score", F.desc("last_ts"), "id").limit(limit)
