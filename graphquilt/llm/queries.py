"""Queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import chunks, docpairs, mixing, nonsource, packing, percentiles, pii, readability, secrets

Query = Callable[[SparkSession, str], DataFrame]


def _p1(s: SparkSession, d: str) -> DataFrame:
    return secrets.redact(table(s, d, "findings"))


def _p4(s: SparkSession, d: str) -> DataFrame:
    return pii.scan(table(s, d, "memory_entries"), table(s, d, "plan_entries"), table(s, d, "given_name"), pii.session_key(s))


def _p5(s: SparkSession, d: str) -> DataFrame:
    return nonsource.classify(table(s, d, "file_node"), table(s, d, "source_blob"))


def _p6(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(s, d, "function_node"), table(s, d, "file_node"), table(s, d, "source_blob")


def _p10(s: SparkSession, d: str) -> DataFrame:
    return readability.levels(table(s, d, "documents"), table(s, d, "reading_label"))


def _p2_merged(s: SparkSession, d: str) -> DataFrame:
    days = percentiles.summary(percentiles.values(table(s, d, "call_log")), ["tool", "day"])
    return percentiles.estimate(percentiles.merge(days, ["tool"]), ["tool"])


#: Shares of the languages in the tree of ``p9_tree``; the sources below share by ``mix_target``.
LANGUAGES = (("en", 0.5), ("de", 0.2), ("fr", 0.15), ("es", 0.15))


def _tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents drawn down a tree of language and source, sizes in code points, half of all there is: German, French and Spanish fall short."""
    lang = F.lower(F.substring(F.coalesce("lang", F.lit("none")), 1, 2))
    docs = table(s, d, "documents").select("doc_id", F.concat_ws("/", lang, F.coalesce("source", F.lit("none"))).alias("source"), "text")
    share = s.createDataFrame(list(LANGUAGES), "lang string, share double")
    targets = table(s, d, "mix_target").crossJoin(F.broadcast(share)).select(F.concat_ws("/", "lang", "source").alias("source"), (F.col("weight") * F.col("share")).alias("weight"), "max_repeat")
    size = F.length("text")
    # one row; the draw itself needs the amount as a number
    total = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").distinct().agg(F.sum(size)).first()[0] or 0
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("n_tokens").cast("string"))), 1, 15), 16, 10).cast("long")
    return mixing.draw(docs, targets, total // 2, size=size, order=order)


def queries() -> dict[str, Query]:
    """Every query of the ten problems that live here."""
    return {
        "p1_found": lambda s, d: secrets.found(_p1(s, d)),
        "p1_redacted": lambda s, d: _p1(s, d).select("id", "n_secrets", "redacted"),
        "p2_percentiles": lambda s, d: percentiles.report(table(s, d, "call_log")),
        "p2_summary": lambda s, d: percentiles.summary(percentiles.values(table(s, d, "call_log")), ["tool", "day"]).select("metric", "tool", "day", "bucket", "n"),
        "p2_merged": lambda s, d: _p2_merged(s, d).select("metric", "tool", "p", "n", F.round("value", 6).alias("value"), "relative_error"),
        "p3_found": lambda s, d: chunks.found(chunks.pieces(table(s, d, "fetched_chunks"))),
        "p3_pieces": lambda s, d: chunks.pieces(table(s, d, "fetched_chunks")).where("latest"),
        "p4_found": lambda s, d: pii.found(_p4(s, d)),
        "p4_redacted": lambda s, d: _p4(s, d).select("entry_table", "path", "redacted"),
        "p5_found": lambda s, d: nonsource.found(_p5(s, d)),
        "p5_classified": _p5,
        "p6_found": lambda s, d: docpairs.documented(*_p6(s, d)).select("id"),
        "p6_pairs": lambda s, d: docpairs.pairs(*_p6(s, d)),
        "p8_containers": lambda s, d: packing.pack(table(s, d, "documents")),
        "p8_fill": lambda s, d: packing.fill(packing.pack(table(s, d, "documents"))),
        "p8_variable": lambda s, d: packing.fill(packing.pack(table(s, d, "documents"), [512, 1024, 2048, 4096])),
        "p9_drawn": lambda s, d: mixing.draw(table(s, d, "documents"), table(s, d, "mix_target"))[0],
        "p9_shares": lambda s, d: mixing.draw(table(s, d, "documents"), table(s, d, "mix_target"))[1],
        "p9_tree": lambda s, d: _tree(s, d)[0],
        "p9_tree_shares": lambda s, d: _tree(s, d)[1].select("source", F.round("target_share", 9).alias("target_share"), "available", F.round("budget", 3).alias("budget"), "drawn_tokens", "n_docs", F.round("share", 9).alias("share")),
        "p10_found": lambda s, d: readability.found(_p10(s, d)),
        "p10_levels": lambda s, d: _p10(s, d).select("doc_id", "language", "n_words", F.round("grade", 3).alias("grade"), "level", F.round("share_5", 6).alias("share_5")),
    }


_PERCENTILES = """
with c as (select distinct id, tool, "timestamp", latency_ms, result_size from call_log),
v as (
  select 'latency_ms' as metric, tool, cast(make_timestamp(cast("timestamp" * 1000000 as bigint)) as date) as day, latency_ms as v, cast(null as bigint) as exact from c
  union all
  select 'result_size', tool, cast(make_timestamp(cast("timestamp" * 1000000 as bigint)) as date), cast(result_size as double), result_size from c
),
w as (select * from v where v is not null and not isnan(v)),
g as (
  select metric, tool, cast(null as date) as day, 'tool' as level, v, exact from w
  union all select metric, tool, day, 'day', v, exact from w
),
r as (
  select *, row_number() over (partition by level, metric, tool, day order by v, exact) - 1 as k,
         count(*) over (partition by level, metric, tool, day) as n
  from g
),
t as (
  select r.*, p, (n - 1) * p as pos
  from r cross join (values (0.5::double), (0.9::double), (0.95::double), (0.99::double), (0.999::double)) as q(p)
),
s as (
  select level, metric, tool, day, p, n, pos - floor(pos) as frac,
         max(case when k = floor(pos) then v end) as lower_stat, max(case when k = ceil(pos) then v end) as upper_stat,
         max(case when k = floor(pos) then exact end) as lower_exact, max(case when k = ceil(pos) then exact end) as upper_exact
  from t where k in (floor(pos), ceil(pos)) group by all
)
select metric, tool, p, n, lower_stat, upper_stat, lower_exact, upper_exact,
       case when lower_stat = upper_stat then lower_stat
            else lower_stat + coalesce(cast(upper_exact - lower_exact as double), upper_stat - lower_stat) * frac end as value,
       level, day
from s
"""


_VALUES = _PERCENTILES[: _PERCENTILES.index("g as (")].rstrip().rstrip(",")
_GAMMA = (1 + percentiles.ALPHA) / (1 - percentiles.ALPHA)
_SUMMARY = f"""{_VALUES},
b as (select metric, tool, day, case when isinf(v) then sign(v) * 1.7e308 else v end as v from w),
k as (select *, (ceil(ln(abs(v)) / {math.log(_GAMMA)!r}) + 100000)::bigint as kk from b where abs(v) >= 1e-9 union all select *, 0 from b where abs(v) < 1e-9),
s as (select metric, tool, day, case when v < 0 then -kk else kk end as bucket, count(*) as n from k group by all)
"""
_MERGED = _SUMMARY + f""", m as (select metric, tool, bucket, sum(n) as n from s group by all),
cu as (select *, sum(n) over (partition by metric, tool order by bucket) as upto, sum(n) over (partition by metric, tool) as total from m),
t as (select * from cu cross join (values (0.5::double), (0.9::double), (0.95::double), (0.99::double), (0.999::double)) as q(p))
select metric, tool, p, total::bigint as n, round(case when bucket = 0 then 0.0 else sign(bucket) * pow({_GAMMA!r}, abs(bucket) - 100000) * {2 / (_GAMMA + 1)!r} end, 6) as value, {percentiles.ALPHA}::double as relative_error
from t where floor((total - 1) * p) >= upto - n and floor((total - 1) * p) < upto"""

_BUDGETS = """
with share(lang, share) as (values """ + ", ".join(f"('{k}', {v}::double)" for k, v in LANGUAGES) + """),
tg as (select lang, lang || '/' || source as source, sum(weight * share) as weight, max(max_repeat) as max_repeat from mix_target cross join share where source is not null group by 1, 2),
docs as (select distinct doc_id, lower(substr(coalesce(lang, 'none'), 1, 2)) || '/' || coalesce(source, 'none') as source, length(text) as n_tokens, text from documents),
d as (select doc_id, source, n_tokens from docs where n_tokens > 0 and source in (select source from tg)),
have as (select source, sum(n_tokens) as n from d group by 1),
total as (select floor(coalesce(sum(length(text)), 0) / 2) as amount from docs where source in (select source from tg)),
leaf as (select tg.*, coalesce(n, 0)::bigint as n, (coalesce(n, 0) * greatest(0, coalesce(max_repeat, 0)))::double as cap from tg left join have using (source)),
node as (select lang, sum(weight) as weight, sum(cap) as cap from leaf where weight > 0 group by 1),
-- a level fills all children to one ratio of weight, those below it to their capacity
na as (select *, cap / weight as r, coalesce(sum(cap) over (order by cap / weight, lang rows between unbounded preceding and 1 preceding), 0) as c0, sum(weight) over (order by cap / weight, lang rows between current row and unbounded following) as w0 from node),
nl as (select coalesce(max(case when (amount - c0) / w0 <= r then (amount - c0) / w0 end), 1e300) as level from na, total),
nb as (select lang, least(cap, level * weight) as amount from node, nl),
la as (select l.*, nb.amount, cap / weight as r, coalesce(sum(cap) over (partition by lang order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) as c0, sum(weight) over (partition by lang order by cap / weight, source rows between current row and unbounded following) as w0 from leaf l join nb using (lang) where weight > 0),
ll as (select lang, coalesce(max(case when (amount - c0) / w0 <= r then (amount - c0) / w0 end), 1e300) as level from la group by 1),
lb as (select la.source, la.n, la.max_repeat, la.weight, least(cap, level * weight) as budget from la join ll using (lang)),
plan as (select *, case when n > 0 then least(floor((budget + 1e-6) / n)::int, coalesce(max_repeat, 0)) else 0 end as full_ from lb),
x as (select d.*, full_, floor(budget + 1e-6)::bigint - full_ * p.n as rest, sum(n_tokens) over (partition by d.source order by ('0x' || substr(md5(doc_id::varchar || '|' || n_tokens::varchar), 1, 15))::bigint, doc_id, n_tokens rows unbounded preceding) as run from d join plan p using (source)),
drawn as (select doc_id, source, n_tokens, (full_ + case when rest > 0 and run <= rest then 1 else 0 end)::int as repeats from x)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL expresses; the others are tested against brute force, round trips or held-out data."""
    return {
        "p2_percentiles": _PERCENTILES,
        "p2_summary": _SUMMARY + "select metric, tool, day, bucket, n from s",
        "p2_merged": _MERGED,
        "p9_tree": _BUDGETS + "select doc_id, source, n_tokens, repeats from drawn where repeats > 0",
        "p9_tree_shares": _BUDGETS
        + "select t.source, round(t.weight / (select sum(weight) from tg where weight > 0), 9) as target_share, coalesce(p.n, 0)::bigint as available, round(coalesce(p.budget, 0), 3) as budget, coalesce(g.tokens, 0)::bigint as drawn_tokens, coalesce(g.docs, 0)::bigint as n_docs, round(coalesce(g.tokens, 0)::double / (select sum(n_tokens * repeats) from drawn), 9) as share from tg t left join plan p using (source) left join (select source, sum(n_tokens * repeats) as tokens, count(*) as docs from drawn where repeats > 0 group by 1) g using (source)",
        "p3_found": "select distinct url, chunk_no from fetched_chunks where length(text) > 1500",
    }
