"""Splitting oversized texts at natural boundaries (problem 3).

Recursive bisection: a core that exceeds ``limit - overlap`` is cut at the
strongest boundary near its midpoint (paragraph, line, sentence, clause, word,
else a grapheme edge) and both halves recurse; afterwards each piece but the
first takes the last ``overlap`` characters of what precedes it (fewer only where
that would open with half a grapheme).  The cores of one text concatenate to the text.

Only rows over the limit go to Python; the rest stay JVM-side as one piece.

Defined results: lengths are Unicode code points; a null text gives no piece, an
empty text one empty piece; (url, chunk_no) stored twice with one text counts
once, stored with several texts every text is cut, told apart by ``variant`` (md5 of the
text), and ``latest`` marks the last fetch (ties by the greater variant); null url or chunk_no are kept
as their own keys; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_left_join
from ..session import importable

LIMIT = 1500
OVERLAP = 150

#: Boundaries from strongest to weakest; a cut falls behind the match.
_LEVELS = (
    re.compile(r"\r?\n(?:[ \t]*\r?\n)+"),
    re.compile(r"\r?\n"),
    re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|[。！？]"),
    re.compile(r"[;:,]\s+|[、，；：]"),
    re.compile(r"\s+"),
)
_EXTEND = re.compile(r"[̀-ͯ᪰-᫿⃐-⃿︀-️︠-︯‍\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]")


def _is_edge(text: str, i: int) -> bool:
    """Whether position ``i`` may be cut: not inside CRLF, a combining or a joined sequence, a flag pair."""
    if i <= 0 or i >= len(text):
        return True
    if text[i] == "\n" and text[i - 1] == "\r":
        return False
    if _EXTEND.match(text[i]) or text[i - 1] == "‍":
        return False
    if "\U0001f1e6" <= text[i] <= "\U0001f1ff":
        k = i
        while k > 0 and "\U0001f1e6" <= text[k - 1] <= "\U0001f1ff":
            k -= 1
        return (i - k) % 2 == 0
    return True


def _edge_near(text: str, i: int, lo: int, hi: int) -> int:
    """The allowed position nearest to ``i`` in [lo, hi]; ``i`` itself if a cluster fills the range."""
    for d in range(0, max(i - lo, hi - i) + 1):
        if i - d >= lo and _is_edge(text, i - d):
            return i - d
        if i + d <= hi and _is_edge(text, i + d):
            return i + d
    return i


def cut_point(text: str, start: int, end: int) -> int:
    """The cut of text[start:end]: strongest boundary within a quarter of the length around the midpoint, then the nearest."""
    mid, reach = (start + end) // 2, max(1, (end - start) // 4)
    lo, hi = max(start + 1, mid - reach), min(end - 1, mid + reach)
    for level in _LEVELS:
        best = None
        for m in level.finditer(text, max(start, lo - 8), hi):
            at = m.end()
            if lo <= at <= hi and _is_edge(text, at) and (best is None or abs(at - mid) < abs(best - mid)):
                best = at
        if best is not None:
            return best
    return _edge_near(text, mid, lo, hi)


def cores(text: str, most: int) -> list[tuple[int, int]]:
    """Spans that tile the text, each of at most ``most`` code points."""
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most or b - a < 2:
            out.append((a, b))
            continue
        at = cut_point(text, a, b)
        todo += [(at, b), (a, at)]
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core start, end) of each piece: text[start:end] is within ``limit`` and text[core:end] tile the text."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out = []
    for a, b in cores(text, limit - overlap):
        s = max(0, a - overlap)
        if s:
            s = next((i for i in range(s, a + 1) if _is_edge(text, i)), a)
        out.append((s, a, b))
    return out


def pieces(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Numbered pieces per (url, chunk_no, variant): ``piece_no, n_pieces, start, core_start, end, piece``."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    importable(rows.sparkSession)
    null = F.lit("\x00")
    key = F.concat(F.coalesce("url", null), F.lit("\x01"), F.coalesce(F.col("chunk_no").cast("string"), null))
    r = rows.where(F.col("text").isNotNull()).groupBy("url", "chunk_no", "text").agg(F.max("fetched_at").alias("fetched_at"))
    r = r.withColumn("n", F.length("text")).withColumn("variant", F.md5("text")).withColumn("_k", key)
    last = r.groupBy("_k").agg(F.max(F.struct("fetched_at", "variant")).alias("_last")).select("_k", F.col("_last.variant").alias("_last"))
    r = salted_left_join(r, last, "_k", F.col("variant")).withColumn("latest", F.col("variant") == F.col("_last"))
    short = r.where(F.col("n") <= limit).select(
        "url", "chunk_no", "variant", "latest", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.lit(0).alias("core_start"), F.col("n").alias("end"), F.col("text").alias("piece")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["url", "chunk_no", "variant", "latest", "piece_no", "n_pieces", "start", "core_start", "end", "piece"]
        for pdf in batches:
            out = []
            for url, no, variant, latest, text in zip(pdf.url, pdf.chunk_no, pdf.variant, pdf.latest, pdf.text, strict=True):
                spans = split(text, limit, overlap)
                out += [(url, None if pd.isna(no) else int(no), variant, latest, k, len(spans), s, a, b, text[s:b]) for k, (s, a, b) in enumerate(spans)]
                if len(out) > 5000:
                    yield _frame(out, names)
                    out = []
            yield _frame(out, names)

    long = r.where(F.col("n") > limit).select("url", "chunk_no", "variant", "latest", "text").mapInPandas(run, short.schema)
    return short.unionByName(long)


def _frame(out: list, names: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(out, columns=names)
    f["chunk_no"] = f["chunk_no"].astype("Int64")
    return f


def found(cut: DataFrame) -> DataFrame:
    """Pairs of which a stored text had to be cut."""
    return cut.where("n_pieces > 1").select("url", "chunk_no").distinct()
