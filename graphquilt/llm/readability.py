"""Reading level of the prose of each document (problem 10).

Markup, code, headings, lists of names and short boilerplate are taken out; each
remaining sentence gets five classic grade estimates (Flesch-Kincaid, automated
readability index, Gunning fog, LIX, Linsear write) from its length in words,
letters and hyphenation-style syllables, combined by their median.  (SMOG and
Coleman-Liau are defined on samples of 30 sentences or 100 words, not on one.)  The level of a document is the band of the word-weighted median of its
sentences; it is demanding as a whole when more than half of its prose words
stand in sentences of band 5.

Grades become bands 1..5 at four cuts per language, fitted to the hand labels
(at most ``MOST_LABELS`` of them by hash order, a documented bound) with a pull
towards the default cuts, so that few labels move them little.  The language is
told from function words, since ``lang`` is often wrong.

Defined results: null, empty and prose-free texts have no level; commits,
changelogs and source code have none either; a null source is judged by its
text; repeated doc_id rows give the row of the longest text (ties by text);
null bands are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable, materialise
from .hyphens import syllables

MOST_LABELS = 50_000
NO_BAND = ("commit", "changelog", "source_code")
#: Cuts between bands in grades, from labels of the corpus at the smallest scale; the fit starts here.
CUTS = {"en": (5.0, 8.0, 13.0, 20.0), "de": (6.0, 8.5, 12.5, 22.0), "fr": (5.0, 8.0, 14.0, 22.0), "es": (5.0, 8.0, 14.0, 22.0), "nl": (6.0, 8.5, 12.5, 22.0), "zh": (5.0, 8.0, 14.0, 22.0), "ja": (5.0, 8.0, 14.0, 22.0), "ko": (5.0, 8.0, 14.0, 22.0)}

# Function words that tell the languages apart.
_FUNCTION_WORDS = {
    "en": frozenset("the a an and of to is in it that for this by with from as not we you be are on at its which or if".split()),
    "de": frozenset("der die das und ist ein eine nicht den dem des zu mit von im wir sich auf für wird als auch werden einen einer durch jede jeder".split()),
    "fr": frozenset("le la les et est un une des du de que qui dans il pour ce sur avec pas au aux dont cette ne se nous chaque".split()),
    "es": frozenset("el la los las y es un una de del que en por con para no se al lo como cuyo esta este hay cada usamos".split()),
    "nl": frozenset("de het een en van is dat niet in op te zijn met voor die er aan ook als wordt bij".split()),
}

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_TAG = re.compile(r"</?[a-zA-Z][^>\n]{0,300}>")
_URL = re.compile(r"(?:https?|ftp)://\S+|www\.\S+")
_INLINE = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]*)?")
_END = re.compile(r"(?<!\be\.g)(?<!\bi\.e)(?<!\bz\.B)(?<!\bbzw)(?<!\betc)(?<!\bcf)[.!?…]+[\"'”’)\]]*(?=\s|$)|[。！？]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CODEY = re.compile(r"[_\\/{}<>=@#$|]|\w\.\w|[a-z][A-Z]|\w\(|\d|::|--")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_CLAUSE = re.compile(r"[，、；：,;]")


def language(words: list[str]) -> str:
    """The language most of whose function words occur; English when none does.  Text mostly in Han, kana or Hangul is told by its script."""
    wide = sum(1 for w in words if _CJK.search(w))
    if wide:
        text = "".join(words)
        n = len(_CJK.findall(text))
        if 3 * n > sum(c.isalpha() for c in text):
            kana, hangul = len(re.findall(r"[\u3040-\u30ff]", text)), len(re.findall(r"[\uac00-\ud7af]", text))
            return "ko" if 2 * hangul > n else "ja" if 10 * kana > n else "zh"
    seen = Counter(w.strip(".,;:!?()\"'").lower() for w in words)
    return max(_FUNCTION_WORDS, key=lambda k: (sum(seen[w] for w in _FUNCTION_WORDS[k]), k == "en"))


def blocks(text: str) -> Iterator[str]:
    """Paragraphs and list items of running prose, code, headings and tables left out."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n\n", t)
    if "&" in t:
        t = html.unescape(t)
    t = t.replace("\xa0", " ")
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    para: list[str] = []
    first = True
    for line in [*t.split("\n"), ""]:
        s = line.strip()
        heading = s.startswith("#") or re.fullmatch(r"[=\-*_~ ]{3,}", s) is not None or s.startswith("|")
        item = _ITEM.match(line)
        if not s or heading or item or line.startswith(("    ", "\t")) and not para:
            if para:
                yield " ".join(para)
                para = []
        if s and not heading:
            if item:
                para = [line[item.end() :].strip()]
            elif not (first and len(s.split()) <= 6 and s[-1] not in ".!?…。！？"):
                para.append(s)
        if s:
            first = False


def sentences(block: str) -> Iterator[str]:
    at = 0
    for m in _END.finditer(block):
        yield block[at : m.end()]
        at = m.end()
    if block[at:].strip():
        yield block[at:]


def counts(sentence: str, lang: str) -> tuple[int, int, int, int, int] | None:
    """(words, letters, syllables, words of three or more syllables, words over six letters), or None for code and boilerplate."""
    s = sentence
    if "`" in s:
        s = _INLINE.sub(" x_x ", s)
    if "://" in s or "www." in s:
        s = _URL.sub(" x_x ", s)
    if lang in ("zh", "ja", "ko"):
        n = len(_CJK.findall(s))
        # two characters make about a word; clauses stand for what long words are elsewhere
        return None if n < 6 or 2 * n < sum(not c.isspace() for c in s) else (max(1, n // 2), n, n, -(1 + len(_CLAUSE.findall(s))), n)
    toks = s.split()
    known = _TOKENS.setdefault(lang, {})
    n = letters = syl = poly = long = codey = 0
    for t in toks:
        c = known.get(t)
        if c is None:
            if len(known) > 300_000:
                known.clear()
            c = known[t] = _weigh(t, lang)
        if c[0] < 0:
            codey += 1
        else:
            n += c[0]
            letters += c[1]
            syl += c[2]
            poly += c[3]
            long += c[4]
    if n < 3 or codey * 4 >= len(toks) or codey and n < 6:
        return None
    return n, letters, syl, poly, long


_TOKENS: dict[str, dict[str, tuple[int, int, int, int, int]]] = {}


def _weigh(token: str, lang: str) -> tuple[int, int, int, int, int]:
    """What a token adds to the counts of its sentence; (-1, ...) for code."""
    if _CODEY.search(token.strip(".,;:!?()\"'")):
        return -1, 0, 0, 0, 0
    words = _WORD.findall(token)
    syl = [syllables(w, lang) for w in words]
    return len(words), sum(map(len, words)), sum(syl), sum(1 for x in syl if x >= 3), sum(1 for w in words if len(w) > 6)


def grade(n: int, letters: int, syl: int, poly: int, long: int) -> float:
    """Median of the estimates for one sentence; for Han, kana and Hangul (marked by a negative ``poly``, the clauses) those of sentence and clause length."""
    if poly < 0:
        return median((0.5 * n, 0.39 * n + 2, letters / -poly))
    linsear = n + 2 * poly
    return median(
        (
            0.39 * n + 11.8 * syl / n - 15.59,
            4.71 * letters / n + 0.5 * n - 21.43,
            0.4 * (n + 100 * poly / n),
            (n + 100 * long / n - 15) / 3.5,
            linsear / 2 if linsear > 20 else linsear / 2 - 1,
        )
    )


def analyse(text: str | None) -> tuple[str | None, int, list[tuple[float, int]]]:
    """(language, prose words, [(grade in half steps, words)]) of a text."""
    if not text:
        return None, 0, []
    parts = [list(sentences(b)) for b in blocks(text)]
    lang = language([w for b in parts for s in b for w in s.split()])
    hist: dict[float, int] = {}
    for b in parts:
        own = sorted((max(-5.0, min(80.0, grade(*c))), c[0]) for c in (counts(s, lang) for s in b) if c)
        mid = middle(own)
        for g, n in own:
            # a sentence is read with its paragraph: half its own grade, half the paragraph's median
            g = round(g + mid) / 2
            hist[g] = hist.get(g, 0) + n
    return (lang if hist else None), sum(hist.values()), sorted(hist.items())


def middle(hist: list[tuple[float, int]]) -> float | None:
    """The word-weighted median grade."""
    total, run = sum(w for _, w in hist), 0
    for g, w in hist:
        run += w
        if 2 * run >= total:
            return g
    return None


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("grade", T.DoubleType()),
        T.StructField("hist", T.ArrayType(T.StructType([T.StructField("g", T.DoubleType()), T.StructField("w", T.IntegerType())]))),
    ]
)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, src, text in zip(pdf.doc_id, pdf.source, pdf.text, strict=True):
            lang, n, hist = analyse(text)
            rows.append((i, src, lang, n, middle(hist), [{"g": g, "w": w} for g, w in hist]))
        yield pd.DataFrame(rows, columns=[f.name for f in _OUT])


def fit_cuts(labels: list[tuple[str, int, float]], weights: list[int] | None = None) -> dict[str, tuple[float, ...]]:
    """Cuts per language: fewest misplaced labels at each cut, pulled towards the default; ``weights`` are how often each label occurs."""
    out = {}
    for lang, default in CUTS.items():
        mine = [(b, g, n) for (k, b, g), n in zip(labels, weights or [1] * len(labels), strict=True) if k == lang]
        cuts = []
        for i, d in enumerate(default):
            # a label beyond the cut's two bands says nothing more than one beside it
            options = sorted({d, *(g + 0.25 for _, g, _ in mine)})
            best = min(options, key=lambda c: (sum(n * ((g >= c) != (b > i + 1)) for b, g, n in mine) + 0.5 * abs(c - d), abs(c - d)))
            cuts.append(best)
        for i in range(1, 4):
            cuts[i] = max(cuts[i], cuts[i - 1])
        out[lang] = tuple(cuts)
    return out


def _cut(lang: Column, cuts: dict[str, tuple[float, ...]], i: int) -> Column:
    c = F.lit(cuts["en"][i])
    for k, v in cuts.items():
        c = F.when(lang == k, F.lit(v[i])).otherwise(c)
    return c


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per doc_id: ``doc_id, source, language, n_words, grade, level, share_5``."""
    importable(documents.sparkSession)
    d = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    d = d.groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text", "source")).alias("r")).select("doc_id", "r.source", "r.text")
    a = materialise(d.mapInPandas(_run, _OUT), "levels")
    lab = labels.where(F.col("band").between(1, 5) & F.col("doc_id").isNotNull()).select("doc_id", "band")
    lab = lab.orderBy(F.xxhash64("doc_id", "band"), "doc_id", "band").limit(MOST_LABELS)
    pairs = a.where(F.col("grade").isNotNull()).join(lab, "doc_id").select("language", "band", "grade")
    # one row per distinct (language, band, half grade): a few hundred whatever the data
    cells = pairs.groupBy("language", "band", "grade").count().collect()
    cuts = fit_cuts([(r.language, r.band, r.grade) for r in cells], [r["count"] for r in cells])
    banded = F.coalesce(F.col("source"), F.lit("")).isin(*NO_BAND) | F.col("grade").isNull()
    level = sum(((F.col("grade") >= _cut(F.col("language"), cuts, i)).cast("int") for i in range(4)), F.lit(1))
    hard = F.aggregate("hist", F.lit(0), lambda acc, x: acc + F.when(x["g"] >= _cut(F.col("language"), cuts, 3), x["w"]).otherwise(0))
    return a.select("doc_id", "source", "language", "n_words", F.when(~banded, F.col("grade")).alias("grade"), F.when(~banded, level).alias("level"), F.when(~banded, hard / F.col("n_words")).alias("share_5"))


def found(levelled: DataFrame) -> DataFrame:
    return levelled.where(F.col("share_5") > 0.5).select("doc_id")
