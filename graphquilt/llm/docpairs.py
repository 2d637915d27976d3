"""Functions paired with their documentation (problem 6).

A Python lexer turns each distinct blob into tokens, one row each: braces,
comments, strings that stand alone, heads of definitions, the line after a head
and, in languages of indentation, lines that step back.  From there on it is SQL: a
running sum over the brace rows of a blob gives the depth, gaps-and-islands over
comment rows group adjacent comment lines, ``lag`` hands the island above to the
definition below it, and a definition ends at the next brace that closes its level
or, by indentation, before the next line that steps back to it.

``pairs`` joins these with function_node: documentation is the stored docstring
or, where that is null, the comment directly above the first line or the string
or comment at the top of the body.

Defined results: a null id gives no row; a function without a blob keeps its
docstring and has null source; a blank docstring is documentation that says
nothing, never replaced by a comment; repeated rows give one row per id; lines
beyond the end of the file are ignored; texts may be of any length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import salted_left_join
from ..session import importable, materialise

_TOKEN = re.compile(
    r'''(?P<doc>"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\')|(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*|\#[^\n]*)'''
    r'''|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<open>\{)|(?P<close>\})|(?P<nl>\n)''',
    re.S,
)
_HEAD = re.compile(r"\b(?:def|func|fn|function|public|private|protected|static|async|export|class|pub|override|final|abstract|internal|interface|impl)\b")

_TOKENS = T.StructType(
    [
        T.StructField("git_blob_sha", T.StringType()),
        T.StructField("hashed", T.BooleanType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("first_line", T.IntegerType()),
        T.StructField("last_line", T.IntegerType()),
        T.StructField("indent", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def lex(body: str | None, hash_comments: bool) -> list[tuple]:
    """Tokens (seq, kind, first line, last line, indent, text) of kinds open, close, comment, string and code.

    A code row is a head of a definition (with its text), the line after one or,
    where blocks are indented, a line that steps back; its ``last_line`` is that of
    the code before it.  Braces in strings and comments are none, and blocks of
    indentation have no brace rows.
    """
    if not body:
        return []
    body = body.replace("\r\n", "\n").replace("\r", "\n")
    out: list[tuple] = []
    seq, line, at_start, begun, line_start, first_seq = 0, 1, True, 0, 0, 0
    before, depth_before, after_head = 0, 0, False  # the last code line, its indent, whether it was a head
    braces: list[tuple] = []

    def flush(end: int) -> None:
        """The code line that ends here, ahead of its braces."""
        nonlocal before, depth_before, after_head, seq
        if not at_start:
            raw = body[line_start:end].split("\n", 1)[0]
            head = _HEAD.search(raw) is not None
            indent = len(raw) - len(raw.lstrip())
            if head or after_head or (hash_comments and indent < depth_before):
                out.append((first_seq, "code", begun, before or begun, indent, raw.strip() if head else None))
            before, depth_before, after_head = line, indent, head
            out.extend(braces)
            braces.clear()

    def open_line() -> None:
        nonlocal at_start, begun, first_seq, seq
        at_start, begun, first_seq = False, line, seq
        seq += 1

    pos = 0
    for m in _TOKEN.finditer(body):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if at_start and body[pos:s].strip():
            open_line()
        if kind == "nl":
            flush(s)
            line, at_start, line_start, pos = line + 1, True, e, e
            continue
        if kind == "line" and body[s] == "#" and not hash_comments:
            kind = "other"
        n = body.count("\n", s, e)
        if at_start and kind in ("line", "block", "doc"):
            stop = body.find("\n", e)
            if kind != "doc" or not body[e : stop if stop >= 0 else len(body)].strip():
                indent = s - (body.rfind("\n", 0, s) + 1)
                out.append((seq, "string" if kind == "doc" else "comment", line, line + n, indent, m.group()))
                seq += 1
                line += n
                if n:
                    line_start = body.rfind("\n", 0, e) + 1
                pos = e
                continue
        if at_start:
            open_line()
        if kind in ("open", "close") and not hash_comments:
            braces.append((seq, kind, line, line, 0, None))
            seq += 1
        line += n
        pos = e
    if at_start and body[pos:].strip():
        open_line()
    flush(len(body))
    if before:
        out.append((seq, "end", before, before, 0, None))
    return out


def _lex_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in _TOKENS]
    for pdf in batches:
        out: list[tuple] = []
        for sha, hashed, body in zip(pdf.git_blob_sha, pdf.hashed, pdf.body, strict=True):
            out += [(sha, bool(hashed), *t) for t in lex(body, bool(hashed))]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)


#: Languages whose comments open with a hash and whose blocks are indented, by suffix.
HASHED = r"\.(py|pyi|rb|sh|bash|ya?ml|toml|tf|pl|r|jl|ex|exs|cfg|ini|mk)$"


def tokens(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Token rows of every distinct (blob, comment style)."""
    importable(files.sparkSession)
    used = files.where(F.col("git_blob_sha").isNotNull() & F.col("path").isNotNull()).select("git_blob_sha", F.lower("path").rlike(HASHED).alias("hashed")).distinct()
    b = blobs.where(F.col("git_blob_sha").isNotNull()).groupBy("git_blob_sha").agg(F.first("body", ignorenulls=True).alias("body"))
    return used.join(b, "git_blob_sha").mapInPandas(_lex_batches, _TOKENS)


def outline(toks: DataFrame) -> DataFrame:
    """Tokens with the depth of braces before them, and beside heads the comment island above and the text at the top of the body.

    Windows over the tokens of one blob only (one shuffle by blob serves all of
    them): running sum of the brace rows for the depth, islands of adjacent comments
    by lag and running sum, lag and lead to attach them.
    """
    key = ["git_blob_sha", "hashed"]
    w = Window.partitionBy(*key).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    t = toks.withColumn("depth", F.sum(step).over(upto)).withColumn("_p", F.lag(F.struct("kind", "last_line", "indent")).over(w))
    joined = (F.col("kind") == "comment") & (F.col("_p.kind") == "comment") & (F.col("_p.last_line") + 1 >= F.col("first_line")) & (F.col("_p.indent") == F.col("indent"))
    t = t.withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(upto)).drop("_p")
    # every row of an island knows its whole text
    of = Window.partitionBy(*key, "island")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "comment", F.struct("seq", "text"))).over(of)), lambda x: x["text"]), "\n")
    t = t.withColumn("whole", F.when(F.col("kind") == "comment", lines).when(F.col("kind") == "string", F.col("text")))
    # braces stand aside for what is above and below; the rows below are those above in the opposite order
    back = Window.partitionBy(*key).orderBy(F.desc("seq"))
    seen = F.when(F.col("kind").isin("comment", "string", "code"), F.struct("kind", "last_line", "indent", "depth", "whole"))
    near = t.withColumn("_above", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_below", F.last(seen, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.when(F.col("hashed"), F.col("_below.indent") > F.col("indent")).otherwise(F.col("_below.depth") > F.col("depth"))
    head = (F.col("kind") == "code") & F.col("text").isNotNull()
    return near.where(F.col("kind").isin("code", "close", "end")).select(
        *key,
        "seq",
        "kind",
        "first_line",
        "last_line",
        "indent",
        "depth",
        F.when(head, F.col("text")).alias("head"),
        F.when(head & (F.col("_above.kind") == "comment") & (F.col("_above.last_line") + 1 == F.col("first_line")), F.col("_above.whole")).alias("comment_above"),
        F.when(head & F.col("_below.kind").isin("comment", "string") & inside, F.col("_below.whole")).alias("top_of_body"),
    )


def delimit(lines: DataFrame) -> DataFrame:
    """Definition heads with the line on which each ends.

    A closing brace ends the levels at or above the depth it leaves, a line of code
    by indentation those at or above its indent, with the line of code before it.
    Each is exploded over the levels at which its blob has heads, a handful, and a
    head takes the next that ends its own level; a head whose surroundings close
    first has no body and ends on its own line.
    """
    key = ["git_blob_sha", "hashed"]
    blob = Window.partitionBy(*key)
    at = F.when(F.col("hashed"), F.col("indent")).otherwise(F.col("depth")).cast("int")
    head = F.col("head").isNotNull()
    x = lines.withColumn("at", at).withColumn("_levels", F.collect_set(F.when(head, at)).over(blob)).withColumn("_last", F.max("last_line").over(blob))
    ends = (F.col("kind") == "close") | (F.col("hashed") & (F.col("kind") == "code"))
    x = x.where(head | ends).withColumn("level", F.explode(F.filter("_levels", lambda v: (ends & (v >= F.col("at"))) | ((v == F.col("at")) & head))))
    mine = head & (F.col("level") == F.col("at"))
    closed = F.when(ends, F.struct(F.when(F.col("hashed"), F.col("last_line")).otherwise(F.col("first_line")).alias("line"), F.col("at").alias("to")))
    nxt = F.last(closed, ignorenulls=True).over(Window.partitionBy(*key, "level").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_next", nxt).where(mine)
    end = F.when(F.col("_next").isNull(), F.when(F.col("hashed"), F.col("_last")).otherwise(F.col("first_line"))).when(~F.col("hashed") & (F.col("_next.to") < F.col("at")), F.col("first_line")).otherwise(F.col("_next.line"))
    return x.select(*key, "first_line", "head", "comment_above", "top_of_body", end.alias("ends"))


# Documentation that says nothing, in the languages of the corpus.
EMPTY_WORDS = frozenset(
    "todo fixme xxx tbd tba wip na none null nil nothing docstring documentation doc docs missing no description desc pending pendiente folgt dokumentation documentacion documenter a faire por hacer hack stub placeholder undocumented getter setter constructor destructor method function func fn class helper helpers see above below same inherit inheritdoc override deprecated internal private public auto generated autogenerated region endregion noqa pylint type ignore eslint disable enable nolint noinspection author since version date copyright spdx license identifier the this that a an of to for and it its is are does do in on by with us any all no args arg arguments parameters params param returns return rtype yields raises throws throw see example examples note summary remarks document me later write add n coming soon fonction methode funktion funcion metodo klasse clase classe cette diese esta die der das le la les el los manquante fehlt falta sin keine pas comment not documented yet here".split()
)
_TAG_LINE = re.compile(
    r"^\s*(?:[:@\\](?:type|rtype|author|see|since|version|override|inheritdoc|deprecated|module|name|todo|private|public|internal|ignore|link|hidden|api)\b.*"
    r"|[:@\\](?:param|arg|argument|parameter|return|returns|raises|throws|exception|yields|yield)\b.*|(?:args|arguments|parameters|params|returns|return|raises|yields|attributes)\s*:?\s*"
    r"|\{@inherit[dD]oc\}.*|pylint:.*|noqa.*|type:\s*ignore.*|eslint-.*|nolint.*|spdx-license-identifier.*|(?:end)?region\b.*|copyright\b.*|-\*-.*-\*-|mypy:.*|fmt:.*|flake8:.*|isort:.*|@?ts-\w+.*|istanbul.*|prettier-.*|coding[:=].*)\s*$",
    re.I,
)
_CODE_LINE = re.compile(r"^\s*(?:[\w.\[\]]+\s*(?:[-+*/|&]?=)(?!=)\s*\S.*|[\w.]+\([^)]*\)\s*;?|(?:return|if|for|while|import|from|const|let|var|print|assert)\b.*[;:({=].*|[{}()\[\];]+)\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_SECTION_ITEM = re.compile(r"^\s*(?:\w+(?:\s*\([^)]*\))?\s*:\s*)$")
_GENERIC = re.compile(r"^(?:(?:this|the|a|an)\s+)?(?:function|method|func|procedure|routine|helper|class|constructor|getter|setter)s?\b\s*(?:(?:to|that|which|for|used to|is used to|will|does)\b)?\s*", re.I)


def strip_comment(text: str) -> str:
    """The words of a comment without its marks, quotes, tags of markup and decoration."""
    t = text.strip()
    if t[:3] in ('"""', "'''"):
        t = t[3:-3] if t.endswith(t[:3]) and len(t) >= 6 else t[3:]
    out = []
    for line in t.splitlines():
        x = line.strip()
        x = re.sub(r"^(?:/\*[*!]*|//[/!]*|#+!?|\*+/|\*(?!\*)|--+)\s?", "", x)
        x = re.sub(r"\*+/\s*$", "", x)
        x = re.sub(r"</?[a-zA-Z][\w:-]*(?:\s[^>]*)?/?>", " ", x)
        out.append(x.strip())
    return "\n".join(out).strip()


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def _parts(name: str) -> set[str]:
    """Words of an identifier, with simple forms of each."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name or "")]
    out = set(words)
    for w in words:
        out |= {w + "s", w + "es", w + "ed", w + "d", w + "ing", w[:-1] + "ing" if w.endswith("e") else w, w[:-1] + "ies" if w.endswith("y") else w, w + w[-1:] + "ing", w + w[-1:] + "ed", w.rstrip("s")}
    return out


def says_something(doc: str | None, name: str | None) -> bool:
    """Whether documentation tells more than the name, parameter names and formal tags."""
    if doc is None or not doc.strip():
        return False
    known = {_fold(x) for x in _parts(name or "")}
    fresh: list[str] = []
    block = ""
    for line in strip_comment(doc).splitlines():
        s = line.strip()
        if not s:
            block = ""
            continue
        m = re.match(r"^[:@\\](param|arg|argument|parameter|returns?|raises|throws|exception|yields?)\b(.*)$", s, re.I)
        if m:
            block = "tag"
            rest = re.sub(r"^\s*(\{[^}]*\})?\s*", "", m.group(2))
            rest = re.sub(r"^:?\s*" if m.group(1).lower()[:2] in ("re", "yi") else r"^[\w.\[\]$=*-]*\s*:?\s*[-–]?\s*", "", rest)
            continue
        if re.match(r"^(args|arguments|parameters|params|returns?|raises|yields?|attributes|throws|parametres|parameter|parametros)\s*:?\s*$", s, re.I):
            block = "section"
            continue
        if block and (line.startswith((" ", "\t")) or _SECTION_ITEM.match(line) or re.match(r"^\w+\s*(\([^)]*\))?\s*:", s) or block == "section"):
            continue
        block = ""
        if _TAG_LINE.match(s) or _CODE_LINE.match(s):
            continue
        s = re.sub(r"^(?:todo|fixme|xxx|hack)\b[:\s]*", "", s, flags=re.I)
        s = re.sub(r"^\[[^\]]*\]\s*", "", s)
        if name:
            s = re.sub(r"\b" + re.escape(name.split(".")[-1]) + r"\b(\(\))?", " ", s, flags=re.I)
        s = _GENERIC.sub("", s)
        for w in _WORD.findall(_fold(s)):
            if len(w) > 1 and w not in known and w not in EMPTY_WORDS:
                fresh.append(w)
        for c in s:
            if "぀" <= c <= "鿿" or "가" <= c <= "힯":
                fresh.append(c)
    return len(set(fresh)) >= 2


@F.pandas_udf(T.BooleanType())
def _says(doc: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([says_something(d, n) for d, n in zip(doc, name, strict=True)], dtype=bool)


def documented(functions: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row per function whose documentation says something: ``id, name, git_blob_sha, hashed, start_line, end_line, documentation, origin``."""
    importable(functions.sparkSession)
    fn = functions.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("name", "file_path", "start_line", "end_line", "docstring"), F.struct("indexed_at", "start_line")).alias("r")).select("id", "r.*")
    path = files.where(F.col("path").isNotNull()).groupBy(F.col("path").alias("file_path")).agg(F.max_by("git_blob_sha", F.struct("indexed_at", "git_blob_sha")).alias("git_blob_sha"))
    fn = salted_left_join(fn, path, "file_path", F.col("id")).withColumn("hashed", F.lower("file_path").rlike(HASHED))
    at = F.concat_ws("\x00", "git_blob_sha", "hashed", "first_line")
    heads = delimit(outline(tokens(files, blobs))).select(at.alias("_at"), F.col("comment_above"), F.col("top_of_body"), F.col("ends"))
    fn = fn.withColumn("_at", F.when(F.col("git_blob_sha").isNotNull(), F.concat_ws("\x00", "git_blob_sha", "hashed", F.col("start_line").cast("int"))))
    d = salted_left_join(fn, heads.dropDuplicates(["_at"]), "_at", F.col("id"))
    near = F.concat_ws("\n\n", "comment_above", "top_of_body")
    d = d.withColumn("documentation", F.when(F.col("docstring").isNotNull(), F.col("docstring")).when(near != "", near)).withColumn("origin", F.when(F.col("docstring").isNotNull(), "docstring").otherwise("comment"))
    d = d.withColumn("end_line", F.coalesce("end_line", "ends"))
    return d.where(F.col("documentation").isNotNull() & (F.trim("documentation") != "")).where(_says("documentation", "name")).select("id", "name", "git_blob_sha", "hashed", "start_line", "end_line", "documentation", "origin")


def pairs(functions: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Documented functions with their source lines; every blob is opened once for all its spans."""
    d = materialise(documented(functions, files, blobs), "documented")
    spans = d.where(F.col("git_blob_sha").isNotNull() & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))).groupBy("git_blob_sha").agg(F.collect_set(F.struct(F.col("start_line").cast("int").alias("a"), F.col("end_line").cast("int").alias("b"))).alias("spans"))
    b = blobs.where(F.col("git_blob_sha").isNotNull()).groupBy("git_blob_sha").agg(F.first("body", ignorenulls=True).alias("body"))
    cut = spans.join(b, "git_blob_sha").withColumn("lines", F.split("body", "\r\n|\n|\r"))
    cut = cut.select("git_blob_sha", F.explode(F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_join(F.slice("lines", s["a"], s["b"] - s["a"] + 1), "\n").alias("source")))).alias("s"))
    at = F.concat_ws("\x00", "git_blob_sha", F.col("start_line").cast("int"), F.col("end_line").cast("int"))
    cut = cut.select(F.concat_ws("\x00", "git_blob_sha", "s.a", "s.b").alias("_at"), "s.source")
    return salted_left_join(d.withColumn("_at", at), cut, "_at", F.col("id")).select("id", "name", "source", "documentation", "origin")
