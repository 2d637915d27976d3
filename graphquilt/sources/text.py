"""Documents, configuration, histories and pages as tables."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ignored, slugify, strip_rename
from ..session import importable
from .code import LANGUAGES

MOST_BYTES = 1_000_000


def blob_sha(content: Column) -> Column:
    """The sha git gives a content (binary): of the word blob, its length and itself."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\x00"), content))


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files below a folder that can be parsed: ``path`` (relative), ``mtime, body, git_blob_sha``.

    The sha is the one git gives the content.  Ignored, oversized and unknown
    files drop out before their content is read.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(re.sub(r"^[a-z]+:/*", "/", base)), "")
    suffix = F.lower(F.regexp_extract(rel, r"(\.[^./]+)$", 1))
    f = raw.withColumn("rel", rel).where((F.col("length") <= most_bytes) & suffix.isin(*LANGUAGES))
    if ignore:
        f = f.where(~ignored("rel", ignore))
    return f.select(F.col("rel").alias("path"), F.unix_micros("modificationTime").cast("double").alias("_us"), F.decode("content", "UTF-8").alias("body"), blob_sha(F.col("content")).alias("git_blob_sha")).select("path", (F.col("_us") / 1e6).alias("mtime"), "body", "git_blob_sha")


def changed_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """What differs between two snapshots by content: ``path, change`` (added, modified, deleted)."""
    a = stored.select("path", F.col("git_blob_sha").alias("old"))
    b = current.select("path", F.col("git_blob_sha").alias("new"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "path", "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return j.withColumn("change", change).where("change is not null").select("path", "change")


def lines(files: DataFrame, key: str = "path", text: str = "body") -> DataFrame:
    """``key, line, text`` of every line, numbered from 1."""
    return files.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_lines(files: DataFrame, path: str, start: int, end: int, most: int = 400) -> DataFrame:
    """Lines of one file in a range of at most ``most`` (the feature's cap)."""
    return lines(files.where(F.col("path") == path)).where(F.col("line").between(start, min(end, start + most - 1))).orderBy("line")


def sections(files: DataFrame, key: str = "path", text: str = "body", preview: int = 240) -> DataFrame:
    """Markdown headings as sections: ``key, title, level, anchor, start_line, end_line, body_preview``.

    Headings inside code fences do not count; a section ends before the next
    heading of its own or a higher level.  The end comes from a running minimum
    over the later headings of each level, per document.
    """
    l = lines(files, key, text)
    w = Window.partitionBy(key).orderBy("line")
    fence = F.col("text").rlike(r"^ {0,3}(```|~~~)")
    l = l.withColumn("_open", F.sum(F.when(fence, 1).otherwise(0)).over(w) % 2)
    l = l.withColumn("_last", F.max("line").over(Window.partitionBy(key)))
    h = l.where((F.col("_open") == 0) & ~fence & F.col("text").rlike(r"^ {0,3}#{1,6}[ \t]+\S"))
    h = h.withColumn("level", F.length(F.regexp_extract("text", r"^ {0,3}(#{1,6})", 1))).withColumn("title", F.trim(F.regexp_replace("text", r"^ {0,3}#{1,6}[ \t]+|[ \t]+#+[ \t]*$", "")))
    later = Window.partitionBy(key).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    end = F.least(*[F.when(F.col("level") >= k, F.coalesce(F.min(F.when(F.col("level") == k, F.col("line"))).over(later), F.col("_last") + 1)).otherwise(F.col("_last") + 1) for k in range(1, 7)])
    h = h.withColumn("end_line", end - 1).withColumn("next", F.coalesce(F.lead("line").over(w), F.col("_last") + 1))
    sec = h.select(key, F.col("line").alias("start_line"), "end_line", "level", "title", slugify("title").alias("anchor"), "next")
    doc = files.select(key, F.split(text, r"\r\n|\n|\r").alias("_l"))
    body = F.substring(F.trim(F.array_join(F.slice("_l", F.col("start_line") + 1, F.greatest(F.col("next") - F.col("start_line") - 1, F.lit(0))), "\n")), 1, preview)
    return sec.join(doc, key).withColumn("body_preview", body).drop("next", "_l")


def section_tree(secs: DataFrame, key: str = "path") -> DataFrame:
    """Parent heading of each: the last one before it with a lower level, ``key, start_line, parent_line``."""
    w = Window.partitionBy(key).orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.greatest(*[F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("start_line"))).over(w)) for k in range(1, 6)])
    # a shallower heading between closes a deeper one: the latest line of any lower level is the parent
    return secs.withColumn("parent_line", parent).select(key, "start_line", "parent_line")


def links(files: DataFrame, key: str = "path", text: str = "body") -> DataFrame:
    """Inline links outside code: ``key, line, label, target``."""
    l = lines(files, key, text)
    w = Window.partitionBy(key).orderBy("line")
    fence = F.col("text").rlike(r"^ {0,3}(```|~~~)")
    l = l.withColumn("_open", F.sum(F.when(fence, 1).otherwise(0)).over(w) % 2).where((F.col("_open") == 0) & ~fence)
    x = l.select(key, "line", F.explode(F.regexp_extract_all("text", F.lit(r"(?<!!)\[[^\]\n]*\]\([^)\s]+[^)]*\)"), F.lit(0))).alias("m"))
    return x.select(key, "line", F.regexp_extract("m", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("m", r"\]\(([^)\s]+)", 1).alias("target"))


def code_mentions(files: DataFrame, key: str = "path", text: str = "body") -> DataFrame:
    """Identifiers in backticks, distinct per document: ``key, name``."""
    m = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][\w.]*)(?:\([^`\n]*\))?`"), F.lit(1))
    return files.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(m)).alias("name"))


def symbol_mentions(files: DataFrame, functions: DataFrame, key: str = "path", text: str = "body") -> DataFrame:
    """Documents that name a function in backticks: ``key, to_id``."""
    m = code_mentions(files, key, text).withColumn("name", F.substring_index("name", ".", -1))
    return m.join(functions.select(F.col("id").alias("to_id"), "name"), "name").select(key, "to_id").distinct()


_CONF = T.StructType([T.StructField("path", T.StringType()), T.StructField("title", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("value_kind", T.StringType())])


def _strip_jsonc(text: str) -> str:
    return re.sub(r"\"(?:[^\"\\]|\\.)*\"|//[^\n]*|/\*.*?\*/", lambda m: m.group() if m.group()[0] == '"' else "", text, flags=re.S)


def config_keys(text: str | None, suffix: str) -> list[tuple[str, int, str]]:
    """Keys of the first two levels: (dotted key, level, kind of value)."""
    if not text:
        return []
    kind = lambda v: "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "scalar"
    try:
        data = json.loads(_strip_jsonc(text)) if suffix in (".json", ".jsonc") else tomllib.loads(text) if suffix == ".toml" else None
    except (ValueError, RecursionError):
        return []
    if suffix in (".yml", ".yaml"):
        out, top = [], ""
        for line in text.splitlines():
            m = re.match(r"^( {0,8}|\t)?(\"[^\"]+\"|'[^']+'|[\w./-]+)\s*:(?:\s+(.*)|)$", line)
            if not m or line.lstrip().startswith("#"):
                continue
            name, rest = m.group(2).strip("\"'"), (m.group(3) or "").split(" #")[0].strip()
            k = "object" if not rest else "list" if rest[0] == "[" else "object" if rest[0] == "{" else "scalar"
            if not m.group(1):
                top = name
                out.append((name, 1, k))
            elif top and len(m.group(1)) <= 4:
                out.append((f"{top}.{name}", 2, k))
        return out
    if not isinstance(data, dict):
        return []
    out = []
    for a, v in data.items():
        out.append((a, 1, kind(v)))
        if isinstance(v, dict):
            out += [(f"{a}.{b}", 2, kind(x)) for b, x in v.items()]
    return out


def config_sections(files: DataFrame) -> DataFrame:
    """Keys of JSON, TOML and YAML files: ``path, title, level, value_kind``."""
    importable(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *k) for p, b in zip(pdf.path, pdf.body, strict=True) for k in config_keys(b, p[p.rfind(".") :].lower())]
            yield pd.DataFrame(rows, columns=["path", "title", "level", "value_kind"])

    return files.where(F.lower("path").rlike(r"\.(jsonc?|toml|ya?ml)$")).select("path", "body").mapInPandas(run, _CONF)


_PKG = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "package", "version", "ecosystem", "dep_group", "dependency", "spec")])


def manifest_rows(text: str | None, name: str) -> list[tuple[str, str, str, str, str, str]]:
    """Packages and dependencies of package.json, pyproject.toml, Cargo.toml and requirements files."""
    out: list[tuple[str, str, str, str, str, str]] = []
    try:
        if name == "package.json":
            d = json.loads(text or "")
            pkg = (d.get("name") or "", d.get("version") or "", "npm")
            out.append((*pkg, "", "", ""))
            for g in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
                out += [(*pkg, g, k, str(v)) for k, v in (d.get(g) or {}).items()]
        elif name in ("pyproject.toml", "Cargo.toml"):
            d = tomllib.loads(text or "")
            p = d.get("project") or d.get("package") or (d.get("tool") or {}).get("poetry") or {}
            eco = "pypi" if name == "pyproject.toml" else "cargo"
            pkg = (p.get("name") or "", str(p.get("version") or ""), eco)
            out.append((*pkg, "", "", ""))
            deps: list[tuple[str, str]] = [("dependencies", x) for x in p.get("dependencies") or [] if isinstance(x, str)]
            for g, xs in (p.get("optional-dependencies") or {}).items():
                deps += [(g, x) for x in xs]
            for g, x in deps:
                m = re.match(r"\s*([A-Za-z0-9][\w.-]*)(.*)", x)
                if m:
                    out.append((*pkg, g, m.group(1), m.group(2).strip()))
            for g in ("dependencies", "dev-dependencies"):
                table = d.get(g) if eco == "cargo" else p.get(g) if isinstance(p.get(g), dict) else None
                out += [(*pkg, g, k, v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in (table or {}).items()]
        elif name.startswith("requirements") and name.endswith(".txt"):
            for line in (text or "").splitlines():
                m = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*([^#;]*)", line)
                if m and not line.lstrip().startswith(("#", "-")):
                    out.append(("", "", "pypi", "dependencies", m.group(1), m.group(2).strip()))
    except (ValueError, AttributeError):
        return out
    return out


def manifests(files: DataFrame) -> DataFrame:
    """Packages with their dependencies, one row per dependency and one per package."""
    importable(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, b in zip(pdf.path, pdf.body, strict=True) for r in manifest_rows(b, p.rsplit("/", 1)[-1])]
            yield pd.DataFrame(rows, columns=[f.name for f in _PKG])

    return files.where(F.col("path").rlike(r"(^|/)(package\.json|pyproject\.toml|Cargo\.toml|requirements[^/]*\.txt)$")).select("path", "body").mapInPandas(run, _PKG)


def internal_dependencies(deps: DataFrame) -> DataFrame:
    """Dependencies on packages of the repository itself: ``package, dependency, dep_group``."""
    own = deps.where("package <> ''").select(F.col("package").alias("dependency"), "ecosystem").distinct()
    return deps.where("dependency <> ''").join(own, ["dependency", "ecosystem"], "left_semi").select("package", "dependency", "dep_group").distinct()


def git_log(raw: DataFrame, order: str = "line") -> DataFrame:
    """``git log --numstat`` lines (``value`` and a line number) as commits: ``sha, author, author_time, path, added, deleted``.

    Headers read ``commit<US>sha<US>author<US>time``; each block is cut at its
    header by a running count, ordered inside files of a log, never over all logs.
    """
    w = Window.partitionBy("log").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    src = raw if "log" in raw.columns else raw.withColumn("log", F.lit(0))
    p = F.split("value", "\x1f")
    head = F.col("value").startswith("commit\x1f")
    x = src.withColumn("h", F.when(head, F.struct(p[1].alias("sha"), p[2].alias("author"), F.coalesce(p[3].try_cast("long"), F.lit(0)).alias("t")))).withColumn("h", F.last("h", ignorenulls=True).over(w))
    c = F.split("value", "\t")
    return x.where(~head & (F.size(c) == 3) & F.col("h").isNotNull()).select("h.sha", "h.author", F.col("h.t").alias("author_time"), F.trim(strip_rename(c[2])).alias("path"), c[0].try_cast("int").alias("added"), c[1].try_cast("int").alias("deleted")).where("path <> ''")


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """Unified diffs (``pr, diff``) as touched line ranges of the old side: ``pr, path, ranges`` (null when a file has no hunk)."""
    importable(diffs.sparkSession)
    out = T.StructType([T.StructField("pr", T.LongType()), T.StructField("path", T.StringType()), T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(pr, p, None if r is None else [{"lo": a, "hi": b} for a, b in r]) for pr, d in zip(pdf.pr, pdf["diff"], strict=True) for p, r in parse_diff(d).items()]
            yield pd.DataFrame(rows, columns=["pr", "path", "ranges"])

    return diffs.select(F.col("pr").cast("long").alias("pr"), "diff").mapInPandas(run, out)


def parse_diff(text: str | None) -> dict[str, list[tuple[int, int]] | None]:
    """Path to changed ranges of the base side; an insertion touches the lines around it."""
    out: dict[str, list[tuple[int, int]] | None] = {}
    path, old, run = "", 0, None
    for line in (text or "").splitlines():
        if line.startswith("diff --git "):
            m = re.match(r"diff --git a/(.*) b/(.*)$", line)
            path = m.group(2) if m else ""
            if path:
                out.setdefault(path, None)
        elif line.startswith("--- a/"):
            path = line[6:].split("\t")[0]
            out.setdefault(path, None)
        elif line.startswith("@@"):
            m = re.match(r"@@ -(\d+)(?:,(\d+))? \+", line)
            if m and path:
                old = int(m.group(1))
                run = None
                if m.group(2) == "0":
                    old += 1
        elif path and line[:1] == "-" and not line.startswith("---"):
            out[path] = _add(out[path], old, old)
            old += 1
            run = "-"
        elif path and line[:1] == "+" and not line.startswith("+++"):
            if run != "-":
                out[path] = _add(out[path], max(1, old - 1), old)
            run = run or "+"
        elif line[:1] == " ":
            old += 1
            run = None
    return out


def _add(ranges: list[tuple[int, int]] | None, lo: int, hi: int) -> list[tuple[int, int]]:
    r = list(ranges or [])
    if r and lo <= r[-1][1] + 1:
        r[-1] = (min(r[-1][0], lo), max(r[-1][1], hi))
    else:
        r.append((lo, hi))
    return r


class _Text(HTMLParser):
    SKIP = frozenset(("script", "style", "noscript", "template", "svg", "head"))
    BREAK = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre", "table", "ul", "ol", "blockquote"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.off, self.in_title = 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in self.SKIP:
            self.off += 1
        elif tag in self.BREAK:
            self.parts.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP:
            self.off = max(0, self.off - 1)
        elif tag in self.BREAK:
            self.parts.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.off:
            self.parts.append(data)


def html_text(html: str | None) -> tuple[str, str]:
    """(title, text) of a page without scripts, styles and head noise."""
    p = _Text()
    try:
        p.feed(html or "")
        p.close()
    except (ValueError, AssertionError):
        pass
    text = re.sub(r"[ \t]+", " ", "".join(p.parts))
    text = re.sub(r" ?\n ?", "\n", text)
    return " ".join("".join(p.title).split()), re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def _html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_text(h) for h in html], columns=["title", "text"])


def pages(raw: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url, title, text`` of HTML pages."""
    importable(raw.sparkSession)
    return raw.select(F.col(url).alias("url"), _html(html).alias("h")).select("url", "h.title", "h.text")


def paragraphs_packed(text: Column | str, limit: int = 1500) -> Column:
    """Chunks of whole paragraphs up to ``limit`` characters; a paragraph beyond it stands alone."""
    t = F.col(text) if isinstance(text, str) else text
    paras = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(
        paras,
        start,
        lambda acc, p: F.when(
            (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) + 2 > limit),
            F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), p.alias("cur")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p)).alias("cur"))),
        lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]),
    )


def csv_summary(files: DataFrame) -> DataFrame:
    """Delimiter, header and size of CSV texts: ``path, delimiter, n_columns, n_rows, header``."""
    first = F.split("body", r"\r?\n")[0]
    counts = [(d, F.size(F.split(first, rx))) for d, rx in ((",", ","), (";", ";"), ("\t", "\t"), ("|", r"\|"))]
    best = F.greatest(*[c for _, c in counts])
    delim = F.coalesce(*[F.when(c == best, F.lit(d)) for d, c in counts])
    rows = F.size(F.filter(F.split("body", r"\r?\n"), lambda x: F.trim(x) != ""))
    return files.where(F.lower("path").rlike(r"\.(csv|tsv)$")).select("path", delim.alias("delimiter"), best.alias("n_columns"), (rows - 1).alias("n_rows"), first.alias("header"))


def memory_entry(files: DataFrame) -> DataFrame:
    """Markdown notes with front matter as entries: ``path, kind, title, body, mtime``."""
    fm = F.regexp_extract("body", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    rest = F.regexp_replace("body", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    field = lambda k: F.trim(F.regexp_replace(F.regexp_extract(fm, rf"(?m)^{k}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", ""))
    title = F.when(field("name") != "", field("name")).when(field("title") != "", field("title")).otherwise(F.regexp_extract(rest, r"(?m)^#[ \t]+(.+)$", 1))
    kind = F.when(field("type") != "", field("type")).otherwise(F.regexp_extract("path", r"([a-z]+)_[^/]*$", 1))
    return files.select("path", kind.alias("kind"), title.alias("title"), rest.alias("body"), "mtime")
