"""Source files to node, edge and side tables.

Each distinct text is parsed once in an Arrow batch: Python by the standard
``ast`` (regular expressions where it does not parse), the other languages by
regular expressions over text whose comments and strings are blanked, with
braces for the ends.  Known losses against a full grammar: overloads on one
line, functions assigned to members, conditional compilation.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable, materialise, spread

_DEF = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)

# Language by file suffix.
LANGUAGES = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".vue": "vue", ".java": "java", ".go": "go", ".rs": "rust", ".cs": "csharp", ".rb": "ruby", ".tf": "terraform", ".tfvars": "terraform", ".md": "markdown", ".mdx": "markdown", ".json": "json", ".jsonc": "json", ".toml": "toml", ".yml": "yaml", ".yaml": "yaml", ".sql": "sql", ".csv": "csv", ".tsv": "csv", ".txt": "text", ".text": "text", ".log": "text", ".rst": "text", ".css": "css"}

Row = tuple[str, str, str, int, int, str | None]
_PARSERS: dict[str, Callable[[str], list[Row]]] = {}


def register_parser(*languages: str):
    """Registers a parser: text to rows (kind, name, qualified name, first line, last line, detail)."""

    def keep(f: Callable[[str], list[Row]]):
        for name in languages:
            _PARSERS[name] = f
        return f

    return keep


def blank(text: str, hash_comments: bool = False) -> str:
    """The text with the insides of comments and strings turned to spaces; lines and columns stay."""
    rx = r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.){2,}'|`(?:[^`\\]|\\.)*`"
    if hash_comments:
        rx = r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    return re.sub(rx, lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def _line(text: str, at: int, starts: list[int]) -> int:
    lo, hi = 0, len(starts)
    while lo < hi:
        mid = (lo + hi) // 2
        if starts[mid] <= at:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _close(code: str, at: int) -> int:
    """Position of the brace that closes the first one opened at or after ``at``; the end of the line when a statement ends first."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif depth == 0:
            return m.start()
    return len(code) - 1


# Words that look like calls or definitions but are statements.
_KEYWORDS = frozenset("if for while switch catch return function class new typeof await throw else do try import export super this match loop select defer go range func fn impl trait struct enum mod use pub let const var static async yield in of instanceof delete void sizeof assert elif except with lambda print not and or".split())
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\s*(?:\.|::)\s*)*)([A-Za-z_]\w*)\s*\(")


def _calls(code: str, inside: Callable[[int], str | None], starts: list[int]) -> list[Row]:
    out: dict[tuple[str, str, str], Row] = {}
    for m in _CALL.finditer(code):
        owner = inside(m.start())
        if owner is None or m.group(2) in _KEYWORDS:
            continue
        receiver = re.sub(r"\s+", "", m.group(1)).rstrip(".:")
        k = (owner, m.group(2), receiver)
        if k not in out:
            n = _line(code, m.start(), starts)
            out[k] = ("call", m.group(2), owner, n, n, receiver)
    return list(out.values())


@register_parser("python")
def parse_python(text: str) -> list[Row]:
    """Functions, classes with bases, imports and calls of a Python file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_lines(text)
    out: list[Row] = []

    def visit(node: ast.AST, scope: str, owner: str | None) -> None:
        for ch in ast.iter_child_nodes(node):
            if isinstance(ch, (ast.FunctionDef, ast.AsyncFunctionDef)):
                q = f"{scope}.{ch.name}" if scope else ch.name
                out.append(("function", ch.name, q, ch.lineno, ch.end_lineno or ch.lineno, ast.get_docstring(ch, clean=True)))
                visit(ch, q, q)
            elif isinstance(ch, ast.ClassDef):
                q = f"{scope}.{ch.name}" if scope else ch.name
                out.append(("class", ch.name, q, ch.lineno, ch.end_lineno or ch.lineno, ",".join(ast.unparse(b) for b in ch.bases)))
                visit(ch, q, owner)
            else:
                if isinstance(ch, ast.Import):
                    out.extend(("import", a.name, a.asname or "", ch.lineno, ch.lineno, owner or "") for a in ch.names)
                elif isinstance(ch, ast.ImportFrom):
                    out.extend(("import", "." * ch.level + (ch.module or ""), a.name, ch.lineno, ch.lineno, owner or "") for a in ch.names)
                elif isinstance(ch, ast.Call) and owner:
                    f = ch.func
                    if isinstance(f, ast.Name):
                        out.append(("call", f.id, owner, ch.lineno, ch.lineno, ""))
                    elif isinstance(f, ast.Attribute):
                        try:
                            r = ast.unparse(f.value)
                        except (ValueError, RecursionError):
                            r = "?"
                        out.append(("call", f.attr, owner, ch.lineno, ch.lineno, r[:80]))
                visit(ch, scope, owner)

    try:
        visit(tree, "", None)
    except RecursionError:
        return _python_by_lines(text)
    return list(dict.fromkeys(out))


def _python_by_lines(text: str) -> list[Row]:
    lines = blank(text, True).split("\n")
    out: list[Row] = []
    stack: list[tuple[int, str]] = []
    for i, line in enumerate(lines, 1):
        m = re.match(r"([ \t]*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", line)
        if m:
            ind = len(m.group(1).expandtabs(4))
            while stack and stack[-1][0] >= ind:
                stack.pop()
            q = ".".join([*(s for _, s in stack), m.group(3)])
            end = i
            for j in range(i, len(lines)):
                body = lines[j]
                if body.strip():
                    if len(body.expandtabs(4)) - len(body.expandtabs(4).lstrip()) <= ind:
                        break
                    end = j + 1
            out.append(("function" if m.group(2) == "def" else "class", m.group(3), q, i, end, None))
            stack.append((ind, m.group(3)))
        m = re.match(r"\s*(?:from\s+([.\w]+)\s+import\s+(.+)|import\s+([.\w]+))", line)
        if m:
            names = [x.strip().split(" as ")[0] for x in (m.group(2) or "").strip("() ").split(",")] if m.group(1) else [""]
            out.extend(("import", m.group(1) or m.group(3), n, i, i, "") for n in names)
    return out


def _braced(text: str, defs: re.Pattern, owners: re.Pattern, imports: re.Pattern, kind_of: Callable[[re.Match], str] | None = None) -> list[Row]:
    code = blank(text)
    starts = _starts(code)
    out: list[Row] = []
    spans: list[tuple[int, int, str]] = []
    for m in owners.finditer(code):
        end = _close(code, m.end() - 1 if code[m.end() - 1] == "{" else m.end())
        name = m.group("name")
        bases = ",".join(x.strip() for x in re.split(r",|\bimplements\b|\bextends\b", (m.groupdict().get("bases") or "")) if x.strip())
        a, b = _line(code, m.start("name"), starts), _line(code, end, starts)
        if not (m.groupdict().get("impl")):
            out.append(("class", name, name, a, b, bases))
        spans.append((m.start(), end, name))
    fns: list[tuple[int, int, str]] = []
    for m in defs.finditer(code):
        name = m.group("name")
        if name in _KEYWORDS:
            continue
        end = _close(code, m.end() - 1)
        if end < m.end() - 1 or "{" not in code[m.start() : end + 1]:
            continue
        inner = [s for s in spans if s[0] < m.start() and m.end() <= s[1]]
        recv = m.groupdict().get("recv")
        q = f"{recv}.{name}" if recv else f"{min(inner, key=lambda s: s[1] - s[0])[2]}.{name}" if inner else name
        out.append(("function", name, q, _line(code, m.start("head"), starts), _line(code, end, starts), None))
        fns.append((m.start(), end, q))
    for m in imports.finditer(text):
        n = _line(code, m.start(), starts)
        src = next((g for g in m.groups() if g), "")
        out.append(("import", src, "", n, n, ""))

    def inside(at: int) -> str | None:
        hit = [f for f in fns if f[0] < at <= f[1] and code.find("{", f[0]) < at]
        return min(hit, key=lambda f: f[1] - f[0])[2] if hit else None

    return out + _calls(code, inside, starts)


_JS_DEF = re.compile(r"(?m)(?:^|(?<=[;{}(!,&|=:?]))(?P<head>[ \t]*)(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>{]*>)?\s*\([^)]*\)[^{;]*\{)")
_JS_METHOD = re.compile(r"(?m)^(?P<head>[ \t]+)(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>{]*>)?\([^)]*\)\s*(?::[^{;=]+)?\{")
_JS_ARROW = re.compile(r"(?m)^(?P<head>[ \t]*)(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^={]+)?=>\s*\{")
_JS_CLASS = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)(?:\s*<[^>{]*>)?(?P<bases>[^{]*)\{")
_JS_IMPORT = re.compile(r"(?m)^\s*(?:import|export)\b[^;\n]*?\bfrom\s*['\"]([^'\"\n]+)['\"]|\bimport\s*\(?\s*['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]")


@register_parser("typescript", "javascript")
def parse_script(text: str) -> list[Row]:
    rows: dict[tuple, Row] = {}
    for rx in (_JS_DEF, _JS_METHOD, _JS_ARROW):
        for r in _braced(text, rx, _JS_CLASS, _JS_IMPORT):
            if r[0] == "function" and rx is _JS_METHOD and "." not in r[2]:
                continue
            rows.setdefault((r[0], r[1], r[2], r[3]) if r[0] != "call" else (r[0], r[1], r[2], r[5]), r)
    return list(rows.values())


@register_parser("vue")
def parse_vue(text: str) -> list[Row]:
    """The script blocks of a single-file component, lines kept."""
    kept = re.sub(r"[^\n]", " ", text)
    for m in re.finditer(r"<script[^>]*>(.*?)</script>", text, re.S):
        kept = kept[: m.start(1)] + m.group(1) + kept[m.end(1) :]
    return parse_script(kept)


# what stands before the name is read once, up to the bracket, and given back by words only
_JAVA_DEF = re.compile(r"(?m)^(?P<head>[ \t]+)(?!(?:return|new|throw|else|case|assert|yield)\b)[\w@<][^\n(){};=]*[ \t>\]](?P<name>[A-Za-z_]\w*)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w., ]+)?\s*\{")
_JAVA_CLASS = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed|partial|internal)\s+)*(?:class|interface|enum|record|struct)\s+(?P<name>[A-Za-z_]\w*)(?:\s*<[^>{]*>)?(?:\s*\([^)]*\))?(?P<bases>[^{;]*)\{")


@register_parser("java")
def parse_java(text: str) -> list[Row]:
    return _braced(text, _JAVA_DEF, _JAVA_CLASS, re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"))


@register_parser("csharp")
def parse_csharp(text: str) -> list[Row]:
    return _braced(text, _JAVA_DEF, _JAVA_CLASS, re.compile(r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;"))


@register_parser("go")
def parse_go(text: str) -> list[Row]:
    d = re.compile(r"(?m)^(?P<head>)func\s+(?:\(\s*\w*\s*\*?(?P<recv>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\([^)]*\)[^{\n]*\{")
    c = re.compile(r"(?m)^type\s+(?P<name>[A-Za-z_]\w*)\s+(?:struct|interface)\s*(?P<bases>)\{")
    rows = _braced(text, d, c, re.compile(r"(?m)^\s*import\s+(?:\w+\s+)?\"([^\"]+)\""))
    block = re.search(r"(?ms)^import\s*\((.*?)^\)", text)
    if block:
        first = text.count("\n", 0, block.start(1)) + 1
        for i, line in enumerate(block.group(1).split("\n")):
            m = re.search(r"\"([^\"]+)\"", line)
            if m:
                rows.append(("import", m.group(1), "", first + i, first + i, ""))
    return rows


@register_parser("rust")
def parse_rust(text: str) -> list[Row]:
    d = re.compile(r"(?m)^(?P<head>[ \t]*)(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<name>[A-Za-z_]\w*)\s*(?:<[^{(]*>)?\([^)]*\)[^{;]*\{")
    c = re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union|(?P<impl>impl)(?:<[^>]*>)?(?:\s+[\w:<>, ]+\s+for)?)\s+(?P<name>[A-Za-z_]\w*)(?P<bases>)[^{;]*\{")
    return _braced(text, d, c, re.compile(r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"))


@register_parser("ruby")
def parse_ruby(text: str) -> list[Row]:
    code = blank(text, True)
    out: list[Row] = []
    stack: list[tuple[str, str, int, int]] = []
    opens = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|for|begin|do)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
    for i, line in enumerate(code.split("\n"), 1):
        m = re.match(r"\s*(class|module|def)\s+(?:self\.)?([A-Za-z_][\w:]*[?!=]?)(?:\s*<\s*([\w:]+))?", line)
        if m and not re.search(r"\bend\s*$", line):
            stack.append((m.group(1), m.group(2), i, len(out)))
            scope = ".".join(n for k, n, _, _ in stack if k != "x")
            out.append(("function" if m.group(1) == "def" else "class", m.group(2), scope, i, i, m.group(3)))
        elif opens.search(line) and not re.search(r"\bend\b", line):
            stack.append(("x", "", i, -1))
        elif re.match(r"\s*end\b", line) and stack:
            k, _, _, at = stack.pop()
            if k != "x":
                r = out[at]
                out[at] = (*r[:4], i, r[5])
        m = re.match(r"\s*require(?:_relative)?\s+", line)
        if m:
            raw = text.split("\n")[i - 1]
            q = re.search(r"['\"]([^'\"]+)['\"]", raw)
            if q:
                out.append(("import", q.group(1), "", i, i, ""))
    return out


@register_parser("terraform")
def parse_terraform(text: str) -> list[Row]:
    """Blocks with type and name, and the references inside them."""
    code = blank(text)
    code_hash = re.sub(r"(?m)#[^\n]*", lambda m: " " * len(m.group()), code)
    starts = _starts(code)
    out: list[Row] = []
    for m in re.finditer(r"(?m)^[ \t]*(resource|data|variable|output|module|provider|locals|terraform)\b([^{\n]*)\{", text):
        names = re.findall(r"\"([^\"]*)\"", m.group(2))
        kind = m.group(1)
        address = {"resource": ".".join(names), "data": "data." + ".".join(names), "variable": "var." + (names[0] if names else "")}.get(kind, kind + ("." + names[0] if names else ""))
        end = _close(code_hash, m.end() - 1)
        a, b = _line(code, m.start(1), starts), _line(code, end, starts)
        out.append((f"tf_{kind}", names[-1] if names else kind, address, a, b, names[0] if len(names) > 1 else ""))
        body = text[m.end() : end]
        for r in sorted({x for x in re.findall(r"\b((?:var|local|module|data\.[a-z]\w*)\.[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)?|[a-z][a-z0-9]*_[a-z0-9_]+\.[A-Za-z_][\w-]*)", body)}):
            out.append(("tf_ref", r, address, a, b, ""))
    for m in re.finditer(r"(?m)^([A-Za-z_][\w-]*)\s*=", text) if not out else ():
        n = _line(code, m.start(), starts)
        out.append(("tf_value", m.group(1), "var." + m.group(1), n, n, ""))
    return out


@register_parser("sql")
def parse_sql(text: str) -> list[Row]:
    """Tables with their columns, also those added later."""
    out: list[Row] = []
    starts = _starts(text)
    code = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    for m in re.finditer(r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\(", code):
        depth, i = 1, m.end()
        cols, cur = [], ""
        while i < len(code) and depth:
            c = code[i]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or depth == 0:
                cols.append(cur)
                cur = ""
            else:
                cur += c
            i += 1
        name = re.sub(r"[\"`\[\]]", "", m.group(1))
        a, b = _line(code, m.start(), starts), _line(code, i - 1, starts)
        keep = [re.sub(r"[\"`\[\]]", "", x.split()[0]) for x in map(str.strip, cols) if x and not re.match(r"(?i)(primary|foreign|unique|check|constraint|key|index|exclude)\b", x)]
        out.append(("sql_table", name, name, a, b, ",".join(keep)))
    for m in re.finditer(r"(?i)\balter\s+table\s+(?:if\s+exists\s+)?([\w.\"`\[\]]+)\s+add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?([\w\"`\[\]]+)", code):
        n = _line(code, m.start(), starts)
        t = re.sub(r"[\"`\[\]]", "", m.group(1))
        out.append(("sql_column", re.sub(r"[\"`\[\]]", "", m.group(2)), t, n, n, ""))
    return out


# Route declarations by framework.
_ROUTES = (
    ("fastapi", re.compile(r"(?m)^[ \t]*@(?P<router>[A-Za-z_]\w*)\.(?P<method>get|post|put|patch|delete|head|options|route|websocket|api_route)\(\s*[\"'](?P<path>[^\"']*)[\"'](?P<rest>[^\n]*)")),
    ("express", re.compile(r"(?m)\b(?P<router>app|router|[a-z]\w*Router)\.(?P<method>get|post|put|patch|delete|all)\(\s*[\"'](?P<path>/[^\"']*)[\"'](?P<rest>[^\n]*)")),
    ("django", re.compile(r"(?m)^[ \t]*(?P<router>re_path|path)\(\s*r?[\"'](?P<path>[^\"']*)[\"'](?P<rest>[^\n]*)")),
    ("spring", re.compile(r"(?m)^[ \t]*@(?P<method>Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(?P<path>[^\"]*)\"(?P<rest>[^\n]*)")),
    ("nest", re.compile(r"(?m)^[ \t]*@(?P<method>Get|Post|Put|Patch|Delete|All)\(\s*[\"'](?P<path>[^\"']*)[\"'](?P<rest>[^\n]*)")),
    ("gin", re.compile(r"(?m)\b(?P<router>[a-z]\w*)\.(?P<method>GET|POST|PUT|PATCH|DELETE|Any)\(\s*\"(?P<path>[^\"]*)\"(?P<rest>[^\n]*)")),
)


def parse_routes(text: str, lang: str) -> list[Row]:
    """Declared HTTP routes: (route, method, path, line, line, framework and router)."""
    fit = {"python": ("fastapi", "django"), "javascript": ("express", "nest"), "typescript": ("express", "nest"), "java": ("spring",), "go": ("gin",)}.get(lang, ())
    out: list[Row] = []
    starts = _starts(text)
    for name, rx in _ROUTES:
        if name in fit:
            for m in rx.finditer(text):
                g = m.groupdict()
                method = (g.get("method") or "any").upper()
                if method in ("ROUTE", "API_ROUTE"):
                    found = re.findall(r"[\"']([A-Z]+)[\"']", g["rest"]) or ["GET"]
                    method = ",".join(found)
                n = _line(text, m.start(), starts)
                out += [("route", "ANY" if x in ("ALL", "ANY", "REQUEST") else x, g["path"], n, n, f"{name}:{g.get('router') or ''}") for x in method.split(",")]
    return out


def parse(text: str | None, lang: str | None) -> list[Row]:
    """Rows of one text; unknown languages and broken texts give what could be read."""
    if not text or lang not in _PARSERS:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [*_PARSERS[lang](text), *parse_routes(text, lang)]


def _language(path: Column) -> Column:
    """The language of a path by its suffix, null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(LANGUAGES.items()) for x in kv]), suffix)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in _DEF]
    for pdf in batches:
        rows: list[tuple] = []
        for key, lang, body in zip(pdf.path, pdf.lang, pdf.body, strict=True):
            rows += [(key, *r) for r in parse(body, lang)]
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def definitions(files: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """``path, kind, name, qualified, start_line, end_line, detail`` of every definition, import, call and route.

    ``files`` has ``path, body``, or ``path, git_blob_sha`` with the contents in
    ``blobs`` (``git_blob_sha, body``).  Each content is parsed once per language,
    in parts spread over all cores, and then given to all its paths.
    """
    importable(files.sparkSession)
    f = files.where(F.col("path").isNotNull()).withColumn("lang", _language(F.col("path"))).where(F.col("lang").isin(*_PARSERS))
    if blobs is None:
        # the digest stands for the text: paths meet the parsed rows without carrying it
        f = f.where(F.col("body").isNotNull()).select("path", "lang", F.md5("body").alias("key"), "body")
        texts = f.groupBy("key", "lang").agg(F.first("body").alias("body"))
    else:
        f = f.where(F.col("git_blob_sha").isNotNull()).select("path", "lang", F.col("git_blob_sha").alias("key"))
        b = blobs.where(F.col("git_blob_sha").isNotNull() & F.col("body").isNotNull()).groupBy(F.col("git_blob_sha").alias("key")).agg(F.first("body").alias("body"))
        texts = f.select("key", "lang").distinct().join(b, "key")
    # written once: definitions are read by many tables, and parsing is the costly part
    parsed = materialise(spread(texts.select(F.concat_ws("\x00", "key", "lang").alias("path"), "lang", "body")).mapInPandas(_run, _DEF).withColumnRenamed("path", "_of"), "parsed")
    at = f.select("path", F.concat_ws("\x00", "key", "lang").alias("_of")).distinct()
    return parsed.join(at, "_of").select(*[c.name for c in _DEF])


def functions(defs: DataFrame) -> DataFrame:
    """The Function table of parsed files."""
    return defs.where("kind = 'function'").select(F.concat("path", F.lit("::"), "qualified").alias("id"), "name", F.col("path").alias("file_path"), "start_line", "end_line", F.col("detail").alias("docstring"))


def classes(defs: DataFrame) -> DataFrame:
    return defs.where("kind = 'class'").select(F.concat("path", F.lit("::"), "qualified").alias("id"), "name", F.col("path").alias("file_path"), "start_line", "end_line", F.lit(None).cast("string").alias("docstring"))


def has_method(defs: DataFrame) -> DataFrame:
    """Class to method edges."""
    f = defs.where("kind = 'function' and instr(qualified, '.') > 0").select("path", F.col("qualified").alias("fq"), F.regexp_replace("qualified", r"\.[^.]+$", "").alias("qualified"))
    c = defs.where("kind = 'class'").select("path", "qualified").distinct()
    return f.join(c, ["path", "qualified"]).select(F.concat("path", F.lit("::"), "qualified").alias("from_id"), F.concat("path", F.lit("::"), "fq").alias("to_id"))


def name_refs(defs: DataFrame) -> DataFrame:
    """Bases of classes as references by name."""
    b = F.explode(F.filter(F.transform(F.split("detail", ","), lambda x: F.trim(x)), lambda x: x != ""))
    return defs.where("kind = 'class' and detail <> ''").select(F.lit("inherits").alias("kind"), F.concat("path", F.lit("::"), "qualified").alias("from_id"), F.col("path").alias("file_path"), b.alias("name"), F.lit("").alias("extra"))


def call_sites(defs: DataFrame) -> DataFrame:
    """Calls by name with the shape of the receiver: bare, self or attribute."""
    recv = F.coalesce("detail", F.lit(""))
    kind = F.when(recv == "", "bare").when(recv.isin("self", "this", "cls", "super()"), "self").otherwise("attr")
    ctx = F.when(kind == "self", F.regexp_replace("qualified", r"\.?[^.]+$", "")).otherwise("")
    return defs.where("kind = 'call'").select(F.concat("path", F.lit("::"), "qualified").alias("from_id"), F.col("path").alias("file_path"), "name", F.lit("").alias("to_id"), kind.alias("kind"), recv.alias("hint"), ctx.alias("ctx")).distinct()
