"""Text functions as Column expressions (JVM-side), with plain Python twins where a driver needs them."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a prose query drops (English and French), as a parameter of ``prose_terms``.
STOPWORDS = tuple(
    "a about after all also am an and any are as at be because been before but by can could did do does for from had has have how i if in into is it its just me more most my no not of on one only or other our out over should so some such than that the their them then there these they this to under up us was we were what when where which who why will with would you your au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qui que sa se ses si son sont sur un une vous".split()
)


def tokenize_identifier(c: Column | str) -> Column:
    """``camelCase_and.dots`` as words: split at lower-to-upper, ``_`` and ``.``, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(x, r"[_.]", " "))


def words(c: Column | str) -> Column:
    """Lower-case letter and digit runs, as the word index cuts them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def embed_tokens(c: Column | str) -> Column:
    """``[A-Za-z0-9]+`` runs, each cut at lower-to-upper and digits kept, lower case."""
    c = F.col(c) if isinstance(c, str) else c
    spaced = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit(r"[a-z0-9]+"), F.lit(0))


def char_ngrams(c: Column | str, n: int = 3) -> Column:
    """Character n-grams of ``^text$``, white space collapsed, lower case; empty for null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.concat(F.lit("^"), F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit("$"))
    return F.coalesce(F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)), F.array().cast("array<string>"))


def trigrams(c: Column | str) -> Column:
    """Distinct lower-case trigrams of a text, for substring candidates."""
    c = F.col(c) if isinstance(c, str) else c
    # a zero-width match at every position, so one pass over the text
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


_PLAIN = str.maketrans({c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, range(0xC0, 0x180)) if unicodedata.normalize("NFKD", c) != c and ord(unicodedata.normalize("NFKD", c)[0]) < 128})


def fold_accents(c: Column | str) -> Column:
    """Lower case without the accents of the Latin blocks; the table comes from the Unicode decompositions."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.translate(c, "".join(map(chr, _PLAIN)), "".join(_PLAIN.values())))


def fold_text(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).lower()


def prose_terms(text: str, stopwords: tuple[str, ...] = STOPWORDS, most: int = 32) -> list[str]:
    """Search terms of a prose query: folded words and their identifier parts without stop words and bare digits."""
    out: dict[str, None] = {}
    for raw in re.findall(r"[^\W]+(?:[.][^\W]+)*", re.sub(r"\b[cdjlmnst]['’]", " ", text, flags=re.I)):
        parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", raw).replace("_", " ").replace(".", " ").split()
        for w in [raw, *parts]:
            w = fold_text(w).strip("_.")
            if w and not w.isdigit() and w not in stopwords and len(w) > 1:
                out.setdefault(w, None)
    return list(out)[:most]


def slugify(c: Column | str) -> Column:
    """Heading anchors: lower case, punctuation dropped, spaces to hyphens."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s_-]", ""), r"\s+", "-")


# The volatile parts of an error message, in the order they are replaced.
SYMPTOM_PATTERNS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"/(?:[\w.\-]+/)+[\w.\-]+", "<path>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<hex>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"\b(?=[0-9]*[a-fA-F])[0-9a-fA-F]{7,}\b", "<hex>"),
    (r"\b\d{13}\b|\b\d{10}\b", "<ts>"),
    (r"\b\d+\b", "<n>"),
)
# Quoted phrases that are the message itself.
SYMPTOM_PHRASES = ("is not installed", "database is locked", "permission denied", "command not found", "no such file or directory", "connection refused", "already exists", "service_disabled")
_QUOTES = (('"', '"'), ("'", "'"), ("`", "`"), ("«", "»"))


def normalize_symptom(c: Column | str) -> Column:
    """An error message without what differs between two occurrences of it: quoted values, times, paths, ids, numbers.

    Letters keep their case.  A quoted reason code in capitals, or a quoted phrase
    that is the message itself, loses its quotes only; null and empty give ''.
    """
    c = F.col(c) if isinstance(c, str) else c
    # a quotation runs to the next sign of its own kind, wherever the first one opens
    body = "|".join(f"{a}[^{z}]*{z}" for a, z in _QUOTES)
    kept = "|".join(rf"{a}(\s*(?:[A-Z][A-Z0-9_]{{2,}}|[^{z}]*(?i:{'|'.join(SYMPTOM_PHRASES)})[^{z}]*)\s*){z}" for a, z in _QUOTES)
    # the first alternative that matches decides, so kept ones go first and all are read in one pass from the left
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?s:{body}|[^\"'`«]+|.)"), F.lit(0))
    inner = lambda x: F.trim(F.substr(x, F.lit(2), F.length(x) - 2))
    x = F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(rf"(?s)^(?:{kept})$")), inner(p)).when(F.rlike(p, F.lit(rf"(?s)^(?:{body})$")), F.lit("<q>")).otherwise(p)), "")
    for rx, to in SYMPTOM_PATTERNS:
        x = F.regexp_replace(x, rx, to)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def symptom_tokens(c: Column | str) -> Column:
    """Distinct words of a normalised symptom that tell something."""
    t = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.array_except(F.filter(t, lambda w: F.length(w) >= 2), F.array(*[F.lit(w) for w in ("ts", "path", "hex", "n", "q")]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def stem(c: Column) -> Column:
    """A light suffix stemmer: the longest of a few suffixes, leaving at least four letters."""
    # one flat chain of cases; nesting would double the expression at every suffix
    out = None
    for suffix in ("ations", "ements", "ation", "ement", "ingly", "ings", "edly", "ing", "ers", "ies", "ed", "es", "er", "ly", "s"):
        n = len(suffix)
        hit, cut = c.endswith(suffix) & (F.length(c) >= 4 + n), F.substring(c, F.lit(1), F.length(c) - n)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def basename(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def strip_rename(path: Column | str) -> Column:
    """The new path of a numstat rename ``a/{x => y}/b`` or ``x => y``."""
    p = F.col(path) if isinstance(path, str) else path
    p = F.regexp_replace(p, r"\{[^{}]* => ([^{}]*)\}", "$1")
    p = F.regexp_replace(p, r"^.* => ", "")
    return F.regexp_replace(p, r"//+", "/")


def glob_to_regex(glob: str) -> str:
    """A path glob as a regular expression: ``**`` any depth, ``*`` and ``?`` within a segment, classes kept."""
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            j = glob.find("]", i + 2)
            if j < 0:
                out, i = out + r"\[", i + 1
            else:
                body = glob[i + 1 : j]
                out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def expand_braces(glob: str) -> list[str]:
    """``a.{py,ts}`` as one glob per choice, nested ones too."""
    depth = start = 0
    for i, c in enumerate(glob):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                parts, level, last = [], 0, start + 1
                for k in range(start + 1, i):
                    if glob[k] == "{":
                        level += 1
                    elif glob[k] == "}":
                        level -= 1
                    elif glob[k] == "," and level == 0:
                        parts.append(glob[last:k])
                        last = k + 1
                parts.append(glob[last:i])
                if len(parts) == 1:
                    continue
                return [x for p in parts for x in expand_braces(glob[:start] + p + glob[i + 1 :])]
    return [glob]


def path_matches(path: Column | str, glob: str) -> Column:
    """Whether a path matches a glob; one without a slash matches the file name anywhere."""
    p = F.col(path) if isinstance(path, str) else path
    rx = []
    for g in expand_braces(glob):
        g = g.removeprefix("./")
        rx.append(glob_to_regex(g if "/" in g else "**/" + g))
    return p.rlike("^(?:" + "|".join(rx) + ")$")


def ignored(path: Column | str, patterns: list[str]) -> Column:
    """Gitignore-style patterns, the last match wins, ``!`` takes back; folders ignore what is below."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for raw in patterns:
        g = raw.strip()
        if not g or g.startswith("#"):
            continue
        back, g = g.startswith("!"), g.lstrip("!")
        folder, g = g.endswith("/"), g.rstrip("/")
        anchored = "/" in g
        rx = glob_to_regex(g.lstrip("/"))
        rx = ("^" if anchored else "(^|/)") + rx + ("/" if folder else "(/|$)")
        out = F.when(p.rlike(rx), F.lit(not back)).otherwise(out)
    return out
