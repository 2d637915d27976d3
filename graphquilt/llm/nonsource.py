"""Generated, minified, vendored or data files among source files (problem 5).

Content is judged once per distinct blob (Arrow batches): an Aho-Corasick
automaton looks for generation and copy notices in the leading comment block,
and layout statistics tell minified code and data from written code.  Path rules
run JVM-side.  A blob that lies under a vendored path marks every other path of
the same blob, and a package name that occurs as a vendored folder marks files
that declare that package outside their own project.

Defined results: null path gives no row; null or missing body is judged by its
path alone; an empty body is never minified, data or a copy; repeated file rows
give one row per path; wrong ``lang`` and ``role`` are not consulted.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import salted_left_join
from ..session import importable, materialise

# Markers that publishers of tools define as such (Go, .NET, Buck and Cargo, Alembic, Bison, Qt, JavaCC, CMake, Rails).
MARKS = ("@generated", "<auto-generated", "<autogenerated", "code generated by", "made by gnu bison", "the qt meta object compiler", "generated by:javacc", "cmake generated file", "signedsource<<", "revision id:")
# Licence texts that travel with copies (BSD, MIT, Apache, MPL, GPL).
LICENCES = ("redistribution and use in source and binary forms", "redistribution and use", "permission is hereby granted, free of charge", "permission is hereby granted", "permission to use, copy, modify", "this notice shall be included", "the software is provided \"as is\"")
# The words of a notice by what they contribute, folded, in the languages of the corpus.
MADE = ("generated", "autogenerated", "created", "autocreated", "produced", "written", "emitted", "compiled", "built", "rendered", "output of", "derived from", "erzeugt", "generiert", "erstellt", "geschrieben", "genere", "produit", "cree par", "ecrit par", "generado", "producido", "creado", "escrito", "gegenereerd", "aangemaakt", "geschreven", "gerado", "generato", "生成", "생성")
MACHINE = ("automatically", "automatic", "auto-", "auto ", "autogenerated", "autocreated", "machine-", "machine ", "a tool", "the tool", "tool:", "script", "command", "codegen", "compiler", "generator", "protoc", "maschinell", "automatisch", "werkzeug", "programm", "automatiquement", "un outil", "l'outil", "automaticamente", "herramienta", "automatico", "自动", "自動", "자동")
EDIT = ("edit", "modif", "change", "alter", "touch", "by hand", "manual", "bearbeit", "aender", "andern", "anderung", "anpass", "editer", "retouch", "editar", "cambi", "bewerk", "wijzig", "编辑", "修改", "編集", "変更", "수정")
NOT = ("not", "n't", "never", "no", "nicht", "keine", "ne", "pas", "niet", "geen", "nunca", "don't", "勿", "不要", "しない", "마십시오")
LOST = ("overwritten", "overwrite", "be lost", "discarded", "not survive", "regenerate", "re-run", "rerun", "rebuild with", "uberschrieben", "gehen verloren", "ecrase", "perdu", "sobrescri", "se perder", "overschreven", "覆盖", "上書き")
COPIED = ("copy of", "copied from", "copy from", "vendored from", "vendored copy", "imported from", "taken from", "forked from", "mirrored from", "mirror of", "bundled from", "synced from", "ported from", "kopie von", "kopie aus", "kopiert aus", "kopiert von", "ubernommen aus", "ubernommen von", "copie de", "copie depuis", "repris de", "importe de", "copia de", "copiado de", "tomado de", "importado de", "kopie van", "gekopieerd uit", "overgenomen uit", "拷贝自", "コピー元")

# Names of lock files, folders and suffixes by convention.
LOCKS = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|Pipfile\.lock|pdm\.lock|uv\.lock|Gemfile\.lock|composer\.lock|Cargo\.lock|Podfile\.lock|mix\.lock|flake\.lock|go\.sum|packages\.lock\.json|\.terraform\.lock\.hcl)$"
ALWAYS_OUTSIDE = r"(^|/)(node_modules|site-packages|dist-packages|bower_components|jspm_packages|Pods|Carthage)/"
OUTSIDE_FOLDER = r"(?i)(^|/)(_?vendor(ed)?|third[-_]?party|3rd[-_]?party|externals?|extern|deps)/([^/]+/)+[^/]+$"
OUTSIDE_NAME = r"(?i)(?:^|/)(?:node_modules|site-packages|dist-packages|bower_components|jspm_packages|Pods|Carthage|_?vendor(?:ed)?|third[-_]?party|3rd[-_]?party|externals?|extern|deps)/(?:[^/]+\.[a-z]{2,}/)?(@[^/]+/[^/]+|[^/]+)/"
GENERATED_FOLDER = r"(?i)(^|/)(generated|__generated__|autogen(erated)?|auto_generated|codegen_out|gen|generated[-_]src)/"
GENERATED_NAME = r"(\.pb\.go|_pb2(_grpc)?\.pyi?|_pb\.(js|d\.ts)|\.pb\.(cc|h)|\.g\.dart|\.gen\.[a-z]+|_gen\.go|_string\.go|\.generated\.[a-z]+|\.designer\.cs|OuterClass\.java)$"
MINIFIED_NAME = r"(?i)[.-]min\.(js|css|mjs)$"
BUNDLE_NAME = r"(?i)\.[0-9a-f]{8,}\.(js|css|mjs)$"

_ARTICLE = re.compile(r"/\*!\s*[\w@./ -]+ v?\d+\.\d+")
_RIGHTS = re.compile(r"copyright (?:\(c\)|©)? ?[\d, -]+(by )?(the )?[\w. -]+ (developers|authors|contributors|maintainers|team|project|foundation)\b")
_VERSION = re.compile(r"\bv?\d+\.\d+|\b(?:tag|version|commit|revision|rev|release)\b|@[0-9a-f]{7,}|https?://|\bupstream\b")
# a participle that only describes a noun ("the generated client"), or one that is denied
_NOUN_BEFORE = re.compile(r"(?:\b(?:the|a|an|any|our|your|its|their|each|every|all|of|for|with|to|from|some|these|those|such|non|der|die|das|den|dem|des|unser\w*|le|la|les|notre|nos|el|los|las|nuestr\w+)[\s-]+)$")
_AGENT = re.compile(r"^(?:\s*(?:automatically|automatisch|automatiquement|automaticamente|by|from|with|using|via|on|at|out of|file|code|source|bindings?|von|aus|mit|durch|par|depuis|avec|por|desde|con|door|uit|met)\b|\s*[.:;,!)]|\s*$|\s*\()")
_DENIED = re.compile(r"(?:\bnot|\bno longer|\bnever|n't|\bnicht(?: mehr)?|\bnon|\bya no|\bplus|\bniet(?: meer)?|\bpas|\bonce|\boriginally|\bformerly|\bused to be)(?:\s+\w+){0,2}\s*$")
_BY_HAND = re.compile(r"^\s*(?:entirely |all )?(?:by hand|manually|von hand|a la main|a mano|met de hand)")
_ABOUT = re.compile(r"\b(?:detect|recogni[sz]e|look for|looks for|skip|match|strip|find|pars|parse|render|print|check|search|read|handle|support|test|report|list|tell)(?:s|es|ed|ing)?\b[^.;]*$|\b(?:marker|banner|notice|header|line|comment|phrase|text)s?\b(?!\s*:)[^.;]*$|[\"'`“”«‘]\s*$|[\"`“«‘][^\"`”»’]*$")
_THIS = re.compile(r"(?:^|[.;:!>*/#-]\s*|\b(?:file|code|module|class|source|document|schema|content|contents|it|this|datei|fichier|archivo|fichero|bestand)\s+(?:is|are|was|were|has been|have been|wurde|wird|ist|a ete|est|fue|es|ha sido|werd|is)?\s*(?:\w+\s+)?)$")
_A_COPY = re.compile(r"(?:^|[.;:]\s*|\b(?:verbatim|unmodified|modified|exact|local|vendored|patched|pinned|frozen|an?|this|is|une|una|eine)\s+)$")
_SPLIT = re.compile(r"(?<=[.;!?])\s+|\n\s*\n")
_MARKS = re.compile(r"^(?:<!--|[\s/*#;%!-])+|\*/\s*$|-->\s*$", re.M)
_NAMESPACE = re.compile(r"^\s*(?:package (?:(?:org|com|net|io)\.)?([\w]+)|from ([\w]+)[\w.]* import|use ([\w]+)::|import .*?from ['\"](@?[\w./-]+)['\"])", re.M)
_COMMENT = ("//", "#", "--", "*", "/*", '"""', "'''", ";", "<!--", "%")


def _automaton():
    """One automaton over all words; a word may play several roles."""
    import ahocorasick

    roles: dict[str, set[str]] = {}
    for role, words in (("mark", MARKS), ("licence", LICENCES), ("made", MADE), ("machine", MACHINE), ("edit", EDIT), ("not", NOT), ("lost", LOST), ("copied", COPIED)):
        for w in words:
            roles.setdefault(w, set()).add(role)
    a = ahocorasick.Automaton()
    for w, r in roles.items():
        a.add_word(w, (len(w), tuple(sorted(r))))
    a.make_automaton()
    return a


_CACHE: dict = {}


def fold(text: str) -> str:
    """Lower case without accents; ß becomes ss."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss").lower()) if not unicodedata.combining(c))


def header(body: str) -> str:
    """The leading comment block: every line up to the first line of code, shebang and directives included."""
    out, quote = [], ""
    for line in body.splitlines():
        s = line.strip().lstrip("﻿")
        if quote:
            out.append(s)
            if quote in s:
                quote = ""
            continue
        if not s:
            continue
        if not s.startswith(_COMMENT):
            break
        out.append(s)
        for q in ('"""', "'''"):
            if s.startswith(q) and s.count(q) == 1:
                quote = q
        if s.startswith(("/*", "<!--")) and "*/" not in s and "-->" not in s:
            quote = "*/" if s.startswith("/*") else "-->"
    return "\n".join(out)


def notice(head: str) -> str:
    """What a header claims of its file: ``generated``, ``copy`` or ``''``.

    Markers and licence texts count by themselves.  Otherwise a sentence says that
    the file was made ("generated by", "automatically written"), by or from
    something, and either of this file itself, or by a machine, or with a warning
    against editing anywhere in the header.  Participles that describe another
    thing, denials, work done by hand and talk about notices do not count.
    """
    if "a" not in _CACHE:
        _CACHE["a"] = _automaton()
    auto = _CACHE["a"]
    text = fold(_MARKS.sub("", head))
    # the first pass tells whether there is anything to weigh
    roles = {r for _, (_, rs) in auto.iter(text) for r in rs}
    if not roles & {"mark", "licence", "made", "copied"}:
        return ""
    made = own = machine = warned = denied = copied = False
    for sentence in _SPLIT.split(text):
        x = " ".join(sentence.split())
        hits = [(e - n + 1, e + 1, rs) for e, (n, rs) in auto.iter(x)]
        here = {r for _, _, rs in hits for r in rs}
        about = False
        for a, b, rs in hits:
            before, after = x[:a], x[b:]
            whole = not (a and x[a - 1].isalnum() and x[a].isascii() and x[a].isalpha() and x[a - 1].isascii())
            if ("mark" in rs) and not _ABOUT.search(before):
                own = made = True
            if "copied" in rs and whole and (x[a:b] not in ("copy of", "copie de", "copia de") or _A_COPY.search(before)) and not _DENIED.search(before) and _VERSION.search(after) and not _ABOUT.search(before):
                copied = True
            if "made" not in rs or not (whole or before.endswith("auto")):
                continue
            if _ABOUT.search(before):
                about = True
            elif _DENIED.search(before) or _BY_HAND.search(after):
                denied = True
            elif _NOUN_BEFORE.search(before) and not before.rstrip().endswith(("from the", "of the")) or not _AGENT.search(after) and x[a].isascii() and not x[a:b].endswith((" of", " from", " par")):
                continue
            else:
                made = True
                own |= bool(_THIS.search(before)) and x[a:b] not in ("written", "built", "created", "compiled", "rendered", "derived from", "geschrieben", "escrito", "geschreven", "erstellt", "creado")
                machine |= "machine" in here
        if not about:
            warned |= "lost" in here or ("edit" in here and any("not" in rs and (a == 0 or not x[a - 1].isalnum()) and (b == len(x) or not x[b].isalnum() or not x[b].isascii() or not x[a].isascii()) or "not" in rs and x[a:b] == "n't" for a, b, rs in hits))
        if {"machine", "edit"} <= here and not about and re.search(r"(?:machine|maschinell|auto)[- ]?(?:made|written|erzeugt|created|generated|built)", x) and not _DENIED.search(x.split("auto")[0]):
            made = own = True
    if made and not denied and (own or machine or warned):
        return "generated"
    if copied or "licence" in roles:
        return "copy"
    return ""


_DATA = re.compile(r"[\d\s.,+\-:;()\[\]{}'\"]+")
_LITERAL = re.compile(r"\b0[xX][0-9a-fA-F_]+|\\x[0-9a-fA-F]{2}|\(byte\)")
_STRING = re.compile(r"\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'", re.S)


def _opaque(m: re.Match) -> str:
    s = next((g for g in m.groups() if g is not None), "")
    prose = s.count(" ") * 12 > len(s)
    return "x" * len(s) if prose else "1" * len(s)


def layout(body: str) -> str:
    """``minified``, ``data`` or ``''`` from the shape of the code outside comments."""
    lines = [x for x in body.splitlines() if x.strip() and not (x.lstrip().startswith(("//", "#", "--", "* ")) and not x.lstrip().startswith("#!"))]
    code = "\n".join(lines)
    n = len(code)
    if n < 300:
        return ""
    inserts = sum(1 for x in lines if x[:12].lower().startswith("insert into") or x[:2] in ("('", "(1"))
    if len(lines) >= 8 and inserts >= 0.8 * len(lines):
        return "data"
    bare = _LITERAL.sub(lambda m: "9" * len(m.group()), _STRING.sub(_opaque, code))
    if sum(len(m) for m in _DATA.findall(bare)) >= 0.8 * n and (len(re.findall(r"\d", bare)) >= 0.2 * n):
        return "data"
    longest = [x for x in lines if len(x) > 300]
    white = sum(1 for c in code if c in " \t\n")
    if sum(map(len, longest)) >= 0.6 * n and white < 0.12 * n:
        return "minified"
    return ""


def judge(body: str | None) -> tuple[str, str]:
    """(kind of non-source content or '', first namespace declared or imported)."""
    if not body:
        return "", ""
    head = header(body)
    m = _NAMESPACE.search(body)
    name = next((g for g in m.groups() if g), "").lower().replace("-", "_") if m else ""
    kind = notice(head) if head else ""
    if not kind and head and _RIGHTS.search(fold(head)):
        kind = "copy"
    if not kind:
        kind = layout(body)
        if not kind and _ARTICLE.match(body.lstrip()):
            kind = "copy"
    return kind, name


_JUDGED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("namespace", T.StringType())])


@F.pandas_udf(_JUDGED)
def _judge(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(b) for b in body], columns=["kind", "namespace"])


def path_kind(path: Column) -> Column:
    """What the path alone says, or null."""
    return (
        F.when(path.rlike(LOCKS), "lock")
        .when(path.rlike(ALWAYS_OUTSIDE) | path.rlike(OUTSIDE_FOLDER), "vendored")
        .when(path.rlike(MINIFIED_NAME) | path.rlike(BUNDLE_NAME), "minified")
        .when(path.rlike(GENERATED_FOLDER) | path.rlike(GENERATED_NAME), "generated")
    )


def classify(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row per path with ``kind`` (null: hand-written) and ``evidence``."""
    importable(files.sparkSession)
    f = files.where(F.col("path").isNotNull()).select("path", "git_blob_sha").withColumn("by_path", path_kind(F.col("path")))
    b = blobs.where(F.col("git_blob_sha").isNotNull()).groupBy("git_blob_sha").agg(F.first("body", ignorenulls=True).alias("body"))
    b = b.withColumn("j", _judge("body")).select("git_blob_sha", "j.kind", "j.namespace", F.length("body").alias("n_chars"))
    outside = f.where(F.col("git_blob_sha").isNotNull()).groupBy("git_blob_sha").agg(F.max((F.col("by_path") == "vendored").cast("int")).alias("lies_outside"))
    # a small row per blob, written once: the joins below and their key counts would judge every body again
    b = materialise(b.join(outside, "git_blob_sha", "left"), "judged")
    f = salted_left_join(f, b, "git_blob_sha", F.col("path"))
    names = (
        f.where(F.col("by_path") == "vendored")
        .select(F.regexp_replace(F.lower(F.regexp_extract("path", OUTSIDE_NAME, 1)), "-", "_").alias("namespace"))
        .where("namespace <> ''")
        .distinct()
        .withColumn("known_outside", F.lit(True))
    )
    own = F.array_contains(F.split(F.regexp_replace(F.lower("path"), "-", "_"), "/"), F.col("namespace"))
    f = f.withColumn("namespace", F.when(F.col("namespace").isNull() | (F.col("namespace") == "") | own, None).otherwise(F.col("namespace")))
    f = salted_left_join(f, names, "namespace", F.col("path"))
    kind = F.coalesce(
        F.when(F.col("kind") != "", F.col("kind")),
        F.col("by_path"),
        F.when((F.col("lies_outside") == 1) & (F.col("n_chars") >= 80), "copy"),
        F.when(F.col("known_outside"), "copy"),
    )
    evidence = F.when(F.col("kind") != "", "content").when(F.col("by_path").isNotNull(), "path").when((F.col("lies_outside") == 1) & (F.col("n_chars") >= 80), "same blob").when(F.col("known_outside"), "package name")
    return f.select("path", kind.alias("kind"), evidence.alias("evidence")).groupBy("path").agg(F.max("kind").alias("kind"), F.max("evidence").alias("evidence"))


def found(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("kind").isNotNull()).select("path")
