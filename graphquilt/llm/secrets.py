"""Credentials in excerpts of code, configuration and notes (problem 1).

Excerpts are lexed into tokens with positions, a linear-chain CRF labels them
with shape and context features, and the Viterbi spans are exactly the characters
to redact.  The CRF is fitted offline to labelled excerpts of public formats
(``secret_forms``; ``EXAMPLES`` of them, a documented bound on training examples and
not on the data); ``python -m graphquilt.llm.secrets`` fits it again and writes
``MODEL`` with its recipe.  The weights, under 1 MB whatever the data, go to the
tasks by broadcast.  An exact check afterwards drops spans that are references,
placeholders or masks.

Every distinct excerpt is labelled once, a batch of them at a time.  Defined
results: a null or empty value holds nothing and stays as it is; repeated ids give
one row in ``found``; the scanner, key and severity are not consulted; texts of any
length are labelled whole (cut only at line ends into windows of ``WINDOW`` tokens,
with the state of key blocks carried across).
"""

from __future__ import annotations

import base64
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import salted_left_join
from ..session import importable, spread
from .crf import CRF

#: Number of generated training excerpts.
EXAMPLES = 40_000
SEED = 7
EPOCHS = 8
WINDOW = 2000
#: The fitted weights; the recipe (examples, seed, epochs) is stored with them.
MODEL = Path(__file__).with_name("secrets_model.npz")

_LEX = re.compile(r"(?<=://)[^\s/\"'<>@:?#(){}\[\]]+(?:/[\w.~-]+)*?/(?=[A-Za-z0-9_-]{16,}(?![\w/.-]))|\\[nrt]|\r?\n|-----[A-Z0-9 ]+-----|(?<!\S)-[a-zA-Z](?=[^\s-])|\$\{[^}\n]*\}|\{\{[^}\n]*\}\}|<[a-z_][\w-]*>|</[a-z_][\w-]*>|://|[^\s\"'`<>(){}\[\],;:=@|\\]+|\S")
# Openings of issued tokens, as their issuers publish them.
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "sk-proj-", "sk-ant-", "sk_live_", "sk_test_", "rk_live_", "AKIA", "ASIA", "glpat-", "xoxb-", "xoxp-", "xapp-", "AIza", "eyJ", "npm_", "hf_", "SG.", "dop_v1_", "shpat_", "pypi-", "ya29.", "key-")
_PREFIX = re.compile("|".join(map(re.escape, sorted(PREFIXES, key=len, reverse=True))))
_ISSUED = re.compile(r"[a-z]{2,6}[_-](?=[0-9A-Za-z-]*\d)[0-9a-zA-Z]{7,}")
_MASK = re.compile(r"\*{2,}|x{6,}|X{6,}|\.{3}|…|•{2,}|#{4,}")
_HOLDER = re.compile(r"(?i)change[_-]?me|replace[_-]?me|your[_-]|_here$|example|placeholder|redacted|masked|dummy|sample|todo|fill[_-]?in|insert|<|secret_\d|^none$|^null$|^true$|^false$|^undefined$|^password$|^secret$|^token$")
_KEYS = (
    ("pw", re.compile(r"(?i)pass(?!ed|ing|es\b)|pwd|passwd|kennwort|contrase|phrase|\bpin\b")),
    ("sec", re.compile(r"(?i)secret|credential|\bcreds?\b")),
    ("tok", re.compile(r"(?i)token(?!s\b|_count|iz)|jwt|bearer|session|auth|basic|pat\b|tok\b")),
    ("key", re.compile(r"(?i)key(?!board|word|map|stone|note|frame)|private|\baes\b|sign|\bhmac\b")),
    ("sum", re.compile(r"(?i)sha\d*|hash|sum|digest|integrity|commit|etag|md5|uuid|tenant|\bid\b|_id$|version")),
    ("loc", re.compile(r"(?i)url|uri|host|endpoint|server|path|file|image|data")),
    ("who", re.compile(r"(?i)user|login|name|owner|mail|notify|email")),
    ("num", re.compile(r"(?i)max|count|limit|timeout|retries|port|len|size|pool")),
)


def lex(text: str) -> list[tuple[int, int, str]]:
    """Tokens (start, end, text); white space but for line ends is dropped."""
    return [(m.start(), m.end(), m.group()) for m in _LEX.finditer(text) if not m.group().isspace() or "\n" in m.group()]


_FORM = str.maketrans(string.ascii_uppercase + string.ascii_lowercase + string.digits, "X" * 26 + "x" * 26 + "9" * 10)
_TWICE = re.compile(r"(.)\1+")
_BEYOND = re.compile(r"[^\W\d_]")


#: Longer tokens are no names of anything.
LONGEST_NAME = 48


def _shape(w: str) -> str:
    """Letter case, digits and signs, runs folded, the first ten."""
    s = w.translate(_FORM)
    if not s.isascii():
        s = _BEYOND.sub("x", s)
    return _TWICE.sub(r"\1", s)[:10]


def _entropy(w: str) -> float:
    n = len(w)
    return -sum(c / n * math.log2(c / n) for c in Counter(w).values())


_ANY_KEY = re.compile("|".join("(?:" + rx.pattern.replace("(?i)", "") + ")" for _, rx in _KEYS), re.I)


def _keys(w: str) -> list[str]:
    """What the token names."""
    return [name for name, rx in _KEYS if rx.search(w)] if len(w) <= LONGEST_NAME and _ANY_KEY.search(w) else []


_B64 = re.compile(r"[A-Za-z0-9+/]{12,}")


_HEX = re.compile(r"[0-9a-f]+")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_IDENT = re.compile(r"(?i)[a-z]+([_.][a-z]+)*")
_CAMEL = re.compile(r"[a-z]+[A-Z][A-Za-z]*")
_PHRASE = re.compile(r"[a-z]+(-[a-z]+){2,}")
_WORD_NUMBER = re.compile(r"[A-Za-z]+[-_!.]?\d{3,}[!#%_.*]*")
_ODD = re.compile(r"[!#%&*$^+~]")
_DOMAIN = re.compile(r"\.[a-z]{2,}(/|$)")
_PATH = re.compile(r"[a-z0-9_.-]+(/[A-Za-z0-9_.-]+){2,}")
_CHORD = re.compile(r"(?i)(?:ctrl|control|cmd|alt|shift|meta|super|win)(?:[+-]\w+)+")
_ABOUT = re.compile(r"(?i)[_.-]?(?:file|path|dir|field|label|name|hint|regex|pattern|policy|length|hash|type|id|url|uri)$")
_DOTTED = re.compile(r"[a-z]\.[a-z]")


def _decodes(w: str) -> bool:
    """Whether base64 of printable ASCII."""
    if not 8 <= len(w) <= 400 or not re.fullmatch(r"[A-Za-z0-9+/]+", w):
        return False
    try:
        raw = base64.b64decode(w + "=" * (-len(w) % 4))
        return len(raw) >= 5 and all(32 <= c < 127 for c in raw)
    except ValueError:
        return False


def _own(w: str) -> list[str]:
    """Features of the token itself."""
    n = len(w)
    if w in ("\n", "\r\n"):
        return ["nl"]
    if n <= 2 and not w.isalnum():
        return ["p=" + w]
    low = w.lower()
    form = w.translate(_FORM)
    digits, upper, lower = form.count("9"), form.count("X"), form.count("x")
    if not form.isascii():
        upper += sum(c.isupper() for c in form if c > "\x7f")
        lower += sum(c.isalpha() and not c.isupper() for c in form if c > "\x7f")
    letters = upper + lower
    special = n - digits - letters
    kinds = (digits > 0) + (upper > 0) + (lower > 0) + (special > 0)
    out = [
        "sh=" + _shape(w),
        f"n={min(n, 12) if n < 12 else 12 + n // 8}",
        f"k={kinds}",
        f"e={int(_entropy(w) * 2)}",
        f"d={int(4 * digits / n)}",
        f"ks={kinds}{min(n // 4, 6)}",
    ]
    if n < 24 and digits < 3:
        out.append("w=" + low)
    if _PREFIX.match(w):
        out.append("prefix" if n >= 14 else "prefix-short")
    elif _ISSUED.match(w):
        out.append("issued")
    if _MASK.search(w):
        out.append("mask")
    if n <= LONGEST_NAME and _HOLDER.search(w):
        out.append("holder")
    if w.startswith(("${", "{{", "$(", "%(", "<")):
        out.append("ref")
    if _HEX.fullmatch(low):
        out.append(f"hex{n if n in (32, 40, 64, 128) else n // 16}")
    elif n == 36 and _UUID.fullmatch(low):
        out.append("uuid")
    if _B64.fullmatch(w):
        out.append("b64" + ("L" if n >= 40 else "S"))
        if _decodes(w):
            out.append("reads-back")
    if not digits:
        if _IDENT.fullmatch(w):
            out.append("ident")
        if upper and _CAMEL.fullmatch(w):
            out.append("camel")
        if special > 1 and _PHRASE.fullmatch(w):
            out.append("phrase")
    elif digits >= 3 and _WORD_NUMBER.fullmatch(w):
        out.append("word-number")
    if special and _ODD.search(w):
        out.append("odd")
    if w.isdigit():
        out.append("number")
    if "." in w and _DOMAIN.search(w):
        out.append("domain")
    if "/" in w and (w[0] in "/~." or _PATH.fullmatch(w)):
        out.append("path")
    if special and n < 30 and _CHORD.fullmatch(w):
        out.append("chord")
    return out + ["is-" + name for name in _keys(w)]


def _near(w: str) -> list[str]:
    """How a token looks to its neighbours."""
    if w in ("\n", "\r\n"):
        return ["nl"]
    if len(w) <= 3 and not w.isalnum():
        return [w]
    out = _keys(w)
    if w.startswith(("${", "{{")):
        out.append("ref")
    if w.startswith("<"):
        out.append("tag")
    if len(w) <= LONGEST_NAME and _ABOUT.search(w):
        out.append("about")
    if len(w) < 14 and sum(c.isdigit() for c in w) < 3:
        out.append(w.lower())
    if "." in w and _DOTTED.search(w):
        out.append("domain")
    if not out:
        out.append("long")
    return out


class Featurer:
    """Turns tokens into rows of ``SLOTS`` parts; a part is numbered once by its key and stands for a set of features.

    The parts of a token: itself, the tokens around it (three), its class with the
    key of its line and what stands between, its class between its neighbours, its
    class with the words of its line, and its class with the quote and the open key
    block.
    """

    SLOTS = 8
    #: Parts kept before the table starts afresh.
    MOST = 400_000

    def __init__(self, vocabulary: frozenset | None = None) -> None:
        self.vocabulary = vocabulary
        self.token: dict[str, tuple] = {}
        self.number: dict[tuple, int] = {}
        self.features: list[list[str]] = []

    def reset(self) -> None:
        self.token.clear()
        self.number.clear()
        self.features.clear()

    def full(self) -> bool:
        return len(self.features) > self.MOST

    def _see(self, w: str) -> tuple:
        """(own part, part as left, second left and right neighbour, classes, name as neighbour, key class, is a word, line words)."""
        own, near = _own(w), _near(w)
        top = tuple(x for x in own if x in _CLASSES or x.startswith("hex")) or ("plain",)
        k = next((x for x in ("pw", "sec", "tok", "key", "sum", "who", "num", "loc") if x in near), "")
        low = w.lower()
        words = frozenset(x for x in re.findall(r"[a-z]+", low) if 1 < len(x) < 14 and (self.vocabulary is None or x in self.vocabulary)) if len(low) < 40 else frozenset()
        put = self._put
        got = self.token[w] = (
            put(("o", w), lambda: ["bias", *own]),
            put(("<", *near), lambda: ["<" + x for x in near]),
            put(("<<", *near), lambda: ["<<" + x for x in near]),
            put((">", *near), lambda: [">" + x for x in near]),
            top,
            near[0],
            k,
            len(w) > 3 or w.isalnum(),
            words,
            own[2] if len(own) > 2 else "",
        )
        return got

    def _put(self, key: tuple, make) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.features)
            self.features.append(make())
        return n

    def __call__(self, toks: list[str], block: str = "") -> tuple[list[list[int]], str]:
        """Parts of each token, and the kind of key block still open at the end."""
        get = self.token.get
        seen = [get(w) or self._see(w) for w in toks]
        n = len(toks)
        edge = get("\n") or self._see("\n")
        # words of each line
        line_of: list[frozenset] = []
        words: set = set()
        for w, s in zip(toks, seen, strict=True):
            if w == "\n" or w == "\r\n":
                line_of.append(frozenset(words))
                words = set()
            elif s[8]:
                words |= s[8]
        line_of.append(frozenset(words))
        put, number = self._put, self.number
        out: list[list[int]] = []
        row, line_key, quote, since, seps = 0, "", "", 0, ""
        last = -1
        for i, w in enumerate(toks):
            s = seen[i]
            if w == "\n" or w == "\r\n":
                row, line_key, quote, since, seps = row + 1, "", "", 0, ""
                out.append([s[0]])
                continue
            if w.startswith("-----"):
                block = ("private" if "PRIVATE" in w else "public" if "PUBLIC" in w else "cert") if "BEGIN" in w else ""
            b1 = seen[i - 1] if i else edge
            b2 = seen[i - 2] if i > 1 else edge
            a1 = seen[i + 1] if i + 1 < n else edge
            top = s[4]
            wordy = s[7]
            if wordy:
                short = seps[-2:]
                few = since if since < 3 else 3
                k1 = ("k", top, s[9], line_key, short, few)
                p1 = number.get(k1)
                if p1 is None:
                    p1 = put(k1, lambda: ["key=" + line_key, f"key={line_key}|{short}|{few}", *[f"{x}|key={line_key}" for x in top], *[f"{x}|key={line_key}|{short}" for x in top], f"kinds|{s[9]}{line_key}"])
                after = toks[i + 1] if i + 1 < n else "\n"
                then = (seen[i + 2][5] if i + 2 < n else "nl") if after in _LINKS else ""
                k2 = ("n", top, b1[5], a1[5], then)
                p2 = number.get(k2)
                if p2 is None:
                    p2 = put(k2, lambda: [*[f"{x}|<{b1[5]}" for x in top], *[f"{x}|<{b1[5]}|>{a1[5] if len(a1[5]) < 4 else '-'}" for x in top], *([">>" + then] if then else [])])
                ws = line_of[row]
                k3 = ("l", top, ws)
                p3 = number.get(k3)
                if p3 is None:
                    p3 = put(k3, lambda: [*["line:" + x for x in sorted(ws)], *[f"line:{x}|{top[0]}" for x in sorted(ws)]])
                k4 = ("q", top, quote, block)
                p4 = number.get(k4)
                if p4 is None:
                    p4 = put(k4, lambda: ["q=" + quote, *[f"{x}|q={quote}" for x in top], *(["block=" + block, *[f"block={block}|{x}" for x in top]] if block else [])])
                out.append([s[0], b1[1], b2[2], a1[3], p1, p2, p3, p4])
            else:
                k1 = ("p", w, line_key, quote)
                p1 = number.get(k1)
                if p1 is None:
                    p1 = put(k1, lambda: ["q=" + quote, f"p|{w}|{line_key}", f"p|{w}|{quote}"])
                out.append([s[0], b1[1], a1[3], p1])
            # state for what follows on the line
            if w == '"' or w == "'" or w == "`":
                quote = "" if quote == w else w if not quote else quote
            elif w in _SEPARATORS:
                seps += w[0] if w != "://" else "u"
            elif wordy:
                since += 1
                if s[6]:
                    line_key, since, seps = s[6], 0, ""
                elif i + 1 < n and toks[i + 1] in ("=", ":") and (w[0].isalpha() or w[0] == "_"):
                    line_key, since, seps = "other", 0, ""
        return out, block


_LINKS = ("(", ".", "=", ":")
_SEPARATORS = frozenset(("=", ":", "://", "@", "/", "+", ",", ";", "(", ">"))
_CLASSES = frozenset(("prefix", "issued", "mask", "holder", "ref", "uuid", "b64L", "b64S", "reads-back", "ident", "camel", "phrase", "word-number", "odd", "number", "domain", "path", "chord"))


def _labels(toks: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[int]:
    """0 outside, 1 first token of a secret, 2 further token."""
    out = []
    for s, e, _ in toks:
        k = next(((a, b) for a, b in spans if a <= s and e <= b), None)
        out.append(0 if k is None else 1 if s == k[0] else 2)
    return out


def train(examples: int = EXAMPLES, seed: int = SEED, epochs: int = EPOCHS) -> CRF:
    """The CRF fitted to generated excerpts of public formats."""
    from .secret_forms import Generator

    g, f = Generator(seed), Featurer()
    data = []
    for _ in range(examples):
        text, spans = g.example()
        toks = lex(text)
        if toks:
            data.append((f([t for _, _, t in toks])[0], _labels(toks, spans)))
    return CRF.fit(data, f.features, 3, epochs=epochs).pruned(0.05)


_LOADED: dict = {}


def model() -> CRF:
    """The stored CRF."""
    if "crf" not in _LOADED:
        _LOADED["crf"] = CRF.loads(MODEL.read_bytes())[0]
    return _LOADED["crf"]


# ------------------------------------------------------------------ labelling


class Labeller:
    """Spans of secrets in texts, many at a time."""

    def __init__(self, crf: CRF) -> None:
        self.crf = crf
        self.features = Featurer(frozenset(f[5:] for f in crf.index if f.startswith("line:") and "|" not in f))
        self.table = np.zeros((0, crf.emit.shape[1]), dtype=np.float32)

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        """Emissions of token rows; parts seen for the first time are scored and kept."""
        fs = self.features.features
        if len(fs) > len(self.table):
            new = np.array([self.crf.part(fs[k]) for k in range(len(self.table), len(fs))], dtype=np.float32)
            self.table = np.concatenate([self.table, new])
        per = np.array([len(r) for r in rows])
        flat = self.table[[k for r in rows for k in r]]
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(per)[:-1]]), axis=0)

    def many(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """Spans of each text."""
        if self.features.full():
            self.features.reset()
            self.table = self.table[:0]
        windows: list[tuple[int, list[tuple[int, int, str]]]] = []
        rows: list[list[int]] = []
        for k, text in enumerate(texts):
            toks = lex(text) if text else []
            block, at = "", 0
            while at < len(toks):
                end = min(len(toks), at + WINDOW)
                if end < len(toks):
                    end = next((j for j in range(end, at + WINDOW // 2, -1) if "\n" in toks[j - 1][2]), end)
                part = toks[at:end]
                got, block = self.features([t for _, _, t in part], block)
                rows += got
                windows.append((k, part))
                at = end
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not windows:
            return out
        labels = self.crf.decode(self._scores(rows), [len(p) for _, p in windows])
        for (k, part), ys in zip(windows, labels, strict=True):
            mine = out[k]
            for i in np.flatnonzero(ys):
                s, e, _ = part[i]
                if ys[i] == 1 or not mine or mine[-1][1] < s:
                    mine.append((s, e))
                else:
                    mine[-1] = (mine[-1][0], e)
        for k, mine in enumerate(out):
            if mine:
                text = texts[k]
                # base64 padding belongs to its literal
                mine = [(s, e + len(text[e : e + 2]) - len(text[e : e + 2].lstrip("=")) if re.fullmatch(r"[A-Za-z0-9+/_-]{8,}", text[s:e]) else e) for s, e in mine]
                out[k] = [x for x in mine if _real(text, *x)]
        return out

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        return self.many([text])[0]


def _real(text: str, s: int, e: int) -> bool:
    """The exact check: the characters could grant access as they stand."""
    w = text[s:e]
    if len(w) < 4 or len(set(w)) < 3:
        return False
    if _MASK.search(w) and len(set(w)) < 12:
        return False
    if w.startswith(("${", "{{", "$(", "%(", "<", "[", "{")) or (w[0] == "$" and re.fullmatch(r"\$[A-Z][A-Z_]+", w)):
        return False
    return not re.fullmatch(r"(?i)(change|replace)[_-]?me|your[_-].*|.*_here|example|placeholder|redacted|null|none|true|false|password|secret|token", w)


def redact_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced by a numbered placeholder; equal values share a number."""
    seen: dict[str, int] = {}
    out, at = [], 0
    for s, e in spans:
        n = seen.setdefault(text[s:e], len(seen) + 1)
        out += [text[at:s], f"<SECRET_{n}>"]
        at = e
    return "".join([*out, text[at:]])


_OUT = T.StructType([T.StructField("_k", T.StringType()), T.StructField("n_secrets", T.IntegerType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("redacted", T.StringType())])


#: Texts labelled at a time.
BATCH = 2000


def kept_labeller(weights: tuple) -> Labeller:
    """One labeller a worker: what it learned of tokens serves the next task."""
    if "labeller" not in _LOADED:
        _LOADED["labeller"] = Labeller(CRF(*weights))
    return _LOADED["labeller"]


def label(values: DataFrame) -> DataFrame:
    """``_k`` (md5 of the value), number and spans of secrets, redacted value, of every distinct value."""
    spark = values.sparkSession
    importable(spark)
    crf = model()
    sent = spark.sparkContext.broadcast((crf.index, crf.emit, crf.move))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lab = kept_labeller(sent.value)
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                keys, texts = pdf._k.iloc[at : at + BATCH].tolist(), pdf.value.iloc[at : at + BATCH].tolist()
                spans = lab.many(texts)
                yield pd.DataFrame([(k, len(sp), [list(x) for x in sp], redact_text(v, sp)) for k, v, sp in zip(keys, texts, spans, strict=True)], columns=["_k", "n_secrets", "spans", "redacted"])

    # a secret has at least four characters without white space, so a value without them holds none
    distinct = values.where(F.col("value").rlike(r"\S{4}")).select("value").distinct().withColumn("_k", F.md5("value"))
    return spread(distinct.select("_k", "value")).mapInPandas(run, _OUT)


def redact(findings: DataFrame) -> DataFrame:
    """One row per distinct (id, value): ``id, value, n_secrets, spans, redacted``."""
    f = findings.select("id", "value").distinct().withColumn("_k", F.md5("value"))
    x = salted_left_join(f, label(findings), "_k", F.col("id"))
    return x.select("id", "value", F.coalesce("n_secrets", F.lit(0)).alias("n_secrets"), "spans", F.coalesce("redacted", "value").alias("redacted"))


def found(redacted: DataFrame) -> DataFrame:
    return redacted.where("n_secrets > 0 and id is not null").select("id").distinct()


if __name__ == "__main__":
    MODEL.write_bytes(train().dumps({"examples": EXAMPLES, "seed": SEED, "epochs": EPOCHS}))
