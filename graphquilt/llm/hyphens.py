"""Syllables by hyphenation rules.

A word is taken apart at the seams of its suffixes, silent letters are passed over,
neighbouring vowels that belong to two syllables are parted, and the consonants
between two nuclei go to the second one as far as a word could begin with them
(maximal onset).  The parts, joined, are the word again.
"""

from __future__ import annotations

import re

_ONSETS = {
    "en": "bl br ch cl cr dr dw fl fr gl gn gr kn ph pl pr qu sc sch scr sh shr sk sl sm sn sp sph spl spr squ st str sw th thr tr tw wh wr",
    "de": "bl br ch chr dr fl fr gl gn gr kl kn kr pf pfl pfr ph pl pr qu sch schl schm schn schr schw sp spr st str th tr tsch zw",
    "fr": "bl br ch chr cl cr dr fl fr gl gn gr ph phl phr pl pr qu th tr vr",
    "es": "bl br ch cl cr dr fl fr gl gr ll pl pr qu rr tr",
    "nl": "bl br ch dr fl fr gl gr kl kn kr pl pr sch schr sl sm sn sp spl spr st str th tr tw vl vr wr zw",
}
_ONSET = {k: frozenset(v.split()) for k, v in _ONSETS.items()}
_NUCLEI = {
    "en": re.compile(r"[aeiouy]+"),
    "de": re.compile(r"aa|ee|oo|ie|ei|ai|ay|ey|au|eu|äu|ui(?=t)|[aeiouyäöü]"),
    "fr": re.compile(r"eau|oeu|œu|aî|aie|ai|au|ei|eu|ou(?![eaiï])|oi|ui|ie(?!z)|io(?=n)|œ|[aeiouyàâäéèêëîïôöùûü]"),
    "es": re.compile(r"[iuü]?[aeoáéó][iuy]?(?![aeoáéó])|[iuü]?[aeoáéó]|[iuíúü]+y?|y(?=$|[^aeiou])"),
    "nl": re.compile(r"aai|ooi|oei|eeu|ieu|aa|ee|oo|uu|ie|oe|eu|ui|ei|ij|ou|au|[aeiouyäëïöü]"),
}
#: Suffixes that begin a part of their own, so that an e before them is a last one.
_SUFFIX = re.compile(r"(?<=[^aeiouy]e)(?=(?:ment|ly|ness|less|ful|some|thing|where|time|body|how|what|ware|work|way|line|side|place|name|man|men|like|ship|hood|ty|fore)(?:s|ly|ed|ing)?$)|(?<=some)(?=(?:one|times?)$)|(?<=any)(?=one$)|(?<=every)(?=one$)|(?<=on)(?=e?self$)|(?<=[a-z]{3}ct)(?=ual)")
#: Two vowels side by side that belong to two syllables, and where they do not.
_PARTED = re.compile(
    r"(?<=cr)e(?=at)|(?<=^r)e(?=act|ali[stz]|all[io]|arr|ass|app|add|uni|us[ei]|im|in[dfhjsv]|ent|ord|op)|(?<=th)e(?=[ao])|(?<=^id)e(?=a)|(?<=ar)e(?=a)|(?<=^pr)e(?=[eo]m|occ|ex)|(?<=in)e(?=a)|(?<=vid)e(?=o)|(?<=er)e(?=o)|(?<=^g)e(?=o)|(?<=^n)e(?=o)|(?<!g)e(?=ou)|e(?=u[ms]$)"
    r"|(?<=^b)i(?=o)|(?<=^d)i(?=[ao])|(?<=^tr)i(?=[ao])|(?<=^[gv])i(?=[ao])|(?<=^qu)i(?=et)|(?<=^sc)i(?=en)|(?<=[^aeiouctsxg])i(?=a(?!g?ge))|(?<=[^aeiouctsxgh])i(?=o(?!us?ly)(?!ur))|(?<=[^aeiouctsxg])i(?=um|us$)|(?<=[dlr])i(?=en(?!d))|(?<=v)i(?=et)|(?<=^d)i(?=et)|(?<=s)i(?=ety)|(?<=oc)i(?=et)|(?<=r)i(?=et)|(?<=[a-z]{2}[bdlnrtfps])i(?=e(?:r|st)$)"
    r"|(?<=[^qgs])u(?=[ao](?!y))|(?<=us)u(?=al)|(?<=[^qgl])u(?=e[ln]|et|e[rs]t)|(?<=[fl])u(?=en)|(?<=t)u(?=i[to])|(?<=^r)u(?=in)|(?<=^fl)u(?=id)|[oeu](?=ings?$)|(?<=[^aeiou])y(?=ing)|(?<=[aeo])y(?=er|o)"
    r"|(?<=^n)a(?=[iï]v)|(?<=ch)a(?=o)|(?<=^c)o(?=[ae]x|op|ord|inc|ef|exi|er[ci])|(?<=^p)o(?=e[tm])|^o(?=as)|(?<=[^aeiou])o(?=e(?:v|t)(?!s))|[ao](?=ï)|[oe](?=ë)"
)
# Common words that no rule reads.
_WHOLE = {"business": ("busi", "ness"), "businesses": ("busi", "ness", "es"), "people": ("peo", "ple"), "something": ("some", "thing"), "being": ("be", "ing"), "area": ("a", "re", "a"), "areas": ("a", "re", "as"), "idea": ("i", "de", "a"), "ideas": ("i", "de", "as"), "colonel": ("colo", "nel"), "wednesday": ("wednes", "day"), "queue": ("queue",), "queues": ("queues",), "queued": ("queued",), "employee": ("em", "ploy", "ee"), "one": ("one",), "someone": ("some", "one"), "anyone": ("a", "ny", "one"), "every": ("ev", "ery"), "everything": ("ev", "ery", "thing"), "different": ("dif", "fe", "rent"), "recipe": ("re", "ci", "pe"), "cache": ("cache",), "pipeline": ("pipe", "line"), "sometimes": ("some", "times")}


def _silent(w: str, at: int, end: int, last: bool) -> bool:
    """Whether the nucleus ``w[at:end]`` of an English part is only written: a final e, or the e of -ed and -es."""
    if w[at:end] != "e" or at == 0:
        return False
    rest = w[end:]
    before = w[at - 1]
    if not re.search(r"[aeiouy]", w[:at]):
        return False
    if rest == "":
        return not (before == "l" and at >= 2 and w[at - 2] not in "aeiouylrw")
    if not last:
        return False
    if rest == "d":
        return before not in "td" and not (before == "l" and at >= 2 and w[at - 2] not in "aeiouylrw")
    if rest == "s":
        return before not in "sxzcg" and w[max(0, at - 2) : at] not in ("ch", "sh") and not (before == "l" and at >= 2 and w[at - 2] not in "aeiouylrw")
    return False


def _nuclei(w: str, lang: str, last: bool = True) -> list[tuple[int, int]]:
    rx = _NUCLEI.get(lang) or _NUCLEI["en"]
    found = [(m.start(), m.end()) for m in rx.finditer(w)]
    if lang not in _NUCLEI or lang == "en":
        out: list[tuple[int, int]] = []
        for a, b in found:
            if w[a] == "y" and b - a > 1 and (a == 0 or w[a - 1] not in "aeiou"):
                a += 1  # a consonant
            if w[a : a + 1] == "u" and a and w[a - 1] == "q" and b - a > 1:
                a += 1
            cuts = [a]
            for m in _PARTED.finditer(w, max(0, a - 8), len(w)):
                if a <= m.start() < b - 1 and m.end() < b:
                    cuts.append(m.end())
            cuts = sorted(set(cuts))
            out += list(zip(cuts, [*cuts[1:], b], strict=True))
        out = [(a, b) for a, b in out if not _silent(w, a, b, last)]
        # -sm, -thm: a syllable without a vowel
        if re.search(r"(?:s|th)ms?$", w) and out and len(w) > 3:
            k = len(w) - (2 if w.endswith("s") else 1)
            out.append((k, k + 1))
        return out
    if lang == "fr" and len(found) > 1:
        a, b = found[-1]
        if re.fullmatch(r"es?|ent", w[a:]) and w[a - 1] not in "aeiouyéèê" and (w[a:] != "ent" or w[a - 1] not in "m"):
            found.pop()
    return found


def hyphenate(word: str, lang: str = "en") -> list[str]:
    """The syllables of a word as it is written; a word without a vowel is one."""
    w = word.lower()
    if not w:
        return []
    if lang == "en" and w in _WHOLE:
        cut, at = [], 0
        for p in _WHOLE[w]:
            cut.append(word[at : at + len(p)])
            at += len(p)
        return cut
    seams = [0, *(m.start() for m in _SUFFIX.finditer(w) if 1 < m.start() < len(w)), len(w)] if lang == "en" else [0, len(w)]
    starts: list[int] = []
    onset = _ONSET.get(lang) or _ONSET["en"]
    for i, (s, e) in enumerate(zip(seams, seams[1:], strict=False)):
        part = w[s:e]
        nuc = _nuclei(part, lang, i == len(seams) - 2)
        if not nuc:
            continue
        starts.append(s)
        for (_, b), (a, _) in zip(nuc, nuc[1:], strict=False):
            k = a
            while k > b and (a - k < 1 or part[k - 1 : a] in onset) and not (k - 1 == b and a - k >= 1 and part[k - 1 : a] not in onset):
                k -= 1
            starts.append(s + k)
    if not starts:
        return [word]
    starts[0] = 0
    starts = sorted(set(starts))
    return [word[a:b] for a, b in zip(starts, [*starts[1:], len(word)], strict=True)]


_KEPT: dict[tuple[str, str], int] = {}


def syllables(word: str, lang: str = "en") -> int:
    """Number of syllables, at least one."""
    k = (lang, word)
    n = _KEPT.get(k)
    if n is None:
        if len(_KEPT) > 200_000:
            _KEPT.clear()
        n = _KEPT[k] = max(1, len(hyphenate(word, lang)))
    return n
