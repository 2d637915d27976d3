"""Personal data in free text, replaced by typed placeholders (problem 4).

Numbers are matched by format and validated, then keyed-permuted within their format
by a Feistel network: digits stay digits, letters letters, separators, country codes
and issuer digits stay.  Check digits and letters (payment cards, IBAN, Spanish DNI
and NIE, French social security, German tax id, Dutch BSN, Italian fiscal code) are
computed anew, so a valid number gets a valid pseudonym and an invalid one an invalid
one, and one value becomes one pseudonym in every document however it is written.
Dates of birth are permuted within the calendar where asked for (``dates``); they are
no type of the project's statement, which has nothing else changed.  Names, mailboxes
and addresses get keyed digests.  There is no default key.

Given and family names come from the reference list and from the corpus itself: a
word that follows several listed given names is a family name, a word that stands
before several known families is a given name, and a word written small more often
than with a capital inside a sentence is an everyday word.  All are aggregations over
all entries, which are masked once and written with their spans.

Defined results: a null or empty body holds nothing and stays as it is; repeated
rows count once; several bodies under one path are told apart by the body; types
of overlapping matches: email before id_number before phone before address
before name; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable, materialise, spread

TYPES = ("name", "email", "phone", "id_number", "address")
#: A learned family needs so many different listed given names before it, a learned given name so many families after it.
SUPPORT = 3
#: The reference list is refused beyond this; it is a list of names, not of persons.
MOST_GIVEN = 200_000
#: Learned names are sent to every task up to this many; beyond, each entry is joined with those that occur in it.
MOST_SENT = 300_000
#: Name of the setting that holds the key of the pseudonyms.
KEY_SETTING = "spark.graphquilt.pseudonym.key"

# ------------------------------------------------------------------ numbers


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _round(key: bytes, tweak: str, i: int, half: int, modulus: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tweak}|{i}|{half}".encode(), hashlib.sha256).digest()[:16], "big") % modulus


def feistel(symbols: list[int], radix: int, key: bytes, tweak: str, rounds: int = 8) -> list[int]:
    """A keyed permutation of strings of one length over ``radix`` symbols (alternating Feistel)."""
    n = len(symbols)
    if n == 0:
        return []
    if n == 1:
        return [(symbols[0] + _round(key, tweak, 0, 0, radix)) % radix]
    u = n // 2
    a, b = 0, 0
    for x in symbols[:u]:
        a = a * radix + x
    for x in symbols[u:]:
        b = b * radix + x
    ma, mb = radix**u, radix ** (n - u)
    for i in range(rounds):
        if i % 2 == 0:
            a = (a + _round(key, tweak, i, b, ma)) % ma
        else:
            b = (b + _round(key, tweak, i, a, mb)) % mb
    out = []
    for v, k in ((b, n - u), (a, u)):
        for _ in range(k):
            out.append(v % radix)
            v //= radix
    return out[::-1]


def _permute(s: str, keep: int, key: bytes, tweak: str) -> str:
    """Digits and letters behind the first ``keep`` characters permuted in their places."""
    head, tail = s[:keep], s[keep:]
    d = [int(c) for c in tail if c in "0123456789"]
    a = [ord(c.upper()) - 65 for c in tail if c.isascii() and c.isalpha()]
    d, a = iter(feistel(d, 10, key, tweak + "d")), iter(feistel(a, 26, key, tweak + "a"))
    out = []
    for c in tail:
        if c in "0123456789":
            out.append(str(next(d)))
        elif c.isascii() and c.isalpha():
            x = chr(65 + next(a))
            out.append(x if c.isupper() else x.lower())
        else:
            out.append(c)
    return head + "".join(out)


# The check letters of the Spanish DNI and NIE in the order of the remainder.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
# What the characters at odd places of an Italian fiscal code count.
_FISCAL_ODD = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23), strict=True))


def _luhn_digit(payload: str) -> int:
    return next(d for d in range(10) if luhn(payload + str(d)))


def _steuer_digit(payload: str) -> int:
    """ISO 7064 MOD 11,10."""
    p = 10
    for c in payload:
        x = (int(c) + p) % 10 or 10
        p = 2 * x % 11
    return (11 - p) % 10


def _fiscal(payload: str) -> int:
    return sum(_FISCAL_ODD[c] if i % 2 == 0 else int(c, 36) - (10 if c.isalpha() else 0) for i, c in enumerate(payload)) % 26


def _bsn(payload: str) -> int:
    """Remainder of the Dutch eleven test; 10 is no digit."""
    return sum(int(c) * (9 - i) for i, c in enumerate(payload)) % 11


def _code(c: str, alphabet: str) -> int:
    return alphabet.index(c)


_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (shape, leading characters kept, payload that may come out, check characters, alphabet or None for a number, value of the check)
_NATIONAL = (
    (re.compile(r"\d{8}[A-Z]"), 0, None, 1, _DNI, lambda p: int(p) % 23),
    (re.compile(r"[XYZ]\d{7}[A-Z]"), 1, None, 1, _DNI, lambda p: int(str("XYZ".index(p[0])) + p[1:]) % 23),
    (re.compile(r"[12]\d{4}[\dAB]\d{7,9}"), 1, re.compile(r"\d\d\d(?:0[1-9]|1[0-2])\d[\dAB]\d{6}"), 2, None, lambda p: 97 - int(p.replace("A", "0").replace("B", "0")) % 97),
    (re.compile(r"[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]"), 0, re.compile(r"[A-Z]{6}\d{2}[A-EHLMPRST](?:[04][1-9]|[1256]\d|[37][01])[A-Z]\d{3}"), 1, _UPPER, _fiscal),
    (re.compile(r"[1-9]\d{10}"), 0, re.compile(r"[1-9]\d{9}"), 1, _DIGITS, _steuer_digit),
    (re.compile(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]"), 0, re.compile(r"(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}"), 0, None, None),
)


def _laid_out(value: str, chars: str) -> str:
    """``chars`` in the places of the letters and digits of ``value``."""
    it = iter(chars)
    return "".join((lambda x: x if c.isupper() or c.isdigit() else x.lower())(next(it)) if c.isascii() and c.isalnum() else c for c in value)


def _walk(payload: str, keep: int, key: bytes, tweak: str, allowed: re.Pattern | None) -> str:
    """The payload permuted, again and again until it is one that may come out (cycle walking)."""
    out = payload
    while True:
        out = _permute(out, keep, key, tweak)
        if allowed is None or allowed.fullmatch(out):
            return out


def _number(value: str, key: bytes) -> str:
    """An identity, account or card number permuted within its format."""
    bare = re.sub(r"[^0-9A-Za-z]", "", value).upper()
    if re.match(r"[A-Z]{2}\d{2}", bare) and 15 <= len(bare) <= 34 and mod97(bare):
        body = _permute(bare[4:], 0, key, "iban" + bare[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
        return _laid_out(value, bare[:2] + f"{check:02d}" + body)
    if bare.isdigit() and 13 <= len(bare) <= 19 and luhn(bare):
        # the first digit tells the issuing network
        body = _permute(bare[:-1], 1, key, "card")
        return _laid_out(value, body + str(_luhn_digit(body)))
    if re.fullmatch(r"\d{9}", bare) and "-" not in value and _bsn(bare[:8]) == int(bare[8]):
        body = bare[:8]
        while True:
            body = _permute(body, 0, key, "bsn")
            if _bsn(body) < 10:
                return _laid_out(value, body + str(_bsn(body)))
    for shape, keep, allowed, n_check, alphabet, check in _NATIONAL:
        if not shape.fullmatch(bare):
            continue
        if check is None:  # the last letter is one of four and no check
            body = _walk(bare[:-1], keep, key, "nino", allowed if allowed.fullmatch(bare[:-1]) else None)
            return _laid_out(value, body + "ABCD"[feistel([_code(bare[-1], "ABCD")], 4, key, "nino" + body)[0]])
        if alphabet is None and len(bare) != 15:
            continue
        payload, tail = bare[:-n_check], bare[-n_check:]
        if allowed is not None and not allowed.fullmatch(payload):
            continue
        size = 97 if alphabet is None else len(alphabet)
        if alphabet is not None and tail not in alphabet:
            continue
        off = ((int(tail) if alphabet is None else _code(tail, alphabet)) - check(payload)) % size
        if off and alphabet in (_DIGITS, None):
            continue  # not such a number at all
        body = _walk(payload, keep, key, "national" + str(n_check), allowed)
        c = (check(body) + off) % size
        return _laid_out(value, body + (f"{c or 97:02d}" if alphabet is None else alphabet[c]))
    return _permute(value, 0, key, "id")


_DAY0, _DAYS = date(1900, 1, 1), 73049
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DATE_FORMS = (
    (re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"), ("y", "m", "d")),
    (re.compile(r"(\d{1,2})([./-])(\d{1,2})\2(\d{4})"), ("d", "m", "y")),
)


def date_pseudonym(value: str, key: bytes) -> str:
    """A date of birth permuted among the days of 1900 to 2099 in its own format; one that is no date there stays."""
    for rx, order in _DATE_FORMS:
        m = rx.fullmatch(value)
        if not m:
            continue
        parts = dict(zip(order, (m.group(1), m.group(3), m.group(4)), strict=True))
        try:
            n = (date(int(parts["y"]), int(parts["m"]), int(parts["d"])) - _DAY0).days
        except ValueError:
            return value
        if not 0 <= n < _DAYS:
            return value
        while True:
            bits = feistel([int(c) for c in f"{n:05d}"], 10, key, "date")
            n = int("".join(map(str, bits)))
            if n < _DAYS:
                break
        d = _DAY0 + timedelta(days=n)
        new = {"y": f"{d.year:04d}", "m": f"{d.month:02d}", "d": f"{d.day:02d}"}
        if len(parts["m"]) == 1 or len(parts["d"]) == 1:
            new["m"], new["d"] = str(d.month), str(d.day)
        return m.group(2).join(new[k] for k in order)
    return value


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The value permuted within its format; valid numbers stay valid."""
    if kind == "phone":
        keep = len(re.match(r"(\+\d{1,2}(?=\D)|\+\d|00\d{2}|0?)", value).group())
        return _permute(value, keep, key, "phone")
    return date_pseudonym(value, key) if kind == "date" else _number(value, key)


def session_key(spark) -> bytes:
    """The key named by ``KEY_SETTING``; where none is set, one drawn for this call, so that pseudonyms link within a run and cannot be inverted by anybody."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


# ------------------------------------------------------------------ patterns

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_])?"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"\s?(?:\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\}|<at>)\s?|\s(?:AT|at)\s(?=[\w-]+\s?(?:DOT|dot|\(dot\)|\[dot\]))"
_DOT = r"\s?(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\{\s?dot\s?\})\s?|\s(?:DOT|dot)\s|\."
EMAIL = re.compile(rf"(?<![\w.+%@/-])(?P<local>{_LOCAL})(?:@|{_AT})(?P<host>{_HOST}(?:(?:{_DOT}){_HOST})*(?:{_DOT})[A-Za-z]{{2,}})(?![\w@-])(?!:[\w~/])(?!\.\w)")
# Mailboxes of software and roles, not of persons.
ROLES = frozenset("git svn hg noreply no-reply donotreply do-not-reply root postmaster mailer-daemon daemon build ci bot notifications notification support info abuse webmaster hostmaster security admin administrator sales jobs team hello contact help security-team user username name someone example you me test".split())

PHONES = (
    re.compile(r"(?<![\w+./-])\+\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d(?:[ ./-]?\d){6,12}(?![\w-])(?!\.\d)", re.A),
    re.compile(r"(?<![\w./-])00(?:1|2\d|3[0-46-9]|4\d|5\d|6[0-6]|8\d|9\d)[ ./-]\d(?:[ ./-]?\d){6,11}(?![\w-])(?!\.\d)", re.A),
    re.compile(r"(?<![\w.(/-])\(\d{3}\)\s?\d{3}[ .-]\d{4}(?![\w-])(?!\.\d)", re.A),
    re.compile(r"(?<![\w./-])[2-9]\d{2}([.-])\d{3}\1\d{4}(?![\w-])(?!\.\d)", re.A),
    re.compile(r"(?<![\w./-])(?:1[ .-])?[2-9]\d{2} \d{3} \d{4}(?![\w-])(?! \d)(?!\.\d)", re.A),
    re.compile(r"(?<![\w./-])0\d{4} \d{6}(?![\w-])(?! \d)", re.A),
    re.compile(r"(?<![\w./-])0\d{2,4}[ /-]\d{3,4} \d{3,4}(?![\w-])(?! \d)", re.A),
    re.compile(r"(?<![\w./-])0\d{2,4}/\d{5,9}(?![\w/-])", re.A),
    re.compile(r"(?<![\w./-])0[1-9](?:[ .]\d{2}){4}(?![\w-])(?![ .]\d)", re.A),
    re.compile(r"(?:(?<=电话)|(?<=电话：)|(?<=电话是)|(?<=手机)|(?<=手机：)|(?<=手機：)|(?<=電話)|(?<=電話：)|(?<=전화 )|(?<=전화: ))\+?\d(?:[ -]?\d){6,12}(?![\w-])", re.A),
    re.compile(r"(?i:(?<=tel )|(?<=tel: )|(?<=phone )|(?<=phone: )|(?<=mobile=)|(?<=mobile: ))\d(?:[ ./-]?\d){6,12}(?![\w-])", re.A),
)

#: Where a phone number may begin: seven digits follow with few signs between them.
_PHONE_AT = re.compile(r"(?<![\w./-])(?=[+(]?\d(?:[ ./()-]{0,3}\d){6})[+(\d]", re.A)

_LABEL = r"(?i:ssn|social security(?: (?:no\.?|number))?|tax ?(?:id|no\.?|number)|tin|itin|steuer-?id(?:entifikationsnummer|nr\.?)?|steuernummer|ni(?:no)?(?: number| no\.?)?|national insurance(?: number| no\.?)?|dni|nie|nif|passport(?: no\.?| number)?|reisepass(?:nr\.?|nummer)?|pasaporte|passeport|personalausweis|id card|identity card|carte d'identit[ée]|driv(?:er|ing)(?:'?s|’s)? ?licen[cs]e(?: no\.?| number)?|f[üu]hrerschein|permis de conduire|n[°o]\.? de s[ée]curit[ée] sociale|s[ée]curit[ée] sociale|num[ée]ro de s[ée]cu|iban|account(?: no\.?| number)|kontonummer|bsn|personnummer|codice fiscale|card(?: no\.?| number)?|kreditkarte|carte(?: bancaire)?|tarjeta)"
_ID_VALUE = r"[A-Z0-9](?:[A-Z0-9]|[ -](?=[A-Z0-9]*\d|[A-Z]\b(?! [a-z]))){3,40}"
IDS = (
    re.compile(r"(?<![\w.-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])(?!\.\d)"),
    re.compile(r"(?<![\w.-])(?P<v>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-])"),
    re.compile(r"(?<![\w.-])(?P<v>\d{8}[A-HJ-NP-TV-Z]|[XYZ]\d{7}[A-HJ-NP-TV-Z])(?![\w-])"),
    re.compile(r"(?<![\w.-])(?P<v>[12] \d{2} (?:0[1-9]|1[0-2]|[2-9]\d) \d[\dAB] \d{3} \d{3}(?: \d{2})?)(?![\w-])(?! \d)"),
    re.compile(rf"(?<![\w-]){_LABEL}\s*[:=#]?\s*(?P<v>{_ID_VALUE})(?![\w-])"),
)
IBAN = re.compile(r"(?<![\w.-])(?P<v>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))(?![\w-])")
CARD = re.compile(r"(?<![\w.-])(?P<v>[3-6]\d{3}(?P<s>[ -]?)\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|3[47]\d{2}(?P<z>[ -]?)\d{6}(?P=z)\d{5})(?![\w-])(?!\.\d)")

_TOWN = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]+(?:[ -](?:(?:de|du|la|le|les|sur|am|an|der|upon|on|in|del|los|las|el) ?-?){0,2}(?!(?:We|You|He|She|It|The|This|That|These|If|Once|When|While|Why|What|Who|How|To|In|On|At|As|A|An|And|But|For|Every|Each|Before|After|Until|Unless|Without|Unlike|Nothing|Most|Last|Two|There|Our|My|Your|Please|Here|Then|Now|See|Use|Ask|Call|Send)\b)[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]+){0,3}"
_SEP = r"(?:,[ \t]*\r?\n?[ \t]*|[ \t]*\r?\n[ \t]*)"
_UNIT = r"(?:(?:Apt|Apartment|Unit|Flat|Suite|Ste|Floor|Fl|#)\.? ?\w{1,5}" + _SEP + ")?"
_WAY = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Close|Court|Ct|Way|Place|Pl|Terrace|Square|Sq|Crescent|Cres|Gardens|Row|Mews|Walk|Grove|Parkway|Pkwy|Highway|Hwy|Circle|Trail|Hill)"
_ZIP = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2})"
ADDRESSES = (
    re.compile(rf"(?<![\w-])\d{{1,5}}[A-Za-z]? (?:[A-ZÀ-Þ][\w'’.-]+ ){{1,4}}{_WAY}\.?{_SEP}{_UNIT}{_TOWN}(?:{_SEP}|[ \t]+)(?:[A-Z]{{2}}[ \t]+)?{_ZIP}(?![\w-])"),
    re.compile(rf"(?<![\w-])(?:[A-ZÄÖÜ][\wÄÖÜäöüß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|chaussee|pfad|markt)|[A-ZÄÖÜ][\wäöüß-]+ (?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring|Damm|Ufer)|(?:Am|An der|Im|Zum|Zur|Auf dem) [A-ZÄÖÜ][\wäöüß-]+) \d{{1,4}} ?[a-z]?{_SEP}(?:[A-Z]-)?\d{{4,5}}[ \t]+{_TOWN}"),
    re.compile(rf"(?<![\w-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Qq]uai|[Aa]llée|[Rr]oute|[Cc]ours|[Ss]quare) (?:(?:de la|de|du|des|la|le|les) |[dl]['’])*[A-ZÀ-Þ][\wÀ-ÿ'’-]+(?: (?:(?:de|du|des|la|le) )?[A-ZÀ-Þ][\wÀ-ÿ'’-]+)*{_SEP}\d{{4,5}}[ \t]+{_TOWN}"),
    re.compile(rf"(?<![\w-])(?:Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|C/|Camino|Ronda|Travesía) ?(?:(?:de la|de los|de las|del|de|la|el|los|las) )?[A-ZÀ-Þ][\wÀ-ÿ'’-]+(?: (?:(?:de|del|la) )?[A-ZÀ-Þ][\wÀ-ÿ'’-]+)*,? \d{{1,4}}(?:,? ?\d{{1,2}}[ºª°]?\.? ?[A-Z]?)?{_SEP}\d{{4,5}}[ \t]+{_TOWN}"),
    re.compile(rf"(?<![\w-])(?:P\.? ?O\.? ?Box|PO Box|Post(?:al)? Box|Postfach|B\.?P\.?|Bo[iî]te postale|Apartado(?: de correos)?) \d{{1,6}}{_SEP}(?:\d{{4,5}}[ \t]+{_TOWN}|{_TOWN}(?:(?:{_SEP}|[ \t]+)(?:[A-Z]{{2}}[ \t]+)?{_ZIP}))(?![\w-])"),
)

_W = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
#: given (middle initial) family; family, given; initial family.
_PAIR = re.compile(rf"(?<![\w@.'’/+=-])({_W})(?: +[^\W\d_]\.)?(?: +({_W})|, ({_W}))(?![\w@]|['’-]\w|\(\)|://)")
#: The same where both words are capitalised.
_PROPER = re.compile(rf"(?<![\w@.'’/+=-])(?=[^\W\d_a-zß-öø-ÿ])({_W})(?: +[^\W\d_]\.)?(?: +(?=[^\W\d_])(?![a-zß-öø-ÿ])({_W})|, (?![a-zß-öø-ÿ])({_W}))(?![\w@]|['’-]\w|\(\)|://)")
_INITIAL = re.compile(rf"(?<![\w@.'’/+-])([A-Z]\.(?: ?[A-Z]\.)*) ?({_W})(?![\w@]|-\w)")
# Forms of address; they are no given names though a family may follow them.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame herr frau hr fr dipl ing mme mlle m monsieur madame senor senora señor señora sr sra don dona doña lic".split())
# a date of birth, by what stands before it
BIRTH = re.compile(r"(?i:\b(?:born(?: on)?|dob|date of birth|birth ?date|birthday|geb(?:oren)?(?: am)?|geburtsdatum|n[ée]e? le|date de naissance|nacid[oa] el|fecha de nacimiento|geboren op|geboortedatum)\.?\s*[:=]?\s*)(?P<v>\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![\w-])(?!\.\d)")


def norm(w: str) -> str:
    return w.lower().replace("’", "'")


def _proper(w: str) -> bool:
    return w[:1].isupper()


def _trim(value: str, after: str) -> str:
    """Without a single digit that numbers the list item behind the value."""
    return value[:-2] if after == ". " and re.search(r"\w \d$", value) and len(value) > 8 else value


# What a text must hold for a group of patterns to be tried at all; each pattern needs it by construction.
_MAY_AT = re.compile(r"[(\[{<]\s?at\s?[)\]}>]|\s(?:AT|at)\s")
_MAY_NUMBER = re.compile(r"\d(?:[ ./()-]{0,2}\d){3}")
# an IBAN and a labelled value may hold their digits among letters
_MAY_IBAN = re.compile(r"(?<=[A-Z]{2})\d{2}")
_MAY_LABELLED = re.compile(r"\d(?:\D*+\d){4}")
_MAY_ADDRESS = re.compile(r"\d(?:\d{3}|[A-Z]{2}\b)")


def _masked(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """All spans but names, and the text with them blanked out."""
    spans: list[tuple[int, int, str]] = []

    def take(s: int, e: int, kind: str) -> None:
        if all(e <= a or s >= b for a, b, _ in spans):
            spans.append((s, e, kind))

    if "@" in text or _MAY_AT.search(text):
        for m in EMAIL.finditer(text):
            local = m.group("local").lower()
            if local in ROLES or local.endswith(("-list", "-bot", "[bot]")) or "://" in text[max(0, m.start() - 3) : m.start()]:
                continue
            take(m.start(), m.end(), "email")
    numbers = _MAY_NUMBER.search(text)
    labelled = _MAY_LABELLED.search(text)
    if numbers:
        for m in CARD.finditer(text):
            d = re.sub(r"\D", "", m.group("v"))
            if 13 <= len(d) <= 19 and luhn(d):
                take(m.start("v"), m.end("v"), "id_number")
    if _MAY_IBAN.search(text):
        for m in IBAN.finditer(text):
            b = m.group("v").replace(" ", "")
            if 15 <= len(b) <= 34 and mod97(b):
                take(m.start("v"), m.end("v"), "id_number")
    for rx, may in zip(IDS, (*[numbers] * (len(IDS) - 1), labelled), strict=True):
        for m in rx.finditer(text) if may else ():
            v = _trim(m.group("v"), text[m.end("v") : m.end("v") + 2]).rstrip(" -")
            if sum(c.isdigit() for c in v) >= 5:
                take(m.start("v"), m.start("v") + len(v), "id_number")
    if _MAY_ADDRESS.search(text):
        for rx in ADDRESSES:
            for m in rx.finditer(text):
                take(m.start(), m.end(), "address")
    if numbers:
        for m in sorted((n, m.start(), m) for c in _PHONE_AT.finditer(text) for n, rx in enumerate(PHONES) if (m := rx.match(text, c.start()))):
            v = _trim(m[2].group(), text[m[2].end() : m[2].end() + 2])
            if 7 <= sum(c.isdigit() for c in v) <= 15:
                take(m[1], m[1] + len(v), "phone")
    spans.sort()
    return blanked(text, spans), spans


def blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the spans overwritten."""
    out, at = [], 0
    for s, e, _ in spans:
        out += [text[at:s], "\x00" * (e - s)]
        at = e
    return "".join([*out, text[at:]]) if out else text


def pairs(text: str, rx: re.Pattern) -> Iterator[tuple[int, int, str, str, bool]]:
    """Overlapping word pairs that could be a name: (start, end, given, family, reversed)."""
    at = 0
    while m := rx.search(text, at):
        a, b, c = m.group(1), m.group(2), m.group(3)
        end = m.end(2) if b else m.end(3)
        if b:
            yield m.start(1), end, a, b, False
        else:
            yield m.start(1), end, c, a, True
        at = m.end(1)


_WORDS = re.compile(_W)


def name_spans(blank: str, given: frozenset | set, families: set, learned: set, everyday: frozenset | set = frozenset()) -> list[tuple[int, int, str]]:
    """Names in a text with everything else blanked out.

    Words that are known start the search: a pair is read from each place where a
    known family could belong to it, and from each listed given name.
    """
    here = set(_WORDS.findall(norm(blank)))
    if here.isdisjoint(families) and here.isdisjoint(given):
        return []
    words = [(m.start(), norm(m.group())) for m in _WORDS.finditer(blank)]
    starts: set[int] = set()
    initials: set[int] = set()
    for i, (s, w) in enumerate(words):
        if w in families:
            starts.update(words[k][0] for k in (i - 2, i - 1, i) if k >= 0)
            initials.update(words[k][0] for k in range(max(0, i - 4), i))
        elif w in given:
            starts.add(s)
    found = []
    for at in sorted(starts):
        m = _PAIR.match(blank, at)
        if not m:
            continue
        a, b, c = m.group(1), m.group(2), m.group(3)
        g, f, rev = (a, b, False) if b else (c, a, True)
        s, e = m.start(1), m.end(2) if b else m.end(3)
        gn, fn = norm(g), norm(f)
        if gn in TITLES or fn in TITLES:
            continue
        known_g, known_f = gn in given or gn in learned, fn in families
        if known_f and (known_g or (gn not in everyday and _proper(g) and len(g) > 1 and not rev)):
            found.append((0 if known_g else 1, s, e))
        elif not rev and gn in given and gn not in everyday and fn not in everyday and _proper(g) and _proper(f) and len(f) > 2 and not (f.isupper() and not g.isupper()):
            found.append((2, s, e))
    for at in sorted(initials):
        m = _INITIAL.match(blank, at)
        if m and norm(m.group(2)) in families:
            found.append((1, m.start(), m.end()))
    used: list[tuple[int, int]] = []
    for _, s, e in sorted(set(found)):
        if all(e <= a or s >= b for a, b in used):
            used.append((s, e))
    return [(s, e, "name") for s, e in sorted(used)]


def spans(text: str | None, given: frozenset | set, families: set, learned: set, everyday: frozenset | set = frozenset()) -> list[tuple[int, int, str]]:
    """Every personal datum of the text: (start, end, type), in order, without overlap."""
    if not text:
        return []
    blank, out = _masked(text)
    return sorted(out + name_spans(blank, given, families, learned, everyday))


def births(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Dates of birth outside the spans already taken."""
    return [(m.start("v"), m.end("v"), "date") for m in BIRTH.finditer(text) if all(m.end("v") <= a or m.start("v") >= b for a, b, _ in taken)]


def placeholder(kind: str, value: str, key: bytes) -> str:
    """``<TYPE pseudonym>``."""
    if kind in ("phone", "id_number", "date"):
        return f"<{kind.upper()} {pseudonym(kind, value, key)}>"
    same = re.sub(r"[^\w@]+", "", norm(value)) if kind != "name" else " ".join(sorted(re.findall(_W, norm(value))))
    return f"<{kind.upper()} {hmac.new(key, (kind + same).encode(), hashlib.sha256).hexdigest()[:10]}>"


def redact_text(text: str, found: list[tuple[int, int, str]], key: bytes) -> str:
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], placeholder(kind, text[s:e], key)]
        at = e
    return "".join([*out, text[at:]])


# ------------------------------------------------------------------ Spark

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pii_type", T.StringType())]))
_PASS = T.StructType(
    [
        T.StructField("entry_table", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("spans", _SPANS),
        T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("given", T.StringType()), T.StructField("family", T.StringType())]))),
        T.StructField("w", T.StringType()),
        T.StructField("small", T.LongType()),
        T.StructField("capital", T.LongType()),
    ]
)
_FOUND = T.StructType(
    [
        T.StructField("entry_table", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("spans", _SPANS),
        T.StructField("redacted", T.StringType()),
    ]
)


def entries(memory: DataFrame, plans: DataFrame) -> DataFrame:
    """Both entry tables as (entry_table, path, body), repeated rows once."""
    m = memory.select(F.lit("memory_entries").alias("entry_table"), "path", "body")
    return m.unionByName(plans.select(F.lit("plan_entries").alias("entry_table"), "path", "body")).distinct()


# a capital at the beginning of a text, line, item or sentence says nothing; one behind a word and a blank does
_INSIDE = re.compile(rf" (?<![.!?…>*#\"'(-] )(?=[^\W\d_a-zß-öø-ÿ])({_W})(?![\w@]|\(\)|://)")
_EDGES = ".,;:!?…()[]{}<>\"'’«»„“”*_`~-"


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per entry its spans but names and the capitalised pairs; per batch how often each word is written small and with a capital inside a sentence."""
    names = [f.name for f in _PASS]
    for pdf in batches:
        out: list[tuple] = []
        tokens, small, capital = Counter(), Counter(), Counter()
        for t, p, body in zip(pdf.entry_table, pdf.path, pdf.body, strict=True):
            blank, got = _masked(body)
            pairs_here = {(norm(g), norm(f)) for _, _, g, f, _ in pairs(blank, _PROPER) if _proper(g) and _proper(f) and len(f) > 2 and len(g) > 1}
            out.append((t, p, body, [{"start": s, "end": e, "pii_type": k} for s, e, k in got], [{"given": g, "family": f} for g, f in sorted(pairs_here) if g not in TITLES and f not in TITLES], None, None, None))
            tokens.update(blank.split())
            capital.update(map(norm, _INSIDE.findall(blank)))
        for w, n in tokens.items():
            w = w.strip(_EDGES)
            if w.islower() and _WORDS.fullmatch(w):
                small[w.replace("’", "'")] += n
        out += [(None, None, None, None, None, w, small[w], capital[w]) for w in small.keys() | capital.keys()]
        yield pd.DataFrame(out, columns=names)


def learn(read: DataFrame, given_names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(families, given names, everyday words) that the corpus itself supports, as one-column tables ``w``."""
    listed = given_names.where(F.col("given").isNotNull()).select(F.lower("given").alias("given")).distinct()
    p = read.select(F.explode("pairs").alias("p")).select("p.given", "p.family").distinct()
    fam = p.join(listed, "given").groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).select(F.col("family").alias("w"))
    cased = read.where(F.col("w").isNotNull()).groupBy("w").agg(F.sum("small").alias("small"), F.sum("capital").alias("capital"))
    common = cased.where(F.col("small") > F.col("capital")).select("w")
    fam = fam.join(common, "w", "left_anti")
    by = p.join(fam.withColumnRenamed("w", "family"), "family").groupBy("given").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("given", "w")
    giv = by.where(F.col("n") >= SUPPORT).select("w").join(common, "w", "left_anti")
    # everyday words matter where a pair could be a name: before a known family, or beside a listed given name
    beside = p.join(listed, "given").select(F.explode(F.array("given", "family")).alias("w"))
    day = common.join(by.select("w").unionByName(beside).distinct(), "w", "left_semi")
    return fam, giv, day


def _words(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(body), "’", "'"), F.lit(r"\p{L}(?:\p{L}|['-](?=\p{L}))*"), F.lit(0)))


def scan(memory: DataFrame, plans: DataFrame, given_names: DataFrame, key: bytes, dates: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per distinct entry: ``entry_table, path, body, spans, redacted``.

    The learned names go to the tasks whole up to ``most_sent`` of them; beyond,
    each entry is joined with the names among its words.  Both ways give the same.
    """
    spark = memory.sparkSession
    importable(spark)
    rows = entries(memory, plans)
    listed = [r.given for r in given_names.where(F.col("given").isNotNull()).select(F.lower("given").alias("given")).distinct().limit(MOST_GIVEN + 1).collect()]
    if len(listed) > MOST_GIVEN:
        raise ValueError("the reference list of given names is too long to be one")
    given = frozenset(listed)
    read = materialise(spread(rows.where(F.col("body").isNotNull() & (F.col("body") != ""))).mapInPandas(_first_pass, _PASS), "masked")
    fam, giv, day = learn(read, given_names)
    known = materialise(fam.withColumn("kind", F.lit("f")).unionByName(giv.withColumn("kind", F.lit("g"))).unionByName(day.withColumn("kind", F.lit("d"))), "names")
    doc = read.where(F.col("body").isNotNull()).select("entry_table", "path", "body", "spans")
    sent = None
    if known.count() <= most_sent:
        sent = spark.sparkContext.broadcast({k: frozenset(r.w for r in rs) for k, rs in ((k, known.where(F.col("kind") == k).select("w").collect()) for k in "fgd")})
        none = F.array().cast("array<string>")
        full = doc.withColumn("families", none).withColumn("learned", none).withColumn("everyday", none)
    else:
        doc = doc.withColumn("_k", F.xxhash64("entry_table", "path", "body"))
        of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("w")))
        here = doc.select("_k", F.explode(_words(F.col("body"))).alias("w")).join(known, "w").groupBy("_k").agg(of("f").alias("families"), of("g").alias("learned"), of("d").alias("everyday"))
        full = doc.join(here, "_k", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, p, b, sp, f, g, d in zip(pdf.entry_table, pdf.path, pdf.body, pdf.spans, pdf.families, pdf.learned, pdf.everyday, strict=True):
                f, g, d = (sent.value["f"], sent.value["g"], sent.value["d"]) if sent is not None else (set() if x is None else set(x) for x in (f, g, d))
                masked = [(x["start"], x["end"], x["pii_type"]) for x in sp]
                got = sorted(masked + name_spans(blanked(b, masked), given, f, g, d))
                cut = sorted(got + births(b, got)) if dates else got
                out.append((t, p, b, [{"start": s, "end": e, "pii_type": k} for s, e, k in cut], redact_text(b, cut, key)))
            yield pd.DataFrame(out, columns=["entry_table", "path", "body", "spans", "redacted"])

    full = spread(full.select("entry_table", "path", "body", "spans", "families", "learned", "everyday")).mapInPandas(run, _FOUND)
    empty = rows.where(F.col("body").isNull() | (F.col("body") == "")).select("entry_table", "path", "body", F.array().cast(_SPANS).alias("spans"), F.col("body").alias("redacted"))
    return full.unionByName(empty)


def found(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("path").isNotNull()).select("entry_table", "path", F.explode("spans").alias("s")).select("entry_table", "path", F.col("s.pii_type").alias("pii_type")).distinct()
