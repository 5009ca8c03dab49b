"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Found and permuted within their own format, so that the result is valid in it and equal values stay equal in all
documents: card numbers (13 to 19 digits that pass the Luhn test), IBANs (mod 97), phone numbers (international ones,
and ten digits in the ways they are written in North America), US social security numbers, IPv4 and IPv6 addresses,
calendar dates (year, day or month first, or with the month's name in English, German, Spanish or French), and the local
part of e-mail addresses in any alphabet. Separators, country codes and domains stay, and dates stay in their century.
With the key every pseudonym can be turned back (restore=True); of IPv6 addresses in mixed case the case is lost.

Among digits that stand side by side every start is tried, and at each the ends that the formats allow, so that a list's
number or a year beside a value neither hides it nor becomes a part of it. A date that may be read both ways is day
first; month-first dates go to month-first dates. The date of one day has one pseudonym in all ways of writing unless the way
allows not all days (month first, or a month's name that several languages share).

The permutation of 0 .. n-1 is a balanced Feistel network over the next even number of bits, walked until the value is
in the format (and the text around it) of the one that it replaces. The whole key counts, and it must not be empty.

Numbers that fail their test, and all other text, stay as they are. Null texts have nothing. Repeated rows and rows without
an id are answered each. Very long texts are read whole. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: For tests and examples; give your own.
KEY = "an example key"

_EMAIL = re.compile(r"[\w.+%-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
}
_NAMES = "|".join(sorted({m for ms in _MONTHS.values() for m in ms}, key=lambda m: (-len(m), m)))
_WORDED = re.compile(rf"(?<![\w.,/-])(?P<d1>\d\d?)(?P<s1>(?:\.|st|nd|rd|th|er)? (?:de )?)(?P<m1>{_NAMES})(?P<t1>,? (?:de )?)(?P<y1>\d{{4}})(?!\w)|(?<!\w)(?P<m2>{_NAMES})(?P<s2> )(?P<d2>\d\d?)(?P<t2>(?:st|nd|rd|th)?,? )(?P<y2>\d{{4}})(?!\w)", re.I)
#: Digits with at most two signs between them, as far as they go.
_RUN = re.compile(r"(?<!\w)[+(]?\d(?:[ ()./:-]{0,2}[+(]?\d)*")
_END = r"(?!\w|[-/.]\d)"
_FORMS = [
    ("ip", re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d)")),
    ("iso", re.compile(rf"\d{{4}}([-/.])\d\d\1\d\d(?:(?=T\d\d:)|{_END})")),
    ("dmy", re.compile(rf"\d\d([-/.])\d\d\1\d{{4}}{_END}")),
    ("mdy", re.compile(rf"\d\d([-/.])\d\d\1\d{{4}}{_END}")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}(?![\w-])")),
]
_GROUPS = [re.compile(r"\d+(?: \d+)*"), re.compile(r"\d+(?:-\d+)+")]
_NORTH = re.compile(r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|[-/.:]\d)|(?:\+1[ .-]?)?[2-9]\d{9}(?!\w|[-/.]\d)")
_ABROAD = [re.compile(rf"\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:[ .-]?\d{{2,4}}){{{k}}}(?!\w|[-/.:]\d)") for k in (4, 3, 2)]
_DIGITS = re.compile(r"\d")


@lru_cache(64)
def _secret(key: str) -> bytes:
    if not key:
        raise ValueError("the key must not be empty")
    return hashlib.sha512(key.encode()).digest()


def _f(key: bytes, tweak: str, round_: int, half: int, value: int) -> int:
    digest = hashlib.blake2b(f"{tweak}|{round_}|{value}".encode(), key=key, digest_size=64).digest()
    out = int.from_bytes(digest, "big")
    while half > 512:
        digest = hashlib.blake2b(digest, key=key, digest_size=64).digest()
        out, half = (out << 512) | int.from_bytes(digest, "big"), half - 512
    return out


def permute(value: int, n: int, key: str, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. n-1, or its inverse."""
    secret = _secret(key)
    if n < 2:
        return value
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            if back:
                left, right = right ^ (_f(secret, tweak, ROUNDS - 1 - r, half, left) & mask), left
            else:
                left, right = right, left ^ (_f(secret, tweak, r, half, right) & mask)
        value = (left << half) | right
        if value < n:
            return value


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _into(text: str, digits: str) -> str:
    """digits in place of the digits of text."""
    it = iter(digits)
    return _DIGITS.sub(lambda _: next(it), text)


@lru_cache(100_000)
def _alphabet(c: str) -> str:
    """The characters that c may become: its kind's, or for letters beyond ASCII those of its case on its page of 128."""
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else c
    if not c.isalpha():
        return c
    page = ord(c) & ~127
    return "".join(x for x in map(chr, range(page, page + 128)) if x.isalpha() and (x.islower(), x.isupper()) == (c.islower(), c.isupper()))


def _chars(text: str, key: str, tweak: str, back: bool) -> str:
    """Permutes each character within its alphabet, all at once."""
    alphabets = [_alphabet(c) for c in text]
    value, n = 0, 1
    for c, a in zip(text, alphabets):
        value, n = value * len(a) + a.index(c), n * len(a)
    shape = "".join(a[0] for a in alphabets)
    value, out = permute(value, n, key, f"{tweak}{shape}", back), []
    for a in reversed(alphabets):
        value, k = divmod(value, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _day(day: datetime.date, key: str, back: bool) -> datetime.date:
    """The pseudonym of a day, within its century."""
    century = day.year // 100
    first = datetime.date(max(1, 100 * century), 1, 1).toordinal()
    last = datetime.date(100 * century + 99, 12, 31).toordinal()
    return datetime.date.fromordinal(first + permute(day.toordinal() - first, last - first + 1, key, f"date{century}", back))


def _date(y: str, m: str, d: str) -> datetime.date | None:
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def valid(kind: str, text: str) -> bool:
    """Whether a text that has the form of a kind is one."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    if kind == "iban":
        plain = text.replace(" ", "")
        return 15 <= len(plain) <= 34 and mod97(plain) == 1
    if kind == "ip":
        return max(int(o) for o in text.split(".")) <= 255
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
        return len(re.sub("[^0-9A-Fa-f]", "", text)) > 2
    if kind == "iso":
        return _date(text[:4], text[5:7], text[8:]) is not None
    if kind == "dmy":
        return _date(text[6:], text[3:5], text[:2]) is not None
    if kind == "mdy":  # what may be read day first is
        return int(text[3:5]) > 12 and _date(text[6:], text[:2], text[3:5]) is not None
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return True


def _once(kind: str, text: str, key: str, back: bool) -> str:
    """One step of the permutation of a kind's texts of this form; it may leave the kind."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, f"card{len(digits)}", back)).zfill(len(digits) - 1)
        return _into(text, next(body + d for d in "0123456789" if luhn(body + d)))
    if kind == "iban":
        plain = text.replace(" ", "")
        body = plain[:2] + "00" + _chars(plain[4:], key, "iban" + plain[:2], back)
        new = iter(body[:2] + f"{98 - mod97(body):02d}" + body[4:])
        return "".join(" " if c == " " else next(new) for c in text)
    if kind == "ip":
        value = permute(int.from_bytes(bytes(int(o) for o in text.split(".")), "big"), 2**32, key, "ip", back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "ip6":
        hexes = re.sub(":", "", text)
        new = f"{permute(int(hexes, 16), 16 ** len(hexes), key, 'ip6' + re.sub('[^:]', 'h', text), back):0{len(hexes)}x}"
        it = iter(new.upper() if hexes.upper() == hexes and re.search("[A-F]", hexes) else new)
        return "".join(c if c == ":" else next(it) for c in text)
    if kind in ("iso", "dmy", "mdy"):
        y, m, d = {"iso": (text[:4], text[5:7], text[8:]), "dmy": (text[6:], text[3:5], text[:2]), "mdy": (text[6:], text[:2], text[3:5])}[kind]
        new = _day(_date(y, m, d), key, back)
        y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        sign = text[4] if kind == "iso" else text[2]
        return sign.join({"iso": (y, m, d), "dmy": (d, m, y), "mdy": (m, d, y)}[kind])
    if kind == "ssn":
        return _into(text, str(permute(int(digits), 10**9, key, "ssn", back)).zfill(9))
    if kind == "email":
        local, _, domain = text.rpartition("@")
        return _chars(local, key, "email", back) + "@" + domain
    keep = len(_DIGITS.findall(re.match(r"\+1(?=\d{10}$)|\+\d{1,3}(?=[ .(-])|", text)[0]))
    rest = digits[keep:]
    return _into(text, digits[:keep] + str(permute(int(rest), 10 ** len(rest), key, f"phone{len(rest)}", back)).zfill(len(rest)))


@lru_cache(100_000)
def pseudonym(kind: str, text: str, key: str, back: bool = False) -> str:
    """The pseudonym of a valid value of a kind: what the permutation comes to next that is valid, too."""
    upper = kind == "ip6" and re.search("[A-F]", text) and not re.search("[a-f]", text)
    while True:
        text = _once(kind, text, key, back)
        if valid(kind, text) and (not upper or re.search("[A-F]", text)):
            return text


@lru_cache(100_000)
def worded(m: tuple, key: str, back: bool) -> tuple | None:
    """(day, month's name, year) of a date with the month's name, permuted among dates with names of the same languages; None if it is none."""
    d, name, y = m
    of = lambda n: frozenset((lang, ms.index(n)) for lang, ms in _MONTHS.items() if n in ms)
    known = of(name.lower())
    lang, month = sorted(known)[0]
    day = _date(y, str(month + 1), d)
    if day is None:
        return None
    langs = {x for x, _ in known}
    while True:
        day = _day(day, key, back)
        new = _MONTHS[lang][day.month - 1]
        if {x for x, _ in of(new)} == langs and (d[0] != "0" or day.day < 10):
            break
    new = new.upper() if name.isupper() else new.capitalize() if name[0].isupper() else new
    return (f"0{day.day}" if d[0] == "0" else str(day.day)), new, f"{day.year:04d}"


def _at(text: str, i: int, upto: int) -> tuple[str, int] | None:
    """(kind, end) of the value that begins at a place and ends before upto, if there is one."""
    for kind, form in _FORMS:
        if (m := form.match(text, i)) and m.end() <= upto and valid(kind, m[0]):
            return kind, m.end()
    by: dict[int, int] = {}
    for groups in _GROUPS:
        if m := groups.match(text, i):
            sizes = []
            for g in re.finditer(r"\d+", text[i : min(m.end(), upto)]):
                e = i + g.end()
                sizes.append(len(g[0]))
                # one group, groups of four with a rest, or as some cards have them
                if (len(sizes) == 1 or {*sizes[:-1]} == {4} and sizes[-1] <= 4 or sizes in ([4, 6, 5], [4, 6, 4])) and not re.match(r"\w", text[e : e + 1]):
                    by.setdefault(sum(sizes), e)
    for n in (16, 15, 19, 14, 13, 18, 17):
        if n in by and valid("card", text[i : by[n]]):
            return "card", by[n]
    if (m := _NORTH.match(text, i)) and m.end() <= upto:
        return "phone", m.end()
    if text[i] == "+" and not text.startswith("+1 ", i):
        for form in _ABROAD:
            m = form.match(text, i)
            if m and m.end() <= upto and valid("phone", m[0]) and not any(_at(text, j, upto) for j in (i + x.end() for x in re.finditer(" ", m[0])) if text[j : j + 1].isdigit()):
                return "phone", m.end()
    return None


def _values(text: str, begin: int, end: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the values in a run of digits."""
    out, i = [], begin
    while i < end:
        if (text[i].isdigit() or text[i] in "+(") and (i == 0 or not re.match(r"[\w.+/:#-]", text[i - 1])) and (found := _at(text, i, end)):
            out.append((found[0], i, found[1]))
            i = found[1]
        else:
            i += 1
    return out


def _run(text: str, key: str, back: bool) -> tuple[str, int]:
    """A run of digits with its values replaced, so that the same places hold values of the same kinds."""
    found = _values(text, 0, len(text))
    if any(kind == "ip" for kind, *_ in found):  # its length may change
        return _ip_run(text, found, key, back)
    for kind, a, b in reversed(found) if back else found:
        new = text[a:b]
        while True:
            new = pseudonym(kind, new, key, back)
            if _values(text[:a] + new + text[b:], 0, len(text)) == found:
                break
        text = text[:a] + new + text[b:]
    return text, len(found)


def _ip_run(text: str, found: list, key: str, back: bool) -> tuple[str, int]:
    """As _run(), for runs with an address in dotted numbers: each value is replaced by itself."""
    out, last = [], 0
    for kind, a, b in found:
        out += [text[last:a], pseudonym(kind, text[a:b], key, back)]
        last = b
    return "".join([*out, text[last:]]), len(found)


def replace(text: str, key: str = KEY, back: bool = False) -> tuple[str, int]:
    """(text with pseudonyms, how many)."""
    _secret(key)
    spans: list[tuple[int, int, str, int]] = []

    def free(m: re.Match) -> bool:
        return not any(a < m.end() and m.start() < b for a, b, _, _ in spans)

    if "@" in text:
        spans += [(m.start(), m.end(), pseudonym("email", m[0], key, back), 1) for m in _EMAIL.finditer(text)]
    if _DIGITS.search(text):
        for m in _IBAN.finditer(text):
            end = m.end()
            while end - m.start() >= 15 and not valid("iban", text[m.start() : end]):
                end = text.rfind(" ", m.start(), end)
            if end - m.start() >= 15 and free(m):
                spans.append((m.start(), end, pseudonym("iban", text[m.start() : end], key, back), 1))
        if text.count(":") > 1:
            spans += [(m.start(), m.end(), pseudonym("ip6", m[0], key, back), 1) for m in _IPV6.finditer(text) if valid("ip6", m[0]) and free(m)]
        for m in _WORDED.finditer(text):
            k = "1" if m["d1"] else "2"
            if free(m) and (new := worded((m["d" + k], m["m" + k], m["y" + k]), key, back)):
                d, name, y = new
                spans.append((m.start(), m.end(), f"{d}{m['s1']}{name}{m['t1']}{y}" if k == "1" else f"{name}{m['s2']}{d}{m['t2']}{y}", 1))
        for m in _RUN.finditer(text):
            if len(m[0]) > 6:
                # other values cut a run
                cuts = sorted((a, b) for a, b, _, _ in spans if a < m.end() and m.start() < b)
                for a, b in zip([m.start(), *(b for _, b in cuts)], [*(a for a, _ in cuts), m.end()]):
                    if b - a > 6:
                        after = text[b : b + 4]
                        new, n = _bounded(text[a:b], text[max(0, a - 1) : a], after, key, back)
                        if n:
                            spans.append((a, b, new, n))
    out, last = [], 0
    for a, b, new, _ in sorted(spans):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), sum(n for *_, n in spans)


def _bounded(run: str, before: str, after: str, key: str, back: bool) -> tuple[str, int]:
    """_run() with the characters around, which decide whether a value may begin or end there."""
    if not (re.match(r"\w", after) or re.match(r"\w", before)):
        return _run(run, key, back)
    whole = before + run + after
    found = [x for x in _values(whole, 0, len(before) + len(run)) if x[1] >= len(before)]
    out, last = [], len(before)
    for kind, a, b in found:
        out += [whole[last:a], pseudonym(kind, whole[a:b], key, back)]
        last = b
    return "".join([*out, whole[last : len(before) + len(run)]]), len(found)


def _replaced(key: str, back: bool) -> Callable:
    _secret(key)

    def run(batches):
        for batch in batches:
            ids, texts, counts = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                new, n = replace(text, key, back)
                if n:
                    ids.append(i)
                    texts.append(new)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "replaced"])

    return run


def pseudonymize(docs: DataFrame, key: str = KEY, restore: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, replaced): the new text of each document that holds personal data; the other documents aren't listed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]|:[0-9A-Fa-f]*:"))
    return rows.mapInArrow(_replaced(key, restore), "doc_id long, text string, replaced int")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data, pseudonymized."""
    return pseudonymize(table(spark, sf_dir, "documents"))
