"""Text of web pages by wrapper inference: union-free regular expressions over the pages of a host.

A page becomes a stream of tags and texts (scripts, styles and comments are single tags or nothing; a text's symbol names
the tag before it). Repeats within the page are folded, whatever their length: a run of equal neighbouring parts becomes a
group that repeats. The streams of a host are aligned one after the other into its wrapper by a longest common
subsequence: what one of the two has and the other lacks becomes an optional group, a part that the other repeats becomes
a repeated group, and texts that align are one text place. The result is a regular expression without unions that every
page of the host matches.

Every page is then matched with its host's wrapper, which gives each of its texts a place. A place, in optional and
repeated groups too, at which two pages or more have a text and all the host's texts are the same is template; every other
place is a slot, whose texts are extracted. So is a text that the match gives no place (where equal parts lie side by side).

Pages of a host that fold to the same stream (its form) are aligned once, whatever their number. Forms are aligned in
portions of FORMS_PORTION, and the portions' wrappers WRAPPERS_MERGED at a time, until a host has one. Hosts are the
URL's, in lower case.

Null and empty HTML give no slots. Pages whose URL is null or has no host are a host of their own, the empty one. Repeated
pages and rows without an id are each answered, and count as pages. Ties (alignments of equal length) are broken the same
way every time. A host with one page has nothing to compare with: all its texts are slots. Very long pages are read whole.
Other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest, xxh64_intdigest

from .common import cut, small, table, tidy_batches, tidy_group
from .urls import host

#: Forms that one task aligns, wrappers that one task merges, and forms up to which what was learned is broadcast.
FORMS_PORTION, WRAPPERS_MERGED, BROADCAST_FORMS = 256, 32, 200_000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^<>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"<\s*(/?[a-zA-Z!][\w:-]*)")
TEXT = "#"
_MOD, _BASE = (1 << 61) - 1, 1_000_003
#: A repeat of n tokens is looked for by the grams of the largest of these lengths up to n.
_GRAMS = (8, 64, 512, 4096, 32768)


def tokens(page: str | None) -> list[tuple[str, str | None]]:
    """(symbol, text) of a page: a tag's name, or # and the tag before the text; blank texts are left out."""
    out: list[tuple[str, str | None]] = []
    tag = ""
    for m in _TOKEN.finditer(page or ""):
        t = m[0]
        if t[0] == "<" and len(t) > 1:
            if t.startswith("<!--"):
                continue
            name = _NAME.match(t)
            if name:
                tag = "<" + name[1].lower() + ">"
                out.append((tag, None))
        elif (text := " ".join(entities.unescape(t).split())):
            if out and out[-1][1] is not None:
                out[-1] = out[-1][0], out[-1][1] + " " + text
            else:
                out.append((TEXT + tag, text))
    return out


class Folder:
    """A stream with neighbouring repeats folded into groups, built symbol by symbol.

    items: (key, content, leaves): content is None or a group's items; leaves has, for each text of the item, the places in the stream that it stands for.
    """

    def __init__(self) -> None:
        self.items: list[tuple[str, list | None, list[list[int]]]] = []
        self.sums = [0]
        self.powers = [1]
        self.code: dict[str, int] = {}
        self.keys: list[tuple] = []  # the grams that end at each item
        self.at: dict[tuple, list[int]] = {}
        self.due: dict[int, list[int]] = {}  # groups by the size at which they may come once more
        self.groups: dict[int, tuple[int, int]] = {}

    def _span(self, a: int, b: int) -> int:
        return (self.sums[b] - self.sums[a] * self.powers[b - a]) % _MOD

    def _push(self, item: tuple) -> None:
        code = self.code.setdefault(item[0], len(self.code) + 1)
        self.items.append(item)
        size = len(self.items)
        self.sums.append((self.sums[-1] * _BASE + code) % _MOD)
        if size >= len(self.powers):
            self.powers.append(self.powers[-1] * _BASE % _MOD)
        keys = []
        for n in _GRAMS:
            if size < n:
                break
            key = n, self._span(size - n, size)
            keys.append(key)
            self.at.setdefault(key, []).append(size)
        self.keys.append(tuple(keys))

    def _pop(self, n: int) -> list:
        """Takes the last n items off."""
        for _ in range(n):
            for key in self.keys.pop():
                self.at[key].pop()
            size = len(self.keys) + 1
            if size - 1 in self.groups:
                length, _ = self.groups.pop(size - 1)
                self.due[size + length].remove(size - 1)
        out = self.items[len(self.items) - n :]
        del self.items[len(self.items) - n :], self.sums[len(self.sums) - n :]
        return out

    def _period(self) -> int:
        """The least n for which the last n items are the same as the n before."""
        size, items = len(self.items), self.items
        last = items[-1][0]
        for n in range(1, min(8, size // 2 + 1)):
            if items[-n - 1][0] == last and self._span(size - 2 * n, size - n) == self._span(size - n, size):
                return n
        for key in self.keys[-1]:
            g = key[0]
            ends = self.at[key]
            for k in range(len(ends) - 2, -1, -1):
                n = size - ends[k]
                if n >= 8 * g or 2 * n > size:
                    break
                if n >= g and self._span(size - 2 * n, size - n) == self._span(size - n, size):
                    return n
        return 0

    def add(self, item: tuple) -> None:
        self._push(item)
        while True:
            size = len(self.items)
            again = next((g for g in self.due.get(size, ()) if self._span(g + 1, size) == self.groups[g][1]), None)
            if again is not None:
                part = self._pop(size - again - 1)
                for have, more in zip(self.items[again][2], [x for i in part for x in i[2]]):
                    have += more
                return
            n = self._period()
            if not n:
                return
            print_ = self._span(size - n, size)
            second, first = self._pop(n), self._pop(n)
            leaves = [a + b for a, b in zip([x for i in first for x in i[2]], [x for i in second for x in i[2]])]
            self._push(("+(" + " ".join(i[0] for i in first) + ")", first, leaves))
            at = len(self.items) - 1
            self.groups[at] = n, print_
            self.due.setdefault(at + 1 + n, []).append(at)


def fold(stream: Sequence[str]) -> list[tuple]:
    folder = Folder()
    for k, symbol in enumerate(stream):
        folder.add((symbol, None, [[k]] if symbol[0] == TEXT else []))
    return folder.items


def form(items: list) -> list:
    """The folded stream without places: symbols and ["+", part] groups."""
    return [["+", form(i[1])] if i[1] is not None else i[0] for i in items]


# A wrapper is a list of [item, option]: the item a symbol or ["+", part], the option 0 for what all pages have, else the number of its optional group.


def key_of(item) -> str:
    return item if isinstance(item, str) else "+(" + " ".join(map(key_of, item[1])) + ")"


def texts_of(item) -> int:
    return (item[0] == TEXT) if isinstance(item, str) else sum(map(texts_of, item[1]))


def regroup(items: list, other: list) -> list:
    """items with each part that a group of items or other repeats made such a group too."""
    for part in sorted({key_of(x): x for x, _ in [*items, *other] if not isinstance(x, str)}.values(), key=lambda x: (-len(x[1]), key_of(x))):
        want = [key_of(x) for x in part[1]]
        keys, out, i, n = [key_of(x) for x, _ in items], [], 0, len(part[1])
        own = key_of(part)
        while i < len(items):
            if keys[i] == want[0] and keys[i : i + n] == want and len({o for _, o in items[i : i + n]}) == 1:
                if not (out and out[-1][1] == items[i][1] and key_of(out[-1][0]) == own):
                    out.append([part, items[i][1]])
                i += n
            elif keys[i] == own and out and out[-1][1] == items[i][1] and key_of(out[-1][0]) == own:
                i += 1  # the group again, as a part beside it became one
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit vectors; of several always the same one."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    out = [(i, i) for i in range(low)]
    x, y = a[low : len(a) - end], b[low : len(b) - end]
    if x and y:
        masks: dict[str, int] = {}
        for j, s in enumerate(y):
            masks[s] = masks.get(s, 0) | (1 << j)
        full = (1 << len(y)) - 1
        v, rows = full, [full]
        for s in x:
            u = v & masks.get(s, 0)
            v = ((v + u) | (v - u)) & full
            rows.append(v)
        i, j, found = len(x), len(y), []
        while i and j:  # a 0 at bit j - 1 of row i: the length grows there
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i + low, j + low))
        out += reversed(found)
    return out + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def align(one: list, two: list) -> list:
    """A wrapper that covers what the wrappers one and two cover."""
    one, two = regroup(one, two), regroup(two, one)
    met = common([key_of(x) for x, _ in one], [key_of(x) for x, _ in two])
    marked: list[tuple] = []  # (item, what its optional group was in either wrapper and whether it was met), 0 for required
    i = j = 0
    for p, q in [*met, (len(one), len(two))]:
        marked += [(x, ("a", o, i)) for x, o in one[i:p]]
        marked += [(x, ("b", o, j)) for x, o in two[j:q]]
        if p < len(one):
            o, r = one[p][1], two[q][1]
            marked.append((one[p][0], ("m", o, r) if o or r else 0))
        i, j = p + 1, q + 1
    out, number, before = [], 0, None
    for x, mark in marked:
        if mark != 0 and mark != before:
            number += 1
        out.append([x, number if mark != 0 else 0])
        before = mark
    return out


def pattern(wrapper: list) -> str:
    """The wrapper as a regular expression over symbols, each ended by a blank."""
    one = lambda x: re.escape(x) + " " if isinstance(x, str) else "(?:" + "".join(map(one, x[1])) + ")+"
    out, k = [], 0
    while k < len(wrapper):
        option, to = wrapper[k][1], k + 1
        while option and to < len(wrapper) and wrapper[to][1] == option:
            to += 1
        body = "".join(one(x) for x, _ in wrapper[k:to])
        out.append(f"(?:{body})?" if option else body)
        k = to
    return "".join(out)


def places(wrapper: list, stream: list) -> list[int]:
    """The wrapper's text place of each text of a form, -1 for a text that it has none for."""
    whole = regroup([[x, 0] for x, _ in wrapper], [])
    grouped = regroup([[x, 0] for x in stream], whole)
    first, n = [], 0
    for x, _ in whole:
        first.append(n)
        n += texts_of(x)
    to = {q: p for p, q in common([key_of(x) for x, _ in whole], [key_of(x) for x, _ in grouped])}
    out: list[int] = []
    at = 0  # the item of the form
    for q, (x, _) in enumerate(grouped):
        own, texts = key_of(x), 0
        want = None if isinstance(x, str) else [key_of(y) for y in x[1]]
        while at < len(stream):  # what x stands for: itself, or the group and its part side by side
            if key_of(stream[at]) == own and (want or not texts):
                texts, at = texts + texts_of(stream[at]), at + 1
            elif want and [key_of(y) for y in stream[at : at + len(want)]] == want:
                texts, at = texts + texts_of(x), at + len(want)
            else:
                break
            if not want:
                break
        each = texts_of(x)
        out += [first[to[q]] + k % each if q in to else -1 for k in range(texts)]
    return out


def _forms(batches):
    """For each host and form of this part: pages, and what all of them say at each text (null where they differ)."""
    seen: dict = {}
    for batch in batches:
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            stream = tokens(page)
            folded = fold([s for s, _ in stream])
            key = name, json.dumps(form(folded))
            says = []
            for leaf in (x for i in folded for x in i[2]):
                said = {stream[k][1] for k in leaf}
                says.append(xxh64_intdigest(said.pop()) >> 1 if len(said) == 1 else None)
            if key in seen:
                have = seen[key]
                have[0] += 1
                have[1] = [a if a == b else None for a, b in zip(have[1], says)]
            else:
                seen[key] = [1, says]
    for k in range(0, len(rows := [(h, f, xxh64_hexdigest(f), n, says) for (h, f), (n, says) in seen.items()]), 5000):
        columns = list(zip(*rows[k : k + 5000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())))], ["host", "form", "name", "pages", "says"])


def _merged(wrappers_: Iterator[list]) -> list:
    out = next(wrappers_)
    for w in wrappers_:
        out = align(out, w)
    return out


def _infer(group: pa.Table) -> pa.Table:
    """The wrapper of a portion of a host's forms, the most frequent first."""
    order = sorted(zip((-n for n in group["pages"].to_pylist()), group["form"].to_pylist()))
    wrapper = _merged([[x, 0] for x in json.loads(f)] for _, f in order)
    return pa.table({"host": group["host"][:1], "portion": group["portion"][:1], "wrapper": [json.dumps(wrapper)]})


def _merge(group: pa.Table) -> pa.Table:
    group = group.sort_by([("part", "ascending")])
    wrapper = _merged(json.loads(w) for w in group["wrapper"].to_pylist())
    return pa.table({"host": group["host"][:1], "portion": group["portion"][:1], "wrapper": [json.dumps(wrapper)]})


def _place(batches):
    """The place of each text of the forms in their host's wrapper."""
    for batch in batches:
        known: dict[str, list] = {}
        found = []
        for w, f in zip(batch.column("wrapper").to_pylist(), batch.column("form").to_pylist()):
            if w not in known:
                known = {w: json.loads(w)}
            found.append(places(known[w], json.loads(f)))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("name"), batch.column("pages"), batch.column("says"), pa.array(found, pa.list_(pa.int32()))], ["host", "name", "pages", "says", "places"])


def infer(forms: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, form, pages): the wrapper as JSON, a list of [item, number of the optional group or 0]."""
    one = forms.groupBy("host", "form").agg(F.sum("pages").alias("pages"))
    count = one.groupBy("host").agg(F.ceil(F.count("*") / FORMS_PORTION).cast("int").alias("portions"))
    placed = one.join(count, "host").select("host", "form", "pages", F.pmod(F.xxhash64("form"), F.col("portions")).cast("int").alias("portion"))
    now = cut(placed.groupBy("host", "portion").applyInArrow(tidy_group(_infer), "host string, portion int, wrapper string"))
    while (now.agg(F.max("portion")).head()[0] or 0) > 0:
        parts = now.select("host", F.col("portion").alias("part"), F.floor(F.col("portion") / WRAPPERS_MERGED).cast("int").alias("portion"), "wrapper")
        now = cut(parts.groupBy("host", "portion").applyInArrow(tidy_group(_merge), "host string, portion int, wrapper string"))
    return now.select("host", "wrapper")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """((host, wrapper), (host, name, fixed)): each host's wrapper, and for each form of its pages which of its texts are template."""
    rows = pages.select(F.coalesce(host(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))
    forms = cut(rows.mapInArrow(tidy_batches(_forms), "host string, form string, name string, pages long, says array<long>"))
    learned = infer(forms)
    placed = cut(forms.join(learned, "host").sortWithinPartitions("host").mapInArrow(tidy_batches(_place), "host string, name string, pages long, says array<long>, places array<int>"))
    said = placed.select("host", "pages", F.explode(F.arrays_zip("places", "says")).alias("x")).where("x.places >= 0")
    by = said.groupBy("host", F.col("x.places").alias("place")).agg(F.sum("pages").alias("pages"), F.min("x.says").alias("low"), F.max("x.says").alias("high"), F.count_if(F.col("x.says").isNull()).alias("differ"))
    template = by.where("pages > 1 AND differ = 0 AND low = high").groupBy("host").agg(F.collect_set("place").alias("template"))
    one = placed.select("host", "name", "places").dropDuplicates(["host", "name"])
    return learned, one.join(template, "host").select("host", "name", F.transform("places", lambda p: F.array_contains("template", p)).alias("fixed"))


def _shape(batches):
    for batch in batches:
        names, every, leaf = [], [], []
        for page in batch.column("html").to_pylist():
            stream = tokens(page)
            folded = fold([s for s, _ in stream])
            number, n = {}, 0
            for s, (symbol, _) in enumerate(stream):
                if symbol[0] == TEXT:
                    number[s] = len(number)
            of = [0] * len(number)
            for i in folded:
                for x in i[2]:
                    for s in x:
                        of[number[s]] = n
                    n += 1
            names.append(xxh64_hexdigest(json.dumps(form(folded))))
            every.append([x for _, x in stream if x is not None])
            leaf.append(of)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(names, pa.string()), pa.array(every, pa.list_(pa.string())), pa.array(leaf, pa.list_(pa.int32()))], ["page_id", "host", "name", "texts", "leaf"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, slots): the texts of each page that aren't its host's template, in order."""
    _, learned = wrappers(pages, url_col, html_col)
    learned = small(cut(learned.where(F.exists("fixed", lambda x: x))), BROADCAST_FORMS)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(host(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))
    shaped = rows.mapInArrow(tidy_batches(_shape), "page_id long, host string, name string, texts array<string>, leaf array<int>")
    joined = shaped.join(learned, ["host", "name"], "left")
    template = lambda i: F.coalesce(F.get("fixed", F.get("leaf", i)), F.lit(False))
    return joined.select("page_id", F.filter("texts", lambda _, i: ~template(i)).alias("slots"))


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of every page."""
    return extract(table(spark, sf_dir, "pages"))
