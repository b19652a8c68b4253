"""Main text of web pages by wrappers: union-free regular expressions over the token streams of a host's pages.

The tags of a page are folded into a pattern: what repeats side by side is one repeated group, and each
text is held by its hash. The patterns of a host's distinct pages are aligned, part by part and then the
parts' results. Where two texts differ, the literal becomes a slot; what only one side has becomes optional.
The result is the host's wrapper, a nested expression of tags, ``(...)?``, ``(...)+``, literals ``"`` and
slots ``#``.

The wrapper decides the text. A literal that several distinct pages share belongs to the template. The article is
the smallest element that holds most of what the slots hold; each page is matched against the wrapper,
and its text is what stands in the article's slots. Names and tags known from HTML (menus, footers,
adverts, comments, article, main) rule slots out or tell of two places which is the article; only a host
with one distinct page, where nothing can be aligned, has nothing but them.
"""

from __future__ import annotations

import html
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import discard, short_batches, stored

#: A quote counts only after an equals sign. What a tag has taken is not given back, so each is read once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>|<[!?][^>]*>", re.S
)
#: Elements nested deeper than this belong to the one above them, so that no walk of a tree goes deeper.
DEEPEST = 150
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe")}
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one of the set begins beside them.
ENDS = {
    "p": None,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
ASIDE_TAGS = frozenset(
    "nav header footer aside form head script style noscript template svg iframe button select textarea title dialog menu object".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts adslot banner promo promotion sponsor sponsored cookie cookies consent notice notices alert "
    "popup modal newsletter subscribe signup login comment comments reply replies respond disqus discussion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs toolbar share sharing social related recommended footer header masthead pagination pager "
    "widget hidden search complementary contentinfo".split()
)
#: Words that make a name one of the page's layout or state, as in ``has-sidebar`` or ``header-fixed``.
MODIFIERS = frozenset(
    "has with without no not open opened closed fixed sticky enabled disabled active layout overflow backface".split()
)
MAIN_WORDS = frozenset("article content post entry story articlebody main".split())
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Za-z]+")
_WHITE = re.compile(r"\s+")
#: A slash at the end of a tag that belongs to an unquoted value.
_IN_VALUE = re.compile(r"=\s*[^\s\"']*/\Z")


def _label(tag: str, attributes: str) -> str:
    """Tag, the words that class, id (after ``#``) and role name it by, and ``!hidden``; numbers in them do not
    count, nor does a heading's id, which is an anchor; ``/``, which parts the labels of a path, is ``_``."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    words = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() in ("class", "role", "itemprop"):
            words += _DIGITS.sub("0", value.lower().replace("/", "_")).split()
        elif name.lower() == "id" and tag not in HEADINGS:
            words += ["#" + w for w in _DIGITS.sub("0", value.lower().replace("/", "_")).split()]
        elif name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none", value):
            words.append("!hidden")
    return ".".join([tag, *sorted(set(words))])


class Page:
    """Blocks of a page as (path, text, characters inside links), and its folded pattern.

    A node of a pattern is name, optional, repeated, children, and of a text (``#``) what is known of it:
    pages, characters, characters inside links, hash (0: texts differ), places in ``blocks``."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int]] = []
        self.text: list[str] = []
        self.linked = self.in_link = 0
        self.stack: list[tuple[str, str, str, list]] = [("", "", "", [])]
        #: Tags of the open elements below the deepest one that is kept.
        self.deeper: list[str] = []
        # No tag ends behind the last bracket: it is not looked for there.
        at, size, last = 0, len(source), source.rfind(">") + 1
        while at < size:
            found = _TOKEN.search(source, at, last) if at < last else None
            if found is None and (comment := source.find("<!--", max(at, last))) >= 0:
                size = comment
                if at >= size:
                    break
            end = found.start() if found else size
            if end > at:
                self._add(html.unescape(source[at:end]) if "&" in source[at:end] else source[at:end])
            if not found:
                break
            at = found.end()
            closing, tag, attributes = found.groups()
            if tag is None:
                if found[0].startswith("<!--") and not found[0].endswith("-->"):
                    break  # a comment without an end
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in _RAW:
                if tag == "svg" and attributes.endswith("/") and not _IN_VALUE.search(attributes):
                    continue  # foreign content: such a tag has no inside
                stop = _RAW[tag].search(source, at)
                at = stop.end() if stop else at if tag == "svg" else size
            elif tag in INLINE:
                self.in_link += tag == "a"
                if tag == "br":
                    self._add("\n")
            else:
                self._open(tag, _label(tag, attributes), attributes.endswith("/"))
        while len(self.stack) > 1:
            self._pop()
        self._end_block()
        self.pattern = ["", 0, 0, fold(self.stack[0][3])]

    def _add(self, text: str) -> None:
        self.text.append(text)
        if self.in_link:
            self.linked += len(text)

    def _end_block(self) -> None:
        text = _WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            _, _, path, children = self.stack[-1]
            told = [1, len(text), min(self.linked, len(text)), _code(text), [len(self.blocks)]]
            self.blocks.append((path, text, self.linked))
            children.append(["#", 0, 0, [], told])
        self.text, self.linked = [], 0

    def _open(self, tag: str, label: str, empty: bool) -> None:
        self._end_block()
        while len(self.stack) > 1:
            top = self.stack[-1][0]
            if top not in ENDS or ENDS[top] is not None and tag not in ENDS[top]:
                break
            self._pop()
        if tag in VOID or empty:
            return
        self.in_link = 0
        if len(self.stack) > DEEPEST:
            self.deeper.append(tag)
            return
        self.stack.append((tag, label, f"{self.stack[-1][2]}/{label}", []))

    def _pop(self) -> None:
        self._end_block()
        self.deeper.clear()
        _, label, _, children = self.stack.pop()
        self.stack[-1][3].append([label, 0, 0, fold(children)])

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            self.in_link = max(0, self.in_link - (tag == "a"))
            return
        # An end tag without its start is nothing; one further out ends all that is open inside.
        if tag in self.deeper:
            self._end_block()
            while self.deeper.pop() != tag:
                pass
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                while len(self.stack) > depth:
                    self._pop()
                return
        self._end_block()


def _code(text: str) -> int:
    """63 bits that tell a text; never 0."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1 or 1


def _name(node: list) -> str:
    return node[0] if node[0] != "()" else "(" + " ".join(map(_name, node[3])) + ")"


def fold(nodes: list) -> list:
    """Neighbours of equal name become one repeated node, and so do runs of two or three that repeat."""
    out: list = []
    for node in nodes:
        if out and _name(out[-1]) == _name(node):
            out[-1] = merge(out[-1], node, max)
            out[-1][2] = 1
        else:
            out.append(node)
    for width in (2, 3):
        at = 0
        while at + 2 * width <= len(out):
            names = [_name(n) for n in out[at : at + width]]
            group = ["()", 0, 1, out[at : at + width]]
            times = 1
            while [_name(n) for n in out[at + times * width : at + (times + 1) * width]] == names:
                again = out[at + times * width : at + (times + 1) * width]
                group[3] = [merge(a, b, max) for a, b in zip(group[3], again)]
                times += 1
            if times > 1:
                out[at : at + times * width] = [group]
            at += 1
    return out


def _both(a: int, b: int) -> int:
    return a + b


def merge(a: list, b: list, pages=_both) -> list:
    """One node for two of equal name. ``pages`` adds up pages where the two are of different pages."""
    out = [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3], pages)]
    if a[0] == "#":
        (n, chars, linked, code, places), (n2, chars2, linked2, code2, places2) = a[4], b[4]
        places.extend(places2)
        out.append([pages(n, n2), chars + chars2, linked + linked2, code if code == code2 else 0, places])
    return out


def align(left: list, right: list, pages=_both) -> list:
    """A longest common order of two lists of nodes; what only one has is optional."""
    pairs = common([_name(n) for n in left], [_name(n) for n in right])
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(left), len(right))]:
        out += [[n[0], 1, *n[2:]] for n in left[i:x]] + [[n[0], 1, *n[2:]] for n in right[j:y]]
        if x < len(left):
            out.append(merge(left[x], right[y], pages))
        i, j = x + 1, y + 1
    return out if len(pairs) == len(left) == len(right) else fold(out)


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Equal ends are taken off first; the rest is halved
    by the lengths of its common parts, a row at a time, so that memory is linear."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    codes: dict = {}
    x, y = (np.array([codes.setdefault(n, len(codes)) for n in names], dtype=np.int64) for names in (a, b))
    return _common(x, y, 0, 0)


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each j the length of a longest common subsequence of ``x`` and the first j of ``y``."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for code in x:
        row[1:] = np.maximum(row[1:], row[:-1] + (y == code))
        np.maximum.accumulate(row, out=row)
    return row


def _common(x: np.ndarray, y: np.ndarray, at: int, to: int) -> list[tuple[int, int]]:
    first, most = 0, min(len(x), len(y))
    while first < most and x[first] == y[first]:
        first += 1
    last = 0
    while last < most - first and x[-1 - last] == y[-1 - last]:
        last += 1
    begin = [(at + k, to + k) for k in range(first)]
    end = [(at + len(x) - k, to + len(y) - k) for k in range(last, 0, -1)]
    x, y, at, to = x[first : len(x) - last], y[first : len(y) - last], at + first, to + first
    if len(x) == 0 or len(y) == 0:
        return begin + end
    if len(x) == 1:
        found = np.flatnonzero(y == x[0])
        return begin + [(at, to + int(k)) for k in found[:1]] + end
    half = len(x) // 2
    cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    return begin + _common(x[:half], y[:cut], at, to) + _common(x[half:], y[cut:], at + half, to + cut) + end


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags, literals (``"``) and text slots."""
    inner = "".join(map(expression, node[3]))
    text = inner if node[0] in ("()", "") else ('"' if literal(node) else "#") if node[0] == "#" else f"<{node[0]}>{inner}</>"
    if node[1] or node[2]:
        text = f"({text})" + ("*" if node[1] and node[2] else "?" if node[1] else "+")
    return text


#: Distinct pages that must agree on a text before it is one of the template.
AGREE = 3


def literal(node: list) -> bool:
    """Whether a text is one of the template: equal on all distinct pages that hold its place."""
    return node[4][3] != 0 and node[4][0] >= AGREE


def flat(nodes: list) -> Iterator[list]:
    """Nodes with groups opened; what is in a repeated group counts as repeated."""
    for node in nodes:
        if node[0] == "()":
            for inner in flat(node[3]):
                yield [*inner[:2], inner[2] | node[2], *inner[3:]] if node[2] and not inner[2] else inner
        else:
            yield node


def _words(name: str) -> set[str]:
    return {*_WORDS.findall(name), *re.split(r"[-_]", name)}


def _aside(names: str, inside: bool) -> bool:
    """Whether a name says that the element stands beside the text. What follows ``--`` and names with
    a word of ``MODIFIERS`` tell how an element looks, not what it is. An id inside an article is the name of
    a part of it (``related-work``) unless all its words say so."""
    for name in names.split("."):
        words = _words(name.lstrip("#").partition("--")[0])
        if words & ASIDE_WORDS and not words & MODIFIERS:
            if not (inside and name.startswith("#") and {w for w in words if w.isalpha()} - ASIDE_WORDS):
                return True
    return False


def rank(path: str, chars: int, linked: int, constant: bool) -> int | None:
    """1: inside an article, 2: inside a main element, 3: inside something named like one, 4: inside an
    article that only stands in something named as beside the text, 5: other text that is not mostly
    links; None: beside the text, or a literal outside article and main elements.

    Names of html, body, main and article are no asides, and a main element overrides those around it;
    inside an article or main element every name counts, that of an article in it as well."""
    best, beside = 5, False
    for label in path.split("/"):
        tag, _, names = label.partition(".")
        words = {w for n in names.split(".") for w in _words(n.lstrip("#"))}
        if tag in ASIDE_TAGS or "!hidden" in names.split(".") and tag not in ("html", "body"):
            return None
        inside = best in (1, 2, 4)
        if _aside(names, inside) and tag not in ("html", "body", "main") and (tag != "article" or inside):
            if inside:
                return None
            best, beside = 5, True
        if tag == "main":
            beside = False
        if tag == "article" or "articlebody" in words and not beside:
            best = min(best, 4 if beside else 1)
        elif tag == "main" or "main" in words and "content" not in words and not beside:
            best = min(best, 2)
        elif words & MAIN_WORDS and not beside:
            best = min(best, 3)
    if beside and best != 4:
        return None
    if constant and best in (3, 5) or best == 5 and 2 * linked > chars:
        return None
    return best


class _Place:
    """An element or text of a wrapper while the article is looked for."""

    def __init__(self, node: list, path: str):
        self.tag, self.repeated, self.text = node[0].partition(".")[0], node[2], node[0] == "#"
        self.path = path if self.text or not node[0] else f"{path}/{node[0]}"
        self.inside = [_Place(n, self.path) for n in flat(node[3])]
        self.rank = self.level = None
        self.slot = False
        self.chars = 0
        if self.text:
            _, self.chars, linked, _, _ = node[4]
            self.rank = rank(self.path, self.chars, linked, literal(node))
            self.slot = self.rank is not None and not literal(node)

    def texts(self) -> Iterator[_Place]:
        if self.text:
            yield self
        for place in self.inside:
            yield from place.texts()

    def weigh(self, marked: bool) -> int:
        """Characters that the slots inside hold, those in article and main elements alone if ``marked``."""
        if not self.text:
            self.chars = sum([p.weigh(marked) for p in self.inside])
        elif not self.slot or marked and self.rank > 2:
            self.chars = 0
        return self.chars

    def tree(self) -> list:
        return [self.path.rpartition("/")[2] if not self.text else "#", self.level if self.text else [p.tree() for p in self.inside]]


def judged(wrapper: list, pages: int) -> list:
    """The wrapper as nested (name, inside), with a level in place of the inside of each text: 1 to 5 in
    the article, higher ones beside it, by ``rank``; null for what is never text.

    The article is looked for from the outside: while one element inside holds at least half of what the slots hold
    it is the next, up to an article or main element, one that repeats, one with nothing but text in it, and one
    beside which a heading differs from page to page. Slots in article and main elements come before others."""
    top = _Place(wrapper, "")
    texts = list(top.texts())
    for place in texts:
        place.level = place.rank
    if pages > 1 and top.weigh(any(p.slot and p.rank <= 2 for p in texts)):
        for place in texts:
            place.level = place.rank and place.rank + 10
        at = top
        while at.tag not in ("article", "main"):
            inner = [p for p in at.inside if not p.text]
            best = max(inner, key=lambda p: p.chars, default=None)
            if best is None or 2 * best.chars < at.chars or best.repeated:
                break
            if all(p.text for p in best.inside) and best.tag not in ("article", "main"):
                break
            if any(p is not best and p.tag in HEADINGS and p.chars for p in inner):
                break
            at = best
        for place in at.texts():
            place.level = place.rank
    return top.tree()


def match(page: list, wrapper: list, levels: dict[int, int]) -> None:
    """Give each block of a page (by its place) the level of the text of the wrapper that it falls on.

    Children are aligned in order with those of the wrapper, groups opened on both sides; what an alignment
    leaves over (a further turn of a repeated group) belongs to the nearest of equal name."""
    nodes = list(flat(page))
    pairs = dict(common([n[0] for n in nodes], [n[0] for n in wrapper]))
    places: dict[str, list[int]] = {}
    if len(pairs) < len(nodes):
        for j, other in enumerate(wrapper):
            places.setdefault(other[0], []).append(j)
    last = 0
    for i, node in enumerate(nodes):
        if i in pairs:
            last = pairs[i]
        elif node[0] in places:
            last = min(places[node[0]], key=lambda j: (abs(j - last), j))
        else:
            continue
        inside = wrapper[last][1]
        if node[0] != "#":
            match(node[3], inside, levels)
        elif inside is not None:
            levels.update(dict.fromkeys(node[4][4], inside))


def host(url: Column) -> Column:
    """Host of a URL in lower case; empty when there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return found


_PATTERN = "host string, pattern string, pages long"
_READ = pa.schema([("host", pa.string()), ("digest", pa.string()), ("pattern", pa.string())])


def _patterns(pages: DataFrame) -> DataFrame:
    """``host``, ``pattern``, ``digest``: one row per distinct page of a host, pages with the same texts
    in the same elements being one."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, source in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                page = Page(source or "")
                whole = "\n".join(f"{path}\t{text}" for path, text, _ in page.blocks)
                digest = hashlib.md5(whole.encode("utf-8", "replace")).hexdigest()
                rows.append((name, digest, json.dumps(_without_places(page.pattern), separators=(",", ":"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=_READ)

    short_batches()
    read = pages.select("host", "html").mapInArrow(run, "host string, digest string, pattern string")
    return read.groupBy("host", "digest").agg(F.min("pattern").alias("pattern"))


def _without_places(node: list) -> list:
    return [*node[:3], [_without_places(n) for n in node[3]], *([[*node[4][:4], []]] if node[0] == "#" else [])]


def _aligned(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in sorted(rows["pattern"], key=lambda p: (len(p), p)):
        node = json.loads(text)
        whole = node if whole is None else merge(whole, node)
    pattern = json.dumps(whole, separators=(",", ":"))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "pattern": [pattern], "pages": [int(rows["pages"].sum())]})


def infer(pages: DataFrame, most: int = 256) -> DataFrame:
    """``host``, ``wrapper``, ``tree``: per host the expression of its distinct pages, and its texts with
    the levels of ``judged``.

    The patterns of a host are dealt into parts of about ``most``, each aligned by itself; the results are
    aligned again in further rounds until one is left, so a host of very many pages is no single task.
    """
    held = stored(_patterns(pages).select("host", "pattern", F.lit(1).cast("long").alias("pages"), F.xxhash64("digest").alias("deal")), "patterns")
    while True:
        sizes = held.groupBy("host").agg(F.count("*").alias("rows"))
        if not sizes.where("rows > 1").head(1):
            break
        # Grouped by one column of both, or the join's partitioning by host would serve the groups as well.
        dealt = held.join(sizes, "host").withColumn("part", F.struct("host", F.pmod("deal", F.ceil(F.col("rows") / most))))
        merged = dealt.groupBy("part").applyInPandas(_aligned, _PATTERN)
        before, held = held, stored(merged.withColumn("deal", F.xxhash64("host", "pattern")), "patterns")
        discard(before)

    @F.pandas_udf("wrapper string, tree string")
    def told(pattern: pd.Series, pages: pd.Series) -> pd.DataFrame:
        nodes = [json.loads(p) for p in pattern]
        trees = [json.dumps(judged(n, int(k)), separators=(",", ":")) for n, k in zip(nodes, pages)]
        return pd.DataFrame({"wrapper": [expression(n) for n in nodes], "tree": trees})

    return held.select("host", told("pattern", "pages").alias("told")).select("host", "told.*")


def main_text(source: str, tree: list) -> str:
    """Blocks on the texts of the best level that this page holds, one per line, in page order."""
    page, levels = Page(source), {}
    match(page.pattern[3], tree[1], levels)
    if not levels:
        return ""
    best = min(levels.values())
    return "\n".join(page.blocks[place][1] for place in sorted(levels) if levels[place] == best)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page; other columns are not read.

    A null or empty html, or one without an article, has the empty text. Pages without a readable
    URL are one host. A repeated row comes out again; an empty table gives an empty one.
    """
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    wrappers = stored(infer(rows).select("host", "tree"), "wrappers")

    @F.pandas_udf("string")
    def text(source: pd.Series, tree: pd.Series) -> pd.Series:
        trees = {t: json.loads(t) for t in tree.dropna().unique()}
        return pd.Series([main_text(s or "", trees[t]) if t is not None else "" for s, t in zip(source, tree)], dtype=object)

    joined = rows.join(wrappers, "host", "left")
    return joined.select("page_id", "url", text("html", "tree").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
