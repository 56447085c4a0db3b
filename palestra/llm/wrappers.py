"""The main text of web pages, by wrappers inferred from the pages of each host.

Method: union-free regular-expression inference. A page is a stream of tags and texts, nested
by its tags (implied end tags included). The streams of one host are aligned one after the
other, element by element: tags that agree are matched and texts become slots. Paragraphs, rows
and elements of one class that follow each other become repeated parts, alone or as a group.
Where tags do not agree, template parts that say the same at both ends are set aside, what lies
between is searched for other repeats, and parts that are left over become optional. The
expression that remains is the host's wrapper. Each slot knows how many pages fill it, how much
of its text is link text, and whether it says the same on all pages, so that the slots of the
article tell themselves from the template. Then each page is aligned with its host's wrapper,
and the texts in article slots come out.

A host with a third of all pages is no hot group: each task folds its pages into one wrapper
per host before anything is shuffled, and wrappers are merged in rounds of bounded groups.
Wrappers are given to the pages by broadcast as far as they are small together, or of hosts
with at least 1/256 of all pages; those of other hosts are joined.

A wrapper stays small however many pages it covers: a part with more than ``MOST_LABELS``
different children tells them apart by tag alone, one with more than ``LONGEST`` children in a
row keeps one entry per label, and elements below ``DEEPEST`` levels lie side by side. These
bound the expression only, never the text.

Defined results: null and empty pages, and pages with nothing but template, give an empty text;
pages without a host are a host of their own; repeated rows and null ids are pages each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.llm.arrays import slices
from palestra.llm.scratch import Scratch

MOST_LABELS, LONGEST, DEEPEST, WIDEST_GROUP = 64, 128, 100, 4
# Wrappers of one host merged by one task, and hosts held by a task before they are passed on.
FAN_IN, HOSTS_AT_ONCE = 64, 2_000
BROADCAST_BYTES = 32 << 20
# Hosts with at least one in so many pages are broadcast in any case.
HEAVY_HOSTS = 256
# Pages that must say the same before a text counts as template.
FEWEST_PAGES = 3

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea noscript iframe xmp noembed noframes template svg".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var".split()
)
_PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
_CONTAINERS = set("html body div section center table tbody tr td font layer main form fieldset content".split())
# An opening tag of the first kind ends open ones of the second, up to the third.
_ENDS = {
    **{tag: ({"li"}, {"ul", "ol", "menu"}) for tag in ["li"]},
    **{tag: ({"dt", "dd"}, {"dl"}) for tag in ("dt", "dd")},
    **{tag: ({"td", "th"}, {"tr", "table"}) for tag in ("td", "th")},
    "tr": ({"td", "th", "tr"}, {"table"}),
    **{tag: ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}) for tag in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_TEMPLATE_TAGS = set("nav footer aside form head button select dialog menu object canvas audio video fieldset".split())
_TEMPLATE_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside ad ads advert adverts advertisement"
    " advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup login search share sharing social related"
    " recommended footer masthead toolbar pagination pager widget widgets copyright skip complementary contentinfo"
    " alertdialog dialog hidden".split()
)
_COMMENT_WORDS = set("comment comments disqus reply replies respond commentlist".split())
_REGION_WORDS = {"main", "articlebody"}

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>"
    # a quote begins a value only behind an equals sign
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[a-z]+")
_TOLD = {"class", "id", "role", "itemprop", "hidden", "style", "aria-hidden"}


class Element:
    """A block of a page: its texts ``(text, characters of links)`` and blocks in order."""

    __slots__ = ("tag", "words", "parts")

    def __init__(self, tag: str, words: tuple[str, ...]):
        self.tag, self.words, self.parts = tag, words, []


def _words(attributes: str) -> tuple[str, ...]:
    """What class, id, role and the like say, as words without digits."""
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in _TOLD:
            value = "".join(values).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                found.append("hidden")
            elif name == "style":
                found += ["hidden"] * ("display:none" in value.replace(" ", ""))
            elif name != "aria-hidden":
                found += _WORDS.findall(value)
    return tuple(found)


def parsed(html: str) -> Element:
    """The blocks of a page. Inline tags leave no trace but the count of link text; those whose
    words say template take their text with them."""
    root = Element("html", ())
    stack, inline = [root], []  # inline: (tag, depth, dropped)
    text, linked, links, dropped, at, n = [], 0, 0, 0, 0, len(html)

    def flush():
        nonlocal linked
        if text:
            content = " ".join(unescape("".join(text)).split())
            if content:
                stack[-1].parts.append((content, min(linked, len(content))))
            text.clear()
        linked = 0

    def leave(depth):
        nonlocal links, dropped
        flush()
        del stack[depth:]
        while inline and inline[-1][1] > depth:
            tag, _, gone = inline.pop()
            links, dropped = links - (tag == "a"), dropped - gone

    while at < n:
        m = _TAG.search(html, at)
        between = html[at : m.start() if m else n]
        if between and not dropped:
            text.append(between)
            if links:
                linked += len(between)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closes, attributes = m[2].lower(), m[1] == "/", m[3]
        if closes:
            if tag in _INLINE:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == tag:
                        _, _, gone = inline.pop(k)
                        links, dropped = links - (tag == "a"), dropped - gone
                        break
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        leave(k)
                        break
                else:
                    flush()
        elif tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
        elif tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
        elif tag in _INLINE:
            words = _words(attributes) if attributes else ()
            gone = any(w in _TEMPLATE_WORDS or w in _COMMENT_WORDS for w in words)
            inline.append((tag, len(stack), gone))
            links, dropped = links + (tag == "a"), dropped + gone
        else:
            ends, until = _ENDS.get(tag, ((), ()))
            depth = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in ends:
                    depth = k
            # an open paragraph ends where a block begins, an open head where the body does
            if depth == len(stack) and stack[-1].tag in ("p", "head"):
                depth -= 1
            leave(depth)
            if tag == "html":
                continue
            element = Element(tag, _words(attributes) if attributes else ())
            stack[-1].parts.append(element)
            if len(stack) < DEEPEST:
                stack.append(element)
    flush()
    return root


class Part:
    """A part of a wrapper: how many pages have it, whether it repeats, characters of its slot
    and of links in it, the checksum of what it says if all pages agree, and its children.
    ``members`` are the elements of one page that it stands for."""

    __slots__ = ("label", "pages", "many", "chars", "linked", "says", "plain", "children", "members", "keep")

    def __init__(self, label, pages=1, many=False, chars=0, linked=0, says=None, plain=False):
        self.label, self.pages, self.many, self.chars, self.linked = label, pages, many, chars, linked
        self.says, self.plain, self.children, self.members, self.keep = says, plain, [], [], False

    @property
    def tag(self):
        return self.label.split(" ", 1)[0]

    @property
    def words(self):
        return self.label.split(" ")[1:]

    def stored(self) -> list:
        return [self.label, self.pages, int(self.many), self.chars, self.linked, self.says, int(self.plain),
                [c.stored() for c in self.children]]

    @staticmethod
    def read(row: list) -> Part:
        part = Part(*row[:7])
        part.children = [Part.read(c) for c in row[7]]
        return part

    def walk(self) -> Iterator[Part]:
        yield self
        for child in self.children:
            yield from child.walk()


def _label(element: Element, plain: bool) -> str:
    return element.tag if plain else " ".join((element.tag, *element.words))


def _part(elements: list[Element], label: str, plain: bool = False) -> Part:
    """The part that stands for elements of one page with one label."""
    part = Part(label, many=len(elements) > 1, plain=plain)
    part.members = elements
    says, children = [], []
    for element in elements:
        own = []
        for p in element.parts:
            if isinstance(p, tuple):
                part.chars += len(p[0])
                part.linked += p[1]
                says.append(p[0])
            else:
                own.append(p)
        children.append(own)
    part.says = zlib.crc32("\n".join(says).encode())
    sequences = [[(_label(c, plain), [c]) for c in own] for own in children]
    if not plain and sum(map(len, sequences)) > MOST_LABELS and len({k for s in sequences for k, _ in s}) > MOST_LABELS:
        return _part(elements, label, True)
    merged: list = []
    for sequence in sequences:
        merged = _folded(_joined(merged, _folded(sequence)))
    part.children = [_part(members, k) for k, members in merged]
    return part


def _tells(label: str) -> bool:
    """Whether neighbours of this label are alike: they are paragraphs, or words say what they are."""
    tag, *words = label.split(" ")
    return bool(words) or tag in _PARAGRAPHS or tag in ("tr", "option")


def _folded(sequence: list[tuple[str, list]], all_labels: bool = False) -> list[tuple[str, list]]:
    """Neighbours of one label, and groups of neighbours that repeat, taken together."""
    width = 1
    while width <= min(WIDEST_GROUP, len(sequence) // 2):
        out: list = []
        for entry in sequence:
            out.append(entry)
            if (
                len(out) >= 2 * width
                and all(out[-k][0] == out[-k - width][0] for k in range(1, width + 1))
                and (all_labels or any(_tells(out[-k][0]) for k in range(1, width + 1)))
            ):
                last = out[-width:]
                del out[-width:]
                for k in range(width):
                    out[k - width][1].extend(last[k][1])
        width = 1 if width > 1 and len(out) < len(sequence) else width + 1
        sequence = out
    if len(sequence) > LONGEST:
        by_label: dict = {}
        for label, members in sequence:
            by_label.setdefault(label, []).extend(members)
        sequence = list(by_label.items())
    return sequence


def _matched(one: list[str], two: list[str]) -> list[tuple[int | None, int | None]]:
    """An alignment of two sequences of labels with the most matches; the others are optional."""
    first = 0
    while first < min(len(one), len(two)) and one[first] == two[first]:
        first += 1
    last = 0
    while last < min(len(one), len(two)) - first and one[-1 - last] == two[-1 - last]:
        last += 1
    a, b = one[first : len(one) - last], two[first : len(two) - last]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    found: list = [(k, k) for k in range(first)]
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            found.append((first + i, first + j))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            found.append((first + i, None))
            i += 1
        else:
            found.append((None, first + j))
            j += 1
    return found + [(len(one) - k, len(two) - k) for k in range(last, 0, -1)]


def _joined(one: list[tuple[str, list]], two: list[tuple[str, list]]) -> list[tuple[str, list]]:
    if not one or not two:
        return one or two
    out = []
    for i, j in _matched([k for k, _ in one], [k for k, _ in two]):
        if i is not None and j is not None:
            one[i][1].extend(two[j][1])
        out.append(two[j] if i is None else one[i])
    return out


def _generalised(part: Part) -> Part:
    """The part with children told apart by tag alone."""
    part.plain = True
    for child in part.children:
        child.label = child.tag
    part.children = _refolded(part.children)
    return part


def _refolded(parts: list[Part]) -> list[Part]:
    """The parts with all neighbours that repeat taken together."""
    out = []
    for _, members in _folded([(p.label, [p]) for p in parts], True):
        whole = members[0]
        for p in members[1:]:
            whole = merged(whole, p, together=True)
        out.append(whole)
    return out


def _content(part: Part) -> int | None:
    """The checksum of what a part and all below it say; none if it is not the same everywhere."""
    found = [p.says for p in part.walk()]
    return None if None in found else zlib.crc32(",".join(map(str, found)).encode())


def _aligned(one: list[Part], two: list[Part], fold_one: bool = True) -> list[tuple[Part | None, Part | None]]:
    """The children of two parts, matched."""
    if [c.label for c in one] == [c.label for c in two]:
        return list(zip(one, two))

    def template(a, b):
        return a.label == b.label and _content(a) is not None and _content(a) == _content(b)

    first = last = 0
    while first < min(len(one), len(two)) and template(one[first], two[first]):
        first += 1
    while last < min(len(one), len(two)) - first and template(one[-1 - last], two[-1 - last]):
        last += 1
    a, b = one[first : len(one) - last], _refolded(two[first : len(two) - last])
    a = _refolded(a) if fold_one else a
    found = [
        (None if i is None else a[i], None if j is None else b[j])
        for i, j in _matched([c.label for c in a], [c.label for c in b])
    ]
    return [*zip(one[:first], two[:first]), *found, *zip(one[len(one) - last :], two[len(two) - last :])]


def merged(one: Part, two: Part, together: bool = False) -> Part:
    """The wrapper of all pages of both; ``together`` if both are parts of the same pages."""
    if one.plain != two.plain:
        one, two = (p if p.plain else _generalised(p) for p in (one, two))
    if together:
        says = None if None in (one.says, two.says) else zlib.crc32(f"{one.says},{two.says}".encode())
    else:
        says = one.says if one.says == two.says else None
    part = Part(
        one.label, max(one.pages, two.pages) if together else one.pages + two.pages, one.many or two.many or together,
        one.chars + two.chars, one.linked + two.linked, says, one.plain,
    )
    part.members = one.members + two.members
    for a, b in _aligned(one.children, two.children):
        part.children.append(merged(a, b, together) if a and b else a or b)
    labels = [c.label for c in part.children]
    if len(labels) > LONGEST or any(a == b and _tells(a) for a, b in zip(labels, labels[1:])):
        part.children = _refolded(part.children)
    if not part.plain and len({c.label for c in part.children}) > MOST_LABELS:
        part = _generalised(part)
    return part


def _decided(root: Part) -> Part:
    """The wrapper with ``keep`` set on the parts whose slots belong to the article."""
    chars: dict[int, tuple[int, int]] = {}
    regions: dict[int, bool] = {}

    def measure(part):
        own, linked = part.chars - part.linked, part.linked
        holds = False
        for child in part.children:
            measure(child)
            own, linked = own + chars[id(child)][0], linked + chars[id(child)][1]
            holds |= regions[id(child)] or is_region(child)
        chars[id(part)], regions[id(part)] = (own, linked), holds

    def is_region(part):
        return (part.tag in ("article", "main") or not _REGION_WORDS.isdisjoint(part.words)) and _COMMENT_WORDS.isdisjoint(part.words)

    measure(root)
    total = max(1, chars[id(root)][0])

    def is_template(part, inside, explicit=False):
        if part.tag in ("body", "html"):
            return False
        if not _COMMENT_WORDS.isdisjoint(part.words):
            return part.tag != "article" or not regions[id(part)]
        if regions[id(part)] or is_region(part):
            return False
        if part.tag in ("nav", "footer", "aside", "head"):
            return True
        told = part.tag in _TEMPLATE_TAGS or not _TEMPLATE_WORDS.isdisjoint(part.words)
        told |= not inside and (part.tag == "header" or "header" in part.words)
        if told and (part.many or 5 * chars[id(part)][0] <= 3 * total):
            return True
        text, linked = chars[id(part)]
        return not explicit and linked > 2 * text and part.tag not in _PARAGRAPHS - {"li"}

    found: list[Part] = []

    def search(part, tag):
        for child in part.children:
            if not is_template(child, False):
                if child.tag == tag or (is_region(child) and not _REGION_WORDS.isdisjoint(child.words)):
                    found.append(child)
                else:
                    search(child, tag)

    for tag in ("article", "main"):
        search(root, tag)
        if 4 * sum(chars[id(p)][0] for p in found) >= total:
            break
        found.clear()
    explicit = bool(found)
    if not explicit:
        found = [_densest(root, is_template)]
    varies = any(p.says is None and p.chars for region in found for p in region.walk())

    def keep(part, inside, constant):
        part.keep = not (constant and part.says is not None and part.pages >= FEWEST_PAGES)
        for child in part.children:
            if not is_template(child, inside, explicit):
                keep(child, inside, varies and (not explicit or child.tag not in _PARAGRAPHS))

    for region in found:
        keep(region, explicit or region.tag not in ("body", "html"), False)
    if not explicit and not any(p.tag == "h1" for p in found[0].walk()):
        _keep_title(root, is_template)
    return root


def _densest(root: Part, is_template) -> Part:
    """The smallest container that holds three quarters of the text that varies."""

    def weight(part):
        own = 0 if part.says is not None and part.pages >= FEWEST_PAGES else part.chars - part.linked
        return own + sum(weight(c) for c in part.children if not is_template(c, False))

    region, whole = root, weight(root)
    while True:
        inner = [c for c in region.children if c.tag in _CONTAINERS and not c.many and not is_template(c, False)]
        heaviest = max(inner, key=weight, default=None)
        if heaviest is None or 4 * weight(heaviest) < 3 * whole or not whole:
            return region
        region = heaviest


def _keep_title(part: Part, is_template) -> None:
    for child in part.children:
        if not is_template(child, False):
            if child.tag == "h1" and not (child.says is not None and child.pages >= FEWEST_PAGES):
                child.keep = True
            _keep_title(child, is_template)


def _texts(page: Element, root: Part) -> list[str]:
    """The texts of a page in slots of the article, in the page's order."""
    kept: set[int] = set()

    def align(part, wrapper):
        if wrapper.keep:
            kept.update(id(m) for m in part.members)
        if wrapper.plain and not part.plain:
            part = _part(part.members, part.label, True)
        for other, child in _aligned(wrapper.children, part.children, False):
            if child and not other:  # out of order: the part of that label anywhere in the sequence
                other = next((c for c in wrapper.children if c.label == child.label), None)
            if child and other:
                align(child, other)

    def emit(element):
        for p in element.parts:
            if isinstance(p, tuple):
                if id(element) in kept:
                    out.append(p[0])
            else:
                emit(p)

    out: list[str] = []
    align(_part([page], "html"), root)
    emit(page)
    return out


def page_text(html: str | None, wrapper: Part | None = None) -> str:
    """The main text of a page by a wrapper that is decided; a page that the wrapper finds no
    article in is its own wrapper."""
    page = parsed(html or "")
    found = _texts(page, wrapper) if wrapper else []
    return "\n".join(found or _texts(page, _decided(_part([page], "html"))))


def _host():
    name = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name).alias("host")


def _encoded(part: Part) -> str:
    return json.dumps(part.stored(), separators=(",", ":"))


_WRAPPERS = "host string, pages long, wrapper string"


def wrappers(pages: DataFrame, fan_in: int = FAN_IN, scratch: Scratch | None = None) -> DataFrame:
    """Per host the number of its pages and its wrapper."""
    scratch = scratch or Scratch(pages.sparkSession)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Part] = {}

        def passed_on():
            rows = [(h, p.pages, _encoded(p)) for h, p in sorted(held.items())]
            columns = list(zip(*rows)) or [[], [], []]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["host", "pages", "wrapper"],
            )

        for batch in slices(batches, "html"):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                part = _bare(_part([parsed(html or "")], "html"))
                held[host] = merged(held[host], part) if host in held else part
            if len(held) > HOSTS_AT_ONCE:
                yield passed_on()
        yield passed_on()

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pages", "wrapper"], ascending=[False, True])
        whole = None
        for row in group["wrapper"]:
            part = Part.read(json.loads(row))
            whole = part if whole is None else merged(whole, part)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "pages": [whole.pages], "wrapper": [_encoded(whole)]})

    found = scratch.table(pages.select(_host(), "html").mapInArrow(folded, _WRAPPERS), "wrappers")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        salts = -(-most // fan_in)
        salted = found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
        found = scratch.table(salted.groupBy("host", "salt").applyInPandas(together, _WRAPPERS), "wrappers")


def _bare(part: Part) -> Part:
    """The part without the page's elements."""
    for p in part.walk():
        p.members = []
    return part


def main_texts(
    pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, fan_in: int = FAN_IN, scratch: Scratch | None = None
) -> DataFrame:
    """Per page its id, url, main text and the characters of it."""
    scratch = scratch or Scratch(pages.sparkSession)
    found = wrappers(pages, fan_in, scratch)
    total, size = found.agg(F.sum("pages"), F.sum(F.length("wrapper"))).first()
    common = F.lit(True) if (size or 0) <= broadcast_bytes else F.col("pages") * HEAVY_HOSTS >= total
    given = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.where(common).collect()})
    schema = T.StructType([pages.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Part] = {}
        for batch in slices(batches, "html"):
            own = batch.column("wrapper").to_pylist() if "wrapper" in batch.schema.names else [None] * batch.num_rows
            texts = []
            for host, html, wrapper in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), own):
                if host not in known:
                    if len(known) > HOSTS_AT_ONCE:
                        known.clear()
                    known[host] = _decided(Part.read(json.loads(wrapper or given.value[host])))
                texts.append(page_text(html, known[host]))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    read = pages.select("page_id", "url", "html", _host())
    if (size or 0) <= broadcast_bytes:
        out = read.mapInArrow(rows, schema)
    else:
        names = found.where(common).select("host")  # at most HEAVY_HOSTS rows
        rare = read.join(F.broadcast(names), "host", "left_anti").join(found.where(~common).select("host", "wrapper"), "host")
        out = read.join(F.broadcast(names), "host", "left_semi").mapInArrow(rows, schema).unionByName(rare.mapInArrow(rows, schema))
    return out.select("*", F.length("text").cast("long").alias("n_chars"))
