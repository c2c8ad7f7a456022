"""Main text of web pages by composite text density.

Every node of the page's tree gets the density

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

of its characters C, tags T, characters in links LC and link tags LT (LCb and Cb: those of the body; 0 counts as 1). The node whose
children's densities sum to most holds the article. The least density on the path from it to the body is the threshold that a part
of the page beside this path must reach to belong to the article too; a first heading always does, and within an article or main
element that holds the node all does that has a density at all, which links alone have not. Tags that only set the look of words
don't count as tags.

Parts that say themselves that they are not text of the article (navigation, forms, scripts, adverts, comments and the like) are
taken off first, but a form that holds most of the page loses only its controls. Names of classes that can mean several things only
nominate a part: inside the chosen node its density decides. Names that can be an article's topic too (a section on logins, a
paragraph classed as a comment) take a part off until the node is chosen, and bring it back if it reads like the text around it. A list
of readers' comments without such a name is told by its structure: repeated items, each with a line on who wrote it or when.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm.shared import groups_of

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE_VALUE = re.compile(r"[^\s>]*")
PART = re.compile(r"[a-z]+|[0-9]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and their ends.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in "script style textarea title iframe noembed noframes xmp".split()}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements within a line, which don't count as tags.
INLINE = frozenset("abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr".split())
#: An opening tag of the key ends an open element of the value, up to the listed scopes.
ENDS_ITS_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table", "select", "menu")
PARAGRAPH_SCOPES = (*SCOPES, "td", "th", "button")
OFF_TAGS = frozenset("nav footer aside button select option datalist dialog menu script style textarea title head noscript template iframe noembed noframes svg canvas object audio video map".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: Names of classes and ids that mean a part beside the article wherever it lies.
OFF_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter subscribe subscription share sharing comment comments disqus replies respond footer copyright pagination pager login signup".split())
#: Names that may mean one: inside the article they need a low density too.
VAGUE_WORDS = frozenset("sponsor promo promotion banner notice notices alert social related recommended recommendations reply widget toolbar search".split())
#: Those of OFF_WORDS that may be what a part of the article is about.
TOPIC_WORDS = frozenset("comment share sharing login signup subscription subscribe menu navigation".split())
#: Names of what a reader's comment says of itself, and of lists of comments.
WRITER_WORDS = frozenset("author user username byline avatar nickname commenter poster date time timestamp posted when ago".split())
THREAD_WORDS = frozenset("discussion discussions thread threads responses reactions opinions talkback feedback conversation".split())
DATE = re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d{2}\b|\b(?:\d+|an?)\s+(?:second|minute|hour|day|week|month|year)s?\s+ago\b|\b(?:yesterday|just now)\b|\b(?:19|20)\d\d\b", re.I)
#: Elements with which forms are filled in.
CONTROLS = frozenset("input button select textarea option form".split())
#: A part with a topic's name must have so many characters, this share of its neighbours' density, and at most this share of links to come
#: back; a comment's line on itself has at most so many characters.
PROSE, ALIKE, LINKS, META_LINE = 60, 0.6, 0.25, 80
#: Parts of the same tag and names from which on these may be those of all text.
SHARED = 3
#: What a name may end in and mean the same.
HOLDERS = frozenset("area articles bar block body bottom box button buttons container content feed footer form header icons inner item items left line link links list main message module outer panel posts region right row section sidebar slot stories text thread title top unit widget wrap wrapper zone".split())
#: Beginnings that make a name tell of something else.
TELLS = frozenset("has no with without is not".split())
#: Off only outside an article, and not where they hold its heading alone.
HEADERS = frozenset("header masthead topbar".split())
KEPT_TAGS = ("html", "body", "article", "main")


def names_one(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id is one of words, alone, at its end, or with names of holders and numbers behind it."""
    parts = PART.findall(name)
    if not parts or parts[0] in TELLS:
        return False
    while len(parts) > 1 and (parts[-1] in HOLDERS and parts[-1] not in words or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] in words


class Page:
    """A page's tree: node 0 is the root; per node its parent, tag, marks as off and as maybe off, and pieces of text and child nodes
    in order. Built in one pass: open elements are a stack, with the places of each tag in it."""

    def __init__(self, source: str):
        self.parent, self.tag, self.off, self.vague, self.parts = [-1], ["html"], [False], [False], [[]]
        self.headers: set[int] = set()
        self.forms: set[int] = set()
        self.topics: set[int] = set()
        self.names: list[str] = [""]
        self.stack, self.places = [0], defaultdict(list)
        self.read(source)

    def add(self, tag: str, attributes: dict[str, str]) -> int:
        node, at = len(self.parent), self.stack[-1]
        self.parent.append(at)
        self.tag.append(tag)
        self.parts.append([])
        self.parts[at].append(node)
        off = tag in OFF_TAGS or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        if tag == "form":
            off = True
            self.forms.add(node)
        elif tag in ("label", "legend") and self.places["form"]:
            off = True
        off = off or attributes.get("role", "").lower().strip() in OFF_ROLES or bool(HIDING.search(attributes.get("style", "").lower()))
        vague = False
        self.names.append(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
        if tag not in KEPT_TAGS and not off:
            names = self.names[node].split()
            off = any(names_one(x, OFF_WORDS) for x in names)
            if off and not any(names_one(x, OFF_WORDS - TOPIC_WORDS) for x in names):
                self.topics.add(node)
            vague = not off and any(names_one(x, VAGUE_WORDS) for x in names)
            if not off and not self.places["article"] and not self.places["main"] and (tag == "header" or any(names_one(x, HEADERS) for x in names)):
                off = True
                self.headers.add(node)
        self.off.append(off)
        self.vague.append(vague)
        return node

    def push(self, node: int) -> None:
        self.places[self.tag[node]].append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Ends the open element at a place of the stack and all within it."""
        while len(self.stack) > depth:
            self.places[self.tag[self.stack.pop()]].pop()

    def nearest(self, tags: tuple[str, ...], scopes: tuple[str, ...] = ()) -> int:
        """The place of the innermost open element of these tags that lies within all open scopes; 0 if none."""
        last = lambda names: max((self.places[t][-1] for t in names if self.places[t]), default=0)
        found = last(tags)
        return found if found > last(scopes) else 0

    def attributes(self, source: str, place: int) -> tuple[dict[str, str], int, bool]:
        """The attributes of a tag from here on, by the first of each name, the place behind the tag (-1: never ends) and
        whether it ends itself."""
        found: dict[str, str] = {}
        while True:
            gap = GAP.match(source, place)
            place = gap.end()
            if place >= len(source):
                return found, -1, False
            if source[place] == ">":
                return found, place + 1, gap[0].endswith("/")
            m = ATTRIBUTE.match(source, place)
            name, value, place = m[0].lower(), "", m.end()
            if equals := EQUALS.match(source, place):
                place = equals.end()
                quote = source[place : place + 1]
                end = source.find(quote, place + 1) if quote in ('"', "'") and self.last[quote] > place else -1
                if end >= 0:
                    value, place = source[place + 1 : end], end + 1
                else:
                    m = BARE_VALUE.match(source, place)
                    value, place = m[0], m.end()
            found.setdefault(name, html.unescape(value) if "&" in value else value)

    def text_of(self, source: str, start: int, end: int) -> None:
        if end > start:
            self.parts[self.stack[-1]].append(html.unescape(source[start:end]))

    def read(self, source: str) -> None:
        self.last = {q: source.rfind(q) for q in ('"', "'")}
        place = start = 0
        while (place := source.find("<", place)) >= 0:
            following = source[place + 1 : place + 2]
            if following in ("!", "?"):
                self.text_of(source, start, place)
                comment = source.startswith("<!--", place)
                end = source.find("-->" if comment else ">", place + 2)
                place = start = len(source) if end < 0 else end + (3 if comment else 1)
            elif following == "/":
                m = NAME.match(source, place + 2)
                end = source.find(">", place + 2)
                self.text_of(source, start, place)
                if m and end >= 0:
                    self.end_tag(m[0].lower())
                place = start = len(source) if end < 0 else end + 1
            elif m := NAME.match(source, place + 1):
                self.text_of(source, start, place)
                given, end, itself = self.attributes(source, m.end())
                # what begins like a tag at the end of a cut page isn't text
                place = start = len(source) if end < 0 else self.start_tag(m[0].lower(), given, itself, source, end)
            else:
                place += 1
        self.text_of(source, start, len(source))

    def end_tag(self, tag: str) -> None:
        if depth := self.nearest((tag,)):
            self.close(depth)
        elif tag == "p":
            self.add("p", {})

    def start_tag(self, tag: str, given: dict[str, str], itself: bool, source: str, place: int) -> int:
        if tag in ENDS_PARAGRAPH and (depth := self.nearest(("p",), PARAGRAPH_SCOPES)):
            self.close(depth)
        if tag in ENDS_ITS_KIND and (depth := self.nearest(ENDS_ITS_KIND[tag], SCOPES)):
            self.close(depth)
        node = self.add(tag, given)
        if tag in RAW:
            end = RAW[tag].search(source, place)
            self.parts[node].append(source[place : end.start() if end else len(source)])
            return end.end() if end else len(source)
        if tag not in VOID and not itself:
            self.push(node)
        return place

    def sums(self, off: list[bool]) -> tuple[list[int], ...]:
        """Characters, tags, characters in links and link tags of every node, without the parts that are off."""
        n = len(self.parent)
        chars, tags, link_chars, links = ([0] * n for _ in range(4))
        for i in range(n - 1, -1, -1):
            if off[i]:
                chars[i] = tags[i] = link_chars[i] = links[i] = 0
                continue
            chars[i] += sum(len(SPACES.sub(" ", x).strip()) for x in self.parts[i] if isinstance(x, str))
            if self.tag[i] == "a":
                link_chars[i], links[i] = chars[i], links[i] + 1
            if (p := self.parent[i]) >= 0:
                chars[p] += chars[i]
                tags[p] += tags[i] + (self.tag[i] not in INLINE)
                link_chars[p] += link_chars[i]
                links[p] += links[i]
        return chars, tags, link_chars, links

    def taken_off(self) -> list[bool]:
        """The nodes that are off, but for a form, or one marked by its attributes alone, that holds the page's article."""
        plain = self.sums([t in OFF_TAGS for t in self.tag])[0]
        holds = [t in ("article", "main", "h1") for t in self.tag]
        prose = [t == "p" for t in self.tag]
        cluttered = [False] * len(plain)
        for i in range(len(plain) - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
            prose[self.parent[i]] |= prose[i]
            cluttered[self.parent[i]] |= cluttered[i] or ((self.off[i] or self.vague[i]) and i not in self.headers)
        headings = {i for i in self.headers if holds[i] and not cluttered[i] and self.tag[self.parent[i]] not in ("body", "html")}
        pages = {i for i in self.forms if (holds[i] or prose[i]) and 2 * plain[i] > plain[0]}
        return [o and i not in headings and i not in pages and (i in self.forms or self.tag[i] in OFF_TAGS or i in self.headers or not holds[i] or 2 * plain[i] <= plain[0]) for i, o in enumerate(self.off)]

    def densities(self, off: list[bool], body: int, sums: tuple[list[int], ...]) -> list[float]:
        chars, tags, link_chars, links = sums
        density = [0.0] * len(chars)
        for i, c in enumerate(chars):
            if c:
                lc, t, lt = link_chars[i] or 1, tags[i] or 1, links[i] or 1
                inner = c / ((c - link_chars[i]) or 1) * lc + (link_chars[body] or 1) / (chars[body] or 1) * c + e
                density[i] = c / t * log(max(c / lc * t / lt, 1.0)) / log(log(inner) + 1e-9) if inner > e else c / t
        return density

    def text(self) -> str:
        certain = self.taken_off()
        shared = Counter((self.tag[i], self.names[i]) for i in self.topics)
        often = {i for i in self.topics if shared[self.tag[i], self.names[i]] >= SHARED}
        if often:
            opened = [o and i not in often for i, o in enumerate(certain)]
            # a name that most of the page's text carries tells no part of it apart
            if 2 * self.sums(certain)[0][0] < self.sums(opened)[0][0]:
                certain, self.topics = opened, self.topics - often
        off = [o or v for o, v in zip(certain, self.vague)]
        sums = self.sums(off)
        if not sums[0][0]:
            off, sums = certain, self.sums(certain)
        chars, n = sums[0], len(certain)
        if not chars[0]:
            return ""
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        if not chars[body]:
            body = 0
        density = self.densities(off, body, sums)
        total = [0.0] * n
        for i in range(1, n):
            total[self.parent[i]] += density[i]
        inside = [False] * n
        for i in range(body, n):
            inside[i] = i == body or (self.parent[i] >= 0 and inside[self.parent[i]])
        best = max((i for i in range(body, n) if inside[i] and chars[i] and self.tag[i] not in INLINE), key=lambda i: (total[i], self.tag[i] in ("article", "main"), -i), default=body)
        path = [best]
        while path[-1] != body:
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        # within an article or main element on the path, whatever has a density belongs
        least, holder = {}, False
        for i in reversed(path):
            holder = holder or self.tag[i] in ("article", "main")
            least[i] = 0.0 if holder else threshold
        off = self.decided(certain, best, density, body)
        for i in self.threads(off, best):
            off[i] = True
        density = self.densities(off, body, self.sums(off))
        on_path = set(path[1:])
        blocks: list[str] = []
        current: list[str] = []

        def flush() -> None:
            if line := SPACES.sub(" ", "".join(current)).strip():
                blocks.append(line)
            current.clear()

        # depth first without recursion: (node, next part, whether the node's own text counts)
        stack = [(body, 0, body == best)]
        while stack:
            node, k, whole = stack.pop()
            if k == 0 and self.tag[node] in BLOCKS:
                flush()
            for j in range(k, len(self.parts[node])):
                part = self.parts[node][j]
                if isinstance(part, str):
                    if whole or node in on_path:
                        current.append(part)
                elif self.tag[part] == "br":
                    current.append(" ")
                elif not off[part] and (whole or part in on_path or part == best or self.tag[part] == "h1" or (density[part] >= least[node] and density[part] > 0)):
                    stack.append((node, j + 1, whole))
                    stack.append((part, 0, part not in on_path))
                    break
            else:
                if self.tag[node] in BLOCKS:
                    flush()
        flush()
        return "\n".join(blocks)

    def decided(self, certain: list[bool], best: int, density: list[float], body: int) -> list[bool]:
        """The nodes that are off once density has decided on those that their names only nominate: beside the best node they are;
        inside it those below the mean density of the best node's other children are."""
        plain = self.densities(certain, body, self.sums(certain))
        children = [density[i] for i in self.parts[best] if not isinstance(i, str) and density[i] > 0]
        mean = sum(children) / len(children) if children else 0.0
        off, inside = list(certain), [False] * len(certain)
        inside[best] = True
        for i in range(best + 1, len(certain)):
            inside[i] = inside[self.parent[i]]
        for i, v in enumerate(self.vague):
            if v:
                off[i] = off[i] or not inside[i] or i == best or plain[i] < mean
        for i in self.returned(certain, inside, mean, body):
            off[i] = False
        if off[best]:
            off[best] = False
        return off

    def returned(self, certain: list[bool], inside: list[bool], mean: float, body: int) -> list[int]:
        """Parts inside the best node with a topic's name that read like the text beside them: prose of a like density, few links, no
        controls and no part of such a name within."""
        named = [i for i in self.topics if inside[i] and certain[i]]
        if not named:
            return []
        opened = list(certain)
        for i in named:
            opened[i] = False
        sums = self.sums(opened)
        density = self.densities(opened, body, sums)
        spoiled = [t in CONTROLS for t in self.tag]
        for i in range(len(certain) - 1, 0, -1):
            spoiled[self.parent[i]] |= spoiled[i] or i in self.topics or (certain[i] and i not in self.topics)
        chars, link_chars = sums[0], sums[2]
        return [i for i in named if not spoiled[i] and chars[i] >= PROSE and link_chars[i] <= LINKS * chars[i] and density[i] >= ALIKE * mean]

    def threads(self, off: list[bool], best: int) -> list[int]:
        """Nodes that hold readers' comments: two items or more of the same tag and names, or one in a part named so, each with a short line
        of a date, a time or a writer, and more text. The best node and what holds it aren't."""
        n = len(self.parent)
        meta, text = [False] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if off[i]:
                continue
            own = " ".join(x for x in self.parts[i] if isinstance(x, str)).strip()
            text[i] += len(own)
            names = self.names[i].split()
            told = self.tag[i] == "time" or any(names_one(x, WRITER_WORDS) for x in names) or (bool(names) and bool(DATE.search(own)))
            meta[i] |= told and text[i] <= META_LINE
            text[self.parent[i]] += text[i]
            meta[self.parent[i]] |= meta[i]
        above = set()
        i = best
        while i >= 0:
            above.add(i)
            i = self.parent[i]
        found = []
        for i in range(1, n):
            if off[i] or i in above or self.tag[i] in INLINE:
                continue
            kinds: dict[tuple[str, str], int] = defaultdict(int)
            for c in self.parts[i]:
                if not isinstance(c, str) and not off[c] and meta[c] and text[c] and self.tag[c] in BLOCKS and any(not isinstance(x, str) for x in self.parts[c]):
                    kinds[self.tag[c], self.names[c]] += 1
            least = 1 if any(names_one(x, THREAD_WORDS) for x in self.names[i].split()) else 2
            if max(kinds.values(), default=0) >= least:
                found.append(i)
        return found


def main_text(source: str | None) -> str:
    """The article's text: blocks in page order joined by line feeds; empty if there is none."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every page, from its whole html.

    A null or empty html, and a page without main text, give an empty text; null ids and urls and repeated rows stay, row by row; an
    empty table gives no rows; other columns of the input, whatever their names, are not read.
    """
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)
