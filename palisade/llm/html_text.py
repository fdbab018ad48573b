"""Main text of web pages by consensus host paths.

1. A page is read by the tokenizer rules of HTML into blocks of text, each with the path of its containers (tags and
   classes, digits generalised). Inline tags and paragraphs are no containers, so unclosed ones don't harm the paths.
2. Every container of a page is scored by the prose that it holds; nested prose counts for less with each level, links
   and boilerplate not at all. The page votes for its containers' paths, and says what text stood in them.
3. Spark adds the votes by host and path, and finds how often the same text stood under a path on pages that differ:
   such a path counts for little. Each host's best path wins (ties: the smaller path).
4. Every page is read again. Its containers of the winning path are widened to the outermost container around them that
   is an article or has prose of its own on that page, and give their blocks if they hold most of the page's prose. Else
   the page's own best container, widened until it does hold most, gives its blocks beside theirs.

Boilerplate are navigation, asides, footers, forms and other elements by their tags; paths that repeat one text on a
host's pages (and don't lead to its winner); and containers whose class, id or role consists of words for boilerplate
only, ``cookie-notice`` say. That last is a guess which a host's pages overrule: where such containers hold most of the
host's prose, they are its text.

Winners are broadcast only while there are at most ``BROADCAST_HOSTS`` hosts, with paths of ``BROADCAST_CHARS`` characters
in all; beyond, those of hosts with more than ``LARGE_HOST`` pages are, and the others are joined by host, so that no
task gets a large host's pages. Containers deeper than ``DEPTH`` are none of their own, so paths are bounded.
Null html has the empty text. A null url, or one without ``://``, has the host ''. Rows are extracted each by itself,
so repeated rows get equal results (and vote as often as they stand); an empty table gives no rows. Long pages are read
whole, in time proportional to their length. Only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialise, small_batches, text_slices
from palisade.llm.url_rules import split_url

BROADCAST_HOSTS, BROADCAST_CHARS, LARGE_HOST = 50_000, 1 << 26, 10_000
#: Containers that stand in one another; what is deeper belongs to the innermost of them. Characters of a step's classes.
DEPTH, STEP_CHARS = 64, 64
#: A path repeats a text if so large a part of its pages, which are so many at least and so large a part of the host's,
#: have that text; and how much repetition takes from a path's votes.
REPEATED, REPEATED_PAGES, REPEATED_PART, REPEATED_COST = 0.8, 5, 0.1, 0.9

# HTML element names and boilerplate words.
CONTAINERS = frozenset("html body main article section div aside nav header footer form menu table tbody thead tr td th ul ol dl figure fieldset details dialog center blockquote".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr figcaption caption summary address option legend title head".split()) | CONTAINERS
RAW = frozenset("script style xmp noembed noframes".split())
SILENT = frozenset("noscript template svg math iframe object canvas audio video select textarea button".split())
IN_HEAD = frozenset("html head title meta link base basefont bgsound".split())
PARTS = frozenset("ul ol dl blockquote figure".split())  # never a whole article
BOILER_TAGS = frozenset("nav aside footer form dialog menu".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alerts announcement aside banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright disclaimer discussion disqus footer form header hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing side sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar topbar trending widget".split()
)
# Words that say nothing beside those; the second half are of articles, whose headers stay.
PLAIN_WORDS = frozenset(
    "area bar block bottom box button col column container content email for global group inner item items label left link links list main of page policy "
    "primary privacy reader readers right row secondary section site slot text the top unit user wrap wrapper".split()
)
ARTICLE_WORDS = frozenset("article articles entry news post posts stories story".split())

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# A tag's rest in its usual form; it can't run past the next tag, so a failure costs no more than what is read anyway.
USUAL = re.compile(r"""((?:\s+[a-zA-Z][\w:-]*(?:="[^"<>]*"|='[^'<>]*'|=[^\s"'=<>`]+)?)*)\s*(/?)>""")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)")
GAP, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
NAMED = re.compile(r"""\s([a-zA-Z][\w:-]*)=(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in (*RAW, *SILENT, "title")}
# These don't stand in their like: a second start tag shows that the first has no end tag.
CLOSE_OR_OPEN = {t: re.compile(rf"</{t}\s*>|(?P<open><{t}(?=[\s/>]))", re.I) for t in ("canvas", "audio", "video", "select", "button")}
# Tags that end a drawing or formula without an end tag, unless they stand in the elements for text in it.
FLOW = frozenset("article blockquote body center div dl h1 h2 h3 h4 h5 h6 hr li main nav ol p pre section table ul".split())
FOREIGN = re.compile(rf"</(?:svg|math)\s*>|<(?:foreignobject|desc|annotation-xml|m[inos]|mtext)(?=[\s/>])|(?P<flow><(?:{'|'.join(sorted(FLOW))})(?=[\s/>]))", re.I)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Tag(NamedTuple):
    start: int
    end: int
    name: str  # lower case; empty for comments, declarations and the like
    close: bool
    closed: bool  # ends with />
    named: dict[str, str]  # class, id and role


class Tags:
    """Reads a page's tags one after the other; what has no end in the page is searched for once, not for each tag."""

    def __init__(self, source: str):
        self.source, self.gone = source, set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` stands next; -1 if nowhere."""
        if what in self.gone:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def next(self, at: int) -> Tag | None:
        source = self.source
        while (at := source.find("<", at)) >= 0:
            mark = source[at + 1 : at + 2]
            if mark in ("!", "?") or mark == "/" and not TAG_NAME.match(source, at + 2):
                dashes = source.startswith("<!--", at)
                end = self.find("-->", at + 2) if dashes else self.find(">", at + 1)
                return Tag(at, len(source) if end < 0 else end + (3 if dashes else 1), "", False, False, {})
            close = mark == "/"
            if name := TAG_NAME.match(source, at + 1 + close):
                end, closed, named = self.rest(name.end())
                return Tag(at, end, name[0].lower(), close, closed, named)
            at += 1
        return None

    def rest(self, at: int) -> tuple[int, bool, dict[str, str]]:
        """End of the tag whose name ends at ``at``, whether it closes itself, and its names. A quote begins a quoted value
        only after an equals sign, and only if the page has another of its kind."""
        source, named = self.source, {}
        if usual := USUAL.match(source, at):
            if usual[1]:
                for key, *values in NAMED.findall(usual[1]):
                    if (key := key.lower()) in ("class", "id", "role"):
                        named.setdefault(key, "".join(values))
            return usual.end(), bool(usual[2]), named
        while name := ATTRIBUTE.match(source, at):
            at = name.end()
            if equals := EQUALS.match(source, at):
                at = equals.end()
                quote = source[at : at + 1]
                end = self.find(quote, at + 1) if quote and quote in "\"'" else -1
                value, at = (source[at + 1 : end], end + 1) if end >= 0 else ((bare := BARE.match(source, at))[0], bare.end())
                if (key := name[1].lower()) in ("class", "id", "role"):
                    named.setdefault(key, value)
        at = GAP.match(source, at).end()
        return min(at + 1, len(source)), source[at - 1 : at] == "/", named

    def silence_end(self, tag: Tag) -> int:
        """Where a silent element ends: with its own start tag if it has no end tag."""
        at = tag.end
        if tag.name in ("svg", "math"):
            if tag.closed:
                return at
            first = FOREIGN.search(self.source, at) if "foreign" not in self.gone else None
            if not first:
                self.gone.add("foreign")
                return at
            if first["flow"]:
                return first.start()
        end = self.closing(tag.name, at, CLOSE_OR_OPEN.get(tag.name, CLOSE[tag.name]))
        if not end:
            return at
        return at if end.groupdict().get("open") else end.end()

    def closing(self, name: str, at: int, pattern: re.Pattern) -> re.Match | None:
        end = pattern.search(self.source, at) if f"/{name}" not in self.gone else None
        if not end:
            self.gone.add(f"/{name}")
        return end

    def head_ends(self, at: int) -> bool:
        """Whether the head that is open at ``at`` has an end tag, or a body after it."""
        while tag := self.next(at):
            at = tag.end
            if tag.name in RAW and not tag.close:
                end = self.closing(tag.name, at, CLOSE[tag.name])
                at = end.end() if end else len(self.source)
            elif tag.name == "body" or tag.name == "head" and tag.close:
                return True
            elif tag.name in ("head", "html"):
                return False
        return False


@dataclass
class Container:
    step: str
    parent: int
    boiler: bool  # by its tag, or one around it
    guessed: bool  # by its names
    blocks: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Containers in order of their opening, and blocks as (container, text, characters inside links)."""

    containers: list[Container]
    blocks: list[tuple[int, str, int]]

    @cached_property
    def paths(self) -> list[str]:
        out: list[str] = []
        for c in self.containers:
            out.append(c.step if c.parent < 0 else f"{out[c.parent]}>{c.step}")
        return out

    def boilers(self, guesses: bool = True, trusted: frozenset[str] = frozenset(), repeated: frozenset[str] = frozenset()) -> list[bool]:
        """Which containers are boilerplate. ``guesses``: believe names, except under the paths ``trusted``."""
        out: list[bool] = []
        for c, path in zip(self.containers, self.paths):
            out.append(c.parent >= 0 and out[c.parent] or c.boiler or guesses and c.guessed and path not in trusted or path in repeated)
        return out


def is_guessed(names: str, inside_article: bool = False) -> bool:
    """Whether any name says boilerplate and nothing else. The header of an article is none."""
    for name in names.split():
        words = {w.lower() for w in WORD.findall(name)}
        telling = words & BOILER_WORDS - ({"header"} if inside_article or words & ARTICLE_WORDS else set())
        if telling and words <= BOILER_WORDS | PLAIN_WORDS | ARTICLE_WORDS:
            return True
    return False


def step_of(tag: Tag) -> str:
    """A tag with its classes, digits generalised; of long ones, a hash of them."""
    classes = ".".join(sorted({DIGITS.sub("#", c) for c in tag.named.get("class", "").split()}))
    if len(classes) > STEP_CHARS:
        classes = f"~{xxhash.xxh64_hexdigest(classes)}"
    return f"{tag.name}.{classes}" if classes else tag.name


def read_page(source: str) -> Page:
    containers, blocks = [Container("", -1, False, False)], []
    stack = [(0, "", False)]  # container, tag, whether it is an article or in one
    deeper: Counter[str] = Counter()  # open tags past DEPTH
    held: list[tuple[str, bool]] = []
    links, block = 0, 0  # block: the container of a block of its own, 0 for the innermost open one

    def close_block() -> None:
        nonlocal held, block
        if held:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in held))).strip()
            if text:
                linked, own = sum(len(t.strip()) for t, in_link in held if in_link), block or stack[-1][0]
                containers[own].blocks.append(len(blocks))
                blocks.append((own, text, min(linked, len(text))))
            held = []
        block = 0

    # 1: in a head that has an end; 2: in one that has none, which ends with the first thing that belongs to a body
    tags, at, head = Tags(source), 0, 0
    while m := tags.next(at):
        if m.start > at and (not head or head == 2 and source[at : m.start].strip()):
            head = 0
            held.append((source[at : m.start], links > 0))
        at, tag = m.end, m.name
        if not tag:
            continue
        if not m.close and tag in RAW:
            end = tags.closing(tag, at, CLOSE[tag])
            at = end.end() if end else len(source)
            continue
        if not m.close and tag in SILENT:
            head = head if head < 2 or tag in ("noscript", "template") else 0
            at = tags.silence_end(m)
            continue
        if tag == "head":
            close_block()
            head = 0 if m.close else 1 + (not tags.head_ends(at))
        elif head and not m.close:
            if tag == "title" and (end := tags.closing(tag, at, CLOSE[tag])):
                at = end.end()
            if tag in FLOW or head == 2 and tag not in IN_HEAD:
                head = 0
        if head:
            continue
        if tag == "a":
            links = 0 if m.close else 1
        elif tag == "br":
            held.append((" ", False))
        elif tag in BREAKS:
            close_block()
        inside = stack[-1][2]
        names = " ".join(m.named.values())
        if tag not in CONTAINERS:
            # a paragraph or the like with a telling name is a container of its block
            if names and tag in BREAKS and not m.close and is_guessed(names, inside):
                containers.append(Container(step_of(m), stack[-1][0], False, True))
                block = len(containers) - 1
            continue
        links = 0
        if m.close:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] == tag), 0)
            if deeper[tag]:
                deeper[tag] -= 1
            elif depth:
                del stack[depth:]
                deeper.clear()
        elif not m.closed and len(stack) > DEPTH:
            deeper[tag] += 1
        elif not m.closed:
            boiler = tag in BOILER_TAGS or tag == "header" and not inside
            guessed = bool(names) and tag not in ("html", "body") and is_guessed(names, inside)
            containers.append(Container(step_of(m), stack[-1][0], boiler, guessed))
            stack.append((len(containers) - 1, tag, inside or tag in ("article", "main")))
    if at < len(source) and head != 1:
        held.append((source[at:], links > 0))
    close_block()
    return Page(containers, blocks)


def scores(page: Page, boilers: list[bool]) -> list[float]:
    """Prose of each container: its own blocks whole, those of the containers in it halved with each level."""
    out = [0.0] * len(page.containers)
    for at in range(len(page.containers) - 1, -1, -1):
        c = page.containers[at]
        if boilers[at]:
            out[at] = 0.0
            continue
        out[at] += sum(len(text) - 2 * linked for _, text, linked in map(page.blocks.__getitem__, c.blocks))
        if c.step.split(".")[0] in ("article", "main"):
            out[at] *= 1.5
        if c.parent >= 0 and out[at] > 0:
            out[c.parent] += out[at] / 2
    return out


def own_prose(page: Page, boilers: list[bool]) -> list[int]:
    """Characters of prose outside links that stand directly in each container, none in boilerplate."""
    out = [0] * len(page.containers)
    for own, text, linked in page.blocks:
        if not boilers[own]:
            out[own] += max(0, len(text) - 2 * linked)
    return out


def widened(page: Page, prose: list[int], at: int) -> int:
    """The outermost container around ``at`` that is an article or has prose of its own; lists and quotes give way to
    what they stand in."""
    tag = lambda i: page.containers[i].step.split(".")[0]
    while tag(at) in PARTS:
        at = page.containers[at].parent
    up = at
    while (up := page.containers[up].parent) >= 0:
        if prose[up] > 0 or tag(up) == "article":
            at = up
    return at


def below(page: Page, boilers: list[bool], roots: list[int]) -> list[bool]:
    """Which containers are any of ``roots`` or stand in one, boilerplate left out."""
    keep = [False] * len(page.containers)
    for i in roots:
        keep[i] = True
    for i, c in enumerate(page.containers):
        if c.parent >= 0 and keep[c.parent]:
            keep[i] = True
        if boilers[i]:
            keep[i] = False
    return keep


class Vote(NamedTuple):
    """What one page, or several, say of a path: its votes with and without guesses, its own prose, the prose in and
    under it (where it is guessed to be boilerplate), and pages."""

    weight: int
    unguessed: int
    prose: int
    beneath: int
    pages: int


def votes_of(source: str | None) -> dict[str, tuple[int, int, Vote]]:
    """Path to (hash of the text in it, hash of all the page's text, vote), of paths with text outside boilerplate tags
    or votes."""
    if not source:
        return {}
    page = read_page(source)
    paths, plain = page.paths, page.boilers(guesses=False)
    prose = own_prose(page, plain)
    beneath = list(prose)
    for i in range(len(paths) - 1, 0, -1):
        beneath[page.containers[i].parent] += beneath[i]
    texts: dict[str, list[str]] = defaultdict(list)
    for own, text, _ in page.blocks:
        if not plain[own]:
            texts[paths[own]].append(text)
    weight, unguessed = defaultdict(float), defaultdict(float)
    own_text, under = defaultdict(int), defaultdict(int)
    for i, (path, a, b) in enumerate(zip(paths, scores(page, page.boilers()), scores(page, plain))):
        weight[path] += a
        unguessed[path] += b
        own_text[path] += prose[i]
        under[path] += beneath[i] if page.containers[i].guessed else 0
    a, b = (max(x.values()) or 1 for x in (weight, unguessed))
    whole = xxhash.xxh64_intdigest("\n".join(t for _, t, _ in page.blocks)) >> 1
    part = lambda s, best: max(0, round(1000 * s / best))
    return {
        p: (xxhash.xxh64_intdigest("\n".join(texts[p])) >> 1, whole, Vote(part(weight[p], a), part(unguessed[p], b), own_text[p], under[p], 1))
        for p in dict.fromkeys(paths)
        if texts[p] or weight[p] > 0 or under[p] > 0
    }


def text_of(source: str | None, path: str | None, trusted: list[str] | None = None, repeated: list[str] | None = None) -> tuple[str, bool]:
    """Main text, and whether it is what the host's path gives."""
    if not source:
        return "", False
    page = read_page(source)
    paths = page.paths
    # what leads to the winner is no boilerplate
    again = frozenset(p for p in repeated or () if path is None or path != p and not path.startswith(f"{p}>"))
    boilers = page.boilers(trusted=frozenset(trusted or ()), repeated=again)
    prose = own_prose(page, boilers)

    def most(keep: list[bool]) -> bool:
        return 2 * sum(p for p, k in zip(prose, keep) if k) > sum(prose) or not any(prose)

    def text(keep: list[bool]) -> str:
        return " ".join(text for own, text, _ in page.blocks if keep[own])

    roots = [widened(page, prose, i) for i, p in enumerate(paths) if p == path and not boilers[i]]
    if roots and most(keep := below(page, boilers, roots)) and (found := text(keep)):
        return found, True
    value = scores(page, boilers)
    at = widened(page, prose, max(range(len(value)), key=value.__getitem__))
    while at and not most(below(page, boilers, [at])):
        at = page.containers[at].parent
    return text(below(page, boilers, [*roots, at])), False


VOTES = "host string, path string, text long, low long, high long, weight long, unguessed long, prose long, beneath long, pages long"


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel over rows (url, html): votes by host, path and text, with the least and largest hash of their pages."""
    for batch in batches:
        for part in text_slices(batch, "html"):
            total: dict[tuple[str, str, int], list[int]] = {}
            for url, source in zip(*(c.to_pylist() for c in part.columns)):
                host = split_url(url)[0]
                for path, (text, page, own) in votes_of(source).items():
                    if (key := (host, path, text)) in total:
                        now = total[key]
                        total[key] = [min(now[0], page), max(now[1], page), *(x + y for x, y in zip(now[2:], own))]
                    else:
                        total[key] = [page, page, *own]
            columns = [*zip(*total)] or [()] * 3, [*zip(*total.values())] or [()] * 7
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns[0], *columns[1]], kinds)], names=[c.split()[0] for c in VOTES.split(", ")])


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "html"):
            found = [text_of(*row) for row in zip(*(part.column(c).to_pylist() for c in ("html", "path", "trusted", "repeated")))]
            texts = pa.array([t for t, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), texts, pa.array([len(t) for t, _ in found], pa.int64()), pa.array([c for _, c in found], pa.bool_())],
                names=["page_id", "url", "text", "n_chars", "by_consensus"],
            )


def host_paths(df: DataFrame) -> DataFrame:
    """(host, path, trusted, repeated, pages): the winning path of every host with a vote, the paths that are no
    boilerplate whatever their names say, and the paths that repeat a text."""
    votes = df.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(vote, VOTES)
    summed = ("weight", "unguessed", "prose", "beneath", "pages")
    texts = votes.groupBy("host", "path", "text").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in summed))
    # copies of one page don't make its text a repeated one
    seen = F.when(F.col("low") == F.col("high"), 1).otherwise(F.col("pages"))
    paths = texts.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in summed), (F.max(seen) / F.sum(seen)).alias("same"))
    paths = materialise(paths.withColumn("same", F.when(F.col("pages") >= REPEATED_PAGES, F.col("same")).otherwise(0.0)), "paths")
    hosts = paths.groupBy("host").agg(F.sum("prose").alias("all_prose"), F.max("pages").alias("all_pages"))
    paths = paths.join(hosts, "host")
    main = F.col("beneath") * 2 > F.col("all_prose")
    trusted = paths.filter(main).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("trusted"))
    paths = paths.join(trusted, "host", "left")
    score = F.when(F.col("trusted").isNull(), F.col("weight")).otherwise(F.col("unguessed")) * (1 - REPEATED_COST * F.col("same"))
    again = (F.col("same") >= REPEATED) & (F.col("pages") >= REPEATED_PART * F.col("all_pages"))
    return paths.groupBy("host").agg(
        F.min_by(F.when(score > 0, F.col("path")), F.struct(-score, "path")).alias("path"),
        F.first("trusted").alias("trusted"),
        F.sort_array(F.collect_list(F.when(again, F.col("path")))).alias("repeated"),
        F.first("all_pages").alias("pages"),
    )


def main_text(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and by_consensus of every row (page_id, url, html) of ``df``."""
    small_batches(df.sparkSession)
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = materialise(host_paths(pages), "host-paths")
    at = F.instr("url", "://")
    after = F.regexp_extract(F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(""), r"\A[^/?#]*", 0)
    host = F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pages = pages.withColumn("host", host)
    chars = F.length(F.concat_ws("", F.array("path"), "trusted", "repeated")).cast("long")
    hosts, size = winners.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and size <= BROADCAST_CHARS:
        joined = pages.join(F.broadcast(winners), "host", "left")
    else:
        # one large host for each LARGE_HOST pages at most
        large = winners.filter(F.col("pages") > LARGE_HOST)
        others = pages.join(F.broadcast(large.select("host")), "host", "left_anti").join(winners, "host", "left")
        joined = pages.join(F.broadcast(large), "host").unionByName(others)
    return joined.select("page_id", "url", "html", "path", "trusted", "repeated").mapInArrow(extract, "page_id long, url string, text string, n_chars long, by_consensus boolean")
