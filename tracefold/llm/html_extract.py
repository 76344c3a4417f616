"""Main text of web pages by equivalence-class template deduction.

1. Every page is cut into tokens: tags, known by their path of structural elements with class, id and
   role, and words, taken by runs (the text between two tags) with the path they stand in; single words would
   share vectors by chance on hosts of few pages.  For each host and token the number of pages, of occurrences,
   the least and largest count on a page and a commutative fingerprint of the occurrence vector over all the host's pages are summed.
2. Tokens with the same vector form an equivalence class.  A class is valid when it holds a tag, and its tokens occur in at
   least ``support`` of the host's pages and equally often in each of them.  The template is the tags of valid classes and
   those runs, on ``STEADY`` pages at least, that stand inside a tag of their own class, as the page's own elements tell.  Classes nest by path: a run or
   tag belongs into the span of the nearest tag above it.
3. A slot is the text in a tag's span that is not template.  A page's text is that of its blocks with a word in
   a slot, in page order, wherever they are on the page; a block of template runs alone is dropped.
4. What varies from page to page like an article but is none is known by its element or its name: menus, headers, footers,
   sidebars, adverts, forms, comments, scripts and styles.  Inside an article or main element a header is part of it, and
   paragraphs, headings and cells are dropped by the narrower list ``DROPPED_LEAVES`` alone.

A page that has no tag of its template but html and body, on which the template's runs outweigh the slots (as on hosts
of copies of one page), or whose host has no valid class, is
read by its own article elements, else main, else body; a page without tags is one block.  Elements with the same
path share a slot.  A path is held as a digest chained over the elements above, so it is as short at any depth.

Python in Arrow batches: tokenising markup is sequential; pages are parsed once for statistics and once for their text.
Statistics cover all pages; they are summed map-side per (host, token), so a host with a third of all pages is a row per
batch and token; tokens of one page are in no template and are not stored.
Templates (a row per host) are joined to pages by host; the adaptive join broadcasts them by
measured size or splits a hot host.  No page is ever grouped with another.

Defined results: a null or empty page has the empty text.  A page cut off in the middle ends there; a
tag or comment cut off is dropped.  Rows that repeat give equal rows; a null or odd url is the host ''.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, table

#: Elements without content, and elements whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head nav header footer aside form script style title noscript template iframe button select option textarea input svg canvas object menu dialog audio video noembed noframes xmp".split())
#: Elements that a new one of the same kind, or a new block, ends.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav(?:bar|igation)?|menus?|breadcrumbs?|header|masthead|footer|side-?bar|aside|widget|related|recommend(?:ed|ations)?|share|sharing|social|"
    r"comments?|respond|replies|reply|disqus|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|signup|login|search|form|pagination|pager|toolbar|skip(?:-link)?|hidden|contentinfo|complementary|alert|dialog|legal|copyright|tags)(?:$|[\s_-])",
    re.IGNORECASE,
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.IGNORECASE)
NUMBER = re.compile(r"\d+")
DROPPED_LEAVES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|comments?|newsletter|cookies?|consent|gdpr|hidden)(?:$|[\s_-])", re.IGNORECASE)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address".split())
#: Pages that must agree before a text counts as constant over a host.
STEADY = 3


class Element:
    __slots__ = ("name", "path", "up", "dropped", "within")

    def __init__(self, name: str, mark: str, up: Element | None, dropped: bool, within: bool):
        self.name, self.up, self.dropped, self.within = name, up, dropped, within  # within an article or main element
        self.path = path_of(name, mark, up.path if up else "")


def path_of(name: str, mark: str, up: str) -> str:
    """A path as the element's name and a digest of its marks and the path above: of constant length at any depth."""
    return f"{name}:{hashlib.blake2b(f'{up}>{name}{mark}'.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def stands_in(element: Element | None, holds: Callable[[str], bool], known: dict) -> bool:
    """Whether ``holds`` is true of an element's path or of one above it; ``known`` keeps what was found, so each element is asked once."""
    way = []
    while element is not None and element not in known:
        way.append(element)
        if holds(element.path):
            known[element] = True
            break
        element = element.up
    found = element is not None and known[element]
    known.update(dict.fromkeys(way, found))
    return found


def is_dropped(name: str, attributes: dict[str, str], within: bool) -> bool:
    if name in DROPPED and not (within and name == "header") or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if name in ("html", "body", "article", "main") or within and name == "header":
        return False
    names = DROPPED_LEAVES if within and name in LEAVES else DROPPED_NAMES
    return any(names.search(attributes.get(k, "")) for k in ("class", "id", "role"))


def events(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """('open', element, ''), ('block', element, '') at a block's edge, ('text', innermost element, text)."""
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by name
    at, n = 0, len(page)

    def last(names: tuple[str, ...]) -> int:
        return max((places[k][-1] for k in names if places.get(k)), default=-1)

    def close(names: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        i = last(names)
        if i >= 0 and i >= last(barrier):
            for element in stack[i:]:
                places[element.name].pop()
            del stack[i:]

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            yield "text", stack[-1] if stack else None, page[at : m.start()]
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name or not m.group().endswith(">"):
            continue  # a comment or declaration, or a tag that the page's end cuts off
        if m.group(1):
            if name not in INLINE:
                yield "block", None, ""
                close((name,), ("td", "table") if name not in ("table", "tr", "td", "th", "tbody", "thead", "body", "html", "article", "main", "footer", "nav", "aside", "header") else ())
            continue
        if name in INLINE or name == "br":
            if name == "br":
                yield "text", stack[-1] if stack else None, " "
            continue
        yield "block", None, ""
        if name not in VOID and name not in RAW:
            close(("p",), ("div", "article", "section", "td", "li", "body", "button"))
        if name in SELF_CLOSING:
            close(SELF_CLOSING[name], ("ul", "ol", "dl", "table", "select"))
        found = {a.lower(): (b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(m.group(3))}
        mark = "".join("." + ".".join(NUMBER.sub("#", found[k]).split()) for k in ("id", "class", "role") if found.get(k))
        up = stack[-1] if stack else None
        within = bool(up and up.within)
        dropped = bool(up and up.dropped) or is_dropped(name, found, within)
        element = Element(name, mark, up, dropped, within or name in ("article", "main"))
        yield "open", element, ""
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
        elif name not in VOID:
            places[name].append(len(stack))
            stack.append(element)
    if at < n:
        tail = page[at:]
        cut = tail.rfind("<")  # a tag that the page's end cuts off
        if cut >= 0 and re.match(r"<[/!a-zA-Z]", tail[cut:]):
            tail = tail[:cut]
        yield "text", stack[-1] if stack else None, tail


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def kind_of(path: str) -> str:
    return path.partition(":")[0]


def run_token(path: str, text: str) -> str:
    """The token of a run: its element's path and a digest of its words; '' without words."""
    words = " ".join(text.split())
    return f"{path}\n{hashlib.blake2b(words.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}" if words else ""


def statistics(page: str) -> dict[str, int]:
    """Occurrences of each token on the page; dropped elements and their text are not counted."""
    out: dict[str, int] = defaultdict(int)
    for kind, element, text in events(page):
        if element is None or element.dropped:
            continue
        if kind == "open":
            out[element.path] += 1
        elif kind == "text" and (token := run_token(element.path, text)):
            out[token] += 1
    return out


def blocks_of(every: list, keep) -> list[list[tuple[Element | None, str]]]:
    """Runs of each block; a text that ``keep`` leaves out ends its block."""
    blocks: list[list[tuple[Element | None, str]]] = [[]]
    for kind, element, text in every:
        if kind == "text" and keep(element):
            blocks[-1].append((element, text))
        elif blocks[-1]:
            blocks.append([])
    return blocks


def main_text(page: str | None, template: tuple[dict[str, int], dict[str, int]] | None) -> str:
    """Text of the blocks in the slots of ``template`` (see ``deduce``), or of the page's own main elements."""
    if not page:
        return ""
    every = list(events(page))
    paths = dict.fromkeys(e.path for kind, e, _ in every if kind == "open" and not e.dropped)
    if template and any(p in template[0] and kind_of(p) not in ("html", "body") for p in paths):
        tags, runs = template
        slots, length, inside = [], 0, defaultdict(dict)

        def fixed(element: Element | None, text: str) -> bool:
            """Whether a run is template: it is in a class, and stands inside a tag of that class."""
            c = runs.get(run_token(element.path, text)) if element is not None else None
            return c is not None and stands_in(element, lambda p: tags.get(p) == c, inside[c])

        for block in blocks_of(every, lambda e: e is None or not e.dropped):
            text = clean([t for _, t in block])
            if text and all(fixed(e, t) for e, t in block if t.strip()):
                length += len(text)
            elif text:
                slots.append(text)
        if sum(map(len, slots)) > length:
            return "\n".join(slots)
    own = next((found for name in ("article", "main", "body") if (found := {p for p in paths if kind_of(p) == name})), None)
    verdicts: dict[Element, bool] = {}

    def mine(element: Element | None) -> bool:
        if own is None or element is None:
            return own is None and (element is None or not element.dropped)
        return not element.dropped and stands_in(element, own.__contains__, verdicts)

    return "\n".join(filter(None, (clean([t for _, t in block]) for block in blocks_of(every, mine))))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def deduce(tokens: list[dict], pages: int, support: float) -> tuple[dict[str, int], dict[str, int]] | None:
    """A host's template from its tokens (token, pages, total, vector, least, most): its tags and its runs, each with its class.

    A run is template only inside a tag of its own class; whether it is, a page's own elements tell.
    """
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in tokens:
        classes[(t["pages"], t["total"], t["vector"])].append(t)
    tags: dict[str, int] = {}
    runs: dict[str, int] = {}
    for number, key in enumerate(sorted(classes)):
        c, n = classes[key], key[0]
        own = [t["token"] for t in c if "\n" not in t["token"]]
        # valid: enough pages and equally often in each of them
        if not own or n < support * pages or any(t["least"] != t["most"] for t in c):
            continue
        tags.update(dict.fromkeys(own, number))
        if n >= STEADY:
            runs.update((t["token"], number) for t in c if "\n" in t["token"])
    return (tags, runs) if tags else None


def templates(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """host, tags, runs: each host's template (see ``deduce``).  pages: host, page_key, html."""
    fields = ("pages", "total", "vector", "least", "most")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for host, key, page in zip(b["host"], b["page_key"], b["html"]):
                sums.setdefault((host, ""), [0] * 5)[0] += 1
                seeds: dict[int, int] = {}
                for token, n in statistics(page or "").items():
                    if n not in seeds:
                        seeds[n] = int.from_bytes(hashlib.blake2b(b"%d:%d" % (key, n), digest_size=6).digest(), "big")
                    s = sums.get((host, token))
                    if s is None:
                        sums[host, token] = [1, n, seeds[n], n, n]
                    else:
                        sums[host, token] = [s[0] + 1, s[1] + n, s[2] + seeds[n], min(s[3], n), max(s[4], n)]
            if sums:
                yield pd.DataFrame([(h, t, *s) for (h, t), s in sums.items()], columns=["host", "token", *fields])

    counted = pages.mapInPandas(run, "host string, token string, " + ", ".join(f"{c} long" for c in fields))
    summed = counted.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum(F.col("vector").cast("decimal(38,0)")).cast("string").alias("vector"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    summed = materialise(summed.where("pages > 1 or token = ''"), "tokens")  # what is on one page is in no template
    # rare tokens are in no template: only those that could reach the support are gathered per host, so few
    size = summed.where("token = ''").select("host", F.col("pages").alias("of"))
    near = summed.where("token <> ''").join(size, "host").where(F.col("pages") >= support * F.col("of"))
    listed = near.groupBy("host").agg(F.max("of").alias("of"), F.collect_list(F.struct("token", *fields)).alias("tokens"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [deduce([dict(t) if isinstance(t, dict) else t.asDict() for t in ts], n, support) or (None, None) for ts, n in zip(b["tokens"], b["of"])]
            yield pd.DataFrame({"host": b["host"], "tags": [f[0] for f in found], "runs": [f[1] for f in found]})

    out = materialise(listed.mapInPandas(judge, "host string, tags map<string, int>, runs map<string, int>"), "templates")
    forget(summed)
    return out


def extract(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text."""
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("page_key"))
    found = templates(keyed.select("host", "page_key", "html"), support)
    joined = keyed.drop("page_key").join(found.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, None if tags is None else (dict(tags), dict(runs))) for h, tags, runs in zip(b["html"], b["tags"], b["runs"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "tags", "runs").mapInPandas(run, f"page_id {kind}, url string, text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``pages``: page_id, url, text, n_chars (see the module's text)."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
