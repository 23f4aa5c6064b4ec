r"""Main text of web pages by template deduction over equivalence classes.

Pages of one host are made from one template.  A page is a sequence of tokens:
an element, known by its path (tags and class / id / role names from the root, digits
masked), or a text block at a path.  The occurrence vector of a token has its
count on every page of the host.

1. *Vectors.*  Per (host, token): the number of pages that have it and two
   sums over those pages of a hash of (page, count).  Equal sums mean equal
   vectors; sums merge, so partial results merge in the scan tasks.
2. *Classes.*  Tokens of a host with one vector are a class.  A class counts if
   it has at least ``min_tokens`` elements and occurs on ``min_share`` of the
   host's pages.  A text block belongs to the template only if it is on
   ``text_share`` of the pages, on ``text_pages`` pages at least, and not all of
   them are copies of one page.
3. *Template.*  A class is nested in the class of its parents: an element is a
   template element if its whole path to the root is.  The deepest template
   element above a text block names its slot.
4. *Slots.*  Over all pages of the host, a slot whose text is more than
   ``link_share`` links is a menu.  If the host has slots inside an article
   (by tag, role or name) outside menus and boilerplate elements, these are
   its main slots; otherwise all others are.  Elements that are boilerplate by
   tag or by name (navigation, footers, adverts, forms, comments, ...) are
   never main text, whatever their slot.
5. *Extraction.*  Blocks in main slots, in page order.  A page without any main
   slot of its host gives its blocks that are neither menu nor boilerplate.

White space is what ``str.split`` splits at; a block ends at every element that is
not an inline one; ``<br>`` is white space.

Only token counts are shuffled: per host and token, aggregated before.  Pages are
read three times and joined to one row per host: broadcast below the session's
size threshold, by skew-split shuffle above it.  A host's row is bounded by page
size (the classes of a host hold at most page tokens / ``min_share`` elements).

Edge cases: NULL and empty pages have empty text; a NULL or relative URL belongs
to the host without a name; a host with one page has a template of that page;
repeated rows are extracted alike; an empty table gives no rows; unclosed
elements and comments end as browsers end them; columns named like the
results are replaced, all other columns but the page itself are kept.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, extended, map_arrow, store

# --- fixed values: element names of HTML, and names that mark page parts ------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark
    q rp rt ruby s samp small span strike strong sub sup time tt u var wbr""".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul""".split())
#: an element ends an open one of these names, looking no further up than the second list
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "a": (("a",), ("table",)),
}
BOILER_TAGS = frozenset("""head nav footer aside form script style noscript template iframe svg button select option
    textarea menu dialog object canvas audio video title""".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
BOILER_NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer header masthead cookie cookies consent
    gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing
    social related recommended pagination pager widget toolbar disqus copyright legal form""".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
#: with one of these a name is of a container, not of the part itself
CONTAINER_NAMES = frozenset("article content main with has no page wrapper layout container post entry".split())
MAIN_NAMES = frozenset("article content main post entry story".split())
HEADER_NAMES = frozenset("header masthead banner".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+)|(<)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|href)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z0-9]+")
MASK = (1 << 32) - 1


@dataclass(frozen=True)
class TemplateOptions:
    min_tokens: int = 2
    min_share: float = 0.05
    text_share: float = 0.9
    text_pages: int = 10
    link_share: float = 0.5


def digest(*parts) -> int:
    """Signed 64-bit hash of texts and numbers."""
    joined = "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True)


class Node:
    """An element path: its id and what its names say."""

    __slots__ = ("id", "tag", "boiler", "main", "link")

    def __init__(self, id_: int, tag: str, boiler: bool, main: bool, link: bool):
        self.id, self.tag, self.boiler, self.main, self.link = id_, tag, boiler, main, link


ROOT = Node(0, "", False, False, False)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)}


def _child(parent: Node, tag: str, raw: str) -> Node:
    found = _attributes(raw) if raw.strip() else {}
    role = found.get("role", "").lower()
    spelled = f"{found.get('class', '')} {found.get('id', '')}"
    # camelCase and separators split names; digits are of the page
    names = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", spelled).lower()))
    shown = re.sub(r"\d+", "0", " ".join(sorted(names)))
    main = parent.main or tag in ("article", "main") or role in ("main", "article")
    hidden = ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
              or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None)
    named = False
    if tag not in ("html", "body"):
        named = bool(names & COMMENT_NAMES) and not names & {"no", "with", "has"}
        if tag not in ("article", "main") and not names & CONTAINER_NAMES:
            named = named or bool(names & (BOILER_NAMES - HEADER_NAMES if parent.main else BOILER_NAMES))
        if tag in ("div", "section", "td") and names & MAIN_NAMES and not named:
            main = True
    boiler = (parent.boiler or hidden or named or tag in BOILER_TAGS or role in BOILER_ROLES
              or (tag == "header" and not parent.main))
    return Node(digest(parent.id, tag, shown, role), tag, boiler, main, parent.link or (tag == "a" and "href" in found))


_NODES: dict[tuple[int, bool, str, str], Node] = {}


def child(parent: Node, tag: str, raw: str) -> Node:
    """The path one element further; known ones are kept (memory only)."""
    key = (parent.id, parent.main, tag, raw if "=" in raw and tag != "a" else "href" if "href" in raw else "")
    node = _NODES.get(key)
    if node is None:
        if len(_NODES) > 100_000:
            _NODES.clear()
        node = _NODES[key] = _child(parent, tag, raw)
    return node


def parse(page: str, template: frozenset | set = frozenset()):
    """(elements, blocks) of a page in order.  elements: path of each element;
    blocks: (path, slot, text, characters inside links)."""
    elements: list[Node] = []
    blocks: list[tuple[Node, int, str, int]] = []
    stack, slots = [ROOT], [0]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    place: list = [ROOT, 0, 0]          # path, slot and link characters of the open block
    at, end = 0, len(page)

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((place[0], place[1], text, place[2]))
            parts.clear()
        place[2] = 0

    def pop_to(depth: int):
        broke = False
        while len(stack) > depth:
            gone = stack.pop()
            slots.pop()
            open_tags[gone.tag] -= 1
            broke = broke or gone.tag not in INLINE or gone.boiler != stack[-1].boiler
        if broke:
            flush()

    def close(names, stop=()) -> None:
        if not any(open_tags.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].tag
            if tag in names:
                pop_to(depth)
                return
            if tag in stop:
                return

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m[7] or m[8]
        if text is not None:
            if not parts:
                if text.isspace():
                    continue
                # the nearest element that is not an inline one holds the block
                depth = len(stack) - 1
                while depth and stack[depth].tag in INLINE and stack[depth].boiler == stack[depth - 1].boiler:
                    depth -= 1
                place[0], place[1] = stack[depth], slots[depth]
            if "&" in text:
                text = _html.unescape(text)
            parts.append(text)
            if stack[-1].link:
                place[2] += len(text)
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue                     # comment or declaration
        tag, raw = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag == "br" or tag == "p" and not open_tags.get("p"):
                continue
            close((tag,))
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object"))
            # formatting that was left open does not hold blocks
            depth = len(stack)
            while depth > 1 and stack[depth - 1].tag in INLINE and not stack[depth - 1].link:
                depth -= 1
            pop_to(depth)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = child(stack[-1], tag, raw)
        if tag not in INLINE or node.boiler != stack[-1].boiler:
            flush()
        elements.append(node)
        slot = node.id if slots[-1] == stack[-1].id and node.id in template else slots[-1]
        if tag in RAW:
            shut = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if tag in VOID or raw.endswith("/") and tag not in CLOSES_P and tag not in INLINE:
            continue
        stack.append(node)
        slots.append(slot)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return elements, blocks


# ---------------------------------------------------------------------------
# template
# ---------------------------------------------------------------------------
ELEMENT, TEXT, PAGE = 0, 1, 2


def _page_tokens(page: str) -> dict[tuple[int, int], int]:
    elements, blocks = parse(page)
    counts: dict[tuple[int, int], int] = {}
    for node in elements:
        counts[ELEMENT, node.id] = counts.get((ELEMENT, node.id), 0) + 1
    for node, _, text, _ in blocks:
        token = (TEXT, digest(node.id, text))
        counts[token] = counts.get(token, 0) + 1
    counts[PAGE, 0] = 1
    return counts


def vectors(pages: DataFrame) -> DataFrame:
    """(host, kind, token, n_pages, low, high, least, most) of pages (host, html):
    the occurrence vector of every token as two sums, and the smallest and
    largest content hash of its pages."""
    def run(batches):
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for host, page in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "html"))):
                page = page or ""
                content = digest(page)
                for token, count in _page_tokens(page).items():
                    mixed = digest(content, count) & (1 << 64) - 1
                    row = found.get((host, *token))
                    if row is None:
                        found[host, *token] = [1, mixed & MASK, mixed >> 32, content, content]
                    else:
                        row[0] += 1
                        row[1] += mixed & MASK
                        row[2] += mixed >> 32
                        row[3], row[4] = min(row[3], content), max(row[4], content)
            if found:
                rows = [(*k, *v) for k, v in found.items()]
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)],
                    ["host", "kind", "token", "n_pages", "low", "high", "least", "most"])

    emitted = map_arrow(pages, run, "host string, kind int, token long, n_pages long, low long, high long, least long, most long")
    return emitted.groupBy("host", "kind", "token").agg(
        *[F.sum(c).alias(c) for c in ("n_pages", "low", "high")], F.min("least").alias("least"), F.max("most").alias("most"))


def templates(vectors_: DataFrame, opt: TemplateOptions = TemplateOptions()) -> DataFrame:
    """(host, elements, texts): the tokens of the valid classes of each host."""
    hosts = vectors_.where(F.col("kind") == PAGE).select("host", F.col("n_pages").alias("all_pages"))
    frequent = (vectors_.where((F.col("kind") == ELEMENT) | ((F.col("kind") == TEXT) & (F.col("n_pages") >= opt.text_pages)
                                                             & (F.col("least") != F.col("most"))))
                .join(hosts, "host")
                .where(F.when(F.col("kind") == ELEMENT, F.col("n_pages") >= opt.min_share * F.col("all_pages"))
                       .otherwise(F.col("n_pages") >= opt.text_share * F.col("all_pages"))))
    classes = frequent.groupBy("host", "n_pages", "low", "high").agg(
        F.collect_list(F.when(F.col("kind") == ELEMENT, F.col("token"))).alias("elements"),
        F.collect_list(F.when(F.col("kind") == TEXT, F.col("token"))).alias("texts")
    ).where(F.size("elements") >= opt.min_tokens)
    return classes.groupBy("host").agg(F.flatten(F.collect_list("elements")).alias("elements"),
                                       F.flatten(F.collect_list("texts")).alias("texts"))


def _rows(batch):
    names = batch.schema.names
    return zip(*(batch.column(names.index(c)).to_pylist() for c in ("host", "html", "elements", "texts")))


def slots(pages: DataFrame, opt: TemplateOptions = TemplateOptions()) -> DataFrame:
    """(host, menus, has_main) from pages joined with their template."""
    def run(batches):
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            sets: dict[str, tuple] = {}
            for host, page, elements, texts in _rows(batch):
                if host not in sets:
                    sets[host] = (frozenset(elements or ()), frozenset(texts or ()))
                template, fixed = sets[host]
                for node, slot, text, linked in parse(page or "", template)[1]:
                    if fixed and digest(node.id, text) in fixed:
                        continue
                    row = found.setdefault((host, slot), [0, 0, 0])
                    row[0] += len(text)
                    row[1] += linked
                    row[2] += len(text) if node.main and not node.boiler else 0
            if found:
                columns = list(zip(*[(*k, *v) for k, v in found.items()]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4])],
                    ["host", "slot", "chars", "linked", "main"])

    emitted = map_arrow(pages, run, "host string, slot long, chars long, linked long, main long")
    summed = emitted.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("chars", "linked", "main")])
    menu = F.col("linked") > opt.link_share * F.col("chars")
    return summed.groupBy("host").agg(
        F.collect_list(F.when(menu, F.col("slot"))).alias("menus"),
        F.coalesce(F.max(~menu & (F.col("main") > 0)), F.lit(False)).alias("has_main"))


def main_text(page: str, template: frozenset = frozenset(), fixed: frozenset = frozenset(),
              menus: frozenset = frozenset(), has_main: bool = False) -> str:
    """The main text of one page, given what is known of its host."""
    blocks = [(node.main, text) for node, slot, text, _ in parse(page, template)[1]
              if not node.boiler and slot not in menus and not (fixed and digest(node.id, text) in fixed)]
    if has_main and any(main for main, _ in blocks):
        blocks = [b for b in blocks if b[0]]
    return "\n".join(text for _, text in blocks)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(
        F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, html: str = "html", url: str = "url",
            opt: TemplateOptions = TemplateOptions()) -> DataFrame:
    """``pages`` without ``html``, plus ``text`` and ``n_chars``."""
    pages = drop_names(pages, [c for c in ("text", "n_chars") if c not in (html, url)])
    kept = [c for c in pages.columns if c != html]
    # the input row travels as one struct, so no column name can clash
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(f"`{url}`").alias("host"),
                         F.col(f"`{html}`").alias("html"))
    template = store(templates(store(vectors(whole.select("host", "html")), "html-vectors"), opt), "html-templates")
    known = store(template.join(slots(whole.select("host", "html").join(template, "host", "left"), opt), "host", "full"),
                  "html-hosts")
    joined = whole.join(known, "host", "left")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            column = lambda c: batch.column(names.index(c)).to_pylist()
            texts, sets = [], {}
            for host, page, elements, fixed, menus, has_main in zip(*map(
                    column, ("host", "html", "elements", "texts", "menus", "has_main"))):
                if host not in sets:
                    sets[host] = (frozenset(elements or ()), frozenset(fixed or ()), frozenset(menus or ()), bool(has_main))
                texts.append(main_text(page or "", *sets[host]))
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("row")), out, pa.array([len(t) for t in texts], pa.int64())],
                ["row", "text", "n_chars"])

    found = map_arrow(joined, run, extended(joined.select("row"), "text string, n_chars long"))
    return found.select("row.*", "text", "n_chars")
