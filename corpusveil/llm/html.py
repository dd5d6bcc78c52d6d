"""Main text of web pages with site style trees.

Pages of a host are merged by the style paths of all their elements (tag and class down from the root).
A branch whose text is the same on the host's different pages has a low entropy and so a low importance;
likewise one whose presentation never varies. The leaves are the text blocks of an element: a block that
stands on most of the different pages which have the element spreads evenly over them and so has a low
importance, though the element's other blocks differ. Importances are shrunk towards 1 by PRIOR pages, so
few pages say little. On each page a branch's importance is combined up the tree: half its own, half its
children's by their share of text. Branches and leaves of low importance are removed from each page.

Menus, adverts and notices are often dealt out of some tens of texts, too many for a low entropy on a host of
some tens of pages. So the number of pages that only repeat a branch's text is held against those to expect
if it is dealt out of DEALT texts, as notices are, and out of FREE, as running text is. The log of their
likelihood ratio is the branch's evidence. A branch outside of articles, but for headings and branches with
most of a page's text, goes if the evidence, from SOME_PAGES or more, is EVIDENCE or more.

Tags, roles and classes that say no article decide only in between: such a branch goes unless its importance is
high on enough pages; what readers write goes always. Pages with equal text count once, so a host of copies keeps its article.

Only hashes by host and path are shuffled. Counts are pre-aggregated by (host, path, content), so a host
with a third of all pages is spread over its contents.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, scratch, tune

#: A branch or leaf goes if its importance is below this. CHILDREN is the children's part of a branch's importance, so one with
#: an own importance of LEAST_IMPORTANCE / (1 - CHILDREN) or more never goes. PRIOR is the weight of the prior, in pages.
LEAST_IMPORTANCE, CHILDREN, PRIOR = 0.2, 0.5, 1.0
#: A branch that the lists call no article stays if its content's importance is this on so many different pages. Texts dealt
#: out of v variants have one of at most log v / log m on m pages, so a hundred pages tell menus of up to 79 variants from running text.
SURE_CONTENT, SURE_PAGES = 0.95, 100
#: Numbers of texts that a notice and running text are thought to be dealt out of, the evidence at which a branch goes (odds of a thousand), and the pages that it must come from.
DEALT, FREE, EVIDENCE, SOME_PAGES = 100.0, 10_000.0, 6.9, 10
#: Elements that hold every page, so that none is removed; and what keeps places of leaves apart from paths.
PAGE, LEAF = frozenset(("", "html", "body")), 0x5EAF
#: Most places (16 bytes each) of all hosts that are broadcast; they are counted first.
PLACES = 1_000_000
#: Share of the presentation in a branch's importance; the rest is its content's.
PRESENTATION = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea select".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Text blocks of an article.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd blockquote pre tbody thead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_ARTICLE = frozenset("nav footer aside form button dialog menu".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NO_CLASS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond disqus reply replies widget pagination pager toolbar search skip copyright".split())
#: Names, in NO_CLASS as well, of what readers write: it differs on every page, so that no importance speaks for it.
READERS = frozenset("comment comments commentlist respond disqus reply replies".split())
#: Names that an article's own wrapper has; as a whole class or id they outweigh words inside of other names (with-sidebar).
ARTICLE_NAME = frozenset("article content entry main page post site story".split())
#: Tags that a start tag closes, up to the nearest of the second set.
CLOSES = {t: ("p", "") for t in "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select"),
}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass(slots=True)
class Node:
    """An element: what it is, its style path, its text blocks in page order with its descendants'."""

    tag: str
    path: int
    hidden: bool
    no_article: bool
    named: bool
    readers: bool
    parent: Node | None
    main: int = 0
    parts: list[str | Node] = field(default_factory=list)
    style: list[str] = field(default_factory=list)
    size: int = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _hidden(tag: str, a: dict[str, str], raw: str) -> bool:
    """Whether no reader of the page sees the element."""
    if tag in ("html", "body", "main", "article"):
        return False
    return tag in ("head", "title") or a.get("aria-hidden") == "true" or bool(a.get("style") and _HIDDEN.search(a["style"].lower())) or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw))


def _no_article(tag: str, a: dict[str, str], inside: int) -> tuple[bool, bool, bool]:
    """Whether the lists call an element no article, whether they do so for its class, id or form tag alone, and whether it is what readers write.

    `inside` is 1 in the main part and 2 in an article. There a heading's names say nothing, a section's
    only as whole names, and others' only if they have two words at most: a section on related work, a heading that is
    called header, or a long name with a listed word in it is the article's.
    """
    if (tag in NO_ARTICLE and tag != "form") or (tag == "header" and not inside) or a.get("role", "").lower() in NO_ROLE:
        return True, False, False
    if tag in ("html", "body", "main"):
        return False, False, False
    names = f"{a.get('class', '')} {a.get('id', '') if tag != 'article' else ''}".lower().split()
    found = [n for n in names if not NO_CLASS.isdisjoint(words := _WORDS.findall(n)) and (NO_CLASS.intersection(words) != {"header"} or ARTICLE_NAME.isdisjoint(words))]
    if tag == "article" or (inside == 2 and tag == "section") or not ARTICLE_NAME.isdisjoint(names):
        found = [n for n in found if n in NO_CLASS]
    elif inside == 2:
        found = [n for n in found if len(_WORDS.findall(n)) <= 2]
    if inside == 2 and tag in HEADINGS:
        found = []
    named = bool(found) or tag == "form"
    return named, named, any(not READERS.isdisjoint(_WORDS.findall(n)) for n in found)


def _facts(tag: str, rest: str, inside: int) -> tuple[str, bool, bool, bool, bool, bool]:
    """An element's look, whether it is hidden, no article by the lists, that by its name alone, and of readers, and whether its role is main."""
    a = _attributes(rest)
    return f"{tag}.{'.'.join(sorted(a.get('class', '').lower().split()))}", _hidden(tag, a, rest), *_no_article(tag, a, inside), a.get("role", "").lower() == "main"


_known = lru_cache(maxsize=4096)(_facts)
#: CLOSES as sets.
_CLOSES = {t: tuple(frozenset(x.split()) for x in pair) for t, pair in CLOSES.items()}


def tags(source: str) -> Iterator[tuple[str, str, bool, str]]:
    """The text before each tag, the tag's name, whether it is an end tag, and its attributes; last the text after all, without a name.

    Quotes hide a ">". A quote that is never closed is an ordinary character; after a tag that runs to the end
    of the page, quotes hide nothing. So each character is looked at a few times at most.
    """
    last = {q: source.rfind(q) for q in "\"'"}
    at = begin = 0
    quoted = True
    while (at := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), at):
            comment = source.startswith("<!--", at)
            end = source.find("-->" if comment else ">", at + 4 if comment else at)
            if end < 0 and not comment:
                break
            yield source[begin:at], "", False, ""
            at = begin = len(source) if end < 0 else end + (3 if comment else 1)
            continue
        if not (m := _NAME.match(source, at)):
            at += 1
            continue
        end, place = -1, m.end()
        while quoted and (q := _END.search(source, place)):
            if q[0] == ">":
                end = q.start()
                break
            place = source.index(q[0], q.end()) + 1 if q.start() < last[q[0]] else q.end()
        if end < 0:
            quoted = False
            end = source.find(">", m.end())
            if end < 0:
                break
        yield source[begin:at], m[1].lower(), source[at + 1] == "/", source[m.end() : end]
        at = begin = end + 1
    yield source[begin:], "", False, ""


def parse(source: str) -> Node:
    """The tree of a page. Unclosed elements end where HTML ends them; raw elements are skipped whole, hidden or listed inline ones are muted."""
    root = node = Node("", 0, False, False, False, False, None)
    text: list[str] = []
    open_: Counter[str] = Counter()
    endless: set[str] = set()
    mute, depth, skip = "", 0, ""
    low: str | None = None
    at = 0

    def flush() -> None:
        if text:
            if block := " ".join("".join(text).split()):
                node.parts.append(block)
            text.clear()

    for raw, tag, closing, rest in tags(source):
        at += len(raw)
        if skip:
            # Inside a raw element whose end is known to come.
            if closing and tag == skip:
                skip = ""
            continue
        if raw and not mute:
            text.append(html.unescape(raw) if "&" in raw else raw)
        if not tag:
            continue
        if closing:
            if tag in INLINE:
                if tag == mute:
                    depth -= 1
                    mute = mute if depth else ""
                continue
            if open_.get(tag):
                flush()
                mute = ""
                while node.tag != tag:
                    open_[node.tag] -= 1
                    node = node.parent
                open_[tag] -= 1
                node = node.parent
            continue
        if tag in RAW:
            if rest.endswith("/") or tag in endless:
                continue
            low = source.lower() if low is None else low
            if low.find(f"</{tag}", at) >= 0:
                skip = tag
            elif tag in ("script", "style", "template", "textarea"):
                break
            else:
                endless.add(tag)
            continue
        if tag in INLINE or tag in VOID:
            if mute:
                depth += tag == mute
            elif "=" in rest or "hidden" in rest:
                if tag in INLINE and any((_known if len(rest) < 200 else _facts)(tag, rest, True)[1:3]):
                    mute, depth = tag, 1
            if tag in ("br", "hr", "wbr", "img"):
                text.append(" ")
            if tag == "hr":
                flush()
            continue
        flush()
        mute = ""
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            if any(open_.get(x) for x in ends):
                up = node
                while up is not root and up.tag not in ends and up.tag not in stops and (tag in ("li", "dt", "dd", "tr", "td", "th") or up.tag in TEXT):
                    up = up.parent
                if up.tag in ends:
                    while node is not up:
                        open_[node.tag] -= 1
                        node = node.parent
                    open_[node.tag] -= 1
                    node = node.parent
        look, hidden, no_article, named, readers, is_main = (_known if len(rest) < 200 else _facts)(tag, rest, node.main)
        node.style.append(look)
        child = Node(tag, xxhash.xxh3_64_intdigest(look.encode("utf-8", "surrogatepass"), seed=node.path) >> 1, hidden, no_article, named, readers, node, node.main)
        if tag == "article":
            child.main = 2
        elif tag == "main" or is_main:
            child.main = max(node.main, 1)
        node.parts.append(child)
        open_[tag] += 1
        node = child
    flush()
    _spare(root)
    return root


def upward(root: Node) -> list[Node]:
    """The visible nodes, children before their parents."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(p for p in x.parts if isinstance(p, Node) and not p.hidden)
    return out[::-1]


def _spare(root: Node) -> None:
    """Sizes of the visible text. A name alone does not speak against a branch that holds most of the page's."""
    order = upward(root)
    for x in order:
        for p in x.parts:
            x.size += len(p) if isinstance(p, str) else 0 if p.hidden else p.size
    for x in order:
        if x.named and 2 * x.size > root.size:
            x.no_article = x.named = x.readers = False


def leaf(path: int, block: str) -> int:
    """The place of a text block in the tree, below its element's path."""
    return xxhash.xxh3_64_intdigest(block.encode("utf-8", "surrogatepass"), seed=path ^ LEAF) >> 1


def combined(root: Node, low: dict[int, float]) -> dict[int, float]:
    """The combined importance of the page's branches, by node, for those whose own one is known to be small."""
    out: dict[int, float] = {}
    for x in upward(root):
        if x.path in low and x.size:
            total = 0.0
            for p in x.parts:
                if isinstance(p, str):
                    total += len(p) * low.get(leaf(x.path, p), 1.0)
                elif not p.hidden:
                    total += p.size * out.get(id(p), 1.0)
            out[id(x)] = (1 - CHILDREN) * low[x.path] + CHILDREN * total / x.size
    return out


def blocks(root: Node, low: dict[int, float], sure: set[int], dealt: set[int]) -> list[tuple[int, str]]:
    """Text blocks in page order with the main part that they are in, without removed branches and leaves."""

    def kept(x: Node) -> bool:
        if x.tag in PAGE:
            return True
        if importance.get(id(x), 1.0) < LEAST_IMPORTANCE or (x.no_article and (x.readers or x.path not in sure)):
            return False
        return x.path not in dealt or x.main == 2 or x.tag in HEADINGS or 2 * x.size > root.size

    out: list[tuple[int, str]] = []
    importance = combined(root, low) if low else {}
    stack: list[Node | tuple[int, int, str]] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            if not low or low.get(leaf(x[1], x[2]), 1.0) >= LEAST_IMPORTANCE:
                out.append((x[0], x[2]))
        elif not x.hidden and kept(x):
            stack.extend((x.main, x.path, p) if isinstance(p, str) else p for p in reversed(x.parts))
    return out


def main_text(source: str | None, low: dict[int, float] | None = None, sure: set[int] | None = None, dealt: set[int] | None = None) -> str:
    """The article of a page: blocks joined by blank lines. Null or blank pages give an empty text.

    What is in <article> is the text if it is at least half of the main part's, and the main part's if it is
    at least half of the page's; otherwise the wider part is.
    `low` are the small importances of branches and leaves on the page's host, `sure` the branches of high importance, `dealt` those
    with evidence of texts dealt out of few.
    """
    kept = blocks(parse(source or ""), low or {}, sure or set(), dealt or set())
    found = [[b for main, b in kept if main >= least] for least in (2, 1, 0)]
    sizes = [sum(map(len, f)) for f in found]
    best = 2 if 2 * sizes[1] < sizes[2] else 1
    return "\n\n".join(found[0 if 2 * sizes[0] >= sizes[best] else best])


def branches(source: str) -> tuple[list[tuple[int, int, int, bool]], int]:
    """The visible part of a page's tree, and the hash of its text.

    A branch is a path, the hash of its presentation, the hash of its text and False; a leaf is its element's
    path, 0, its place and True. The page's text is what the lists leave of it, or all if they leave none.
    """
    root, rows, leaves = parse(source), {}, set()
    digest = lambda parts: xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) >> 1
    text: dict[int, str] = {}
    listed: dict[int, str] = {}
    for x in upward(root):
        every, some = [], []
        for p in x.parts:
            if isinstance(p, str):
                place = leaf(x.path, p)
                leaves.add((x.path, 0, place, True))
                every.append(f"{place:x}")
                some.append(f"{place:x}")
            elif not p.hidden:
                if p.size:
                    every.append(text[id(p)])
                if not p.no_article and listed[id(p)]:
                    some.append(listed[id(p)])
        text[id(x)], listed[id(x)] = f"{digest(every):x}", f"{digest(some):x}" if some else ""
        if x.size:
            style, own = rows.setdefault(x.path, ([], []))
            style.append(digest(x.style))
            own.append(text[id(x)])
    return [(path, digest(map(str, style)), digest(own), False) for path, (style, own) in rows.items()] + sorted(leaves), digest([listed[id(root)] or text[id(root)]])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, content (the content's importance), evidence (0 for leaves) and importance of the branches and leaves of each host's merged tree, and m, the different pages that they rest on; from columns host and h (the page's source)."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("look", pa.int64()), ("content", pa.int64()), ("leaf", pa.bool_()), ("page", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, h in zip(b.column("host").to_pylist(), b.column("h").to_pylist(), strict=True):
                found, page = branches(h)
                rows += [(host, *f, page) for f in found]
            if rows:
                yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    seen = cut(pages.where("host <> '' and h is not null").select("host", "h").mapInArrow(run, "host string, path long, look long, content long, leaf boolean, page long").distinct(), "seen")

    def entropy(what: str) -> DataFrame:
        counts = seen.where("not leaf").groupBy("host", "path", what).agg(F.count_distinct("page").alias("n"))
        return counts.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), (F.sum("n") - F.count("*")).alias("repeats")).select("host", "path", "m", "repeats", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias(what))

    both = entropy("content").join(entropy("look").drop("m", "repeats"), ["host", "path"])
    # Poisson likelihoods of so many repeats; a single page has none to expect.
    dealt, free = (F.col("m") - v * (1 - F.exp(F.col("m") * math.log1p(-1 / v))) for v in (DEALT, FREE))
    evidence = F.when(F.col("m") > 1, F.col("repeats") * F.log(dealt / free) - dealt + free).otherwise(0.0)
    inner = both.select("host", "path", "m", F.lit(False).alias("leaf"), "content", evidence.alias("evidence"), (PRESENTATION * F.col("look") + (1 - PRESENTATION) * F.col("content")).alias("importance"))
    on = seen.where("not leaf").groupBy("host", "path").agg(F.count_distinct("page").alias("m"))
    spread = seen.where("leaf").groupBy("host", "path", "content").agg(F.count_distinct("page").alias("n")).where("n > 1")
    leaves = spread.join(on, ["host", "path"]).select("host", F.col("content").alias("path"), "m", F.lit(True).alias("leaf"), (1 - F.log("n") / F.log("m")).alias("content"), F.lit(0.0).alias("evidence")).withColumn("importance", F.col("content"))
    shrunk = (F.col("importance") * F.col("m") + PRIOR) / (F.col("m") + PRIOR)
    return inner.union(leaves).withColumn("importance", shrunk)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """The main text of each page: k, url, text, n_chars.

    A null or blank source gives an empty text. A null or unusual URL has no host, so tags alone decide for
    its page. Repeated rows are returned each, and null keys stay null; an empty table gives no rows.
    """
    spark = pages.sparkSession
    tune(spark)
    host = F.coalesce(F.regexp_extract(F.lower(F.col(f"`{url}`")), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))
    own = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{source}`").cast("string").alias("h"), host.alias("host"))
    low, sure = F.col("importance") < LEAST_IMPORTANCE / (1 - CHILDREN), ~F.col("leaf") & (F.col("content") >= SURE_CONTENT) & (F.col("m") >= SURE_PAGES)
    dealt = (F.col("evidence") >= EVIDENCE) & (F.col("m") >= SOME_PAGES)
    with scratch(spark):
        lists = style_tree(own).where(low | sure | dealt).groupBy("host").agg(F.collect_set(F.when(low, F.struct("path", "importance"))).alias("low"), *(F.collect_set(F.when(x, F.col("path"))).alias(name) for name, x in (("sure", sure), ("dealt", dealt))))
        places = cut(lists, "places", keep=True)
    weight = places.agg(F.coalesce(F.sum(F.size("low") + F.size("sure") + F.size("dealt") + 2), F.lit(0))).first()[0]
    schema = pa.schema([("k", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for h, x, y, z in zip(*(b.column(name).to_pylist() for name in ("h", "low", "sure", "dealt")), strict=True):
                found.append(main_text(h, {p["path"]: p["importance"] for p in x or ()}, set(y or ()), set(z or ())))
            yield batch(schema, k=b.column("k"), url=b.column("url"), text=found, n_chars=[len(t) for t in found])

    lists = F.broadcast(places) if weight <= PLACES else places
    return own.join(lists, "host", "left").select("k", "url", "h", "low", "sure", "dealt").mapInArrow(run, "k long, url string, text string, n_chars long")
