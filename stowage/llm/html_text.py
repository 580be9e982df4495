"""HTML extraction by template deduction.

Tokens are a page's block tags with their path and its text blocks with theirs. For each host, tokens that have the same
occurrence vector over its pages (so many times on the same pages) form an equivalence class; the vector is kept as a
commutative digest, so it is one aggregate over (host, token) with map-side combining, whatever a host's size. Classes on
SUPPORT pages of a host are candidates, however many pages it has, so that each of its layouts has its own. A class is template for certain if a
block tag is in it (an element on the same pages) or it is on half of the host's pages; another, of texts alone, only outside
article and main elements and if it has SIZE tokens: a lone sentence, or an article's copies, repeat in the same way. The class on most pages is the page's frame and the others nest in it.
On a page a class counts only if its tokens stand in one slot of the frame, in order; else its tokens are that page's own.
What template tokens don't cover are the slots. The main text is the slots' text in the page's content element (article, else
main, else an element named for content that has half of the page's own text, else the body), without elements that are by tag, role
or name menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments. A name that only may say so doesn't drop a
heading or paragraph unless its tag is template too. Template text goes inside an article or main element too, unless
its class has the page's title or template text is two thirds of the element's: then it is an article's copies.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; unclosed and stray tags are tolerated, at
any depth; blocks repeat in the result as often as on the page; repeated rows count as pages and get a row each; an empty table gives
no rows; only page_id, url and html are read, so other columns never clash.
"""

from __future__ import annotations

import functools
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, pieces, small, small_batches, written

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>|([^<]+)|(<)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SCOPE = frozenset("article aside body div footer form header html main nav section table td th blockquote fieldset".split())
DROP_TAGS = frozenset("aside button dialog footer form head menu nav title".split())
#: Names (class, id) of parts to drop: those that say so wherever they stand, and those that on a line of text (LINES) need the template's word.
CERTAIN_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription comment comments disqus respond reply replies".split())
DROP_NAMES = CERTAIN_NAMES | frozenset("popup modal overlay sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer discussion share sharing social related recommended recommendations widget toolbar pagination pager login signup search copyright".split())
#: Words that may stand beside such a word in one name without another meaning.
BESIDE = frozenset("site page main top bottom left right header box block area bar wrap wrapper container list item items button buttons link links section widget primary secondary global form post posts article articles user reader inner outer slot unit thread content text body row col column group panel icon icons js".split())
#: Tags of single lines or paragraphs.
LINES = frozenset("h1 h2 h3 h4 h5 h6 p pre".split())
HEAD_NAMES = frozenset("header masthead topbar".split())
DROP_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar".split())
CONTENT_NAMES = frozenset("content post entry story article articlebody maincontent".split())
#: Pages of a host that a class stands on at least.
SUPPORT = 4
#: Tokens of a class at least, if it has no block tag and is on fewer than half of the pages.
SIZE = 2


def _attributes(raw: str) -> tuple[str, frozenset, str]:
    """role, the names of class and id, and hidden, content or nothing."""
    names, role, state = [], "", ""
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            names += value.split()
        elif name == "role":
            role = value
        elif name == "itemprop":
            state = state or ("content" if value == "articlebody" else "")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            state = "hidden"
    return role, frozenset(names), state


@functools.lru_cache(50_000)
def _meaning(name: str) -> tuple[bool, bool, bool, bool]:
    """Whether a class or id names a part to drop for certain, one to drop, a page's head, the content."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    plain = all(w in DROP_NAMES or w in HEAD_NAMES or w in BESIDE for w in words)
    return plain and any(w in CERTAIN_NAMES for w in words), plain and any(w in DROP_NAMES for w in words), plain and any(w in HEAD_NAMES for w in words), any(w in CONTENT_NAMES for w in words)


class Token(NamedTuple):
    """A block tag (text empty) or a text block. digest: of the path of tags and names to it, and its text; level: 3 in an article,
    2 in main, 1 in an element named for content, 0 elsewhere; doubt: the place of the tag that its name may drop, or -1; title: in an h1."""

    digest: int
    text: str
    level: int
    dropped: bool
    doubt: int
    title: bool


class _Open(NamedTuple):
    tag: str
    path: int
    level: int
    dropped: bool
    doubt: int
    p: int  # where in the stack the p and the li stand that a new block or li ends; 0 for none
    li: int


def parse(page: str | None) -> list[Token]:
    """The page's tokens in order. Paths are rolling hashes and implied ends are kept with each open element, so depth costs nothing."""
    out: list[Token] = []
    stack = [_Open("", 0, 0, False, -1, 0, 0)]
    open_: Counter = Counter()
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                out.append(Token(xxhash.xxh3_64_intdigest(text, top.path) - (1 << 63), text, top.level, top.dropped, top.doubt, top.tag == "h1"))

    def end(at: int) -> None:
        for x in stack[at:]:
            open_[x.tag] -= 1
        del stack[at:]

    for raw_tag, close, tag, attributes, text, stray in TOKEN.findall(page or ""):
        if text or stray:
            held.append(text or stray)
            continue
        tag = tag.lower()
        if not tag:
            if raw_tag:
                held.append(" ")
            continue
        block = tag in BLOCK
        if tag == "br":
            held.append(" ")
        if block:
            flush()
        if close:
            if open_[tag] > 0:
                while stack[-1].tag != tag:
                    open_[stack.pop().tag] -= 1
                open_[stack.pop().tag] -= 1
            continue
        if tag in VOID:
            continue
        role, names, state = _attributes(attributes) if attributes else ("", frozenset(), "")
        means = [any(x) for x in zip(*map(_meaning, names), strict=True)] if names else [False] * 4
        if not block:
            top = stack[-1]
            if state == "hidden" or means[1]:
                flush()
                open_[tag] += 1
                stack.append(top._replace(tag=tag, path=xxhash.xxh3_64_intdigest(tag, top.path), dropped=True))
            elif top.dropped and top.tag == tag:
                open_[tag] += 1
                stack.append(top)  # so that its end doesn't end the dropped element
            continue
        if stack[-1].p:
            end(stack[-1].p)
        if tag == "li" and stack[-1].li:
            end(stack[-1].li)
        top = stack[-1]
        level = max(top.level, 3 if tag == "article" or state == "content" else 2 if tag == "main" or role == "main" else 1 if means[3] and tag != "body" else 0)
        head = tag == "header" or role == "banner" or means[2]
        certain, named = means[0], means[1]
        if tag in ("html", "body", "article", "main"):
            # names on the page's own frame describe the page, not a part to drop, but for comments
            certain = named = any(w in ("comment", "comments", "reply", "replies") for n in names if _meaning(n)[0] for w in re.split(r"[^a-z]+", n))
        doubtful = named and not certain and tag in LINES
        dropped = top.dropped or tag in DROP_TAGS or named and not doubtful or role in DROP_ROLES or state == "hidden" or head and level < 2
        shown = ".".join(sorted(n for n in names if not re.search(r"\d", n)))  # names with numbers are often of one page
        path = xxhash.xxh3_64_intdigest(f"{tag}.{shown}", top.path)
        doubt = len(out) if doubtful else top.doubt
        out.append(Token(path - (1 << 63), "", level, dropped, doubt, False))
        scope, at = tag in SCOPE, len(stack)
        stack.append(_Open(tag, path, level, dropped, doubt, at if tag == "p" else 0 if scope else top.p, at if tag == "li" else 0 if scope or tag in ("ul", "ol") else top.li))
        open_[tag] += 1
    flush()
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://|[/?#].*$", "", (url or "").lower(), flags=re.S)


def _tokens(pages: DataFrame) -> DataFrame:
    """host, token, tag, n, row, key of every page's different tokens, and one without a token for the page itself; row numbers the pages, key is the html's digest."""

    @frugal
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, 64):
                rows = []
                for url, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    host, key = host_of(url), _key(raw)
                    rows += [(host, token, tag, n, row, key) for (token, tag), n in Counter((t.digest, not t.text) for t in parse(raw)).items()]
                    rows.append((host, None, False, 1, row, key))
                    row += 1
                if rows:
                    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "token", "tag", "n", "row", "key"])

    return pages.select("url", "html").mapInArrow(tokens, "host string, token long, tag boolean, n long, row long, key binary")


def _key(raw: str | None) -> bytes:
    return xxhash.xxh3_128_digest(raw or "")


def deduced(pages: DataFrame) -> DataFrame:
    """host, token, pages, first, sure: the templates' tokens. pages and first (its least token) name a host's class."""
    vectors = _tokens(pages).groupBy("host", "token", "tag").agg(F.count("*").alias("pages"), F.expr("bit_xor(xxhash64(row, n))").alias("vector")).filter(F.col("pages") >= SUPPORT)
    vectors = written(vectors, "html-tokens")
    totals = vectors.filter("token IS NULL").select("host", F.col("pages").alias("all"))
    by = ["host", "pages", "vector"]
    classes = vectors.filter("token IS NOT NULL").groupBy(*by).agg(F.min("token").alias("first"), F.bool_or("tag").alias("tags"), F.count("*").alias("size"))
    classes = classes.join(totals, "host").select(*by, "first", (F.col("tags") | (F.col("pages") * 2 >= F.col("all"))).alias("sure"), "size").filter(F.col("sure") | (F.col("size") >= SIZE))
    return written(vectors.filter("token IS NOT NULL").drop("tag").join(classes.drop("size"), by).drop("vector"), "html-templates")


def slots(tokens: list[Token], known: dict[int, tuple]) -> list[tuple | None]:
    """The class of each of a page's tokens, None for the page's own: those no valid class has. known: token -> (-pages, first, sure)."""
    at_: dict[tuple, list[int]] = {}
    for i, t in enumerate(tokens):
        found = known.get(t.digest)
        if found is not None:
            at_.setdefault(found, []).append(i)
    out: list[tuple | None] = [None] * len(tokens)
    frame: list[int] = []
    for found in sorted(at_):
        at = at_[found]
        # a nested class stands in one slot of the frame
        if frame and len(at) > 1 and bisect_left(frame, at[-1]) > bisect_left(frame, at[0]):
            at = [i for i in at if tokens[i].text]
        for i in at:
            out[i] = found
        frame = frame or at
    return out


def main_text(page: str | None, known: dict[int, tuple] | None) -> str:
    tokens = parse(page)
    found = slots(tokens, known or {})
    size = lambda which: sum(len(tokens[i].text) for i in which)
    # a line whose name alone may drop it goes if its tag is template, or where a host's pages are too few to tell
    able = [i for i, t in enumerate(tokens) if t.text and not t.dropped and not (t.doubt >= 0 and (not known or found[t.doubt] is not None))]
    best = max((tokens[i].level for i in able), default=0)
    content = [i for i in able if tokens[i].level >= best]
    if best == 1 and 2 * size(content) < size(i for i in able if found[i] is None):
        best, content = 0, able  # a name alone doesn't leave out most of the page's own text
    # a class that has the page's title is an article's copies, no template
    copied = {found[i] for i in content if tokens[i].title}
    kept = [i for i in content if found[i] is None or tokens[i].level >= 2 and (not found[i][2] or found[i] in copied)]
    if best >= 2 and 3 * size(kept) < size(content):
        kept = content  # two thirds of an article on other pages too: copies
    if not kept and content:
        # elsewhere a copy of other pages has the text of its rarest class, if that isn't a template for certain
        rarest = max(found[i] for i in content)
        kept = [i for i in content if found[i] == rarest and not rarest[2]]
    return "\n\n".join(tokens[i].text for i in kept)


def extract(pages: DataFrame, limit: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages. Templates of up to limit tokens are broadcast; beyond that each page gets its own tokens' classes by a join."""
    names, types = ["page_id", "url", "text", "n_chars"], "page_id long, url string, text string, n_chars long"
    template = deduced(pages)
    shared = None
    if template.count() <= limit:
        by_host: dict[str, dict[int, tuple]] = {}
        for r in template.toLocalIterator():
            by_host.setdefault(r.host, {})[r.token] = (-r.pages, r.first, r.sure)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = shared.value if shared else {}
        for batch in batches:
            for part in pieces(batch, 64):
                page, url, raw, *hits = (c.to_pylist() for c in part.columns)
                if hits:
                    known = [{x["token"]: (-x["pages"], x["first"], x["sure"]) for x in mine or ()} for mine in hits[0]]
                else:
                    known = [hosts.get(host_of(u)) for u in url]
                texts = [main_text(x, k) for x, k in zip(raw, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    rows = pages.select("page_id", "url", "html")
    if shared:
        return rows.mapInArrow(run, types)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 64):
                url, raw = part.column(1).to_pylist(), part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(host_of, url), pa.string()), pa.array(map(_key, raw), pa.binary())], ["page_id", "url", "html", "host", "key"])

    # pages of one host with the same html have the same tokens, so they share a row of classes
    own = _tokens(pages).filter("token IS NOT NULL").select("host", "token", "key").join(small(template), ["host", "token"])
    own = own.groupBy("host", "key").agg(F.collect_set(F.struct("token", "pages", "first", "sure")).alias("hits"))
    return rows.mapInArrow(keyed, "page_id long, url string, html string, host string, key binary").join(own, ["host", "key"], "left").select("page_id", "url", "html", "hits").mapInArrow(run, types)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
