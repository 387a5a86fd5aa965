"""Main text of web pages by tag-path ratios.

A page is read as a list of blocks, each with the path of elements from the root to it. Text length (without links)
and punctuation are summed by path and divided by the path's blocks; the two ratios are fused into one score, which is
smoothed along the page and averaged over a path's blocks. A threshold parts the paths into two classes, the one that
separates their scores best; paths over it are content. The article or main element that holds most of the content, or
else the smallest container of all of it, is the article. Inside it, blocks of other paths (headings, short paragraphs,
lists) are kept in page order where they stand in a part of the page that holds content; a part without content, such as
a box of links or of short phrases, is left out, within an article that says so only if its score is less than half the
threshold. Elements that HTML has for something else (menus, headers and footers, asides, forms) never count, and class,
id or role names take out what stands outside an article; inside one they only ask for half the content's score.

The time is in proportion to the length of a page, however deep or broken it is.

Cases: null or empty html, or html without text, gives ''. Unclosed and misnested tags, comments, scripts and
character references are handled; nothing is cut from a long page. Frames, drawings, objects, templates and what stands for
scripts are left out with their content if they end; without an end tag only the tag itself is. A head needs no end. Rows are independent, so repeated rows give
repeated results; only three columns of the input are read.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import read, slices, small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: A comment, script or style without its end, which goes on to the end of the page.
UNENDED = re.compile(r"<!--(?!.*-->\Z)|<!\[CDATA\[(?!.*\]\]>\Z)|<(script|style)\b(?!.*</\1\s*>\Z)", re.S | re.I)
#: Elements that are left out with all they hold, once they end, and what may hide their tags.
WHOLE = frozenset("noscript template iframe svg object".split())
ENDED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)(noscript|template|iframe|svg|object)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)",
    re.S | re.I,
)
#: Elements that a drawing can't hold outside a foreignObject: one of them means that its end tag is missing.
BREAKOUT = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|dl|table|body|article|main|section|blockquote|pre)\b|(<foreignobject\b)", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text.
OUTSIDE = frozenset("nav footer aside form button select option textarea label fieldset dialog menu canvas audio video title".split())
CONTAINERS = frozenset("html body main article section div td center".split())
#: An opening tag ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIMITS = frozenset("ul ol table dl body article section div main td".split())
#: Words in class, id and role that name something beside the article.
NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar sidebars aside widget widgets"
    " menu menus nav navbar navigation breadcrumb breadcrumbs footer foot footnav masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " newsletter subscribe subscription signup login comment comments commentlist commentary reply replies respond disqus discussion"
    " share sharing social related recommended recommendations trending toolbar pagination pager search skip copyright legal disclaimer complementary contentinfo".split()
)
#: Classes and roles that, as a whole, leave no doubt even inside an article.
CERTAIN = frozenset(
    "comments comments-area comment-list comment-body commentlist commentary-list disqus_thread disqus-thread sidebar breadcrumb breadcrumbs navbar pagination"
    " cookie-notice cookie-banner cookie-consent share-buttons social-share sharedaddy adsbygoogle advertisement newsletter-signup navigation".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These name the page's head outside an article; inside it they hold its title.
HEADERS = frozenset("header topbar".split())
#: Classes that say what an element has or is filed under, not what it is.
STATES = re.compile(r"(?:has|with|without|no|is|category|tag|type|status|format|lang)[-_]|.*[-_](?:open|closed|enabled|disabled|on|off)\Z", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
LABEL = re.compile(r"\b(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟¡¿]")
DISCUSSION = re.compile(r"\W*(?:\d+\s+)?(?:reader |user )?(?:comments?|kommentare?|commentaires?|comentarios?|leserkommentare|responses?|leave a (?:comment|reply))\W*(?:\(?\d+\)?)?\W*\Z", re.I)
#: Levels of headings.
LEVELS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "header": 6, "hgroup": 6}
#: Elements that part a page: one without content is left out with all that it holds.
PARTS = frozenset("div section center".split())
#: Share of links above which an unselected block is dropped, and least quotient of the two classes' mean scores.
LINKS, CONTRAST = 0.66, 1.5
#: Weights of the block before, a block itself and the one behind it.
SMOOTH = (0.15, 0.7, 0.15)


def named_outside(attributes: str, inside: bool, element: str) -> str:
    """NAMED, DOUBTED or nothing. An id of a heading, a paragraph or a section is often made of its title."""
    doubted = ""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return NAMED
        if key == "style":
            if "display:none" in value.replace(" ", "").lower():
                return NAMED
            continue
        titled = element == "p" or element in HEADINGS
        if key == "id" and titled:
            continue
        words = {w.lower() for part in value.split() if not STATES.match(part) for w in WORD.findall(part)}
        if words & NAMES:
            if not inside and not (key == "id" and element == "section"):
                return NAMED
            if key != "id" and not titled and element != "section" and not CERTAIN.isdisjoint(value.lower().split()):
                return NAMED
            doubted = DOUBTED
        elif not inside and words & HEADERS:
            return NAMED
    return doubted


#: Outside by name only, and maybe so.
NAMED, DOUBTED = "named", "doubted"


def ends_of(page: str) -> dict[int, int]:
    """Where elements of WHOLE that end begin and end. An end tag belongs to the latest open tag of its name."""
    found: dict[int, int] = {}
    open_: dict[str, list[tuple[int, int]]] = defaultdict(list)
    breaks = [(m.start(), bool(m[1])) for m in BREAKOUT.finditer(page)] if "<svg" in page or "<SVG" in page.upper() else []
    starts = [a for a, _ in breaks]
    for m in ENDED.finditer(page, 0, page.rfind(">") + 1):
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if open_[name]:
                start, inner = open_[name].pop()
                k = bisect.bisect_left(starts, inner)
                if name != "svg" or k == len(starts) or starts[k] >= m.start() or breaks[k][1]:
                    found[start] = m.end()
        elif name in ("svg", "object") and m[4].endswith("/>"):
            found[m.start()] = m.end()
        else:
            open_[name].append((m.start(), m.end()))
    return found


def blocks_of(page: str) -> tuple[list[list], list[tuple[int, str]], list[int], list[int]]:
    """Blocks [text, element, is outside, characters in links, doubted element]; elements (parent, name) in page order;
    the last element inside each; and the tag path of each, where a part of the page is told by its class or id too. Every step looks at the open elements through an index by name, so that the time
    is in proportion to the page, however deep it nests."""
    elements: list[tuple[int, str]] = [(-1, "#")]
    paths, known = [0], {}  # (path, name, class or id) -> path
    stack: list[tuple[str, int, bool | str, bool, int]] = [("#", 0, False, False, 0)]  # name, element, outside, in an article, doubted element
    open_: dict[str, list[int]] = defaultdict(list)  # name -> places in the stack
    limits: list[int] = [0]  # places of LIMITS
    blocks: list[list] = []
    parts: list[str] = []
    linked = links = 0
    discussions: list[int] = []  # blocks

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and elements[owner][1] != "title":
                blocks.append([text, owner, outside, links, doubt])
                if len(text) < 60 and elements[owner][1] in LEVELS and DISCUSSION.match(text):
                    discussions.append(len(blocks) - 1)
            parts.clear()
        links = 0

    def close(place: int) -> None:
        """Close the open element at a place and all inside it."""
        while len(stack) > place:
            gone = stack.pop()[0]
            open_[gone].pop()
            if limits[-1] == len(stack):
                limits.pop()

    ends_at = ends_of(page)
    stop = page.rfind(">") + 1  # no tag begins behind it
    owner, outside, doubt, at = 0, False, 0, 0
    while m := TOKEN.search(page, at, stop):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if linked:
                links += len(piece)
        at = m.end()
        name = m[3]
        if name is None:
            if at == stop and UNENDED.match(m[0]):
                at = len(page)
            continue
        name = name.lower()
        if name in WHOLE and m.start() in ends_at:
            at = ends_at[m.start()]
            continue
        if m[2]:
            if name in INLINE:
                linked = max(0, linked - (name == "a"))
                continue
            flush()
            if open_[name]:
                close(open_[name][-1])
                linked = 0
        elif name in INLINE:
            linked += name == "a"
            continue
        elif name == "br":
            parts.append(" ")
            continue
        else:
            flush()
            linked = 0
            if stack[-1][0] == "title":
                close(len(stack) - 1)
                _, owner, outside, _, doubt = stack[-1]
            if name in VOID or name == "head":
                continue
            ends = ENDS.get(name, ()) if name not in CLOSES_P else ("p",)
            if place := max((open_[x][-1] for x in ends if open_[x]), default=0):
                # An element of a kind that ends others and is a limit itself, as td, ends its like.
                if place >= limits[-1]:
                    close(place)
            _, parent, out, inside, doubt = stack[-1]
            inside = inside or name in ("article", "main")
            elements.append((parent, name))
            attributes = m[4]
            label = LABEL.search(attributes) if name in PARTS else None
            paths.append(known.setdefault((paths[parent], name, label and label[1].strip("\"'")), len(known) + 1))
            if name in OUTSIDE or name == "header" and not inside:
                out = True
            elif not out and len(attributes) > 5 and name not in ("html", "body") and (named := named_outside(attributes, inside, name)):
                if named == NAMED:
                    out = NAMED
                else:
                    doubt = doubt or len(elements) - 1
            if not attributes.endswith("/>"):
                if name in LIMITS:
                    limits.append(len(stack))
                open_[name].append(len(stack))
                stack.append((name, len(elements) - 1, out, inside, doubt))
        _, owner, outside, _, doubt = stack[-1]
    if at < len(page):
        parts.append(page[at:].partition("<!--")[0])
    flush()
    last = list(range(len(elements)))
    for e in range(len(elements) - 1, 0, -1):
        parent = elements[e][0]
        last[parent] = max(last[parent], last[e])
    # A discussion goes on to the end of its heading's parent or to the next heading of its level or a higher one.
    done = -1
    for first in discussions:
        parent, name = elements[blocks[first][1]]
        if first <= done or elements[parent][1] in ("#", "body", "html", "article", "main"):
            continue
        for i in range(first, len(blocks)):
            e = blocks[i][1]
            if i > first and LEVELS.get(elements[e][1], 7) <= LEVELS[name] or not parent <= e <= last[parent]:
                break
            blocks[i][2] = True
            done = i
    return blocks, elements, last, paths


def split_scores(scores: dict[int, float], chars: dict[int, int]) -> tuple[float, float]:
    """The threshold between two classes of paths, and the mean of the upper class: of all cuts of the ordered scores, the
    one with the greatest variance between the classes, each path counting by its characters. If the upper mean is not
    CONTRAST times the lower one, all paths are of one class."""
    order = sorted((scores[p], n) for p, n in chars.items())
    total, weight = sum(x * n for x, n in order), sum(n for _, n in order)
    best, cut, upper = 0.0, order[0][0], total / weight
    low = below = 0.0
    for i in range(1, len(order)):
        x, n = order[i - 1]
        low, below = low + x * n, below + n
        if order[i][0] == x:
            continue
        m0, m1 = low / below, (total - low) / (weight - below)
        between = below * (weight - below) * (m1 - m0) ** 2
        if between > best and m1 >= CONTRAST * m0:
            best, cut, upper = between, order[i][0], m1
    return cut, upper


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by one space."""
    if not page:
        return ""
    blocks, elements, last, paths = blocks_of(page)
    inside = [b for b in blocks if not b[2]]
    if not inside:
        inside = [b for b in blocks if b[2] == NAMED]  # the names must be wrong
        if not inside:
            return ""

    # Ratios of each path, over all blocks of the page; smoothed along the page, and fused.
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for text, e, _, links, _ in blocks:
        p = paths[e]
        length[p] += max(0, len(text) - links)
        marks[p] += len(PUNCTUATION.findall(text))
        count[p] += 1
    series = [math.log1p(length[p] / count[p]) * math.log1p(1 + marks[p] / count[p]) for p in (paths[b[1]] for b in blocks)]
    total = defaultdict(float)
    for i, b in enumerate(blocks):
        near = [(series[k], SMOOTH[k - i + 1]) for k in (i - 1, i, i + 1) if 0 <= k < len(series)]
        total[paths[b[1]]] += sum(x * w for x, w in near) / sum(w for _, w in near)
    fused = {p: total[p] / count[p] for p in total}

    def select(some: list[list]) -> tuple[float, float]:
        chars: dict[int, int] = defaultdict(int)
        for text, e, *_ in some:
            chars[paths[e]] += len(text)
        return split_scores(fused, chars)

    # What is named inside an article has to reach half the content's score by itself.
    cut, upper = select(inside)
    doubts: dict[int, list[list]] = defaultdict(list)
    for b in inside:
        if b[4]:
            doubts[b[4]].append(b)
    low: set[int] = set()
    for e, named in doubts.items():
        named = [b for b in named if elements[b[1]][1] not in HEADINGS] or named
        chars, linked = sum(len(b[0]) for b in named), sum(b[3] for b in named)
        points = sum(len(PUNCTUATION.findall(b[0])) for b in named)
        ratio = math.log1p(max(0, chars - linked) / len(named)) * math.log1p(1 + points / len(named))
        if ratio < upper / 2 or linked > LINKS * chars:
            low.add(e)
    if low:
        inside = [b for b in inside if b[4] not in low] or inside
        cut, upper = select(inside)

    # The article: an element that says so and holds most of the selected text, if no other one beside it holds much of
    # it; else the deepest container with all of it.
    held = [0] * len(elements)
    for text, e, _, links, _ in inside:
        if fused[paths[e]] >= cut:
            held[e] += max(1, len(text) - links)
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e][0]] += held[e]
    root = max(e for e in range(len(elements)) if held[e] == held[0] and (e == 0 or elements[e][1] in CONTAINERS))
    said = [e for e, (_, name) in enumerate(elements) if name in ("article", "main") and held[e]]
    marked = False
    if said:
        top = max(said, key=lambda e: (held[e], -e))
        beside = any(held[e] * 3 >= held[top] for e in said if not top <= e <= last[top])
        if held[top] * 2 > held[0] and not beside:
            root, marked = top, True

    # A path over the threshold is content. A block of another path is too where it stands in a part that holds content:
    # a heading, a short paragraph, a list. A part without any is left out, within an article that says so only if its
    # score is less than half the threshold.
    part = [0] * len(elements)
    for e, (parent, name) in enumerate(elements):
        part[e] = e if e == root or name in PARTS else part[parent] if parent >= 0 else 0
    out = []
    for text, e, _, links, _ in inside:
        if root <= e <= last[root]:
            score = fused[paths[e]]
            if score >= cut or links <= LINKS * len(text) and (held[part[e]] or marked and score >= cut / 2):
                out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and the main text of each page."""
    rows = small_batches(pages).select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
