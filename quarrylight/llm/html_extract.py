"""HTML extraction by two passes of block rules.

The page is cut into blocks at block-level tags; inline tags, comments, scripts, styles and other invisible parts go.
First pass, context-free: blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by
tag, role, class or id of an enclosing element) are boilerplate; of the rest, link density, length and stop-word density
decide: bad, good, near-good or short. Second pass: headings, and blocks that are short or near-good, inherit the label
of the nearest decided neighbour, first of those in their own container (the innermost div, section or the like), then
of all; if there are as near ones of both labels, near-good blocks are content and others not. On a page without a good
block, the near-good ones with the most stop words are good; without any, what no mark or link density rules out. Blocks of an
article or main element are content unless they are marked as boilerplate; lists of references stay.

A class, an id or a form around an article or main element, or on it, is a wrapper's and does not make it boilerplate;
names like has-sidebar, no-sidebar or content-sidebar-wrap are of layouts and say nothing. Inside main text, a class or id marks a
block only if one of its names as a whole is that of comments, adverts, related pages, sharing or the like: an article's section
"social-history" is no social bar. A link counts over the blocks that it spans, if the page closes it. Articles in parts named for
reader comments, related pages or adverts are boilerplate only on pages with other main text.

Nothing is dropped or capped but boilerplate blocks. White space in a block becomes one space; character references are
decoded. Null pages count as empty, malformed pages are read as far as they make sense, in time linear in their length. Repeated
rows are extracted alike, an empty table gives no rows. Scale: one pass, no shuffle.
Columns of the input stay, but for those named like a result column, which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import as_row, replace_columns

#: Thresholds of the first pass.
LINKS, SHORT, LONG, FEW, MANY = 0.33, 70, 200, 0.12, 0.22

# Element names of HTML, and frequent words of four languages.
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("script style noscript template iframe object embed svg math canvas audio video map head title select textarea button datalist".split())
RAW = frozenset("script style noscript template iframe svg math title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog form toolbar".split())
#: Elements and roles of main text; a main element is the page's own.
ARTICLE, MAIN = 1, 2
GOOD_NAMES = {"article": ARTICLE, "main": MAIN}
CONTAINERS = frozenset("article aside body div fieldset footer form header html main nav section table td th".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|foot|header|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notices?|alerts?|popup\w*|modal\w*|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social\w*|comments?|comment\w*|respond|replies|reply|disqus|discussion|reactions"
    r"|related|recommended|widget\w*|pagination|pager|legal|copyright|disclaimer|search\w*|form|hidden|skip|outbrain|taboola|kommentar\w*|comentarios?|werbung|anzeigen?|publicit\w*|publicidad|impressum|datenschutz)(?:$|[\s_-])",
    re.I,
)
#: Of these names, those of parts that hold articles of others.
PART_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|comment\w*|respond|replies|reply|disqus|discussion|reactions|related|recommended|outbrain|taboola|kommentar\w*|comentarios?|werbung|anzeigen?|publicit\w*|publicidad)(?:$|[\s_-])", re.I)
#: Whole names that mark a block inside main text.
INSIDE_NAMES = re.compile(
    r"(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|comments?|commentlist|respond|replies|reply|disqus|discussion|reactions|related|recommended|outbrain|taboola|kommentare?|comentarios?|werbung|anzeigen?|publicit\w*|publicidad"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|sidebar|breadcrumbs?|pagination|pager|cookies?|consent|gdpr|popup|modal|navbar|nav|navigation|menu(?:[_-]items?[\w-]*)?|toolbar|skip|hidden)"
    r"(?:[_-](?:ad|box|links?|buttons?|bar|list|section|area|form|container|wrapper|block|unit|slot|posts?|pages|articles?|notice|banner|thread|title|\d+))*",
    re.I,
)
#: What a name says of the layout of its element: parts that it has or lacks, and the wrapper of the content and of parts.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]\S*|(?<!\S)(?=\S*content)\S+[_-]wrap(?:per)?(?!\S)|(?<!\S)\S+[_-]layout(?!\S)", re.I)
#: How firmly an element is boilerplate: not, unless main text is inside, unless it is the only main text, by all means.
CLEAN, WRAPPER, PART, BAD = range(4)
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its just like may more no not of on one only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces comme dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur te tu un une vous y à été être "
    "al así como con cuando de del desde donde el ella en entre era es esta este esto fue ha han hasta hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene un una y ya".split()
)
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z))", re.S)
#: Possessive, so that a long name without a value is passed over once.
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+", re.S)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Elements that a new block of a kind closes if it is still open.
CLOSES = {"p": BLOCKS - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


class Block:
    """A block's text, letters inside links, and where it stands."""

    __slots__ = ("parts", "linked", "heading", "bad", "good", "home", "text", "label", "dense")

    def __init__(self, heading: bool, bad: int, good: int, home: int):
        self.parts: list[str] = []
        self.linked = 0
        self.heading, self.bad, self.good, self.home = heading, bad, good, home
        self.text = self.label = ""
        self.dense = 0.0


def _within(bad: int, good: int) -> int:
    """What a mark is inside or on an element that says main text."""
    return CLEAN if bad == WRAPPER and good or bad == PART and good == MAIN else bad


def _named(value: str, inside: bool) -> int:
    """How firmly a class or id says boilerplate, of an element inside main text or elsewhere."""
    value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
    if inside:
        marked = [n for n in value.split() if INSIDE_NAMES.fullmatch(n)]
        return CLEAN if not marked else PART if any(PART_NAMES.search(n) for n in marked) else WRAPPER
    value = _LAYOUT.sub(" ", value)
    return CLEAN if not BAD_NAMES.search(value) else PART if PART_NAMES.search(value) else WRAPPER


def _marks(name: str, attributes: str, inside: bool = False) -> tuple[int, int]:
    """How firmly an element's own tag and attributes say boilerplate, and whether they say main text."""
    bad = (WRAPPER if name == "form" else BAD) if name in BAD_TAGS else CLEAN
    good = GOOD_NAMES.get(name, 0)
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                bad = BAD
            elif key == "role":
                if value in BAD_ROLES:
                    bad = max(bad, WRAPPER if value == "form" else BAD)
                good = max(good, GOOD_NAMES.get(value, 0))
            elif key in ("class", "id") and name not in ("body", "html"):
                bad = max(bad, _named(value, inside))
    return _within(bad, good), good


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    found: list[Block] = []
    # Of each open element: name, how firmly it is in boilerplate, whether it is in main text, in a heading, and the number of its container.
    opened: list[tuple[str, int, int, bool, int]] = []
    # links: 0 outside of links, 1 in a link that ends with the block, 2 in one that the page closes.
    links = serial = 0
    block = Block(False, CLEAN, 0, 0)
    # How many elements of a name are open, and the ends that the rest of the page does not have: nothing is searched twice.
    n_open: Counter[str] = Counter()
    endless: set[str] = set()

    def close() -> None:
        nonlocal block
        text = _SPACE.sub(" ", entities.unescape("".join(block.parts))).strip()
        if text:
            block.text = text
            found.append(block)
        _, bad, good, heading, home = opened[-1] if opened else ("", CLEAN, 0, False, 0)
        block = Block(heading, bad, good, home)

    def end_of(name: str, pattern: re.Pattern, at: int) -> re.Match | None:
        end = None if name in endless else pattern.search(page, at)
        if end is None:
            endless.add(name)
        return end

    def put(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            put(page[at:])
            break
        put(page[at : tag.start()])
        at = tag.end()
        if not tag[2]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name in UNSEEN and not closing:
            if name in RAW or name in ("button", "select", "audio", "video", "canvas", "object", "map", "head", "datalist"):
                if name == "head":
                    end = end_of(name, re.compile(r"</head\s*>|<body\b", re.I), at)
                    at = (end.end() if end[0].startswith("</") else end.start()) if end else at
                elif not tag[4]:
                    end = end_of(name, re.compile(rf"</{name}\s*(?:>|\Z)", re.I), at)
                    at = end.end() if end else len(page) if name in ("script", "style") else at
                put(" ")
            continue
        if name == "br":
            put(" ")
        elif name == "a":
            links = 0
            keys = {key.lower() for key, _ in _ATTRIBUTE.findall(tag[3] or "")}
            # A named place is no link.
            if not closing and ("href" in keys or not keys & {"name", "id"}):
                following = _ANCHOR.search(page, at)
                links = 2 if following and following[1] else 1
        elif name in BLOCKS:
            if closing:
                while n_open[name]:
                    last = opened.pop()[0]
                    n_open[last] -= 1
                    if last == name:
                        break
                close()
            elif name == "hr" or name in VOID:
                close()
            else:
                while opened and name in CLOSES.get(opened[-1][0], ()):
                    n_open[opened.pop()[0]] -= 1
                _, was_bad, was_good, was_heading, home = opened[-1] if opened else ("", CLEAN, 0, False, 0)
                bad, good = _marks(name, tag[3], bool(was_good))
                serial += name in CONTAINERS
                # What stands in an article's own header, as a title does, is not the page's header.
                if name == "header" and was_good and not was_bad:
                    bad = CLEAN
                # Marks inside an article of others hold even where that article is the page's.
                elif bad and was_bad == PART and was_good:
                    bad = BAD
                n_open[name] += 1
                opened.append((name, max(bad, _within(was_bad, good)), max(good, was_good), name in HEADINGS or was_heading, serial if name in CONTAINERS else home))
                close()
            if links == 1:
                links = 0
    opened.clear()
    close()
    parts = [b for b in found if b.bad == PART and b.good]
    if parts and not any(_first(b) in ("good", "near") for b in found):
        for b in parts:
            b.bad = CLEAN
    return found


def _first(block: Block) -> str:
    if block.bad:
        return "bad"
    n = len(block.text)
    linked = block.linked / n
    if linked > LINKS:
        # An article may hold a list of links, such as its references.
        return "short" if block.good else "bad"
    if block.heading:
        return "heading"
    words = _WORD.findall(block.text.lower())
    dense = block.dense = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if n < SHORT:
        return "short"
    if dense >= MANY:
        return "good" if n >= LONG or block.good else "near"
    if dense >= FEW:
        return "near"
    return "near" if block.good or n >= LONG else "bad"


def _nearest(blocks: list[Block], homes: bool) -> list[str]:
    """The label of each block's nearest decided neighbour, in its own container or anywhere; "both" for a tie of the two."""
    n = len(blocks)
    labels, distance = [""] * n, [n + 1] * n
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            home = blocks[i].home if homes else 0
            if blocks[i].label in ("good", "bad"):
                last[home] = (i, blocks[i].label)
            elif home in last:
                at, label = last[home]
                if abs(i - at) < distance[i]:
                    labels[i], distance[i] = label, abs(i - at)
                elif abs(i - at) == distance[i] and label != labels[i]:
                    labels[i] = "both"
    return labels


def classify(blocks: list[Block]) -> None:
    """Labels every block good or bad."""
    for block in blocks:
        block.label = _first(block)
    if not any(b.label == "good" for b in blocks):
        # A page without a good block has its main text in the best of its near-good ones.
        near = [b for b in blocks if b.label == "near"]
        for block in [b for b in near if b.dense >= MANY] or near:
            block.label = "good"
    # Where even that is lacking, short blocks and headings are all there is.
    wordless = not any(b.label == "good" for b in blocks)
    found = []
    for block, own, anywhere in zip(blocks, _nearest(blocks, True), _nearest(blocks, False), strict=True):
        label = own or anywhere
        if block.label in ("good", "bad"):
            label = block.label
        elif block.good or not label or wordless:
            # Without a decided neighbour, what is on the page is all there is.
            label = "good"
        elif label == "both":
            label = "good" if block.label == "near" else "bad"
        found.append(label)
    for block, label in zip(blocks, found, strict=True):
        block.label = label


def main_text(page: str | None) -> str:
    """The main text of a page, a line a block."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df with text and n_chars."""
    rows = df.select(as_row(df.drop(html)), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__row", "text", "n_chars"])

    schema = rows.select("__row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return replace_columns(rows.mapInArrow(run, schema), "__row", {"text": F.col("text"), "n_chars": F.col("n_chars")})
