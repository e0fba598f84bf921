"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by rules of stop-word density, length and link density, and by
where they stand: what is inside menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments is
boilerplate; text inside an article is content, links too. A class or id marks a container if it names just that (sidebar,
site-footer, share-buttons), not if it only has such a word in it (content-sidebar-wrap, elementor-widget-text-editor); a main or an
article inside a container marked that way stands for itself, but for articles inside reader comments, adverts and related pages. Blocks that are short and carry no such sign are ambiguous;
in the second pass they inherit the label of the nearest decided neighbour (the nearer by blocks; of two equally near, content wins). On a page on
which no block is decided as content they are its text. A paragraph or heading that is hidden or marked itself is boilerplate up to its end.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by two line feeds in page
order. Nothing else is dropped or cut. Tags that the page leaves open end with the page; an unfinished tag at its end is dropped.

Rows: a null or empty html gives an empty text. Repeated rows give a result each; a null url stays null. An empty table gives an
empty result. Other columns are ignored. Pages are handled where they are, in Arrow batches without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gradelake.llm.textcore import column

#: First-pass bounds: link density above which a block is boilerplate; words and stop-word density from which one outside an article is content; words of a short block.
MANY_LINKS, LONG_WORDS, DENSE, SHORT_WORDS = 0.5, 15, 0.2, 15
#: Frequent function words of the corpus' languages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui se ses son sont sur un une vous "
    "aber als am an auch auf aus bei das dem den der des die du ein eine einen er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über und von war wie zu zum zur "
    "al como con cuando de del el ella en entre era es esta este fue ha hay la las lo los más me muy no o para pero por que se sin sobre su sus también un una y ya".split()
)

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Tags that nest, and so tell where a block stands.
CONTAINER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header li main menu nav ol search section table td th tr ul select button title label span a".split())
#: Tags whose content is no text, up to their end tag.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video noembed noframes xmp".split())
FOREIGN = frozenset("svg math".split())
DROPPED = frozenset("aside button dialog fieldset footer form head menu nav search select title label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status toolbar".split())
#: Words in class or id that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments commentlist respond disqus cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login menu menus nav navbar navigation pagination pager footer masthead sidebar sidebars widget widgets related recommended recommendations share sharing social toolbar search skip replies reviews".split()
)

#: A quote opens a quoted value only behind an equals sign; elsewhere it is a character like any other. Nothing is tried twice.
ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)|<[A-Za-z/][^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"\w+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Classes that tell what a page has, as in has-sidebar, and not what this container is.
STATE = re.compile(r"(?:has|with|no|is|without)[-_]", re.I)
HAS = frozenset("has with no without".split())
#: Marks of parts that no prefix turns into something else, as in acme-sidebar.
STRONG = frozenset("breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr newsletter menu menus nav navbar navigation pagination pager footer masthead sidebar sidebars toolbar".split())
#: Marks of parts whose own articles are not the page's.
OTHERS = frozenset("ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored comment comments commentlist respond disqus replies related recommended recommendations reply".split())
#: Parts of a name that say where a marked container stands, before the mark, and what it is built of, after it.
BEFORE = frozenset("article body bottom blog content desktop entry float fixed global head header in inline js left local main mobile page post primary right secondary single site sticky sub the top web".split())
AFTER = frozenset("area articles bar banner block body bottom box btn button buttons card column col container content footer form group header heading holder icons inner item items left link links list main message outer panel posts primary region right section secondary slot text thread title top trail tree unit wrap wrapper".split())
#: Parts of a name before a mark that make what wraps both of them, as in content-sidebar-wrap.
WHOLE = frozenset("article body content entry main page post site text".split())

OPEN, ARTICLE, BAD, MARKED, ALIEN = 0, 1, 2, 3, 4


def marks_of(name: str, now: int) -> set[str]:
    """The marks that decide what a container of this class or id is; none if they are but some part of the name."""
    parts = [x.lower() for x in PARTS.findall(name)]
    at = [i for i, x in enumerate(parts) if x in MARKS or x == "header" and now == OPEN]
    if not at or STATE.match(name) or HAS & set(parts[: at[0]]):
        return set()
    before, marks, after = parts[: at[0]], {parts[i] for i in at}, [x for x in parts[at[0] :] if x not in MARKS and x != "header"]
    if "header" in marks and (len(marks) == 1 and parts[-1] != "header" or set(parts) & {"article", "entry", "post"}):
        marks.discard("header")
    if not marks or not AFTER.issuperset(after) or after and WHOLE & set(before):
        return set()
    known = BEFORE.issuperset(before) and not (before and marks <= {"widget", "widgets"})
    return marks if known or now != ARTICLE and not after and marks & (STRONG | {"header"}) else set()


def standing(tag: str, attributes: str, now: int, inside_article: bool) -> int:
    """Where the content of a container stands: OPEN, in an ARTICLE, BAD (boilerplate), or boilerplate by a class or id only, in which a main
    or article stands for itself (MARKED) or only a main does (ALIEN)."""
    if now == BAD or tag in DROPPED or tag == "header" and not inside_article:
        return BAD
    marks, role = set(), ""
    if attributes.strip():
        found = {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in ROLES:
            return BAD
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        if tag not in ("body", "html"):
            marks = set().union(*(marks_of(x, now) for x in names))
        if tag in ("article", "main"):
            marks &= {"comment", "comments", "reply"}
    if marks:
        return max(now, ALIEN if marks & OTHERS else MARKED)
    if tag == "main" or role == "main":
        return ARTICLE
    return ARTICLE if (tag == "article" or role == "article") and now != ALIEN else now


def raw_end(page: str, tag: str, at: int, closed: bool) -> int:
    """Where the content of a tag like script ends whose start tag ends at ``at``. A slash in the start tag closes foreign elements only; on others
    it tells nothing, unless no end tag follows, or another start tag of the kind comes first."""
    if closed and tag in FOREIGN:
        return at
    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    if closed and (close is None or re.compile(rf"<{tag}(?=[\s/>])", re.I).search(page, at, close.start())):
        return at
    return close.end() if close else len(page)


class Block:
    __slots__ = ("linked", "place", "text")

    def __init__(self, text: str, linked: int, place: int) -> None:
        self.text, self.linked, self.place = text, linked, place


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order, with the characters of links in them and where they stand."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    place, links, text, linked, own = OPEN, 0, [], 0, None

    def flush() -> None:
        nonlocal linked, own
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, linked, place if own is None else max(own, place)))
            text.clear()
        linked, own = 0, None

    at, end, find = 0, len(page), TOKEN.match
    while at < end:
        m = find(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        if page[at - 1] != ">":
            break  # the page ends inside this tag
        tag = tag.lower()
        if tag in RAW and not m[1]:
            at = raw_end(page, tag, at, m[3].endswith("/"))
            text.append(" ")
            continue
        if tag == "br" or tag in ("td", "th"):
            text.append(" ")
        if tag in BLOCK and tag not in ("td", "th"):
            flush()
            if tag not in CONTAINER and not m[1] and m[3].strip():
                own = standing(tag, m[3], place, False)
        if tag == "a":
            links = 0 if m[1] else 1
        if tag in CONTAINER and tag not in VOID:
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if stack[i][1] != place:
                            flush()
                        place = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] in ("article", "nav", "body", "main", "aside", "footer", "form", "table") and tag in ("span", "a", "label", "li", "button"):
                        break  # an inline end tag does not end what stands around it
            else:
                new = standing(tag, m[3], place, any(t in ("article", "main") for t, _ in stack) if tag == "header" else False)
                if new != place:
                    flush()
                stack.append((tag, place))
                place = new
    flush()
    return out


def first_pass(block: Block) -> bool | None:
    """True for content, False for boilerplate, None if it is not decided."""
    if block.place >= BAD:
        return False
    if block.place == ARTICLE:
        return True
    if block.linked > MANY_LINKS * len(block.text):
        return False
    words = WORD.findall(block.text.lower())
    dense = sum(w in STOP_WORDS for w in words) >= DENSE * len(words)
    if len(words) >= LONG_WORDS and dense:
        return True
    return None if len(words) < SHORT_WORDS or dense or block.place == OPEN and not block.linked else False


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one; on a page without decided content they are content."""
    if True not in labels:
        return [x is None for x in labels]
    n = len(labels)
    before, after = [(n + 1, False)] * n, [(n + 1, False)] * n
    last = None
    for i, x in enumerate(labels):
        last = i if x is not None else last
        if last is not None:
            before[i] = (i - last, labels[last])
    last = None
    for i in range(n - 1, -1, -1):
        last = i if labels[i] is not None else last
        if last is not None:
            after[i] = (last - i, labels[last])
    return [x if x is not None else (b[1] or a[1] if b[0] == a[0] else min(b, a)[1]) for x, b, a in zip(labels, before, after, strict=True)]


def extract(page: str | None) -> str:
    found = blocks(page or "")
    keep = second_pass([first_pass(b) for b in found])
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [extract(x) for x in column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "page_id").cast(pa.int64()), column(part, "url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
