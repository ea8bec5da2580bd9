"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classes each block by itself: what stands in navigation,
page headers and footers, side bars, notices, adverts, forms, comments, scripts or styles goes; then link density, length
and stop-word density make a block good, bad, nearly good or short. In the second pass the undecided ones inherit from
their nearest decided neighbours within the same region (article, main part or page). A region that the page itself marks
as its article counts as good at its ends, so that a headline or a two-word paragraph stays with it. Such a region stands for
the page only if it has a good part of the text that the page as a whole shows; else the wider one is taken.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
#: Part of a page's words that stop words are at least where it has a language of theirs.
STOP_KNOWN = 0.06
LINKS, LINKS_IN_ARTICLE = 0.2, 0.67
#: Least part of the main text by page-wide rules that an article or main part must hold to stand for the page.
MOST_OF_PAGE = 0.4

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their them there they this to was we were which who will with would you
aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sein sich sie sind so über um und unter vom von vor war wie wird wir zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous à été
al como con cuando del desde donde el ella ellos era es esta este está fue ha hay la las lo los más muy no nos o para pero por porque que se sin sobre su sus también un una y ya
""".split())
# Elements of HTML.
RAW = frozenset("script style noscript template iframe svg math textarea select canvas audio video object title".split())
DROPPED = frozenset("head nav footer aside form button dialog menu label input fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody thead tfoot tr caption ul".split())
SPACED = frozenset("br td th option".split())
# Words in class and id names, and roles, of what isn't the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus footer header masthead topbar login search toolbar copyright disclaimer pagination pager widget widgets skip hidden kommentar kommentare werbung anzeige anzeigen seitenleiste commentaire commentaires publicite comentario comentarios publicidad anuncio anuncios navegacion".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-z]+")


def _marked(tag: str, attributes: str) -> bool:
    """Whether an element's own attributes say that it isn't part of the article."""
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        what, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "").lower()
        if what in ("class", "id"):
            names.update(NAME.findall(value))
        elif what == "role" and value in ROLES or what == "hidden" or what == "aria-hidden" and value == "true" or what == "style" and re.search(r"display\s*:\s*none", value):
            return True
    if tag in ("html", "body", "main") or not names & MARKS or names & {"has", "with", "without", "no", "enabled", "disabled", "open", "closed"}:
        return False
    own = names & {"article", "post", "entry", "story", "content", "page", "main"}
    return not (own and names & MARKS <= {"header", "banner", "hidden", "menu", "sidebar"})


class Block:
    __slots__ = ("parts", "linked", "region", "text", "kind", "stops")

    def __init__(self, region: int):
        self.parts, self.linked, self.region, self.text, self.kind, self.stops = [], 0, region, "", "", -1.0


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks outside dropped elements, and the rank of each region: 0 the page, 1 a main part, 2 an article."""
    out, ranks = [], [0]
    stack: list[tuple[str, bool, int, bool]] = []  # tag, dropped, region, in a link
    opened: defaultdict[str, int] = defaultdict(int)  # of the stack, by tag
    dropped, region, linked, now = False, 0, False, Block(0)

    def end():
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(region)

    def shut(depth: int) -> None:
        nonlocal dropped, region, linked
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1
        dropped, region, linked = stack[-1][1:] if stack else (False, 0, False)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[7] is not None:
            if not dropped:
                text = html.unescape(m[7]) if "&" in m[7] else m[7]
                now.parts.append(text)
                if linked:
                    now.linked += len(text.strip())
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag closes up to its start, if there is one
            if tag in BLOCKS:
                end()
            if opened[tag]:  # what is searched is closed, so each element is passed once
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                if tag in BLOCKS:
                    end()
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if tag not in ("svg", "math") or not attributes.endswith("/"):  # no other element of these closes itself
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag in BLOCKS:
            if stack and stack[-1][0] == "p" or tag in ("li", "dd", "dt", "tr") and stack and stack[-1][0] == tag:
                shut(len(stack) - 1)
            elif tag not in ("p",) and any(s[0] == "p" for s in stack[-4:]) or tag == "p" and any(s[0] == "p" for s in stack[-6:]):
                depth = max(k for k in range(max(0, len(stack) - 6), len(stack)) if stack[k][0] == "p")
                if not any(s[0] in BLOCKS for s in stack[depth + 1 :]):  # formatting left open in a paragraph
                    shut(depth)
            end()
        elif tag in SPACED and not dropped:
            now.parts.append(" ")
        if tag in VOID:
            continue
        inside = tag != "header" or opened["article"] > 0 or opened["main"] > 0
        gone = dropped or tag in DROPPED or not inside or bool(attributes) and _marked(tag, attributes)
        if not gone and (tag in ("article", "main") or "articlebody" in attributes.lower()):
            rank = 1 if tag == "main" else 2
            if rank >= ranks[region]:
                ranks.append(rank)
                region = len(ranks) - 1
        opened[tag] += 1
        stack.append((tag, gone, region, linked or tag == "a"))
        dropped, linked = gone, linked or tag == "a"
        if tag in BLOCKS:
            now = Block(region)
    end()
    return out, ranks


def _known(found: list[Block]) -> bool:
    """Whether the page's language is one of the stop words': they are a part of its text without links that chance doesn't reach."""
    words = [w for b in found if not b.linked for w in WORD.findall(b.text.lower())]
    return not words or sum(map(STOP_WORDS.__contains__, words)) >= STOP_KNOWN * len(words)


def _first_pass(block: Block, article: bool, known: bool = True) -> str:
    n = len(block.text)
    if block.linked > (LINKS_IN_ARTICLE if article else LINKS) * n:
        return "bad"
    if n < SHORT:
        return "short"
    if not known:
        return "good" if n > LONG else "near"
    if block.stops < 0:
        words = WORD.findall(block.text.lower())
        block.stops = sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)
    stops = block.stops
    if article and stops < STOP_LOW and block.linked > LINKS * n:  # a list of links and names, not prose
        return "bad"
    if stops >= STOP_HIGH:
        return "good" if n > LONG else "near"
    if stops >= STOP_LOW:
        return "near"
    return "near" if article else "weak" if n > LONG and not block.linked else "bad"


def _second_pass(row: list[Block], article: bool) -> None:
    """Undecided blocks take the label of their nearest decided neighbours; ties go to good, near blocks need only one good side, and weak ones
    (long, but hardly prose) two."""
    labels = [b.kind for b in row]
    edge = "good" if article else "bad"
    before, last = [], (edge, -1)
    for k, x in enumerate(labels):
        before.append(last)
        if x in ("good", "bad"):
            last = (x, k)
    after, last = [None] * len(row), (edge, len(row))
    for k in range(len(row) - 1, -1, -1):
        after[k] = last
        if labels[k] in ("good", "bad"):
            last = (labels[k], k)
    for k, b in enumerate(row):
        if labels[k] in ("near", "short", "weak"):
            (left, i), (right, j) = before[k], after[k]
            if labels[k] == "weak":
                b.kind = "good" if left == right == "good" else "bad"
            elif left == right:
                b.kind = left
            elif labels[k] == "near":
                b.kind = "good"
            else:
                b.kind = left if k - i < j - k else right if j - k < k - i else "good"


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by empty lines; "" for null, an empty page or one without any."""
    if not page:
        return ""
    found, ranks = blocks(page)
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    found = [b for b in found if b.text]
    texts, known = {}, _known(found)
    for rank in (0, 1, 2):
        row = [b for b in found if ranks[b.region] >= rank]
        for b in row:
            b.kind = _first_pass(b, rank > 0, known)
        _second_pass(row, rank > 0)
        texts[rank] = [b.text for b in row if b.kind == "good"]
    size = {rank: sum(map(len, good)) for rank, good in texts.items()}
    for rank in (2, 1, 0):
        if texts[rank] and size[rank] >= MOST_OF_PAGE * max(size.values()):
            return "\n\n".join(texts[rank])
    # nothing decided: all that isn't mostly links
    return "\n\n".join(b.text for b in found if b.linked <= LINKS * len(b.text))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: ``key``, ``url``, text (main text) and n_chars (its code points), from the whole page.

    Null and empty pages have the text "". Broken and cut-off markup is read as far as it goes: an end tag without a start is
    ignored, an element that is never closed ends with its parent. Repeated rows each give a row; an empty table gives an
    empty one; other columns are not read, so extra columns cannot clash.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_page")
            text = [main_text(x.as_py()) for x in batch.column(at)]
            kept = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*[batch.schema.names[k] for k in kept], "text", "n_chars"])

    small_batches(pages.sparkSession)
    held = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.coalesce(F.col(f"`{page}`"), F.lit("")).alias("_page"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "_page")
    return held.mapInArrow(run, f"{kinds}, text string, n_chars long")
