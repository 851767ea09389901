"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by its link density, its
length and the density of stop words. Short blocks and those in between stay undecided. In the second pass an undecided block
inherits the label of its nearest decided neighbours. Being inside `article` or `main` decides nothing. On a page
without any good block, the longest undecided one is good.

The kind of container (a tag such as `aside`, a class such as `comments`) is a further sign, as a reader's comment or a cookie
notice reads like main text. It raises what is asked of a block, but never decides alone: a long block with many stop
words stays undecided, and is good if its nearest decided neighbours on both sides are. A container that holds most of a page's good
text says nothing (a form or a widget around all of it), nor do any if no good text stands outside of them. A class counts
only if all its parts name such containers or layout: `comment-list` does, `related-work` doesn't.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their
there they this to was we were which will with you your
au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes moi mon ne nos nous
on ou par pas pour qu que qui sa se ses son sur te tu un une vos votre vous
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat
ich ihr im in ist kein mit nach nicht noch nur oder sehr sein sich sie sind so über um und von vor war was wie wir
zu zum zur
al algo como con cuando del desde donde el ella entre era es esta este esto está fue ha hay la las lo los más mi muy
no o para pero por porque que se sin sobre su sus también un una y ya
""".split()
)

_RAW = "script|style|noscript|template|textarea|iframe|svg|object|canvas|title|math"
_TOKEN = re.compile(rf"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>{_RAW})(?=[\s/>])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>(?P<inside>.*?)(?:</(?P=raw)\s*+>|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-z][^<>]*+>|<[!?/][^>]*+>""", re.S | re.I)
_HINT = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

#: Tags at which a block ends.
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that hold others and are kept open until they are closed.
_HOLDS = frozenset("article aside details dialog dir div dl fieldset figure footer form header label legend main menu nav ol optgroup option search section select span table ul button body td li blockquote p".split()) | _HEADINGS
#: What a paragraph that is still open doesn't reach beyond.
_BOUNDS = frozenset("td li div section article main form aside blockquote table".split())
#: Containers that speak against a block, by tag and by words of their class, id or role.
_BESIDE_TAGS = frozenset("nav footer aside form menu dialog select button fieldset search label legend option".split())
_BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer bottombar sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin search form comment comments respond reply replies discussion disqus feedback share sharing social related recommended recommendations toc pagination pager copyright complementary contentinfo toolbar skip outbrain taboola teaser teasers menubar dialog".split()
)
#: What may stand beside them in a name of several parts.
_LAYOUT = frozenset(
    "site main page top left right bottom upper lower list item items box bar wrapper wrap container content inner outer block area section zone col column row grid link links post posts article articles entry button buttons icon icons slot unit group title heading header text body panel card global primary secondary mobile desktop sticky fixed small large user users thread count meta info policy message messages js c m l".split()
)
#: The share of a page's good text from which on a container says nothing.
MOST = 0.8

#: First pass, in characters and shares.
LINKED, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.34, 80, 200, 0.12, 0.30
#: A heading belongs to a good block that begins within so many characters after it.
HEADING_REACH = 200


@dataclass
class Block:
    text: str
    linked: int = 0
    beside: bool = False
    heading: bool = False
    label: str = ""
    words: float | None = None  # the density of stop words, once it is known


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order; in one pass, whatever the nesting."""
    found: list[Block] = []
    parts: list[str] = []
    linked = links = articles = headings = 0
    stack: list[tuple[str, bool, int]] = []  # tag, whether it speaks against its blocks, and its first block
    against_: list[tuple[int, int]] = []  # first block and the one behind the last, of containers that do
    open_: dict[str, list[int]] = {}  # places in the stack of each tag, and of _BOUNDS

    def close():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, linked, heading=headings > 0))
        parts, linked = [], 0

    def heard(text: str):
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len("".join(text.split()))

    def entered(name: str, against: bool):
        nonlocal articles, headings
        for key in (name, "") if name in _BOUNDS else (name,):
            open_.setdefault(key, []).append(len(stack))
        stack.append((name, against, len(found)))
        articles += name in ("article", "main")
        headings += name in _HEADINGS

    def left(k: int):
        """Closes what stands in the stack from place k on."""
        nonlocal articles, headings
        while len(stack) > k:
            name, against, first = stack.pop()
            for key in (name, "") if name in _BOUNDS else (name,):
                open_[key].pop()
            if against and first < len(found):
                against_.append((first, len(found)))
            articles -= name in ("article", "main")
            headings -= name in _HEADINGS

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            heard(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if m["raw"] or not name:
            continue
        if name == "a":
            links = max(0, links + (-1 if m["end"] else 1))
        if name in _BLOCK:
            close()
        if name not in _HOLDS:
            continue
        places = open_.get(name)
        if m["end"]:
            if places:
                if name == "span" and stack[places[-1]][1]:
                    close()
                left(places[-1])
        elif not m["attrs"].rstrip().endswith("/"):
            if name == "body":
                left(0)
            elif name == "p" and places and places[-1] > (open_.get("") or [-1])[-1]:
                left(places[-1])  # a paragraph ends the one before it
            against = _speaks_against(name, m["attrs"], articles > 0)
            if name == "span" and against:
                close()
            entered(name, against)
    heard(page[at:])
    close()
    left(0)
    _mark_beside(found, against_)
    return found


def _mark_beside(found: list[Block], against: list[tuple[int, int]]) -> None:
    """Marks the blocks of containers that speak against them and hold less than most of the good text.

    Without any good text, all counts that is no link. If all of it is marked then, what stands in the fewest containers, and of these the one with
    most of it, is the text, and what holds it says nothing.
    """
    alone = [first_pass(b) for b in found]
    mass = [len(b.text) * (x == "good") for b, x in zip(found, alone, strict=True)]
    if not any(mass):
        mass = [max(0, len(b.text) - 2 * b.linked) * (x == "") for b, x in zip(found, alone, strict=True)]

    def marked(mass: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
        sums = [0, *accumulate(mass)]
        held = [(a, b) for a, b in against if sums[b] - sums[a] < MOST * sums[-1] or not sums[-1]]
        return _depths(len(found), held), held

    depths, held = marked(mass)
    least = min((d for d, m in zip(depths, mass, strict=True) if m), default=0)
    if least:
        mass = [m * (d == least) for m, d in zip(mass, depths, strict=True)]
        sums = [0, *accumulate(mass)]
        a, b = max(held, key=lambda span: sums[span[1]] - sums[span[0]])
        depths, _ = marked([m * (a <= k < b) for k, m in enumerate(mass)])
    for b, depth in zip(found, depths, strict=True):
        b.beside = depth > 0


def _depths(n: int, spans: list[tuple[int, int]]) -> list[int]:
    """How many spans each of n places stands in."""
    turns = [0] * (n + 1)
    for a, b in spans:
        turns[a] += 1
        turns[b] -= 1
    return list(accumulate(turns))[:n]


def _speaks_against(name: str, attrs: str, in_article: bool) -> bool:
    """Whether the container's kind speaks against its blocks. The header of an article doesn't."""
    if name in _BESIDE_TAGS or name == "header" and not in_article:
        return True
    if attrs and name not in ("body", "article", "main"):
        for key, *values in _HINT.findall(attrs):
            key, value = key.lower(), "".join(values).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            for parts in (re.split(r"[^a-z0-9]+", token) for token in value.split()):
                named = any(p in _BESIDE_WORDS or p == "header" and not in_article for p in parts)
                if named and all(p in _BESIDE_WORDS or p in _LAYOUT or not p or p.isdigit() for p in parts):
                    return True
    return False


_WORD = re.compile(r"[^\W\d_]+")


def _stops(block: Block) -> float:
    if block.words is None:
        words = _WORD.findall(block.text.lower())
        block.words = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return block.words


def first_pass(block: Block) -> str:
    """'bad', 'good', or '' where the block alone doesn't tell. More is asked of one whose container speaks against it: at best it stays undecided."""
    size = len(block.text)
    density = block.linked / max(1, size - block.text.count(" "))
    if density > LINKED or size < LONG and block.text.startswith("©"):
        return "bad"
    if block.beside:
        return "" if size >= LONG and density == 0 and _stops(block) >= MANY_STOPS else "bad"
    if size < SHORT:
        return "bad" if density > 0 else ""
    stops = _stops(block)
    return "good" if stops >= MANY_STOPS or stops >= FEW_STOPS and size >= LONG else ""


def labelled(found: list[Block]) -> list[Block]:
    """Both passes. What a container was held against says nothing of the blocks around it."""
    for b in found:
        b.label = first_pass(b)
    if not any(b.label == "good" for b in found):
        if any(b.beside and b.label == "" for b in found):  # all that reads like text stands in such containers
            for b in found:
                b.beside = False
                b.label = first_pass(b)
        longest = max((b for b in found if not b.label and not b.beside), key=lambda b: len(b.text), default=None)
        if longest and not any(b.label == "good" for b in found):
            longest.label = "good"
    told = [k for k, b in enumerate(found) if b.label and not b.beside]
    labels = [b.label for b in found]
    seen = -1  # the place in told of the nearest one before k
    reach = [0] * (len(found) + 1)  # characters up to the next one
    for k in range(len(found) - 1, -1, -1):
        reach[k] = 0 if found[k].label and not found[k].beside else reach[k + 1] + len(found[k].text)
    for k, b in enumerate(found):
        if b.label:
            seen += not b.beside
            continue
        before = told[seen] if seen >= 0 else None
        after = told[seen + 1] if seen + 1 < len(told) else None
        near = [(abs(x - k), found[x].label) for x in (before, after) if x is not None]
        if b.beside:
            labels[k] = "good" if [x for _, x in near] == ["good", "good"] else "bad"
        elif b.heading and after is not None and found[after].label == "good" and reach[k + 1] < HEADING_REACH or not near:
            labels[k] = "good"
        else:
            nearest = min(d for d, _ in near)
            labels[k] = "good" if any(d == nearest and x == "good" for d, x in near) else "bad"
    for b, x in zip(found, labels, strict=True):
        b.label = x
    return found


def main_text(page: str | None) -> str:
    """The good blocks in page order, joined by one space; empty if there is none."""
    return " ".join(b.text for b in labelled(blocks(page or "")) if b.label == "good")


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars.

    Whole pages of any length and nesting are read, in time that grows with their length; null counts as
    empty and gives an empty text. Repeated rows are repeated; other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = df.select(df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return out.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
