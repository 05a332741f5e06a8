"""Main text of HTML pages by two passes of block rules.

The first pass looks at each block alone: where it stands, its length, its
share of stop words and of text in links. It decides what is clear and leaves
short or middling blocks open. In the second pass open blocks take the label
of the nearest decided neighbour.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Frequent words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son les aux d l ou mais comme on elle nous vous tout cette été sans même être deux ont leur ses si".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está".split(),
}
STOPS = {k: frozenset(v) for k, v in STOP_WORDS.items()}
ALL_STOPS = frozenset().union(*STOPS.values())

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas video audio select textarea button head title".split())
#: Elements that are not part of the article, unless it stands in them.
APART = frozenset("nav footer aside menu dialog fieldset".split())
CONTAINERS = (BLOCK_TAGS | SKIPPED) - {"p", "hr"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("input select textarea button".split())
#: Words in class, id or role of what is not the article; those of the second list also name whole layouts.
FURNITURE = "ads? advert\\w* adsense sponsor\\w* nav(?:bar|igation|s)? menu\\w* breadcrumbs? footer foot cookies? consent gdpr notice notification alert newsletter subscribe signup login share sharing social related recommend\\w* morelinks comments? commentlist replies reply respond disqus discussion pagination pager skip contentinfo".split()
LAYOUT = "banner promo\\w* sidebar\\w* masthead topbar toolbar popup modal overlay search tags widgets? copyright legal disclaimer hidden complementary dialog form".split()
TALK = re.compile(r"comments?|commentlist|replies|reply|respond|disqus|discussion")
#: Words that may stand before and behind them in one name.
BEFORE = "site page main global top bottom left right primary secondary post entry article content wp the sub header mobile sticky user reader inline side author".split()
BEHIND = "left right top bottom bar box list area section wrapper wrap container inner content links? block items? panel module slot unit header title icons? buttons? text message \\d+".split()


def _names(nouns: list[str], others: list[str]) -> re.Pattern:
    """Whole names made of one of *nouns*, with words that may stand beside it."""
    noun, any_noun = "|".join(nouns), "|".join(nouns + others)
    return re.compile(rf"(?:(?:{'|'.join(BEFORE)}|{any_noun})[-_]+)*(?:{noun})(?:[-_]+(?:{'|'.join(BEHIND)}|{any_noun}))*", re.I)


FURNITURE_NAME, LAYOUT_NAME = _names(FURNITURE, LAYOUT), _names(LAYOUT, [])
MAIN_NAME = re.compile(r"(?:article|main|story)(?:[-_]?(?:body|content|text))?|(?:post|entry)[-_]?(?:content|body|text)", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|lang|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"""type\s*=\s*["']?hidden""", re.I)
WORD = re.compile(r"[^\W\d_]+")

# Rules of the first pass.
SHORT_CHARS = 70
LONG_CHARS = 200
MANY_STOPS = 0.32
SOME_STOPS = 0.30
MANY_LINKS = 0.2
MOSTLY_LINKS = 0.66
GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"
#: A form with less text, unless that is most of the page's, or with fewer words for each control, is furniture.
FORM_CHARS = 400
WORDS_A_CONTROL = 30


class Part:
    """An element that may stand apart from the article, and what is in it."""

    __slots__ = ("kind", "chars", "words", "mains", "controls")

    def __init__(self, kind: str):
        self.kind = kind
        self.chars = self.words = self.mains = self.controls = 0

    def apart(self, mains_elsewhere: int, page_chars: int) -> bool:
        if self.mains and not mains_elsewhere:
            return False
        if self.kind == "form":
            return self.words < WORDS_A_CONTROL * self.controls or (self.chars < FORM_CHARS and 2 * self.chars <= page_chars)
        return self.kind != "layout" or 2 * self.chars <= page_chars


class Block:
    __slots__ = ("text", "linked", "parts", "inside", "heading", "apart")

    def __init__(self, text: str, linked: int, parts: tuple[Part, ...], inside: bool, heading: bool):
        self.text, self.linked, self.parts, self.inside, self.heading = text, linked, parts, inside, heading
        self.apart = False


def _kind(name: str, given: dict[str, str], inside: bool) -> str | None:
    """Why an element may stand apart: by its tag, as a form, by its name, or by a name that layouts have too."""
    if name in ("body", "html", "main"):
        return None
    if name == "form":
        return "form"
    # A header belongs to the page unless it stands in the article.
    if name in APART or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or (name == "header" and not inside):
        return "tag"
    names = [t for k in ("class", "id", "role") for t in given.get(k, "").split()]
    if any(FURNITURE_NAME.fullmatch(t) for t in names):
        return "talk" if any(TALK.search(t) for t in names) else "name"
    return "layout" if any(LAYOUT_NAME.fullmatch(t) for t in names) else None


def _is_main(name: str, given: dict[str, str]) -> bool:
    names = [t for k in ("class", "id", "role") for t in given.get(k, "").split()]
    return name in ("article", "main") or given.get("itemprop", "").lower() == "articlebody" or any(MAIN_NAME.fullmatch(t) for t in names)


def _attributes(rest: str) -> dict[str, str]:
    return {name.lower(): (value or "").strip("\"'") for name, value in ATTRIBUTE.findall(rest)}


def blocks_of(page: str) -> tuple[list[Block], str]:
    """(text blocks in page order, language of the page)."""
    blocks: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, tuple[Part, ...], bool, bool]] = []  # element, parts it is in, inside main, heading
    lang, in_link, breaks = "", False, 0
    within: tuple[Part, ...] = ()
    alone: tuple[Part, ...] = ()
    inside = heading = False
    free_mains = 0

    def end() -> None:
        nonlocal in_link, breaks
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(links)).split()))
            blocks.append(Block(text, linked, within + alone, inside, heading))
            for part in within:
                part.chars += len(text) - linked
                part.words += text.count(" ") + 1
        parts.clear()
        links.clear()
        in_link, breaks = False, 0

    at = 0
    while at < len(page):
        match = TOKEN.search(page, at)
        text = page[at : match.start()] if match else page[at:]
        if text:
            if text.strip():
                breaks = 0
            parts.append(text)
            if in_link:
                links.append(text)
        if not match:
            break
        at = match.end()
        name = (match["name"] or match["name2"] or "").lower()
        if not name:
            continue
        closing = bool(match["close"] or match["close2"])
        rest = match["rest"] or match["rest2"] or ""
        if name in CONTROLS and not closing and not HIDDEN.search(rest):
            for part in within:
                part.controls += 1
        if name in SKIPPED and not closing:
            if rest.rstrip().endswith("/"):
                continue
            if name == "head":
                stop = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
            else:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            # An element that never ends hides nothing but its tag, save for scripts and styles.
            at = stop.end() if stop else (len(page) if name in ("script", "style") else at)
            continue
        if name == "html" and not closing:
            lang = _attributes(rest).get("lang", "")[:2].lower()
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                end()
        elif name in BLOCK_TAGS:
            end()
            # A paragraph may stand apart by its own name; it ends with the next block.
            alone = ()
            if name == "p" and not closing and (kind := _kind(name, _attributes(rest), inside)):
                alone = (Part(kind),)
            if name in CONTAINERS and name not in VOID:
                if closing:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
                elif not rest.rstrip().endswith("/"):
                    given = _attributes(rest)
                    _, around, was_inside, _ = stack[-1] if stack else ("", (), False, False)
                    main, kind = _is_main(name, given), _kind(name, given, was_inside)
                    # The article itself may have any name but that of a comment.
                    kind = kind if kind == "talk" or not main else None
                    if main and kind is None:
                        for part in around:
                            part.mains += 1
                        free_mains += not around
                    own = (*around, Part(kind)) if kind else around
                    stack.append((name, own, was_inside or (main and kind is None), name in HEADINGS))
                _, within, inside, heading = stack[-1] if stack else ("", (), False, False)
        elif name in ("label", "input") and not closing:
            parts.append(" ")
    end()
    page_chars = sum(len(b.text) - b.linked for b in blocks)
    for b in blocks:
        b.apart = any(part.apart(free_mains, page_chars) for part in b.parts)
    return blocks, lang


def stop_share(text: str, stops: frozenset[str]) -> float:
    words = WORD.findall(text.lower())
    return sum(w in stops for w in words) / len(words) if words else 0.0


def first_pass(blocks: list[Block], lang: str) -> list[str]:
    stops = STOPS.get(lang, ALL_STOPS)
    has_main = any(b.inside and not b.apart for b in blocks)
    labels = []
    for b in blocks:
        links = b.linked / len(b.text)
        if b.apart or (has_main and not b.inside):
            label = BAD
        elif has_main:
            # The page says where its article is: only blocks of links are decided against.
            if links > MOSTLY_LINKS and not b.heading:
                label = BAD
            elif len(b.text) < SHORT_CHARS:
                label = SHORT
            else:
                label = GOOD if stop_share(b.text, stops) >= SOME_STOPS else NEAR
        elif links > MANY_LINKS:
            label = BAD
        elif len(b.text) < SHORT_CHARS:
            label = BAD if b.linked else SHORT
        elif (share := stop_share(b.text, stops)) >= MANY_STOPS:
            label = GOOD if len(b.text) > LONG_CHARS else NEAR
        else:
            label = NEAR if share >= SOME_STOPS or len(b.text) > LONG_CHARS else SHORT
        labels.append(label)
    return labels


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is text: open ones as the nearest decided block of the page's body.

    At equal distance a heading goes with what follows it, a middling block is
    text and a short one goes with what precedes it. Blocks that stand apart by
    their element decide nothing. Without any decided block all open ones are text.
    """
    n = len(labels)
    decided = [i for i in range(n) if labels[i] in (GOOD, BAD) and not blocks[i].apart]
    if any(b.inside and not b.apart for b in blocks):
        decided = [i for i in decided if blocks[i].inside]
    before, after = [-1] * n, [-1] * n
    marks = set(decided)
    last = -1
    for i in range(n):
        before[i] = last
        last = i if i in marks else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if i in marks else last
    out = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        p, q = before[i], after[i]
        if p < 0 and q < 0:
            out.append(True)
        elif p < 0 or q < 0:
            out.append(labels[max(p, q)] == GOOD)
        elif labels[p] == labels[q]:
            out.append(labels[p] == GOOD)
        elif label == NEAR:
            out.append(True)
        elif i - p != q - i:
            out.append(labels[p if i - p < q - i else q] == GOOD)
        else:
            out.append(labels[q if blocks[i].heading else p] == GOOD)
    return out


def main_text(page: str) -> str:
    blocks, lang = blocks_of(page)
    keep = second_pass(blocks, first_pass(blocks, lang))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """*pages* (html, ...) with text, its main text, and n_chars, the code points of that.

    A null or empty html, and a page without text, give an empty text. Rows are
    handled one by one, whole, so repeated rows and nulls in other columns do
    not matter. Columns named text or n_chars are replaced.
    """

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return pages.withColumn("text", of(F.coalesce("html", F.lit("")))).withColumn("n_chars", F.length("text").cast("long"))
