"""Main text of web pages by tag-path ratios.

One pass per page, without a shuffle, linear in its length. A tolerant tokenizer keeps the stack of open
elements; each piece of text belongs to its root-to-leaf tag path. Only what HTML itself says is no article
is left out beforehand: scripts and the like, menus, forms, asides, footers, hidden elements, and headers
that are not an article's own. Of the rest, text length, punctuation and linked text are summed per path;
each path's mean length and mean punctuation are smoothed over neighbouring pieces of the page and fused by
a product of their logarithms. Two priors weigh a path's score: an element whose class, id or role names an
advert, notice, comments and the like (``DOUBT``, ``OTHER``), and text outside of the article or main element
of a page that has one (``OUTSIDE``). Paths under a share of the page's best score are dropped, as are paths
that are nearly all links; in an article element, and without doubt, the share is lower.

A class that also names content ("post related-topic") or a layout ("with-sidebar") is no doubt, nor is one
on an element that holds most of the text, unless it names comments, adverts, consent or related pages. A
list or table between kept pieces of the element that holds it is kept with all it holds, unless it is nearly
all links. Headings stay if content follows.

Selected text becomes blocks: broken at block elements and line breaks, character references decoded,
white space made one space, joined by one newline.

Defined cases: null, empty and markup-free pages (whose text is one path, so content); unclosed tags,
quotes and comments (a comment or script without end takes the rest, a "<" without any ">" after it is
text); repeated rows each give a row; null ids and urls stay null; extra columns are kept only if asked for,
and if they are called text or n_chars, the new ones get underscores before their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .blocks import Block
from .common import fresh, map_blocks, table

#: Shares of the best path's score under which a path is no content: in an article element, else.
SHARE_IN_ARTICLE, SHARE = 0.02, 0.48
#: Weights of elements that are named as no article, as surely none, and of text outside of the article element.
DOUBT, OTHER, OUTSIDE = 0.3, 0.1, 0.4
#: Share of linked text from which a path is a menu.
LINKED = 0.7
#: Pieces to either side that smooth a path's ratios.
REACH = 2

_STOP = re.compile(r"[\"'>]")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")

#: Element names by what they mean in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg annotation object canvas select xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom".split())
_NEVER = frozenset("head title nav footer aside form button menu dialog fieldset datalist option".split())
_ENDS_P = frozenset("address article aside blockquote details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl table".split())
#: Words in classes, ids and roles of what is not article text.
_SAYS_NOT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion promoted sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead topbar cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond reply replies discussion widget widgets toolbar pagination pager copyright disclaimer search searchbox complementary contentinfo dialog hidden".split()
)
#: Words that make a name one of a layout ("with-sidebar", "overflow-hidden") and not of the part itself.
_LAYOUT = frozenset("with has have no not without overflow layout open opened enabled active".split())
#: Parts that are no article however much of the page's text they hold.
_OTHERS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors related recommended recommendations comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr".split())
#: Words that make a class one of content, whatever else it says.
_CONTENT = frozenset("article post hentry entry content story main".split())
_WHOLE = frozenset("html body main article".split())
_KEPT, _DOUBT, _OTHER, _TAKEN = 0, 1, 2, 3


def _not_article(name: str, tag: str, inside: bool) -> int:
    """What an element says of its text: nothing, that it may be no article, that it surely is none, or that it is left out."""
    if name in _NEVER or name == "header" and not inside:
        return _TAKEN
    if "=" not in tag and "hidden" not in tag.lower():
        return _KEPT
    verdict, content = _KEPT, False
    for key, value in _ATTRIBUTE.findall(tag, 1 + len(name)):
        key, value = key.lower(), value.strip("\"'").lower()
        if name not in _WHOLE and (key == "hidden" or key == "aria-hidden" and value == "true"):
            return _TAKEN
        for said in value.split() if key in ("class", "id", "role") else ():
            words = [w for w in re.split(r"[^a-z0-9]+", said) if w]
            if not _LAYOUT.isdisjoint(words) or "hidden" in words and len(words) > 1:
                continue
            if not _OTHERS.isdisjoint(words):
                verdict = _OTHER
            elif not _SAYS_NOT.isdisjoint(words) or "side" in words and "bar" in words:
                verdict = max(verdict, _DOUBT)
            else:
                content = content or not _CONTENT.isdisjoint(words)
    return _KEPT if content or name in ("html", "body") else verdict


@dataclass(frozen=True)
class Piece:
    """Text with its block, the number of its path, whether it is linked, in an article element and in a heading, the innermost element in doubt, and the outermost list."""

    block: int
    path: int
    text: str
    linked: bool
    inside: bool
    heading: bool
    doubt: int
    list: int


class Walk:
    """The pieces of text of a page that may be content."""

    def __init__(self, page: str):
        self.pieces: list[Piece] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.doubts: list[tuple[int, int]] = [(-1, _KEPT)]  # what each is in, and what it says
        self.holders: dict[int, list[int]] = {}  # of a list's number, the first and (excluded) last piece of the element that holds it
        self._read(page)

    def _tag_end(self, page: str, at: int) -> int:
        """The place after a tag, quoted values apart; a quote without end counts as no quote."""
        where = at
        while m := _STOP.search(page, where):
            if m[0] == ">":
                return m.end()
            close = page.find(m[0], m.end())
            if close < 0:
                return page.find(">", at) + 1
            where = close + 1
        return page.find(">", at) + 1

    def _read(self, page: str) -> None:
        # of the open elements: name, verdict, path, doubt, outermost list, first piece
        stack: list[tuple[str, int, int, int, int, int]] = []
        many: Counter[str] = Counter()
        out, lists, block, at, last = 0, 0, 0, 0, page.rfind(">")
        waiting: list[list[int]] = [[]]  # lists whose holder is open, by depth

        def text(said: str) -> None:
            if not out:
                _, _, path, doubt, list_, _ = stack[-1] if stack else ("", 0, -1, 0, -1, 0)
                heading = any(many[h] for h in _HEADINGS)
                self.pieces.append(Piece(block, self.paths.setdefault((path, ""), len(self.paths)), said, many["a"] > 0, many["article"] + many["main"] > 0, heading, doubt, list_))

        while at < len(page):
            begin = page.find("<", at)
            if begin != at:
                text(page[at : begin if begin >= 0 else len(page)])
                if begin < 0:
                    break
                at = begin
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            if at > last:
                text(page[at:])
                break
            if page[at + 1 : at + 2] in ("!", "?"):
                at = page.find(">", at) + 1
                continue
            m = _TAG.match(page, at)
            if not m:
                text("<")
                at += 1
                continue
            begin, at = at, self._tag_end(page, m.end())
            token, name, closing = page[begin:at], m[1].lower(), page[begin + 1] == "/"
            if name in _RAW and not closing:
                if not token.endswith("/>"):
                    end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                    close = page.find(">", end.end()) if end else -1
                    at = close + 1 if close >= 0 else len(page)
                continue
            block += name not in _INLINE and name not in _RAW
            drop = len(stack)
            if closing:
                if many[name]:
                    drop = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
            elif name in _VOID:
                continue
            elif name in _ENDS_P and many["p"]:  # a paragraph without end ends here
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        drop = i
                    if stack[i][0] not in _INLINE:
                        break
            for gone, took, _, _, _, first in reversed(stack[drop:]):
                out -= took == _TAKEN
                many[gone] -= 1
                for x in waiting.pop():
                    self.holders[x] = [first, len(self.pieces)]
            del stack[drop:]
            if not closing and not token.endswith("/>"):
                took = _not_article(name, token, many["article"] + many["main"] > 0)
                _, _, path, doubt, list_, _ = stack[-1] if stack else ("", 0, -1, 0, -1, 0)
                if took in (_DOUBT, _OTHER):
                    self.doubts.append((doubt, took))
                    doubt = len(self.doubts) - 1
                if name in _LISTS and list_ < 0 and stack:
                    list_, lists = lists, lists + 1
                    waiting[-1].append(list_)
                path = self.paths.setdefault((path, name + "!" * took), len(self.paths))
                stack.append((name, took, path, doubt, list_, len(self.pieces)))
                waiting.append([])
                out += took == _TAKEN
                many[name] += 1
        for entry in reversed(stack):
            for x in waiting.pop():
                self.holders[x] = [entry[5], len(self.pieces)]

    def weights(self) -> np.ndarray:
        """Of each piece: what the elements that it is in take from its score."""
        whole = any(p.inside and p.text.strip() for p in self.pieces)
        held = [0] * len(self.doubts)
        for p in self.pieces:
            held[p.doubt] += len(p.text.strip()) if p.inside or not whole else 0
        everything = sum(held)
        for i in range(len(held) - 1, 0, -1):
            held[self.doubts[i][0]] += held[i]
        weight = [1.0] * len(held)
        for i, (up, took) in enumerate(self.doubts[1:], 1):
            sure = took == _OTHER or 2 * held[i] <= everything
            weight[i] = max(1e-9, weight[up] * ((OTHER if took == _OTHER else DOUBT) if sure else 1.0))
        return np.array([weight[p.doubt] * (1.0 if p.inside or not whole else OUTSIDE) for p in self.pieces])


def _between(found: list[Piece], holders: dict[int, list[int]], number: np.ndarray, chosen: np.ndarray, length: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Pieces of lists and tables that lie between chosen pieces of the element that holds them. ``number``: the pieces' places in the page."""
    in_list = np.array([p.list for p in found])
    sure = np.concatenate([[0], np.cumsum(chosen & (in_list < 0))])
    out = np.zeros(len(found), bool)
    of = np.flatnonzero(in_list >= 0)
    of = of[np.argsort(in_list[of], kind="stable")]
    for mine in np.split(of, np.flatnonzero(np.diff(in_list[of])) + 1) if len(of) else []:
        lo, hi = np.searchsorted(number, holders[int(in_list[mine[0]])])
        before, after = sure[mine[0]] - sure[lo], sure[hi] - sure[mine[-1] + 1]
        if before > 0 and after > 0 and (length[mine] * linked[mine]).sum() < LINKED * length[mine].sum():
            out[mine] = True
    return out


def main_text(page: str | None) -> str:
    walk = Walk(page or "")
    number = np.array([i for i, p in enumerate(walk.pieces) if p.text.strip()], np.int64)
    if not len(number):
        return ""
    weight = walk.weights()[number]
    found = [walk.pieces[i] for i in number.tolist()]
    texts = [html.unescape(p.text) for p in found]
    path = np.unique(np.array([p.path for p in found]), return_inverse=True)[1]
    length = np.array([len(" ".join(t.split())) for t in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
    linked = np.array([p.linked for p in found], float)
    count = np.bincount(path)
    total = np.maximum(np.bincount(path, length), 1)
    share_linked = np.bincount(path, length * linked) / total

    def smooth(x: np.ndarray) -> np.ndarray:
        """Per path, the mean of a path ratio over its pieces' neighbourhoods."""
        sums = np.concatenate([[0], np.cumsum(x[path])])
        i = np.arange(len(path))
        lo, hi = np.maximum(i - REACH, 0), np.minimum(i + REACH + 1, len(path))
        return np.bincount(path, (sums[hi] - sums[lo]) / (hi - lo)) / count

    score = np.log1p(smooth(total / count)) * (1 + np.log1p(smooth(np.bincount(path, marks) / count)))
    weighed = score[path] * weight
    surely = np.array([p.inside for p in found]) & (weight == 1)
    chosen = (weighed >= np.where(surely, SHARE_IN_ARTICLE, SHARE) * weighed.max()) & (share_linked[path] < LINKED)
    chosen |= _between(found, walk.holders, number, chosen, length, linked) & (weight >= weight.max())
    heading = np.array([p.heading for p in found])
    for i in range(len(found) - 1, -1, -1):  # a heading stays with what it heads
        if heading[i] and not linked[i]:
            chosen[i] = i + 1 < len(found) and chosen[i + 1] or chosen[i] and not heading.all()
    if heading.all():
        chosen |= True
    # a block stays whole if at least half of its text is content: links and emphasis are part of it
    block = np.unique(np.array([p.block for p in found]), return_inverse=True)[1]
    kept = np.bincount(block, length * chosen) * 2 >= np.bincount(block, length)
    blocks: dict[int, list[str]] = {p.block: [] for p, b in zip(found, block, strict=True) if kept[b]}
    for p in walk.pieces:  # with the white space between its inline elements
        if p.block in blocks:
            blocks[p.block].append(html.unescape(p.text))
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (with the column html) with text and n_chars; of its columns those named ``keep`` (all if None)."""
    kept = pages.select(*keep) if keep is not None else pages
    text, n_chars = fresh(kept, "text"), fresh(kept, "n_chars")

    def made(block: Block) -> dict[str, object]:
        texts = [main_text(block.bytes_of(i).decode("utf-8", "replace")) for i in range(block.n)]
        return {text: texts, n_chars: [len(t) for t in texts]}

    return map_blocks(pages, made, f"`{text}` string, `{n_chars}` long", text="html", keep=keep)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
