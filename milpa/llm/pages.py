"""Main text of web pages by consensus of their host.

Each page's containers are scored by the text of their paragraphs, less link text, fading with depth. The best container is widened to the
article around it, or else to its parents as long as what stands beside it is low in links, and votes for its generalised path (tags with
their first class, digits as N) among all pages of its host; votes are counted in Spark. Every page is then extracted again from the
containers at its host's winning path, or, where it has none, from its own. Where the host's path holds but a small part of the text of the
page's own path, both are taken. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever they stand.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milpa.llm._shared import slices, written

#: Winning paths of all hosts are broadcast up to so many bytes; beyond, pages of one host are dealt to ``SALTS`` tasks.
BROADCAST_BYTES, SALTS = 64 << 20, 64

#: What may stand in a tag whose quoted parts hold no ``<``; no part runs beyond the next one.
_INSIDE = r"""(?:[^<>"'/]|/(?!>)|"[^"<]*+"|'[^'<]*+')*+/?"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|</?([a-zA-Z][a-zA-Z0-9:-]*+)({_INSIDE})>|<[!?][^<>]*+>|[^<]+|<", re.S)
_NAME, _REST, _STOP = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)"), re.compile(r"[^<>]*+>"), re.compile(r"[<>\"']")
#: Elements that are left out with all they hold, of which the first are never without an end.
_SWALLOWS, _LEFT_OUT = frozenset(("script", "style")), frozenset("template textarea iframe svg title select button object".split())
_SAME = {t: re.compile(rf"</{t}\s*>" if t in _SWALLOWS else rf"<(/?){t}(?![\w:-])[^<>]*+>?", re.I) for t in _SWALLOWS | _LEFT_OUT}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_OUT = frozenset("nav header footer aside form menu dialog head".split())
#: Starts of these end an element of ``_LEFT_OUT`` that has no end of its own.
_STARTS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre header footer nav aside form figure address li dt dd tr td th tbody".split())
_CONTAINER = frozenset("article main section div td body center".split())
#: Words of classes, ids and roles that mark what isn't the article; those that do so only where no other word stands with
#: them; and words for parts, which say nothing themselves.
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted sidebar sponsor sponsored subscribe toolbar widget widgets".split()
)
_OUT_ALONE = frozenset("byline related recommended search share sharing signup social".split())
_PARTS = frozenset(
    "area articles author bar block body bottom box buttons consent container content count element footer group holder icons inner item items left line link links list main meta outer overlay panel posts primary reply right row secondary section slot text thread title top unit wrap wrapper".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A host's path with less than a quarter of the text of the page's own is not trusted alone, if the latter has this many characters.
_LEAST_PART, _LEAST_OWN = 0.25, 250
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
_SPACE = re.compile(r"\s+")


def _marks_out(name: str) -> bool:
    """Whether a class, id or role is one of what isn't the article: ``ad-slot``, ``site-header``, ``share-links``, but not ``ad-hoc`` or ``share-price``."""
    words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
    said = [w for w in words if w in _OUT_WORDS or w not in _PARTS]
    return bool(said) and (said[-1] in _OUT_WORDS or all(w in _OUT_WORDS or w in _OUT_ALONE for w in said))


def _tag_end(page: str, at: int, ends: dict[int, int]) -> int:
    """Where the tag ends of which ``at`` is inside, its quoted parts read whole; -1 if it has no end. What was found from a place is kept
    in ``ends``, so that all tags of a page together read it once."""
    passed = []
    while at not in ends:
        passed.append(at)
        stop = _STOP.search(page, at)
        if stop is None or stop[0] == "<":
            ends[at] = -1
        elif stop[0] == ">":
            ends[at] = stop.end()
        else:
            close = page.find(stop[0], stop.end()) + 1
            if not close:
                ends[at] = -1
            else:
                at = close
    for x in passed:
        ends[x] = ends[at]
    return ends[at]


def _tokens(page: str):
    """``text, None, ""`` for texts, ``tag, name, attributes`` for tags; comments, scripts, styles and what else is left out whole are passed over."""
    at, ends = 0, {}
    while at < len(page):
        m = _TOKEN.match(page, at)
        whole, tag, attributes = m[0], m[1], m[2]
        start, at = at, m.end()
        if tag is None:
            if whole == "<" and (name := _NAME.match(page, start)):
                end = _tag_end(page, name.end(), ends)
                if end < 0 and (rest := _REST.match(page, name.end())):
                    end = rest.end()
                if end > 0:
                    whole, tag, attributes, at = page[start:end], name[1], page[name.end() : end - 1], end
            if tag is None:
                if whole[0] != "<" or whole == "<":
                    yield whole, None, ""
                continue
        tag = tag.lower()
        if tag in _SAME and whole[1] != "/":
            if tag == "svg" and _SELF_CLOSED.search(attributes):
                continue
            same = _SAME[tag].search(page, at)
            if tag in _SWALLOWS:
                at = same.end() if same else len(page)
                continue
            if same and same[1]:
                at = same.end()
                continue
        yield whole, tag, attributes


class Page:
    """Blocks of text in page order, and the containers above them."""

    def __init__(self, html: str | None):
        # a path is a number: its parent's path and its last name, so that deep pages don't hold long texts for every element
        self.steps: dict[tuple[int, str], int] = {(-1, "body"): 0}
        self.paths, self.parents, self.tags, self.out = [0], [-1], ["body"], [False]
        self.blocks: list[tuple[int, str, float]] = []  # container or block element, text, share of it in links
        stack, text, linked, in_link = [0], [], 0, 0
        inline: list[tuple[str, int, bool]] = []  # open inline elements: tag, blocks open around it, whether it is left out
        left_out, opened = 0, dict.fromkeys(_INLINE | _LEFT_OUT, 0)

        def close_inline(tag: str | None = None) -> None:
            nonlocal left_out
            while inline and (tag or inline[-1][1] > len(stack)):
                name, _, out = inline.pop()
                opened[name] -= 1
                left_out -= out
                if name == tag:
                    break

        for whole, tag, attributes in _tokens(html or ""):
            if tag is None:
                if not left_out:
                    text.append(whole)
                    linked += len(whole) if in_link else 0
                continue
            closing = whole[1] == "/"
            if tag in _VOID:
                if tag in ("br", "hr"):
                    text.append(" ")
                continue
            if tag in ("html", "body"):
                continue
            if tag in _INLINE:
                if tag == "a":
                    in_link = 0 if closing else 1
                if closing and opened[tag]:
                    close_inline(tag)
                elif not closing and not _SELF_CLOSED.search(attributes):
                    inline.append((tag, len(stack), self._named_out(attributes)))
                    opened[tag] += 1
                    left_out += inline[-1][2]
                continue
            if tag in _LEFT_OUT and not closing:
                inline.append((tag, len(stack), True))
                opened[tag] += 1
                left_out += 1
                continue
            loose = [n for n in _LEFT_OUT if opened[n]] if left_out else []
            if tag in _LEFT_OUT or loose and not closing:
                for name in loose if tag in _STARTS else {tag}.intersection(loose):
                    while opened[name]:
                        close_inline(name)
                if tag not in _STARTS:
                    continue
            self._flush(stack[-1], text, linked)
            text, linked = [], 0
            if closing:
                if tag in (self.tags[n] for n in stack[1:]):
                    while self.tags[stack.pop()] != tag:
                        pass
                    in_link = 0
                    close_inline()
                continue
            if self.tags[stack[-1]] == "p" or self.tags[stack[-1]] in _CLOSES.get(tag, ()):
                stack.pop()
                close_inline()
            self._open(tag, attributes, stack, left_out > 0)
        self._flush(stack[-1], text, linked)

    @staticmethod
    def _named_out(attributes: str) -> bool:
        return bool(attributes) and any(_marks_out(name) for a in _ATTRIBUTE.finditer(attributes) for name in (a[2] or a[3] or a[4] or "").lower().split())

    def _open(self, tag: str, attributes: str, stack: list[int], left_out: bool) -> None:
        name = tag
        if attributes:
            named = {a[1].lower(): (a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(attributes)}
            first = (named.get("class") or named.get("id") or "").split()
            if first:
                name += "." + re.sub(r"\d+", "N", first[0].lower())
        parent = stack[-1]
        self.out.append(self.out[parent] or left_out or tag in _OUT or self._named_out(attributes))
        self.paths.append(self.steps.setdefault((self.paths[parent], name), len(self.steps)))
        self.parents.append(parent)
        self.tags.append(tag)
        stack.append(len(self.tags) - 1)

    def _flush(self, node: int, text: list[str], linked: int) -> None:
        if text and not self.out[node]:
            whole = "".join(text)
            clean = _SPACE.sub(" ", entities.unescape(whole)).strip()
            if clean:
                self.blocks.append((node, clean, min(1.0, linked / len(whole))))

    def best(self) -> tuple[str, float] | None:
        """Path of the best container, widened, and its score; of equal ones the outermost, first."""
        score: dict[int, float] = {}
        for node, text, link in self.blocks:
            worth = len(text) * (1 - link)
            while node >= 0 and worth >= 1:
                if self.tags[node] in _CONTAINER:
                    score[node] = score.get(node, 0.0) + worth
                    worth *= 0.5
                node = self.parents[node]
        if not score:
            return None
        node = max(score, key=lambda n: (score[n], -n))
        return self.written(self.paths[self._widened(node)]), score[node]

    def written(self, path: int) -> str:
        """A path as text."""
        steps, names = list(self.steps), []
        while path >= 0:
            path, name = steps[path]
            names.append(name)
        return ">".join(reversed(names))

    def path(self, written: str | None) -> int | None:
        """The path that a text names, if the page has it."""
        at: int | None = -1
        for name in (written or "").split(">"):
            at = self.steps.get((at, name))
            if at is None:
                return None
        return at

    def _widened(self, node: int) -> int:
        """The article around ``node``, or the outermost parent up to which all other text is low in links; only what adds text counts."""
        around = node
        while around >= 0 and self.tags[around] != "article":
            around = self.parents[around]
        if around >= 0:
            return around
        whole, linked = [0.0] * len(self.tags), [0.0] * len(self.tags)
        for n, text, link in self.blocks:
            whole[n] += len(text)
            linked[n] += len(text) * link
        same: dict[tuple[int, int], list[float]] = {}  # text and links of the elements at one path in one parent
        for n in range(len(self.tags) - 1, 0, -1):
            p = self.parents[n]
            of = same.setdefault((p, self.paths[n]), [0.0, 0.0])
            for total, k in ((whole, 0), (linked, 1)):
                total[p] += total[n]
                of[k] += total[n]
        widest = node
        while node > 0 and self.tags[node] != "main":
            p = self.parents[node]
            mine = same[p, self.paths[node]]
            more, links = whole[p] - mine[0], linked[p] - mine[1]
            if links > 0.5 * more:
                break
            widest, node = p if more >= 1 else widest, p
        return widest

    def _inside(self, paths: tuple[str | None, ...]) -> list[bool]:
        wanted = {self.path(x) for x in paths}
        inside = [p in wanted for p in self.paths]
        for n in range(1, len(inside)):
            inside[n] |= inside[self.parents[n]]
        return inside

    def unlinked(self, path: str) -> float:
        """Characters inside the elements at ``path`` that are not in links."""
        inside = self._inside((path,))
        return sum(len(text) * (1 - link) for node, text, link in self.blocks if inside[node])

    def text(self, *paths: str | None) -> str:
        """Blocks inside the elements at any of ``paths``, joined by line breaks."""
        inside = self._inside(paths)
        return "\n".join(text for node, text, _ in self.blocks if inside[node])


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1)), r"^www\.", ""), F.lit(""))


def _vote(batches):
    for batch in slices(batches, "html"):
        best = [Page(x).best() for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([b and b[0] for b in best], pa.string()), pa.array([b and b[1] for b in best], pa.float64())], names=["host", "path", "score"])


def _extract(batches):
    for batch in slices(batches, "html"):
        texts, used = [], []
        for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
            page = Page(html)
            best = page.best()
            own = best and best[0]
            if page.path(path) is None:
                path = own
            if own != path and (much := page.unlinked(own) if own else 0) >= _LEAST_OWN and page.unlinked(path) < _LEAST_PART * much:
                texts.append(page.text(path, own))
                used.append(own)
            else:
                texts.append(page.text(path))
                used.append(path)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: each host's winning path, by pages, then by score, then by name."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, score double").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("w")).select("host", "w.path", "w.votes")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html, ...)``: ``page_id, url, text, n_chars, path``.

    What begins like a tag but has no end is text; an element left out that has no end tag of its own ends where the next block, or its parent, does.
    A very long page is worked whole in one task; of paths with equal votes and scores the last by name wins.
    Null and empty html have an empty text and no path; pages without a url, or with one that names no host, vote together. Repeated rows
    vote and are returned each. Further columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("host", host_of(F.col("url")))
    winners = written(host_paths(pages))
    if winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:  # more hosts than every executor can hold: a hot host's pages are dealt to several tasks
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
