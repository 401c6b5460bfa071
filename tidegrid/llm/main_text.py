"""Main text of web pages by consensus of a host's pages.

1. Each page's containers are scored by the paragraph text that they hold: all of what is in an article or main, however deep,
   and of what is up to two containers down in others. The best ones vote, with their generalised paths of tags and classes
   (digits become one sign), for what a page of this host looks like.
2. Votes are summed by host and path; up to WINNERS paths of a host win, if enough of its pages voted for them.
3. Each page is read again: the text is that of all containers at the best of the winning paths that the page has, in page
   order, or, on a page that has none of them, at the path of its own best container. The containers about them, up to an article or
   to what the body holds, add the prose that they hold themselves (a headline or a lead above the inner container) and that of other
   containers with paragraphs, unless it is mostly links. Menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles, mark-up and reader comments are left out, with all that they hold; the header within an article,
   which has its title, stays.

Defined cases: equal votes go to the path that sorts first, equal scores of a page to its first container. Null ids are ids. null and empty html give the empty text; a null url has the empty host, and its pages vote together. Unclosed and
badly nested elements end where their parent ends; truncated tags at the end of a page are dropped. Repeated rows each vote and
each give a row. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import BROADCAST_ROWS, small_enough, text_of, written
from tidegrid.llm.sentencepieces import small_batches

#: Paths that may win on a host, the share of its votes that each needs, and the containers of a page that vote.
WINNERS, SHARE, VOTERS = 4, 0.05, 3

#: A path beyond this many characters goes on from a checksum of it.
LONGEST = 1000

# What HTML says about elements, and the words by which sites name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms mtext object q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
LEFT_OUT = frozenset("nav footer header aside form script style noscript template iframe textarea title head svg select audio video canvas dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CONTAINERS = frozenset("article main section div td body".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SCOPE = frozenset("article main section div td th table ul ol dl aside nav footer header form body html".split())
NAMES_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar rail header masthead "
    "footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs widget widgets pagination pager toolbar copyright disclaimer alert outbrain taboola search form skip".split()
)
#: Words that may stand beside one of those in a class without changing what it names: site-header, but not no-sidebar or share-price.
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons container content desktop first global inner item items large last left links list main mobile module my "
    "outer page panel popular post posts primary region right secondary section side site slot small stories sub sticky the top unit us wrap wrapper articles icons".split()
)
COMMENTS = frozenset("comment comments commentlist discussion discussions disqus guestbook respond responses reply replies talkback".split())
#: Words by which a class says something about comments without holding any.
STATES = frozenset("no not has with without open opened closed enabled disabled allow allowed".split())

# a quote opens a value only after an equals sign; a tag that the page breaks off in is dropped
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in RAW}
_CREDIT = (1.0, 0.5, 0.25)
#: What an article or main gets of the text in containers within it, however deep, and what text in links counts in one.
_WITHIN, _LINKED = 0.5, 0.1


class _Open:
    """The open elements. How many of a name are open is known by scope, so that an end tag without a start costs nothing."""

    def __init__(self):
        # name, container that text goes to, and whether text is left out, in a paragraph, in a link, in an article; link-dense block
        self.stack: list[tuple[str, int, bool, bool, bool, bool, int]] = [("body", 0, False, False, False, False, 0)]
        self.scopes: list[Counter] = [Counter()]
        self.named: Counter = Counter()

    def push(self, name: str, *rest) -> None:
        self.stack.append((name, *rest))
        if name in SCOPE:
            self.named[name] += 1
            self.scopes.append(Counter())
        else:
            self.scopes[-1][name] += 1

    def close(self, name: str) -> None:
        """Ends the innermost element of the name and all in it; one that is no scope itself only within its scope."""
        if not (self.named[name] if name in SCOPE else self.scopes[-1][name]):
            return
        while True:
            gone = self.stack.pop()[0]
            if gone in SCOPE:
                self.named[gone] -= 1
                self.scopes.pop()
            else:
                self.scopes[-1][gone] -= 1
            if gone == name:
                return


class Page:
    """The containers of a page: tag, generalised path and score; and its text in order, with the container of each piece.

    What is left out goes with all that it holds, articles too. By its tag, or a class, id or role that names it, an element is
    left out at once; one with such a word in a longer name only if most of its text is links. Without `names` only tags, roles and
    comments count: for pages whose whole text stands in an element of such a name. With `rescue` an article or main counts
    wherever it stands: for pages that leave a menu open."""

    def __init__(self, source: str, names: bool = True, rescue: bool = False):
        self.path, self.score, self.parent = ["body"], [0.0], [-1]
        # container, text, link-dense block, and whether it is in a link and in a paragraph
        self.pieces: list[tuple[int, str, int, bool, bool]] = []
        self.own, self.factor = [0.0], [0.5]
        # blocks that are left out if they are mostly links: parent, characters, characters in links; the first stands for none
        self.dense: list[list[int]] = [[-1, 0, 0]]
        opened = _Open()
        at, size = 0, len(source)
        for m in iter(lambda: _TOKEN.search(source, at), None):
            begin, end = m.span()
            _, box, out, para, link, art, dense = opened.stack[-1]
            if begin > at and not out:
                self._text(source[at:begin], box, para, link, dense, art)
            at = end
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name not in INLINE and not out:
                self.pieces.append((box, "\n", dense, False, False))
            if m[1]:
                opened.close(name)
            elif name not in VOID:
                for gone in CLOSES.get(name, ()):
                    opened.close(gone)
                if name in ENDS_P:
                    opened.close("p")
                if name == "body" or name == "html":
                    continue
                _, box, out, para, link, art, dense = opened.stack[-1]
                if name in RAW:
                    at = _END[name].search(source, end).end()
                    continue
                if m[3].endswith("/") and name in ("svg", "path", "use"):
                    continue
                verdict, tail = self._named(m[3], names and name != "main") if m[3] else ("", "")
                if verdict == "out" or (name in LEFT_OUT and not (name == "header" and art)):
                    out = True
                elif verdict == "dense" and name not in INLINE:
                    self.dense.append([dense, 0, 0])
                    dense = len(self.dense) - 1
                elif rescue and name in ("article", "main"):
                    out = False
                art = art or name in ("article", "main")
                if name in CONTAINERS and not out:
                    above = self.path[box] if len(self.path[box]) < LONGEST else f"{zlib.crc32(self.path[box].encode()):08x}"
                    self.path.append(f"{above}>{name}{tail}")
                    self.score.append(0.0)
                    self.own.append(0.0)
                    self.parent.append(box)
                    self.factor.append(2.5 if name == "article" else 2.1 if name == "main" else 1.0)
                    box, para = len(self.path) - 1, False
                opened.push(name, box, out, para or name in ("p", "pre", "blockquote"), link or name == "a", art, dense)
            if at >= size:
                break
        _, box, out, para, link, art, dense = opened.stack[-1]
        if at < size and not out:
            self._text(source[at:], box, para, link, dense, art)
        self._settle()

    def _text(self, raw: str, box: int, para: bool, link: bool, dense: int, art: bool) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append((box, text, dense, link, para))
        if text.isspace():
            return
        if dense:
            self.dense[dense][1] += len(text)
            self.dense[dense][2] += len(text) if link else 0
        n = len(text) * (1.0 if para or box else 0.5) * ((_LINKED if art else 0) if link else 1)
        if n:
            self.own[box] += n
            for share in _CREDIT:
                self.score[box] += share * n * self.factor[box]
                box = self.parent[box]
                if box < 0:
                    break

    def _settle(self) -> None:
        """Credit of articles for all that they hold, and blocks of links taken out."""
        held = list(self.own)
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
            if self.factor[k] > 1:
                self.score[k] = self.factor[k] * (self.own[k] + _WITHIN * (held[k] - self.own[k]))
        for k in range(len(self.dense) - 1, 0, -1):
            up = self.dense[self.dense[k][0]]
            up[1] += self.dense[k][1]
            up[2] += self.dense[k][2]
        gone = [False] * len(self.dense)
        for k in range(1, len(gone)):
            parent, n, links = self.dense[k]
            gone[k] = 2 * links > n or gone[parent]
        if any(gone):
            self.pieces = [(box, "\n" if gone[d] else t, d, link and not gone[d], para and not gone[d]) for box, t, d, link, para in self.pieces]

    @staticmethod
    def _named(attrs: str, names: bool) -> tuple[str, str]:
        """What class, id and role say: "out", "dense" (out if mostly links) or nothing; and the generalised classes."""
        verdict, tail = "", ""
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                verdict = "out"
            elif key == "role":
                if value.lower() in ROLES:
                    verdict = "out"
            elif key in ("class", "id"):
                if key == "class":
                    tail = "".join("." + x for x in sorted(_DIGITS.sub("#", value.lower()).split()))
                for name in value.split():
                    words = set(_WORDS.split(_CAMEL.sub("-", name).lower())) - {""}
                    told = words & NAMES_OUT if names else set()
                    if (words & COMMENTS and not words & STATES) or (told and words <= told | BESIDE):
                        verdict = "out"
                    elif told and not verdict:
                        verdict = "dense"
        return verdict, tail

    def best(self) -> list[int]:
        """Containers by falling score, the first of equal ones first; those without any are left out."""
        return [k for k in sorted(range(len(self.score)), key=lambda k: -self.score[k]) if self.score[k] > 0]

    def text(self, path: str) -> str:
        """The text of all containers at the path, and of what belongs to them in those about them, in page order."""
        inside = [p == path for p in self.path]
        about: set[int] = set()
        for k in [k for k, main in enumerate(inside) if main]:
            # up to an article, or to what the body holds
            while self.factor[k] <= 1 and self.parent[k] > 0 and self.parent[k] not in about:
                k = self.parent[k]
                about.add(k)
        own = [(0, 0, False)] * len(self.path)
        for k, t, _, link, para in self.pieces if about else ():
            if n := len(t.strip()):
                plain, linked, paragraphs = own[k]
                own[k] = (plain, linked + n, paragraphs) if link else (plain + n, linked, paragraphs or para)
        held = list(own)
        for k in range(len(held) - 1, 0, -1):
            up, one = held[self.parent[k]], held[k]
            held[self.parent[k]] = (up[0] + one[0], up[1] + one[1], up[2] or one[2])
        prose = lambda plain, linked, _: 0 < plain > 2 * linked
        kept = list(inside)
        for k in range(1, len(kept)):
            beside = self.parent[k] in about and k not in about and prose(*held[k]) and held[k][2]
            inside[k] = inside[k] or beside or (inside[self.parent[k]] and k not in about)
            kept[k] = inside[k] or (k in about and prose(*own[k]))
        return " ".join("".join([t for k, t, *_ in self.pieces if kept[k]]).split())

    def main(self, winners: list[str]) -> tuple[str, str]:
        """Text and path of the main containers."""
        order = self.best()
        if not order:
            return "", ""
        scored = {self.path[k] for k in order}
        path = next((p for p in winners if p in scored), self.path[order[0]])
        return self.text(path), path


def parsed(source: str) -> Page:
    """The page; where that leaves no container with text without its names, and then with articles wherever they stand."""
    for how in ({}, {"names": False}, {"names": False, "rescue": True}):
        page = Page(source, **how)
        if any(page.score):
            break
    return page


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, h) to a page's votes: host, path and weight, its best container's being 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: dict[tuple[str, str], float] = {}
            for where, source in zip(pdf["host"], pdf["h"], strict=True):
                page = parsed(source)
                order = page.best()[:VOTERS]
                for path, weight in {page.path[k]: page.score[k] / page.score[order[0]] for k in reversed(order)}.items():
                    total[where, path] = total.get((where, path), 0) + round(weight, 3)
            yield pd.DataFrame([(a, b, w) for (a, b), w in total.items()], columns=["host", "path", "weight"])

    return pages.select("host", "h").mapInPandas(run, "host string, path string, weight double")


def winners(cast: DataFrame) -> DataFrame:
    """host and its winning paths, the one with the most votes first."""
    summed = cast.groupBy("host", "path").agg(F.sum(F.col("weight").cast("decimal(20,3)")).alias("votes"))
    ranked = summed.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).filter(F.col("k") <= WINNERS)
    of_host = ranked.join(summed.groupBy("host").agg(F.sum("votes").alias("all")), "host").filter(F.col("votes") >= SHARE * F.col("all"))
    return of_host.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: int = BROADCAST_ROWS // 4) -> DataFrame:
    """For each row: id, url, text, n_chars (code points) and path, the containers'."""
    id_type = pages.select(F.col(id_col)).schema[0].dataType.simpleString()
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("h")).withColumn("host", host(F.col("url")))
    won = written(winners(votes(plain)), "winners")
    both = plain.join(F.broadcast(won) if small_enough(won, bound) else won, "host", "left").select("id", "url", "h", "paths")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in small_batches(whole, "h"):
                out = [parsed(h).main([] if p is None else list(p)) for h, p in zip(pdf["h"], pdf["paths"], strict=True)]
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "url": pdf["url"].to_numpy(), "text": [t for t, _ in out], "n_chars": [len(t) for t, _ in out], "path": [p for _, p in out]})

    got = both.mapInPandas(run, f"id {id_type}, url string, text string, n_chars long, path string")
    return got.withColumnsRenamed({"id": id_col, "url": url_col})
