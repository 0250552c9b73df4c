"""Main text of web pages: site templates go by their recurrence, other page furniture by its tags and names.

A page is read into elements and blocks of text. Each block-level subtree has a hash of its tags and words. Spark
counts on how many pages of a host each subtree stands; subtrees that recur on many of them are the site's
template and are deleted, wherever they stand. Inside the article the bar is higher: there a paragraph counts as
template only if half of the host's pages have it, since articles quote and copy each other.

Menus, adverts and footers whose words differ from page to page recur as shells: hashes of a subtree's tags and
class names, repeats folded, and of its place, without its words. Shells count outside the article only. On a host whose
pages have neither article nor main element, the place that holds most of the paragraphs on its pages takes the article's
part, and only shells with little text outside links go. What recurs in neither way, or stands on hosts of few pages,
is known by its tags and names.

Reading takes time in proportion to the page, however broken its markup is: no place is looked at again and again.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, written

#: A subtree is template if so many pages of its host, and this share of them, hold it: outside and inside articles.
OUTSIDE, INSIDE = (5, 0.2), (10, 0.5)
#: A shell of a host without articles has at most this share of the text that the paragraphs of the main place have.
LITTLE = 0.2

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_IN_TAG = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*([\"'])")
#: Elements whose content is no text of the page, up to their end tag.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg textarea select iframe object canvas title".split()}
_LONG_NUMBER = re.compile(r"&#(?:[xX]([0-9a-fA-F]{7,})|([0-9]{8,}));?")


def tokens(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "" or "/", tag, attributes) of the markup of a page in turn; the tag of comments and the like is empty.

    A quoted value begins after an equals sign; a quote that is not closed is a sign like others. A tag that never
    ends takes the rest of the page with it, as in browsers.
    """
    at, n, unclosed = 0, len(source), set()
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if source[start + 1 : start + 2] in ("!", "?"):
            end = source.find(">", start)
            at = n if end < 0 else end + 1
            yield start, at, "", "", ""
            continue
        m = _OPEN.match(source, start)
        if m is None:
            at = start + 1
            continue
        tag = m[2].lower()
        if not m[1] and tag in _RAW:
            end = _RAW[tag].search(source, m.end())
            at = n if end is None else end.end()
            yield start, at, "", "", ""
            continue
        at = m.end()
        while (sign := _IN_TAG.search(source, at)) is not None and sign[0] == "=":
            at = sign.end()
            quote = _QUOTE.match(source, at)
            if quote is not None and quote[1] not in unclosed:
                end = source.find(quote[1], quote.end())
                if end < 0:
                    unclosed.add(quote[1])
                at = quote.end() if end < 0 else end + 1
        if sign is None:
            yield start, n, "", "", ""
            return
        at = sign.end()
        yield start, at, m[1], tag, source[m.end() : at - 1]


def _unescaped(text: str) -> str:
    """Character references decoded; numbers beyond all characters become the replacement character."""
    if "&#" in text:
        number = lambda m: int(d or "0", 16 if m[1] else 10) if len(d := (m[1] or m[2]).lstrip("0")) < 8 else 0
        text = _LONG_NUMBER.sub(lambda m: f"&#{number(m)};" if number(m) else "\ufffd", text)
    return html.unescape(text)


# --- fixed values: names of HTML elements, and words of class, id and role that name page furniture ---
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form menu dialog button label option datalist audio video".split())
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription sidebar menu navbar nav navigation breadcrumb breadcrumbs "
    "pagination pager share sharing social related recommended recommendations comment comments disqus respond reply replies "
    "footer header masthead login signup search widget toolbar complementary contentinfo skip".split()
)
CONTENT = frozenset("article entry post content story main".split())
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements that a start tag closes if they are open (and no container of lists or tables stands between).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("ul ol dl table menu body html article section div main".split())
_SCOPES = frozenset("article main body".split())
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: What a page tells of a hash: a subtree outside or inside the article, a shell, or a place that holds paragraphs.
SUBTREE, WITHIN, SHELL, PLACE = range(4)


class Page:
    """Elements (tag, parent, rule that drops them, hashes of subtree, shell and place) and blocks of text (element, text)."""

    def __init__(self, source: str):
        self.tags: list[str] = ["html"]
        self.parents: list[int] = [-1]
        self.ruled: list[bool] = [False]
        self.hashes: list[int] = [0]
        self.shells: list[int] = [0]
        self.places: list[int] = [0]
        self._names: list[str] = ["html"]
        self._shapes: list[list[int]] = [[]]
        # characters outside links of the blocks of each element itself
        self.plain: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []
        self._parts: list[list[str]] = [[]]
        self._stack: list[int] = [0]
        # places in the stack of each open tag, of what ends the search for an end tag's start, and for a list's item
        self._open: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self._barriers: list[int] = [0]
        self._linked = 0
        stack, pieces, last, link = self._stack, [], 0, False
        for start, end, closing, tag, names in tokens(source):
            if start > last:
                pieces.append(source[last:start])
                if link:
                    self._linked += start - last
            last = end
            if not tag:
                continue
            if tag == "a":
                link = not closing
            if tag == "br":
                pieces.append(" ")
                continue
            block = tag in BLOCKS
            if closing:
                if block or tag in DROPPED or len(stack) > 1 and self.tags[stack[-1]] == tag:
                    self._close(tag, pieces)
                continue
            ruled = tag in DROPPED or tag == "header"
            if len(names) > 4:
                ruled = ruled or _furniture(names)
            if not block and not ruled:
                continue
            self._flush(stack[-1], pieces)
            if tag in VOID:
                continue
            if block and tag not in _CLOSES:
                while self.tags[stack[-1]] == "p" or self.tags[stack[-1]] not in BLOCKS and self.tags[stack[-1]] not in DROPPED and "p" in (self.tags[s] for s in stack[-3:]):
                    self._pop()
            if tag in _CLOSES:
                k = max((self._open[t][-1] for t in _CLOSES[tag] if self._open.get(t)), default=0)
                if k > self._barriers[-1]:
                    self._pop_to(k)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.ruled.append(ruled)
            self.hashes.append(0)
            self.shells.append(0)
            self.plain.append(0)
            found = _CLASS.search(names) if len(names) > 4 else None
            # numbers in class names are often those of the page
            classes = " ".join(sorted(_DIGITS.sub("#", (found[1] or found[2] or found[3] or "").lower()).split())) if found else ""
            self._names.append(f"{tag} {classes}")
            self.places.append(_hash(f"{self.places[stack[-1]]:x}", self._names[-1]))
            self._shapes.append([])
            self._parts.append([])
            if not names.endswith("/") or block:
                self._push(tag)
        pieces.append(source[last:])
        self._flush(stack[-1], pieces)
        self._pop_to(1)

    def _push(self, tag: str) -> None:
        k = len(self._stack)
        self._stack.append(len(self.tags) - 1)
        self._open.setdefault(tag, []).append(k)
        if tag in _SCOPES:
            self._scopes.append(k)
        if tag in _BARRIER:
            self._barriers.append(k)

    def _flush(self, element: int, pieces: list[str]) -> None:
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = _unescaped(text)
            if text := " ".join(text.split()):
                self.blocks.append((element, text))
                self._parts[element].append(text)
                self.plain[element] += max(0, len(text) - self._linked)
            pieces.clear()
        self._linked = 0

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._pop()

    def _pop(self) -> None:
        k = self._stack.pop()
        tag = self.tags[k]
        self._open[tag].pop()
        if tag in _SCOPES:
            self._scopes.pop()
        if tag in _BARRIER:
            self._barriers.pop()
        shape = _hash(self._names[k], *(f"{h:x}" for h in self._shapes[k]))
        beside = self._shapes[self.parents[k]]
        if not beside or beside[-1] != shape:
            beside.append(shape)
        self._shapes[k] = []
        parts = self._parts[k]
        if parts:
            self.shells[k] = _hash(f"{self.places[k]:x}", f"{shape:x}")
            digest = xxhash.xxh3_64_intdigest("\x1f".join([tag, *parts]).encode("utf-8", "surrogatepass"))
            self.hashes[k] = digest - (1 << 63)
            self._parts[self.parents[k]].append(f"{digest:x}")
            parts.clear()

    def _close(self, tag: str, pieces: list[str]) -> None:
        self._flush(self._stack[-1], pieces)
        k = self._open[tag][-1] if self._open.get(tag) else 0
        # an end tag without a start doesn't end the article
        if k and (tag in ("body", "html") or not self._scopes or k >= self._scopes[-1]):
            self._pop_to(k)

    def inside(self) -> list[bool]:
        """Whether each element is an article, or lies in one (or in the main element if there is no article)."""
        tags = self.tags
        dropped = self._dropped(frozenset(), None)
        scope = next((s for s in ("article", "main") if any(t == s and not d for t, d in zip(tags, dropped, strict=True))), None)
        out = [False] * len(tags)
        for k in range(1, len(tags)):
            out[k] = out[self.parents[k]] or tags[k] == scope and not dropped[k]
        return out

    def _dropped(self, templates: frozenset[int], place: int | None) -> list[str]:
        """Why each element goes: "template", "rule", or "" if it stays."""
        tags, parents = self.tags, self.parents
        content = [t in ("article", "main") for t in tags]
        shells = any(content)
        holds = [t in _SCOPES for t in tags]
        main = content
        if not shells and place is not None:
            main = [p == place for p in self.places]
            shells = any(main)
        has = list(main)
        for k in range(len(tags) - 1, 0, -1):
            holds[parents[k]] |= holds[k]
            has[parents[k]] |= has[k]
        out = [""] * len(tags)
        within, near = [False] * len(tags), [False] * len(tags)
        for k in range(1, len(tags)):
            within[k] = within[parents[k]] or content[k]
            near[k] = near[parents[k]] or main[k]
            if out[parents[k]]:
                out[k] = out[parents[k]]
            elif not holds[k] and (self.hashes[k] in templates or shells and not near[k] and not has[k] and self.shells[k] in templates):
                out[k] = "template"
            # reader comments are often articles of their own
            elif self.ruled[k] and (not holds[k] and not (tags[k] == "header" and within[k]) or tags[k] == "article" and within[parents[k]]):
                out[k] = "rule"
        return out

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        return self.result(templates)[0]

    def result(self, templates: frozenset[int], place: int | None = None) -> tuple[str, int, int]:
        """The text, and how many blocks went as parts of templates and by rules; place is the main one of a host without articles."""
        dropped = self._dropped(templates, place)
        inside = self.inside()
        scoped = any(inside)
        why = [dropped[k] for k, _ in self.blocks]
        text = "\n".join(t for k, t in self.blocks if not dropped[k] and (inside[k] or not scoped))
        return text, why.count("template"), why.count("rule")

    def subtrees(self) -> list[tuple[int, int, int]]:
        """(hash, kind, characters outside links) of what a page tells its host, each hash once for its kind.

        Block-level subtrees with text, inside the article or not; shells outside it, without characters; on a page without
        an article all shells and the places that hold paragraphs, with theirs.
        """
        tags, parents = self.tags, self.parents
        inside = self.inside()
        # as in _dropped: any article or main element, also one that goes itself, tells that the page has such
        content = [t in ("article", "main") for t in tags]
        scoped, has, near = any(content), list(content), list(content)
        text = list(self.plain)
        for k in range(len(tags) - 1, 0, -1):
            has[parents[k]] |= has[k]
            text[parents[k]] += text[k]
        found: dict[tuple[int, int], int] = {}
        for k in range(1, len(tags)):
            near[k] |= near[parents[k]]
            if not scoped and tags[k] in _PROSE and self.plain[k] and not self.ruled[k]:
                at = (self.places[parents[k]], PLACE)
                found[at] = found.get(at, 0) + self.plain[k]
            if not self.hashes[k] or tags[k] in ("article", "main", "body", "html"):
                continue
            found[self.hashes[k], WITHIN if inside[k] else SUBTREE] = 0
            if not near[k] and not has[k]:
                found[self.shells[k], SHELL] = 0 if scoped else found.get((self.shells[k], SHELL), 0) + text[k]
        return [(h, kind, n) for (h, kind), n in found.items()]


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _furniture(attributes: str) -> bool:
    for m in _NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(re.split(r"[^a-z0-9]+", name))
            found = words & FURNITURE
            if found and not (found == {"header"} and words & CONTENT):
                return True
    return bool(_HIDDEN.search(attributes))


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, templates: array of hashes of subtrees and shells, place: the main one of a host without articles, or null) from
    rows (host, html). A page counts once for each hash it holds."""

    def make():
        def run(sources):
            found = [Page(s or "").subtrees() for s in sources]
            return {"found": [[{"hash": h, "kind": k, "text": n} for h, k, n in x] for x in found]}

        return run

    own = map_text(pages.where("host != ''"), make, T.StructType.fromDDL("found array<struct<hash: long, kind: int, text: long>>"), "html", ["host"])
    seen = own.select("doc.host", F.inline("found")).groupBy("host", "hash", F.greatest("kind", F.lit(WITHIN)).alias("sort"))
    seen = seen.agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.sum("text").alias("text"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    least = lambda rule: (F.col("n") >= rule[0]) & (F.col("n") >= rule[1] * F.col("pages"))
    seen = seen.where(F.col("n") >= min(OUTSIDE[0], INSIDE[0])).join(hosts, "host").where(F.when(F.col("kind") == WITHIN, least(INSIDE)).otherwise(least(OUTSIDE)))
    # what is left stands on a fixed share of a host's pages, so its number is at most a few pages' subtrees
    place = F.max_by(F.when(F.col("kind") == PLACE, F.struct("hash", (F.col("text") / F.col("n")).alias("text"))), F.when(F.col("kind") == PLACE, F.struct("text", "hash")))
    others = F.collect_list(F.when(F.col("kind") != PLACE, F.struct("hash", (F.col("text") / F.col("n")).alias("text"))))
    kept = seen.groupBy("host").agg(place.alias("main"), others.alias("others"))
    few = F.filter("others", lambda x: (x["text"] == 0) | (x["text"] <= LITTLE * F.coalesce(F.col("main.text"), F.lit(0.0))))
    return written(kept.select("host", F.transform(few, lambda x: x["hash"]).alias("templates"), F.col("main.hash").alias("place")), "templates")


def extract_main_text(pages: DataFrame, *, url: str = "url", source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of pages: doc, text, and the blocks that went as parts of templates and by rules (longs).

    Null or empty html gives an empty text. Pages without a host in their url have no template removed. White
    space in a block becomes one space, blocks are joined by a newline in page order; nothing else is cut.
    Repeated rows count as pages of their own and each get their row. Columns of any name are kept in doc.
    """
    kept = pages.columns if keep is None else keep
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), host.alias("host"), F.col(f"`{source}`").cast("string").alias("html"))
    rows = rows.join(site_templates(rows.select("host", "html")), "host", "left").select("doc", "html", "templates", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(s or "").result(frozenset(t or ()), p) for s, t, p in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            texts, templates, rules = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(templates, pa.int64()), pa.array(rules, pa.int64())], names=["doc", "text", "by_template", "by_rule"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *T.StructType.fromDDL("text string, by_template long, by_rule long").fields]))
