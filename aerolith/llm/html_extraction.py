"""Main text of pages by consensus paths of their host.

1. Each page is walked once. Blocks of text score their container in full and the container around it by half (long
   blocks and commas count more, text in links against it); the best container names a generalised path of tags and
   classes, in which numbers are replaced by `#`.
2. Spark counts the votes per host and path; a path with at least SHARE of the votes of its host wins.
3. Each page is walked again. Of its host's winning paths the narrowest one that holds MOST of the score of the page's own
   best container gives the text of all its containers; where none does, the winning path that scores best here. The own
   best container gives the text where no winning path occurs, or only with less than PART of its score. The body as
   a whole can only win on pages whose text stands right under it.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments never score and never give text.
A class, an id or a form tag only marks an element as one of these while it does not hold the page: an element around the
main element, around the article with the most text, or around MOST of the text that no such mark covers differently is a
wrapper, whatever it is called (`freed`). Marks of reader comments give way to the main element and the title alone.

Votes are summed per task before they are shuffled. Pages meet the few winners of their host by (host, salt), so a host
with a third of all pages is dealt out over SALTS parts.

Defined results: a null, empty or textless page gives an empty text; a null url is a host of its own; a null id stays
null; repeated rows give equal texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.base import slices

SHARE, SALTS = 0.1, 16
MOST, PART = 0.8, 0.25

# Elements that never hold article text, whatever their classes.
_DROPPED = {"nav", "header", "footer", "aside", "button", "select", "textarea", "dialog", "menu", "head", "title", "iframe", "object", "canvas", "label", "fieldset"}
# Elements whose content is not markup.
_RAW = "script|style|noscript|template|svg|math|iframe|textarea|title"
_CONTAINERS = _DROPPED | {"html", "form", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "td", "blockquote", "figure", "details", "center"}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "pre", "br", "hr", "figcaption", "summary", "address", "caption", "option", "tbody", "thead"}
_EMPTY = {"br", "hr"}
# Words of a class, id or role that mark what is not the article.
_HINTS = {
    "nav", "navbar", "navigation", "menu", "header", "masthead", "banner", "topbar", "footer", "contentinfo", "sidebar", "aside", "complementary", "rail", "widget", "widgets",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo",
    "promotion", "form", "search", "login", "signup", "subscribe", "newsletter", "breadcrumb", "breadcrumbs", "share", "sharing",
    "social", "related", "recommended", "toolbar", "pagination", "pager", "copyright",
}
_COMMENTS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
# Words that say a class tells of something elsewhere (`no-comments`, `has-sidebar`).
_ELSEWHERE = {"no", "not", "has", "have", "with", "without", "open", "closed"}
# Attributes up to the end of a tag; a quoted value may hold `>`.
_ATTRS = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:svg|math)(?=[\s/]){_ATTRS}(?<=/)>|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>|<[!?][^>]*+>|<[/a-zA-Z][^<>]*+>",
    re.S | re.I,
)
# One whole attribute: its name and its value.
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")


class Element:
    __slots__ = ("boiler", "held", "links", "mark", "parent", "path", "score", "size", "tag", "titled")

    def __init__(self, tag: str, path: str, parent: "Element | None", boiler: bool, mark: str = "") -> None:
        self.tag, self.path, self.parent, self.boiler, self.mark = tag, path, parent, boiler, mark
        self.score, self.size, self.links, self.held, self.titled = 0.0, 0, 0, 0.0, False

    def around(self) -> "Iterator[Element]":
        """The element and those it lies in."""
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent


def _marks(tag: str, attrs: str) -> tuple[str, bool, str]:
    """(generalised class, whether the element is no article text by its kind, what its names say it is)."""
    if not attrs:
        return "", tag in _DROPPED, "hint" if tag == "form" else ""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    mark = "hint" if tag == "form" else ""
    if tag not in ("html", "body", "main", "article"):
        for name in " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split():
            words = _WORD.findall(name)
            if _ELSEWHERE.isdisjoint(words):
                mark = "comment" if mark == "comment" or not _COMMENTS.isdisjoint(words) else mark if _HINTS.isdisjoint(words) else "hint"
    return ".".join(sorted(_NUMBER.sub("#", found.get("class", "").lower()).split())), tag in _DROPPED or hidden, mark


def walk(page: str) -> list[tuple[Element, str]]:
    """Blocks of the page in order, outside of what is no article text: (container, text)."""
    root = Element("", "", None, False)
    stack, blocks, parts = [root], [], []
    in_link, dropped, title, link_chars = False, False, False, 0
    at = 0

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            top = stack[-1]
            if text and not top.boiler and not dropped:
                blocks.append((top, text))
                top.size += len(text)
                top.links += min(link_chars, len(text))
                top.titled |= title
            parts, link_chars = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                link_chars += len(piece)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["end"])
        if tag in _CONTAINERS:
            flush()
            dropped = in_link = title = False
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            elif not m["attrs"].endswith("/"):
                kind, boiler, mark = _marks(tag, m["attrs"])
                up = stack[-1]
                name = tag + ("." + kind if kind else "")
                path = up.path if tag in ("html", "body") else f"{up.path}>{name}"
                stack.append(Element(tag, path, up, up.boiler or boiler, mark))
        elif tag in _LEAVES:
            flush()
            in_link = False
            dropped = not closing and tag not in _EMPTY and any(_marks(tag, m["attrs"])[1:])
            title = tag == "h1" and not closing
        elif tag == "a":
            in_link = not closing
        # other elements run inside their line of text
    if at < len(page):
        parts.append(page[at:])
    flush()
    return _outside_marks(blocks)


def _outside_marks(blocks: list[tuple[Element, str]]) -> list[tuple[Element, str]]:
    """The blocks that lie in no marked element, wrappers apart."""
    if not any(e.mark for box in {id(b): b for b, _ in blocks}.values() for e in box.around()):
        return blocks
    total, mains = 0.0, {}
    for box, text in blocks:
        worth = _worth(text) * (1 - box.links / box.size)
        lies_in = list(box.around())
        remark = any(e.mark == "comment" for e in lies_in)
        total += 0.0 if remark else worth
        for e in lies_in:
            e.held += worth
            e.titled |= box.titled
            if e.tag == "main" or e.tag == "article" and not remark:
                mains[id(e)] = e
    first = max(mains.values(), key=lambda e: (e.tag == "main", e.held), default=None)
    holding = set(map(id, first.around())) if first else set()

    def freed(e: Element) -> bool:
        if e.mark == "comment":
            return e.titled or (id(e) in holding and first.tag == "main")
        return id(e) in holding or e.held >= MOST * total

    wrapped: dict[int, bool] = {}
    out = []
    for box, text in blocks:
        if id(box) not in wrapped:
            wrapped[id(box)] = all(not e.mark or freed(e) for e in box.around())
        if wrapped[id(box)]:
            out.append((box, text))
    return out


def _worth(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def scored(blocks: list[tuple[Element, str]]) -> dict[str, float]:
    """Score of each path that holds text."""
    seen: dict[int, Element] = {}
    for box, text in blocks:
        worth = _worth(text)
        box.score += worth
        seen[id(box)] = box
        if box.parent:
            box.parent.score += worth / 2
            seen[id(box.parent)] = box.parent
    scores: dict[str, float] = {}
    for box in seen.values():
        share = box.links / box.size if box.size else 0.0
        scores[box.path] = scores.get(box.path, 0.0) + box.score * (1 - share)
    return scores


def _article(path: str) -> str:
    """The path up to its outermost article, else up to its main element, else the path itself."""
    steps = path.split(">")
    for wanted in ("article", "main"):
        for k, step in enumerate(steps):
            if step.partition(".")[0] == wanted:
                return ">".join(steps[: k + 1])
    return path


def best_path(blocks: list[tuple[Element, str]]) -> str | None:
    scores = scored(blocks)
    return _article(max(scores, key=lambda p: (scores[p], p))) if scores else None


def _inside(path: str, wanted: str) -> bool:
    return path == wanted or path.startswith(wanted + ">") or not wanted


def _chosen(blocks: list[tuple[Element, str]], winners: list[str]) -> str:
    """The path whose containers hold the main text of this page."""
    own, worth = best_path(blocks), Counter()
    for box, text in blocks:
        worth[box.path] += _worth(text) * (1 - box.links / box.size)

    def held(*paths: str) -> float:
        return sum(x for p, x in worth.items() if all(_inside(p, wanted) for wanted in paths))

    whole = held(own)
    met = [w for w in winners if any(_inside(p, w) for p in worth) and (w or not own or worth[""] >= PART * whole)]
    holding = [w for w in met if held(w, own) >= MOST * whole]
    if holding:
        return min(holding, key=lambda w: (held(w), -len(w), w))
    best = max(met, key=lambda w: (held(w), len(w), w), default=own)
    return best if held(best) >= PART * whole else own


def main_text(page: str, winners: list[str]) -> str:
    blocks = walk(page)
    if not blocks:
        return ""
    chosen = _chosen(blocks, winners)
    return " ".join(text for box, text in blocks if _inside(box.path, chosen))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: Counter = Counter()
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            path = best_path(walk(page.as_py() or ""))
            if path is not None:
                votes[host, path] += 1
        if len(votes) > 100_000:
            yield _votes(votes)
            votes = Counter()
    yield _votes(votes)


def _votes(votes: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "n"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(p.as_py() or "", w or []) for p, w in zip(batch.column("html"), batch.column("winners").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winners): at most 1 / SHARE paths a host."""
    votes = pages.select("host", "html").mapInArrow(_voted, "host string, path string, n bigint").groupBy("host", "path").agg(F.sum("n").alias("n"))
    totals = votes.groupBy("host").agg(F.sum("n").alias("total"))
    return votes.join(totals, "host").where(F.col("n") >= F.col("total") * SHARE).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("winners"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host"))
    winners = winning_paths(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    met = rows.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "winners")
    out = met.mapInArrow(_extracted, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
