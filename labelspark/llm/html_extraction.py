"""HTML extraction by consensus paths of a host."""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import no_null_text, staged

BLOCK_PAGES = 256  # pages that are kept and sent together
LEAST_COVER = 0.5  # share of a page's text that a path needs to be voted for
SEMANTIC = {"article": 1.3, "main": 1.2}
NAMED = 1.1

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math xmp noembed noframes".split())
_DROP = _RAW | frozenset("head nav header footer aside form dialog menu button select object canvas audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES = {
    **{t: ("p",) for t in _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",),
}
_SCOPE = frozenset("table ul ol dl td th div section article main body html blockquote aside nav form button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices gdpr popup "
    "modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead comment comments disqus replies reply respond related recommended recommendations share sharing social pagination pager "
    "widget widgets toolbar hidden skip".split()
)
_CONTENT = frozenset("article content main post entry story body text".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")
_HASHED = re.compile(r"\d+|(?<![a-z0-9])[0-9a-f]{6,}(?![a-z0-9])")


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, open or close. Comments, declarations and the
    inside of raw elements are left out."""
    at, lower = 0, None
    while True:
        lt = page.find("<", at)
        if lt < 0:
            if at < len(page):
                yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":
                return  # a tag that the page's end cuts off
            yield "text", "<", ""
            at = lt + 1
            continue
        close, name, attributes = m.group(1, 2, 3) if m[2] is not None else m.group(4, 5, 6)
        name, at = name.lower(), m.end()
        yield "close" if close else "open", name, attributes
        if not close and name in _RAW and not attributes.endswith("/"):
            lower = page.lower() if lower is None or len(lower) != len(page) else lower
            end = lower.find("</" + name, at) if len(lower) == len(page) else page.find("</" + name, at)
            if end < 0:
                return
            at = end


def _boiler(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element by its tag, role, class or id is no part of an article."""
    if name in _DROP:
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    for word in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower())
        if not parts or parts[0] in ("no", "has", "with", "without"):
            continue
        if parts[-1] == "header" and parts[0] in ("article", "post", "entry", "story"):
            continue
        if parts[0] in _BOILER or parts[-1] in _BOILER:
            return True
    return False


def _step(name: str, attributes: dict[str, str]) -> str:
    """One step of a generalised path: the tag and its classes, numbers and hashes as #."""
    classes = sorted({_HASHED.sub("#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([name, *classes])


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of the containing elements, text, characters inside links) of the page's text blocks, in
    page order, without those in boilerplate elements."""
    stack: list[tuple[str, str, bool]] = []  # tag, step, dropped
    out, parts, link = [], [], 0
    where: tuple[str, ...] = ()

    def flush():
        nonlocal parts, link
        text = " ".join("".join(parts).split())
        if text:
            out.append((where, text, link))
        parts, link = [], 0

    for kind, value, raw in _tokens(page):
        if kind == "text":
            if not (stack and stack[-1][2]):
                if not parts:
                    where = tuple(s for t, s, _ in stack if t in _BLOCK and t not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "html"))
                text = html.unescape(value)
                parts.append(text)
                link += len(text) if any(t == "a" for t, _, _ in stack) else 0
            continue
        if value == "br":
            parts.append(" ")
            continue
        if value in _BLOCK:
            flush()
        if kind == "open":
            if value in _CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _CLOSES[value]:
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPE:
                        break
            if value in _VOID or raw.endswith("/"):
                continue
            attributes = {m[1].lower(): html.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTR.finditer(raw)} if raw.strip() else {}
            dropped = bool(stack and stack[-1][2]) or _boiler(value, attributes)
            if dropped and value not in _BLOCK and not (stack and stack[-1][2]):
                parts.append(" ")
            stack.append((value, _step(value, attributes), dropped))
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == value:
                    del stack[i:]
                    break
                if value in ("p", "b", "i", "a", "span", "em", "strong") and stack[i][0] in _SCOPE:
                    break
    flush()
    return out


def path_scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[str, float]:
    """Score of each container path of a page: its share of the text outside links, more for an
    element that says it is the article. A path counts all blocks below it."""
    cover: Counter[str] = Counter()
    for where, text, link in found:
        worth = max(len(text) - link, 0)
        for depth in range(1, len(where) + 1):
            cover["/".join(where[:depth])] += worth
    total = sum(max(len(t) - n, 0) for _, t, n in found)
    out = {}
    for path, worth in cover.items():
        if total and worth >= LEAST_COVER * total:
            tag, *classes = path.rsplit("/", 1)[-1].split(".")
            named = NAMED if any(p in _CONTENT for c in classes for p in _PART.findall(c)) else 1.0
            out[path] = worth / total * SEMANTIC.get(tag, named)
    return out


def _paths(found: list[tuple[tuple[str, ...], str, int]]) -> set[str]:
    """Every container path of a page."""
    return {"/".join(w[:d]) for w in {w for w, _, _ in found} for d in range(1, len(w) + 1)}


def _best(found: list[tuple[tuple[str, ...], str, int]]) -> tuple[str | None, float]:
    """The page's own best path and its score."""
    scores = path_scores(found)
    path = max(scores, key=lambda p: (scores[p], p.count("/"), p), default=None)
    return path, scores.get(path, 0.0)


def _below(texts: list[tuple[str, str]], path: str | None) -> str:
    """The texts of (path, text) in and below a path; all without one."""
    return "\n\n".join(t for w, t in texts if path is None or w == path or w.startswith(path + "/"))


def extract(page: str, paths: list[str]) -> tuple[str, str | None]:
    """(text, path) by the first of `paths` that the page has, else by the page's own best path."""
    found = blocks(page)
    have = _paths(found)
    path = next((p for p in paths if p in have), None) or _best(found)[0]
    return _below([("/".join(w), t) for w, t, _ in found], path), path


_PAGE = pa.struct([("i", pa.int32()), ("host", pa.string()), ("paths", pa.list_(pa.string())), ("vote", pa.string()), ("votes", pa.int64())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages: a key, the pages' texts and their paths as a compressed Arrow stream, and each
    page's host, container paths and vote."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_PAGES):
            part = batch.slice(first, BLOCK_PAGES)
            found = [blocks(page) for page in part.column("html").to_pylist()]
            own = pa.RecordBatch.from_pydict({
                "page_id": part.column("page_id"), "url": part.column("url"),
                "at": pa.array([["/".join(w) for w, _, _ in f] for f in found], pa.list_(pa.string())),
                "texts": pa.array([[t for _, t, _ in f] for f in found], pa.list_(pa.string())),
            })
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(own)
            pages = []
            for i, (host, f) in enumerate(zip(part.column("host").to_pylist(), found, strict=True)):
                vote, score = _best(f)
                pages.append({"i": i, "host": host, "paths": sorted(_paths(f)), "vote": vote, "votes": round(score * 1000)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([pages], pa.list_(_PAGE))],
                names=["block", "texts", "pages"],
            )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed, chosen in zip(batch.column("texts"), batch.column("chosen").to_pylist(), strict=True):
            own = pa.ipc.open_stream(packed.as_py()).read_all().combine_chunks().to_batches()[0]
            path_of = {c["i"]: c["path"] for c in chosen or []}
            paths = [path_of.get(i) for i in range(own.num_rows)]
            rows = zip(own.column("at").to_pylist(), own.column("texts").to_pylist(), paths, strict=True)
            done = [_below(list(zip(at, texts, strict=True)), path) for at, texts, path in rows]
            yield pa.RecordBatch.from_arrays(
                [own.column("page_id"), own.column("url"), pa.array(done, pa.string()), pa.array(paths, pa.string())], names=["page_id", "url", "text", "path"],
            )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text, path (of the container used).

    Every page votes for its best container path, with its score; votes are summed per host and path, and
    each page takes that of its own container paths which has most votes of its host, however many paths the host
    has, so a page with an odd best container follows its siblings. Equal votes go to the longer path. Blocks
    in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
    (by tag, role, class or id) never count. Character references are decoded, white space in a block
    becomes one blank, blocks are joined by an empty line.

    Null and empty pages give an empty text; a page whose text has no container gives all its blocks.
    A null or odd url is the host "". Pages repeated under one id give a row each. A tag cut off by the
    end of the page is left out. An empty table gives an empty result; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), no_null_text(html_col).alias("html")
    )
    id_type = rows.schema["page_id"].dataType.simpleString()
    parsed = staged(
        rows.mapInArrow(_parse, "block string, texts binary, pages array<struct<i:int,host:string,paths:array<string>,vote:string,votes:long>>"), "parsed"
    )
    each = parsed.select("block", F.explode("pages").alias("p")).select("block", "p.*")
    votes = staged(each.filter("vote is not null").groupBy("host", F.col("vote").alias("path")).agg(F.sum("votes").alias("votes")), "host-paths")
    order = F.struct(-F.col("votes"), -F.length("path"), "path")
    best = (
        each.select("block", "i", "host", F.explode("paths").alias("path")).join(votes, ["host", "path"])
        .groupBy("block", "i").agg(F.min_by("path", order).alias("path"))
        .groupBy("block").agg(F.collect_list(F.struct("i", "path")).alias("chosen"))
    )
    # Staged, so Spark knows its size and need not deal out the texts when it is small.
    joined = parsed.select("block", "texts").join(staged(best, "page-paths"), "block", "left").select("texts", "chosen")
    return joined.mapInArrow(_apply, f"page_id {id_type}, url string, text string, path string")
