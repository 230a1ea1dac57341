"""Main text of web pages by consensus paths per host.

1. Each page is parsed once; its containers (elements that hold blocks of text)
   are scored by the text below them, nearer blocks counting more, links not,
   and the page votes for the generalised tag-class path with the best sum.
2. Spark counts the votes per host and path; a host keeps its ``PATHS`` most
   voted paths (a list of fixed length per host).
3. Each page is parsed again and its text taken from all elements at the most
   voted path it has, or at its own best path if it has none of them.

A path is the tags from the root with their classes, digits left out, without
paragraph and inline elements. Menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are known by tag, role, class or id, and are left out
wherever they are. Of parts that are often repeated furniture, but may be the article's (``SOFT``), the host's pages
decide too: a block of them goes if more than half of the pages, three at least, have the same text at the same path.

Defined results: a null, empty or text-free page gives an empty text; a page
without a host in its url (or with a null url) uses its own best container;
unclosed and stray tags are repaired as browsers do in the common cases;
repeated rows vote as often as they occur; votes that tie go to the longer,
then the lesser path. Columns of any name pass through.
"""

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import fresh, types_of
from jobscope.session import as_written

PATHS = 3
REPEATED = 3  # pages at least that have a text, for it to be furniture
DEEPEST = 256  # containers in containers; deeper ones belong to the last
NEAR = 0.5  # what a block counts for a container one level further up
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "select", "annotation", "annotation-xml"}
IN_HEAD = RAW | {"html", "head", "base", "link", "meta"}  # whatever else begins, or text, ends an open head
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "td", "blockquote", "center", "details", "figure", "dd"}
BLOCKS = CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "table", "tbody", "thead", "tfoot", "tr", "th", "pre",
    "address", "figcaption", "summary", "header", "footer", "nav", "aside", "form", "fieldset", "hr", "menu", "dialog", "hgroup", "caption",
}
AWAY = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog", "toolbar"}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|topbar|masthead|footer|sidebar|side-?bar|aside|rail|widget|widgets|ads?|adverts?|advertisement"
    r"|advertising|adsense|adbox|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|comments?|commentlist|replies|reply|respond|disqus|breadcrumbs?|pagination|pager|search|searchform"
    r"|toolbar|skip|skip-link)(?:$|[\s_-]|\d)",
    re.I,
)
SOFT = re.compile(
    r"(?:^|[\s_-])(?:share|sharing|social|discussion|related|recommended|recommendations|hidden|copyright|legal|tags|meta)(?:$|[\s_-]|\d)", re.I
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:$|[\s_-]|\d)", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|text|article-?body)(?:$|[\s_-]|\d)", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""")
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt|dd", {"dl"}), "dd": ("dt|dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td|th", {"tr", "table"}), "th": ("td|th", {"tr", "table"})}


class _Node:
    __slots__ = ("tag", "path", "away", "good", "inside", "container", "depth", "soft")

    def __init__(self, tag, path, away, good, inside, container, depth, soft=False):
        self.tag, self.path, self.away, self.good, self.inside, self.container, self.depth = tag, path, away, good, inside, container, depth
        self.soft = soft


def _open(tag: str, attributes: str, up: _Node) -> _Node:
    classes = names = role = ""
    hidden = False
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "class":
                classes = value
            elif name == "id":
                names = value
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
    marked = f"{classes} {names}".strip()
    inside = up.inside or tag in ("article", "main") or role in ("main", "article")
    away = up.away or hidden or tag in AWAY or role in ROLES
    if not away and tag == "header":
        away = not up.inside
    if not away and marked and tag not in ("html", "body", "article", "main"):
        away = bool(NOISE.search(marked)) or not up.inside and bool(HEADER.search(marked))
    soft = up.soft or bool(marked) and tag not in ("html", "body") and bool(SOFT.search(marked))
    good = 3.0 if tag in ("article", "main") or role in ("main", "article") else 2.0 if marked and GOOD.search(marked) else 1.0
    if tag not in CONTAINERS or up.depth >= DEEPEST:
        return _Node(tag, up.path, away, good, inside, up.container, up.depth, soft)
    label = tag + "".join(f".{c}" for c in sorted(re.sub(r"\d+", "", classes).split()))
    node = _Node(tag, f"{up.path}/{label}", away, good, inside, None, up.depth + 1, soft)
    node.container = (node, up.container)
    return node


def blocks(html: str) -> list[tuple[tuple, str, int, int | None]]:
    """(container chain, text, characters of links, name of a soft block) of every block of text that is not away, in page order."""
    root = _Node("", "", False, 1.0, False, None, 0)
    root.container = (root, None)
    stack, out, piece = [root], [], []
    linked = 0

    def flush():
        nonlocal linked
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                top = stack[-1]
                out.append((top.container, text, linked, _name(top.path, text) if top.soft else None))
            piece.clear()
        linked = 0

    at, end = 0, len(html)
    in_link = 0
    while at < end:
        k = html.find("<", at)
        if k < 0:
            k = end
        if stack[-1].tag == "head" and html[at:k].strip():
            del stack[-1]
        if k > at and not stack[-1].away:
            text = html[at:k]
            if "&" in text:
                text = unescape(text)
            piece.append(text)
            if in_link:
                linked += len(text)
        if k == end:
            break
        if html.startswith("<!--", k):
            stop = html.find("-->", k + 4)
            at = end if stop < 0 else stop + 3
            continue
        if html[k + 1 : k + 2] in ("!", "?"):
            stop = html.find(">", k)
            at = end if stop < 0 else stop + 1
            continue
        m = TAG.match(html, k)
        if not m:  # a lone <
            if not stack[-1].away:
                piece.append("<")
            at = k + 1
            continue
        tag, at = m.group(1).lower(), m.end()
        if html[k + 1] == "/":
            if tag == "br":
                piece.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCKS or any(n.tag in BLOCKS for n in stack[i:]):
                        # an inline end tag does not close blocks
                        if tag not in BLOCKS:
                            break
                        flush()
                        in_link = 0
                    if tag == "a":
                        in_link = max(0, in_link - 1)
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            del stack[-1]
        if tag in RAW:
            closed = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end if closed is None else closed.end()
            continue
        if tag == "br":
            piece.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            in_link = 0
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINERS:
                    break
            if tag in CLOSES:
                same, within = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in same.split("|"):
                        del stack[i:]
                        break
                    if stack[i].tag in within:
                        break
        if tag in VOID or m.group(2).endswith("/") and tag not in BLOCKS:
            continue
        if tag == "a":
            in_link += 1
        stack.append(_open(tag, m.group(2), stack[-1]))
    flush()
    return out


def _name(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def best_path(found: list) -> str | None:
    """The path whose containers have the most text below them in sum, nearer blocks counting more."""
    score: dict[str, float] = {}
    for chain, text, linked, _ in found:
        worth = max(0, len(text) - 2 * linked)
        weight = 1.0
        while chain is not None:
            node, chain = chain
            score[node.path] = score.get(node.path, 0.0) + worth * weight * node.good
            weight *= NEAR
    # dicts keep the order in which paths were met: ties go to the first
    return max(score, key=score.__getitem__) if score else None


def _below(chain, path: str) -> bool:
    while chain is not None:
        if chain[0].path == path:
            return True
        chain = chain[1]
    return False


def extract(html: str, paths: list[str], furniture: set[int] | None = None) -> str:
    """Text at the first of the paths that the page has, else at its best path, without soft blocks that are the host's furniture."""
    found = [x for x in blocks(html) if not (furniture and x[3] in furniture)]
    for path in [*paths, best_path(found)]:
        text = [t for chain, t, *_ in found if path is not None and _below(chain, path)]
        if text:
            return "\n".join(text)
    return ""


def _vote(batches):
    """Of each page a row with its path, and a row for each soft block."""
    for batch in batches:
        hosts, paths, names = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = blocks(html) if html else []
            soft = sorted({x[3] for x in found if x[3] is not None})
            hosts += [host] * (1 + len(soft))
            paths += [best_path(found), *[None] * len(soft)]
            names += [None, *soft]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(names, pa.int64())], ["host", "path", "soft"])


def main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """The rows of pages (columns ``keep``, by default all) with the main text."""
    keep = pages.columns if keep is None else keep
    out = fresh(out, keep)
    host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    body = F.col(f"`{html}`").cast("string")
    votes = as_written(
        pages.select(host.alias("host"), body.alias("html")).filter("host <> ''")
        .mapInArrow(_vote, "host string, path string, soft bigint")
        .groupBy("host", "path", "soft").agg(F.count(F.lit(1)).alias("n")),
        "votes",
    )
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc(F.length("path")), "path")
    won = (
        votes.filter("path is not null").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PATHS)
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("won"))
    )
    sizes = votes.filter("soft is null").groupBy("host").agg(F.sum("n").alias("pages"))
    # texts that most pages have: no more than twice as many as a page has
    repeated = (
        votes.filter(F.col("soft").isNotNull() & (F.col("n") >= REPEATED)).join(sizes, "host").filter(2 * F.col("n") > F.col("pages"))
        .groupBy("host").agg(F.collect_list("soft").alias("furniture"))
    )
    winners = as_written(
        won.join(repeated, "host", "left")
        .select(F.col("host").alias("_host"), F.transform("won", lambda x: x["path"]).alias("_paths"), F.col("furniture").alias("_furniture")),
        "host-paths",
    )
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), body.alias("_html"), host.alias("_host_of"))
    joined = rows.join(winners, F.col("_host_of") == F.col("_host"), "left").select(*[F.col("_row")[c].alias(c) for c in keep], F.col("_html").alias(fresh("_html", keep)), F.col("_paths").alias(fresh("_paths", keep)), F.col("_furniture").alias(fresh("_furniture", keep)))
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(out, T.StringType())])
    kinds, raw, paths, furniture = types_of(schema), fresh("_html", keep), fresh("_paths", keep), fresh("_furniture", keep)

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (raw, paths, furniture)), strict=True)
            texts = [extract(h, p or [], set(f or [])) if h else "" for h, p, f in rows]
            columns = [*[batch.column(c) for c in keep], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return joined.mapInArrow(run, schema)
