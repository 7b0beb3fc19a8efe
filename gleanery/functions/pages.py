"""What a page is about: main content, safe Markdown, parsers by host, fields found again, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import columns as C
from gleanery.functions import html as H

#: Class names of main content; file types of attachments; path parts that hold them; page assets.
MAIN_CLASSES = ["article-content", "article_content", "post-content", "entry-content", "main-content", "main_content"]
FILE_TYPES = ["pdf", "docx", "doc", "xlsx", "xls", "zip", "rar", "wps", "et", "csv"]
FILE_PATHS = ["attach", "attachment", "oldfile", "files"]
ASSETS = ["js", "css", "png", "jpg", "jpeg", "gif", "ico", "svg", "html", "htm"]


def without_hidden(root: H.Node) -> H.Node:
    """The tree without what nobody sees; changed in place."""
    for node in list(root.walk()):
        node.children = [c for c in node.children if isinstance(c, str) or not (c.tag in H.NOISE or H.hidden(c))]
    return root


def running_text(root: H.Node) -> dict[int, int]:
    """Of each element the letters of text that are not inside a link, by ``id``; one walk, sums from below."""
    order, sizes = [], {}
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        sizes[id(node)] = 0 if linked or node.tag in H.UNSEEN else sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        order.append(node)
        if node.tag not in H.UNSEEN:
            stack += [(c, linked) for c in node.elements()]
    for node in reversed(order):
        if node.parent is not None and id(node.parent) in sizes and node is not root:
            sizes[id(node.parent)] += sizes[id(node)]
    return sizes


def main_node(root: H.Node, share: float = 0.6, least: int = 100) -> H.Node:
    """The container of the main content, or the body where none clearly is.

    The search goes down from the body, each time to the child with the most running text (text outside of links),
    as long as that child holds ``share`` of the whole page's and at least ``least`` letters. It ends at a semantic container
    (main, article, role main, a class of ``MAIN_CLASSES``), and before a single paragraph.
    """
    sizes = running_text(root)
    now = next((n for n in root.walk() if n.tag == "body"), root)
    whole = sizes[id(now)]

    def semantic(n):
        return n.tag in ("main", "article") or n.attrs.get("role") == "main" or any(c in n.attrs.get("class", "") for c in MAIN_CLASSES)

    while not semantic(now):
        below = [c for c in now.elements() if id(c) in sizes]
        best = max(below, key=lambda c: (semantic(c), sizes[id(c)]) if sizes[id(c)] >= least and 2 * sizes[id(c)] >= whole else (False, sizes[id(c)]), default=None)
        if best is None or best.tag == "p" or sizes[id(best)] < max(least, (0.5 if semantic(best) else share) * whole):
            break
        now = best
    return now


def extract_main(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """Outer HTML and text of the main content, hidden content gone before the choice."""

    def fn(h):
        node = main_node(without_hidden(H.parse(h)))
        return [(node.html(), node.text())]

    return H._map(df, html_col, fn, H._strings("main_html", "main_text"), keep)


def extract_safe_markdown(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """Markdown of the main content. Hidden text goes first, so it cannot steer the choice of the container."""
    return H._map(df, html_col, lambda h: [(H.markdown(main_node(without_hidden(H.parse(h)))),)], H._strings("markdown"), keep)


def extract_by_site(df: DataFrame, html_col: str, host: Column, sites: dict[str, dict], fields: list[str], keep: list[str]) -> DataFrame:
    """Rows by the first site whose ``host`` pattern fits: ``{name: {"host": regex, "row": css, "fields": {...}}}``.

    Each page is parsed once, by its own site's selectors; pages of no site and rows without any value give
    nothing. A field that a site does not name is empty. The site's name is in ``_site``.
    """
    compiled = {name: (H.compile_any(s["row"]), [H.compile_any(s["fields"][f]) if f in s["fields"] else None for f in fields]) for name, s in sites.items()}
    site = F.coalesce(*[F.when(host.rlike(s["host"]), F.lit(name)) for name, s in sites.items()])
    marked = df.select("*", site.alias("_site")).where("_site is not null")
    packed = marked.select(*keep, "_site", F.concat("_site", F.lit("\n"), F.coalesce(F.col(html_col), F.lit(""))).alias("__page"))

    def fn(page):
        name, body = page.split("\n", 1)
        row, selectors = compiled[name]
        found = [tuple(H.value(node, s) if s else "" for s in selectors) for node in H.select(H.parse(body), row)]
        return [r for r in found if any(v.strip() for v in r)]

    return H._map(packed, "__page", fn, H._strings(*fields), [*keep, "_site"])


def rescue_fields(df: DataFrame, html_col: str, fields: dict[str, str], known: dict[str, dict], keep: list[str], threshold: float = 60.0) -> DataFrame:
    """Each field by its selector; where that is blank, by the element most like the known fingerprint.

    For each field also ``<field>_action``: ``kept``, ``rescued``, or ``none`` where nothing alike has a value.
    """
    compiled = {f: H.compile_any(s) for f, s in fields.items()}
    schema = H._strings(*[n for f in fields for n in (f, f"{f}_action")])

    def fn(h):
        root, out = H.parse(h), []
        for f, selector in compiled.items():
            found, action = H.value(root, selector), "kept"
            if not found.strip():
                action = "none"
                if f in known:
                    scored = [(H.similarity(known[f], n, threshold), -i, n) for i, n in enumerate(root.walk()) if n.tag]
                    for score, _, node in sorted((x for x in scored if x[0]), key=lambda x: x[:2], reverse=True):
                        if text := node.text():
                            found, action = text, "rescued"
                            break
            out += [found, action]
        return [tuple(out)]

    return H._map(df, html_col, fn, schema, keep)


def find_similar(df: DataFrame, html_col: str, selector: str, keep: list[str], threshold: float = 60.0) -> DataFrame:
    """Other elements that are like the first match of a selector: tag, text, selector, score, next of kin (siblings, parents)."""
    compiled = H.compile_any(selector)
    schema = T.StructType([*H._strings("tag", "text", "selector"), T.StructField("score", T.DoubleType()), T.StructField("is_sibling", T.BooleanType()), T.StructField("ancestors", T.StringType())])

    def fn(h):
        root = H.parse(h)
        first = next(iter(H.select(root, compiled)), None)
        if first is None:
            return []
        known, out = H.fingerprint(first), []
        for n in root.walk():
            if n.tag and n is not first and (score := H.similarity(known, n, threshold)):
                out.append((n.tag, n.text(), H.css_path(n), score, n.parent is first.parent, H.way(n).rpartition("/")[0]))
        return out

    return H._map(df, html_col, fn, schema, keep)


def attachment_targets(html: Column, base: Column) -> tuple[Column, Column]:
    """Arrays of the attachments and of the content images of a page: absolute, in order, each once.

    Attachments are files behind a viewer, then links by file type, then links by path (without page assets).
    """

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))

    kinds = "|".join(FILE_TYPES)
    viewed = found(r"""(?i)viewer\.html\?file=([^"'&]+)""")
    linked = found(rf"""(?i)(?:href|src)=["']([^"']+\.(?:{kinds}))["']""")
    hinted = F.filter(
        found(rf"""(?i)["']([^"'?]*?/(?:{"|".join(FILE_PATHS)})/[^"']+)["']"""), lambda u: ~u.rlike(rf"(?i)\.(?:{'|'.join(ASSETS)})(?:[?#]|$)")
    )
    direct = F.filter(F.concat(linked, hinted), lambda u: ~u.rlike(r"(?i)viewer\.html"))
    images = found(r"""(?i)(?:src|href|data-src)=["']([^"']*?/(?:picture|image|img)/[^"']+?\.(?:png|jpe?g|gif))["']""")

    def absolute(urls: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(urls, lambda u: C.absolute_url(u, base)), lambda u: u != ""))

    return absolute(F.concat(viewed, direct)), absolute(images)


def records_path(value, deepest: int = 5) -> str:
    """Where a JSON document holds its records: the dotted path of a list of objects, ``.`` for the document itself.

    All lists down to ``deepest`` keys are found level by level, under known keys (`PATH_KEYS`) or at the end of a path under any
    other. One with objects goes before an empty one, then the path whose keys come first in ``PATH_KEYS``; other keys
    come after those, in the document's order. Lists of anything else do not count.
    """
    if isinstance(value, list):
        return "."
    found, level = [], [((), (), value)] if isinstance(value, dict) else []
    for _ in range(deepest):
        below = []
        for path, ranks, node in level:
            for place, (key, v) in enumerate(node.items()):
                rank = PATH_KEYS.index(key) if key in PATH_KEYS else len(PATH_KEYS) + place
                if isinstance(v, list) and (not v or isinstance(v[0], dict)):
                    found.append((not v, (*ranks, rank), (*path, key)))
                elif isinstance(v, dict) and key in PATH_KEYS:
                    below.append(((*path, key), (*ranks, rank), v))
        level = below
    return ".".join(min(found)[2]) if found else ""


#: Keys that lead to records, in order.
PATH_KEYS = ["data", "list", "rows", "items", "records", "result", "resultList", "datas", "content", "page"]
