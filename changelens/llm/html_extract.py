"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens are the containers of a page (by their path) and its text blocks (path
and text).  Over the pages of a host, near-equal ones counted once, every token has an occurrence
vector, a count per page; tokens with equal vectors form an equivalence class.
A page's layout is the largest class of containers it has, so a host with several layouts has a
template for each.  Within a layout a class is valid if it has ``CLASS_TOKENS`` tokens or more and is on at least half
of the layout's pages, and on more than one.  The containers of valid classes nest by
their paths into the layout's template; its texts of valid classes are fixed, and what
other text there is fills its gaps.  The slot to extract is the container that means
the article (article, main, or a class or id that says so), or else the innermost
container that holds the gaps' text.  What is in the slot, without menus, forms and
the like, is the text, however often it is repeated on the host.  Without a slot the
body is read from its first to its last text that isn't fixed.

A host's vectors are folded to a digest by one grouped aggregate, so no task
holds the pages of a host.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import join_per_key, ship, shingle_hashes, written
from .jaccard_join import _coefficients, minhash

SHARE = 0.5
CLASS_TOKENS = 2
GAP_SHARE = 0.9
#: Pages whose word shingles meet in one of BANDS bands of ROWS MinHash values are near-equal (at a Jaccard similarity of
#: 0.9 with probability 0.99, at 0.5 with 0.03).
BANDS, ROWS = 8, 8

# Elements by what they mean.
RAW = ("script", "style", "iframe", "textarea", "title")  # no markup inside: all goes up to the end tag
EMBEDDED = frozenset("noscript template svg select object canvas button video audio".split())
UNNESTED = frozenset("select button".split())  # a start tag ends an open one
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
CONTAINERS = frozenset("html body main article section div table tbody thead tr td th ul ol dl header footer nav aside form figure blockquote "
                       "center details fieldset dialog menu address".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary legend hr option label".split())
SKIPPED = frozenset("head nav footer aside form menu dialog fieldset".split())
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side rail menu menubar nav navbar "
    "navigation topnav breadcrumb breadcrumbs footer foot header masthead topbar toolbar comments comment commentlist replies disqus respond reviews "
    "share sharing social related recommended recommendations more widget widgets pagination pager paging login search searchbox skip tags "
    "disclaimer copyright legal paywall".split())
# Words that mean advertising in any name, even of a paragraph in an article.
ADS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
MAIN_NAMES = frozenset("article content main post entry story maincontent articlebody postcontent entrycontent".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)|=|[^>=]++)*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: What ``occurrences`` tells of a token.
TOKEN = (("token", pa.int64()), ("path", pa.string()), ("text", pa.bool_()), ("n", pa.int64()), ("main", pa.bool_()), ("chars", pa.int64()))


#: What class, id, role and the like say of an element, the strongest word last.
NOTHING, PERHAPS, ADVERT, SURE, HIDDEN = range(5)


def _named(value: str) -> tuple[bool, int]:
    """What class or id names say: (main, NOTHING to SURE for skipped).

    A name whose words all mean "not main" is sure; one with such a word among
    others ("site-header") is not, though an advertising word is more than a hint.
    """
    main, says = False, NOTHING
    for name in value.split():
        words = _NAME.findall(name)
        whole = "".join(words)
        if whole in MAIN_NAMES or words and all(w in MAIN_NAMES for w in words):
            main = True
        elif whole in SKIPPED_NAMES or words and all(w in SKIPPED_NAMES for w in words):
            says = max(says, HIDDEN if ADS.intersection(words) else SURE)
        elif any(w in SKIPPED_NAMES for w in words):
            says = max(says, ADVERT if ADS.intersection(words) else PERHAPS)
    return main, says


def _meaning(name: str, attrs: str) -> tuple[str, int, bool]:
    """(path step, NOTHING to HIDDEN for skipped, main) of a start tag."""
    step, skipped, main = name, HIDDEN if name in SKIPPED else NOTHING, name in ("article", "main")
    if attrs and not attrs.isspace():
        names = NOTHING
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                if key == "class":
                    step += "." + "-".join(_NAME.findall(value))
                says = _named(value)
                main, names = main or says[0], max(names, says[1])
            elif key == "role":
                skipped, main = HIDDEN if value in SKIPPED_ROLES else skipped, main or value == "main"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                skipped = HIDDEN
        if name not in ("html", "body"):
            skipped = max(skipped, NOTHING if main and names < SURE else names)
    return step, skipped, main and skipped < SURE


def _closed(tags: list) -> set[int]:
    """Places of the start tags of embedded elements whose end tag comes before that of a container around them."""
    ends: set[int] = set()
    stack: list[tuple[str, int]] = []
    where: dict[str, list[int]] = defaultdict(list)  # places on the stack by name
    for at, m in enumerate(tags):
        name = (m["name"] or "").lower()
        if name not in EMBEDDED and name not in CONTAINERS:
            continue
        if m["close"]:
            if where[name]:
                to = where[name][-1]
                if name in EMBEDDED:
                    ends.add(stack[to][1])
                while len(stack) > to:
                    where[stack.pop()[0]].pop()
        elif not (name in EMBEDDED and m["attrs"].endswith("/")):
            if name in UNNESTED and where[name]:
                to = where[name][-1]
                while len(stack) > to:
                    where[stack.pop()[0]].pop()
            where[name].append(len(stack))
            stack.append((name, at))
    return ends


def blocks(page: str) -> tuple[list[tuple[str, str, bool, int]], dict[str, tuple[int, bool]], list[int]]:
    """Blocks of a page in order, as (path, text, skipped, characters in links), its containers as path -> (count, main), and the places of h1 blocks.

    A container inside a skipped one is skipped.  A container skipped for a word
    among others in a name is not if it holds a main container with half the text of the
    page's longest, or, on a page without text in one, half of the page's text; in the article (the whole
    page if none is named) headings and other leaves aren't skipped for such a word, headings not for any name but advertising.
    A block ends at any start or end of a container, paragraph, heading or list
    item.  Missing end tags are closed with their parents; a tag cut off at the
    end of the page is dropped.  Embedded elements (buttons, drawings, players) go
    with all inside; one that is closed in its start tag holds nothing, and one
    without an end tag only what comes before the next block.
    """
    raw: list[tuple[int, str, str, int, int]] = []  # (container, text, leaf, what its names say, characters in links)
    nodes: list[tuple[int, str, int, bool]] = [(0, "", NOTHING, False)]  # (parent, path, what its names say, main) of containers
    stack: list[tuple[str, int]] = [("", 0)]  # (tag, container) of open containers
    held: list[str] = []
    links = in_link = 0
    leaf, says = "", NOTHING  # name of the open paragraph, heading or item and what its names say

    def flush():
        nonlocal links
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        if text:
            raw.append((stack[-1][1], text, leaf, says, links))
        held.clear()
        links = 0

    at = 0
    tags = list(_TOKEN.finditer(page))
    closed = _closed(tags) if any(m["name"] and m["name"].lower() in EMBEDDED for m in tags) else ()
    inside = 0  # embedded elements that are open and have an end tag
    loose = ""  # an embedded element without one: its text ends with the next block
    opened: list[str] = []
    for place, m in enumerate(tags):
        if m.start() > at and not inside and not loose:
            held.append(page[at:m.start()])
            links += in_link and m.start() - at
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and not inside:
                held.append(" ")
            continue
        name = name.lower()
        if name in EMBEDDED:
            if m["close"]:
                if name in opened:
                    while opened.pop() != name:
                        pass
            elif place in closed:
                opened.append(name)
            elif not inside and not m["attrs"].endswith("/"):
                loose = name
            if not inside and name != "svg":
                held.append(" ")
            inside = len(opened)
            continue
        if inside:
            continue
        if name in CONTAINERS or name in LEAVES:
            loose = ""
        if name == "a":
            in_link = 0 if m["close"] else 1
        elif name == "br":
            held.append("\n")
        elif name in CONTAINERS or name == "head":
            flush()
            in_link, leaf, says = 0, "", NOTHING
            if m["close"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in VOID:
                if name == "body":
                    while stack[-1][0] == "head":
                        stack.pop()
                step, skipped, main = _meaning(name, m["attrs"])
                parent = stack[-1][1]
                path = nodes[parent][1]
                if name == "header" and "article" not in path and "main" not in path:
                    skipped = HIDDEN
                stack.append((name, len(nodes)))
                nodes.append((parent, f"{path}>{step}", skipped, main))
        elif name in LEAVES:
            flush()
            in_link, leaf, says = 0, "" if m["close"] else name, NOTHING
            if leaf and m["attrs"]:
                says = _meaning(name, m["attrs"])[1]
    if at < len(page) and not inside and not loose:
        held.append(page[at:])
    flush()
    return _resolved(raw, nodes)


def _resolved(raw: list, nodes: list) -> tuple[list, dict, list]:
    """Decide what is skipped once the whole page is known; see ``blocks``."""
    gone, within = [False], [0]  # skipped for sure, with all inside; the innermost main container around
    for i, (parent, _, says, main) in enumerate(nodes[1:], 1):
        gone.append(gone[parent] or says >= SURE)
        within.append(i if main and not gone[i] else within[parent])
    own = [0] * len(nodes)  # text of a main container outside of the main containers in it
    chars = [0] * len(nodes)
    for node, text, _, says, links in raw:
        if not gone[node] and says < SURE:
            chars[node] += len(text)
            own[within[node]] += max(0, len(text) - 2 * links)
    own[0] = 0
    longest = max(own)
    held = own[:]  # the longest main container in a container
    for i in range(len(nodes) - 1, 0, -1):
        parent = nodes[i][0]
        chars[parent] += chars[i]
        held[parent] = max(held[parent], held[i])
    skipped = [False]
    seen: dict[str, tuple[int, bool]] = {}
    for i, (parent, path, says, main) in enumerate(nodes[1:], 1):
        gives_way = 2 * held[i] >= longest if longest else 2 * chars[i] >= chars[0]
        skipped.append(skipped[parent] or says >= SURE or says > NOTHING and not gives_way)
        n, was = seen.get(path, (0, False))
        seen[path] = (n + 1, was or main and not skipped[i])
    out: list[tuple[str, str, bool, int]] = []
    titles = []
    for node, text, leaf, says, links in raw:
        least = PERHAPS
        if within[node] or not longest:
            least = ADVERT
            if leaf in HEADINGS and says == SURE:
                least = HIDDEN
        if leaf == "h1":
            titles.append(len(out))
        out.append((nodes[node][1], text, skipped[node] or says >= least, links))
    return out, seen, titles


def _token(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - 2 ** 63


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _prefixes(path: str):
    """A container's path and those of all containers around it, from the root ('')."""
    parts = F.split(path, ">")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ">"))


def occurrences(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, again): the tokens of every page (host, page, tokens), a row per distinct page, and the pages (host, page)
    that are near another page of their host with a lesser name.

    ``tokens`` has (token, path, text, n, main, chars) of each token, named by its hash.  ``text`` marks text blocks, the
    others are containers.
    """
    a, b = _coefficients(BANDS * ROWS)

    def bands(found) -> list[int]:
        words = shingle_hashes("\n".join(text for _, text, skipped, links in found if not skipped and 2 * links < len(text)))
        if not len(words):
            return []
        m = minhash(words, a, b).reshape(BANDS, ROWS)
        return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - 2 ** 63 for i, row in enumerate(m)]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in TOKEN]
        for batch in batches:
            out: list[list] = [[] for _ in TOKEN]
            ends, near = [0], []
            for page in batch.column("html").to_pylist():
                found, seen, _ = blocks(page)
                chars: dict[str, int] = defaultdict(int)
                texts: dict[int, list] = {}
                for path, text, skipped, links in found:
                    own = 0 if skipped else max(0, len(text) - 2 * links)
                    t = texts.setdefault(_token(path, text), [path, 0, 0])
                    t[1] += 1
                    t[2] += own
                    chars[""] += own
                    while own and path:
                        chars[path] += own
                        path = path.rpartition(">")[0]
                rows = [(_token(""), "", False, 1, False, chars[""])]
                rows += [(_token(p), p, False, n, main, chars[p]) for p, (n, main) in seen.items()]
                rows += [(t, p, True, n, False, c) for t, (p, n, c) in texts.items()]
                for o, v in zip(out, zip(*rows)):
                    o.extend(v)
                ends.append(len(out[0]))
                near.append(bands(found))
            rows = pa.StructArray.from_arrays([pa.array(o, k) for o, (_, k) in zip(out, TOKEN)], names=names)
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(near, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), *columns], names=["host", "page", "tokens", "bands"])

    ship(pages.sparkSession)
    schema = "host string, page long, tokens array<struct<token: long, path: string, text: boolean, n: long, main: boolean, chars: long>>, bands array<long>"
    rows = _by_host(pages).select("host", "html", "page").mapInArrow(tokens, schema).dropDuplicates(["host", "page"])
    found = written(rows, "html-found")
    near = found.select("host", "page", F.explode("bands").alias("band"))
    first = near.groupBy("host", "band").agg(F.min("page").alias("first"), F.max("page").alias("__last")).filter("first < __last").drop("__last")
    again = near.join(first, ["host", "band"]).filter("first < page").select("host", "page").distinct()
    return found.drop("bands"), written(again, "html-again")


def _by_host(pages: DataFrame) -> DataFrame:
    """``pages`` with its host, null html as empty, and ``page``, the hash that names its html."""
    html = F.coalesce("html", F.lit(""))
    return pages.withColumn("host", host_of(F.col("url"))).withColumn("html", html).withColumn("page", F.xxhash64("html"))


def _each(found: DataFrame) -> DataFrame:
    """A row for each of a page's tokens."""
    return found.withColumn("__token", F.explode("tokens")).drop("tokens").select("*", "__token.*").drop("__token")


def _vectors(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, vector, support, path, text, most, main, chars): each token with the digest of its occurrence vector over the pages of its key."""
    return found.groupBy(*keys, "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("support"), F.max("path").alias("path"), F.bool_or("text").alias("text"),
        F.max("n").alias("most"), F.bool_or("main").alias("main"), F.sum("chars").alias("chars"))


def layouts(found: DataFrame, again: DataFrame) -> DataFrame:
    """(host, page, layout): the largest class of containers, of CLASS_TOKENS or more and on several distinct pages, that a page has (0: none).

    A class is known by one of its tokens.  Of equally large classes the one on more pages counts.
    """
    held = found.withColumn("tokens", F.filter("tokens", lambda t: ~t["text"]))
    boxes = _each(held)
    per = _vectors(_each(held.join(again, ["host", "page"], "left_anti")), ["host"])
    classes = per.filter("support > 1").groupBy("host", "vector").agg(F.count("*").alias("size"), F.max("support").alias("pages"), F.min("token").alias("token"))
    classes = classes.filter(F.col("size") >= CLASS_TOKENS)
    on = boxes.groupBy("host", "token").agg(F.count("*").alias("__n"))
    known = join_per_key(boxes.select("host", "token", "page"), classes.join(on, ["host", "token"]), ["host", "token"], "__n")
    best = known.groupBy("host", "page").agg(F.max(F.struct("size", "pages", "vector"))["vector"].alias("layout"))
    return written(found.select("host", "page").join(best, ["host", "page"], "left").fillna(0, ["layout"]), "html-layouts")


def templates(pages: DataFrame) -> DataFrame:
    """The tokens of ``_templates``."""
    return _templates(pages)[0]


def _templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, layouts): (host, layout, vector, token, path, text, most, support, n_pages, n_tokens, main, chars) of all tokens on half of
    their layout's pages, and the layout of every page.

    ``vector`` digests the occurrence vector, so (host, layout, vector) is the equivalence class and ``n_tokens``
    its size.  Near-equal pages of a host count once: a page counts if no page with a
    lesser name is near it.
    """
    found, again = occurrences(pages)
    of_page = layouts(found, again)
    key = ["host", "layout"]
    counted = of_page.join(again, ["host", "page"], "left_anti")
    # a merge join at any size, so that the disk it takes grows with the pages
    per = written(_vectors(_each(found.join(counted.hint("merge"), ["host", "page"])), key), "html-tokens")
    size = per.filter("path = '' AND NOT text").select(*key, F.col("support").alias("n_pages"))
    held = per.groupBy(*key).agg(F.count("*").alias("__n"))
    often = join_per_key(per, size.join(held, key), key, "__n").drop("__n").filter(F.col("support") >= SHARE * F.col("n_pages"))
    # tokens of one class have the same support, so a class is here whole or not at all
    return often.join(often.groupBy(*key, "vector").agg(F.count("*").alias("n_tokens")), [*key, "vector"]), of_page


def slots(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, layouts): (host, layout, main, gap, common) with the path to extract (null: the whole body) and its template texts.

    ``gap``: no container means main, so the slot is the innermost template
    container, once on a page, around GAP_SHARE of the text that fills the
    template's gaps.  The list is as long as the texts that half of a host's
    pages share, which one page bounds.  Hosts whose pages are all near-equal have no
    template texts.
    """
    found, of_page = _templates(pages)
    valid, key = written(found, "html-templates"), ["host", "layout"]
    inner = F.struct((F.col("path").rlike(r">(article|main)[^>]*$")).cast("int").alias("named"), "chars",
                     F.length("path").alias("depth"), "path")
    main = valid.filter("NOT text AND main AND chars > 0").groupBy(*key).agg(F.max(inner)["path"].alias("named"))
    fixed = valid.filter((F.col("support") > 1) & (F.col("n_tokens") >= CLASS_TOKENS))
    # classes nest by path: what a template text takes of a container it takes of all containers around it
    filled = (fixed.filter("text AND chars > 0").select(*key, "chars", F.explode(_prefixes("path")).alias("path"))
              .groupBy(*key, "path").agg(F.sum("chars").alias("taken")))
    left = (F.col("chars") - F.coalesce("taken", F.lit(0))).alias("left")
    total = valid.filter("path = '' AND NOT text").join(filled, [*key, "path"], "left").select(*key, left).withColumnRenamed("left", "total")
    gaps = (fixed.filter("NOT text AND most = 1").join(filled, [*key, "path"], "left").select(*key, "path", left).join(total, key)
            .filter((F.col("total") > 0) & (F.col("left") >= GAP_SHARE * F.col("total")) & ~F.col("path").rlike(r"^(>html[^>]*)?(>body[^>]*)?$"))
            .groupBy(*key).agg(F.max_by("path", F.struct(F.size(F.split("path", ">")), "path")).alias("inner")))
    text = fixed.filter("text").groupBy(*key).agg(F.collect_list("token").alias("common"))
    slot = main.join(gaps, key, "full_outer").select(*key, F.coalesce("named", "inner").alias("main"), F.col("named").isNull().alias("gap"))
    return slot.join(text, key, "full_outer"), of_page


def _packed(page: str) -> tuple[bytes, int]:
    """What ``_text`` reads of a page: its containers, those that mean main, and the blocks that aren't skipped as (path, text, h1); zstd-packed, and its size."""
    found, seen, titles = blocks(page)
    title = set(titles)
    own = [p for p, (_, m) in seen.items() if m]
    kept = [(p, t, i in title) for i, (p, t, skipped, _) in enumerate(found) if not skipped]
    plain = json.dumps([list(seen), own, kept], ensure_ascii=False).encode()
    return pa.compress(plain, "zstd", asbytes=True), len(plain)


def _text(packed: bytes, size: int, main: str | None, gap: bool | None, common: list[int] | None) -> str:
    """The text of a page by its layout's slot; see ``extract``."""
    seen, own, found = json.loads(pa.decompress(packed, size, "zstd", asbytes=True))
    fixed = set(common or ())
    if main not in seen:
        gap = False
        named = [p for p in own if re.search(r">(article|main)[^>]*$", p)]
        main = max(named or own, key=len, default="")
    alike = [(p, t) for p, t, h1 in found if p == main or p.startswith(f"{main}>") or gap and h1 and _token(p, t) not in fixed]
    if not main or not alike:
        alike = [(p, t) for p, t, _ in found]
        free = [i for i, (p, t) in enumerate(alike) if _token(p, t) not in fixed] if fixed else []
        alike = alike[free[0]:free[-1] + 1] if free else alike
    return "\n\n".join(t for _, t in alike)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``; blocks are joined by an empty line.

    Null and empty html give an empty text; pages without a host share the empty
    host.  A page without its host's slot is read by its own article, else by its
    body.  Nothing inside a slot goes for being repeated; of a whole body the template
    texts before its first and after its last other text go, unless it has no other.
    """
    ship(pages.sparkSession)
    slot, of_page = slots(pages)
    # one narrow row per distinct page, and one join of the pages themselves: their parsed blocks move, packed, not their html
    known = written(of_page.join(slot, ["host", "layout"], "left"), "html-slots")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [_packed(page) for page in b.column("html").to_pylist()]
            columns = [pa.array([p for p, _ in packed], pa.binary()), pa.array([n for _, n in packed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns], names=[*names, "packed", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_text(*row) for row in zip(*(b.column(c).to_pylist() for c in ("packed", "size", "main", "gap", "common")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    names = ["page_id", "url", "host", "page"]
    kept = (_by_host(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).select(*names, "html")
            .mapInArrow(pack, "page_id long, url string, host string, page long, packed binary, size long"))
    # merged at any size, as above
    return (kept.join(known.hint("merge"), ["host", "page"], "left").select("page_id", "url", "packed", "size", "main", "gap", "common")
            .mapInArrow(run, "page_id long, url string, text string"))
