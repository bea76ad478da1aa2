"""HTML extraction with a site style tree.

Pages of a host are merged into a style tree: an element is a node under its parent's node, named by its presentation
(tag, class, id and role); its contents are its own text blocks, and its shapes are the sequences of child tags that pages have at it.
With m distinct pages at a node (pages whose text blocks are all equal, by node and order, are copies and count once), a block that
c of them share carries log(c) / log(m) of noise. A node's importance is composed over its branch: one less the mean noise of all blocks in
and below it, by weight 1 - PRESENTATION, and the entropy of its shapes, by weight PRESENTATION. Nodes and blocks of fewer than PAGES pages are
important. A branch all of whose nodes are less important than LEAST goes, and so does a block that is less important
itself, as a closing line among the paragraphs of a text.

Names are priors: elements whose tag or name says that they aren't content (menus, headers, footers, sidebars, notices, adverts, forms,
comments) have no importance to begin with, as have elements outside the article where a page marks one. Inside a marked article such names
only take PRIOR from the importance, but for classes of reader comments, adverts, newsletters and consent, and nothing without such a name goes. A name is a
whole class, id or role; names of headings don't count.

Elements nested deeper than DEEPEST levels belong to their ancestor's node at that level, so that pages of unclosed tags take linear time and a branch has a bounded length; their text stays.

The tree is a table of (host, node), which grows with the hosts' templates: pages send the fingerprints of their nodes
and blocks, these are counted by aggregation, and each page gets back what it loses: by a broadcast of all that is lost up to BROADCAST rows,
beyond by a join on the page's fingerprint. No host's pages are gathered in one task. Pages are parsed twice, which takes less than
writing all texts in between.

Null and empty pages have an empty text. Rows are judged by their own content, so repeated rows and null ids stay as they are; a null
url is a host of its own. An empty table gives no rows. Other columns pass through unless their names are those of the results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblathe.llm.common import kept, small_batches, table
from weblathe.llm.url_filter import host

LEAST = 0.25
PRESENTATION = 0.1
#: What a telling name inside a marked article takes from a node's importance.
PRIOR = 0.3
#: Pages that a node needs before the entropy of its contents says anything.
PAGES = 8
#: Levels of the tree: elements nested deeper belong to their ancestor's node at this level.
DEEPEST = 256
#: Rows (host, lost node or block) that are broadcast.
BROADCAST = 100_000

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary header footer nav aside form fieldset hr br center hgroup search dialog".split())
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: Which open elements a start tag closes, up to which ancestor.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Tags and words in class, id or role that say that an element isn't content.
UNNAMED = {"html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
NOISE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "input", "label", "dialog", "menu", "search", "object", "embed", "canvas", "audio", "video"}
#: A whole class, id or role: such a word, also with the usual words of templates before and after it.
NOISE_NAME = re.compile(
    r"(?i)(?:(?:site|page|main|global|top|bottom|left|right|post|entry|article|blog|primary|secondary|mobile|sticky|user|google|js|c)[_-]+)*"
    r"(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|footer|header|masthead|topbar|"
    r"comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|widgets?|toolbar|pagination|pager|skip|contentinfo|complementary|search|alert|copyright|disclaimer)"
    r"(?:[_-]+(?:nav|navigation|menu|bar|box|list|links?|items?|area|section|wrapper|wrap|container|content|inner|widget|block|banner|form|buttons?|icons?|posts?|articles?|stories|media|text|top|bottom|left|right|main|primary|secondary|[0-9]+))*"
)
#: Classes and roles, but not ids, that say so inside an article too: reader comments, adverts, newsletters and consent.
STRICT_NAME = re.compile(
    r"(?i)(?:(?:reader|user|post|article|entry|page)[_-]+)?(?:comments?|commentlist|replies|respond|disqus|ads?|adverts?|advertisements?|advertising|sponsored|newsletter|subscribe|cookies?[_-](?:notice|banner|consent))"
    r"(?:[_-]+(?:list|area|section|thread|form|wrapper|wrap|container|box|block|banner|slot|unit|signup|[0-9]+))*"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg|select|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def parsed(page: str) -> tuple[bool, dict[int, list[str]], dict[int, tuple[int, ...]], list[tuple[int, bool, bool, str]]]:
    """Whether the page marks an article; the child tags of its nodes, "" before each element's; the nodes above each block's node, itself first; and its text
    blocks in page order: (fingerprint of the block's node, whether it is noise, whether it is in the article and its names say that it is noise, text).

    Where a page has an article or main element, blocks outside it are noise.
    """
    out: list[tuple[int, bool, bool, bool, str]] = []
    # tag, node, noise (its own or above it), inside the article, named as noise there, place of the nearest block
    stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, 0)]
    tags: dict[int, list[str]] = {}
    parents: dict[int, int] = {}
    above: dict[int, tuple[int, ...]] = {}
    words: list[str] = []
    known: dict = {}
    opened: Counter = Counter()

    def flush():
        if words:
            if text := " ".join("".join(words).split()):
                _, node, _, inside, named, _ = stack[stack[-1][5]]
                if node not in above:
                    chain = [node]
                    while chain[-1]:
                        chain.append(parents[chain[-1]])
                    above[node] = tuple(chain)
                out.append((node, stack[-1][2], inside, named, text))
            words.clear()

    def close(i):
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]

    def put(text):
        if text:
            if stack[-1][2] and not stack[-1][5]:
                flush()
            words.append(html.unescape(text))

    at = 0
    for m in TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if not opened[tag]:
                if tag in ("p", "br"):
                    flush()
                continue
            i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
            if stack[-1][2] or stack[-1][5] >= i:
                flush()
            close(i)
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P and opened["p"]:
            close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"))
        if tag in CLOSES:
            closes, up_to = CLOSES[tag]
            if any(opened[x] for x in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in up_to:
                        break
                    if stack[i][0] in closes:
                        close(i)
                        break
        attrs = m[4]
        _, parent, noise, inside, named, nearest = stack[-1]
        tags.setdefault(parent, []).append(tag)
        if tag in VOID:
            continue
        key = (parent, tag, attrs, inside)
        if key not in known:
            names = {k.lower(): (a or b or c) for k, a, b, c in reversed(NAMES.findall(attrs))} if attrs else {}
            label = "\0".join([tag, *(f"{k}={names[k]}" for k in sorted(names))])
            telling = tag not in UNNAMED and any(NOISE_NAME.fullmatch(x) for k, v in names.items() for x in ([v.strip()] if k == "id" else v.split()))
            strict = tag not in UNNAMED and any(STRICT_NAME.fullmatch(x) for k, v in names.items() if k != "id" for x in v.split())
            own = tag in NOISE_TAGS or (tag == "header" and not inside) or (telling and not inside) or strict
            article = tag in ("article", "main") or names.get("role", "").lower() == "main"
            known[key] = (xxhash.xxh3_64_intdigest(label, parent), own, article and not own, telling and inside)
        node, own, article, telling = known[key]
        if len(stack) > DEEPEST:
            node = parent
        else:
            tags.setdefault(node, []).append("")
            parents[node] = parent
        if own and not noise:
            flush()
        opened[tag] += 1
        stack.append((tag, node, noise or own, inside or (article and not noise), named or telling, len(stack) if tag in BLOCK else nearest))
    put(page[at:])
    flush()
    marked = any(inside and not noise for _, noise, inside, _, _ in out)
    return marked, tags, above, [(node, noise or (marked and not inside), named, text) for node, noise, inside, named, text in out]


_MASK = 0xFFFFFFFFFFFFFFFF


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def nodes(pages: DataFrame) -> DataFrame:
    """Of (host, page, html): (host, page, marked, content, node, named, shape, above, blocks) for each node with text of a page that its names don't rule out.

    marked: whether the page marks an article; content: fingerprint of all these nodes' blocks, equal for copies of a page;
    named: whether the node is in the article and its names say that it is noise; shape: fingerprint of the node's child tags;
    above: the nodes of its branch, itself first.
    """
    names = ["host", "page", "marked", "content", "node", "named", "shape", "above", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, k, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found: dict[int, list[int]] = {}
                whole = xxhash.xxh3_64()
                marked, tags, above, all_blocks = parsed(text or "")
                telling = {n for n, _, named, _ in all_blocks if named}
                for n, noise, _, block in all_blocks:
                    if not noise:
                        b = xxhash.xxh3_64_intdigest(block)
                        found.setdefault(n, []).append(b)
                        whole.update(n.to_bytes(8, "little") + b.to_bytes(8, "little"))
                content = whole.intdigest()
                rows += [(h, k, marked, content, n, n in telling, xxhash.xxh3_64_intdigest(" ".join(tags.get(n, ()))), above[n], blocks) for n, blocks in found.items()]
            if rows:
                hosts, keys, marks, contents, node, soft, shapes, chains, lists = zip(*rows)
                arrays = [pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(marks), pa.array(_signed(contents)), pa.array(_signed(node)), pa.array(soft), pa.array(_signed(shapes)), _listed(chains), _listed(lists)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pages.select("host", "page", "html").mapInArrow(run, "host string, page long, marked boolean, content long, node long, named boolean, shape long, above array<long>, blocks array<long>")


def _listed(lists) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed([x for part in lists for x in part])))


def importance(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, node, importance) of the style tree's nodes with text, and (host, node, block, importance) of the blocks of PAGES pages or more."""
    once = found.groupBy("host", "node", "content").agg(F.min("shape").alias("shape"), F.min("blocks").alias("blocks"))
    size = once.groupBy("host", "node").agg(F.count(F.lit(1)).alias("m"))
    shapes = once.groupBy("host", "node", "shape").agg(F.count(F.lit(1)).alias("n"))
    # sum over shapes of -(n/m) log_m(n/m) = log_m(m) - sum(n log n) / (m log m)
    shape = shapes.groupBy("host", "node").agg(F.sum(F.col("n") * F.log("n")).alias("shape"))
    keys = ["host", "node"]
    shared = once.select(*keys, F.explode(F.array_distinct("blocks")).alias("block")).groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("c"))
    shared = kept(shared)
    noise = shared.groupBy(*keys).agg(F.sum(F.log("c") * F.col("c")).alias("noise"), F.sum("c").alias("weight"))
    m = F.col("m")
    often = kept(size.join(shape, keys).join(noise, keys).withColumns({"noise": F.when(m < PAGES, 0.0).otherwise(F.col("noise") / F.log(m)), "variety": F.when(m < PAGES, 1.0).otherwise(1 - F.col("shape") / (m * F.log(m)))}))
    chains = found.select(*keys, "above").distinct()
    below = chains.join(often, keys).select("host", F.explode("above").alias("node"), "noise", "weight")
    branch = below.groupBy(*keys).agg((1 - F.sum("noise") / F.sum("weight")).alias("content"))
    value = F.when(m < PAGES, 1.0).otherwise((1 - PRESENTATION) * F.col("content") + PRESENTATION * F.col("variety"))
    blocks = shared.filter(F.col("c") > 1).join(often.filter(m >= PAGES).select(*keys, "m"), keys)
    return often.join(branch, keys).select(*keys, value.alias("importance")), blocks.select(*keys, "block", (1 - F.log("c") / F.log(m)).alias("importance"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", least: float = LEAST) -> DataFrame:
    """pages, without html, with text and n_chars."""
    small_batches(pages.sparkSession)
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars", page.lower())]
    rows = pages.select(F.struct(*[F.col(c) for c in names]).alias("given"), F.coalesce(F.col(page), F.lit("")).alias("html"), F.coalesce(host(F.col(url)), F.lit("")).alias("host"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    found = kept(nodes(rows))
    of_nodes, of_blocks = importance(found)
    low = of_nodes.filter(F.col("importance") < least + PRIOR).select("host", "node", F.col("node").alias("lost"), (F.col("importance") < least).alias("whole"))
    same = of_blocks.filter(F.col("importance") < least).select("host", "node", F.col("node").bitwiseXOR(F.col("block")).alias("lost"), F.lit(True).alias("whole"))
    low = kept(low.unionByName(same))
    # lost everywhere but in marked articles; lost where names in an article say that a node is noise
    sets = [F.collect_set(F.when(F.col("whole"), F.col("lost"))).alias("lost"), F.collect_set(F.when(F.col("lost") == F.col("node"), F.col("lost"))).alias("soft")]
    if low.count() <= BROADCAST:
        rows = rows.join(F.broadcast(low.groupBy("host").agg(*sets)), "host", "left")
    else:
        rows = rows.join(found.select("host", "node", "page").distinct().join(low, ["host", "node"]).groupBy("page").agg(*sets), "page", "left")
    out = rows.select("given", "html", "lost", "soft")
    given = out.schema["given"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, *gone in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                lost, soft = ({x & _MASK for x in some or ()} for some in gone)
                marked, _, _, blocks = parsed(source)
                texts.append(" ".join(text for node, noise, named, text in blocks if not (noise or named and node in soft or not marked and _goes(node, text, lost))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["given", "text", "n_chars"])

    made = out.mapInArrow(run, T.StructType([T.StructField("given", given), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return made.select(*[F.col("given")[c].alias(c) for c in names], "text", "n_chars")


def _goes(node: int, text: str, lost: set[int]) -> bool:
    """Whether the block's own node, with its branch, or the block itself is lost."""
    return bool(lost) and (node in lost or node ^ xxhash.xxh3_64_intdigest(text) in lost)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
