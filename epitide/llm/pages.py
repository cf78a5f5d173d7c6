"""Main text of web pages by a site style tree: same-host pages merged, unimportant branches removed."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import text_key
from epitide.session import cut

#: The lists of unimportant nodes are broadcast only if they have no more bytes than this.
BROADCAST_BYTES = 16 << 20

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br img".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video".split())
CONTENT = frozenset("article main".split())
#: Elements around the whole page, whose names say nothing of a branch.
WHOLE = frozenset("html body".split())
NOISE = frozenset("head title nav aside footer form button select option label textarea menu dialog input fieldset".split())
#: Noise elements that some sites put around the whole page, and those whose end tag is often left out.
FRAMES, PANELS = frozenset("form fieldset label".split()), frozenset("nav aside footer menu".split())
#: Parts of class names and ids that say what a branch is for, and parts that say nothing.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies "
    "respond disqus share social related subscribe newsletter login signup search widget".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons card cards col column container content cta desktop fixed footer form frame global group head "
    "holder icons inner item items js left link links list logo main mobile module nav outer page panel post posts primary reader readers right row "
    "section secondary site slot slots sticky tertiary text thread title top ui unit units user users view widgets wrap wrapper zone".split())
#: An open element of these is never closed by what starts inside it.
SCOPE = frozenset("html body article main section div ul ol dl table blockquote nav aside footer header form".split())

#: Weights of presentation and content in the importance of a node, and the least importance that stays.
SHOWN, SAID, KEEP_FROM = 0.55, 0.45, 0.5
#: Presentation of a node whose names call it content: it goes if its texts are the same on nearly all of many pages.
CONTENT_SHOWN = 0.75
#: Prior of a branch one of whose names has a noise word beside words of other kind (search-results, header-story).
DOUBTFUL = 0.25
#: What m pages of a host say weighs (m - 1) / (m - 1 + DOUBT); the rest is what one page says.
DOUBT = 4.0
BLOCK = "array<struct<text:string,node:bigint,prior:double>>"
COUNTED = "array<struct<feature:bigint,fresh:boolean,node:bigint,first:boolean,style:bigint,prior:double>>"


class Page(HTMLParser):
    """Blocks of a page in order, each with the style node that holds it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: Open elements, each with its path and the number of its branch.
        self.stack: list[tuple[str, str, int]] = [("#", "", 0)]
        #: Of each branch: the one above, its path, what its element and names say, article or main below it or not, end tag or not.
        self.above, self.paths, self.says, self.holds, self.ended = [0], [""], ["open"], [False], [False]
        self.parts: list[str] = []
        self.silent = 0
        self.blocks: list[tuple[str, str]] = []
        self.children: dict[str, dict[str, None]] = {}
        self.feed(html)
        self.close()
        self.end_block()
        self.prior = self.priors()

    def priors(self) -> dict[str, float]:
        """Least prior of the branches of each path: 1 in an article or main element, 0 in what is called noise, else 0.5.

        One word in a class or id does not speak for a branch with an article in it, nor for the whole page. A form around an
        article is a frame of the page; a menu, footer or the like without an end tag ends where an article begins: its own
        texts are noise, the article is none. A name of which a noise word is a part only makes a branch ``DOUBTFUL``.
        """
        each, ends, least = [0.5], [0.5], {"": 0.5}
        for i in range(1, len(self.above)):
            prior, says, holds = each[self.above[i]], self.says[i], self.holds[i]
            lifted = ends[self.above[i]] if holds or says == "content" else prior
            below = None
            if says == "panel" and holds and not self.ended[i]:
                prior, below = 0.0, max(lifted, 0.5) if lifted > 0 else 0.0
            elif says == "frame" and holds and lifted > 0:
                prior = min(lifted, 0.5)
            elif says in ("noise", "panel", "frame") or (says == "named" and not holds) or (says == "header" and prior < 1):
                prior = 0.0
            elif says == "content" and lifted > 0:
                prior = 1.0
            elif says == "doubtful" and lifted > 0:
                prior = 0.5
            elif says == "partly" and not holds:
                prior = min(prior, DOUBTFUL)
            elif holds:
                prior = lifted
            each.append(prior)
            ends.append(prior if below is None else below)
            least[self.paths[i]] = min(prior, least.get(self.paths[i], prior))
        return least

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.blocks.append((text, self.stack[-1][1]))

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            if tag not in VOID:
                self.silent += 1
                self.stack.append((tag, self.stack[-1][1], self.stack[-1][2]))
            return
        if tag in INLINE:
            if tag == "br":
                self.parts.append("\n")
            elif tag not in VOID:
                self.stack.append((tag, self.stack[-1][1], self.stack[-1][2]))
            return
        self.end_block()
        if tag in CLOSES or (tag not in VOID and any(t == "p" for t, _, _ in self.stack)):
            ends = CLOSES.get(tag, {"p"}) | {"p"}
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in ends and not (tag == "li" and self.stack[i][0] != "li" and self.stack[i][0] != "p"):
                    del self.stack[i:]
                    break
                if self.stack[i][0] in SCOPE:
                    break
        _, above, branch = self.stack[-1]
        names = [x for k, v in attrs if k in ("class", "id") and v for x in v.split()]
        parts = [set(filter(None, n.lower().replace("_", "-").split("-"))) for n in names]
        words = {w for n in parts for w in n} | {v for k, v in attrs if k == "role" and v}
        name = f"{tag}.{names[0].lower()}" if names else tag
        path = above if above.rpartition("/")[2] == name else f"{above}/{name}"
        plain = any(n & NOISE_NAMES and all(w in NOISE_NAMES or w in NEUTRAL or w.isdigit() for w in n) for n in [*parts, words - set().union(*parts)])
        if tag in NOISE:
            says = "frame" if tag in FRAMES else "panel" if tag in PANELS else "noise"
        elif words & NOISE_NAMES and tag not in WHOLE:
            says = "doubtful" if tag in CONTENT else "named" if plain else "partly"
        else:
            says = "header" if tag == "header" else "content" if tag in CONTENT or "main" in words else "open"
        if says == "content":
            up = branch
            while up and not self.holds[up]:
                self.holds[up] = True
                up = self.above[up]
        self.children.setdefault(above, {})[name] = None
        for column, value in ((self.above, branch), (self.paths, path), (self.says, says), (self.holds, False), (self.ended, tag in VOID)):
            column.append(value)
        if tag not in VOID:
            self.stack.append((tag, path, len(self.above) - 1))

    def handle_endtag(self, tag):
        if tag not in INLINE and tag not in SILENT:
            self.end_block()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if tag not in INLINE and tag not in SILENT:
                    self.ended[self.stack[i][2]] = True
                self.silent -= sum(t in SILENT for t, _, _ in self.stack[i:])
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def page_blocks(html: str | None) -> list[dict]:
    """Text, style node and prior of each block."""
    page = Page(html or "")
    return [{"text": text, "node": signed(path), "prior": page.prior[path]} for text, path in page.blocks]


def page_counts(html: str | None) -> list[dict]:
    """What the style tree counts of each block: the text as a number, new on the page or not, and the style
    (child elements) of its node, at the node's first block."""
    page = Page(html or "")
    texts, nodes, out = set(), set(), []
    for text, path in page.blocks:
        out.append({"feature": signed(text), "fresh": (path, text) not in texts, "node": signed(path),
                    "first": path not in nodes, "style": signed(" ".join(page.children.get(path, ()))),
                    "prior": page.prior[path]})
        texts.add((path, text))
        nodes.add(path)
    return out


def parsed(html: Column, kind: str, read) -> Column:
    """``read`` of each page, an array column of type ``kind``."""
    fields = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    names = [f.split(":") for f in kind.removeprefix("array<struct<").removesuffix(">>").split(",")]
    arrow = pa.list_(pa.struct([(n, fields[t]) for n, t in names]))

    @F.arrow_udf(kind)
    def parse(pages: pa.Array) -> pa.Array:
        return pa.array([read(p.as_py()) for p in pages], arrow)

    return parse(html)


def host(url: Column) -> Column:
    """Host of a URL in lower case; the empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(blocks: DataFrame) -> DataFrame:
    """host, node, pages, prior, importance: the pages of each host merged into one tree of style nodes.

    A node is a path of element names with their first class; of a branch, the nodes that hold text
    decide. Its content importance is 1 minus the mean entropy, over the m pages that have the node,
    of the texts in it: a text of one page has entropy 0, one of all pages log m / log m = 1. The entropies
    count by a weight that grows gradually with m. Its
    presentation importance starts from what its names say (article, menu, ...) and, where they say
    nothing, grows with the entropy of the child styles it shows. Counts are aggregated map-side
    by (host, node, text) and by (host, node, style), so a host with a third of all pages is spread
    by its texts.
    """
    features = (blocks.where("fresh").groupBy("host", "node", "feature").agg(F.count(F.lit(1)).alias("k"))
                .groupBy("host", "node").agg(F.sum(F.col("k") * F.log("k")).alias("text_sum"), F.sum("k").alias("texts")))
    styles = (blocks.where("first").groupBy("host", "node", "style").agg(F.count(F.lit(1)).alias("k"), F.min("prior").alias("prior"))
              .groupBy("host", "node").agg(F.sum(F.col("k") * F.log("k")).alias("style_sum"), F.sum("k").alias("pages"),
                                           F.min("prior").alias("prior")))
    spread = F.log(F.col("pages"))
    trust = (F.col("pages") - 1) / (F.col("pages") - 1 + F.lit(DOUBT))
    content = F.when(F.col("pages") > 1, 1 - trust * F.least(F.lit(1.0), F.col("text_sum") / F.col("texts") / spread)).otherwise(1.0)
    styled = F.when(F.col("pages") > 1, 0.5 + trust * (0.5 - F.col("style_sum") / F.col("pages") / spread)).otherwise(0.5)
    shown = F.when(F.col("prior") == 0.5, 0.25 + 0.5 * styled).when(F.col("prior") == DOUBTFUL, 0.1 + 0.3 * styled).when(F.col("prior") == 1, F.lit(CONTENT_SHOWN)).otherwise(F.col("prior"))
    return features.join(styles, ["host", "node"]).select(
        "host", "node", "pages", "prior", (SHOWN * shown + SAID * content).alias("importance"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text of every page: what is left when branches of low importance are removed.

    A branch that its names call a menu, footer, advert and so on is always below KEEP_FROM; for all others the
    entropies of the host's pages decide, inside an article or main element from a higher importance, in a branch whose
    names only hold such a word (search-results) from a lower one. An article in a form, or after the start of a menu
    that never ends, stays. Blocks are joined in page order by an empty line, white space inside a block is one space.

    NULL and empty pages have an empty text, pages without a host share one tree. Repeated rows
    and NULL ids stay as they are, an empty table gives an empty one, other columns are not read.

    Equal pages of a host count once in its tree, and each of them has the text.

    Pages are parsed once for the counts and once for the text, so no text is moved or written on
    the way: only numbers of blocks are aggregated, map-side for equal pages, and each page gets the list of its host's
    unimportant nodes, of those whose names do not call them noise. The lists are broadcast if their
    measured bytes allow it and joined by host otherwise.
    """
    counted = (pages.select(host(F.col(url)).alias("host"), text_key(F.col(html)).alias("page"), parsed(F.col(html), COUNTED, page_counts).alias("b"))
               .groupBy("host", "page").agg(F.first("b").alias("b")))
    blocks = cut(counted.select("host", F.explode("b").alias("b")).select("host", "b.*"), "blocks")
    low = (style_tree(blocks).where((F.col("importance") < KEEP_FROM) & (F.col("prior") > 0))
           .groupBy("host").agg(F.collect_set("node").alias("low")))
    low = cut(low.select("host", "low", F.size("low").alias("nodes")), "low")
    size = low.agg(F.coalesce(F.sum(F.col("nodes") * 8 + 64), F.lit(0))).first()[0]
    low = low.select(F.col("host").alias("_host"), "low")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"),
                        parsed(F.col(html), BLOCK, page_blocks).alias("b"))
    rows = rows.join(F.broadcast(low) if size <= BROADCAST_BYTES else low, F.col("host") == F.col("_host"), "left")
    known = F.when(F.col("low").isNull(), F.array().cast("array<bigint>")).otherwise(F.col("low"))
    stay = F.filter("b", lambda x: (x["prior"] > 0) & ~F.array_contains(known, x["node"]))
    return rows.select("page_id", "url", F.array_join(F.transform(stay, lambda x: x["text"]), "\n\n").alias("text"))
