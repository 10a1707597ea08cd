"""Main text of web pages by site style trees (operator 2).

The different pages of a host are merged into one tree: an element node is the path of tags and classes that
leads to it, a style node one of the child sequences seen there. A node's content importance is one less the
mean entropy of its texts over the pages, so 1 if every page words it anew and 0 if all agree; where a node has
children too, the entropy of its styles is mixed in. Outside articles the texts that a host shows at a node are
weighed a second time by how they spread over the pages of all hosts, whose own names are masked: adverts that vary
within a host come from one pool, and that pool's entropy is low. Such a node goes if either the trees together or
that of all hosts find it of low importance. A text that many of the pages share is weighed by its own entropies.

HTML's own names are a prior with the weight of PRIORS pages: against no evidence they decide alone, against much
they lose, both ways: a block named as a menu whose texts are new on every page stays, a nameless one of a few
wordings goes. The prior of an article's headings, which many pages may share, outweighs any entropy. Two things
are no matter of importance and are never read: what no browser shows as text (scripts, drawings, controls, hidden
elements), and what readers write, which is new on every page and can only be known by its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

THRESHOLD = 0.7
#: Weight of what a node's texts say against its own styles, to the power of their number less one.
DECAY = 0.9
#: Pages that a host's tree, and those of all hosts, count for at most.
MOST_PAGES = 64
#: Kinds of a block by its names, and the importance and weight, in pages, of each as a prior.
NAMED, OTHER, PLAIN, HEADING = range(4)
PRIORS = {NAMED: (0.0, 24), OTHER: (1.0, 1e-3), PLAIN: (1.0, 32), HEADING: (1.0, 400)}
#: Removed nodes and texts of all hosts that are broadcast at most; beyond it the join shuffles.
BROADCAST_PATHS = 100_000

# HTML's own names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
FOREIGN = frozenset(["svg", "math"])
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption b i em strong a span br code sub sup small u q cite".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_CONTENT = frozenset("nav header footer aside form menu dialog".split())
NO_TEXT = frozenset("head script style noscript template iframe object embed svg math canvas audio video button select option textarea input label title".split())
#: Words that as a class, id or role name what is no content, and words that may stand beside them.
NO_CONTENT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice alert popup modal "
    "comment comments replies reply respond disqus share sharing social related recommended recommendations newsletter subscribe subscription login signup search pagination pager toolbar widget widgets complementary contentinfo dialog".split()
)
READERS = frozenset("comment comments replies reply respond disqus".split())
NAME_PARTS = frozenset("a b c box block bar bars list lists item items slot section area unit container wrapper wrap inner outer content main site page top bottom left right center link links button buttons form posts panel group row col primary secondary global local fixed sticky new thread js".split())
#: Start tags that end an open element of these kinds.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), frozenset(["p"])),
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: Elements beyond which an end tag or CLOSES does not reach.
SCOPES = frozenset("html body article section main div table ul ol dl td th blockquote nav aside header footer form".split())

_open = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_mark = re.compile("[\"'>]")
_attribute = re.compile(r"([^\s=\"'>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=\"'>/]+)")
_spaces = re.compile(r"\s+")
_digits = re.compile(r"\d+")
_parts = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


_ends = {name: re.compile(f"</{name}[^>]*>?", re.I | re.A) for name in RAW}


class _Finder:
    """Where marks stand next; what is not there any more is looked for once, so that a page is read in one pass."""

    def __init__(self, text: str):
        self.text, self.missing, self.next = text, set(), {}

    def find(self, what: str, at: int) -> int:
        """Place of a mark at or after `at`, which never goes back for the same mark; -1 if there is none."""
        found = self.next.get(what, -2)
        if found == -1 or found >= at:
            return found
        found = self.next[what] = self.text.find(what, at)
        return found

    def end_of(self, name: str, at: int) -> int:
        """Where the raw element's end tag ends; -1 if there is none."""
        if name in self.missing:
            return -1
        m = _ends[name].search(self.text, at)
        if not m:
            self.missing.add(name)
        return m.end() if m else -1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page; kind is text, open or close. Raw text elements vanish whole.

    An unended comment, script or style ends with the page, any other unended raw element at once. Once a tag's
    quotes leave it without an end, quotes mean nothing any more.
    """
    source, at, end, quotes = _Finder(html), 0, len(html), True
    while at < end:
        start = source.find("<", at)
        if start != at:
            yield "text", html[at : start if start > 0 else end], ""
            if start < 0:
                return
        at = start
        if html.startswith("<!--", at):
            stop = source.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if html.startswith(("<!", "<?"), at):
            stop = source.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        m = _open.match(html, at)
        if not m:
            yield "text", "<", ""
            at += 1
            continue
        name, stop = m.group(2).lower(), source.find(">", m.end())
        if stop < 0:
            yield "text", html[at:], ""
            return
        if quotes:
            spot = m.end()
            while (mark := _mark.search(html, spot)) and mark.group() != ">":
                spot = html.find(mark.group(), mark.end()) + 1
                if not spot:
                    mark = None
                    break
            quotes = mark is not None
            stop = mark.start() if quotes else stop
        attributes = html[m.end() : stop]
        at = stop + 1
        if m.group(1):
            yield "close", name, ""
            continue
        if name in RAW:
            stop = source.end_of(name, at)
            at = stop if stop >= 0 else end if name in ("script", "style") else at
            continue
        yield "open", name, attributes
        if attributes.endswith("/") and name in FOREIGN:
            yield "close", name, ""


def _names(attributes: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether it is hidden."""
    if not attributes or attributes.isspace():
        return "", False
    found = {(m.group(1) or m.group(3)).lower(): (m.group(2) or "").strip("\"'") for m in _attribute.finditer(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return " ".join(found[k] for k in ("class", "id", "role") if found.get(k)), hidden


def names_no_content(label: str, words: frozenset[str] = NO_CONTENT_NAMES) -> bool:
    """Whether a class, id or role says so: all its parts are known, and one of them is among the words, which name what is no content."""
    for name in label.split():
        parts = [p.lower() for p in _parts.findall(name)]
        if any(p in words for p in parts) and all(p in NO_CONTENT_NAMES or p in NAME_PARTS or p.isdigit() for p in parts):
            return True
    return False


#: Why an element's text is no content: a form holds it, a name says so, or it is never read.
FORM, CALLED, UNREAD = 1, 2, 3


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) - (1 << 63)


class Page:
    """Blocks (path, kind, text) of a page in page order, and the style of each node: the sequence of its children.

    A form is no content unless nothing else is: then it stands around the whole page. An article or main element is
    content wherever it stands.
    """

    def __init__(self, html: str, names: bool = True):
        self.blocks: list[tuple[int, int, str]] = []
        self.styles: dict[int, list[int]] = {}
        # name, path, why it is no content, whether in an article, whether plain text of one
        stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
        forms = []
        # open elements by name: those that bound others, and the rest since the last bound
        bounds, inner, held = {}, [{}], []

        def block() -> None:
            if held:
                text = _spaces.sub(" ", unescape("".join(held)).replace("\xa0", " ")).strip()
                held.clear()
                name, path, noise, article, plain = stack[-1]
                if text and noise < UNREAD:
                    if noise == FORM:
                        forms.append(len(self.blocks))
                    kind = NAMED if noise else OTHER if not (article and plain) else HEADING if name in HEADINGS else PLAIN
                    self.blocks.append((path, kind if names else OTHER, text))

        def pop() -> str:
            name = stack.pop()[0]
            if name in SCOPES:
                bounds[name] -= 1
                inner.pop()
            else:
                inner[-1][name] -= 1
            return name

        for kind, name, attributes in tokens(html):
            if kind == "text":
                held.append(name)
                continue
            if kind == "open" and name == "br":
                held.append(" ")
                continue
            if name not in BLOCKS and name not in NO_CONTENT and name not in NO_TEXT:
                continue  # inline tags neither part texts nor make branches
            block()
            if kind == "close":
                if (bounds if name in SCOPES else inner[-1]).get(name):
                    while pop() != name:
                        pass
                continue
            if name in BLOCKS:  # a block ends drawings and formulas
                while stack[-1][0] in FOREIGN:
                    pop()
            closes = CLOSES.get(name, ())
            while len(stack) > 1 and stack[-1][0] in closes:
                pop()
            if name in VOID:
                continue
            label, hidden = _names(attributes)
            _, up, noise, article, plain = stack[-1]
            inside = name in ("article", "main")
            if hidden or name in NO_TEXT or names and label and names_no_content(label, READERS):
                noise = UNREAD
            elif noise < UNREAD:
                if inside:
                    noise = 0
                elif name in NO_CONTENT - {"form"} and not (article and name == "header") or label and names_no_content(label):
                    noise = CALLED
                elif name == "form":
                    noise = max(noise, FORM)
            path = _hash(up, name, _digits.sub("0", label))
            below = self.styles.setdefault(up, [])
            if not below or below[-1] != path:
                below.append(path)
            stack.append((name, path, noise, article or inside, inside or plain and (name in TEXT_BLOCKS or name == "header") and not label))
            if name in SCOPES:
                bounds[name] = bounds.get(name, 0) + 1
                inner.append({})
            else:
                inner[-1][name] = inner[-1].get(name, 0) + 1
        block()
        if all(kind == NAMED for _, kind, _ in self.blocks):
            for i in forms:
                path, _, text = self.blocks[i]
                self.blocks[i] = (path, OTHER, text)


def masked(text: str, host: str) -> str:
    """The text with its host's name as a mark, so that what hosts word alike is equal."""
    for name in (host, host.removeprefix("www.")):
        text = text.replace(name, "\0") if name else text
    return text


def _parsed(names: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks of each page, and its nodes' texts and styles as hashes."""
        for batch in batches:
            rows = []
            for html, host in zip(batch["html"], batch["host"], strict=True):
                page = Page(html, names)
                leaves = [_hash(path, masked(text, host)) for path, _, text in page.blocks]
                kinds: dict[int, int] = {}
                for path, kind, _ in page.blocks:
                    kinds[path] = max(kinds.get(path, NAMED), kind)
                own, seen = [], set()
                for (path, _, _), leaf in zip(page.blocks, leaves, strict=True):
                    if leaf not in seen:
                        own.append((path, leaf, False, path not in seen, kinds[path]))
                        seen |= {leaf, path}
                own += [(path, _hash(*page.styles[path]), True, False, kind) for path, kind in kinds.items() if path in page.styles]
                rows.append((_hash(*leaves), [b[0] for b in page.blocks], leaves, [b[2] for b in page.blocks], own))
            out = batch[["page_id", "url", "host"]].copy()
            for i, name in enumerate(("page", "paths", "leaves", "texts")):
                out[name] = [r[i] for r in rows]
            out["nodes"] = [[dict(zip(("path", "value", "style", "first", "kind"), x, strict=True)) for x in r[4]] for r in rows]
            yield out

    return run


PARSED = "page_id long, url string, host string, page long, paths array<long>, leaves array<long>, texts array<string>, nodes array<struct<path:long,value:long,style:boolean,first:boolean,kind:int>>"


def _spread(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts(*keys, value, style, n, firsts, kind) -> (*keys, pages, kind, texts, tree): what the tree says of each node."""
    n, styles = F.col("n"), F.col("style")
    sums = counts.groupBy(*keys).agg(
        F.sum("firsts").alias("pages"), F.max("kind").alias("kind"), *[F.sum(F.when(styles == s, x)).alias(f"{name}{int(s)}") for s in (False, True) for name, x in (("n", n), ("log", n * F.log(n)))], F.count_if(styles).alias("styles")
    )
    # entropies of values over pages, on the scale of the number of pages
    log = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    leaf = F.least(F.lit(1.0), 1 - F.col("log0") / F.col("n0") / log)
    style = F.least(F.lit(1.0), 1 - F.coalesce(F.col("log1") / F.col("n1"), F.lit(0.0)) / log)
    keep = F.pow(F.lit(DECAY), F.greatest(F.col("styles") - 1, F.lit(0)))
    return sums.select(*keys, "pages", "kind", F.col("n0").alias("texts"), (keep * leaf + (1 - keep) * style).alias("tree"))


def removed(parsed: DataFrame, threshold: float) -> DataFrame:
    """(host, gone): for each host the hashes of its nodes, and of single texts of others, that are of low importance."""
    # copies of a page count once
    pages = parsed.filter(F.size("nodes") > 0).groupBy("host", "page").agg(F.first("nodes").alias("nodes"))
    nodes = pages.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    counts = stored(nodes.groupBy("host", "path", "value", "style").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts"), F.max("kind").alias("kind")))
    own = _spread(counts, ["host", "path"])
    # written first: a path that most hosts have meets its one row in a join that is split where they are many
    everywhere = stored(counts.groupBy(F.col("path").alias("_path")).agg(F.sum("firsts").alias("all_pages")))
    rated = own.join(everywhere, F.col("path") == F.col("_path")).drop("_path")
    prior, weight = F.lit(None), F.lit(None)
    for kind, (value, size) in PRIORS.items():
        prior, weight = F.when(F.col("kind") == kind, F.lit(value)).otherwise(prior), F.when(F.col("kind") == kind, F.lit(float(size))).otherwise(weight)
    evidence = lambda pages: F.least(F.col(pages) - 1, F.lit(MOST_PAGES)).cast("double")
    # what articles of several hosts say alike, quoted or copied, is theirs
    own_word = F.col("kind").isin(PLAIN, HEADING)
    here, all_ = evidence("pages"), F.when(own_word, F.lit(0.0)).otherwise(evidence("all_pages"))
    together = lambda tree, all_tree: (here * tree + all_ * all_tree + weight * prior) / (here + all_ + weight)
    spread = lambda n, pages: F.greatest(F.lit(0.0), 1 - F.log(n) / F.log(F.greatest(F.col(pages), F.lit(2))))
    # texts that several pages have: their spread over all hosts, that of the others being 1
    alike = counts.filter("not style").groupBy(F.col("path").alias("_path"), F.col("value").alias("_value")).agg(F.sum("n").alias("all_n")).filter("all_n > 1")
    shared = stored(counts.filter("not style").join(alike, (F.col("path") == F.col("_path")) & (F.col("value") == F.col("_value"))).select("host", "path", "value", "n", "all_n"))
    logs = shared.groupBy("host", "path").agg(F.sum(F.col("n") * F.log("all_n")).alias("logs"))
    mean_log = F.coalesce(F.col("logs"), F.lit(0.0)) / F.col("texts")
    all_tree = F.greatest(F.lit(0.0), 1 - mean_log / F.log(F.greatest(F.col("all_pages"), F.lit(2))))
    alone = F.when(own_word, F.lit(1.0)).otherwise((all_ * all_tree + weight * prior) / (all_ + weight))
    rated = rated.join(logs, ["host", "path"], "left")
    rated = stored(rated.withColumn("low", F.least(together(F.col("tree"), all_tree), alone) < threshold))
    # of the nodes that stay, single texts may fall
    texts = shared.join(rated.filter("not low"), ["host", "path"])
    share = F.col("n") / F.col("pages")
    low = together((1 - share) * F.col("tree") + share * spread("n", "pages"), spread("all_n", "all_pages")) < threshold
    gone = rated.filter("low").select("host", F.col("path").alias("x")).unionByName(texts.filter(low).select("host", F.col("value").alias("x")))
    return gone.groupBy("host").agg(F.sort_array(F.collect_set("x")).alias("gone"))


def host_of(url) -> F.Column:
    """Lower-cased host of a URL without its port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, threshold: float = THRESHOLD, names: bool = True) -> DataFrame:
    """Per page row: page_id, url, text. With names off the trees decide alone.

    Null html is empty and gives an empty text; pages with a null url or none share the empty host. White
    space in a block becomes one space, blocks are joined by one newline in page order. Broken markup
    is read as far as it goes, in time linear in its length; a form around a whole page is no bar to its text. Repeated rows give repeated rows and count
    once; of equal importance nothing is chosen. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    parsed = stored(rows.mapInPandas(_parsed(names), PARSED))
    gone = stored(removed(parsed, threshold).withColumnRenamed("host", "_host"))
    # templates are few: their nodes are broadcast if a count says so
    if gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0] <= BROADCAST_PATHS:
        gone = F.broadcast(gone)
    found = F.arrays_zip(F.col("paths").alias("path"), F.col("leaves").alias("leaf"), F.col("texts").alias("text"))
    kept = parsed.join(gone, F.col("host") == F.col("_host"), "left").withColumn("found", found)
    falls = lambda x: F.array_contains("gone", x["path"]) | F.array_contains("gone", x["leaf"])
    stays = lambda x: ~F.coalesce(falls(x), F.lit(False))
    text = F.array_join(F.transform(F.filter("found", stays), lambda x: x["text"]), "\n")
    return kept.select("page_id", "url", text.alias("text"))


def op2_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
