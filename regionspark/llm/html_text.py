"""Main text of HTML pages by equivalence-class template deduction.

Pages of one host come from a template. Tokens of a page are its start tags, told apart by their role
(name, class, id and the roles above them), and its text blocks with the role they stand in. Tokens
that occur equally often on every page of the host share an occurrence vector and form an equivalence
class. The vector is kept as sums of the halves of (page, count) hashes over the host's distinct pages,
so classes are found by an aggregate, no host's pages ever meet in one task, and repeated pages count
once.

Template. The classes of what occurs once on a page, on at least ``SUPPORT`` of the pages that have
tokens, are its frame; classes of repeated tokens nest in the places between the frame's members. An
element whose text is in its own class holds no data: that text is the same wherever the element stands
(on ``SUPPORT`` of its pages), and is template text, in the frame and in nested classes alike. What is
left are the slots. The slot that holds the pages' own words - the deepest frame element with nearly all
of them, an article first - is the main one, and so is that of each layout on at least ``VARIANT`` of
the pages.

Extraction takes the blocks of the main slot that are no template text. A page without any main slot
gives its article, else all blocks that are no template text. A heading inside an article is its title
and stays, as does a line that is on every page but stands in an element whose other text differs. Hosts of
fewer than ``MIN_PAGES`` distinct pages have too few to deduce from and use the template over all hosts.

Last resort: what differs by page and still is no article text (menus with links of the page, adverts,
forms, reader comments) can't be told by a template when it stands in the main slot. There, elements
are left out by element, role or class name. Scripts and styles never are text.

Text: character references are decoded; white space inside a block, line breaks and table cell bounds
become one space; blocks are joined in page order by one newline.

Defined cases: null or empty html gives an empty text; a null or odd url makes a host of its own;
rows that share a page_id give a row each, and page_id may be of any type; malformed markup is read
leniently (unclosed elements end with their parent, a stray ``<`` is text); an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import settle, skew_join

MIN_PAGES = 3
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*)(?P<close>>)"
    r"|<(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split())
_SPACE = frozenset("br td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOT_TEXT = frozenset("head nav aside form button select option datalist input svg math canvas object audio video map menu dialog footer header".split())
_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-?bar|rail|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|newsletter|subscribe|signup|sign-up|login|share|sharing|social|related|recommend(?:ed|ations)?|comments?|comment-list|disqus|repl(?:y|ies)|respond|toolbar|pagination|pager|skip-link|widget|masthead|site-header|page-header|topbar)(?:$|[-_\s])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[-_\s])header(?:$|[-_\s])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: A start tag of the first ends an open element of the second, if nothing of the third is between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if "=" in raw or "hidden" in raw else {}


class _Element:
    __slots__ = ("name", "role", "depth", "out", "article", "main", "words")

    def __init__(self, name, role, depth, out, article, main):
        self.name, self.role, self.depth, self.out, self.article, self.main, self.words = name, role, depth, out, article, main, 0


class Page:
    """One pass over a page: its elements' roles and its blocks, with where they stand."""

    def __init__(self, source: str, main_roles: frozenset[int] = frozenset()):
        self.blocks: list[tuple[str, bool, bool, int, bool]] = []  # text, inside article, inside main slot, role of its element, heading of an article
        self.elements: list[_Element] = []
        self.has_main = False
        self.words = 0
        self._text: list[str] = []
        root = _Element("", 0, 0, False, False, False)
        stack = [root]
        at = 0
        lower = None
        while at < len(source):
            m = _TOKEN.search(source, at)
            if not m:
                self._add(source[at:], stack)
                break
            if m.start() > at:
                self._add(source[at : m.start()], stack)
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                if name in _BLOCK:
                    self._break(stack)
                elif name in _SPACE:
                    self._text.append(" ")
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                    if stack[i].name in ("article", "main", "body") and name not in ("html", "body"):
                        break  # a stray end tag doesn't leave the article
                continue
            if name in _BLOCK:
                self._break(stack)
            elif name in _SPACE:
                self._text.append(" ")
            if name in _ENDS:
                own, stop = _ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in own:
                        del stack[i:]
                        break
                    if stack[i].name in stop:
                        break
            elif name in _BLOCK:
                for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[i].name == "p":
                        del stack[i:]
                        break
                    if stack[i].name in _BLOCK:
                        break
            raw = m["attrs"] or m["attrs2"] or ""
            if name in _VOID or (raw.endswith("/") and name not in _BLOCK and name not in _RAW):
                continue
            if name in _RAW:
                lower = lower or source.lower()
                end = lower.find(f"</{name}", at)
                at = len(source) if end < 0 else end
                stack.append(_Element(name, stack[-1].role, stack[-1].depth, True, False, False))
                continue
            parent = stack[-1]
            a = _attributes(raw)
            label = f"{a.get('class', '')} {a.get('id', '')}".strip()
            role = _hash(name, re.sub(r"\d+", "0", label), parent.role)
            article = parent.article or name in ("article", "main") or a.get("role") == "main"
            out = parent.out or self._left_out(name, label, a, parent.article)
            e = _Element(name, role, parent.depth + 1, out, article, parent.main or (role in main_roles and not out))
            self.has_main |= e.main
            self.elements.append(e)
            stack.append(e)
        self._break(stack)
        self.words = root.words

    @staticmethod
    def _left_out(name: str, label: str, a: dict[str, str], in_article: bool) -> bool:
        if name in ("html", "body", "article", "main"):
            return False
        if name == "header" or (label and _HEADER.search(label) and not _NAMES.search(label)):
            return not in_article
        if name in _NOT_TEXT or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        return bool(label and _NAMES.search(label))

    def _add(self, text: str, stack: list[_Element]) -> None:
        if not stack[-1].out:
            self._text.append(_html.unescape(text) if "&" in text else text)

    def _break(self, stack: list[_Element]) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            n = text.count(" ") + 1
            for e in stack:
                e.words += n
            e = next((e for e in reversed(stack) if e.name in _BLOCK), stack[0])
            self.blocks.append((text, e.article, e.main, e.role, e.article and e.name in _HEADINGS))


def _host(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), url, F.lit("")).alias("host")


_STAT = {"host": pa.string(), "token": pa.int64(), "kind": pa.int32(), "depth": pa.int32(), "role": pa.int64(), "sig": pa.int64(), "sig2": pa.int64(), "df": pa.int64(), "n": pa.int64(), "words": pa.int64(), "place": pa.int64(), "of": pa.int64()}
_STAT_SQL = "host string, token long, kind int, depth int, role long, sig long, sig2 long, df long, n long, words long, place long, of long"
#: Kinds of tokens: the page itself, a start tag, one of an article, a text block, all text blocks of a role.
PAGE, TAG, ARTICLE, TEXT, BLOCKS = range(5)
EVERY = "*"
#: The frame stands once on at least this share of the pages that have tokens; a variant layout on that.
SUPPORT, VARIANT = 0.9, 0.1
_PACKED = np.dtype([("token", "<u8"), ("role", "<u8"), ("kind", "u1"), ("depth", "<u2"), ("n", "<u4"), ("words", "<u4"), ("place", "<u8")])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def page_tokens(source: str) -> tuple[np.ndarray, int]:
    """(distinct tokens of a page with their counts, its words)."""
    page = Page(source)
    seen: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    for place, e in enumerate(page.elements):
        if not e.out:
            x = seen[e.role, 0, ARTICLE if e.name in ("article", "main") else TAG, e.depth]
            x[0] += 1
            x[1] += e.words
            x[2] += place
    for text, _, _, role, heading in page.blocks:
        seen[role, 0, BLOCKS, 0][0] += 1
        if not heading:
            seen[_hash(role, text), role, TEXT, 0][0] += 1
    return np.array([(*key, *x) for key, x in seen.items()], _PACKED), page.words


def _pages(batches):
    """Host, content hash and packed tokens of each page that has any (null and empty ones are no support)."""
    for b in batches:
        rows = []
        for host, source in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
            tokens, words = page_tokens(source or "")
            if len(tokens):
                key = xxhash.xxh3_128_intdigest(source)
                rows.append((host, _signed(key >> 64), _signed(key % 2**64), words, tokens.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 3, pa.binary()), strict=True)], ["host", "k1", "k2", "words", "tokens"])


def _occurrences(batches):
    """Per batch, host and token: what a sum over distinct pages needs."""
    for b in batches:
        total: dict[tuple, list[int]] = {}
        for host, k1, words, packed in zip(*(b[c].to_pylist() for c in ("host", "k1", "words", "tokens")), strict=True):
            tokens = np.frombuffer(packed, _PACKED).tolist()
            for token, role, kind, depth, n, w, place in [*tokens, (0, 0, PAGE, 0, 1, 0, 0)]:
                sig = _hash(k1, n)
                for h in (host, EVERY) if kind in (PAGE, TAG, ARTICLE) else (host,):
                    x = total.setdefault((h, token, kind, depth, role), [0, 0, 0, 0, 0, 0, 0])
                    for at, value in enumerate((sig & 0xFFFFFFFF, sig >> 32, 1, n, w, place, words)):
                        x[at] += value
        if total:
            rows = [(h, _signed(t), k, d, _signed(r), *x) for (h, t, k, d, r), x in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STAT.values(), strict=True)], list(_STAT))


def deduce(tokens: pd.DataFrame) -> dict:
    """The template of one host from its frequent tokens: equivalence classes, the frame, template texts,
    the main slot and those of variant layouts."""
    page = tokens[tokens.kind == PAGE].iloc[0]
    least = max(MIN_PAGES, VARIANT * page.df)
    classes = []
    for _, own in tokens[tokens.kind.isin((TAG, ARTICLE, TEXT))].groupby(["sig", "sig2"]):
        own = own.assign(at=own.place / own.n).sort_values(["at", "token"])
        once = (own.n == own.df).all() and own.df.iloc[0] >= SUPPORT * page.df
        classes.append((once, own))
    frame = [own for is_frame, own in classes if is_frame]
    frame = pd.concat(frame) if frame else tokens.iloc[:0].assign(at=0.0)
    tags = frame[frame.kind != TEXT]
    main = None
    if len(tags):
        most = tags.words.max()
        articles = tags[(tags.kind == ARTICLE) & (tags.words * 2 >= most)]
        holds = articles if len(articles) else tags[tags.words >= 0.8 * most]
        main = int(holds.sort_values(["depth", "token"]).token.iloc[-1 if not len(articles) else 0])
    # layouts of a part of the pages, told by the frame reaching no deeper than the body: each class's
    # element that holds nearly all words of its own pages
    variants = []
    if main is None or int(tags[tags.token == main].depth.iloc[0]) <= 2:
        for is_frame, own in classes:
            holds = own[(own.kind != TEXT) & (own.n == own.df) & (own.depth > 2) & (own.words > 0) & (own.words >= 0.8 * own.of)]
            if not is_frame and len(holds) and holds.df.iloc[0] >= least:
                articles = holds[holds.kind == ARTICLE]
                holds = (articles if len(articles) else holds).sort_values(["depth", "token"])
                variants.append(int(holds.token.iloc[0 if len(articles) else -1]))
    # an element whose blocks are the same texts wherever it stands has no slot: they are template text
    blocks = tokens[(tokens.kind == BLOCKS) & (tokens.df >= least)].set_index("token")[["df", "n"]]
    texts = tokens[tokens.kind == TEXT].join(blocks, on="role", rsuffix="_role", how="inner")
    texts = texts[texts.df >= SUPPORT * texts.df_role]
    texts = texts[texts.groupby("role").n.transform("sum") >= SUPPORT * texts.n_role]
    bounds = np.sort(tags["at"].to_numpy())
    nested = [(int(np.searchsorted(bounds, own["at"].iloc[0])), own.token.tolist()) for is_frame, own in classes if not is_frame and len(own) > 1]
    return {"main_role": main, "variants": sorted(variants), "frame": tags.token.tolist(), "template_texts": sorted(texts.token.tolist()), "nested": nested, "pages": int(page.df)}


_TEMPLATE = "host string, pages long, main_role long, variants array<long>, frame array<long>, template_texts array<long>, nested array<struct<slot:int,tokens:array<long>>>"


def _templates(tokens: pd.DataFrame) -> pd.DataFrame:
    t = deduce(tokens)
    return pd.DataFrame([{"host": tokens.host.iloc[0], "pages": t["pages"], "main_role": t["main_role"], "variants": t["variants"], "frame": t["frame"], "template_texts": t["template_texts"], "nested": [{"slot": s, "tokens": k} for s, k in t["nested"]]}]).astype({"main_role": "Int64"})


def page_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One template for each host, and one over all (host ``*``)."""
    named = pages.select(_host(F.col(url).cast("string")), F.col(html).cast("string").alias("html"))
    distinct = named.mapInArrow(_pages, "host string, k1 long, k2 long, words long, tokens binary").groupBy("host", "k1", "k2").agg(F.first("words").alias("words"), F.first("tokens").alias("tokens"))
    stats = distinct.mapInArrow(_occurrences, _STAT_SQL).groupBy("host", "token", "kind", "depth", "role").agg(*(F.sum(c).alias(c) for c in ("sig", "sig2", "df", "n", "words", "place", "of")))
    stats = settle(stats, "html-tokens")
    pages_of = stats.filter(F.col("kind") == PAGE).select("host", F.col("df").alias("pages"))
    # what is on a tenth of a host's pages: ten times the tokens of a page at most
    often = skew_join(stats, pages_of, "host", "pages").filter(F.col("df") >= F.col("pages") * VARIANT).drop("pages")
    return often.groupBy("host").applyInPandas(_templates, _TEMPLATE)


def main_text(source: str | None, main_role: int | None, template_texts=(), variants=()) -> str:
    """What a page has in its main slot - that of its variant layout, else that of the frame - without
    template texts."""
    page = Page(source or "", frozenset(variants)) if variants else None
    if page is None or not page.has_main:
        page = Page(source or "", frozenset(() if main_role is None else (main_role,)))
    drop = set(template_texts)
    blocks = [b for b in page.blocks if not drop or b[4] or _hash(b[3], b[0]) not in drop]
    if page.has_main:
        return "\n".join(b[0] for b in blocks if b[2])
    # a page that leaves the template: its article, else all that is not template text
    return "\n".join(b[0] for b in [b for b in blocks if b[1]] or blocks)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    templates = settle(page_templates(pages, url, html), "html-templates")
    every = templates.filter(F.col("host") == EVERY).select("main_role").first()
    default = every.main_role if every else None
    own = templates.filter((F.col("host") != EVERY) & (F.col("pages") >= min_pages)).select("host", "main_role", "template_texts", "variants", "pages")
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), _host(F.col(url).cast("string")), F.col(html).cast("string").alias("html"))
    joined = skew_join(named, own, "host", "pages", "left", 2_000).select("page_id", "url", "html", "main_role", "template_texts", "variants")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = []
                for source, role, texts, variants in zip(*(part[c].to_pylist() for c in ("html", "main_role", "template_texts", "variants")), strict=True):
                    role = default if role is None else role
                    got.append(main_text(source, None if role is None else role % 2**64, [t % 2**64 for t in texts or ()], [v % 2**64 for v in variants or ()]))
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return joined.mapInArrow(run, StructType([*(joined.schema[c] for c in ("page_id", "url")), StructField("text", StringType()), StructField("n_chars", LongType())]))
