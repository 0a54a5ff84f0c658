"""Main text of web pages, by structure first and by a host-wide suffix array where structure doesn't tell.

A page is cut into blocks. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and the
like (by element, role, class or id) go. If the page has text inside ``article`` or ``main``, that is its main text. A
page without such an element is undecided: all its other blocks are candidates, and the token streams of its host tell
which are boilerplate. The streams of a host's pages (what lies outside main text) are concatenated, page after
page, and a suffix array over them (ordered by the first ``RUN`` tokens, which is all that covering needs) finds every
run of at least ``RUN`` tokens that recurs in a page with another stream (equal ones count once). Tokens that such runs cover are removed and the
unique runs are kept.

The method on its own can't give the wanted text: it would delete an article that two pages of a host share, and
keep a menu that only one page has. So it decides what the markup leaves open, and nothing else.

A host may hold a third of all pages: it is split into chunks of at most ``CHUNK_PAGES`` pages, each chunk's suffix
array emits one row for each distinct run it holds (its hash, the smallest and largest page that has it), and equal runs of
several chunks meet in an aggregation. Nothing is capped.

Null html is empty; null urls share the empty host. Rows that repeat a page are extracted each. Character references
are decoded, white space in a block becomes one space, and blocks are joined by a line break. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

RUN = 8
CHUNK_PAGES = 2000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|template|svg|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav header footer aside form menu dialog button select option fieldset head object audio video canvas map".split())
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open paragraph.
CLOSES_P = BLOCKS - {"br", "button", "caption", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "legend"}
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|overlay|comments?|disqus|replies|sidebar|side|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|header|masthead|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|widget|pagination|pager|disclaimer|copyright|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|advert\w*|ads?)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def _flags(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is main."""
    skip, main = tag in SKIPPED, tag in ("article", "main")
    if attributes and not attributes.isspace():
        if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
            skip = True
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id") and tag not in ("html", "body"):
                skip = skip or bool((REMARKS if tag in ("article", "main") else MARKED).search(value))
            elif name == "role":
                skip = skip or value.lower() in ROLES
                main = main or value.lower() == "main"
            elif name == "itemprop":
                main = main or value == "articleBody"
            elif name == "style":
                skip = skip or bool(re.search(r"display\s*:\s*none", value, re.I))
    return skip, main


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """Blocks in page order: text, whether markup calls it boilerplate, whether it lies in a main element."""
    found: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]

    def end_block():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, stack[-1][1], stack[-1][2]))
            parts.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        closing, tag = m.group(2), m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end_block()
        if tag in VOID:
            continue
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                if stack[depth][1] != stack[-1][1] or stack[depth - 1][1:] != stack[-1][1:]:
                    end_block()
                del stack[depth:]
            continue
        if tag in CLOSES_P or tag == "p":
            k = len(stack) - 1
            while k > 0 and stack[k][0] not in BLOCKS:
                k -= 1
            if k > 0 and stack[k][0] == "p":
                del stack[k:]
        skip, main = _flags(tag, m.group(4))
        if skip or main:
            end_block()
        if not m.group(4).endswith("/"):
            stack.append((tag, stack[-1][1] or skip, stack[-1][2] or main))
    parts.append(page[at:])
    end_block()
    return found


def main_text(page: str) -> str | None:
    """The main text, or None if the markup doesn't tell."""
    found = blocks(page)
    if not found:
        return ""
    main = [t for t, skip, inside in found if inside and not skip]
    if main or any(inside for _, _, inside in found):
        return "\n".join(main)
    return None if any(not skip for _, skip, _ in found) else ""


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


# The suffix array of a chunk of pages


def suffix_array(codes: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` (a power of two) tokens, and the rank of each position's prefix, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def chunk_runs(streams: list[tuple[int, list[str]]], depth: int = RUN) -> list[tuple[bytes, int, int]]:
    """Distinct runs of ``depth`` tokens of pages ``(number, tokens)``: hash, smallest and largest page that has it."""
    vocabulary: dict[str, int] = {}
    codes: list[int] = []
    pages: list[int] = []
    left: list[int] = []
    for k, (_, tokens) in enumerate(streams):
        codes += [vocabulary.setdefault(t, len(vocabulary)) for t in tokens]
        # A separator that no other page has.
        codes.append(-1 - k)
        pages += [k] * (len(tokens) + 1)
        left += range(len(tokens), -1, -1)
    if not codes:
        return []
    order, rank = suffix_array(np.array(codes), depth)
    whole = np.array(left)[order] >= depth
    order = order[whole]
    if not len(order):
        return []
    ranked, numbers = rank[order], np.array([n for n, _ in streams], np.int64)[np.array(pages)[order]]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    low, high = np.minimum.reduceat(numbers, first), np.maximum.reduceat(numbers, first)
    words = list(vocabulary)
    return [(run_hash([words[codes[p + i]] for i in range(depth)]), int(a), int(b)) for p, a, b in zip(order[first], low, high, strict=True)]


def run_hash(tokens: list[str]) -> bytes:
    return hashlib.blake2b("\0".join(tokens).encode(), digest_size=16).digest()


def unique_text(found: list[str], covered: set[int], depth: int = RUN) -> str:
    """Blocks without the tokens that repeated runs (given by where they start in the page's stream) cover."""
    at, kept = 0, []
    gone = {s + i for s in covered for i in range(depth)}
    for text in found:
        tokens = text.split(" ")
        left = [t for i, t in enumerate(tokens, at) if i not in gone]
        at += len(tokens)
        if left:
            kept.append(" ".join(left))
    return "\n".join(kept)


# Distributed


def _undecided(rows: DataFrame) -> DataFrame:
    """Text of undecided pages, by their host's repeated runs: __row, text."""

    @F.pandas_udf("array<string>")
    def streams(pages: pd.Series) -> pd.Series:
        """Blocks outside main text; of undecided pages, only those that markup doesn't call boilerplate."""
        out = []
        for p in pages:
            found = blocks(p)
            main = any(inside for _, _, inside in found)
            out.append([t for t, skip, inside in found if (not inside if main else not skip)])
        return pd.Series(out)

    open_rows = rows.where("__text is null").select("__row", "__host", "__page", streams("__html").alias("blocks"))
    hosts = open_rows.select("__host").distinct()
    side = rows.join(hosts, "__host", "left_semi").select("__row", "__host", streams("__html").alias("blocks"))
    size = rows.groupBy("__host").agg(F.ceil(F.count(F.lit(1)) / CHUNK_PAGES).alias("__chunks"))
    # Pages with the same stream (mirrors) are one page to the runs, or they would empty each other.
    side = side.join(size, "__host").withColumn("__stream", F.xxhash64("blocks")).withColumn("__chunk", F.pmod(F.xxhash64("__row"), F.col("__chunks")))

    def runs(group: pd.DataFrame) -> pd.DataFrame:
        streams = [(int(r), [t for b in found for t in b.split(" ")]) for r, found in zip(group["__stream"], group["blocks"], strict=True)]
        return pd.DataFrame([(group["__host"].iloc[0], *x) for x in chunk_runs(streams)], columns=["__host", "__run", "low", "high"])

    repeated = (
        side.groupBy("__host", "__chunk")
        .applyInPandas(runs, "__host string, __run binary, low long, high long")
        .groupBy("__host", "__run")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low < high")
        .select("__host", "__run", F.lit(True).alias("__hit"))
    )

    def positions(batches):
        for b in batches:
            out = []
            for r, h, found in zip(b["__row"], b["__host"], b["blocks"], strict=True):
                tokens = [t for x in found for t in x.split(" ")]
                out += [(r, h, i, run_hash(tokens[i : i + RUN])) for i in range(len(tokens) - RUN + 1)]
            yield pd.DataFrame(out, columns=["__row", "__host", "at", "__run"])

    marks = (
        salted_join(open_rows.mapInPandas(positions, "__row long, __host string, at int, __run binary"), repeated, ["__host", "__run"], F.struct("__row", "at"))
        .where("__hit")
        .groupBy("__row")
        .agg(F.collect_set("at").alias("starts"))
    )

    @F.pandas_udf("string")
    def kept(found: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([unique_text(list(b), set() if s is None else set(s)) for b, s in zip(found, starts, strict=True)])

    return open_rows.join(marks, "__row", "left").select("__row", kept("blocks", "starts").alias("__kept"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text and n_chars."""

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([main_text(t) for t in texts], dtype=object)

    def finished(rows: DataFrame, text) -> DataFrame:
        return rows.select(F.col("__page").alias(id_col), F.col("__url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

    rows = pages.select(
        F.col(id_col).alias("__page"),
        F.col(url_col).alias("__url"),
        host_of(F.col(url_col)).alias("__host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("__html"),
    )
    rows = rows.withColumn("__row", F.xxhash64("__page", "__url", "__html"))
    told_rows = rows.withColumn("__text", told("__html"))
    decided = finished(told_rows.where("__text is not null"), F.col("__text"))
    # Hosts with an undecided page, written once; where there are none, the suffix arrays have nothing to decide.
    open_hosts = cut(told_rows.where("__text is null").select("__host").distinct())
    if open_hosts.isEmpty():
        return finished(told_rows, F.coalesce("__text", F.lit("")))
    in_question = cut(told_rows.join(open_hosts, "__host", "left_semi"))
    texts = _undecided(in_question)
    undecided = in_question.where("__text is null").join(texts.dropDuplicates(["__row"]), "__row")
    return decided.unionByName(finished(undecided, F.col("__kept")))
