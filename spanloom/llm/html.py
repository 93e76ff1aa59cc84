"""HTML extraction by host suffix arrays.

1. Pages are cut into text blocks, menus, headers, footers and the like left out by their elements, roles
   and classes. Where a page has an article or main element, only what stands in one counts.
2. A host's pages are dealt into cohorts of about ``COHORT_BYTES``. A cohort's pages are laid end to end as
   tokens, blocks parted by a token of their own, and their suffix array is built by prefix doubling. The
   suffixes that share their first ``LEAST`` tokens are a run; a run counts once for each distinct page.
3. What makes a run boilerplate is the share of the host's distinct pages it stands on. A run can only
   reach a share of the host if it reaches that share in some cohort, so each cohort proposes the runs
   that do, every cohort counts all that its host proposes, and the sums are exact for the whole
   host, whatever its size (Savasere, Omiecinski and Navathe's partition algorithm).
4. Tokens that boilerplate runs cover go and the unique runs stay. On a page with an article or main
   element, where markup has already told the rest apart, a block goes only if it is covered whole, and
   by runs that nearly all pages of the host have: articles quote each other.

Pages with the same blocks count once, so that copies of a page don't make its article boilerplate.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import durable, table
from spanloom.llm.suffix_dedup import BASES, Prefixes, mix

COHORT_BYTES = 2 << 20
#: Runs (8 bytes each) and hosts that are broadcast at most.
BROADCAST_RUNS, BROADCAST_HOSTS = 2_000_000, 200_000
#: Pages that a task knows to have sent.
MOST_SEEN = 1_000_000
#: Tokens of a run. The share of a host's distinct pages that makes a run boilerplate, and the least number
#: of them: on pages without an article or main element, and on pages that have one.
LEAST = 6
SHARES, PAGES = (0.02, 0.9), (2, 20)

#: Elements by what they are to the reader.
SILENT = frozenset("script style noscript template svg iframe object canvas audio video title select textarea button".split())
#: Elements that swallow the rest of a page if they are never closed.
RAW = frozenset("script style title textarea".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset(("article", "main"))
BLOCKS = frozenset(
    "p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure"
    " figcaption address hr body html nav header footer aside form fieldset details summary menu dialog".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole class names and ids of what isn't the article.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising ad-slot ad-unit ad-banner ad-container adsbygoogle sponsor sponsored sponsored-content promo banner"
    " cookie cookies cookie-banner cookie-notice cookie-consent cookie-bar consent consent-banner gdpr notice site-notice newsletter newsletter-signup subscribe subscription"
    " sidebar side-bar widget widget-area nav navbar nav-bar navigation site-navigation main-navigation main-nav menu main-menu breadcrumb breadcrumbs pagination toolbar"
    " header site-header page-header masthead footer site-footer page-footer comments comment-list comment-section comments-area disqus disqus_thread replies respond"
    " related related-posts related-articles recommended recommendations share-buttons share-bar sharing social social-links social-share popup modal overlay login signup search-form".split()
)
#: Class names and ids of what readers write.
READERS = frozenset("comment commentlist comment-body comment-content comment-thread comments-section comments-list reader-comments user-comments responses".split())
#: Within an article only elements that hold blocks are judged by name: a paragraph or a word of it is the article's.
HOLDERS = frozenset("div section article main ul ol li dl table form fieldset details figure blockquote".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
#: An end tag closes these if they stand open inside.
P_ENDS = BLOCKS - frozenset(("html", "body"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\s]+")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't the article: by what it is, by its role, by its class names and its id. ``inside`` an
    article a header is the article's own."""
    if tag in CHROME:
        return not (tag == "header" and inside)
    if tag in ("html", "body") or (inside and tag not in HOLDERS):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        kind = m[1].lower()
        if kind != "role" and not READERS.isdisjoint(names):
            return True
        if tag not in ARTICLE and not (CHROME_ROLES if kind == "role" else CHROME_NAMES).isdisjoint(names):
            return True
    return False


def blocks_of(page: str) -> list[tuple[bool, str]]:
    """(in an article or main element, text) of a page's visible blocks in order, chrome left out."""
    out: list[tuple[bool, str]] = []
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in chrome, in an article
    opened: dict[str, int] = {}
    at = 0

    def say(text: str) -> None:  # references are decoded before the next markup: it ends them
        words.append(entities.unescape(text) if "&" in text else text)

    def flush(article: bool) -> None:
        text = _SPACE.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            out.append((article, text))

    def place() -> tuple[bool, bool]:
        return stack[-1][1:] if stack else (False, False)

    def close(tag: str) -> None:
        while (last := stack.pop()[0]) != tag:
            opened[last] -= 1
        opened[tag] -= 1

    while at < len(page):
        start = page.find("<", at)
        found = _TOKEN.match(page, start) if start >= 0 else None
        chrome, article = place()
        if start >= 0 and found is None:  # a bare "<" is text
            if not chrome:
                say(page[at : start + 1])
            at = start + 1
            continue
        if not chrome:
            say(page[at : start if start >= 0 else len(page)])
        if start < 0:
            break
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCKS:
                flush(article)
            if opened.get(tag):
                close(tag)
            continue
        if tag in SILENT:
            end = _END[tag].search(page, at)
            if end or tag in RAW:
                at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            flush(article)
            if tag in P_ENDS and opened.get("p") and stack[-1][0] in ("p", "b", "i", "em", "strong", "a", "span", "u", "small", "font"):
                close("p")
                chrome, article = place()
        elif tag == "br":
            words.append("\n")
        if tag not in VOID and not found[3].endswith("/"):
            stack.append((tag, chrome or _is_chrome(tag, found[3], article), article or tag in ARTICLE))
            opened[tag] = opened.get(tag, 0) + 1
    flush(place()[1])
    return out


def parsed(page: str) -> tuple[bool, list[str]]:
    """Whether the page has an article or main element with text, and the texts of its blocks: those that
    stand in such an element if there are any, else all."""
    found = blocks_of(page)
    inside = [t for article, t in found if article]
    return bool(inside), inside or [t for _, t in found]


class Stream:
    """Pages laid end to end as hashed tokens; ``pages`` are pairs as ``parsed`` returns them."""

    def __init__(self, pages: list[tuple[bool, list[str]]]):
        # a block has no line feed and single spaces: "\n" becomes the token between blocks
        texts = [" \n ".join(blocks).encode(errors="surrogatepass") for _, blocks in pages]
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = np.flatnonzero(raw == 32)
        start = np.concatenate(([0], space[:-1] + 1)) if space.size else space
        size = space - start
        tokens = mix(Prefixes(raw, BASES[0]).of(start, size) + size.astype(np.uint64)) if space.size else np.zeros(0, np.uint64)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.page = np.searchsorted(ends, start, side="right")
        self.tokens = tokens
        self.between = (size == 1) & (raw[start] == 10) if space.size else np.zeros(0, bool)
        self.article = np.array([a for a, _ in pages], bool)
        n = max(0, tokens.size - LEAST + 1)
        run = np.zeros(n, np.uint64)
        for k in range(LEAST):
            run = run * np.uint64(BASES[1]) + tokens[k : k + n]
        whole = self.page[:n] == self.page[LEAST - 1 : LEAST - 1 + n]
        self.starts = np.flatnonzero(whole)
        # runs on pages of both kinds are told apart
        self.runs = mix(run[whole] + self.article[self.page[self.starts]].astype(np.uint64))

    def suffix_array(self) -> np.ndarray:
        """Starts in the order of their suffixes, told apart by their first LEAST tokens or more."""
        rank = np.unique(self.tokens, return_inverse=True)[1].astype(np.int64)
        order, reach = np.argsort(rank, kind="stable"), 1
        while reach < LEAST:
            second = np.full(rank.size, -1, np.int64)
            second[: rank.size - reach] = rank[reach:]
            key = rank * (rank.size + 1) + second + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], (np.diff(key[order]) != 0).cumsum()))
            rank = np.empty_like(rank)
            rank[order] = new
            reach *= 2
        return order

    def spread(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, of pages with an article, number of pages) of the runs, by the suffix array: neighbours in it
        with the same first LEAST tokens on pages of one kind are a run."""
        if not self.starts.size:
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        which = np.full(self.tokens.size, -1, np.int64)
        which[self.starts] = np.arange(self.starts.size)
        order = self.suffix_array()
        order = order[which[order] >= 0]
        same = np.ones(max(0, order.size - 1), bool)
        for k in range(LEAST):
            same &= self.tokens[order[1:] + k] == self.tokens[order[:-1] + k]
        block = np.concatenate(([0], (~same).cumsum()))
        page = self.page[order]
        kind = self.article[page]
        seen = np.unique(((block * 2 + kind) * (page.max() + 1) + page).astype(np.int64), return_index=True)[1]
        runs = self.runs[which[order[seen]]]
        found, first, n = np.unique(runs, return_index=True, return_counts=True)
        return found, kind[seen][first], n

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """On how many pages each of the wanted runs (in order) stands."""
        at = np.minimum(np.searchsorted(wanted, self.runs), max(0, wanted.size - 1))
        ok = wanted[at] == self.runs if wanted.size else np.zeros(self.runs.size, bool)
        page = self.page[self.starts[ok]]
        pairs = np.unique(at[ok] * (int(page.max(initial=0)) + 1) + page)
        return np.bincount(pairs // (int(page.max(initial=0)) + 1), minlength=wanted.size)

    def left(self, boilerplate: np.ndarray, pages: list[tuple[bool, list[str]]]) -> list[str]:
        """The pages' texts without what boilerplate runs (in order) cover."""
        change = np.zeros(self.tokens.size + 1, np.int64)
        if boilerplate.size:
            at = np.minimum(np.searchsorted(boilerplate, self.runs), boilerplate.size - 1)
            hit = self.starts[boilerplate[at] == self.runs]
            np.add.at(change, hit, 1)
            np.add.at(change, hit + LEAST, -1)
        gone = np.cumsum(change)[:-1] > 0
        touched = set(self.page[gone].tolist())
        bounds = np.searchsorted(self.page, np.arange(len(pages) + 1))
        out = []
        for i, (article, blocks) in enumerate(pages):
            if i not in touched:
                out.append("\n".join(blocks))
                continue
            own, between = gone[bounds[i] : bounds[i + 1]], self.between[bounds[i] : bounds[i + 1]]
            kept = []
            for block, cut in zip(blocks, np.split(own, np.flatnonzero(between)), strict=True):
                cut = cut[-(block.count(" ") + 1) :]  # without the token before the block
                if article or not cut.any():
                    rest = "" if cut.all() else block
                else:
                    rest = " ".join(t for t, out_ in zip(block.split(" "), cut.tolist(), strict=True) if not out_)
                if rest:
                    kept.append(rest)
            out.append("\n".join(kept))
        return out


def _packed(pages: list[tuple[bool, list[str]]]) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(json.dumps(pages, ensure_ascii=True).encode())


def _unpacked(blob: bytes) -> list[tuple[bool, list[str]]]:
    return [(a, t) for a, t in json.loads(zstandard.ZstdDecompressor().decompress(blob))]


COHORT_FIELDS = "host string, pages binary, n bigint, page_ids array<bigint>, urls array<string>, of array<int>, contents array<binary>, articles binary, elsewhere binary"


def _cohort(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the distinct pages, the rows that have them, and the runs that the cohort proposes; of copies
    (a negative part) just the rows, with what tells their pages."""
    pdf = pdf.sort_values(["page_id", "url"], kind="stable")
    rows = [[None if pd.isna(x) else int(x) for x in pdf["page_id"]], [None if pd.isna(u) else u for u in pdf["url"]]]
    if key[1] < 0:
        row = [key[0], None, 0, *rows, [], pdf["content"].tolist(), b"", b""]
    else:
        codes, contents = pd.factorize(pdf["content"])
        distinct = [_unpacked(b)[0] for b in pdf.drop_duplicates("content")["page"]]
        run, article, n = Stream(distinct).spread()
        alone = int(pdf["parts"].iloc[0]) == 1  # then these are the host's figures already
        need = [max(PAGES[k] if alone else 1, SHARES[k] * len(distinct) - 1e-9) for k in (0, 1)]
        proposed = [run[(article == bool(k)) & (n >= need[k])].tobytes() for k in (0, 1)]
        row = [key[0], _packed(distinct), len(distinct), *rows, codes.astype(np.int32).tolist(), list(contents), proposed[1], proposed[0]]
    return pd.DataFrame([row], columns=["host", "pages", "n", "page_ids", "urls", "of", "contents", "articles", "elsewhere"])


def cohorts(pages: DataFrame, cohort_bytes: int = COHORT_BYTES) -> DataFrame:
    """Rows of COHORT_FIELDS: cohorts of distinct pages, and rows of copies without pages. Pages travel
    compressed; a page's cohort is told by a hash of its blocks, so it is the same wherever the page
    stands. A task sends a page once and its further copies as bare rows, dealt evenly over groups of their
    own, so no group grows with the copies of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            contents, blobs = [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                made = [parsed(page or "")]
                contents.append(hashlib.sha256(json.dumps(made).encode()).digest()[:16])
                key = contents[-1] + host.encode()
                blobs.append(None if key in seen else _packed(made))
                if len(seen) >= MOST_SEEN:  # a page may be sent once more than needed then
                    seen.clear()
                seen.add(key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(contents, pa.binary()), pa.array(blobs, pa.binary())], names=["host", "page_id", "url", "content", "page"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    sizes = durable(sizes.select("host", F.ceil(F.greatest("bytes", F.lit(1)) / cohort_bytes).cast("int").alias("parts")))
    if sizes.count() <= BROADCAST_HOSTS:
        sizes = F.broadcast(sizes)
    cut = rows.mapInArrow(run, "host string, page_id bigint, url string, content binary, page binary")
    copy = -1 - F.pmod(F.xxhash64("page_id", "url", F.spark_partition_id()), F.col("parts"))
    part = F.when(F.col("page").isNull(), copy).otherwise(F.pmod(F.xxhash64("content"), F.col("parts")))
    dealt = cut.join(sizes, "host").withColumn("part", part).repartition("host", "part")  # else a host's cohorts would stay in one task
    return durable(dealt.groupBy("host", "part").applyInPandas(_cohort, COHORT_FIELDS))


def proposals(dealt: DataFrame) -> DataFrame:
    """(host, run, article): the runs that any cohort proposes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, *sides in zip(*(batch.column(c).to_pylist() for c in ("host", "elsewhere", "articles")), strict=True):
                for article, runs in enumerate(sides):
                    found = np.frombuffer(runs, np.int64)
                    for at in range(0, found.size, 50_000):
                        some = found[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([host] * some.size, pa.string()), pa.array(some), pa.array([bool(article)] * some.size)], names=["host", "run", "article"])

    return dealt.select("host", "elsewhere", "articles").mapInArrow(run, "host string, run bigint, article boolean").distinct()


def by_host(runs: DataFrame) -> DataFrame:
    """(host, runs) of a written (host, run, ...): broadcast while runs are few, so that the cohorts, which hold
    all text, needn't move; beyond that Spark joins them as it sees fit."""
    few = runs.count() <= BROADCAST_RUNS
    each = runs.groupBy("host").agg(F.collect_list("run").alias("runs"))
    return F.broadcast(each) if few else each


def boilerplate(dealt: DataFrame) -> DataFrame:
    """(host, run): each host's boilerplate runs, counted over all of its cohorts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                wanted = np.sort(np.asarray(batch.column("runs")[i].values).view(np.uint64))
                n = Stream(_unpacked(batch.column("pages")[i].as_py())).count(wanted)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("host")[i], n.size), pa.array(wanted.view(np.int64)), pa.array(n)], names=["host", "run", "pages"])

    wanted = durable(proposals(dealt))
    asked = dealt.select("host", "pages").join(by_host(wanted), "host")
    counts = asked.select("host", "pages", "runs").mapInArrow(run, "host string, run bigint, pages bigint").groupBy("host", "run").agg(F.sum("pages").alias("pages"))
    whole = dealt.groupBy("host").agg(F.sum("n").alias("n"))
    article, least = F.col("article"), F.when(F.col("article"), F.lit(PAGES[1])).otherwise(F.lit(PAGES[0]))
    need = F.greatest(least, F.col("n") * F.when(article, F.lit(SHARES[1])).otherwise(F.lit(SHARES[0])) - 1e-9)
    found = counts.join(wanted, ["host", "run"]).join(whole, "host").where(F.col("pages") >= need)
    return durable(found.select("host", "run"))


def _cleaned(batch: pa.RecordBatch, i: int) -> list[str]:
    """The texts of a cohort's distinct pages; the batch begins with (pages, runs)."""
    distinct, runs = _unpacked(batch.column(0)[i].as_py()), batch.column(1)[i]
    runs = np.sort(np.asarray(runs.values).view(np.uint64)) if runs.is_valid else np.zeros(0, np.uint64)
    return Stream(distinct).left(runs, distinct) if runs.size else ["\n".join(blocks) for _, blocks in distinct]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text) of (pages, runs, of, page_ids, urls)."""
    for batch in batches:
        for i in range(batch.num_rows):
            texts, of = _cleaned(batch, i), batch.column(2)[i].as_py()
            for at in range(0, len(of), 500):
                rows = [batch.column(c)[i].values.slice(at, 500) for c in (3, 4)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([texts[k] for k in of[at : at + 500]], pa.string())], names=["page_id", "url", "text"])


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, run, text) of (pages, runs, contents, host, wanted): the texts of the wanted contents."""
    for batch in batches:
        for i in range(batch.num_rows):
            contents, wanted = batch.column(2)[i].as_py(), set(batch.column(4)[i].as_py())
            if wanted.isdisjoint(contents):
                continue
            texts = _cleaned(batch, i)
            rows = [(c, t) for c, t in zip(contents, texts, strict=True) if c in wanted]
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(3)[i], len(rows)), pa.array([c for c, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.string())], names=["host", "run", "text"])


def extract(pages: DataFrame, cohort_bytes: int = COHORT_BYTES) -> DataFrame:
    """(page_id, url, text) of every page.

    Null html is an empty page and gives an empty text; null or odd urls make one host, ''. Repeated rows
    each get their row; pages with equal blocks get equal texts. Other columns are ignored; an empty table
    gives no rows. A host of any size is dealt into cohorts, so no task gets more than one at a time, or
    one page if that is larger; the result doesn't depend on how they are dealt.
    """

    dealt = cohorts(pages, cohort_bytes)
    held = dealt.where("pages is not null")
    told = held.join(by_host(boilerplate(held)), "host", "left")
    own = told.select("pages", "runs", "of", "page_ids", "urls").mapInArrow(_texts, "page_id bigint, url string, text string")
    copies = dealt.where("pages is null").select("host", F.explode(F.arrays_zip("page_ids", "urls", "contents")).alias("row"))
    copies = copies.select("host", F.col("row.page_ids").alias("page_id"), F.col("row.urls").alias("url"), F.col("row.contents").alias("run"))
    if copies.isEmpty():
        return own
    wanted = by_host(durable(copies.select("host", "run").distinct())).withColumnRenamed("runs", "wanted")
    texts = told.join(wanted, "host").select("pages", "runs", "contents", "host", "wanted").mapInArrow(_copied, "host string, run binary, text string")
    return own.unionByName(copies.join(texts.dropDuplicates(["host", "run"]), ["host", "run"]).select("page_id", "url", "text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
