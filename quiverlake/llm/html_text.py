"""Main text of web pages: markup and zones, then boilerplate by a host suffix array.

A forgiving scan cuts a page into blocks (block-level elements part them; white space inside is one space) and gives
each a zone: main (inside the article, or else main element), soft (there too, but in an element whose class or id may mean
something else, as "search" or "tags"), other, or out (menus, page headers, footers, sidebars, notices, adverts, forms,
comments and the like, by element, role, class or id). Scripts, styles and comments are no text. Zone other counts only on
pages without a main zone. Zones soft and other are in doubt, and the array decides on them.

The words of a page's doubtful blocks are its token stream. A suffix starts at each word that has ``LEADING`` words from there in
its block, and at each block's first, and shows these words, or the block. Splitters sampled on (host, leading words) deal the suffixes out, a bucket sorts its own by
multikey quicksort and compares each with its neighbours from other pages: words in common from the start of both are
a repeated substring if they are ``LONG`` or a whole block. Covered words go, unique runs stay. Suffixes that agree in three words
never part at a boundary, so only repeats of fewer words than that, which don't count, are not seen across one.
Pages with the same blocks count as one, so a page that is stored twice loses nothing.

Zone main's words go through an array too, a host's articles together. An article's own words may well stand elsewhere, when pages
carry the same article, quote it or advertise it, so there a repeat is boilerplate only if it is part of the host's template: the run
(or whole block, if no heading) stands in more than half of the host's different articles, ``MANY`` at least, and such runs are
less than half of the page's article. Pages are dealt out by host, a large host in pieces. What more than half of
a host's articles hold, more than half of some piece's hold too, so the pieces' arrays find every candidate; these are then counted on the
whole host.

A suffix that a task holds from two pages in full is settled there; two go on as witnesses, so a very common block is a few
rows for each task. A null page has no blocks: its text is empty, as is that of a page without main text. Repeated rows give
the same text each. A null url is a host of its own. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, stored, table
from .substrings import multikey_order
from .textvec import SPACED, Words, flat, hash_word, hashes, mixed

#: TITLE is main too, a heading.
MAIN, OTHER, OUT, SOFT, TITLE = 0, 1, 2, 3, 4
#: Words of a suffix, and words in a row that make a repeat inside a block.
LEADING, LONG = 8, 8
#: Suffixes held by a task before it settles those that two pages share.
HELD = 1 << 18
#: Different articles that a host must have before a run in most of them is its template.
MANY = 20
#: Bytes of html of one host that go through one array, if that is ``PIECE_PAGES`` pages or more.
PIECE_BYTES, PIECE_PAGES = 1 << 21, 4

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|</[^a-zA-Z<>][^<>]*>|</>", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = frozenset("script style noscript template title textarea iframe svg math object select button head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input link meta nobr picture source area".split())
_OUT_TAGS = frozenset("nav footer aside form header menu dialog".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification sidebar aside menu nav navbar navigation navi topbar breadcrumb breadcrumbs crumbs footer comment comments commentlist disqus reply replies respond share sharing recommended recommendations newsletter subscribe subscription signup popup modal pagination pager".split())
#: Words that may name prose as well: in a main zone they leave the block in doubt.
_SOFT_WORDS = frozenset("alert banner side rail foot header masthead discussion social related widget overlay toolbar login search skip hidden tags".split())
#: Words beside these in a name that don't make it another one.
_BESIDE = frozenset("a area article bar blog block bottom box button col column container content div entry form group holder inner item items left link links list main module outer page panel post region right row section site text the top unit wrap wrapper".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(s)} if s and "=" in s else {}


def _out(tag: str, attributes: dict[str, str], raw: str) -> int:
    """1: no text of the article, 2: perhaps none (by a word of its class or id), 0: nothing speaks against it."""
    if tag in _OUT_TAGS or attributes.get("role", "").lower() in _OUT_ROLES or attributes.get("aria-hidden") == "true":
        return 1
    if "hidden" in raw and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", raw) or "none" in raw and re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return 1
    found = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if tag != "body" else ():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w} - _BESIDE
        if words and words <= _OUT_WORDS:
            return 1
        if words and words <= _OUT_WORDS | _SOFT_WORDS:
            found = 2
    return found


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, without empty ones."""
    found: list[tuple[int, int, str, bool]] = []  # rank of the container, out (1) or soft (2), text, whether a heading
    stack: list[tuple[str, int, int]] = []  # tag, container rank, out
    parts: list[str] = []
    rank = out = at = 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((rank, out, text, any(t in _HEADINGS for t, _, _ in stack)))

    def pop_to(i: int) -> None:
        nonlocal rank, out
        del stack[i:]
        rank, out = (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        if lt > at:
            parts.append(page[at:lt])
        m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a tag that never ends
                break
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in _RAW and not closing:
            if tag == "head" or m[3].endswith("/"):
                continue
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style", "textarea", "title") else at)
            if tag in ("select", "button", "iframe", "object"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag not in _INLINE
        if block:
            end_block()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if not block:
                        # an inline end tag does not close blocks around it
                        if any(t not in _INLINE for t, _, _ in stack[i + 1 :]):
                            break
                        if stack[i][2] != (stack[i - 1][2] if i else 0):
                            end_block()
                    pop_to(i)
                    break
            continue
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _CLOSES_P or tag == "li":
            # an open paragraph (or item) ends here, with what is inline in it
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == "p" or tag == "li" and t == "li":
                    pop_to(i)
                    break
                if t not in _INLINE:
                    break
        attributes = _attributes(m[3])
        new_out = out
        if out != 1 and (mark := _out(tag, attributes, m[3])):
            new_out = 1 if mark == 1 or not rank else 2
        if new_out != out and not block:
            end_block()
        new_rank = rank
        if new_out != 1:
            if tag == "article" or attributes.get("itemprop") == "articleBody":
                new_rank = max(rank, 2)
            elif tag == "main" or attributes.get("role") == "main":
                new_rank = max(rank, 1)
        if tag in ("h1", "h2") and rank == 2 and out == 1 and stack and any(t == "header" for t, _, _ in stack) and all(t != "header" or r == 2 for t, r, _ in stack):
            new_out = 0  # the headline in an article's own header
        stack.append((tag, new_rank, new_out))
        rank, out = new_rank, new_out
    end_block()
    best = max((r for r, o, _, _ in found if not o), default=0)
    return [(OUT if o == 1 else (SOFT if o else TITLE if h else MAIN) if r == best and best else OTHER, t) for r, o, t, h in found]


def _host(url: str | None) -> int:
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0]
    return int(np.uint64(hash_word(host or "-")).astype(np.int64))


def large_hosts(pages: DataFrame) -> dict[int, int]:
    """Pieces of each host that has more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_host(x) for x in b.column(0).to_pylist()], pa.int64()), b.column(1)], ["host", "size"])

    sizes = pages.select(F.col("url").cast("string").alias("url"), F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long").alias("size")).mapInArrow(run, "host bigint, size bigint")
    pieces = F.least(F.ceil(F.sum("size") / PIECE_BYTES), F.floor(F.count("*") / PIECE_PAGES)).cast("long")
    return {r["host"]: r["pieces"] for r in sizes.groupBy("host").agg(pieces.alias("pieces")).where("pieces > 1").collect()}


def _signature(tokens: np.ndarray) -> int:
    return int(mixed(np.array([np.bitwise_xor.reduce(mixed(tokens + np.arange(1, len(tokens) + 1, dtype=np.uint64))) if len(tokens) else 0], np.uint64)).view(np.int64)[0])


def page_blocks(pages: DataFrame, pieces: dict[int, int]) -> DataFrame:
    """id, page_id, url, host (hash), page (hash of its blocks), article (that of its main zone), piece of the host, kind (of zone: main, or
    other without one), and the blocks that may be kept, packed: bytes of them and the same compressed. Pages of a large host that no array needs,
    as they have no main zone or a task has read the same article before, have negative pieces, so that copies don't gather."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen, n = pa.Codec("zstd"), set(), 0
        for b in chunks(batches, "html"):
            out = []
            for url, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = blocks(page or "")
                data, offsets = flat(pa.array([t for _, t in found], pa.string()))
                tokens = hashes(data, offsets[:-1], offsets[1:])
                main = np.array([z in (MAIN, TITLE) for z, _ in found], bool)
                kind = MAIN if main.any() else OTHER
                article, host = _signature(tokens[main]), _host(url)
                piece = article % pieces.get(host, 1)
                if host in pieces:
                    if kind == OTHER or (host, article) in seen:
                        n += 1
                        piece = -1 - n % pieces[host]
                    seen.add((host, article))
                packed = "\n".join(f"{z}{t}" for z, t in found if z != OUT and (z != OTHER or kind == OTHER)).encode()
                out.append((host, _signature(tokens), article, piece, kind, len(packed), codec.compress(packed, asbytes=True)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["id", "page_id", "url", "host", "page", "article", "piece", "kind", "bytes", "packed"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.monotonically_increasing_id().alias("id"), "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"id bigint, page_id {kind}, url string, host bigint, page bigint, article bigint, piece int, kind int, bytes bigint, packed binary")


def article_suffixes(articles: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Article, place (its words counted through), number of words, and leading words (as columns) of each suffix of main blocks that may be a repeat."""
    doc_of = np.repeat(np.arange(len(articles)), [len(x) for x in articles])
    title = np.array([z == TITLE for x in articles for z, _ in x], bool)
    w = Words(*flat(pa.array([t for x in articles for _, t in x], pa.string())), SPACED)
    h = np.append((w.hash | np.uint64(2)).view(np.int64), 0)
    last = w.first[1:][w.doc]
    left = last - np.arange(len(last))
    # What is shorter and no whole block can't be a repeat; a short heading may well be each article's own.
    of = np.flatnonzero((left >= LONG) | (left == w.count[w.doc]) & ~title[w.doc])
    last = last[of]
    columns = [np.where(of + j < last, h[np.minimum(of + j, len(h) - 1)], (of + j == last).astype(np.int64)) for j in range(LONG)]
    row = doc_of[w.doc]
    return row[of], of - np.searchsorted(row, row[of]), np.minimum(left[of], LONG), columns


def suffix_keys(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mixed(c.view(np.uint64) + mixed(key))
    return key.view(np.int64)


def in_most(row: np.ndarray, columns: list[np.ndarray], n: int) -> np.ndarray:
    """Of the suffixes of n articles, in sorted order, those that more than half of the articles share."""
    order, same = multikey_order([*columns, row])
    if not len(order):
        return order
    changed = np.ones(len(order), bool)
    changed[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    group = np.cumsum(changed) - 1
    return order[np.bincount(group, weights=~same)[group] * 2 > n]


def template_runs(row: np.ndarray, at: np.ndarray, words: np.ndarray, totals: np.ndarray) -> dict[int, list[dict[str, int]]]:
    """Runs of covered words of each article, if they are less than half of its ``totals``."""
    found: dict[int, list[dict[str, int]]] = {}
    for i in np.lexsort((at, row)):
        runs, start, end = found.setdefault(int(row[i]), []), int(at[i]), int(at[i] + words[i])
        if runs and start <= runs[-1]["to"]:
            runs[-1]["to"] = max(runs[-1]["to"], end)
        else:
            runs.append({"from": start, "to": end})
    return {i: x for i, x in found.items() if 2 * sum(y["to"] - y["from"] for y in x) < totals[i]}


def _main(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [x for x in found if x[0] in (MAIN, TITLE)]


def _words(articles: list[list[tuple[int, str]]]) -> np.ndarray:
    return np.array([sum(t.count(" ") + 1 for _, t in x) for x in articles], np.int64)


_RUNS = "array<struct<from: int, to: int>>"


def judged_articles(found: DataFrame, pieces: dict[int, int]) -> DataFrame:
    """Unpacked pages with the words of the main zone that are the host's template (``runs``), unless the host is ``large``; ``first`` of an
    article's pages, and, with some page of each piece of a large host, keys of the suffixes that most of the piece's articles share (``often``)."""
    runs = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    block = pa.list_(pa.struct([("zone", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        codec = pa.Codec("zstd")
        t = pa.Table.from_batches(batches).combine_chunks()
        host, piece = t.column("host").to_numpy(), t.column("piece").to_numpy()
        order = np.lexsort((piece, host))
        starts = np.flatnonzero(np.append(True, (host[order][1:] != host[order][:-1]) | (piece[order][1:] != piece[order][:-1])))
        for i, z in zip(starts, np.append(starts[1:], len(order)), strict=True):
            b = t.take(pa.array(order[i:z]))
            large = int(host[order[i]]) in pieces
            pages_ = [[(int(x[0]), x[1:]) for x in codec.decompress(p, n, asbytes=True).decode().split("\n")] if n else [] for p, n in zip(b.column("packed").to_pylist(), b.column("bytes").to_pylist(), strict=True)]
            number: dict[int, int] = {}
            own, first, articles = [], [], []
            for a, kind, found in zip(b.column("article").to_pylist(), b.column("kind").to_pylist(), pages_, strict=True):
                first.append(kind == MAIN and a not in number and piece[order[i]] >= 0)
                if first[-1]:
                    number[a] = len(articles)
                    articles.append(_main(found))
                own.append(number.get(a, -1) if kind == MAIN else -1)
            often: list[int] = []
            cut: dict[int, list[dict[str, int]]] = {}
            if articles and (large or len(articles) >= MANY):
                row, at, words, columns = article_suffixes(articles)
                hit = in_most(row, columns, len(articles))
                if large:
                    often = np.unique(suffix_keys([c[hit] for c in columns])).tolist()
                else:
                    cut = template_runs(row[hit], at[hit], words[hit], _words(articles))
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).combine_chunks() for c in ("id", "page_id", "url", "host", "page", "kind")), pa.array([[{"zone": z, "text": x} for z, x in p] for p in pages_], block), pa.array([large] * n), pa.array(first), pa.array([cut.get(x) for x in own], runs), pa.array([often, *[None] * (n - 1)], pa.list_(pa.int64()))],
                ["id", "page_id", "url", "host", "page", "kind", "blocks", "large", "first", "runs", "often"],
            )

    kind = found.schema["page_id"].dataType.simpleString()
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "host", "piece").mapInArrow(run, f"id bigint, page_id {kind}, url string, host bigint, page bigint, kind int, blocks array<struct<zone: int, text: string>>, large boolean, first boolean, runs {_RUNS}, often array<bigint>")


def large_templates(found: DataFrame) -> dict[int, np.ndarray]:
    """Keys of the suffixes that more than half of the articles of each large host share: candidates of its pieces, counted in all of them."""
    large = found.where("large")
    often: dict[int, set[int]] = {}
    for r in large.where("size(often) > 0").select("host", "often").collect():
        often.setdefault(r["host"], set()).update(r["often"])
    if not often:
        return {}
    keys = {h: np.array(sorted(x), np.int64) for h, x in often.items()}
    large = large.where("first").where(F.col("host").isin(list(keys)))
    totals = large.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= MANY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "bytes"):
            hosts = b.column(0).to_numpy()
            for h in np.unique(hosts):
                articles = [_main([(x["zone"], x["text"]) for x in p]) for p in b.column(1).filter(pa.array(hosts == h)).to_pylist()]
                row, _, _, columns = article_suffixes(articles)
                key = suffix_keys(columns)
                hit = np.flatnonzero(np.isin(key, keys[int(h)]))
                one = np.unique(np.stack([key[hit], row[hit]]), axis=1)[0]
                found_, n = np.unique(one, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), h)), pa.array(found_), pa.array(n)], ["host", "key", "n"])

    rows = large.select("host", "blocks", F.array_join(F.col("blocks.text"), " ").alias("bytes"))
    counts = rows.mapInArrow(count, "host bigint, key bigint, n bigint").groupBy("host", "key").agg(F.sum("n").alias("n"))
    out: dict[int, list[int]] = {}
    for r in counts.join(totals, "host").where("2 * n > total").collect():
        out.setdefault(r["host"], []).append(r["key"])
    return {h: np.array(sorted(x), np.int64) for h, x in out.items()}


def doubtful() -> Column:
    """Whether a block ``x`` of a page of this ``kind`` is in doubt, as a condition in SQL."""
    return F.expr(f"exists(blocks, x -> x.zone = {SOFT} OR kind = {OTHER} AND x.zone = {OTHER})")


def leading_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts, one after the other: its text, its place there, and its suffix (LEADING hashes; 1 after the text's last word, then 0)."""
    w = Words(*flat(pa.array(texts, pa.string())), SPACED)
    h = (w.hash | np.uint64(2)).view(np.int64)
    at = np.arange(len(h))
    last = w.first[1:][w.doc]
    there = at[:, None] + np.arange(LEADING)
    tokens = np.where(there < last[:, None], np.append(h, 0)[np.minimum(there, len(h))], (there == last[:, None]).astype(np.int64))
    return w.doc, at - w.first[:-1][w.doc], tokens


def common(order: np.ndarray, key: np.ndarray, tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each suffix in sorted order, how many leading tokens it shares with the nearest ones of other pages before and after it."""
    n = len(order)
    t, k, p = tokens[order], key[order], page[order]
    adjacent = np.zeros(n + 1, np.int64)  # between i - 1 and i
    adjacent[1:n] = np.where(k[1:] == k[:-1], np.cumprod((t[1:] == t[:-1]) & (t[1:] != 0), axis=1).sum(axis=1), 0)
    out = np.zeros(n, np.int64)
    for step in (1, -1):
        a, q = (adjacent[:n], p) if step == 1 else (adjacent[1:][::-1], p[::-1])
        new = np.ones(n, bool)
        new[1:] = q[1:] != q[:-1]
        # Within a run of one page, the least of what lies between it and the run's first.
        start = np.flatnonzero(new)
        least = a.copy()
        for i, z in zip(start, np.append(start[1:], n), strict=True):
            if z - i > 1:
                least[i:z] = np.minimum.accumulate(a[i:z])
        out = np.maximum(out, least if step == 1 else least[::-1])
    return out


def repeated_runs(pages: DataFrame) -> DataFrame:
    """(id, from, to): words of the doubtful blocks of pages(id, host, page, texts), counted through, that are repeated."""
    names = ["id", "at", "head", "host", "lead", "rest", "page"]
    schema = "id bigint, at int, head boolean, host bigint, lead bigint, rest array<bigint>, page bigint"

    def out(ids, at, head, host, tokens, page) -> pa.RecordBatch:
        rest = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * LEADING + 1, LEADING, dtype=np.int32)), pa.array(tokens.ravel()))
        lead = (mixed(tokens[:, 0].view(np.uint64) ^ mixed(tokens[:, 1].view(np.uint64) + mixed(tokens[:, 2].view(np.uint64))))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at.astype(np.int32)), pa.array(head), pa.array(host), pa.array(lead), rest, pa.array(page)], names)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settled() -> Iterator[pa.RecordBatch]:
            """Suffixes that two pages here share in full are known (at < 0), with two of them left as witnesses."""
            ids, at, head, host, tokens, page = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, same = multikey_order([host, *tokens.T, page])
            changed = np.ones(len(order), bool)
            changed[1:] = (host[order][1:] != host[order][:-1]) | (tokens[order][1:] != tokens[order][:-1]).any(axis=1)
            group = np.cumsum(changed) - 1
            pages_ = np.bincount(group, weights=~same)
            known = np.zeros(len(order), bool)
            known[order] = pages_[group] > 1
            # Of each group the first and the last row, which are of different pages.
            edge = np.zeros(len(order), bool)
            edge[order] = changed | np.append(changed[1:], True)
            ids = np.where(known, -1 - ids, ids)
            keep = ~known | edge
            yield out(ids[keep], at[keep], head[keep], host[keep], tokens[keep], page[keep])
            rest = known & ~edge
            words = np.zeros((int(rest.sum()), LEADING), np.int64)
            words[:, 1] = (tokens[rest] > 1).sum(axis=1) + (tokens[rest] < 0).sum(axis=1)
            yield out(ids[rest], at[rest], head[rest], np.zeros(len(words), np.int64), words, page[rest])

        n = 0
        for b in chunks(batches, "bytes"):
            texts = b.column(3).to_pylist()
            sizes = np.array([len(x) for x in texts])
            doc, place, tokens = leading_words([t for x in texts for t in x])
            row = np.repeat(np.arange(len(texts)), sizes)[doc]
            at = np.arange(len(row)) - np.searchsorted(row, row)
            # What is shorter and no whole block can't be a repeat.
            of = np.flatnonzero((place == 0) | ((tokens != 0) & (tokens != 1)).all(axis=1))
            row = row[of]
            held.append((b.column(0).to_numpy()[row], at[of], place[of] == 0, b.column(1).to_numpy()[row], tokens[of], b.column(2).to_numpy()[row]))
            n += len(of)
            if n >= HELD:
                yield from settled()
                n = 0
        if held:
            yield from settled()

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        ids, at, head, host, page = (t.column(c).to_numpy() for c in ("id", "at", "head", "host", "page"))
        tokens = t.column("rest").combine_chunks().flatten().to_numpy().reshape(-1, LEADING)
        order, _ = multikey_order([host, *tokens.T, page])
        shared = np.zeros(len(ids), np.int64)
        shared[order] = common(order, host, tokens, page)
        whole = head & (tokens == 1).any(axis=1) & (shared == (tokens != 0).sum(axis=1))
        words = np.minimum(shared, ((tokens != 0) & (tokens != 1)).sum(axis=1))
        known = ids < 0
        settled = known & (tokens[:, 0] == 0)
        words[settled] = tokens[settled, 1]
        hit = np.flatnonzero(settled | whole | (words >= LONG))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(known, -1 - ids, ids)[hit]), pa.array(at[hit]), pa.array((at[hit] + words[hit]).astype(np.int32))], ["id", "from", "to"])

    rows = pages.select("id", "host", "page", "texts", F.array_join("texts", " ").alias("bytes")).mapInArrow(suffixes, schema)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "host", "lead").mapInArrow(bucket, "id bigint, from int, to int")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and ``removed`` (number of repeated words removed)."""
    pieces = large_hosts(pages)
    # Only the text that may be kept is moved and stored.
    found = stored(judged_articles(page_blocks(pages, pieces), pieces))
    templates = large_templates(found) if pieces else {}
    in_doubt = found.where(doubtful())
    texts = F.transform(F.filter("blocks", lambda x: (x["zone"] == SOFT) | (F.col("kind") == OTHER)), lambda x: x["text"])
    ranges = repeated_runs(in_doubt.select("id", "host", "page", texts.alias("texts"))).groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for host, found, runs, ranges in zip(*(b.column(c).to_pylist() for c in ("host", "blocks", "runs", "ranges")), strict=True):
                main = _main([(x["zone"], x["text"]) for x in found])
                if main and host in templates:
                    row, at, words, columns = article_suffixes([main])
                    hit = np.isin(suffix_keys(columns), templates[host])
                    runs = template_runs(row[hit], at[hit], words[hit], _words([main])).get(0)
                # Words of main blocks and of doubtful ones are counted apart.
                gone = [{i for x in y or () for i in range(x["from"], x["to"])} for y in (runs, ranges)]
                at, left = [0, 0], []
                for x in found:
                    words, k = x["text"].split(" "), int(x["zone"] not in (MAIN, TITLE))
                    left.append(" ".join(w for i, w in enumerate(words, at[k]) if i not in gone[k]))
                    at[k] += len(words)
                texts.append("\n".join(x for x in left if x))
                removed.append(len(gone[0]) + len(gone[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "removed"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, removed bigint"
    columns = ["page_id", "url", "host", "blocks", "runs", "ranges"]
    template = F.col("runs").isNotNull() | F.col("host").isin(list(templates))
    judged = in_doubt.join(ranges, "id", "left").select(columns).mapInArrow(cut, schema)
    sure = found.where(~doubtful())
    shared = sure.where(template).withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)).select(columns).mapInArrow(cut, schema)
    plain = sure.where(~template).select("page_id", "url", F.array_join(F.transform("blocks", lambda x: x["text"]), "\n").alias("text"), F.lit(0).cast("long").alias("removed"))
    return plain.unionByName(shared).unionByName(judged)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
