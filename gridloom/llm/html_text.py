"""Main text of web pages: markup zones, and suffix arrays over the token streams of all pages of a host.

A page is cut into blocks, each in one of three zones.  *Chrome* (menus, page headers, footers,
sidebars, notices, adverts, forms, reader comments, by element, role or whole class names) is dropped,
*body* (inside ``article``, ``main`` or a container named so) is kept, the rest is *loose*.  Body
markup inside a form or a wrapper with a chrome name is body all the same, a ``main`` anywhere; an
``article`` among menus, asides, adverts, comments or teasers is not.  A page of nothing but chrome
keeps what stands in its forms and chrome wrappers as loose.

Every page sends two streams to its host's suffix arrays, its body tokens and its loose tokens.  They
find the runs of ``RUN`` or more tokens that occur on distinct pages, and decide what goes:

* Loose text that a page without a body shares with another page's loose text is boilerplate: the
  tokens that such a run covers are removed, the unique ones stay.  A page with body text loses its
  loose text anyway, but counts as a page that repeats it.
* A body is protected, since copies of an article and passages that articles share must stay whole.
  Its blocks go only if runs cover them whole that stand in ``ARTICLES`` or more and in more than the
  share ``MOST`` of the host's articles (notices and adverts inside the article without a mark), and
  only if more of the body stays than goes.  Pages whose bodies have the same smallest window hash are
  copies and count as one article, the page with the smallest row hash.

Hosts are dealt into shards of bounded size, copies into the same one, after each task has sent only
one of the copies it read.  A shard's suffix array reduces its windows to one row each.  Loose windows
carry the smallest and largest page; merging these rows over the shards finds every window on two
pages, also if each shard holds it once.  Body windows leave a shard with the number of articles that
hold them if more than half the share do.  Shards that do not report a window hold it in that many
at most, which decides nearly all of them; what stays open is counted in all shards.  So sharding
changes nothing.

Edge cases: null or empty html gives an empty text.  Null urls share the empty host.  Rows with equal
url and html are one page that is returned as often.  Unclosed elements end with their container, cut-off tags are dropped,
unknown references stay as they stand.  Extra columns are carried along.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, bounded, mix, powers, release, to_workers, word_hashes
from gridloom.llm.url_rules import host

#: Tokens that a repeated run must have.
RUN = 12
#: Articles that must hold a run before body text is taken for a notice of the host.
ARTICLES = 10
#: Share of the host's articles that must be exceeded.
MOST = 0.75
#: Tokens of a host that one task sorts, about.
SHARD_TOKENS = 2_000_000
#: Bytes of html to a token, about.
TOKEN_BYTES = 8

RAW = "script style noscript template svg math iframe object canvas title textarea select button audio video"
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul body".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Chrome that no article inside turns into body.
SEALED_NAMES = set("aside dialog footer menu nav".split())
SEALED_ROLES = set("alert alertdialog complementary contentinfo dialog menu menubar navigation".split())
SEALED_WORDS = set("ad ads advert advertisement adverts advertising comment comments disqus promo promoted recommended related replies reply sponsor sponsored comment-list comments-area comment-respond related-posts related-articles ad-slot ad-banner ad-container".split())
#: Chrome unless body markup stands inside; words are whole class names or ids.
CHROME_ROLES = set("banner form search".split())
CHROME_WORDS = set(
    "banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup search share sharing sidebar signup skip social subscribe toolbar widget widgets"
    " site-header site-footer page-footer main-nav main-navigation site-nav site-navigation nav-bar nav-menu cookie-banner cookie-notice cookie-consent comment-form left-sidebar right-sidebar sidebar-left sidebar-right share-buttons social-share social-links newsletter-signup search-form skip-link".split()
)
BODY_NAMES = set("article article-body articlebody article-content content entry entry-content main main-content maincontent post post-content post-body story story-body".split())

# The inside of a tag by the standard: names, each with a value after "=" if any.  A quote opens a value only
# straight after "="; anywhere else it is a plain character, and ">" ends the tag.
ATTRIBUTES = r"(?:[\s/]+|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)?)*+"
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")\b" + ATTRIBUTES + r"(?:>.*?(?:</(?P=raw)\s*[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>" + ATTRIBUTES + r")(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LOOSE, BODY, DROPPED, FORM, SEALED = 0, 1, 2, 3, 4


def _zone(name: str, rest: str, outer: int, lenient: bool = False) -> int:
    """Zone inside an element, from its name, class, id and role; all from DROPPED on are left out."""
    marks = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip() else {}
    ids, role = set(marks.get("id", "").split()), marks.get("role")
    names = ids | set(marks.get("class", "").split())
    if name == "main":
        return BODY
    if outer == SEALED or name in SEALED_NAMES or role in SEALED_ROLES:
        return SEALED
    if name not in ("html", "body") and names & SEALED_WORDS:
        return SEALED
    if name == "article" or role in ("main", "article"):
        return BODY
    chrome = outer if lenient or outer >= DROPPED else DROPPED
    if name == "form":
        return FORM if chrome == DROPPED and outer == LOOSE else chrome
    if name == "header":
        return outer if outer == BODY else chrome
    if name in ("html", "body") or not marks:
        return outer
    if role in CHROME_ROLES or names & (CHROME_WORDS - {"header"} if outer == BODY else CHROME_WORDS):
        return chrome if outer != FORM or lenient else DROPPED
    return BODY if (ids if outer == DROPPED else names) & BODY_NAMES else outer


def blocks(page: str, lenient: bool = False) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, chrome left out; if ``lenient``, only sealed chrome."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", LOOSE)]
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((stack[-1][1] if stack[-1][1] < DROPPED else kept, text))

    kept, marked, at = LOOSE, set(), 0
    for m in MARKUP.finditer(page):
        if stack[-1][1] < DROPPED and m.start() > at:
            held.append(page[at : m.start()])
            kept = stack[-1][1]
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
        if m["end"]:
            if any(n == name for n, _ in stack[1:]):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and not m["rest"].endswith("/"):
            if block and stack[-1][0] == "p":
                stack.pop()
            outer = stack[-1][1]
            zone = _zone(name, m["rest"], outer, lenient)
            if name in CONTAINERS or zone != outer or name in marked:
                if zone != outer:
                    marked.add(name)
                stack.append((name, zone))
    if stack[-1][1] < DROPPED and at < len(page):
        held.append(page[at:])
        kept = stack[-1][1]
    flush()
    return out


def _zones(batch: pa.RecordBatch) -> tuple[list[str], list[list[str]]]:
    """Body text and loose blocks of every page; html is the third column."""
    body, loose = [], []
    for page in pc.fill_null(batch.column(2), "").to_pylist():
        got = blocks(page)
        body.append("\n\n".join(t for z, t in got if z == BODY))
        loose.append([t for z, t in got if z != BODY] if got else [t for _, t in blocks(page, lenient=True)])
    return body, loose


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, loose = _zones(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.string()), pa.array(loose, pa.list_(pa.string())), *batch.columns[3:]], names=["rid", "host", "body", "loose", *batch.schema.names[3:]])


def _streams(run: int):
    """Body and loose tokens of every page that has some, as 32-bit hashes.

    ``kin`` of a body is the smallest hash of its windows (of all its tokens, if there is none), of loose text the page.
    A task leaves out a page if it has sent one of the same kin and zone with a smaller row hash.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[bool, str, int], int] = {}
        for batch in batches:
            zones, out = _zones(batch), []
            pages = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for body in (True, False):
                tokens, first = stream(zones[0] if body else [" ".join(x) for x in zones[1]])
                w = windows(tokens, run)
                for (rid, host), at, end in zip(pages, first[:-1], first[1:], strict=True):
                    if at == end:
                        continue
                    own = w[at : end - run + 1] if end - at >= run else windows(tokens[at:end], end - at)
                    kin = int(own.min().astype(np.int64)) if body else rid
                    if sent.get((body, host, kin), rid + 1) > rid:
                        sent[body, host, kin] = rid
                        out.append((rid, host, body, kin, tokens[at:end].astype("<u4").tobytes()))
            kinds = {"rid": pa.int64(), "host": pa.string(), "body": pa.bool_(), "kin": pa.int64(), "tokens": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return find


def stream(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit token hashes of the blocks in order, and where each block's begin."""
    raw = [p.encode() for p in parts]
    tokens, first = word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    return tokens >> np.uint64(32), first


def windows(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hash of the ``run`` tokens from each position on."""
    n = max(0, len(tokens) - run + 1)
    w = powers(run + 1)
    return mix(sum((tokens[k : k + n] * w[k + 1] for k in range(run)), np.zeros(n, np.uint64)))


def suffix_runs(tokens: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, first-of-its-run flags) by the first ``run`` tokens, by prefix doubling; suffixes shorter than that are left out."""
    _, rank = np.unique(tokens, return_inverse=True)
    length = 1
    while length < run:
        step = min(length, run - length)
        n = len(rank) - step
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        _, rank = np.unique(rank[:n].astype(np.uint64) << np.uint64(32) | rank[step : step + n].astype(np.uint64), return_inverse=True)
        length += step
    order = np.argsort(rank, kind="stable")
    return order, np.concatenate(([True], np.diff(rank[order]) > 0))[: len(order)]


def window_pages(streams: list[np.ndarray], ids: np.ndarray, run: int = RUN) -> pd.DataFrame:
    """Every window of ``run`` tokens inside the pages' streams: its hash, smallest and largest page id, number of streams."""
    tokens = np.concatenate([x for k, t in enumerate(streams) for x in (t, mix(np.array([k + 1], dtype=np.uint64)))])  # a separator that no other page has
    lens = np.array([len(t) for t in streams])
    which = np.repeat(np.arange(len(streams)), lens + 1)
    ends = np.cumsum(lens + 1) - 1  # each page's separator
    order, first = suffix_runs(tokens, run)
    run_no = np.cumsum(first) - 1
    whole = order + run <= ends[which[order]]  # no separator inside
    order, run_no = order[whole], run_no[whole]
    if not len(order):
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"fp": none, "low": none, "high": none, "pages": none})
    new = np.concatenate(([True], np.diff(run_no) > 0))
    at, page = np.flatnonzero(new), which[order]
    new[1:] |= np.diff(page) > 0
    fp = windows(tokens, run)[order[at]].view(np.int64)
    return pd.DataFrame({"fp": fp, "low": np.minimum.reduceat(ids[page], at), "high": np.maximum.reduceat(ids[page], at), "pages": np.add.reduceat(new.astype(np.int64), at)})


def _unpack(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype="<u4").astype(np.uint64) for t in rows["tokens"]]


def _shard(run: int):
    """Windows of a shard's loose text with their smallest and largest page; of its articles those on more than half of ``MOST``.

    With several shards, a row without a window holds the number of the shard's articles.
    """

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        host, body, shards = rows[["host", "body", "shards"]].iloc[0]
        got = window_pages(_unpack(rows), rows["kin"].to_numpy(np.int64), run)
        if body:
            got = got[got["pages"] > MOST / 2 * len(rows)]
        if shards == 1:  # nothing to merge
            got = got[got["pages"] >= (ARTICLES if body else 2)]
        got["fp"] = got["fp"].astype("Int64")
        if body and shards > 1:
            got = pd.concat([got, pd.DataFrame({"fp": pd.array([None], "Int64"), "low": 0, "high": 0, "pages": 0})])
        release()
        return got.assign(host=host, body=bool(body), articles=len(rows))[["host", "body", "fp", "low", "high", "pages", "articles"]]

    return find


def _count(run: int):
    """Articles of a shard that hold each candidate, and all its articles."""

    def find(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(asked["fp"].to_numpy(np.int64))
        pages = np.zeros(len(fps), np.int64)
        for tokens in _unpack(rows):
            pages += np.isin(fps, windows(tokens, run).view(np.int64))
        return pd.DataFrame({"host": asked["host"].iloc[0] if len(asked) else None, "fp": fps, "pages": pages, "articles": len(rows)})

    return find


def _positions(run: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, h, loose in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                w = windows(stream(loose)[0], run).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), rid)), pa.array([h] * len(w), pa.string()), pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w)], names=["rid", "host", "pos", "fp"])

    return find


def _uncovered(run: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for loose, hit in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = [p.split() for p in loose]
                covered = np.zeros(sum(map(len, tokens)) + 1, dtype=np.int64)
                for p in hit or ():
                    covered[p : p + run] = 1
                at, parts = 0, []
                for t in tokens:
                    parts.append(" ".join(w for w, c in zip(t, covered[at : at + len(t)], strict=True) if not c))
                    at += len(t)
                out.append("\n\n".join(p for p in parts if p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rid", "left"])

    return keep


def without_notices(body: str, fps: np.ndarray, run: int = RUN) -> str:
    """``body`` less the blocks that windows of ``fps`` cover whole, if more stays than goes."""
    parts = body.split("\n\n")
    tokens, first = stream(parts)
    covered = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows(tokens, run).view(np.int64), fps))
    np.add.at(covered, at, 1)
    np.add.at(covered, at + run, -1)
    bare = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] == 0)))
    goes = bare[first[1:]] == bare[first[:-1]]
    return "\n\n".join(p for p, g in zip(parts, goes, strict=True) if not g) if 2 * np.diff(first)[goes].sum() < len(tokens) else body


def _judge(run: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            out = [without_notices(body, np.array(fps, np.int64), run) if fps and body else body for body, fps in pairs]
            text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([text, *batch.columns[2:]], names=["text", *batch.schema.names[2:]])

    return keep


def host_runs(pages: DataFrame, ws: Workspace, run: int = RUN, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """What a host repeats, as hashes of windows: (host, fp) of loose text on two pages and (host, fps) of bodies in most articles.

    ``pages`` has rid, host and html.
    """
    size = F.sum(F.octet_length("html")) / F.lit(TOKEN_BYTES * shard_tokens)
    large = ws.keep(pages.groupBy("host").agg(F.ceil(size).cast("long").alias("shards")).where("shards > 1"))
    large = bounded(large, large.count(), 64)
    shards = F.coalesce("shards", F.lit(1).cast("long"))

    def dealt(pages: DataFrame) -> DataFrame:
        sent = to_workers(pages.select("rid", "host", "html"), _streams(run), "rid long, host string, body boolean, kin long, tokens binary")
        sent = sent.join(large, "host", "left").withColumn("shards", shards).withColumn("shard", F.pmod("kin", "shards"))
        return sent.repartition("host", "shard").groupBy("host", "shard", "shards", "body", "kin").agg(F.min_by("tokens", "rid").alias("tokens"))

    found = ws.keep(dealt(pages).groupBy("host", "shard", "body").applyInPandas(_shard(run), "host string, body boolean, fp long, low long, high long, pages long, articles long"))
    loose = found.where("not body").groupBy("host", "fp").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "fp")
    whole = found.where("body and fp is null").groupBy("host").agg(F.sum("articles").alias("whole"))
    often = found.where("body and fp is not null").groupBy("host", "fp").agg(F.sum("pages").alias("pages"), F.sum("articles").alias("articles"))
    often = often.join(whole, "host", "left").withColumn("whole", F.coalesce("whole", "articles"))

    def most(n, articles):
        return (n >= ARTICLES) & (n > MOST * articles)

    at_most = F.col("pages") + MOST / 2 * (F.col("whole") - F.col("articles"))
    often = ws.keep(often.where(most(at_most, F.col("whole"))).withColumn("sure", most(F.col("pages"), F.col("whole"))))
    sure, unsure = often.where("sure").select("host", "fp"), often.where("not sure").select("host", "fp")
    hosts = unsure.select("host").distinct()
    n = hosts.count()
    if n:
        asked = unsure.join(large, "host", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))).select("host", "shard", "fp")
        articles = dealt(pages.join(bounded(hosts, n, 64), "host", "left_semi")).where("body")
        counts = articles.groupBy("host", "shard").cogroup(asked.groupBy("host", "shard")).applyInPandas(_count(run), "host string, fp long, pages long, articles long")
        counts = counts.groupBy("host", "fp").agg(F.sum("pages").alias("pages"), F.sum("articles").alias("articles"))
        sure = sure.unionByName(counts.where(most(F.col("pages"), F.col("articles"))).select("host", "fp"))
    return loose, ws.keep(sure.groupBy("host").agg(F.sort_array(F.collect_list("fp")).alias("fps")))


def extract(pages: DataFrame, run: int = RUN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``pages`` without their html, with ``text`` and ``n_chars``."""
    ws = Workspace(pages.sparkSession, "html")
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(others)]
    given = pages.select(F.xxhash64("url", "html").alias("rid"), host(F.col("url")).alias("host"), "html", *named)
    repeated, notices = host_runs(given, ws, run, shard_tokens)
    kinds = "".join(f", `c{i}` {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)]
    carried = [f"c{i}" for i in range(len(others))]
    rows = to_workers(given, _parse, "rid long, host string, body string, loose array<string>" + kinds)
    plain, undecided = rows, None
    if not repeated.isEmpty():
        undecided = ws.keep(rows.where("body = '' and size(loose) > 0").drop("body"))
        plain = rows.where("body <> '' or size(loose) = 0")
    text = F.when(F.col("body") == "", F.array_join("loose", "\n\n")).otherwise(F.col("body")).alias("text")
    n, longs = notices.agg(F.count("*"), F.sum(F.size("fps"))).first()
    if n:
        plain = plain.join(bounded(notices, n + longs, 64), "host", "left")
        plain = to_workers(plain.select(text, F.when(F.col("body") != "", F.col("fps")).alias("fps"), *carried), _judge(run), "text string" + kinds)
    else:
        plain = plain.select(text, *carried)
    plain = plain.select(*kept, "text").withColumn("n_chars", F.length("text").cast("long"))
    if undecided is None:
        return plain
    loose = undecided.select("rid", "host", "loose").dropDuplicates(["rid"])
    spots = loose.mapInArrow(_positions(run), "rid long, host string, pos int, fp long")
    hits = spots.join(repeated, ["host", "fp"]).groupBy("rid").agg(F.collect_list("pos").alias("hits"))
    left = loose.select("rid", "loose").join(hits, "rid", "left").mapInArrow(_uncovered(run), "rid long, left string")
    out = undecided.join(left, "rid", "left").select(*kept, F.coalesce("left", F.lit("")).alias("text"))
    return plain.unionByName(out.withColumn("n_chars", F.length("text").cast("long")))
