"""Main text of HTML pages: structure of the markup, and a suffix array over each host's pages.

A page is cut into blocks.  Markup that names its role decides at once: menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles go; what stands in an article (or
main) element stays.  Blocks that the markup leaves open are decided by the host's suffix array:
a page's are one token stream, so that a run may cover several short blocks; the streams of the
host's pages are concatenated, substrings of RUN tokens or more that repeat across
distinct pages are boilerplate, and the runs that they do not cover are kept, beside an article
too.  Only runs count as boilerplate that pages with different content (article, or else longest
block) share, as a copied page is no boilerplate.

A host's pages are dealt to shards of about SHARD pages, each with a suffix array of its own;
what is unique in its shard is compared across shards by the hashes of its token windows, with one
entry for each window that repeats in a shard.

Edge cases: null or empty html gives an empty text; a null url is a host of its own; rows that
repeat are pages of their own; unclosed tags, stray ``<`` and text outside of body are read as
browsers do; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import hashing, suffixes
from spindrift.sources.stage import Stages

#: Tokens of a repeated run, at least, and pages of a shard, about.
RUN, SHARD = 8, 256

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WHITE = re.compile(r"\s+")

# Elements by what they mean for the main text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes", "object", "canvas"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "head"}
MAIN = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# A new one of these ends an open one of the same kind (or of those listed).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words that a class, id or role may hold beside an article's own; inside an article only whole names count.
ROLES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|menubar|breadcrumb\w*|sidebar|side|widget\w*|footer|header|masthead|cookie\w*|consent|notice\w*|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|search|share\w*|social\w*|related|recommend\w*|comment\w*|reply|replies|disqus|respond|pagination|pager|toolbar|skip|copyright|legal|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)


NAMES = re.compile(ROLES.pattern.replace(r"(?:^|[\s_-])", "^", 1).replace(r"(?:$|[\s_-])", r"(?:[\s_-]?(?:\d+|s|area|bar|block|body|box|button|buttons|container|content|form|group|inner|item|items|link|links|list|panel|section|thread|wrap|wrapper|unit))*$", 1), re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment\w*|reply|replies|disqus|respond)(?:$|[\s_-])", re.I)
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "th", "dd", "dt", "figcaption"}


def _is_chrome(name: str, attrs: str, in_main: bool) -> int:
    """0: no; 1: by a name that an article inside outweighs; 2: whatever is inside."""
    if name in CHROME:
        # The header of an article holds its title.
        return 0 if name == "header" and in_main else 2
    if not attrs or name in ("html", "body") or name in MAIN:
        return 0
    values = [a or b or c for _, a, b, c in ATTR.findall(attrs)]
    if any(COMMENTS.search(v) for v in values):
        return 2
    if not in_main:
        return int(any(ROLES.search(v) for v in values))
    # An article's own text keeps its place whatever a class word may say of it.
    return 0 if name in PROSE else int(any(NAMES.search(v) for value in values for v in value.split()))


def page_blocks(html: str) -> list[tuple[str, bool]]:
    """(text, in_main) of each block that the markup does not rule out, in page order."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # name, 0 nothing / 1 main / 2 chrome by name / 3 chrome / 4 main inside chrome by name, block
    parts: list[str] = []
    chrome = main = soft = 0
    outer: list[int] = []
    at = 0

    def flush() -> None:
        if parts:
            text = WHITE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, main > 0))

    def pop() -> None:
        nonlocal chrome, main, soft
        _, kind, _ = stack.pop()
        main -= kind in (1, 4)
        chrome -= kind in (2, 3)
        soft -= kind == 2
        if kind == 4:
            chrome = soft = outer.pop()

    lower = None
    for m in iter(lambda: TAG.search(html, at), None):
        if not chrome and m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name == "p" and not any(s[0] == "p" for s in stack):
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # Structure is not closed by inline ends that stand outside of it.
            if depth is not None and not (name not in BLOCKS and any(s[2] for s in stack[depth + 1 :])):
                if name in BLOCKS:
                    flush()
                while len(stack) > depth:
                    pop()
            continue
        if name in RAW:
            if lower is None:
                lower = html.lower()
            end = lower.find(f"</{name}", at)
            if end < 0:
                if name in ("noscript", "template", "svg", "object", "canvas", "iframe"):
                    continue
                at = len(html)
                break
            close = html.find(">", end)
            at = len(html) if close < 0 else close + 1
            continue
        if name == "br":
            if not chrome:
                parts.append(" ")
            continue
        if name in BLOCKS:
            if not chrome:
                flush()
            else:
                parts.clear()
            if stack and stack[-1][0] == "p":
                pop()
            if name in ENDS:
                while stack and stack[-1][0] in ENDS[name]:
                    pop()
            if name == "body":
                while stack and stack[-1][0] == "head":
                    pop()
        if name in VOID or m[3].endswith("/") and name in VOID:
            continue
        kind = (1 if not chrome or chrome > soft or main else 4) if name in MAIN else (0, 2, 3)[_is_chrome(name, m[3], main > 0)]
        main += kind in (1, 4)
        chrome += kind in (2, 3)
        soft += kind == 2
        if kind == 4:
            # Nothing but class words stands against it: it is read like any article.
            outer.append(soft)
            chrome = soft = 0
            parts.clear()
        stack.append((name, kind, name in BLOCKS))
    if at < len(html) and not chrome:
        parts.append(html[at:])
    flush()
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
    for batch in batches:
        size = max(1, min(len(batch), int(256 * len(batch) * 16384 / max(1, batch.nbytes * 1))))
        for a in range(0, len(batch), size):
            part = batch.slice(a, size)
            urls = part.column("url").to_pylist()
            found = [page_blocks(h) if h else [] for h in part.column("html").to_pylist()]
            hosts = [(m[1].lower() if (m := host.match(u or "")) else "") for u in urls]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[i for _, i in f] for f in found], pa.list_(pa.bool_()))],
                names=["page_id", "url", "host", "blocks", "main"],
            )


def _open_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's streams of open tokens: which repeat in another page of the shard, and the window hashes of the rest."""
    rows, tokens, content = [], [], []
    vocabulary: dict[str, int] = {}
    for row, texts, sign in zip(pdf["row"], pdf["texts"], pdf["sign"], strict=True):
        # A page's blocks are one stream, as a run may cover several short ones; only pages are apart.
        ids = [vocabulary.setdefault(w, len(vocabulary)) for text in texts for w in text.split(" ")]
        rows.append((row, sign, len(tokens), len(ids)))
        tokens += [*ids, -len(rows)]
        content += [sign] * (len(ids) + 1)
    symbols = np.asarray(tokens, dtype=np.int64)
    symbols = np.where(symbols < 0, len(vocabulary) - symbols, symbols)
    signs = np.asarray(content, dtype=np.int64)
    windows = []
    run = RUN
    rank = suffixes.depth_ranks(symbols, run)
    order = np.argsort(rank, kind="stable")
    ranks, by = rank[order], signs[order]
    cut = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
    least, most = np.minimum.reduceat(by, cut), np.maximum.reduceat(by, cut)
    repeated = np.zeros(len(symbols), dtype=bool)
    repeated[order] = np.repeat(least != most, np.diff(np.r_[cut, len(ranks)]))
    at = np.flatnonzero(repeated)
    edge = np.zeros(len(symbols) + run + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    covered = np.cumsum(edge)[: len(symbols)] > 0
    hashes = np.array([hash_text(w) for w in vocabulary], dtype=np.uint64)
    factor = hashing.powers(np.uint64(0xA0761D6478BD642F | 1), run + 1)
    for row, sign, start, n in rows:
        at, h = [], []
        if n >= run:
            own = hashes[symbols[start : start + n]]
            h = hashing.mix(sum(own[i : n - run + 1 + i] * factor[i + 1] for i in range(run)))
            left = np.flatnonzero(~repeated[start : start + n - run + 1])
            at, h = left.tolist(), h[left].view(np.int64).tolist()
        windows.append((row, sign, np.flatnonzero(covered[start : start + n]).tolist(), at, h))
    # One entry for each window that repeats here, in a line without a row: a single one in another shard meets it.
    own = hashes[symbols[order[cut[least != most]][:, None] + np.arange(run)]]
    again = hashing.mix(sum(own[:, i] * factor[i + 1] for i in range(run)))
    windows.append((None, None, [], [], again.view(np.int64).tolist()))
    out = pd.DataFrame(windows, columns=["row", "sign", "covered", "at", "windows"])
    return out.astype({"row": "Int64", "sign": "Int64"}).assign(host=pdf["host"].iloc[0])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the tokens of the open stream that are gone."""
    for batch in batches:
        texts = []
        for blocks, main, gone in zip(*[batch.column(c).to_pylist() for c in ("blocks", "main", "gone")], strict=True):
            lost, at, kept = set(gone or ()), 0, []
            for block, in_main in zip(blocks, main, strict=True):
                if not in_main:
                    words = block.split(" ")
                    block = " ".join(w for i, w in enumerate(words, at) if i not in lost)
                    at += len(words)
                if block:
                    kept.append(block)
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def hash_text(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    pre = hashing.prefix(data)
    return int(hashing.range_hash(pre, np.array([0]), np.array([len(data)]))[0])


def extract_main_text(pages: DataFrame, stages: Stages | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    stages = stages or Stages(pages.sparkSession, "pages")
    html = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    page_type = dict(html.dtypes)["page_id"]
    parsed = html.mapInArrow(_parse, f"page_id {page_type}, url string, host string, blocks array<string>, main array<boolean>")
    parsed = stages.save(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")

    # What tells a page's content: its article or else its longest block.
    longest = F.aggregate("blocks", F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    body = F.when(F.exists("main", lambda x: x), F.array_join(F.filter("blocks", lambda b, i: F.element_at(F.col("main"), i + 1)), "\n")).otherwise(longest)
    # Every block that the markup leaves open is in question, beside an article too; pages without one need no join.
    has_open = F.exists("main", lambda x: ~x)
    undecided = parsed.where(has_open)
    texts = F.filter("blocks", lambda b, i: ~F.element_at(F.col("main"), i + 1))
    streams = stages.save(undecided.select("row", "host", F.xxhash64(body).alias("sign"), texts.alias("texts")), "open")
    per_host = streams.groupBy("host").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    sharded = streams.join(per_host, "host").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    runs = sharded.select("row", "host", "sign", "texts", "shard").groupBy("host", "shard").applyInPandas(
        _open_runs, "row long, sign long, covered array<int>, at array<int>, windows array<long>, host string"
    )
    runs = stages.save(runs, "runs")
    # Windows that are unique in their shard but repeat in another shard of the host, or between shards.
    again = runs.where("row is null").select("host", F.explode("windows").alias("h"))
    runs = runs.where("row is not null")
    single = runs.select("host", "row", "sign", F.explode(F.arrays_zip("at", "windows")).alias("w"))
    single = single.select("host", "row", "sign", F.col("w.at").alias("at"), F.col("w.windows").alias("h"))
    signs = single.select("host", "h", F.col("sign").alias("lo"), F.col("sign").alias("hi"), F.lit(False).alias("again"))
    signs = signs.unionByName(again.withColumn("again", F.lit(True)), allowMissingColumns=True)
    across = signs.groupBy("host", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("again").alias("again")).where("again or lo <> hi").select("host", "h")
    across = single.join(across, ["host", "h"]).groupBy("row").agg(F.collect_set("at").alias("also"))
    also = F.flatten(F.transform(F.coalesce("also", F.array().cast("array<int>")), lambda a: F.sequence(a, a + RUN - 1)))
    gone = runs.join(across, "row", "left").select("row", F.array_union("covered", also).alias("gone"))

    decided = parsed.where(~has_open).select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    free = undecided.join(gone, "row", "left").select("page_id", "url", "blocks", "main", "gone")
    free = free.mapInArrow(_strip, f"page_id {page_type}, url string, text string")
    return decided.union(free).withColumn("n_chars", F.length("text").cast("long"))
