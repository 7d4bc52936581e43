"""Main text of web pages: containers and, where these leave lines open, differences between pages with near URLs.

Page differencing alone cannot give the article: paragraphs that two pages of a host share would go, and an advert that no neighbour
has would stay. So what a page itself says comes first. Lines inside navigation, header, footer, aside, form, advert, notice, comment
and like elements are dropped; an article or main element vouches for the plain lines inside it. Open are lines of an article whose
element has a class or id with such a word among others (`share-price`, `notice-bar-2`), and all lines of a page without an article.
These are settled by difference: pages are sorted by host and path over the cluster (copies count once, at the least path), a page is
paired with that neighbour in its host whose path shares more segments, all lines of both are aligned by a longest common
subsequence, and open lines that are shared are deleted.

Only keys are sorted; ranks come from one count for each partition, so a host that holds a third of all pages is spread like any other.

Results, by case: a null or empty html gives the empty text; a page whose host has no page with other lines keeps its open lines (so
a page crawled again is never held against itself); a null url is a host of its own with other null urls; a tag that is cut off at the
end is dropped; a table without rows gives none; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import pieces

#: A quote opens a value only after an equals sign; elsewhere it is a sign like any other.
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[a-zA-Z/][^>]*$""", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = frozenset("script style title textarea template noscript iframe svg math canvas object video audio noframes xmp head".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PLATE = frozenset("nav header footer aside form menu dialog button select label fieldset".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations widget widgets login signup toolbar pagination pager skip".split())
_BESIDE = frozenset("list box boxes wrap wrapper container area section bar block inner outer top bottom left right item items unit units slot panel link links button buttons btn form content page site global primary secondary main mobile desktop sticky fixed small large the and of".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _kind(tag: str, attributes: str) -> str:
    """What an element says about the lines in it: "plate" for boilerplate, "doubt" if a class or id has such a word among others."""
    if tag in _HEADING:
        return ""
    if tag in _PLATE:
        return "plate"
    if not attributes.strip():
        return ""
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes) or re.search(r"aria-hidden\s*=\s*[\"']?true", attributes) or re.search(r"display\s*:\s*none", attributes):
        return "plate"
    doubt = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for one in value.split():
                words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one).lower()))
                if words & _WORDS:
                    if words <= _WORDS | _BESIDE:
                        return "plate"
                    doubt = "doubt"
        if name.lower() == "role" and value.lower() in _ROLES:
            return "plate"
    return doubt


def lines(html: str) -> tuple[list[str], str]:
    """The lines outside boilerplate, in order, and the kind of each: a in an article, d in an article but in doubt, o outside."""
    found: list[str] = []
    kinds: list[str] = []
    piece: list[str] = []
    open_: list[tuple[str, str]] = []  # open elements that matter: (tag, "plate", "doubt", "article", "heading" or "")
    depth = {"plate": 0, "doubt": 0, "article": 0, "heading": 0}

    def end_block() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text and (not depth["plate"] or (depth["heading"] and depth["article"] and all(t == "header" for t, k in open_ if k == "plate"))):
            found.append(text)
            kinds.append("o" if not depth["article"] else "d" if depth["doubt"] else "a")

    def close(at: int) -> None:
        for _, kind in open_[at:]:
            if kind:
                depth[kind] -= 1
        del open_[at:]

    at = 0
    while (m := _TOKEN.search(html, at)) is not None:
        if m.start() > at:
            piece.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            piece.append(" ")
            continue
        if m[1]:
            if tag in _BLOCK:
                end_block()
            here = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if here is not None:
                close(here)
            continue
        if tag in _RAW:
            if tag == "head":
                m2 = re.compile(r"</head\s*>|<body\b", re.I).search(html, at)
                if m2:
                    at = m2.start() if m2[0][1] != "/" else m2.end()
                continue
            if not m[3].rstrip().endswith("/"):
                ended = _RAW_END[tag].search(html, at)
                at = ended.end() if ended else len(html)
            continue
        if tag in _BLOCK:
            end_block()
        if tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        is_article = tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", m[3]))
        if is_article and depth["plate"] and not depth["article"]:
            close(next(i for i, (_, k) in enumerate(open_) if k == "plate"))  # an element of boilerplate that was never closed
        if tag == "article" and any(t == "article" for t, k in open_ if k == "article"):
            kind = "plate"  # an article inside an article is a comment on it
        else:
            kind = _kind(tag, m[3])
            if kind != "plate" and is_article:
                kind = "article"
            elif not kind and tag in _HEADING:
                kind = "heading"
        if kind:
            depth[kind] += 1
        if kind or tag in _BLOCK and tag not in ("p", "li"):
            open_.append((tag, kind))
        elif tag in ("p", "li"):
            while open_ and open_[-1][1] == "heading":
                close(len(open_) - 1)
    if at < len(html):
        piece.append(unescape(html[at:]))
    end_block()
    return found, "".join(kinds)


def undecided(kinds: str) -> bool:
    """Whether the difference to another page has a say: lines in doubt, or no article at all."""
    return "d" in kinds or "a" not in kinds and "o" in kinds


def kept(found: list[str], kinds: str, gone: set[int]) -> list[str]:
    """An article vouches for its lines, shared or not; lines in doubt, or outside where there is no article, stay if they are not shared."""
    has = "a" in kinds or "d" in kinds
    return [x for i, (x, k) in enumerate(zip(found, kinds, strict=True)) if k == "a" or (k == "d" or not has) and i not in gone]


def _rows(a: list[int], masks: dict[int, int], width: int) -> Iterator[int]:
    """For each beginning of a, a bit for each line of b: 0 where a longest common subsequence of the beginnings grows."""
    v = full = (1 << width) - 1
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list[int]) -> dict[int, int]:
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    out = {}
    for x, places in at.items():
        bits = bytearray(len(b) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _common(a: list[int], b: list[int], most: int) -> list[int]:
    """Which of a are in a longest common subsequence of a and b; rows of at most `most` bits are kept at once."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > most:  # the middle of a meets b where both halves together are longest
        half, n = len(a) // 2, len(b)
        grown = lambda x, y: np.r_[0, np.cumsum(1 - np.unpackbits(np.frombuffer(deque(_rows(x, _masks(y), n), 1)[0].to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64))]
        k = int(np.argmax(grown(a[:half], b) + grown(a[half:][::-1], b[::-1])[::-1]))
        return _common(a[:half], b[:k], most) + [half + i for i in _common(a[half:], b[k:], most)]
    rows = list(_rows(a, _masks(b), len(b)))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def shared(a: list[str], b: list[str], most: int = 1 << 28) -> set[int]:
    """Which lines of a are in a longest common subsequence of a and b."""
    begin, end = 0, 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    inner, other = a[begin : len(a) - end], b[begin : len(b) - end]
    number: dict[str, int] = {}
    for x in other:
        number.setdefault(x, len(number))
    at = [i for i, x in enumerate(inner) if x in number]
    mine = set(inner)
    found = _common([number[inner[i]] for i in at], [number[x] for x in other if x in mine], most)
    return {*range(begin), *(begin + at[i] for i in found), *range(len(a) - end, len(a))}


_PARSED = "uid long, page_id long, url string, host string, path string, settled boolean, lines array<string>, kinds string"
_TEXT = r"array_join(filter(lines, (x, i) -> substr(kinds, i + 1, 1) = 'a'), '\n')"


def place(url: str | None) -> tuple[str, str]:
    """Host and path."""
    bare = re.sub(r"[?#].*$", "", re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or ""), flags=re.S)
    host, _, path = bare.partition("/")
    return host.lower(), path


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        found = [lines(html or "") for html in batch.column(3).to_pylist()]
        host, path = zip(*map(place, batch.column(2).to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array([not undecided(k) for _, k in found], pa.bool_()), pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([k for _, k in found], pa.string())], ["uid", "page_id", "url", "host", "path", "settled", "lines", "kinds"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            out = ["\n".join(kept(own, kinds, shared(own, other or []))) for own, kinds, other in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def neighbours(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """uid and the nearest other uid of the same host, for each row of keys (uid, host, path, settled) that is not settled."""
    spark = keys.sparkSession
    ordered = keys.repartitionByRange("host", "path", "uid").sortWithinPartitions("host", "path", "uid").withColumn("pos", F.monotonically_increasing_id())
    ordered = scratch.table(ordered, "ordered")
    part = F.shiftright("pos", 33)
    before, bases = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # one number for each partition
        bases.append((r["part"], before))
        before += r["count"]
    base = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    ranked = ordered.withColumn("part", part).join(base, "part").select("uid", "host", "path", "settled", (F.col("base") + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    open_ = ranked.where("not settled").select(F.col("uid").alias("of"), F.col("host").alias("own_host"), F.split("path", "/").alias("own"), F.explode(F.array(F.col("rank") - 1, F.col("rank") + 1)).alias("rank"), F.col("rank").alias("own_rank"))
    pairs = open_.join(ranked, "rank").where("host = own_host")
    same = F.aggregate(F.sequence(F.lit(0), F.least(F.size("own"), F.size(F.split("path", "/")))), F.lit(0), lambda n, i: F.when((n == i) & (F.get("own", i) == F.get(F.split("path", "/"), i)), n + 1).otherwise(n))
    best = F.max(F.struct(same.alias("same"), (-F.col("rank")).alias("first"), F.col("uid").alias("uid")))
    return pairs.groupBy("of").agg(best.alias("best")).select(F.col("of").alias("uid"), F.col("best.uid").alias("other"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text for each row of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "html-text")
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    parsed = scratch.table(rows.mapInArrow(_parse, _PARSED), "parsed")
    done = parsed.where("settled").select("page_id", "url", F.expr(_TEXT).alias("text"))
    if parsed.where("not settled").isEmpty():
        return done
    # copies count once, so no page is held against one with the same lines
    key = F.sha2(F.concat_ws("\n", "lines"), 256).alias("key")
    groups = parsed.select("uid", "host", "path", "settled", key).groupBy("host", "key").agg(F.min(F.struct("path", "uid")).alias("first"), F.min("settled").alias("settled"))
    groups = scratch.table(groups.select("host", "key", F.col("first.uid").alias("uid"), F.col("first.path").alias("path"), "settled"), "groups")
    near = scratch.table(neighbours(groups.select("uid", "host", "path", "settled"), scratch), "near")
    other = groups.join(near, "uid").select("host", "key", "other")
    other = scratch.table(other.join(parsed.select(F.col("uid").alias("other"), F.col("lines").alias("theirs")), "other").select("host", "key", "theirs"), "other")
    open_ = parsed.where("not settled").select("page_id", "url", "host", key, "lines", "kinds").join(other, ["host", "key"], "left")
    return done.union(open_.select("page_id", "url", "lines", "kinds", "theirs").mapInArrow(_difference, "page_id long, url string, text string"))
