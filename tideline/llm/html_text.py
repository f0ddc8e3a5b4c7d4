"""Main text of web pages, by structure and by a suffix array of each host.

A page becomes blocks of text. Blocks inside an article (or ``main``) that is not
a menu, advert, form, comment or the like are its text. The blocks outside and, behind a
place that nothing crosses, those of the article make up the page's token stream, and a
host's streams are judged against each other:

* a bitmap of the leading grams (``RUN`` tokens) that several rows may have settles most of
  the others without a shuffle; it may name too many and never too few;
* a suffix of which no other page of the host has the first ``RUN`` tokens repeats
  nothing; counting these leading grams settles it without a sort;
* the stretches of a stream where that is not so are kept once per host and content,
  however many pages have them, and their suffixes are sorted by Spark in one order of
  host and tokens, over as many tasks as it takes;
* along this order each suffix is compared with its nearest neighbours of other pages:
  the longer common prefix is its repeat. Suffixes carry ``DEPTH`` tokens; a longer
  repeat shows as one at every place, so what they cover together is the same.

Tokens that repeats cover are boilerplate. On pages without an article the runs they do
not cover, of blocks that are no menus and the like, make up the text. An article keeps
its repeats too, which are counted.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, materialize, partitions

RUN = 6  # tokens a repeat between pages of a host must have
DEPTH = 48  # tokens that are sorted of each suffix
PAGES = 256  # pages handled at once
_NONE = np.zeros(0, dtype=np.int64)
HELD = 1 << 21  # grams a task sorts at once
# Grams have 40 bits in the bitmap's buckets: 12 of the bucket, 28 in it, the upper 15 of which are a place of the bitmap.
_BUCKET, _PLACE = 28, 13
_ODD, _ALL = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1)
_LONG = 64  # bytes of a token that are hashed for all tokens at once
_CHARS = 1 << 20  # of html are handled at once
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select menu dialog head object canvas".split())
SCOPE = frozenset("article main section div td th table body html".split())
HINT = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promotion sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription comment comments reply replies disqus share sharing social related "
    "search login contentinfo complementary".split()
)
_CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_ARTICLE, _GONE, _HEADER = 1, 2, 3  # effects of a tag
_KNOWN: dict[str, tuple | None] = {}  # what short pieces of markup do, as pages repeat them
_P, _OUTSIDE = ("p",), ("", False, False)


def _hinted(attributes: str) -> bool:
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        if HINT.intersection(re.split(r"[^a-z0-9]+", (a or b or c).lower())):
            return True
    return False


def _markup(m: re.Match) -> tuple | None:
    """What a piece of markup does: ``(closes, tag, is a block, tags it ends, scope of those,
    end of its raw text, stays closed, effect)``. The effect is that of :func:`blocks`."""
    tag = (m[2] or m[4] or "").lower()
    if not tag:
        return None
    block = tag in BLOCK
    if m[1]:
        return True, tag, block, (tag,), () if tag in SCOPE else SCOPE, None, False, 0
    attributes = m[3] if m[2] else m[5]
    ends, scope = (), ()
    if block and tag in _CLOSES:
        ends, scope = _CLOSES[tag].split(), SCOPE | {"ul", "ol", "dl", "tr"} if tag in ("li", "dt", "dd") else SCOPE
    raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I) if tag in RAW else None
    hint = _hinted(attributes) if attributes else False
    if tag in ("article", "main") and not hint:
        effect = _ARTICLE
    elif tag in DROPPED or hint:
        effect = _GONE
    else:
        effect = _HEADER if tag == "header" else 0
    return False, tag, block, ends, scope, raw, tag in VOID or attributes.endswith("/") and not block, effect


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """``(text, dropped, in article)`` of each block, in page order. White space inside a
    block, line breaks included, is one space; blocks without text are left out."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, in article
    parts: list[str] = []

    def end_block() -> None:
        if text := " ".join("".join(parts).split()):
            out.append((text, *(stack[-1][1:] if stack else (False, False))))
        parts.clear()

    def pop(tags, scope=()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    at, search = 0, TOKEN.search
    while m := search(page, at):
        start, end = m.span()
        if start > at:
            said = page[at:start]
            parts.append(html.unescape(said) if "&" in said else said)
        at, shown = end, m[0]
        if shown in _KNOWN:
            does = _KNOWN[shown]
        else:
            does = _markup(m)
            if end - start <= 64 and len(_KNOWN) < 20_000:
                _KNOWN[shown] = does
        if does is None:
            continue
        closes, tag, block, ends, scope, raw, closed, effect = does
        if block and parts:
            end_block()
        if closes:
            pop(ends, scope)
            continue
        if block:
            pop(_P, SCOPE)
            if ends:
                pop(ends, scope)
        elif tag == "br":
            parts.append(" ")
        if raw:
            close = raw.search(page, at)
            at = close.end() if close else len(page)
            continue
        if closed:
            continue
        _, dropped, article = stack[-1] if stack else _OUTSIDE
        if effect == _ARTICLE:
            dropped, article = dropped and article, True  # an element left open before it does not hide it
        elif effect == _GONE or effect == _HEADER and not article:
            dropped = True
        stack.append((tag, dropped, article))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    end_block()
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def _page(url: str | None, page: str | None) -> tuple[list[str], list[tuple[str, bool]], bytes]:
    """Blocks of the article, blocks outside it, and a key of URL and blocks."""
    found = blocks(page or "")
    own = [t for t, dropped, article in found if article and not dropped]
    outside = [(t, d) for t, d, article in found if d or not article]
    key = xxhash.xxh3_128_digest(repr((url or "", outside, own)).encode("utf-8", "surrogatepass"))
    return own, outside, key


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _numbers(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens of ``text``, each behind a space but the first, begin and end, and a
    64-bit number for each."""
    padded = text + bytes(8)
    spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    lo, hi = np.concatenate([_NONE, [0], spaces + 1]), np.concatenate([_NONE, spaces, [len(text)]])
    words = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = hi - lo
    out = size.astype(np.uint64) * _ODD
    some, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(some):
        left = size[some] - at
        word = words[lo[some] + at] & (_ALL >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)))
        out[some] = _mixed(_mixed(out[some] ^ word))
        some, at = some[left > 8], at + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[lo[i] : hi[i]])
    return lo, hi, out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return x ^ x >> np.uint64(32)


def _grams(size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``RUN`` tokens follow each other without an empty one, and a 64-bit hash of them."""
    n = len(numbers) - RUN + 1
    if n <= 0:
        return _NONE, np.zeros(0, dtype=np.uint64)
    out = numbers[:n].copy()
    for i in range(1, RUN):  # mixed after each token, so that the order counts
        out = _mixed(out) + numbers[i : i + n]
    empty = np.concatenate([[0], np.cumsum(size == 0)])
    at = np.flatnonzero(empty[RUN:] == empty[:n])
    return at, _mixed(_mixed(out[at]))


def _gram(tokens: list[str]) -> int:
    lo, hi, numbers = _numbers(_utf8(" ".join(tokens)))
    return int(_grams(hi - lo, numbers)[1].view(np.int64)[0])


def _salt(host: str | None) -> int:
    return xxhash.xxh3_64_intdigest(_utf8(host or ""))


class _Streams:
    """The token streams of some pages, one behind the other. A token ``\\n`` ends each block; an
    empty one, of which no gram is, parts the article from what is outside, and pages.

    ``salt`` and ``key`` of each page; ``text`` and where in it each token begins and ends; ``page``,
    ``at`` (token of all) and ``gram`` of each gram, hosts having different ones."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        self.urls, self.key, said = [u for u, _ in rows], [], []
        for url, page in rows:
            own, outside, key = _page(url, page)
            self.key.append(key)
            parts = ("".join([t + " \n " for t, _ in outside]), "".join([" " + t + " \n" for t in own]))
            said.append(_utf8("".join(parts)))
        self.salt = [_salt(host_of(u)) for u in self.urls]
        self.text = b"  ".join(said)
        self.lo, self.hi, numbers = _numbers(self.text)
        begin = np.cumsum([0, *(len(x) + 2 for x in said[:-1])])
        self.first = np.searchsorted(self.lo, begin)
        self.at, self.gram = _grams(self.hi - self.lo, numbers)
        self.page = np.searchsorted(self.first, self.at, side="right") - 1
        self.gram ^= np.array(self.salt, dtype=np.uint64)[self.page]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[_Streams]:
    rows, n = [], 0
    for batch in batches:
        for url, page in zip(batch.column(0), batch.column(1)):
            rows.append((url.as_py(), page.as_py()))
            n += len(rows[-1][1] or "")
            if n >= _CHARS or len(rows) == PAGES:
                yield _Streams(rows)
                rows, n = [], 0
    if rows:
        yield _Streams(rows)


def _packed(low: np.ndarray) -> bytes:
    """Ascending numbers as differences: their lower halves, then the upper ones, compressed."""
    gaps = np.diff(low, prepend=np.uint32(0)).astype("<u4")
    upper = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    high = (gaps >> np.uint32(16)).astype("<u2").view(np.uint8)
    return gaps.astype("<u2").tobytes() + upper.compress(high[::2].tobytes() + high[1::2].tobytes()) + upper.flush() + len(gaps).to_bytes(4, "little")


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[-4:], "little")
    high = np.frombuffer(zlib.decompress(blob[2 * n : -4], -15), dtype=np.uint8).astype(np.uint32)
    gaps = np.frombuffer(blob, dtype="<u2", count=n).astype(np.uint32) | high[:n] << np.uint32(16) | high[n:] << np.uint32(24)
    return np.cumsum(gaps, dtype=np.uint32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, grams``: the sorted grams of some pages, each once a page, as packed differences."""
    held, n = [], 0

    def packed() -> pa.RecordBatch:
        every = np.sort(np.concatenate(held))
        buckets, at = np.unique(every >> np.uint64(_BUCKET), return_index=True)
        low = (every & np.uint64((1 << _BUCKET) - 1)).astype(np.uint32)
        blobs = [_packed(x) for x in np.split(low, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "grams"])

    for x in _streams(batches):
        held.append(np.unique(x.gram >> np.uint64(24) << np.uint64(16) | x.page.astype(np.uint64)) >> np.uint64(16))
        n += len(held[-1])
        if n >= HELD:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, bits``: the places of the grams that several rows have."""

    def bits(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        every = np.sort(np.concatenate([_unpacked(x) for x in held]))
        some = np.zeros(1 << _BUCKET - _PLACE, dtype=bool)
        some[every[1:][every[1:] == every[:-1]] >> np.uint32(_PLACE)] = True
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(some).tobytes()], pa.binary())], names=["bucket", "bits"])

    now, held = None, []
    for batch in batches:
        for bucket, grams in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and held:
                yield bits(now, held)
                held = []
            now = bucket
            held.append(grams)
    if held:
        yield bits(now, held)


def gram_bitmap(rows: DataFrame) -> np.ndarray:
    """Which places hold a gram that several rows of ``rows`` (``url, html``) have: 16 MB at any size."""
    sketches = rows.mapInArrow(_sketches, "bucket int, grams binary")
    sketches = sketches.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    bitmap = np.zeros((1 << 40 - _BUCKET, 1 << _BUCKET - _PLACE - 3), dtype=np.uint8)
    for r in sketches.mapInArrow(_several, "bucket int, bits binary").toLocalIterator():
        bitmap[r.bucket] = np.frombuffer(r.bits, dtype=np.uint8)
    return bitmap.ravel()


_STRETCH = "_key binary, at int, piece binary, host long, page long, text string"
_STRETCH_KINDS = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string())


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _row(key: bytes, at: int, salt: int, page: int, text: bytes) -> tuple:
    piece = xxhash.xxh3_128_digest(salt.to_bytes(8, "little") + text)
    return key, at, piece, _signed(salt), _signed(page), text.decode("utf-8", "surrogatepass")


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Where numbers that follow each other begin and end in ``at``."""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)])) if len(at) else []


def _batches(rows: Iterator[tuple], kinds: tuple, names: list[str], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches, smaller ones where the column ``text`` is long."""
    part, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], names=names)

    for row in rows:
        part.append(row)
        n += len(row[text]) if text is not None else 0
        if len(part) == 4096 or n >= 4 * _CHARS:
            yield batch()
            part, n = [], 0
    if part:
        yield batch()


def _names(fields: str) -> list[str]:
    return [x.split()[0] for x in fields.split(", ")]


def _page_stretches(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches of the pages whose grams several rows may have."""

    def rows() -> Iterator[tuple]:
        for x in _streams(batches):
            place = x.gram >> np.uint64(24 + _PLACE)
            often = (bitmap[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1
            at, page = x.at[often > 0], x.page[often > 0]
            pages = [_salt(u) for u in x.urls]
            for i, j in _runs(at):  # an empty token is between pages, so a run is of one
                p = page[i]
                yield _row(x.key[p], int(at[i] - x.first[p]), x.salt[p], pages[p], x.text[x.lo[at[i]] : x.hi[at[j - 1] + RUN - 1]])

    yield from _batches(rows(), _STRETCH_KINDS, _names(_STRETCH), 5)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of streams, ``url, host, _key, tokens, grams``."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for url, host, key, tokens, grams in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.array([i for i, g in enumerate(grams) if g is not None], dtype=np.int64)
                for i, j in _runs(at):
                    yield _row(key, int(at[i]), _salt(host), _salt(url), _utf8(" ".join(tokens[at[i] : at[j - 1] + RUN])))

    yield from _batches(rows(), _STRETCH_KINDS, _names(_STRETCH), 5)


def _piece_grams(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    """``gram, lo, hi`` of the grams of pieces, or ``gram, pid, s`` if their ``places`` are asked for."""
    for batch in batches:
        for k in range(0, batch.num_rows, 4 * PAGES):
            part = batch.slice(k, 4 * PAGES)
            pid, host, first, last = (part.column(c).to_numpy() for c in range(4))
            texts = [_utf8(t) for t in part.column(4).to_pylist()]
            lo, hi, numbers = _numbers(b"  ".join(texts))  # an empty token between pieces
            begin = np.searchsorted(lo, np.cumsum([0, *(len(t) + 2 for t in texts[:-1])]))
            at, gram = _grams(hi - lo, numbers)
            own = np.searchsorted(begin, at, side="right") - 1
            gram = (gram ^ host.view(np.uint64)[own]).view(np.int64)
            cols = [gram, pid[own], (at - begin[own]).astype(np.int32)] if places else [gram, first[own], last[own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "pid", "s"] if places else ["gram", "lo", "hi"])


_SUFFIX = "host long, suffix string, s int, piece binary, lo long, hi long"


def _suffixes(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of a piece that begin at ``starts``, all of them if it is on several pages."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                host, piece, lo, hi, text, starts = (c[k].as_py() for c in batch.columns)
                tokens = text.split(" ")
                for s in starts if lo == hi else range(len(tokens) - RUN + 1):
                    yield host, " ".join(tokens[s : s + depth]), s, piece, lo, hi

    yield from _batches(rows(), kinds, _names(_SUFFIX))


def _common(a: list[str], b: list[str]) -> int:
    for n, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return n
    return min(len(a), len(b))


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``piece, s, n``: how many tokens each suffix of the order has in common with another
    page. A suffix of a piece on several pages repeats whole. The leading gram is known to
    repeat, so what lies in another task can only lengthen a repeat that others cover too."""
    kinds = (pa.binary(), pa.int32(), pa.int32())

    def rows() -> Iterator[tuple]:
        before: tuple | None = None  # last suffix of the run of another page
        run: list[tuple] = []  # suffixes of one page that follow each other, with what they have so far
        for batch in batches:
            for host, suffix, s, piece, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = suffix.split(" ")
                page = lo if lo == hi else (piece, s)  # a piece on several pages differs from any page
                if run and (run[-1][0] != host or run[-1][4] != page):
                    for x in run:
                        yield x[1], x[2], max(x[5], _common(x[3], tokens) if x[0] == host and x[5] < len(x[3]) else 0, RUN)
                    before, run = run[-1], []
                n = len(tokens) if lo != hi else _common(tokens, before[3]) if before and before[0] == host else 0
                run.append((host, piece, s, tokens, page, n))
        for x in run:
            yield x[1], x[2], max(x[5], RUN)

    yield from _batches(rows(), kinds, ["piece", "s", "n"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``piece, found`` with the repeats that meet as one."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())]))
    for batch in batches:
        found = batch.column(1)
        s, n = (found.flatten().field(k).to_numpy().astype(np.int64) for k in ("s", "n"))
        size = np.diff(found.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        order = np.lexsort((s, row))
        far = int((s + n).max(initial=0)) + 1  # rows lie so far from each other that none meet
        s, e = (s + row * far)[order], (s + n + row * far)[order]
        e = np.maximum.accumulate(e)
        begins = np.flatnonzero(np.concatenate([s[:1] >= 0, s[1:] > e[:-1]]))
        ends = np.concatenate([begins[1:], [len(s)]])[: len(begins)] - 1
        s, e, row = s[begins], e[ends], row[begins]
        spans = pa.StructArray.from_arrays([pa.array((s - row * far).astype(np.int32)), pa.array((e - s).astype(np.int32))], names=["s", "n"])
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), spans).cast(kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["piece", "found"])


def _sweep(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _swept(df: DataFrame) -> DataFrame:
    _sweep(df)
    return materialize(df)


def repeated_spans(streams: DataFrame) -> DataFrame:
    """``_key, spans``: token ranges that repeat on another page of the host, for streams that
    have any. ``streams``: ``url, host, _key, tokens, grams``; a page is its URL. Null grams are
    known to be no repeats."""
    streams = streams.select("url", "host", "_key", "tokens", "grams")
    return _stretch_spans(materialize(streams.mapInArrow(_stretches, _STRETCH)), False)


def _stretch_spans(stretches: DataFrame, merged: bool) -> DataFrame:
    """:func:`repeated_spans` of written stretches, which are discarded; those of a stretch
    that meet can be ``merged``."""
    depth = DEPTH
    pieces = stretches.groupBy("piece").agg(F.first("host").alias("host"), F.first("text").alias("text"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    pieces = _swept(pieces.withColumn("pid", F.monotonically_increasing_id()))
    placed = _swept(stretches.select("piece", "_key", "at").distinct())
    discard(stretches)
    texts = pieces.select("pid", "host", "lo", "hi", "text")
    # Counting grams starts in every task, so one that a whole host shares is a few rows by
    # the time it is shuffled. Those of a piece on several pages need no place.
    often = texts.mapInArrow(lambda it: _piece_grams(it, False), "gram long, lo long, hi long")
    often = often.groupBy("gram").agg((F.min("lo") != F.max("hi")).alias("often")).filter("often").select("gram")
    marks = texts.filter("lo = hi").mapInArrow(lambda it: _piece_grams(it, True), "gram long, pid long, s int").join(often, "gram")
    marks = _swept(marks.groupBy("pid").agg(F.collect_list("s").alias("starts")))  # at most one per token of the page
    suffixes = pieces.join(marks, "pid", "left").filter("lo <> hi or starts is not null").select("host", "piece", "lo", "hi", "text", "starts")
    suffixes = _swept(suffixes.mapInArrow(lambda it: _suffixes(it, depth), _SUFFIX))
    discard(pieces)
    discard(marks)
    # Equal suffixes may go to two tasks, as the order ends with piece and place.
    order = ["host", "suffix", "lo", "piece", "s"]
    ordered = suffixes.repartitionByRange(partitions(stretches.sparkSession), *order).sortWithinPartitions(*order)
    found = ordered.mapInArrow(_repeats, "piece binary, s int, n int")
    found = found.groupBy("piece").agg(F.collect_list(F.struct("s", "n")).alias("found"))
    found = _swept(found.mapInArrow(_merged, found.schema) if merged else found)
    discard(suffixes)
    spans = F.transform("found", lambda x: F.struct((F.col("at") + x["s"]).alias("s"), (F.col("at") + x["s"] + x["n"]).alias("e")))
    spans = placed.join(found, "piece").select("_key", spans.alias("spans")).groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = _swept(spans)
    discard(placed)
    discard(found)
    _sweep(spans)
    return spans


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the text is made from: the article, compressed, or else the blocks; and how many
    tokens are outside the article."""
    kinds = (pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.int64())
    for batch in batches:
        for lo in range(0, batch.num_rows, PAGES):
            part, rows = batch.slice(lo, PAGES), []
            for url, page in zip(part.column(1), part.column(2)):
                own, outside, key = _page(url.as_py(), page.as_py())
                whole, n = bool(own), sum(len(t.split()) + 1 for t, _ in outside)
                rows.append((key, zlib.compress("\n".join(own).encode()) if whole else None, None if whole else [t for t, _ in outside], None if whole else [d for _, d in outside], n))
            cols = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["page_id", "url", "_key", "article", "outside", "dropped", "n_outside"])


def _unique(words: list[str], covered: list[bool]) -> list[str]:
    """Words of a block without repeats. A repeat that reaches in from a neighbouring block
    counts only if it takes the whole block or ``RUN`` of its words."""
    if all(covered):
        return []
    out, at = [], 0
    for gone, run in groupby(covered):
        n = len(list(run))
        if not gone or n < RUN:
            out += words[at : at + n]
        at += n
    return out


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, PAGES):
            part, texts, counts, said = batch.slice(lo, PAGES), [], [], []
            spans = part.column(6)
            for k, (article, outside, dropped, n_outside) in enumerate(zip(*(part.column(k).to_pylist() for k in (2, 3, 4, 5)))):
                own = spans[k].values
                s, e = (own.field(x).to_numpy() for x in ("s", "e")) if own is not None else (_NONE, _NONE)
                size = max(n_outside, int(e.max(initial=0)))
                covered = np.cumsum(np.bincount(s, minlength=size + 1) - np.bincount(e, minlength=size + 1)) > 0
                counts.append(int(covered[:n_outside].sum()))
                said.append(int(covered.sum()) - counts[-1])
                if article is not None:
                    texts.append(zlib.decompress(article).decode())
                    continue
                at, kept, covered = 0, [], covered.tolist()
                for text, gone in zip(outside, dropped):
                    words = text.split()
                    if not gone and (own := " ".join(_unique(words, covered[at : at + len(words)]))):
                        kept.append(own)
                    at += len(words) + 1
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(said, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_repeated", "n_article_repeated"],
            )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, n_repeated, n_article_repeated``.

    ``n_repeated`` counts the tokens outside the article, block ends included, that repeat on
    another page of the host, inside an article or not, whether or not the page has an article;
    ``n_article_repeated`` counts those of the article. What an article says stays, repeated or not. A page is its URL to its host: rows with the same one are no
    distinct pages, and of equal repeats none counts as the first: all of them go. Null html gives an empty text;
    pages with a null URL share the empty host and are one page to it. Ids may be null or
    repeat. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    raw = rows.select("url", "html")
    bitmap = rows.sparkSession.sparkContext.broadcast(gram_bitmap(raw))
    stretches = _swept(raw.mapInArrow(lambda it: _page_stretches(it, bitmap.value), _STRETCH))
    bitmap.destroy()  # the stretches are written
    spans = _stretch_spans(stretches, True)
    parts = rows.mapInArrow(_texts, "page_id long, url string, _key binary, article binary, outside array<string>, dropped array<boolean>, n_outside long")
    parts = parts.join(spans, "_key", "left").select("page_id", "url", "article", "outside", "dropped", "n_outside", "spans")
    return parts.mapInArrow(_finished, "page_id long, url string, text string, n_chars long, n_repeated long, n_article_repeated long")
