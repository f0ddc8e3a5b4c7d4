"""Personal data by patterns and by bootstrapped context, in DataFrame operations.

Four fixed patterns give the base entities. They are the seeds of a bootstrap:
the words around seeds become lexical patterns, patterns and the strings they
surround form a graph, and a few rounds of scoring pass confidence from seeds to
patterns and from patterns to other identifier-like strings. Occurrences of such
strings in patterns of high confidence are added as spans of kind ``id``.

Sums and maxima along the matches of a text are taken in blocks of ``BLOCK``, and words
around a match are cut from pages of ``PAGE`` code points, so a text with a hundred
thousand matches costs about as much as that many texts with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, materialize

KINDS = ["email", "ip", "card", "phone"]
# Same matches as the plain patterns, without retries inside a run that has failed: a run's
# first place is tried, and a place inside it only where the match before has ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|(?<=[A-Za-z0-9-])(?=[._%+]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "id": r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])[0-9A-Za-z](?:[0-9A-Za-z_-]){5,63}+(?![0-9A-Za-z])",
}
# Cheap signs that a text can hold a match at all.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.8
WIDTH = 48  # code points on either side from which context words are taken
BROADCAST_ROWS, BROADCAST_SPANS = 50_000, 500_000
BLOCK, PAGE = 256, 4096
SPAN = "array<struct<s:int,e:int,v:string>>"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once however often later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    back = F.split(F.reverse(_digits(v)), "")
    back = F.filter(back, lambda d: d != "")
    each = F.transform(
        back,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(IP),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "id": lambda v: F.length(_digits(v)) >= 4,
}


def _ahead(items: Column, start: Column, merge) -> Column:
    """What has been merged before each item, for a short array."""
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        items, zero, lambda a, x: F.struct(merge(a["at"], x).cast("int").alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"]
    )


def _blocked(size: Column, block) -> Column:
    """``block(first place, items)`` for every ``BLOCK`` of ``size`` items."""
    return F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(BLOCK)), lambda b: block(b, F.least(F.lit(BLOCK), size - b)))


def _starts(blocks: str, merge) -> Column:
    return _ahead(F.transform(blocks, lambda blk: F.aggregate(blk, F.lit(0), lambda a, x: merge(a, x).cast("int"))), F.lit(0), merge)


def _running(blocks: str, starts: str, merge) -> Column:
    return F.flatten(F.zip_with(blocks, starts, lambda blk, at: _ahead(blk, at, merge)))


def _sum(a: Column, x: Column) -> Column:
    return a + x


def _lengths(matches: str, pieces: str) -> Column:
    """Blocks of how far each match reaches beyond the end of the match before it."""
    m, p = F.col(matches), F.col(pieces)
    both = lambda b, n: F.zip_with(F.slice(p, b + 1, n), F.slice(m, b + 1, n), lambda q, v: F.length(q) + F.length(v))
    return F.when(F.size(m) > 0, _blocked(F.size(m), both)).otherwise(F.array().cast("array<array<int>>"))


def _spans(matches: str, pieces: str, before: Column) -> Column:
    """Places of matches, from their lengths, those of what lies between them and where the
    match before each one ended."""
    found = F.zip_with(matches, F.coalesce(pieces, F.array().cast("array<string>")), lambda v, q: F.struct(v.alias("v"), F.length(q).alias("g")))

    def placed(x: Column, at: Column) -> Column:
        s = at + x["g"]
        return F.struct(s.alias("s"), (s + F.length(x["v"])).alias("e"), x["v"].alias("v"))

    return F.filter(F.zip_with(found, before, placed), lambda x: x["v"].isNotNull())


def _valid(kind: str):
    return lambda x: VALID[kind](x["v"])


def _of_kind(n: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), x["v"].alias("v"))


def _is_kind(n: int):
    return lambda x: x["k"] == n


def find_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (sorted structs ``s, k, e, v``; k is the place in ``KINDS``) and ``ids``
    (identifier-like strings outside the base spans) to rows with a non-null text."""
    t, kinds = F.col(text), [*KINDS, "id"]
    none = F.array().cast("array<string>")
    found = {}
    for k in kinds:
        all_of = F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0))
        found[f"_m_{k}"] = F.when(F.instr(t, SIGNS[k]) > 0, all_of).otherwise(none) if k in SIGNS else all_of
    df = _once(rows, **found)
    df = _once(df, **{f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(t, PATTERNS[k], -1)) for k in kinds})
    df = _once(df, **{f"_b_{k}": _lengths(f"_m_{k}", f"_p_{k}") for k in kinds})
    df = _once(df, **{f"_t_{k}": _starts(f"_b_{k}", _sum) for k in kinds})
    df = _once(df, **{f"_s_{k}": F.filter(_spans(f"_m_{k}", f"_p_{k}", _running(f"_b_{k}", f"_t_{k}", _sum)), _valid(k)) for k in kinds})
    base = F.concat(
        *(
            F.transform(f"_s_{k}", _of_kind(n))
            for n, k in enumerate(KINDS)
        )
    )
    df = _once(df, base=F.array_sort(base))

    def reach(b: Column, n: Column) -> Column:
        items = F.transform(F.slice("base", b + 1, n), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        ends = F.transform(F.slice("base", b + 1, n), lambda x: x["e"])
        return F.struct(F.get("base", b)["s"].alias("s"), F.array_max(ends).alias("e"), items.alias("items"))

    df = _once(df, _near=F.when(F.size("base") > 0, _blocked(F.size("base"), reach)))
    meets = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    free = F.filter("_s_id", lambda x: ~F.exists("_near", lambda n: meets(n, x) & F.exists(n["items"], lambda b: meets(b, x))))
    df = _once(df, ids=F.when(F.col("_near").isNull(), F.col("_s_id")).otherwise(free))
    return df.drop("_near", *(f"_{a}_{k}" for a in "mpbts" for k in kinds))


def _pages(text: str, more: int) -> Column:
    """The text in pages of ``PAGE`` code points, each with ``more`` of what follows."""
    t = F.col(text)
    places = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(PAGE))
    return F.transform(places, lambda k: F.substring(t, k + 1, F.lit(PAGE + more)))


def _contexts(pages: str, spans: Column, seed: bool) -> Column:
    """``s, e, v, seed, patterns`` of each span: the two words before it, and the word
    before with the word behind."""

    def cut(at: Column, n: Column) -> Column:
        page = F.get(F.col(pages), F.floor(at / PAGE).cast("int"))
        return F.lower(F.substring(F.coalesce(page, F.lit("")), at % PAGE + 1, n))

    def one(x: Column) -> Column:
        first_place = F.greatest(x["s"] - WIDTH, F.lit(0))
        ahead = cut(first_place, x["s"] - first_place)
        behind = cut(x["e"], F.lit(WIDTH))
        two = F.regexp_extract(ahead, r"(\S+\s+\S+\s*)$", 1)
        last, first = F.regexp_extract(ahead, r"(\S+\s*)$", 1), F.regexp_extract(behind, r"^(\s*\S+)", 1)
        squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
        left, around = F.concat(F.lit("l "), squeeze(two)), F.concat(F.lit("a "), squeeze(last), F.lit("\t"), squeeze(first))
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), F.lit(seed).alias("seed"),
            F.filter(F.array(F.when(two != "", left), F.when((last != "") & (first != ""), around)), lambda p: p.isNotNull()).alias("patterns"),
        )

    return F.transform(spans, one)


def learn_patterns(spans: DataFrame) -> DataFrame:
    """``pattern`` of high confidence, from ``v, seed, pattern`` rows.

    The confidence of a pattern is the mean score of the distinct strings it surrounds;
    a seed scores 1, another string the noisy-or of its patterns with enough support.
    """
    edges = spans.groupBy("pattern", "v").agg(F.max("seed").alias("seed"))
    # What is counted per pattern or string is written before it is joined, so that Spark can
    # split the rows of a common pattern over tasks.
    support = edges.groupBy("pattern").agg(F.count_if("seed").alias("n")).filter(F.col("n") >= SUPPORT).select("pattern")
    support = materialize(support)
    edges = materialize(edges.join(support, "pattern", "left_semi").withColumn("score", F.col("seed").cast("double")))
    for n in range(ROUNDS):
        conf = materialize(edges.groupBy("pattern").agg(F.avg("score").alias("conf")))
        if n == ROUNDS - 1:
            break
        scored = edges.join(conf, "pattern")
        by_string = scored.groupBy("v").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.99)))))).alias("found"))
        by_string = materialize(by_string)
        after = materialize(
            edges.join(by_string, "v").select("pattern", "v", "seed", F.when(F.col("seed"), 1.0).otherwise(F.when(F.col("found") >= CONFIDENCE, F.col("found")).otherwise(0.0)).alias("score"))
        )
        discard(edges)
        edges = after
    return conf.filter(F.col("conf") >= CONFIDENCE).select("pattern")


def added_spans(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, added``: spans (structs ``s, k, e``) that context adds, for rows of :func:`find_spans`."""
    some = _once(rows.filter((F.size("base") > 0) | (F.size("ids") > 0)), _pages=_pages(text, WIDTH))
    each = F.explode(F.concat(_contexts("_pages", F.col("base"), True), _contexts("_pages", F.col("ids"), False)))
    spans = some.select(key, each.alias("x")).select(key, "x.*")
    spans = materialize(spans)
    edges = spans.select("v", "seed", F.explode("patterns").alias("pattern"))
    good = materialize(learn_patterns(edges))
    hits = spans.filter("not seed").select(key, "s", "e", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
    hits = hits.select(key, "s", F.lit(len(KINDS)).alias("k"), "e").distinct()
    return materialize(hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("added")))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, "id"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def with_spans(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``rows`` with ``base`` and ``spans`` (base and added ones, sorted by start and kind)."""
    found = find_spans(rows, text)
    added = added_spans(found, key, text)
    n, spans = added.agg(F.count("*"), F.coalesce(F.sum(F.size("added")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and spans <= BROADCAST_SPANS:  # else an ordinary join
        added = F.broadcast(added)
    plain = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    more = F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    return found.join(added, key, "left").withColumn("spans", F.array_sort(F.concat(plain, more))).drop("added", "ids")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, sorted by start and then by
    kind as listed (``id`` last). Null texts are empty; a text without spans has an empty
    string and its digest. Ids may be null or repeat: every row is judged by its own text,
    so repeated rows give equal results. An empty table gives no rows.

    Added spans are runs of 6 to 64 ASCII letters, digits, ``_`` and ``-`` with 4 digits or
    more, in a pattern that ``SUPPORT`` distinct seeds have and whose confidence reaches
    ``CONFIDENCE``. They overlap neither base spans, which go first, nor each other. Context
    words are those within ``WIDTH`` code points on either side.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.sha2("text", 256))
    out = with_spans(rows, "_key")
    counts = [F.size(F.filter("base", _is_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask(rows: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``text`` (not null) with each span replaced by its kind in
    brackets; of spans that overlap the first stands for all."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in [*KINDS, "id"]))
    ends = lambda b, n: F.transform(F.slice(spans, b + 1, n), lambda x: x["e"])
    df = _once(rows, _b=_blocked(F.size(spans), ends))
    df = _once(df, _t=_starts("_b", F.greatest))
    label = lambda x, at: F.when(x["s"] >= at, F.get(names, x["k"])).otherwise("")
    told = F.zip_with(spans, _running("_b", "_t", F.greatest), lambda x, at: F.struct(x["s"].alias("s"), x["e"].alias("e"), label(x, at).alias("l")))
    df = _once(df, _own=F.filter(told, lambda x: x["s"].isNotNull()), _pages=_pages(text, 0))

    def page(part: Column, k: Column) -> Column:
        lo = k * PAGE

        def step(acc: Column, x: Column) -> Column:
            gap = F.substring(part, acc["at"] - lo + 1, F.greatest(F.greatest(x["s"], lo) - acc["at"], F.lit(0)))
            shown = F.when(x["s"] >= lo, x["l"]).otherwise("")
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap, shown).alias("out"))

        own = F.filter("_own", lambda x: (x["e"] > lo) & (x["s"] < lo + PAGE))
        return F.aggregate(
            own, F.struct(lo.alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(part, a["at"] - lo + 1, F.lit(PAGE)))
        )

    whole = F.array_join(F.transform("_pages", page), "")
    return df.withColumn(out, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop("_b", "_t", "_own", "_pages")
