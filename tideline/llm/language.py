"""Language identification by cross-parsing.

Running text of labelled documents of each language becomes a suffix automaton. A
whole text, in lower case and with all that lies between words as one space, is cut into
the longest pieces that occur in a language's sample, across words. The language that
needs the fewest pieces per character, each weighed by the bits it takes to point into
its sample, wins.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_DOCS = 24  # labelled documents per language, drawn by a hash of doc_id
SAMPLE_CHARS = 4096  # first among those of at most so many code points
UNKNOWN = "und"


class SuffixAutomaton:
    """All substrings of a text; ``longest`` follows one from a given place."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def linked(self) -> dict:
        """The states as one graph: a state maps a character to the next state."""
        for state in self.next:
            for c, to in state.items():
                state[c] = self.next[to]
        return self.next[0]


def phrases(root: dict, text: str) -> int:
    """Pieces of a greedy cross-parsing: each is the longest match from where the
    last one ended; a character that the sample lacks is a piece of its own."""
    n, state = 0, root
    for c in text:
        to = state.get(c)
        if to is None:
            n += 1
            if state is root:
                continue
            to = root.get(c)
            if to is None:
                n += 1
                to = root
        state = to
    return n + (state is not root)


_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, with every run of characters that are no letters as one space, and one
    space at either end."""
    return f" {_OTHER.sub(' ', text.lower()).strip(' ')} "


class Identifier:
    """Cross-parsing against one automaton per language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = ["".join(map(plain, samples[lang])) for lang in self.langs]
        self.automata = [SuffixAutomaton(t).linked() for t in texts]
        self.bits = np.array([math.log2(len(t) + 1) for t in texts])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        text = plain(text)
        cost = np.array([phrases(a, text) for a in self.automata]) * self.bits / len(text)
        order = np.argsort(cost, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        return self.langs[order[0]], float(1 - cost[order[0]] / cost[order[1]])


_LOADED: dict[str, Identifier] = {}


def _predictor(key: str, samples, text: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Identifier(samples.value)
        model = _LOADED[key]
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names[:width], "lang_pred", "score"],
            )

    return run


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The sample texts of each language, from documents that have a label, a text that is
    not empty and an id whose fold is not 2.

    The bound: ``SAMPLE_DOCS`` whole documents of at most ``SAMPLE_CHARS`` code points each,
    in the order of a hash of the id; where a language has fewer, its next longer ones until
    ``SAMPLE_DOCS * SAMPLE_CHARS`` code points are reached, the last document being whole.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).filter(
        (fold("i") != 2) & F.col("l").isNotNull() & (F.length("t") > 0)
    )
    order = Window.partitionBy("l").orderBy(F.greatest("c", F.lit(SAMPLE_CHARS)), F.xxhash64("i"), "i")
    each = rows.groupBy("i", "l").agg(F.max(F.length("t")).alias("c"))  # repeated rows count once
    drawn = each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS)
    pairs, read = set(), {}
    for r in drawn.orderBy("l", "n").collect():
        if read.get(r.l, 0) < SAMPLE_DOCS * SAMPLE_CHARS:
            read[r.l] = read.get(r.l, 0) + r.c
            pairs.add((r.i, r.l))
    if not pairs:
        return {}
    texts: dict[str, list[str]] = {}
    ids = sorted({i for i, _ in pairs})
    # Rows repeated under a drawn id are grouped away: one text for each id and label.
    once = rows.filter(F.col("i").isin(ids)).groupBy("i", "l").agg(F.min("t").alias("t")).collect()
    for r in sorted(once, key=lambda r: r.i):
        if (r.i, r.l) in pairs:
            texts.setdefault(r.l, []).append(r.t)
    return texts


def with_language(docs: DataFrame, samples: dict[str, list[str]], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``. Text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by the sample sizes above
    names = [*keep, *([] if text_col in keep else [text_col])]
    rows = docs.select(*names)
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    run = _predictor(uuid.uuid4().hex, shared, names.index(text_col), len(keep))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    ``und`` with score 0 for texts that are null or have no letter, and for all texts
    where nothing could be learned (an empty table or no labels). Equal costs go to the
    language first in the alphabet. The score is the share of bits that the best
    language saves against the next. Rows with a null id are predicted, never learned
    from, and count as not held out.
    """
    samples = learn(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return with_language(rows, samples, ["doc_id", "held_out"])
