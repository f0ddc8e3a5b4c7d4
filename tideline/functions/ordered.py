"""Rules whose outcome depends on every row before, as one ordered pass.

Rows are dealt by key, sorted, and read in Arrow batches with the rule's state carried
from row to row: memory is one batch however many rows a key has, and the time is linear.
They are dealt by a hash of the key: a deal by the key itself is left out after a join or an
aggregation by that key, whose own deal Spark may undo at run time, knowing nothing of the pass.
A key's rows meet in one task, which such a rule cannot avoid; the caller selects the
few columns it needs first, so that payloads do not travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def _values(column: pa.Array) -> list:
    """A column as Python values. Going through numpy takes a tenth of the time of one scalar each."""
    kind, nulls = column.type, column.null_count
    if nulls == len(column):
        return [None] * nulls
    if pa.types.is_list(kind) and column.values.null_count == 0:
        flat, ends = _values(column.values), column.offsets.to_numpy().tolist()
        out = [flat[a:b] for a, b in zip(ends, ends[1:])]
    elif pa.types.is_string(kind):
        coded = column.dictionary_encode()
        words = [*coded.dictionary.to_pylist(), None]
        return [words[i] for i in coded.indices.fill_null(len(words) - 1).to_numpy().tolist()]
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        out = (column.fill_null(False if pa.types.is_boolean(kind) else 0) if nulls else column).to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    if nulls:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
            out[i] = None
    return out


def ordered_pass(df: DataFrame, by: list[str], order: list[str | Column], uses: list[str], fields: dict[str, str], start: Callable, step: Callable, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with the columns ``fields`` (name to type) that ``step`` gives
    for each row. What only the order needs does not travel to the workers.

    Of each key ``by`` the rows come in ``order``. ``start()`` is a key's first state;
    ``step(state, *values of uses)`` returns the next state and a tuple of outputs.
    """
    width = len(by)
    kept = keep or df.columns
    schema = df.limit(0).select(*kept, *(F.lit(None).cast(kind).alias(name) for name, kind in fields.items())).schema
    kinds = [_KINDS[k] for k in fields.values()]
    names = [*by, *uses]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [_values(batch.column(batch.schema.get_field_index(n))) for n in names]
            outs = []
            for now, row in zip(zip(*columns[:width]), zip(*columns[width:])):
                if now != key:
                    key, state = now, start()
                state, out = step(state, *row)
                outs.append(out)
            added = [pa.array(x, k) for x, k in zip(zip(*outs), kinds)] if outs else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *fields])

    keys = [F.col(b) for b in by]
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).select(*kept).mapInArrow(run, schema)


def ordered_rows(df: DataFrame, by: list[str], order: list[str | Column], uses: list[str], schema: str, start: Callable, step: Callable, finish: Callable | None = None) -> DataFrame:
    """Rows that an ordered pass gives: ``step(state, *values of uses)`` returns the rows (tuples
    without the key) that each row leads to and changes ``state`` in place; ``finish(state)`` returns
    those at a key's end. ``schema`` is that of the key followed by the rows."""
    width = len(by)
    fields = df.sparkSession.createDataFrame([], schema).schema
    kinds = [_KINDS[f.dataType.simpleString().replace("bigint", "long")] for f in fields]
    names, keys = [*by, *uses], [F.col(b) for b in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=fields.names)
            out.clear()
            return batch

        for batch in batches:
            columns = [_values(batch.column(batch.schema.get_field_index(n))) for n in names]
            for now, row in zip(zip(*columns[:width]), zip(*columns[width:])):
                if now != key:
                    if finish and key is not None:
                        out += [(*key, *x) for x in finish(state)]
                    key, state = now, start()
                if made := step(state, *row):
                    out += [(*key, *x) for x in made]
                    if len(out) >= 8192:
                        yield flush()
        if finish and key is not None:
            out += [(*key, *x) for x in finish(state)]
        if out:
            yield flush()

    return df.select(*names, *[o for o in order if isinstance(o, str) and o not in names]).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).select(*names).mapInArrow(run, fields)
