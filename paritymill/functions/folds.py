"""Keyed folds over sorted partitions, for state that depends on earlier decisions.

Rows are hash-partitioned by key and sorted inside each partition, so a fold walks
Arrow batches once and holds the state of a single key.  A key is never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_OUT_ROWS = 10_000


def sorted_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[tuple], object],
    step: Callable[[object, tuple], tuple | None],
    schema: str,
    finish: Callable[[object], tuple | list[tuple] | None] | None = None,
    placed: bool = False,
) -> DataFrame:
    """Fold every key in ``order``.

    ``start(key)`` makes the state, ``step(state, row)`` may return an output row and
    ``finish(state)`` may return one, or a list of them, after the last row of the key.
    ``row`` is a named tuple of the columns of ``df``.  ``placed`` tells that the rows of a key
    are in one partition already.
    """
    keys = list(keys)
    names = [part.strip().split(" ")[0].strip("`") for part in _split_schema(schema)]

    def done(state: object) -> list[tuple]:
        made = finish(state) if finish is not None else None
        return made if isinstance(made, list) else [made] if made is not None else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            positions = [batch.columns.get_loc(k) for k in keys]
            for row in batch.itertuples(index=False, name="Row"):
                key = tuple(row[i] for i in positions)
                if state is None or key != current:
                    if state is not None:
                        out.extend(done(state))
                    current, state = key, start(key)
                made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out, columns=names)
        last = done(state) if state is not None else []
        if last:
            yield pd.DataFrame(last, columns=names)

    near = df if placed else df.repartition(*keys)
    return near.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    run: Callable[[tuple, list[tuple]], Iterator[tuple]],
    schema: str,
) -> DataFrame:
    """``run(key, rows)`` for every group of ``keys``, its rows in ``order``, nulls first.

    Groups must be bounded (a chunk of a key, or a key's chunk summaries).  They come one
    after another from a sorted partition, so a group costs no more than its rows.
    """
    keys, columns = list(keys), list(columns)
    out_schema = to_arrow_schema(T.StructType.fromDDL(schema))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        current, held = None, []
        for batch in batches:
            names = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            rows = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            for key, row in zip(names, rows, strict=True):
                if key != current:
                    if held:
                        yield current, held
                    current, held = key, []
                held.append(row)
        if held:
            yield current, held

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        made = zip(zip(*rows, strict=True), out_schema, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in made], schema=out_schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in groups(batches):
            out.extend(run(key, rows))
            if len(out) >= _OUT_ROWS:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_first() for c in order])
    return placed.mapInArrow(mapped, schema)


def _split_schema(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    parts, depth, current = [], 0, ""
    for ch in schema:
        if ch in "<(":
            depth += 1
        elif ch in ">)":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]
