"""Groups of rows folded in order, for rules that depend on what came before in their scan."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[list[dict]], list[tuple]], default: Callable[[list[dict], Exception], list[tuple]] | None = None) -> DataFrame:
    """fold's rows for each group: its rows as dictionaries, in order. Spark deals out and sorts the groups; a task holds one
    of them at a time, so that many small groups cost little each. A group is one Python list: meant for what one scan holds.

    default: the rows of a group whose fold raises, made from the group and the error, so that one bad group doesn't fail its
    task and with it the job; without it the error is raised."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out, strict=True)], schema=out)

    def folded(group: list[dict]) -> list[tuple]:
        if default is None:
            return fold(group)
        try:
            return fold(group)
        except Exception as error:  # noqa: BLE001
            return default(group, error)

    def run(batches):
        group, key = [], None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                k = [row[c] for c in keys]
                if k != key and group:
                    found += folded(group)
                    group = []
                key = k
                group.append(row)
            if found:
                yield packed(found)
        if group and (found := folded(group)):
            yield packed(found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
