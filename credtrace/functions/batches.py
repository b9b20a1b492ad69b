"""Nested Arrow columns as plain lists, a leaf at a time and some rows at a time, so that no batch becomes objects as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a batch that are plain lists at a time.
ROWS = 512


def slices(batch: pa.Array) -> Iterator[pa.Array]:
    return (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS))


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def plain(leaf: pa.Array) -> list:
    """Strings or numbers; null is None."""
    return leaf.to_pylist() if leaf.null_count and not pa.types.is_string(leaf.type) else leaf.to_numpy(zero_copy_only=False).tolist()


def items(lists: pa.Array) -> tuple[list[int], pa.Array]:
    """Where each list begins and ends in its items, and the items; a null list is empty."""
    if not len(lists):  # the JVM writes no offsets for none
        return [0], lists.values.slice(0, 0)
    offsets = lists.offsets.to_numpy()
    first, last = int(offsets[0]), int(offsets[-1])
    return (offsets - first).tolist(), lists.values.slice(first, last - first)


def cut(values: list, offsets: list[int]) -> list[list]:
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def plain_lists(lists: pa.Array) -> list[list]:
    offsets, values = items(lists)
    return cut(plain(values), offsets)


def offsets_of(lists: list[list]) -> pa.Array:
    out = [0]
    for own in lists:
        out.append(out[-1] + len(own))
    return pa.array(out, pa.int32())


def as_lists(lists: list[list], fields: dict[str, pa.DataType]) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    columns = list(zip(*(x for own in lists for x in own))) or [()] * len(fields)
    return pa.ListArray.from_arrays(offsets_of(lists), pa.StructArray.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, fields.values())], names=list(fields)))
