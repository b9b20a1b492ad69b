"""Many values looked for in a text at once, for file rows that hold thousands of them; column functions over Arrow."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrace.functions import batches

#: Characters at each end of a value that its mask shows, where it is longer than both.
VISIBLE = 4
#: Longer values are few and are looked for one by one, so that the automaton stays small.
LONG = 512


def places(values: list[str], text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of every place of a value in the text.

    An automaton over all values reads the text once; where its library is missing the text is cut once for each length of a value.
    """
    values = [v for v in dict.fromkeys(values) if v and len(v) <= len(text)]
    for v in (v for v in values if len(v) > LONG):
        at = text.find(v)
        while at >= 0:
            yield at, at + len(v), v
            at = text.find(v, at + 1)
    values = [v for v in values if len(v) <= LONG]
    if not values:
        return
    try:
        from ahocorasick import Automaton
    except ImportError:
        by_length: dict[int, set[str]] = {}
        for v in values:
            by_length.setdefault(len(v), set()).add(v)
        for n, own in sorted(by_length.items()):
            yield from ((at, at + n, text[at:at + n]) for at in range(len(text) - n + 1) if text[at:at + n] in own)
        return
    automaton = Automaton()
    for v in values:
        automaton.add_word(v, v)
    automaton.make_automaton()
    for last, v in automaton.iter(text):
        yield last + 1 - len(v), last + 1, v


def masked(values: list[str], lines: list[str]) -> list[str]:
    """The lines with every place of a value masked: short values whole, of longer ones all but both ends. Line breaks stay."""
    text = "\n".join(lines)
    edges: dict[int, int] = {}
    for start, end, value in places(values, text):
        if len(value) > 2 * VISIBLE:
            start, end = start + VISIBLE, end - VISIBLE
        edges[start] = max(edges.get(start, 0), end)
    pieces, at = [], 0
    for start in sorted(edges):
        start, end = max(start, at), edges[start]
        if end > start:
            pieces += [text[at:start], "\n".join("*" * len(x) for x in text[start:end].split("\n"))]
            at = end
    return "".join([*pieces, text[at:]]).split("\n")


def holders(values: list[str], texts: list[str]) -> list[int | None]:
    """For each value the first text that holds it and is not the value itself. The texts are read as one, a character between them
    that no value holds."""
    starts, found = [0], {}
    for text in texts:
        starts.append(starts[-1] + len(text) + 1)
    for start, end, v in places([v for v in values if "\0" not in v], "\0".join(texts)):
        number = bisect.bisect_right(starts, start) - 1
        if v not in found and (start, end) != (starts[number], starts[number + 1] - 1):
            found[v] = number
    return [found.get(v) for v in values]


def redacted(given: Column) -> Column:
    """The lines of a file with all known values masked, in one pass over its text; ``given`` is struct(lines, known)."""
    def run(files: pa.Array) -> pa.Array:
        out, kind = [], pa.list_(pa.string())
        for part in batches.slices(files):
            rows = zip(batches.plain_lists(part.field("known")), batches.plain_lists(part.field("lines")), part.field("lines").is_valid().to_pylist())
            out.append(pa.array([(masked(known, lines) if known and lines else lines) if there else None for known, lines, there in rows], kind))
        return batches.joined(out, kind)

    return F.arrow_udf(run, "array<string>")(given)


def look_ups(given: Column) -> Column:
    """struct(at, held): of each wanted name its place among the names, of each value the first text that holds it; null for none.

    ``given`` is struct(names, wanted, texts, values).
    """
    def run(files: pa.Array) -> pa.Array:
        out, numbers = [], pa.list_(pa.int32())
        for part in batches.slices(files):
            at, held = [], []
            for names, wanted, texts, values in zip(*(batches.plain_lists(part.field(c)) for c in ("names", "wanted", "texts", "values"))):
                place = {}
                for k, name in enumerate(names):
                    place.setdefault(name, k)
                at.append([place.get(x) for x in wanted])
                held.append(holders(values, texts) if values and texts else [None] * len(values))
            out.append(pa.StructArray.from_arrays([pa.array(at, numbers), pa.array(held, numbers)], names=["at", "held"]))
        return batches.joined(out, pa.struct([("at", numbers), ("held", numbers)]))

    return F.arrow_udf(run, "struct<at:array<int>,held:array<int>>")(given)
