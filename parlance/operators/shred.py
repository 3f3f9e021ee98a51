"""Flat, related tables from deeply nested records.

Each record's JSON text is parsed as a stream of events into (path, ordinals, value) triples; the triples of one record are
grouped by their nearest repeated ancestor and each group is pivoted into one row. A record never leaves its task, so the
operator needs no shuffle, and rows of any repeated ancestor are one filter away.

A path names object keys joined by dots; arrays add `[]`, and objects whose keys are data (maps) add `{}`. A row has the path of
its repeated ancestor, the ordinals (positions or map keys) that lead to it, and its leaves by relative path.

Defined results: null, empty or damaged JSON gives no rows (a record is kept whole or not at all); a missing field is absent from
`leaves`; null leaves are absent, but their array element still gives a row; repeated rows are shredded each; very long texts are
streamed; extra columns are passed through when named as keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("ordinals", T.ArrayType(T.StringType())),
    T.StructField("leaves", T.MapType(T.StringType(), T.StringType())),
])

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def events(text: str) -> Iterator[tuple[str, object]]:
    """The parse events of one JSON text: ('{', None), ('[', None), ('key', k), ('value', v), ('end', None). Raises ValueError on damage."""
    i, n, stack = _SPACE.match(text, 0).end(), len(text), []
    expect = "value"  # value, first (value or end of array), key, firstkey, comma
    while True:
        if i >= n:
            raise ValueError("cut off")
        ch = text[i]
        if expect in ("key", "firstkey"):
            if ch == "}" and expect == "firstkey":
                stack.pop()
                yield "end", None
                i += 1
                expect = "comma"
            elif ch == '"':
                key, i = scanstring(text, i + 1, False)
                yield "key", key
                i = _SPACE.match(text, i).end()
                if i >= n or text[i] != ":":
                    raise ValueError("no colon")
                i += 1
                expect = "value"
            else:
                raise ValueError("no key")
        elif expect == "comma":
            if ch == ",":
                expect = "key" if stack[-1] == "{" else "value"
            elif ch == ("}" if stack[-1] == "{" else "]"):
                stack.pop()
                yield "end", None
            else:
                raise ValueError("no comma")
            i += 1
        elif ch == "{":
            stack.append("{")
            yield "{", None
            i += 1
            expect = "firstkey"
        elif ch == "[":
            stack.append("[")
            yield "[", None
            i += 1
            expect = "first"
        elif ch == "]" and expect == "first":
            stack.pop()
            yield "end", None
            i += 1
            expect = "comma"
        elif ch == '"':
            v, i = scanstring(text, i + 1, False)
            yield "value", v
            expect = "comma"
        else:
            m = _ATOM.match(text, i)
            if not m:
                raise ValueError("no value")
            yield "value", None if m[0] == "null" else m[0]
            i = m.end()
            expect = "comma"
        i = _SPACE.match(text, i).end()
        if not stack:
            if i < n:
                raise ValueError("text after the value")
            return


def triples(text: str, maps: frozenset[str] = frozenset()) -> Iterator[tuple[str, tuple[str, ...], object, bool]]:
    """(path, ordinals, value, is a leaf) of one JSON text. Elements of arrays and entries of maps also give a triple of their own."""
    # Each frame: kind, path so far, ordinals so far, the next position (arrays) or the pending key (objects).
    frames: list[list] = []

    def place() -> tuple[str, tuple[str, ...], bool]:
        if not frames:
            return "", (), False
        f = frames[-1]
        if f[0] == "[":
            at = f[1] + "[]", (*f[2], str(f[3])), True
            f[3] += 1
            return at
        if f[0] == "map":
            return f[1] + "{}", (*f[2], f[3]), True
        return (f"{f[1]}.{f[3]}" if f[1] else f[3]), f[2], False

    for kind, v in events(text):
        if kind == "key":
            frames[-1][3] = v
        elif kind == "end":
            frames.pop()
        else:
            path, ordinals, repeated = place()
            if repeated:
                yield path, ordinals, None, False
            if kind == "value":
                yield path, ordinals, v, True
            else:
                frames.append(["map" if kind == "{" and path in maps else kind, path, ordinals, 0])


def rows(text: str | None, maps: frozenset[str] = frozenset(), inherit: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, tuple[str, ...], dict[str, str]]]:
    """The pivoted rows of one JSON text, in document order; none if it is null or damaged. inherit: see shred."""
    if text is None:
        return []
    groups: dict[tuple[str, tuple[str, ...]], dict[str, str]] = {}
    try:
        for path, ordinals, value, leaf in triples(text, maps):
            cut = max(path.rfind("[]"), path.rfind("{}")) + 2 if ordinals else 0
            row = groups.setdefault((path[:cut], ordinals), {})
            if leaf and value is not None:
                row[path[cut:].lstrip(".")] = value
    except (ValueError, IndexError, RecursionError):
        return []
    for above, names in (inherit or {}).items():
        depth = above.count("[]") + above.count("{}")
        for (p, o), leaves in groups.items():
            if p != above and p.startswith(above):
                held = groups.get((above, o[:depth]), {})
                leaves.update({f"{above}.{n}": held[n] for n in names if n in held})
    return [(p, o, leaves) for (p, o), leaves in groups.items()]


def shred(df: DataFrame, text: Column, keys: list[str], maps: tuple[str, ...] = (), leaves: tuple[str, ...] | None = None, inherit: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per repeated ancestor of each record: the keys, path, ordinals and leaves.

    text: JSON text (use to_json for typed columns). maps: paths of objects whose keys are data. leaves: relative paths to keep,
    all by default; elements that are plain values have the relative path ''. inherit: leaves of an ancestor (by its path) that the
    rows below it carry as `path.leaf`, so that parents need no join.
    """
    known = frozenset(maps)
    kept = None if leaves is None else frozenset(leaves) | {f"{p}.{n}" for p, names in (inherit or {}).items() for n in names}
    source = df.select(*keys, text.alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, *ROWS.fields])
    out_type = pa.struct([("path", pa.string()), ("ordinals", pa.list_(pa.string())), ("leaves", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for p, o, v in rows(text, known, inherit):
                    at.append(i)
                    found.append((p, o, [(k, x) for k, x in v.items() if kept is None or k in kept]))
            idx = pa.array(at, pa.int64())
            cols = [b.column(i).take(idx) for i in range(b.num_columns - 1)]
            cols += [pa.array([f[k] for f in found], out_type.field(k).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "path", "ordinals", "leaves"])

    return source.mapInArrow(run, schema)


def table(shredded: DataFrame, path: str, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """The table of one repeated ancestor: the keys, its ordinals, and a column for each relative path in columns."""
    return shredded.filter(F.col("path") == path).select(*keys, "ordinals", *[F.col("leaves")[k].alias(n) for n, k in columns.items()])


def is_json_array(text: str) -> bool:
    """Whether text is one complete JSON array."""
    try:
        return isinstance(json.loads(text), list)
    except ValueError:
        return False
