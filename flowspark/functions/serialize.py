"""Flows to JSON and text (expressions) and to length-delimited protobuf (vectorised codec)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FLOW_COLUMNS, FLOW_FIELDS
from .arrow import kind_of
from .protobuf import Field, bytes_of, decode, encode, split
from .render import DEFAULTS, RENDERERS, VIRTUAL, plain


MESSAGES = 50_000  # decoded together


@dataclass
class Format:
    """What a formatter writes: columns in order, renames, renderers by column, key columns."""

    fields: Sequence[str] = tuple(FLOW_COLUMNS)
    rename: Mapping[str, str] = field(default_factory=dict)
    render: Mapping[str, str] = field(default_factory=dict)
    key: Sequence[str] = ()

    def __post_init__(self):
        for name, renderer in self.render.items():
            if renderer not in RENDERERS:
                raise ValueError(f"no renderer {renderer} (for {name})")


def rendered(df: DataFrame, name: str, fmt: Format) -> Column:
    """A column as it is written: arrays element by element."""
    if name not in df.columns:
        if name in VIRTUAL:
            return VIRTUAL[name]()
        raise ValueError(f"no column {name}")
    kind = df.schema[name].dataType
    simple = kind.elementType.simpleString() if isinstance(kind, T.ArrayType) else kind.simpleString()
    chosen = RENDERERS[fmt.render[name]] if name in fmt.render else DEFAULTS.get(name)
    render = chosen if chosen and fmt.render.get(name) != "none" else lambda c: plain(c, simple)
    return F.transform(F.col(name), render) if isinstance(kind, T.ArrayType) else render(F.col(name))


def to_json(df: DataFrame, fmt: Format | None = None) -> Column:
    fmt = fmt or Format()
    return F.to_json(F.struct(*[rendered(df, n, fmt).alias(fmt.rename.get(n) or n) for n in fmt.fields]), {"ignoreNullFields": "false"})


def to_text(df: DataFrame, fmt: Format | None = None) -> Column:
    """``name=value`` joined by spaces."""
    fmt = fmt or Format()
    parts = []
    for n in fmt.fields:
        c = rendered(df, n, fmt)
        array = n in df.columns and isinstance(df.schema[n].dataType, T.ArrayType)
        value = F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ","), F.lit("]")) if array else c.cast("string")
        parts.append(F.concat(F.lit(f"{fmt.rename.get(n) or n}="), value))
    return F.concat_ws(" ", *parts)


@dataclass(frozen=True)
class Extension:
    """A declared column beyond the schema: protobuf tag, kind (varint, string or bytes), repeated or not."""

    name: str
    tag: int
    kind: str = "varint"
    array: bool = False


def message_fields(extensions: Sequence[Extension] = ()) -> list[Field]:
    """The flow's fields and the extensions'.  Numbers of the schema's lists are packed, those of extensions are not."""
    out = []
    for n, t, tag in FLOW_FIELDS:
        inner, repeated = (t.elementType, True) if isinstance(t, T.ArrayType) else (t, False)
        binary = isinstance(inner, T.BinaryType)
        out.append(Field(n, tag, binary, repeated, repeated and not binary, kind_of(t)))
    for e in extensions:
        inner = pa.int64() if e.kind == "varint" else pa.binary()
        out.append(Field(e.name, e.tag, e.kind != "varint", e.array, False, pa.list_(inner) if e.array else inner))
    return out


def to_protobuf(flows: DataFrame, extensions: Sequence[Extension] = (), delimited: bool = True) -> DataFrame:
    """flows as (message binary)."""
    fields = [f for f in message_fields(extensions) if f.name in flows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            message = encode(dict(zip(b.schema.names, b.columns, strict=True)), fields, len(b), delimited)
            yield pa.RecordBatch.from_arrays([message], ["message"])

    return flows.select(*[f.name for f in fields]).mapInArrow(run, "message binary")


def from_protobuf(messages: DataFrame, column: str = "message", extensions: Sequence[Extension] = (), delimited: bool = True, unknown: bool = False) -> DataFrame:
    """Flows from a binary column of messages, or of several length-delimited ones.

    With unknown there is a column of that name: what tags without a column
    hold, in order, as (tag, number, bytes); else they are skipped.
    """
    fields = message_fields(extensions)
    kinds = {"varint": T.LongType(), "string": T.BinaryType(), "bytes": T.BinaryType()}
    extra = [T.StructField(e.name, T.ArrayType(kinds[e.kind]) if e.array else kinds[e.kind]) for e in extensions]
    if unknown:
        extra.append(T.StructField("unknown", T.ArrayType(T.StructType.fromDDL("tag int, number bigint, bytes binary"))))
    schema = T.StructType([T.StructField(n, t) for n, t, _ in FLOW_FIELDS] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, data = bytes_of(b.column(0))
            end = np.cumsum(lengths)
            begin = end - lengths
            if delimited:
                begin, end = split(data, begin, end)
            for k in range(0, len(begin), MESSAGES):
                found = decode(data, begin[k : k + MESSAGES], end[k : k + MESSAGES], fields, unknown)
                yield pa.RecordBatch.from_arrays([found[n] for n in schema.names], schema.names)

    return messages.select(column).mapInArrow(run, schema)
