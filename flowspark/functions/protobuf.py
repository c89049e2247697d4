"""Protobuf messages of many flows at once: numpy over Arrow columns, no loop over messages.

Encoding makes, for each field, the bytes that every message has of it and
their lengths, then lays the fields of all messages side by side into one
buffer.  Decoding walks all messages in step: each step reads the next key and
value of every message that is not at its end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .arrow import binary_of, list_of

Part = tuple[np.ndarray, np.ndarray]  # lengths, and the bytes one after the other


@dataclass(frozen=True)
class Field:
    name: str
    tag: int
    is_bytes: bool = False
    repeated: bool = False
    packed: bool = False
    type: pa.DataType = pa.int64()  # of the column


UNKNOWN = pa.list_(pa.struct([("tag", pa.int32()), ("number", pa.int64()), ("bytes", pa.binary())]))


def varints(v: np.ndarray) -> Part:
    """64-bit numbers as varints."""
    v = v.view(np.uint64) if v.dtype == np.int64 else v.astype(np.int64).view(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << 7 * k)
    place = np.arange(int(n.max(initial=1)))
    out = (v[:, None] >> (place * 7).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    out[place < n[:, None] - 1] |= 128
    return n, out[place < n[:, None]]


def side_by_side(parts: Sequence[Part], n: int) -> Part:
    """The parts of each of n messages after each other."""
    parts = [(lengths, data) for lengths, data in parts if len(data)]
    total = sum((lengths for lengths, _ in parts), np.zeros(n, np.int64))
    out = np.empty(int(total.sum()), np.uint8)
    at = np.cumsum(total) - total
    for lengths, data in parts:
        out[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(data))] = data
        at = at + lengths
    return total, out


def fixed(data: bytes, there: np.ndarray) -> Part:
    """The same bytes where a field is there."""
    return there * len(data), np.tile(np.frombuffer(data, np.uint8), int(there.sum()))


def only(part: Part, there: np.ndarray) -> Part:
    lengths, data = part
    return (lengths * there, data[np.repeat(there, lengths)])


def bytes_of(a: pa.Array) -> Part:
    a = a.cast(pa.binary()) if a.type != pa.binary() else a
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    return np.diff(offsets), np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)


def numbers_of(a: pa.Array) -> np.ndarray:
    return a.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)


def key_of(tag: int, wire: int) -> bytes:
    return varints(np.array([tag << 3 | wire]))[1].tobytes()


def field_parts(f: Field, a: pa.Array, n: int) -> list[Part]:
    """What the messages have of one column; zeros, empty bytes and empty lists are left out."""
    if not f.repeated:
        if f.is_bytes:
            lengths, data = bytes_of(a)
            there = lengths > 0
            return [fixed(key_of(f.tag, 2), there), only(varints(lengths), there), (lengths, data)]
        v = numbers_of(a)
        return [fixed(key_of(f.tag, 0), v != 0), only(varints(v), v != 0)]
    if a.null_count:
        a = pa.array([x or [] for x in a.to_pylist()], a.type)
    counts = np.diff(a.offsets.to_numpy()).astype(np.int64)
    values = a.flatten()
    if not len(values):
        return []
    every = np.ones(len(values), bool)
    if f.is_bytes:
        lengths, data = bytes_of(values)
        each = side_by_side([fixed(key_of(f.tag, 2), every), varints(lengths), (lengths, data)], len(values))
    elif f.packed:
        each = varints(numbers_of(values))
    else:
        each = side_by_side([fixed(key_of(f.tag, 0), every), varints(numbers_of(values))], len(values))
    ends = np.concatenate(([0], np.cumsum(each[0])))[np.concatenate(([0], np.cumsum(counts)))]
    whole = np.diff(ends), each[1]
    if not f.packed:
        return [whole]
    return [fixed(key_of(f.tag, 2), counts > 0), only(varints(whole[0]), counts > 0), whole]


def encode(columns: dict[str, pa.Array], fields: Sequence[Field], n: int, delimited: bool) -> pa.Array:
    """Messages of n rows, fields in the order of their tags."""
    parts = [p for f in sorted(fields, key=lambda f: f.tag) if f.name in columns for p in field_parts(f, columns[f.name], n)]
    lengths, data = side_by_side(parts, n)
    if delimited:
        lengths, data = side_by_side([varints(lengths), (lengths, data)], n)
    return binary_of(data, lengths)


def read_varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the varints that begin at these places, where they end)."""
    value, at, live, shift = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at)), 0
    while len(live):
        if shift > 63:
            raise ValueError("a varint of more than ten bytes")
        if (at[live] >= end[live]).any():
            raise ValueError("a varint runs past the message")
        b = data[at[live]].astype(np.uint64)
        value[live] |= (b & np.uint64(127)) << np.uint64(shift)
        at[live] += 1
        live = live[b >= 128]
        shift += 7
    return value, at


def split(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the length-delimited messages in stretches of data, in their order."""
    begins, ends = [], []
    live = np.flatnonzero(at < end)
    at = at.copy()
    while len(live) > 32:  # many stretches: all in step
        size, start = read_varints(data, at[live], end[live])
        stop = start + size.astype(np.int64)
        if (stop > end[live]).any():
            raise ValueError("a message runs past the data")
        begins.append(start)
        ends.append(stop)
        at[live] = stop
        live = live[stop < end[live]]
    rest: tuple[list, list] = ([], [])
    for i in live.tolist():  # a few long ones, each by itself
        k, z = int(at[i]), int(end[i])
        raw = data[k:z].tobytes()
        base, k, z = k, 0, len(raw)
        while k < z:
            size = shift = 0
            while True:
                if k >= z:
                    raise ValueError("a varint runs past the message")
                b = raw[k]
                k += 1
                size |= (b & 127) << shift
                if b < 128:
                    break
                shift += 7
            if k + size > z:
                raise ValueError("a message runs past the data")
            rest[0].append(base + k)
            k += size
            rest[1].append(base + k)
    first = np.concatenate([*begins, np.array(rest[0], np.int64)])
    last = np.concatenate([*ends, np.array(rest[1], np.int64)])
    order = np.argsort(first, kind="stable")
    return first[order], last[order]


def stretches(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of each stretch, one after the other."""
    before = np.cumsum(length) - length
    return data[np.repeat(begin - before, length) + np.arange(int(length.sum()))]


def decode(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fields: Sequence[Field], unknown: bool = False) -> dict[str, pa.Array]:
    """Columns of the messages: of repeated scalars the last counts, lists accumulate, tags without a field go to `unknown` or are skipped."""
    n, by_tag = len(begin), {f.tag: f for f in fields}
    seen: dict[int, list] = {}  # tag -> (step, messages, wire type, numbers, begins, lengths)
    at, live, step = begin.astype(np.int64).copy(), np.flatnonzero(begin < end), 0
    while len(live):
        key, at[live] = read_varints(data, at[live], end[live])
        tag, wire = (key >> np.uint64(3)).astype(np.int64), (key & np.uint64(7)).astype(np.int64)
        if not np.isin(wire, (0, 1, 2, 5)).all():
            raise ValueError(f"wire type {wire[~np.isin(wire, (0, 1, 2, 5))][0]}")
        number, first, size = np.zeros(len(live), np.uint64), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        plain, sized = wire == 0, wire == 2
        if plain.any():
            number[plain], at[live[plain]] = read_varints(data, at[live[plain]], end[live[plain]])
        if sized.any():
            length, at[live[sized]] = read_varints(data, at[live[sized]], end[live[sized]])
            if (length > np.uint64(2**31)).any():
                raise ValueError("a field runs past the message")
            size[sized] = length.astype(np.int64)
        for kind, width in ((1, 8), (5, 4)):
            size[wire == kind] = width
        first[:] = at[live]
        at[live] += size
        if (at[live] > end[live]).any():
            raise ValueError("a field runs past the message")
        for kind, width in ((1, 8), (5, 4)):
            for k in range(width) if (wire == kind).any() else ():
                here = wire == kind
                number[here] |= data[first[here] + k].astype(np.uint64) << np.uint64(8 * k)
        for t in np.unique(tag).tolist():
            if t in by_tag or unknown:
                here = tag == t
                seen.setdefault(t, []).append((step, live[here], wire[here], number[here], first[here], size[here]))
        live = live[at[live] < end[live]]
        step += 1
    out = {f.name: column_of(f, seen.get(f.tag, []), data, n) for f in fields}
    if unknown:
        out["unknown"] = unknown_of({t: x for t, x in seen.items() if t not in by_tag}, data, n)
    return out


def column_of(f: Field, found: list, data: np.ndarray, n: int) -> pa.Array:
    inner = f.type.value_type if f.repeated else f.type
    for _, _, wire, *_ in found:
        if f.is_bytes and (wire != 2).any() or not f.is_bytes and not f.repeated and (wire == 2).any():
            raise ValueError(f"the wire type of {f.name}")
    if not f.repeated:
        if f.is_bytes:
            first, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for _, who, _, _, at, length in found:
                first[who], size[who] = at, length
            return binary_of(stretches(data, first, size), size)
        value = np.zeros(n, np.uint64)
        for _, who, _, number, *_ in found:
            value[who] = number
        return pa.array(value.view(np.int64).astype(inner.to_pandas_dtype()))
    if not found:
        return list_of(pa.array([], inner), np.zeros(n, np.int64))
    who, order = [], []
    first, size, value = [], [], []
    for step, messages, wire, number, at, length in found:
        if f.is_bytes:
            who.append(messages)
            order.append(np.full(len(messages), step << 32))
            first.append(at)
            size.append(length)
            continue
        single = wire != 2
        who.append(messages[single])
        order.append(np.full(int(single.sum()), step << 32))
        value.append(number[single])
        live, place, inside = np.flatnonzero(~single), at + 0, 0
        live = live[length[live] > 0]
        while len(live):  # packed numbers, all messages in step
            v, place[live] = read_varints(data, place[live], (at + length)[live])
            who.append(messages[live])
            order.append(np.full(len(live), (step << 32) + inside))
            value.append(v)
            live = live[place[live] < (at + length)[live]]
            inside += 1
    messages = np.concatenate(who)
    ranked = np.lexsort((np.concatenate(order), messages))
    counts = np.bincount(messages, minlength=n)
    if f.is_bytes:
        length = np.concatenate(size)[ranked]
        return list_of(binary_of(stretches(data, np.concatenate(first)[ranked], length), length), counts)
    return list_of(pa.array(np.concatenate(value)[ranked].view(np.int64).astype(inner.to_pandas_dtype())), counts)


def unknown_of(seen: dict[int, list], data: np.ndarray, n: int) -> pa.Array:
    """What undeclared tags hold, in order: numbers, or bytes of length-delimited fields."""
    rows: list[list[dict]] = [[] for _ in range(n)]
    found = sorted(((step, t, x) for t, each in seen.items() for step, *x in each), key=lambda y: y[:2])
    for _, t, (who, wire, number, at, length) in found:
        for i, w, v, a, z in zip(who.tolist(), wire.tolist(), number.view(np.int64).tolist(), at.tolist(), length.tolist(), strict=True):
            rows[i].append({"tag": t, "number": None if w == 2 else v, "bytes": data[a : a + z].tobytes() if w == 2 else None})
    return pa.array(rows, UNKNOWN)
