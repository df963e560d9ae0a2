"""Arguments of many messages as Arrow columns: fields of some of them, functions worked out once for each distinct value,
and messages rendered from them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .fmt import Renderer, c_format


def starts(args: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the arguments of each message begin in `args.values`, and how many there are; -1 of a message without a list."""
    ends = args.offsets.to_numpy()
    sizes = np.diff(ends)
    if args.null_count:
        sizes = np.where(args.is_valid().to_numpy(zero_copy_only=False), sizes, -1)
    return ends[:-1], sizes


def child(args: pa.StructArray, name: str, at: np.ndarray) -> pa.Array | None:
    """A field of the arguments at some places; None where it is missing or null throughout."""
    k = args.type.get_field_index(name)
    if k < 0:
        return None
    own = args.field(k)
    if own.null_count == len(own):
        return None
    found = own.take(pa.array(at))
    return None if found.null_count == len(found) else found


def distinct(values: pa.Array, fn: Callable[[Any], Any]) -> tuple[list, np.ndarray]:
    """fn of each distinct value, null included, and the place of each row's among these."""
    if pa.types.is_floating(values.type):  # by their bits, as -0.0 is not 0.0
        found = values.view(pa.int64()).dictionary_encode("encode")
        known = found.dictionary.view(values.type)
    else:
        found = values.dictionary_encode("encode")
        known = found.dictionary
    return [fn(v) for v in known.to_pylist()], found.indices.to_numpy()


def rendered(fmt: pa.Array, args: pa.ListArray) -> pa.Array:
    """What Renderer gives of each message, a format at a time."""
    found = fmt.dictionary_encode("encode")
    codes, (begin, sizes) = found.indices.to_numpy(), starts(args)
    parts, places = [], []
    for k, text in enumerate(found.dictionary.to_pylist()):
        rows, r = np.flatnonzero(codes == k), Renderer(text)
        own = columns(r, args.values, begin[rows]) if (sizes[rows] >= len(r.steps)).all() else None
        if own is None:  # messages of one statement with values of different kinds, or too few
            own = pa.array([r(a) for a in args.take(pa.array(rows)).to_pylist()], pa.string())
        parts.append(own)
        places.append(rows)
    if len(parts) < 2:
        return parts[0] if parts else pa.array([], pa.string())
    order = np.empty(len(fmt), np.int64)
    order[np.concatenate(places)] = np.arange(len(fmt))
    return pa.concat_arrays(parts).take(pa.array(order))


def columns(r: Renderer, args: pa.StructArray, begin: np.ndarray) -> pa.Array | None:
    """Messages of one format whose arguments begin at some places; None if their values are not of one kind each."""
    pieces: list[pa.Array | pa.Scalar] = [pa.repeat(pa.scalar(""), len(begin))]
    for j, ((text, m, kind), convert) in enumerate(zip(r.steps, r.converters, strict=True)):
        value = next((v for name in ("s", "d", "u", "i") if (v := child(args, name, begin + j)) is not None), None)
        if value is None or value.null_count:
            return None
        width, prec = child(args, "width", begin + j), child(args, "prec", begin + j)
        if width is None and prec is None:
            shown, where = distinct(value, convert)
        else:
            none = pa.nulls(len(begin), pa.int32())
            (v, at_v), (w, at_w), (p, at_p) = (distinct(x, lambda x: x) for x in (value, none if width is None else width, none if prec is None else prec))
            known, where = np.unique((at_v.astype(np.int64) * len(w) + at_w) * len(p) + at_p, return_inverse=True)
            shown = [c_format(m, kind, v[c // len(p) // len(w)], w[c // len(p) % len(w)], p[c % len(p)]) for c in known.tolist()]
        pieces += [pa.scalar(text), pa.array(shown, pa.string()).take(pa.array(where))]
    return pc.binary_join_element_wise(*pieces, pa.scalar(r.tail), "")
