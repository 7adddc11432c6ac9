"""Column expressions over handles (node_id * 2 + reverse bit), edges and walks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(node_id: Column, reverse: Column) -> Column:
    return node_id * 2 + F.when(reverse, 1).otherwise(0)


def node_of(handle: Column) -> Column:
    return F.shiftright(handle, 1)


def is_reverse(handle: Column) -> Column:
    return handle.bitwiseAND(1) == 1


def flip(handle: Column) -> Column:
    return handle.bitwiseXOR(1)


def is_canonical_edge(a: Column, b: Column) -> Column:
    """Of an edge a -> b and its mirror image flip(b) -> flip(a), exactly one is canonical (or they are the same edge).

    Leaving a node forwards, the target may not lie before it; leaving it in reverse, the target must lie
    behind it, or be the node itself read forwards.
    """
    na, nb = node_of(a), node_of(b)
    return F.when(is_reverse(a), (nb > na) | ((nb == na) & ~is_reverse(b))).otherwise(nb >= na)


def mirrored(walk: Column) -> Column:
    """The walk on the other strand."""
    return F.transform(F.reverse(walk), flip)


def is_canonical_walk(walk: Column) -> Column:
    """A walk whose ends have the same orientation is canonical when forward; else its end handles decide as an edge does."""
    first, last = F.element_at(walk, 1), F.element_at(walk, -1)
    return F.when(is_reverse(first) == is_reverse(last), ~is_reverse(first)).otherwise(is_canonical_edge(first, last))


def walk_key(walk: Column) -> Column:
    return F.array_join(F.transform(walk, lambda h: h.cast("string")), ",")
