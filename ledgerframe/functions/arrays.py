"""Folds over arrays whose cost stays linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLOCK = 64


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def states_before(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each entry of `values` the state of the fold before it: start, step(start, first), ...

    Entries are folded in blocks; the states at the blocks' starts are found once, those inside from there.
    """
    fold = lambda entries, state: F.aggregate(entries, state, step)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    heads = lambda bs: F.slice(F.aggregate(bs, F.array(start), lambda a, b: F.concat(a, F.array(fold(b, F.element_at(a, -1))))), F.lit(1), F.size(bs))
    inside = lambda b, head: F.transform(b, lambda x, i: fold(F.slice(b, F.lit(1), i), head))
    whole = lambda bs: F.flatten(F.zip_with(bs, heads(bs), inside))
    return bound(values, lambda v: F.when(F.size(v) > 0, bound(blocks(v), whole)).otherwise(F.slice(F.array(start), F.lit(1), F.lit(0))))


def linear_quantile(ordered: Column, p: float) -> Column:
    """Quantile of an ascending array, linear between neighbours."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.get(ordered, F.floor(at).cast("int"))
    return low + (F.get(ordered, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def mean_of(values: Column) -> Column:
    """Mean of an array, null where it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def mean_up_to_quantile(ordered: Column, p: float, strict: bool) -> Column:
    """Mean of the entries of an ascending array below its quantile (strict) or up to it; null where there is none.

    Only the entries up to the quantile's place are looked at; all of them where equal values reach beyond it.
    """
    q, at = linear_quantile(ordered, p), F.ceil((F.size(ordered) - 1) * F.lit(p)).cast("int")
    head = F.slice(ordered, F.lit(1), at + 1)
    if strict:
        return mean_of(F.filter(head, lambda x: x < q))
    return mean_of(F.filter(F.when(F.get(ordered, at + 1) <= q, ordered).otherwise(head), lambda x: x <= q))
