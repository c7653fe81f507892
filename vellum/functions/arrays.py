"""Arrays as ordered sets: first spellings, complements, bounds, intersections in a given order; id sets of claims."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of every key in order; elements with an empty or null key are left out."""
    keys = F.transform(values, key)
    pairs = F.transform(values, lambda x, i: F.struct(x.alias("x"), key(x).alias("k"), F.array_position(keys, key(x)).alias("p"), (i + 1).alias("i")))
    return F.transform(F.filter(pairs, lambda z: (z["k"] != "") & (z["p"] == z["i"])), lambda z: z["x"])


def complement(universe: Sequence[str], values: Column) -> Column:
    """What of the universe is not there, in its order."""
    return F.array_except(F.array(*map(F.lit, universe)), values)


def bounded_by(values: Column, bound: Column) -> Column:
    """The values within the bound, all of them where there is no bound."""
    return F.when(F.size(bound) > 0, F.array_intersect(values, bound)).otherwise(values)


def in_order_of(first: Column, *others: Column) -> Column:
    """What all arrays hold, in the order of the first."""
    for o in others:
        first = F.array_intersect(first, o)
    return first


def united(*arrays: Column) -> Column:
    """All elements of all arrays once, in order; nulls count as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.flatten(F.array(*[F.coalesce(a, none) for a in arrays]))))


def hits_or_candidates(ids: Column, candidates: Column, predicted: Column) -> Column:
    """Predicted ids that are among the ids, or among the candidates where there are no ids."""
    return F.array_intersect(F.when(F.size(ids) > 0, ids).otherwise(candidates), predicted)


def first_per_key(entries: Column) -> Column:
    """A map of entries (key, value) in which the first value of every key counts."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.transform(F.filter(F.transform(entries, lambda e, i: F.struct(e.alias("e"), (F.array_position(keys, e["key"]) == i + 1).alias("f"))), lambda z: z["f"]), lambda z: z["e"]))


def filled_or_default(fields: Sequence[str], known: Column, empty: Column) -> Column:
    """array(struct(field, value)) of all fields in order, ``empty`` where the map has none."""
    return F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.try_element_at(known, F.lit(f)), empty).alias("value")) for f in fields])
