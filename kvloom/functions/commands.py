"""Keys of a command by its arguments, as native columns.

Most commands have their keys at a first place, a last one and a step. The rest give a
number of keys, or name keys after an option, whose place depends on the words that the
options before it take. Places count from 0, which is the command's name.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import key_slot

#: Commands that state how many keys follow, with the place of that number and the places of keys before it.
NUMKEYS = {
    "EVAL": (2, ()), "EVALSHA": (2, ()), "EVAL_RO": (2, ()), "EVALSHA_RO": (2, ()), "FCALL": (2, ()), "FCALL_RO": (2, ()),
    "ZUNION": (1, ()), "ZINTER": (1, ()), "ZDIFF": (1, ()), "ZINTERCARD": (1, ()), "SINTERCARD": (1, ()), "SUNIONCARD": (1, ()), "SDIFFCARD": (1, ()),
    "LMPOP": (1, ()), "ZMPOP": (1, ()), "BLMPOP": (2, ()), "BZMPOP": (2, ()),
    "ZUNIONSTORE": (2, (1,)), "ZINTERSTORE": (2, (1,)), "ZDIFFSTORE": (2, (1,)),
}
#: No word after this option is an option.
END = 1 << 30
#: How many words each option takes.
STREAM_OPTIONS = {"BLOCK": 1, "COUNT": 1, "MAXCOUNT": 1, "MAXSIZE": 1, "CLAIM": 1, "GROUP": 2, "NOACK": 0, "STREAMS": END}
SORT_OPTIONS = {"BY": 1, "LIMIT": 2, "GET": 1, "STORE": 1}
RADIUS_OPTIONS = {"STORE": 1, "STOREDIST": 1}
MIGRATE_OPTIONS = {"AUTH": 1, "AUTH2": 2, "KEYS": END}


def _none() -> Column:
    return F.array().cast("array<int>")


def _run(low: Column, n: Column) -> Column:
    """n places from low on."""
    return F.when(n > 0, F.sequence(low, low + n - 1)).otherwise(_none())


def option_places(args: Column, first: int, takes: dict[str, int], others: int = 0) -> Column:
    """Places of the options of ``takes`` from ``first`` on, in order. Words that an option takes are none themselves; ``others``: what any other word takes."""
    width = F.create_map(*[F.lit(x) for pair in takes.items() for x in pair])
    start = F.struct(F.lit(first).alias("free"), _none().alias("places"))

    def step(state: Column, i: Column) -> Column:
        own = width[F.upper(F.get(args, i))]
        here = i >= state["free"]
        free = F.when(here, i + 1 + F.coalesce(own, F.lit(others))).otherwise(state["free"])
        return F.struct(free.alias("free"), F.when(here & own.isNotNull(), F.array_append(state["places"], i)).otherwise(state["places"]).alias("places"))

    return F.aggregate(_run(F.lit(first), F.size(args) - first), start, step)["places"]


def _named(args: Column, places: Column, *words: str) -> Column:
    """The last of the places that holds one of the words; null if none does."""
    return F.array_max(F.filter(places, lambda p: F.upper(F.get(args, p)).isin(*words)))


def _count(args: Column, place: Column) -> Column:
    return F.regexp_extract(F.get(args, place), r"^\s*\+?([0-9]+)", 1).try_cast("int")


def key_places(args: Column, first: Column, last: Column, step: Column, flags: Column) -> Column:
    """Places of a command's keys; first, last (negative: from the end), step and flags are its table row's, null for unknown commands.

    Arguments that don't fit a command's form give no keys, except those whose place is fixed.
    """
    name, size = F.upper(F.get(args, F.lit(0))), F.size(args)
    lookup = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[name]
    place = lookup({c: at for c, (at, _) in NUMKEYS.items()})
    number = _count(args, place)
    fixed = F.when(name.isin(*[c for c, (_, before) in NUMKEYS.items() if before]), F.array(F.lit(1))).otherwise(_none())
    counted = F.when(place + number < size, F.concat(fixed, _run(place + 1, number))).otherwise(fixed)

    streams = _named(args, option_places(args, 1, STREAM_OPTIONS, END), "STREAMS")
    after = size - streams - 1
    of_streams = F.when(after % 2 == 0, _run(streams + 1, (after / 2).cast("int"))).otherwise(_none())

    def with_target(places: Column, *words: str) -> Column:
        target = _named(args, F.filter(places, lambda p: p + 1 < size), *words) + 1
        return F.when(size < 2, _none()).when(target.isNotNull(), F.array(F.lit(1), target)).otherwise(F.array(F.lit(1)))

    moved = _named(args, option_places(args, 6, MIGRATE_OPTIONS), "KEYS")
    single = F.get(args, F.lit(3)) != ""
    of_migrate = F.when(moved.isNull(), F.when(single, F.array(F.lit(3))).otherwise(_none())).when(single, _none()).otherwise(_run(moved + 1, size - moved - 1))
    pairs = _count(args, F.lit(1))
    of_pairs = F.when((pairs >= 1) & (pairs.cast("long") * 2 + 1 < size), F.sequence(F.lit(2), pairs * 2, F.lit(2))).otherwise(_none())
    end = F.least(F.when(last < 0, size + last).otherwise(last), size - 1)
    ranged = F.when((first > 0) & (end >= first) & ~F.contains(flags, F.lit("p")), F.sequence(first, end, F.greatest(step, F.lit(1)))).otherwise(_none())
    return (
        F.when(place.isNotNull(), counted)
        .when(name.isin("XREAD", "XREADGROUP"), of_streams)
        .when(name == "SORT", with_target(option_places(args, 2, SORT_OPTIONS), "STORE"))
        .when(name == "SORT_RO", F.when(size > 1, F.array(F.lit(1))).otherwise(_none()))
        .when(name.isin("GEORADIUS", "GEORADIUSBYMEMBER"), with_target(option_places(args, 5, RADIUS_OPTIONS), "STORE", "STOREDIST"))
        .when(name == "MIGRATE", of_migrate)
        .when(name == "CLUSTERSCAN", _none())
        .when(name == "MSETEX", of_pairs)
        .otherwise(ranged)
    )


def command_keys(args: Column, first: Column, last: Column, step: Column, flags: Column) -> Column:
    return F.transform(key_places(args, first, last, step, flags), lambda i: F.get(args, i))


def crosses_slots(keys: Column) -> Column:
    """Keys of one command in different hash slots, which a cluster refuses."""
    return F.size(F.array_distinct(F.transform(keys, key_slot))) > 1
