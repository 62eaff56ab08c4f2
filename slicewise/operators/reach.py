"""Everything that is reachable along keys, in as many rounds as the logarithm of the longest path.

Nodes are (tag, num, text): a table and a key value. Pairs (a node, what it points to) are doubled each round: after k rounds
a jump leads over 2 ** k pairs, and what is reached is all within fewer. A child has one parent for a
key, so a node has one jump, and a round is a join of narrow tables of bounded size: it shuffles the jumps
and what is reached once each, however many rounds went before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import freeze, sent_if_small

NODE = ("tag", "num", "text")
TO = tuple(f"to_{c}" for c in NODE)


def renamed(df: DataFrame, old: tuple[str, ...], new: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in zip(old, new, strict=True)])


def reached_from(start: DataFrame, pairs: DataFrame, ahead: bool, on_round: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
    """Nodes from which (or to which, with ``ahead``) jumps lead to (from) a start node; those of start included.

    ``start`` has columns NODE, ``pairs`` NODE and TO. Stops when a round finds nothing: what is k pairs away from the start
    is found in the round in which jumps lead over the largest power of two up to k, so there is nothing further
    then, also where paths run in circles. ``on_round`` is given each round's plans, for tests.
    """
    reached = freeze(start.select(*NODE).distinct(), "reached")
    jumps = freeze(pairs.select(*NODE, *TO).distinct(), "jumps")
    near, far = (NODE, TO) if ahead else (TO, NODE)
    while True:
        known, further = sent_if_small(reached), sent_if_small(jumps)
        found = jumps.join(renamed(known, NODE, near), list(near), "left_semi").select(*[F.col(c).alias(n) for c, n in zip(far, NODE, strict=True)]).distinct()
        new = found.join(known, list(NODE), "left_anti")
        middle = tuple(f"middle_{c}" for c in NODE)
        first = jumps.select(*NODE, *[F.col(c).alias(m) for c, m in zip(TO, middle, strict=True)])
        second = further.select(*[F.col(c).alias(m) for c, m in zip(NODE, middle, strict=True)], *TO)
        longer = first.join(second, list(middle)).select(*NODE, *TO).distinct()
        if on_round:
            on_round(new, longer)
        new = freeze(new, "reached")
        if new.isEmpty():
            return reached
        reached, jumps = freeze(reached.unionByName(new), "reached"), freeze(longer, "jumps")
