"""Identity resolution: patient hits to persons, in the order of files and places."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join


def fold(rows: pd.DataFrame, run: str) -> pd.DataFrame:
    """Persons of one component's hits (hit, ids, linked, name_person), in hit order.

    An id linked before, or claimed by an earlier hit, gives its person (verified); two persons are a conflict. Else the one
    person of the same name (unverified), else a new one. Only hits without a linked id claim their ids.
    """
    claimed: dict[str, str] = {}
    out = []
    for r in rows.sort_values("hit").itertuples():
        known = dict(zip(r.ids, r.linked))
        persons = {p for i in r.ids if (p := claimed.get(i) or known[i])}
        if len(persons) > 1:
            out.append((r.hit, None, "conflict"))
            continue
        if persons:
            out.append((r.hit, persons.pop(), "verified"))
            continue
        person = r.name_person or hashlib.sha256(f"{run}:{r.hit}".encode()).hexdigest()[:32]
        out.append((r.hit, person, "unverified" if r.name_person else "new"))
        for i in r.ids:
            claimed.setdefault(i, person)
    return pd.DataFrame(out, columns=["hit", "person_key", "state"])


def claiming(left: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(hit): open hits of left (hit, id) that are sure to claim their ids.

    A hit without an earlier one at any of its ids claims. A hit with exactly one earlier one claims if that one does not, so
    along a chain of such hits claims alternate: each hit points at the end of its chain by pointer doubling, with the parity
    of the way, and claims if the way is even and the chain ends at a hit that claims. Chains that end at a hit with several
    earlier ones stay open.
    """
    total = left.count()
    firsts = left.groupBy("id").agg(F.min("hit").alias("first"))
    met = spread_join(left, firsts, ["id"], F.col("hit"), total)
    seconds = met.where("hit > first").groupBy("id").agg(F.min("hit").alias("second"))
    near = spread_join(met, seconds, ["id"], F.col("hit"), total, how="left")
    before = F.when(F.col("hit") > F.col("first"), F.col("first"))
    third = F.coalesce(F.col("hit") > F.col("second"), F.lit(False))
    hits = keep(near.groupBy("hit").agg(F.min(before).alias("to"), F.max(before).alias("most"), F.max(third).alias("several")))
    points = hits.where("to = most and not several").select("hit", "to", F.lit(True).alias("odd"), F.lit(False).alias("done"))
    while count := points.where("not done").count():
        further = points.select(F.col("hit").alias("to"), F.col("to").alias("next"), F.col("odd").alias("flip"), F.col("done").alias("last"))
        stepped = spread_join(points.where("not done"), further, ["to"], F.col("hit"), count, how="left")
        odd = F.col("odd") != F.coalesce("flip", F.lit(False))
        stepped = stepped.select("hit", F.coalesce("next", "to").alias("to"), odd.alias("odd"), F.coalesce("last", F.lit(True)).alias("done"))
        points = keep(points.where("done").unionByName(stepped))
    free = hits.where("to is null").select("hit")
    even = points.where("not odd").join(free.withColumnRenamed("hit", "to"), "to", "left_semi").select("hit")
    return free.unionByName(even)


def settled(ids: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(hit, id) of the hits that claim their ids, of ids (hit, id) of the hits without a linked id.

    A hit claims its ids unless an earlier one has claimed any of them. A round settles all hits that are sure to claim
    (claiming()) and all that share an id with them; its tables are written. A chain of hits of which each waits for the one
    before takes as many steps as its length has binary digits; rounds follow the longest run of hits that wait for several.
    """
    claims, left = None, keep(ids.distinct())
    while not left.isEmpty():
        new = keep(left.join(claiming(left, keep), "hit", "left_semi").select("hit", "id"))
        claims = new if claims is None else claims.unionByName(new)
        gone = left.join(new.select("id"), "id", "left_semi").select("hit").distinct()
        left = keep(left.join(gone, "hit", "left_anti").select("hit", "id"))
    return left if claims is None else claims


def assign_persons(hits: DataFrame, links: DataFrame, names: DataFrame, run: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(hit, person_key, state) for hits (hit long, ids array<string>, name string), as fold() states it.

    links (id, person) and names (name, person) are what is known before the run. Which hits claim their ids is found in
    rounds over all hits (settled()); every other hit then meets the persons of its ids by a join, so no task holds the
    hits of a component.
    """
    ids = keep(hits.select("hit", F.explode("ids").alias("id")).distinct())
    linked = ids.join(links.where("person <> ''"), "id").select("hit", "person")
    claims = settled(ids.join(linked.select("hit").distinct(), "hit", "left_anti"), keep)
    unique = hits.groupBy("name").agg(F.count("*").alias("n"), F.min("hit").alias("hit")).where("n = 1")
    single = names.groupBy("name").agg(F.count_distinct("person").alias("p"), F.min("person").alias("name_person")).where("p = 1 and name_person <> ''")
    named = unique.join(single, "name").select("hit", "name_person")
    new = F.substring(F.sha2(F.concat(F.lit(f"{run}:"), F.col("hit").cast("string")).cast("binary"), 256), 1, 32)
    own = hits.select("hit").join(named, "hit", "left").select("hit", F.coalesce("name_person", new).alias("own"), F.when(F.col("name_person").isNull(), "new").otherwise("unverified").alias("own_state"))
    claimed = claims.join(own, "hit").select("id", F.col("hit").alias("by"), F.col("own").alias("person"))
    met = ids.join(claimed, "id").where("by < hit").select("hit", "person").unionByName(linked)
    found = met.groupBy("hit").agg(F.min("person").alias("least"), F.max("person").alias("most"))
    rows = own.join(found, "hit", "left")
    several = F.col("least") < F.col("most")
    return rows.select(
        "hit",
        F.when(F.col("least").isNull(), F.col("own")).when(~several, F.col("least")).alias("person_key"),
        F.when(F.col("least").isNull(), F.col("own_state")).when(several, "conflict").otherwise("verified").alias("state"),
    )
