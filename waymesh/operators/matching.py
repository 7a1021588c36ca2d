"""Stable matching by deferred acceptance, in rounds of joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def stable_matching(wishes: DataFrame) -> DataFrame:
    """Who is bound to whom when owners ask for places in the order of their wishes and a place keeps its best owner.

    ``wishes`` holds ``owner, place, wish, worth``: owners ask for the lowest ``wish`` first, places keep the lowest ``worth``; equal ones are decided by
    the smaller id. Returns ``owner, place, state`` for every wish: ``bound``, ``demoted`` (wanted more than what the owner got, but held by a better one) or ``not_asked``. No owner and
    place would both rather have each other than what they are bound to. In every round all free owners ask at once, so rounds grow with the longest chain of
    refusals, not with owners; refusals of one round are one join.
    """
    every = wishes.select("owner", "place", F.struct("wish", "place").alias("_wish"), F.struct("worth", "owner").alias("_worth")).distinct()
    left = cut(every)
    while True:
        # what an owner asks for now, given all refusals so far; places weigh all who ask
        asked = left.groupBy("owner").agg(F.min("_wish").alias("_wish")).join(left, ["owner", "_wish"])
        best = asked.groupBy("place").agg(F.min("_worth").alias("_best"))
        # a place that holds an owner refuses for good whoever is worth less to it, whether it has asked or will
        gone = cut(left.join(best, "place").where(F.col("_worth") > F.col("_best")).select("owner", "place"))
        if gone.isEmpty():
            break
        left = cut(left.join(gone, ["owner", "place"], "left_anti"))
    got = asked.select("owner", F.col("_wish").alias("_got"))
    state = F.when(F.col("_wish") == F.col("_got"), "bound").when(F.col("_got").isNull() | (F.col("_wish") < F.col("_got")), "demoted").otherwise("not_asked")
    return every.join(got, "owner", "left").select("owner", "place", state.alias("state"))
