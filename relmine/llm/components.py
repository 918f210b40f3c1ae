"""Lookups of groups of any size, connected components, and links inside
MinHash buckets without all pairs; DataFrames throughout."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmine.llm.common import written
from relmine.llm.minhash import THRESHOLD, confirmed

LARGEST_SHARE = 1024
PARITIES = 4  # 64-bit words of a set's parities
LEAST_FREQUENT = 8  # sets that a token is in, at least, to count as frequent


def looked_up(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Each row with its group's columns. Groups that hold at least one
    1024th of all ``total`` rows number at most 1024 and are broadcast; the
    others are joined and none of them is large."""
    least = -(-total // LARGEST_SHARE)
    large = F.broadcast(groups.filter(F.col(size) >= least))
    first = rows.join(large, on, "left")
    rest = first.filter(F.col(size).isNull()).select(*rows.columns).join(groups.filter(F.col(size) < least), on)
    return first.filter(F.col(size).isNotNull()).unionByName(rest)


def components(links: DataFrame, name: str) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in
    ``links`` (``a``, ``b``), by alternating large and small stars: each step
    hangs neighbours on the smallest one, until every component is a star.
    State is written to the shared folder after each step."""

    def measured(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(links.filter("a <> b").select(high, low).distinct(), name)
    seen = None
    while (now := measured(edges)) != seen and now[0]:
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.filter("a <> b").distinct(), name)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def rare_first(held: DataFrame, total: int) -> DataFrame:
    """Prefixes of full sets (``id``, ``c``, ``shingles``), rarest shingles
    first: ``token``, ``id``, ``c``, ``n`` (the set's size), ``at`` (the
    token's place) and the set's parities ``p0`` ... (each token flips one
    bit, so two sets differ in at least as many tokens as bits).

    A set of size n that is similar to another (t or more) shares a token
    with it among its first ``n - ceil(t * n) + 1``, in any order common to
    both. The order puts tokens of few sets first; those of at least one
    1024th of all sets, a list bounded by 1024 times the mean size, are sent
    to the tasks."""

    def tokens(batches):
        for batch in batches:
            for shingles in batch.column("shingles"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(shingles.as_buffer(), dtype="<i8"))], ["token"])

    least = max(LEAST_FREQUENT, total // LARGEST_SHARE)
    counts = held.select("shingles").mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") >= least).orderBy("token").toArrow()
    known = held.sparkSession.sparkContext.broadcast((frequent["token"].to_numpy(), frequent["n"].to_numpy()))
    kind = held.schema["id"].dataType.simpleString()
    parities = [f"p{i}" for i in range(PARITIES)]

    def prefixes(batches):
        often, sets = known.value
        for batch in batches:
            for i, shingles in enumerate(batch.column("shingles")):
                token = np.frombuffer(shingles.as_buffer(), dtype="<i8")
                n = len(token)
                seen = np.zeros(n, dtype=np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, token), len(often) - 1)
                    seen = np.where(often[at] == token, sets[at], 0)
                first = token[np.lexsort((token, seen))[: n + (-THRESHOLD * n // 100) + 1]]
                same = [pa.repeat(batch.column(c)[i], len(first)) for c in ("id", "c")]
                odd = np.bincount(token.view(np.uint64) % np.uint64(64 * PARITIES), minlength=64 * PARITIES) & 1
                words = np.packbits(odd.astype(np.uint8)).view("<i8")
                alone = [pa.repeat(pa.scalar(int(v), pa.int64()), len(first)) for v in (n, *words)]
                columns = [pa.array(first), *same, pa.array(np.arange(len(first))), *alone]
                yield pa.RecordBatch.from_arrays(columns, ["token", "id", "c", "at", "n", *parities])

    return held.select("id", "c", "shingles").mapInArrow(prefixes, f"token long, id {kind}, c {kind}, at long, n long, " + ", ".join(f"{p} long" for p in parities))


def across(prefixes: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of different components that may be similar: at
    their first common token, what follows in either still reaches the
    overlap that their sizes ask for. Each token's largest component is not
    compared with itself: one side of the join is all other rows."""
    parts = prefixes.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    rows = written(prefixes.join(main.select("token", "main"), "token"), "prefixes")
    x, y = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "token"]) for s in "xy")
    least = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    reach = least * (100 + THRESHOLD) >= (F.col("n_x") + F.col("n_y")) * THRESHOLD
    bits = sum(F.bit_count(F.col(f"p{i}_x").bitwiseXOR(F.col(f"p{i}_y"))) for i in range(PARITIES))
    reach &= bits * (100 + THRESHOLD) <= (F.col("n_x") + F.col("n_y")) * (100 - THRESHOLD)
    both = x.filter("c_x <> main_x").join(y, (x["token"] == y["token"]) & (F.col("c_x") != F.col("c_y")) & reach)
    return both.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()


def bucket_links(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], name: str, sketches: DataFrame | None = None, alike: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Links (``a``, ``b``) enough to give the components of all similar
    pairs within buckets. ``keys``: ``id``, ``key``; ``sets_of`` gives the
    full sets (``id``, ``shingles``) of the ids it gets.

    First every member is compared with its bucket's hub, the member that
    shares most buckets with most others (of many edited copies, the text
    they were made from); full sets confirm. Members that then are in one
    component need no comparison with each other. In buckets that still hold several components, pairs of
    different ones that share one of their rarest shingles are compared: no
    similar pair lacks such a shingle, and members that only have a frequent
    passage in common are not paired. ``sketches`` (``id``, ``sketch``) and
    ``alike`` drop pairs that are surely too far apart before their full sets
    are compared."""
    crowded = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
    members = written(keys.join(crowded.select("key", "n"), "key"), f"{name}-members")
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "id").groupBy("key").agg(F.max(F.struct("met", "id"))["id"].alias("hub"))
    sets = written(sets_of(members.select("id").distinct()), f"{name}-sets")

    def near(pairs: DataFrame) -> DataFrame:
        if sketches is None:
            return pairs
        a, b = (sketches.select(F.col("id").alias(s), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
        return pairs.join(a, "a").join(b, "b").filter(alike("sketch_a", "sketch_b")).select("a", "b")

    stars = members.join(hubs, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(confirmed(near(stars), sets), f"{name}-stars")
    found = components(links, f"{name}-round").withColumnRenamed("component", "c")
    left = members.filter("n > 2").join(found, "id", "left").withColumn("c", F.coalesce("c", "id"))
    several = left.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("key")
    left = left.join(several, "key", "left_semi").select("id", "c").distinct()
    held = written(left.join(sets, "id"), f"{name}-left")
    others = across(rare_first(held, held.count()))
    return links.unionByName(written(confirmed(near(others), sets), f"{name}-others"))
