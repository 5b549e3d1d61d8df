"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of hashes of its runs of five words.  Ordered by hash, two
sets with a Jaccard similarity of 0.8 share an element among their first fifth
(the prefix).  Documents with equal prefix and size are one *group*; groups meet
on shared prefix elements; pairs of groups whose shared elements can't add up
are filtered out; the others are expanded to their members and verified on the
whole sets.

Three things keep this near linear:

* An element that more than ``HOT`` sets hold is never joined on.  Heads are a
  little longer than prefixes, so that a pair is lost only if both sides hold
  many hot elements.  Such sets (few) are joined again on *all* their elements;
  what is then still lost lies between sets that are hot for four fifths, the
  near copies of one text.  These are compared with the first of their bucket.
* Only connections matter.  Each set is verified against its first partner;
  other pairs are looked at only if they are not connected by then.
* Equal sets are one node from the start.

Hashes have 63 bits; a node is named by the smallest ``doc_id`` of its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tareline.llm.batches import with_text_columns
from tareline.session import materialise

WORDS = 5
#: Documents link when 100 * intersection >= 80 * union, that is 180 * intersection >= 80 * (sum of sizes).
LINK = 80
#: Elements of more sets than this are hot.
HOT = 50
#: Ids are broadcast up to this many (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Odd multipliers of the words of a run.
MULTIPLIERS = [np.uint64(int.from_bytes(hashlib.sha256(b"word %d" % i).digest()[:8], "little") | 1) for i in range(WORDS)]


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of all words where there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = max(0, len(ids) - WORDS)
    h = np.full(last + 1, min(len(ids), WORDS), np.uint64)
    for i, m in enumerate(MULTIPLIERS[: len(ids)]):
        h += (ids[i : i + last + 1] ^ (ids[i : i + last + 1] >> np.uint64(31))) * m
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def head_size(n: int | Column) -> int | Column:
    """Length of a head: the prefix (a fifth and one), and a little more to make up for hot elements."""
    if isinstance(n, int):
        return min(n, n // 5 + 1 + n // 40 + 8)
    return F.least(n, F.floor(n / 5) + 1 + F.floor(n / 40) + 8)


def least_shared(n: Column) -> Column:
    """Head elements that a set of this size shares at least with any set it links to and whose head ends later."""
    return head_size(n) - F.floor(n / 5)


def smaller(n: Column) -> Column:
    """Size of the smallest set that a set of this size can link to."""
    return F.ceil(n * LINK / 100)


def few(df: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def heads_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_key, group_key, head`` of every document."""
    def make() -> Callable[[list], list[pa.Array]]:
        def compute(texts: list) -> list[pa.Array]:
            sets = [shingle_set(t) for t in texts]
            heads = [s[: head_size(len(s))] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                pa.array([hashlib.md5(h.tobytes()).digest() for h in heads], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *heads]))),
            ]

        return compute

    fields = [T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()),
              T.StructField("group_key", T.BinaryType()), T.StructField("head", T.ArrayType(T.LongType()))]
    return with_text_columns(docs, "text", make, fields, ["doc_id"], as_bytes=True)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, n, items``: the whole sets of the named documents."""
    def make() -> Callable[[list], list[pa.Array]]:
        def compute(texts: list) -> list[pa.Array]:
            sets = [shingle_set(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            return [pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, flat)]

        return compute

    named = docs.select(F.col("doc_id").alias("id"), "text").join(few(ids), "id", "left_semi")
    fields = [T.StructField("n", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))]
    return with_text_columns(named, "text", make, fields, ["id"], as_bytes=True)


# -- candidates


def shared_elements(rows: DataFrame) -> DataFrame:
    """Of ``id, n, last, weight, h``: rows whose element others hold too, with ``df``, the sets that hold it."""
    counts = rows.groupBy("h").agg(F.sum("weight").alias("df"), F.count("*").alias("rows"))
    return rows.join(counts.where("rows > 1 OR df > 1").select("h", "df"), "h")


def meeting(shared: DataFrame, rest: Callable[[str], Column]) -> DataFrame:
    """Pairs that share an element that isn't hot and whose elements can still add up: ``a, b``.

    ``rest`` gives what a side may hold beyond the elements looked at.
    """
    light = shared.where(F.col("df") <= HOT).select("h", "id", "n", "last")
    a, b = (light.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "last")]) for s in "ab")
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * LINK) & (F.col("n_b") * 100 >= F.col("n_a") * LINK)
    met = a.join(b, "h").where((F.col("id_a") < F.col("id_b")) & sizes)
    counted = met.groupBy("id_a", "id_b", "n_a", "n_b", "last_a", "last_b").agg(F.count("*").alias("common"))
    hot = shared.where(F.col("df") > HOT).groupBy("id").agg(F.count("*").alias("hot"))
    for s in "ab":
        counted = counted.join(hot.select(F.col("id").alias(f"id_{s}"), F.col("hot").alias(f"hot_{s}")), f"id_{s}", "left")
    hidden = F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    beyond = F.when(F.col("last_a") <= F.col("last_b"), rest("n_a")).otherwise(rest("n_b"))
    most = F.least(F.col("common") + hidden + beyond, "n_a", "n_b")
    return counted.where(most * (100 + LINK) >= (F.col("n_a") + F.col("n_b")) * LINK).select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b")
    )


def hot_counts(shared: DataFrame) -> DataFrame:
    return shared.where(F.col("df") > HOT).groupBy("id", "n").agg(F.count("*").alias("hot"))


# -- verification and components


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, decided on the whole sets."""
    a, b = (sets.select(*[F.col(c).alias(x) for c, x in (("id", s), ("n", f"n_{s}"), ("items", f"items_{s}"))]) for s in "ab")
    both = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.join(b, "b").join(a, "a").where(both * (100 + LINK) >= (F.col("n_a") + F.col("n_b")) * LINK).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (its smallest id) of every node of an edge list, by alternating star contraction.

    Each round ties the larger neighbours of a node, then the smaller ones, to
    its smallest neighbour; rounds are logarithmic in number.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    for s in "ab":
        pairs = pairs.join(found.select(F.col("id").alias(s), F.col("component").alias(f"of_{s}")), s, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


# -- the join


def candidates(docs: DataFrame, heads: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of nodes that may link; of near copies that only hot elements tie together, a pair each and the prefix rows.

    ``heads`` as of `heads_of`; ``classes``: ``group_key, n, id`` of each node.
    """
    groups = classes.groupBy("group_key", "n").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    picked = heads.select(F.col("doc_id").alias("id"), "n", "group_key", "head").join(
        few(groups.select("id", "group_key", "weight")), ["id", "group_key"]
    )
    rows = picked.select("id", "n", F.element_at("head", -1).alias("last"), "weight", F.explode("head").alias("h"))
    shared = materialise(shared_elements(rows), "shared")
    met = meeting(shared, lambda n: F.col(n) - head_size(F.col(n)))

    # Expand group pairs to their members, and groups to the pairs inside them.
    member = classes.join(groups.select("group_key", F.col("id").alias("group"), "weight"), "group_key").select("group", "id", "weight")
    several = member.where((F.col("weight") > 1) & (F.col("weight") <= HOT)).select("group", "id")
    inside = several.withColumnRenamed("id", "a").join(several.withColumnRenamed("id", "b"), "group").where("a < b").select("a", "b")
    pairs = met
    for s in "ab":
        pairs = pairs.join(several.select(F.col("group").alias(s), F.col("id").alias("__id")), s, "left").withColumn(
            s, F.coalesce("__id", s)).drop("__id")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(inside)

    # Sets with many hot elements meet again on all of their elements.
    many = hot_counts(shared).where(F.col("hot") >= least_shared(smaller(F.col("n")))).select(F.col("id").alias("group"))
    again = materialise(sets_of(docs, member.join(many, "group", "left_semi").select("id").distinct()), "again")
    whole = again.repartition("id").select("id", "n", F.lit(0).cast("long").alias("last"), F.lit(1).cast("long").alias("weight"), F.explode("items").alias("h"))
    shared_again = materialise(shared_elements(whole), "shared_again")
    pairs = pairs.union(meeting(shared_again, lambda n: F.lit(0).cast("long")))

    # Near copies: hot for four fifths.  Their prefixes are taken in order of rarity, so that a passage that many
    # texts share comes last.  Each meets the set with the fewest elements of its own in its buckets here, which is
    # the nearest to what they were copied from, and others later if need be.
    copies = hot_counts(shared_again).where(F.col("hot") * 100 >= F.col("n") * LINK).select("id")
    own = Window.partitionBy("id")
    alone = F.col("n") - F.count("*").over(own)  # elements that nobody else holds come first
    ranked = shared_again.join(copies, "id", "left_semi").select(
        "id", "n", "h", alone.alias("alone"), F.row_number().over(own.orderBy("df", "h")).alias("rank")
    )
    place = (F.col("alone") + F.col("rank")).alias("place")
    prefix = ranked.select("id", "n", "alone", place, "h").where(F.col("place") <= F.floor(F.col("n") / 5) + 1)
    prefix = materialise(prefix, "prefix")
    best = prefix.groupBy("h").agg(F.min(F.struct("alone", "id")).alias("best"))
    stars = prefix.join(best, "h").groupBy("id").agg(F.min("best")["id"].alias("best")).where("id <> best").select(
        F.least("id", "best").alias("a"), F.greatest("id", "best").alias("b"))
    return pairs.distinct(), stars, prefix


def links_apart(prefix: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of near copies in one bucket that are not connected yet.

    The bucket's element must stand in the prefix that the two sizes ask for,
    which is shorter for sets of like size than the longest one stored.
    """
    placed = prefix.join(found, "id", "left").select("h", "id", "n", "place", F.coalesce("component", "id").alias("of"))
    a, b = (placed.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place", "of")]) for s in "ab")
    early = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    enough = early * (100 + LINK) >= (F.col("n_a") + F.col("n_b")) * LINK
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * LINK) & (F.col("n_b") * 100 >= F.col("n_a") * LINK)
    # A bucket that is all one component gives nothing, whatever its size.
    mixed = placed.groupBy("h").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select("h")
    met = a.join(mixed, "h", "left_semi").join(b, "h").where((F.col("id_a") < F.col("id_b")) & (F.col("of_a") != F.col("of_b")) & sizes & enough)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def similar(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``).

    Texts without words have an empty set, link with nothing and are their own
    component.  Rows that repeat an id are one document and share its links; a
    row without an id has none of its own but belongs to its equals' component.
    """
    docs = docs.select("doc_id", "text")
    heads = materialise(heads_of(docs), "heads")
    classes = materialise(
        heads.where("n > 0").groupBy("group_key", "set_key", "n").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"), "classes"
    )
    pairs, stars, prefix = candidates(docs, heads, classes)
    pairs, stars = materialise(pairs, "pairs"), materialise(stars, "stars")
    ends = pairs.union(stars).select(F.explode(F.array("a", "b")).alias("id")).union(prefix.select("id")).distinct()
    sets = materialise(sets_of(docs, ends), "sets")

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(stars).distinct()
    links = materialise(verify(first, sets), "links")
    for more in (lambda found: apart(pairs, found), lambda found: links_apart(prefix, found)):
        found = components(links)
        links = materialise(links.union(verify(more(found), sets)), "links")
    found = components(links)

    named = classes.join(found, "id", "left").select("set_key", "n", F.coalesce("component", "id").alias("component"))
    joined = heads.select("doc_id", "n", "set_key").join(named, ["set_key", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest id, with the columns it came with.

    Documents without words or without an id are kept as they are.  Of rows that
    repeat an id only one stays, the one of the smallest text (null before empty).
    """
    first = similar(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept"))
    keep = materialise(first.groupBy("__kept").agg(F.count(F.lit(1)).alias("__rows")), "kept")
    repeated = (F.col("__rows") > 1) & F.col("__kept").isNotNull()
    same = F.col("doc_id").eqNullSafe(F.col("__kept"))
    lone = docs.join(few(keep.where(~repeated).select("__kept")), same, "left_semi")
    again = docs.join(few(keep.where(repeated).select("__kept")), same, "left_semi")
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("text")).alias("__row")
    return lone.unionByName(again.groupBy(F.col("doc_id").alias("__kept")).agg(row).select("__row.*"))
