"""Near duplicates by a chosen-path set similarity join.

A document is the set of hashes of its runs of four words, equal sets are one
*class*, and a signature holds the minwise tokens of the set under ``COORDINATES``
random orders.  A tree branches documents by the tokens of a few chosen orders:
documents with the same token of a chosen order meet in a child node.  A node
chooses one order, every fourth node two, so that the expected number of common
children of two sets of similarity 0.8 is one or more at every level, and a pair
is lost in one tree with a probability that grows slowly with the depth.
``TREES`` independent trees make losing a pair improbable (at most 1e-6 for a
pair whose nodes are small at the fourth level, 1e-13 at the first).

* Classes of a small node are compared with each other: sizes and two bits of
  every minwise token first, whole sets at last.
* In a large node each class is compared with the node's pivot, the class that
  meets most others, which ties near copies of one text together.  Then nodes
  whose classes are not all connected by now branch again, level by level.
* Near copies are not parted by branching: a large child that holds more than half
  of its parent, and what is large after ``DEPTH`` levels, branches no further.
  Its classes are joined exactly on the rarest elements of their sets.

Only connections matter: each class is verified against its nearest candidate
first, other pairs only if they are not connected by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tareline.llm.batches import with_text_columns
from tareline.llm.jaccard import LINK, apart, components, links_apart, shared_elements, verify
from tareline.session import materialise

WORDS = 4
COORDINATES, TREES, DEPTH = 64, 16, 4
#: Classes of a small node at most.
SMALL = 32
#: Pairs are verified if at most so many of the 64 pairs of token bits differ.  At similarity 0.8 each differs
#: with probability 0.15, so more than 26 differ with a probability of 3e-7.
MISMATCHES = 26
#: Orders chosen at the roots: one a tree, a second one for every fourth.
ROOTS = list(range(TREES + TREES // 4))


def odd_numbers(name: str, n: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{name} {i}".encode()).digest()[:8], "little") | 1 for i in range(n)], np.uint64)


RUN, ORDER = odd_numbers("run", WORDS), odd_numbers("order", COORDINATES)
MIX = odd_numbers("mix", 1)[0]
BLOCK = 4096


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the runs of four words; of all words where there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ids ^= ids >> np.uint64(32)
    last = max(0, len(ids) - WORDS)
    h = np.full(last + 1, min(len(ids), WORDS), np.uint64)
    for i, m in enumerate(RUN[: len(ids)]):
        h += ids[i : i + last + 1] * m
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def signature(items: np.ndarray) -> np.ndarray:
    """The set's minwise token under each order, as 32 bits; a block of elements at a time."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(items), BLOCK):
        part = items[start : start + BLOCK, None].view(np.uint64)
        least = np.minimum(least, (part * ORDER).min(0))
    return ((least ^ (least >> np.uint64(31))) * MIX >> np.uint64(32)).astype(np.uint32)


def bits_of(tokens: np.ndarray) -> list[int]:
    """Two bits of every token, in two whole numbers."""
    two = (tokens & 3).astype(np.uint64).reshape(2, 32) << (2 * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(two, axis=1).view(np.int64).tolist()


def signed(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, n, set_key, bits0, bits1, tokens`` of every row; stored, so that ``uid`` stays."""
    def make() -> Callable[[list], list[pa.Array]]:
        def compute(texts: list) -> list[pa.Array]:
            sets = [shingles(t) for t in texts]
            tokens = [signature(s) for s in sets]
            bits = [bits_of(t) for t in tokens]
            flat = np.concatenate([np.zeros(0, np.uint32), *tokens]).view(np.int32)
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                *(pa.array([b[i] for b in bits], pa.int64()) for i in (0, 1)),
                pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES, pa.array(flat)),
            ]

        return compute

    fields = [T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bits0", T.LongType()),
              T.StructField("bits1", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return materialise(with_text_columns(numbered, "text", make, fields, ["uid", "doc_id"], as_bytes=True), "signed")


def whole_sets(docs: DataFrame, signed_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, n, items`` of the named classes, taken from the rows that gave them their name."""
    def make() -> Callable[[list], list[pa.Array]]:
        def compute(texts: list) -> list[pa.Array]:
            sets = [shingles(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            return [pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, flat)]

        return compute

    wanted = signed_rows.select("uid", "doc_id", "set_key").join(ids.select(F.col("id").alias("uid")), "uid", "left_semi")
    wanted = wanted.select(F.col("uid").alias("id"), F.col("doc_id").alias("__doc"), F.col("set_key").alias("__set"))
    texts = docs.join(wanted.select("__doc").distinct(), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi").select("doc_id", "text")
    fields = [T.StructField("set_key", T.BinaryType()), T.StructField("n", T.LongType()),
              T.StructField("items", T.ArrayType(T.LongType()))]
    made = with_text_columns(texts, "text", make, fields, ["doc_id"], as_bytes=True)
    # A repeated id may stand for several texts: the set says which one is meant.
    met = made.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("set_key") == F.col("__set")))
    return met.select("id", "n", "items").dropDuplicates(["id"])


# -- nodes and candidates


def token_node(order: Column, tokens: Column, *path: Column) -> Column:
    """The child in which the documents with this token of this order meet."""
    return F.xxhash64(*path, order, F.get(tokens, order))


def differing(a: str, b: str) -> Column:
    """How many of the tokens' pairs of bits differ."""
    def of(name: str) -> Column:
        x = F.col(f"{name}_{a}").bitwiseXOR(F.col(f"{name}_{b}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return of("bits0") + of("bits1")


ABOUT = ["id", "n", "bits0", "bits1"]


def alike(a: str = "a", b: str = "b") -> Column:
    """Whether sizes and token bits leave it possible that two sets link."""
    x, y = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (x * 100 >= y * LINK) & (y * 100 >= x * LINK) & (differing(a, b) <= MISMATCHES)


def candidate(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), differing("a", "b").alias("far"))


def sides(rows: DataFrame, *more: str) -> list[DataFrame]:
    return [rows.select("node", *[F.col(c).alias(f"{c}_{s}") for c in [*ABOUT, *more]]) for s in "ab"]


def within_small(rows: DataFrame) -> DataFrame:
    """Candidates of the small nodes: pairs of classes that are not connected."""
    a, b = sides(rows.where(F.col("size") <= SMALL), "of")
    return candidate(a.join(b, "node").where((F.col("id_a") < F.col("id_b")) & (F.col("of_a") != F.col("of_b")) & alike()))


def around_pivots(rows: DataFrame) -> DataFrame:
    """Candidates of the large nodes: every class with the one that meets most others in all trees."""
    large = rows.where(F.col("size") > SMALL)
    rank = F.struct("weight", (-F.col("id")).alias("first"), *ABOUT)
    pivots = large.groupBy("node").agg(F.max(rank).alias("pivot"))
    pivots = pivots.select("node", *[F.col(f"pivot.{c}").alias(f"{c}_b") for c in ABOUT])
    return candidate(sides(large)[0].join(pivots, "node").where((F.col("id_a") != F.col("id_b")) & alike()))


def shared_nodes(rows: DataFrame) -> DataFrame:
    """``rows`` of nodes whose classes are not all connected, with the node's ``size``."""
    met = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("of").alias("x"), F.max("of").alias("y"))
    return rows.join(met.where("x <> y").select("node", "size"), "node")


def branched(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The children of ``rows`` by the orders that their nodes choose."""
    spread = len(ROOTS)
    first, second = (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(COORDINATES - spread)).cast("int") + spread for i in (1, 2))
    orders = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4)) == 0, F.array(first, second)).otherwise(F.array(first))
    child = token_node(F.col("order"), F.col("tokens"), F.col("node"))
    opened = rows.select("node", "id", "of", F.col("size").alias("parent")).join(classes, "id")
    opened = opened.select("*", F.explode(F.array_distinct(orders)).alias("order"))
    return opened.select(child.alias("node"), *ABOUT, "weight", "of", "parent")


# -- connecting


def nearest_first(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that connect what ``pairs`` connect, and their components; each class's nearest candidate is verified first."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "far"),
                                          F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "far"))).alias("x")).select("x.*")
    nearest = ends.groupBy("id").agg(F.min(F.struct("far", "other")).alias("m")).select(
        F.least("id", "m.other").alias("a"), F.greatest("id", "m.other").alias("b")).distinct()
    links = materialise(verify(nearest, sets), "links")
    links = materialise(links.union(verify(apart(pairs, components(links)), sets)), "links")
    return links, components(links)


def rest_pairs(sets: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of near copies, not yet connected, that share one of the rarest elements that a link needs."""
    one = F.lit(1).cast("long")
    rows = sets.repartition("id").select("id", "n", one.alias("last"), one.alias("weight"), F.explode("items").alias("h"))
    shared = materialise(shared_elements(rows), "rest_elements")
    own = Window.partitionBy("id")  # a document's own elements
    alone = F.col("n") - F.count("*").over(own)
    ranked = shared.select("id", "n", "h", alone.alias("alone"), F.row_number().over(own.orderBy("df", "h")).alias("rank"))
    place = (F.col("alone") + F.col("rank")).alias("place")
    prefix = ranked.select("id", "n", "alone", place, "h").where(F.col("place") <= F.floor(F.col("n") / 5) + 1)
    return links_apart(materialise(prefix, "rest_prefix"), found)


def linked(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, component`` of the classes that link with others."""
    roots = F.explode(F.array(*[F.lit(i) for i in ROOTS])).alias("order")
    top = classes.select("*", roots).select(token_node(F.col("order"), F.col("tokens")).alias("node"), *ABOUT, F.col("id").alias("of"))
    top = materialise(shared_nodes(top), "nodes")
    # How many others a class meets at the roots, once for all levels.
    weights = top.groupBy("id").agg(F.sum("size").alias("weight"))
    top = materialise(top.join(weights, "id"), "nodes")
    pairs = materialise(within_small(top).union(around_pivots(top)).distinct(), "pairs")
    sets = materialise(whole_sets(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    links, found = nearest_first(pairs, sets)

    of = found.select("id", F.col("component").alias("of"))
    large = top.where(F.col("size") > SMALL)
    classes = classes.join(large.select("id", "weight").distinct(), "id")
    level = large.select("node", "id").join(of, "id", "left").withColumn("of", F.coalesce("of", "id"))
    level = materialise(shared_nodes(level), "nodes")
    deeper, rest = [], []
    for _ in range(DEPTH):
        if level.isEmpty():
            break
        children = materialise(shared_nodes(branched(level, classes)), "nodes")
        deeper += [within_small(children), around_pivots(children)]
        large = children.where(F.col("size") > SMALL)
        rest.append(large.where(F.col("size") * 2 > F.col("parent")).select("id"))
        level = large.where(F.col("size") * 2 <= F.col("parent"))
    if not deeper:
        return found
    more = materialise(reduce(DataFrame.union, deeper).select("a", "b").distinct(), "pairs")
    left = materialise(reduce(DataFrame.union, [*rest, level.select("id")]).distinct(), "rest")
    ids = more.select(F.explode(F.array("a", "b")).alias("id")).union(left).distinct()
    sets = materialise(whole_sets(docs, rows, ids), "sets")
    exact = rest_pairs(sets.join(left, "id", "left_semi"), found)
    return components(materialise(links.union(verify(more.union(exact).distinct(), sets)), "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    Null texts and texts without words have an empty set, link with nothing and
    are their own component.  Rows with equal sets, repeated rows among them, are
    in one component, which is named by its smallest id; a row without an id takes
    its component's, if that has one.  ``kept`` is true where the row's id is the
    component's (null without an id).  Rows that repeat an id with another text
    are texts of their own.  Other columns play no part; an empty table gives no
    rows.
    """
    docs = docs.select("doc_id", "text")
    rows = signed(docs)
    grouped = rows.where("n > 0").groupBy("set_key", "n").agg(F.min("uid").alias("id"), F.min("doc_id").alias("smallest"))
    grouped = materialise(grouped, "classes")
    classes = rows.join(grouped.select(F.col("id").alias("uid")), "uid", "left_semi").select(
        F.col("uid").alias("id"), "n", "bits0", "bits1", "tokens")
    found = linked(docs, rows, classes)

    named = grouped.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = named.groupBy("component").agg(F.min("smallest").alias("name"))
    labels = named.join(names, "component").select("set_key", "n", "name")
    joined = rows.select("doc_id", "n", "set_key").join(labels, ["set_key", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         (F.col("doc_id") == component).alias("kept"))
