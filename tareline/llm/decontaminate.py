"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is the piece of documents a task holds at a time.  Its words become
numbers (0 for a word that no benchmark item has), and its suffix array lists
the places of whole suffixes, each up to the next such word, in order (by prefix
doubling).  Benchmark suffixes are found in it by binary search on their first
``WINDOW`` words, those only that begin with a word of the shard's suffixes.  A
place where the words before differ too begins a longest verbatim match; its
length is read off both suffixes.  Documents never meet each other, so nothing
is shuffled.

The benchmark reaches the tasks in blocks of a bounded number of words, one
after the other: the matches of a block are stored before the next one is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tareline.functions.nulls import quoted
from tareline.llm.batches import with_text_columns
from tareline.session import materialise

ROW_ID = "__row_id"
WINDOW = 10
#: A block of the benchmark has about this many words (one item at least).
BLOCK_WORDS = 1_000_000
#: Words of two suffixes compared at a time.
STEP = 32
#: Bytes of words: letters and digits (A-Z made lower case) and all of non-ASCII; others separate.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
MATCH_FIELDS = ("item_id", "start", "item_start", "length")
MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("item_start", T.LongType()),
    T.StructField("length", T.LongType()),
]))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs ``first[i] .. first[i] + count[i] - 1``: the index ``i`` of each element, and the element."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[run]


def search_keys(numbers: np.ndarray, place: np.ndarray, length: np.ndarray, window: int, fill: int) -> np.ndarray:
    """The first words at each place as one key that sorts like them, filled up where ``length`` is less than the window."""
    ahead = np.arange(window)
    rows = np.where(ahead < length[:, None], numbers[place[:, None] + ahead], fill).astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()


@dataclass
class Block:
    """Benchmark items as numbers: distinct windows in order, and where each stands."""

    vocabulary: dict[bytes, int]
    names: list[str | None]
    numbers: np.ndarray  # of the words of all items, a 0 before, between and after them
    starts: np.ndarray  # of items in numbers
    low: np.ndarray  # search keys of the distinct windows, lower and upper
    high: np.ndarray
    heads: np.ndarray  # where the windows that begin with word n start among them
    lengths: np.ndarray
    first: np.ndarray  # where a window's rows start in items / places
    items: np.ndarray
    places: np.ndarray  # in numbers
    shortest: int
    window: int


def make_block(rows: list[tuple[str | None, list[bytes]]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    sizes = np.array([len(item) for _, item in rows], int)
    starts = np.cumsum(sizes + 1) - sizes
    numbers = np.zeros(sizes.sum() + len(rows) + 1 + max(window, STEP), np.int64)
    for (_, item), at in zip(rows, starts):
        numbers[at : at + len(item)] = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in item]
    item, place = spread(starts, np.maximum(1, sizes - window + 1))
    length = np.minimum(window, sizes)[item]
    low, one, which = np.unique(search_keys(numbers, place, length, window, 0), return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    return Block(
        vocabulary, [n for n, _ in rows], numbers, starts, low, search_keys(numbers, place[one], length[one], window, 2**32 - 1),
        np.searchsorted(numbers[place[one]], np.arange(len(vocabulary) + 2)), length[one],
        np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(low)))]), item[order], place[order],
        int(length.min()) if len(length) else window, window,
    )


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark streamed to the driver, one block in memory at a time; items without words have no windows."""
    rows: list[tuple[str | None, list[bytes]]] = []
    size = 0
    picked = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`").cast("binary"))
    for name, body in picked.toLocalIterator():
        item = words(bytes(body) if body is not None else None)
        if item:
            rows.append((name, item))
            size += len(item)
        if size >= block_words:
            yield make_block(rows, window)
            rows, size = [], 0
    if rows:
        yield make_block(rows, window)


def suffix_array(numbers: np.ndarray, place: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The suffixes at ``place`` in order, as indices into it; a suffix has ``run`` words and all places of a run are given.

    Prefix doubling: ranks by the first n words give those by 2 n, until no more suffixes part.
    """
    rank, length, parted = numbers.copy(), 1, 0
    while True:
        ahead = np.where(run > length, rank[np.minimum(place + length, len(rank) - 1)], 0)
        pairs, which = np.unique(rank[place] * (rank.max(initial=0) + 1) + ahead, return_inverse=True)
        rank[place] = which + 1
        if len(pairs) == parted:
            return np.argsort(which, kind="stable")
        parted, length = len(pairs), 2 * length


def match_lengths(numbers: np.ndarray, at: np.ndarray, block: Block, there: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many words the suffixes ``at`` in the shard and ``there`` in the block have in common, ``known`` at least."""
    length, going, ahead = known.copy(), np.arange(len(at)), np.arange(STEP)
    while len(going):
        x, y = (at[going] + length[going])[:, None] + ahead, (there[going] + length[going])[:, None] + ahead
        ours, theirs = numbers[np.minimum(x, len(numbers) - 1)], block.numbers[np.minimum(y, len(block.numbers) - 1)]
        same = np.minimum.accumulate((ours == theirs) & (ours > 0), axis=1).sum(1)
        length[going] += same
        going = going[same == STEP]
    return length


def find(texts: list, block: Block) -> tuple[list[int], list[list[tuple]]]:
    """Number of words of each text, and its matches as (item, start, item start, length)."""
    split = [words(t) for t in texts]
    sizes = np.array([len(s) for s in split], int)
    starts = np.cumsum(sizes + 1) - sizes  # a 0 before and after each text ends its runs
    numbers = np.zeros(sizes.sum() + len(split) + 1 + block.window, np.int64)
    for s, at in zip(split, starts):
        numbers[at : at + len(s)] = np.fromiter(map(block.vocabulary.get, s, repeat(0)), np.int64, len(s))
    matches: list[list[tuple]] = [[] for _ in texts]
    ends, place = np.flatnonzero(numbers == 0), np.flatnonzero(numbers)
    end = np.searchsorted(ends, place)
    long = ends[end] - ends[end - 1] > block.shortest
    place, run = place[long], (ends[end] - place)[long]
    if not len(place) or not len(block.low):
        return sizes.tolist(), matches

    order = suffix_array(numbers, place, run)
    order = order[run[order] >= block.shortest]
    place, run = place[order], run[order]
    array = search_keys(numbers, place, run, block.window, 0)
    heads = np.unique(numbers[place])
    _, window = spread(block.heads[heads], block.heads[heads + 1] - block.heads[heads])
    first = np.searchsorted(array, block.low[window], "left")
    hit, slot = spread(first, np.maximum(np.searchsorted(array, block.high[window], "right") - first, 0))
    at, window = place[slot], window[hit]

    hit, row = spread(block.first[window], np.diff(block.first)[window])
    item, there, at, known = block.items[row], block.places[row], at[hit], block.lengths[window][hit]
    before, there_before = numbers[at - 1], block.numbers[there - 1]
    begins = (before != there_before) | (before == 0)
    item, there, at = item[begins], there[begins], at[begins]
    length = match_lengths(numbers, at, block, there, known[begins])
    doc = np.searchsorted(starts, at, "right") - 1
    by = np.lexsort((at, there, item))
    for d, i, a, j, n in zip(*(x[by].tolist() for x in (doc, item, at - starts[doc], there - block.starts[item], length))):
        matches[d].append((block.names[i], a, j, n))
    return sizes.tolist(), matches


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``n_words`` and ``matches``: the longest verbatim matches with benchmark items.

    A match is at least ``window`` words long, or the whole of a shorter item.
    Null and empty texts have no words; items without words match nothing; an
    item without an id matches under a null name.  Repeated rows are matched
    each on its own, columns called like the new ones are replaced; an empty
    benchmark matches nothing, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    passed = docs.columns if keep is None else keep
    kind = pa.list_(pa.struct([
        ("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64()),
    ]))

    def add(df: DataFrame, sent: Broadcast, through: list[str]) -> DataFrame:
        def make() -> Callable[[list], list[pa.Array]]:
            def compute(texts: list) -> list[pa.Array]:
                sizes, found = find(texts, sent.value)
                rows = [[dict(zip(MATCH_FIELDS, m)) for m in f] for f in found]
                return [pa.array(sizes, pa.int64()), pa.array(rows, kind)]

            return compute

        fields = [T.StructField("n_words", T.LongType()), T.StructField("matches", MATCH)]
        return with_text_columns(df, text, make, fields, through, as_bytes=True)

    rest = blocks(benchmark, item_id, item_text, window, block_words)
    block, stored = next(rest, make_block([], window)), []
    after = next(rest, None)
    if after:
        # Stored once, rows keep their numbers from block to block.
        docs = materialise(docs.select(F.monotonically_increasing_id().alias(ROW_ID), *map(quoted, {text: 0} | dict.fromkeys(passed))), "shard")
    while after:
        sent = spark.sparkContext.broadcast(block)
        stored.append(materialise(add(docs, sent, [ROW_ID]).where(F.size("matches") > 0).select(ROW_ID, "matches"), "matches"))
        sent.destroy()
        block, after = after, next(rest, None)
    found = add(docs, spark.sparkContext.broadcast(block), [*([ROW_ID] if stored else []), *passed])
    if stored:
        others = reduce(DataFrame.union, stored).groupBy(ROW_ID).agg(F.flatten(F.collect_list("matches")).alias("__others"))
        every = F.concat("matches", F.coalesce("__others", F.array().cast(MATCH)))
        found = found.join(others, ROW_ID, "left").withColumn("matches", every)
    made = {"n_words", "matches"}
    return found.select(*[F.col(f"`{c}`") for c in passed if c.lower() not in made], "n_words", "matches")


def covered(matches: str) -> F.Column:
    """Number of words inside any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["b"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"),
    ))["n"]


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words hit, and a digest of the items that occur in it."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", covered("matches").alias("n_hit"), names.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match, with the columns they came with.

    Null and empty texts stay, and so do repeated rows; an empty benchmark removes nothing.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text")
    found = with_matches(packed, benchmark, keep=["__doc"])
    return found.where(F.size("matches") == 0).select("__doc.*")
