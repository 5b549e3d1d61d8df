"""Document fingerprints by winnowing, in DataFrame functions only.

The words of a text give rolling hashes of k words; from every window of w
hashes the smallest is kept, the rightmost of equal ones, with its position.
Any run of ``w + k - 1`` words that two texts share therefore leaves a hash in
both fingerprints.  A text need not have blanks: each character of a script
that is written without them is a word of its own, and so is each code point of
a run without blanks that is longer than ``MAX_WORD``.

A hash and its position are packed into one number, hash first and position
downwards, so that the smallest number of a window is the rightmost smallest
hash.  33 bits of hash and 30 of position hold every text a column can hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 3, 4
POSITION_BITS = 30
LAST = (1 << POSITION_BITS) - 1
HASHES = (1 << 33) - 1
#: Rows of an ordered chunk, about, and the number of chunks at most (beyond it chunks grow).
CHUNK_ROWS, MAX_CHUNKS = 2000, 2000
#: Code points of a word; a longer run without blanks is no word.
MAX_WORD = 32
#: Scripts written without blanks (Thai, Lao, Tibetan, Myanmar, Khmer, kana, bopomofo, Han, Yi).
UNSPACED = (
    r"([\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{1950}-\x{19DF}\x{1A20}-\x{1AAF}\x{3001}-\x{312F}"
    r"\x{31A0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}])"
)


def gram_keys(words: Column, k: int) -> Column:
    """Packed hash and position of every run of ``k`` words; of all words where there are fewer."""
    def packed(hashed: Column, at: Column) -> Column:
        return F.shiftleft(hashed.bitwiseAND(F.lit(HASHES)), POSITION_BITS) + (F.lit(LAST) - at)

    runs = F.arrays_zip(*[F.slice(words, 1 + i, F.greatest(F.size(words) - (k - 1), F.lit(0))) for i in range(k)])
    many = F.transform(runs, lambda r, at: packed(F.xxhash64(r), at))
    return F.when(F.size(words) >= k, many).otherwise(F.array(packed(F.xxhash64(words), F.lit(0))))


def winnow(keys: Column, w: int) -> Column:
    """The smallest key of every window of ``w`` keys, each once; of all keys where there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(keys) - (w - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda at: F.array_min(F.slice(keys, at, w))))


def with_fingerprint(df: DataFrame, text: str, column: str, k: int = K, w: int = W) -> DataFrame:
    """Add the fingerprint of a text as packed keys in order of position; null and blank texts have none."""
    words, keys = f"{column}__words", f"{column}__keys"
    spaced = F.regexp_replace(F.col(text), UNSPACED, " $1 ")
    points = F.flatten(F.transform(words, lambda x: F.when(F.length(x) > MAX_WORD, F.split(x, "")).otherwise(F.array(x))))
    return (
        df.withColumn(words, F.filter(F.split(spaced, r"[\x09-\x0D ]+"), lambda x: x != ""))
        .withColumn(words, F.when(F.exists(words, lambda x: F.length(x) > MAX_WORD), points).otherwise(F.col(words)))
        .withColumn(keys, gram_keys(F.col(words), k))
        .withColumn(column, F.when(F.size(words) > 0, winnow(F.col(keys), w)).otherwise(F.array().cast("array<bigint>")))
        .drop(words, keys)
    )


def hashes(fingerprint: str | Column) -> Column:
    return F.transform(fingerprint, lambda x: F.shiftright(x, POSITION_BITS))


def positions(fingerprint: str | Column) -> Column:
    """Positions of the kept hashes, counted in words."""
    return F.transform(fingerprint, lambda x: F.lit(LAST) - x.bitwiseAND(F.lit(LAST)))


def as_text(fingerprint: str | Column) -> Column:
    """Keys (hash and position in one number) in hexadecimal, joined by blanks."""
    return F.array_join(F.transform(fingerprint, lambda x: F.hex(x)), " ")


def likeness(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; 1 for two without any."""
    x, y = hashes(a), hashes(b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(df: DataFrame, order: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``next_<column>`` for every column of ``derive(df)`` from the row that follows by ``order``.

    The first row follows the last.  Rows are dealt into ordered chunks by
    quantiles of ``order``, shuffled once, and read on inside a chunk only; a
    chunk's last row takes the head of the next chunk from a table of one row
    per chunk.  Rows without an order value come first; rows with equal ones
    follow each other by content.
    """
    n = min(MAX_CHUNKS, max(1, df.count() // CHUNK_ROWS))
    at = [i / n for i in range(1, n)]
    cuts = sorted(set(df.stat.approxQuantile(order, at, 0.2 / n))) if at else []
    # The number of cuts at or below the value; -1 where there is none.
    below = F.expr(f"array_position(transform(array({', '.join(f'{c!r}D' for c in cuts)}), c -> c > `{order}`), true)") if cuts else F.lit(0)
    dealt = df.withColumns({
        "__chunk": F.when(F.col(order).isNull(), -1).when(below == 0, len(cuts)).otherwise(below - 1).cast("long"),
        "__tie": F.xxhash64(*df.columns),
    })
    # Rows are shuffled as they came; what is derived from them is computed where they arrive.
    made = derive(dealt.repartition("__chunk"))
    own = [c for c in made.columns if c not in ("__chunk", "__tie", order)]
    window = Window.partitionBy("__chunk").orderBy(order, "__tie")
    read_on = made.withColumn("__next", F.lead(F.struct(*own)).over(window))

    first = dealt.groupBy("__chunk").agg(F.min(F.struct(order, "__tie")).alias("__first"))
    # One row per chunk, MAX_CHUNKS + 1 at most.
    heads = dealt.join(F.broadcast(first), "__chunk").where(F.struct(order, "__tie").eqNullSafe(F.col("__first")))
    heads = derive(heads.drop("__first").dropDuplicates(["__chunk"])).select(F.col("__chunk").alias("__to"), F.struct(*own).alias("__head"))
    in_order = Window.orderBy("__chunk")
    following = first.select("__chunk", F.coalesce(
        F.lead("__chunk").over(in_order), F.first("__chunk").over(in_order)).alias("__to"))
    jumps = following.join(heads, "__to").select("__chunk", "__head")
    nxt = F.coalesce("__next", "__head")
    joined = read_on.join(jumps, "__chunk")
    return joined.withColumns({f"next_{c}": nxt[c] for c in own}).drop("__chunk", "__tie", "__next", "__head")


def edited(text: str, following: str) -> Column:
    """The text with its last quarter replaced by as much of the start of the following text."""
    return F.expr(
        f"concat(substring({text}, 1, cast(char_length({text}) - char_length({text}) div 4 as int)),"
        f" substring({following}, 1, cast(char_length({text}) div 4 as int)))"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness, and that to the next document.

    Null texts count as empty; an empty text's fingerprint is empty.  With one
    document the next document is itself.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    chained = with_next(docs.select("doc_id", body.alias("text")), "doc_id", lambda df: with_fingerprint(df, "text", "print"))
    changed = with_fingerprint(chained.withColumn("edit", edited("text", "next_text")), "edit", "edit_print")
    return changed.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        as_text("print").alias("fingerprint"), as_text("edit_print").alias("edited_fingerprint"),
        likeness("print", "edit_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"),
    )
