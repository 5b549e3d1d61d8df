"""WARC records and a Merkle audit of their fixity.

Pages become WARC records in files of a bounded number of records, each at an
offset.  Over the records of a file, in order of offset, stands a tree: a leaf
is the digest of a record, an inner node the digest of up to ``FANOUT``
children and of the offset range they cover; the files' roots are the leaves of
one more tree.  To audit a replica, roots are compared first and only the
children of nodes that differ are looked at on the next level down, so sound
parts cost one comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tareline.session import materialise

FANOUT = 16
RECORDS_PER_FILE = 1024
#: Levels above the leaves of a file: FANOUT ** LEVELS records at least.
LEVELS = 3


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """``page_id, file, number, offset, length, record`` of each page as a WARC resource record.

    A page's file follows from its content, so equal pages sit side by side;
    inside a file records are ordered by id and content.  Null fields are
    written as empty ones.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    files = max(1, -(-pages.count() // per_file))
    key = F.xxhash64(page_id, url, F.md5(body))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(page_id).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    made = pages.select(F.col(page_id).alias("page_id"), F.pmod(key, F.lit(files)).alias("file"), record.alias("record"), key.alias("__key"))
    order = Window.partitionBy("file").orderBy("page_id", "__key")
    length = F.octet_length("record").cast("long")
    return made.withColumn("length", length).select(
        "page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("number"),
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        "length", "record",
    )


def stored_records(pages: DataFrame) -> DataFrame:
    """The records written once to the shared folder, so that offsets are the same whenever they are read."""
    return materialise(records(pages), "warc")


def leaves(recs: DataFrame) -> DataFrame:
    """Node of each record: its digest and the range of bytes it covers."""
    return recs.select(
        "file", F.lit(0).alias("level"), F.col("number").alias("node"),
        F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"),
        F.sha2("record", 256).alias("digest"),
    )


def joined_digest() -> list[Column]:
    """One digest over children in order, bound to the offset range they cover."""
    children = F.array_sort(F.collect_list(F.struct("node", "first", "last", "digest")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["first"], c["last"], c["digest"])), ",")
    return [F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(text.cast("binary"), 256).alias("digest")]


def tree(recs: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes of every file by level, leaves first; the last level holds the roots of the files.

    A node has at most ``FANOUT`` children; only the top level may have more, and
    a file never has more than its records.
    """
    made = [materialise(leaves(recs), "leaves")]
    for level in range(1, levels + 1):
        parent = F.floor(F.col("node") / FANOUT) if level < levels else F.lit(0).cast("long")
        up = made[-1].withColumn("__parent", parent).groupBy("file", "__parent").agg(*joined_digest())
        made.append(up.select("file", F.lit(level).alias("level"), F.col("__parent").alias("node"), "first", "last", "digest"))
    return made[:1] + [materialise(x, "tree") for x in made[1:]]


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes that are missing on a side or differ in digest or range."""
    a, b = ours.alias("a"), theirs.alias("b")
    same = (F.col("a.file") == F.col("b.file")) & (F.col("a.node") == F.col("b.node"))
    return a.join(b, same, "full_outer").where(
        ~(F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.first").eqNullSafe(F.col("b.first")))
    ).select(
        F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.node", "b.node").alias("node"),
        F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"),
    )


def corrupted(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaves that differ between two trees: ``file, node, expected, found``.

    Starts from the roots of the stores; on the next level, of the stores as of
    their files, only children of differing nodes are compared.
    """
    levels = store_levels(ours, theirs)
    a, b = store_tree(ours, levels), store_tree(theirs, levels)
    odd = materialise(differing(a[-1], b[-1]), "odd")
    for level in reversed(range(levels)):
        odd = differing(*below(odd, F.floor(F.col("node") / FANOUT), a[level], b[level]))
    # Stored, the differing files have a known size: a few filter the records without a shuffle.
    odd = materialise(odd.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("node"), "expected", "found"), "odd")
    for level in reversed(range(len(ours) - 1)):
        parent = F.lit(0).cast("long") if level == len(ours) - 2 else F.floor(F.col("node") / FANOUT)
        odd = differing(*below(odd, parent, ours[level], theirs[level]))
    return odd


def below(odd: DataFrame, parent: Column, *sides: DataFrame) -> list[DataFrame]:
    """The nodes of each side whose parent differs."""
    suspects = odd.select("file", F.col("node").alias("__parent"))
    return [nodes.withColumn("__parent", parent).join(suspects, ["file", "__parent"], "left_semi") for nodes in sides]


def file_roots(nodes: list[DataFrame]) -> DataFrame:
    return nodes[-1].select("file", "digest")


def store_levels(*stores: list[DataFrame]) -> int:
    """Levels over the files up to one root, enough for each of the stores."""
    last = max([r[0] for s in stores for r in s[-1].select(F.max("file")).collect() if r[0] is not None], default=0)
    levels = 1
    while last >= FANOUT**levels:
        levels += 1
    return levels


def store_tree(nodes: list[DataFrame], levels: int) -> list[DataFrame]:
    """Nodes over the files by level, the files' roots first and the store's root last; ``file`` is 0 in all of them."""
    made = [nodes[-1].select(F.lit(0).cast("long").alias("file"), F.lit(0).alias("level"), F.col("file").cast("long").alias("node"),
                             "first", "last", "digest")]
    for level in range(1, levels + 1):
        up = made[-1].withColumn("__parent", F.floor(F.col("node") / FANOUT)).groupBy("file", "__parent").agg(*joined_digest())
        up = up.select("file", F.lit(level).alias("level"), F.col("__parent").alias("node"), "first", "last", "digest")
        made.append(materialise(up, "store"))
    return made


def store_root(nodes: list[DataFrame]) -> str | None:
    """Root over all files, from levels of at most ``FANOUT`` children; None for an empty store."""
    row = store_tree(nodes, store_levels(nodes))[-1].first()
    return row["digest"] if row else None


def audit(ours: DataFrame, theirs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every record of ours with ``sound``: whether the replica holds the same bytes at the same place.

    ``ours`` and ``theirs`` have the columns of `records`.  Records that only the
    replica holds come with a null id.
    """
    mine, other = tree(ours, levels), tree(theirs, levels)
    odd = corrupted(mine, other).select("file", F.col("node").alias("number"), "found", F.lit(True).alias("__odd"))
    listed = ours.select("page_id", "file", "number", "offset", "length").join(
        mine[0].select("file", F.col("node").alias("number"), F.col("digest").alias("sha256")), ["file", "number"]
    )
    return listed.join(odd, ["file", "number"], "full_outer").select(
        "page_id", "file", "number", "offset", "length", "sha256",
        F.when(F.col("__odd"), F.col("found")).otherwise(F.col("sha256")).alias("replica_sha256"),
        F.col("__odd").isNull().alias("sound"),
    )


def damaged(recs: DataFrame, one_in: int) -> DataFrame:
    """A replica of records in which one byte of about one record in ``one_in`` is changed, chosen by the id."""
    chosen = F.pmod(F.xxhash64("page_id", F.lit("damage")), F.lit(one_in)) == 0
    at = F.floor(F.col("length") / 2).cast("int")
    rest = F.expr("substring(record, cast(length div 2 as int) + 2, 2147483647)")
    byte = F.when(F.expr("substring(record, cast(length div 2 as int) + 1, 1)") == F.lit("x").cast("binary"), F.lit("y")).otherwise(F.lit("x"))
    changed = F.concat(F.expr("substring(record, 1, cast(length div 2 as int))"), byte.cast("binary"), rest)
    return recs.withColumn("record", F.when(chosen & (at >= 0), changed).otherwise(F.col("record")))
