"""Cross-tokenizer alignment by inverted pair bitmaps.

A text is encoded by two tokenizers.  Tokens of both cover the same bytes; an
occurrence of a token of the one and of the other whose byte ranges overlap is a
*link*, and an id pair's count is the number of documents that hold it linked.

Counts come from an inverted index.  Documents are numbered inside *blocks* of
bounded text; for every id pair a block holds a compressed bitmap of the
documents that link it (positions of two bytes, or a bit set where that is
shorter), and one more bitmap, a *plane*, for each binary digit of the number of
links beyond the first.  Bitmaps of the pieces of a block are merged by OR.
Blocks have no document in common, so the bitmap of a pair over all documents is
the list of its blocks' bitmaps and its popcount is the sum of theirs.  With the
counts known, the postings return them: each block's bitmaps, joined with the
counts, add up to the scores of its documents.

Neither tokenizer's tokens reach from a character that is no white space to a
blank after it, so texts are cut there and each different piece of text is
encoded once, as long as a Python worker remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tareline.llm.batches import pieces, reach_library
from tareline.llm.bpe import self_of
from tareline.session import materialise

#: Between a character that is no white space and blanks that something follows.
CUT = re.compile(r"(?<=\S)(?= +[^ ])")
#: A block ends with so many documents or so many bytes of text (one text at least).
BLOCK_DOCS, BLOCK_BYTES = 1 << 15, 16 << 20
#: A worker forgets its pieces of text beyond so many bytes (strings and what is known of them).
MEMORY_BYTES = 160 << 20
#: Pieces of text that are encoded and aligned at a time.
LEARNT = 20_000
#: Plane 0 holds the documents, plane ``i`` the digit ``i - 1`` of the links beyond the first.
DOCUMENTS = 0

#: ``n_a``, ``n_b``, ``n_groups``, the groups as text, and the pair of every link.
Piece = tuple[int, int, int, bytes, list[int]]
#: The same of many texts (their links one after the other), and the number of links of each.
Told = tuple[Sequence[int], Sequence[int], Sequence[int], Sequence[bytes | None], Sequence[int], Sequence[int]]


class Tokenizers:
    """Two vocabularies: a byte-level one (A, a tokenizers file) and one with byte fallback (B, a sentencepiece model)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        by_letter = {self_of(b): b for b in range(256)}
        self.bytes_a = {i: bytes(map(by_letter.__getitem__, t)) if set(t) <= by_letter.keys() else t.encode()
                        for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_b = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = {i: len(t) for i, t in self.bytes_a.items()}, list(map(len, self.bytes_b))
        top = max(*self.bytes_a, len(self.bytes_b) - 1) + 1
        self.sizes_a = np.array([self.size_a.get(i, 0) for i in range(top)])
        self.sizes_b = np.array(self.size_b)
        #: An id with what follows it in the groups' text: one more of its side, the other side, the next group.
        self.said = [f"{i}{mark}".encode() for i in range(top) for mark in ",|;"]
        self.said_sizes = np.array(list(map(len, self.said)))

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both of texts that begin with a blank (B adds its own)."""
        for a, b in zip(self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1)):
            yield a.ids, b

    def align(self, text: str, a: list[int], b: list[int]) -> Piece | None:
        """What the tokens of a text tell; None where a side's bytes are not the text's."""
        whole = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        size_a, size_b = self.size_a, self.size_b
        links, groups, i, j, from_i, from_j, n = [], [], 0, 0, 0, 0, len(a)
        end_a, end_b = size_a[a[0]], size_b[b[0]]
        while True:  # the tokens at hand overlap; the one that ends first gives way to the next of its side
            links.append(a[i] << 32 | b[j])
            if end_a < end_b:
                i += 1
                end_a += size_a[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += size_b[b[j]]
            else:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}"
                              if i - from_i > 1 or j - from_j > 1 else f"{a[from_i]}|{b[from_j]}")
                if i == n:
                    break
                from_i, from_j = i, j
                end_a += size_a[a[i]]
                end_b += size_b[b[j]]
        return n, len(b), len(groups), ";".join(groups).encode(), links

    def align_all(self, texts: list[str], a: Sequence[list[int]], b: Sequence[list[int]]) -> Told:
        """``align`` of many texts, one after the other on one line of bytes."""
        whole = [t.encode() for t in texts]
        stops = np.cumsum(list(map(len, whole)))
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        line = b"".join(whole)
        if not (n_a.all() and n_b.all() and self.sizes_a[ids_a].all() and self.sizes_b[ids_b].all()
                and (ends_a[np.cumsum(n_a) - 1] == stops).all() and (ends_b[np.cumsum(n_b) - 1] == stops).all()
                and b"".join(map(self.bytes_a.__getitem__, flat_a)) == line and b"".join(map(self.bytes_b.__getitem__, flat_b)) == line):
            one = [self.align(*x) or (0, 0, 0, None, []) for x in zip(texts, a, b)]  # some text is not spelt
            *told, links = zip(*one)
            return *told, list(chain.from_iterable(links)), list(map(len, links))

        # A link reaches from one end of any token to the next, a group from one end of tokens of both to the next.
        ends = np.union1d(ends_a, ends_b)
        i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = ends[ends_a[i] == ends_b[j]]
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        to_a, to_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate([[0], to_b])[group_a]] = 3 * ids_a + (ends_a == both[group_a])
        order[np.arange(len(ids_b)) + to_a[group_b]] = 3 * ids_b + 2 * (ends_b == both[group_b])
        said = b"".join(map(self.said.__getitem__, order.tolist()))
        at = np.concatenate([[0], np.cumsum(self.said_sizes[order])[np.cumsum(n_a + n_b) - 1]]).tolist()
        groups = [said[x : y - 1] for x, y in zip(at, at[1:])]
        n_groups, held = (np.diff(np.searchsorted(x, stops, "right"), prepend=0) for x in (both, ends))
        return n_a, n_b, n_groups, groups, ids_a[i] << 32 | ids_b[j], held


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Both vocabularies, read once per Python worker."""
    return Tokenizers(path_a, path_b)


class Pieces:
    """What is known of the pieces of text met so far, by number; bounded in bytes."""

    def __init__(self, tokens: Tokenizers) -> None:
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # None: the tokens do not spell the piece
        self.sizes = [array("q") for _ in range(3)]
        self.links, self.starts = array("q"), array("q", [0])
        self.size = 0

    def learn(self, texts: set[str]) -> None:
        new = [t for t in texts if t not in self.number]
        for start in range(0, len(new), LEARNT):
            self.learn_some(new[start : start + LEARNT])

    def learn_some(self, new: list[str]) -> None:
        *sizes, groups, links, held = self.tokens.align_all(new, *zip(*self.tokens.encode(new)))
        self.number.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups += groups
        for column, more in zip([*self.sizes, self.links, self.starts], [*sizes, links, self.starts[-1] + np.cumsum(held)]):
            column.frombytes(np.asarray(more, np.int64).tobytes())
        self.size += 260 * len(new) + sum(map(len, new)) + sum(len(g or b"") for g in groups) + 8 * len(links)


@cache
def remembered(path_a: str, path_b: str) -> Pieces:
    """The pieces that a Python worker knows, which its next task goes on with."""
    return Pieces(tokenizers(path_a, path_b))


#: Of a document: ``n_a, n_b, n_groups, n_links, groups_sha256``.
Row = tuple[int, int, int, int, str]
NOTHING: Row = (0, 0, 0, 0, "")


def digest(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest()


class Block:
    """Documents of a block: their digests, and the bitmaps of their pairs in the making."""

    def __init__(self) -> None:
        self.rows: list = []
        self.digests: list[Row] = []
        self.bytes = 0
        #: Postings of the pieces of the block: pair, document and number of links.
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """OR of the bitmaps of all pieces, ordered by pair and document; links of a pair in a document add up."""
        pair, doc, links = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.postings) if self.postings else [()] * 3))
        order = np.lexsort((doc, pair))
        pair, doc, links = pair[order], doc[order], links[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])[: len(pair)])
        return pair[first], doc[first], np.add.reduceat(links, first) if len(first) else links

    def add(self, rows: list, texts: list[str | None], pieces: Pieces) -> None:
        """Encode documents and take them in."""
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        pieces.learn(set().union(*cut))
        numbers = [list(map(pieces.number.__getitem__, c)) for c in cut]
        texts_of = [list(map(pieces.groups.__getitem__, n)) for n in numbers]
        whole = {i: self.whole(texts[i], pieces) for i, known in enumerate(texts_of) if None in known}
        for i in whole:
            numbers[i] = []
        doc = np.repeat(np.arange(len(texts)), list(map(len, numbers)))
        flat = np.array([n for of in numbers for n in of], np.int64)
        starts, links = np.array(pieces.starts), np.array(pieces.links)
        held = np.diff(starts)
        told = [np.bincount(doc, column[flat], len(texts)).astype(np.int64) for column in [*map(np.array, pieces.sizes), held]]

        # A piece's links count once for each time that a document holds it.
        key, times = np.unique(doc << 32 | flat, return_counts=True)
        doc, flat = key >> 32, key & 0xFFFFFFFF
        spread = held[flat]
        at = np.arange(spread.sum()) + np.repeat(starts[flat] - np.cumsum(spread) + spread, spread)
        base = len(self.rows)
        self.postings.append((links[at], base + np.repeat(doc, spread), np.repeat(times, spread)))
        for i, row in enumerate(rows):
            found = whole.get(i)
            if found:
                *sizes, groups, pairs = found
                self.digests.append((*sizes, len(pairs), digest(groups)))
                self.postings.append((np.array(pairs, np.int64), np.full(len(pairs), base + i), np.ones(len(pairs), np.int64)))
            elif i in whole or not numbers[i]:
                self.digests.append(NOTHING)
            else:
                self.digests.append((*(int(t[i]) for t in told), digest(b";".join(texts_of[i]))))
            self.rows.append(row)
        self.bytes += sum(len(t or "") for t in texts)

    @staticmethod
    def whole(text: str, pieces: Pieces) -> Piece | None:
        """The alignment of a text in one, where the tokens do not spell a piece of it."""
        ((a, b),) = pieces.tokens.encode([" " + text])
        return pieces.tokens.align(" " + text, a, b)

    def bitmaps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """Plane, pairs, number of documents, bitmaps and whether they are bit sets, a plane at a time."""
        pair, doc, links = self.merged()
        beyond, plane = links - 1, DOCUMENTS
        chosen = np.ones(len(pair), bool)
        while len(pair):
            yield plane, *compressed(pair[chosen], doc[chosen], len(self.rows))
            if not (beyond >> plane).any():
                return
            chosen = (beyond >> plane & 1).astype(bool)
            plane += 1


def compressed(pair: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Bitmaps of the documents of each pair (rows ordered by pair and document)."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
    count = np.diff(np.concatenate([first, [len(pair)]]))
    flat = doc.astype("<u2").tobytes()
    width = -(-n_docs // 8)
    dense = count * 2 > width
    made = []
    for start, n, bits in zip(first.tolist(), count.tolist(), dense.tolist()):
        if bits:
            row = np.zeros(width * 8, np.uint8)
            row[doc[start : start + n]] = 1
            made.append(np.packbits(row, bitorder="little").tobytes())
        else:
            made.append(flat[2 * start : 2 * (start + n)])
    return pair[first], count, pa.array(made, pa.binary()), dense


def documents_of(bitmap: bytes, dense: bool) -> np.ndarray:
    """The documents of a bitmap."""
    if dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
    return np.frombuffer(bitmap, "<u2").astype(np.int64)


DIGESTS = ["n_a", "n_b", "n_groups", "n_links"]
POSTING = T.StructType([T.StructField("pair", T.LongType()), T.StructField("plane", T.IntegerType()),
                        T.StructField("bitmap", T.BinaryType()), T.StructField("dense", T.BooleanType())])


def indexed(docs: DataFrame, path_a: str, path_b: str, text: str, keep: list[str]) -> DataFrame:
    """Stored rows of two kinds: a document with its place and digests, or a pair's bitmap of one plane of a block."""
    reach_library(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("row", packed.schema["row"].dataType),
        *[T.StructField(n, T.LongType()) for n in DIGESTS], T.StructField("groups_sha256", T.StringType()), *POSTING,
    ])
    names, digests = schema.names, len(DIGESTS) + 1

    def made(block: Block, number: int, row_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        n = len(block.rows)
        if not n:
            return
        columns = list(zip(*block.digests))
        yield pa.RecordBatch.from_arrays([
            pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(block.rows, row_type),
            *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string()),
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], names=names)
        for plane, pair, _, bitmap, dense in block.bitmaps():
            for start in range(0, len(pair), 10_000):
                part = slice(start, start + 10_000)
                m = len(pair[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, row_type),
                    *[pa.nulls(m, pa.int64())] * (digests - 1), pa.nulls(m, pa.string()),
                    pa.array(pair[part]), pa.array([plane] * m, pa.int32()), bitmap[part], pa.array(dense[part])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, number = remembered(path_a, path_b), TaskContext.get().partitionId() << 32
        block, row_type = Block(), None
        for batch in batches:
            row_type = batch.column("row").type
            for part in pieces(batch, "__text"):
                if pieces_of.size > MEMORY_BYTES:
                    pieces_of.forget()
                block.add(part.column("row").to_pylist(), part.column("__text").to_pylist(), pieces_of)
                # A piece adds 512 documents at most, so places fit in two bytes.
                if len(block.rows) >= BLOCK_DOCS or block.bytes >= BLOCK_BYTES:
                    yield from made(block, number, row_type)
                    block, number = Block(), number + 1
        yield from made(block, number, row_type)

    return materialise(packed.mapInArrow(run, schema), "alignment")


def pair_counts(index: DataFrame) -> DataFrame:
    """``pair, a, documents, links``: documents by popcount, links by the popcounts of all planes."""
    held = F.when(F.col("dense"), F.expr("bitmap_count(bitmap)")).otherwise(F.floor(F.octet_length("bitmap") / 2)).cast("long")
    worth = F.when(F.col("plane") == DOCUMENTS, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    return index.where("pair IS NOT NULL").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == DOCUMENTS, held)).alias("documents"), F.sum(held * worth).alias("links"),
    ).withColumn("a", F.shiftright("pair", 32))


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """``block, place, n_best, count_sum``: what the postings of a block return to its documents."""
    best = counts.groupBy("a").agg(F.max("documents").alias("most"))
    known = counts.join(best, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
    # The counts may outgrow any broadcast: one way at every size.
    postings = index.where("pair IS NOT NULL").select("block", "pair", "plane", "bitmap", "dense").join(known.hint("merge"), "pair")

    def returned(group: pa.Table) -> pa.Table:
        best_links, total = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for batch in group.select(["plane", "bitmap", "dense", "documents", "best"]).to_batches():
            for plane, bitmap, dense, documents, is_best in zip(*(c.to_pylist() for c in batch.columns)):
                at, worth = documents_of(bitmap, dense), 1 << max(0, plane - 1)
                total[at] += documents * worth
                if is_best:
                    best_links[at] += worth
        place = np.flatnonzero(total)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * len(place), pa.int64()),
                         "place": pa.array(place, pa.int32()), "n_best": best_links[place], "count_sum": total[place]})

    slim = postings.select("block", "plane", "bitmap", "dense", "documents", "best")
    return slim.groupBy("block").applyInArrow(returned, "block long, place int, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` to every row.

    A and B encode a blank and the whole text without special tokens.  Byte
    offsets at which tokens of both end cut them into groups, given as
    ``a1,a2|b1;a3|b2,b3``.  ``n_best`` counts the links whose pair is held by as many
    documents as any pair of its A id, ``count_sum`` adds up the pairs' counts.
    Null and empty texts, and texts that one side's tokens don't spell exactly,
    have no tokens: zeros and an empty digest.  Every row is a document, repeated
    rows too.  ``keep`` names the columns that pass through (all by default).
    """
    keep = docs.columns if keep is None else keep
    index = indexed(docs, path_a, path_b, text, keep)
    counts = materialise(pair_counts(index), "pair_counts")
    told = scores(index, counts)
    rows = index.where("place IS NOT NULL").select("block", "place", "row", *DIGESTS, "groups_sha256")
    full = rows.join(told, ["block", "place"], "left").na.fill(0, ["n_best", "count_sum"])
    return full.select("row.*", *DIGESTS, "n_best", "count_sum", "groups_sha256")
