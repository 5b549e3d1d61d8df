"""BPE encoding and decoding by a prefix-sharing trie of distinct words.

A vocabulary with word ends is a BPE over an alphabet in which the last symbol
of a word is marked.  The encoding of a prefix of a word is then determined by
its *last token* alone: dropping it leaves the encoding of a shorter prefix,
and it must be compatible with that prefix's own last token.  Distinct words
form a trie; a depth-first walk computes the last token of each
node once, however many words share it, and a word's ids are read back along
the path.

Tokens ``a, b`` are compatible if no merge ever joins them: until one does,
each side grows as it would alone, so it is enough to follow the part of ``a``
at the border and the part of ``b`` at the border through the ranks and ask
whether a rule for the two comes before either part is used up.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tokenizers import Tokenizer

from tareline.llm.batches import with_text_columns

END = "</w>"
#: Python takes the four ASCII separators for blanks, the vocabularies do not.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile(r"(?:[^\S\x1c-\x1f])+")
#: Bounds on what a Python worker remembers: letters of runs (longer ones than LONG are coded each time), token pairs, and steps.
MAX_LETTERS, LONG, MAX_PAIRS, MAX_STEPS = 4_000_000, 64, 400_000, 200_000

#: A token, its length and its packed id.
Entry = tuple[str, int, bytes]
#: The longest end of a prefix that begins a token; the tokens that end there, longest first: inside a word, at its end.
State = tuple[str, list[Entry], list[Entry]]

#: Latin letters that no rule changes but for their case, and one mark.
LATIN = re.compile(r"([a-zA-ZÀ-ÖØ-Þß-öø-ÿ]+)([.,;:!?]?)")
MARKS = frozenset(".,;:!?")


def self_of(byte: int) -> str:
    """The printable letter that stands for a byte in a byte-level vocabulary: itself, or the next free one from 256."""
    def prints(b: int) -> bool:
        return 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255

    return chr(byte) if prints(byte) else chr(256 + sum(not prints(b) for b in range(byte)))


class Bpe:
    """One vocabulary file: ``encode`` texts to packed ids.

    Normalisation and the split into words (in byte letters) are the rules that
    the file states, applied by the tokenizers library; no rule reaches across
    a blank, so runs between blanks are looked up as a whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        packed = {t: np.array([i], "<u4").tobytes() for t, i in model["vocab"].items()}
        self.inner = {t: i for t, i in packed.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in packed.items() if t.endswith(END)}
        by_byte = {b: self_of(b) for b in range(256)}
        self.letters = {c: "".join(by_byte[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.ranks, self.made = {}, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[a, b] = rank
            self.made[a + b] = rank, (a, b)
        self.lefts: dict[str, list[tuple[str, int]]] = {}
        self.rights: dict[str, list[tuple[str, int]]] = {}
        self.begins = {t[:n] for of in (self.inner, self.final) for t in of for n in range(len(t) + 1)}
        self.states: dict[str, State] = {}
        self.steps: dict[str, State] = {}
        rules = Tokenizer.from_file(path)
        self.normalise = rules.normalizer.normalize_str
        self.pre_tokens = rules.pre_tokenizer.pre_tokenize_str
        self.specials = re.compile("|".join(map(re.escape, self.added)))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.final_pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.letters_kept = 0

    # -- compatibility

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """Parts of a token at its right (1) or left (0) border, each with the rank that uses it up."""
        chain, used = [], len(self.made)
        while True:
            chain.append((token, used))
            if token not in self.made:
                return chain
            used, parts = self.made[token]
            token = parts[side]

    def remember(self, pairs: dict[tuple[str, str], bool], before: str, key: str, token: str) -> bool:
        if len(pairs) >= MAX_PAIRS:
            pairs.clear()
        apart = pairs[before, key] = self.stay_apart(before, token)
        return apart

    def stay_apart(self, before: str, token: str) -> bool:
        if not before:
            return True
        lefts = self.lefts.get(token) or self.lefts.setdefault(token, self.edge(token, 0))
        for x, x_used in self.rights.get(before) or self.rights.setdefault(before, self.edge(before, 1)):
            for y, y_used in lefts:
                rank = self.ranks.get((x, y))
                # Of equal rules the leftmost is applied first.
                if rank is not None and rank < x_used and rank <= y_used:
                    return False
        return True

    # -- the trie

    def step(self, text: str) -> State:
        """The longest end of ``text`` that begins a token, with the tokens that end there."""
        if len(self.steps) >= MAX_STEPS:
            self.steps.clear()
        state = text
        while state not in self.begins:
            state = state[1:]
        found = self.states.get(state)
        if found is None:
            ends = [state[i:] for i in range(len(state))]
            found = self.states[state] = (state, *([(t, len(t), of[t]) for t in ends if t in of] for of in (self.inner, self.final)))
        self.steps[text] = found
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct words (in byte letters), given in order.

        Words in order are their trie in depth-first order: what a word shares
        with the one before is the path from the root to where they part.  The
        stacks hold what is known of the prefixes along the present path (the
        longest end that begins a token, the last token, the packed ids), so a
        shared prefix is computed once.
        """
        found: dict[str, bytes] = {}
        states, last, ids, before = [""], [""], [b""], ""
        known, pairs, final_pairs = self.steps.get, self.pairs, self.final_pairs
        for word in words:
            size = len(word)
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            end = min(shared, size - 1, len(states) - 1)  # of a whole word no last token inside a word is known
            del states[end + 1 :], last[end + 1 :], ids[end + 1 :]
            state = states[end]
            while (end := end + 1) < size:
                text = state + word[end - 1]
                state, tokens, _ = known(text) or self.step(text)
                for token, length, code in tokens:
                    key = last[end - length], token
                    apart = pairs.get(key)
                    if apart if apart is not None else self.remember(pairs, *key, token):
                        break
                else:
                    raise ValueError(f"the vocabulary has no token for {word[:end]!r}")
                states.append(state)
                last.append(token)
                ids.append(ids[end - length] + code)
            text = state + word[-1]
            for stem, length, code in (known(text) or self.step(text))[2]:
                key = last[size - length], stem
                apart = final_pairs.get(key)
                if apart if apart is not None else self.remember(final_pairs, *key, stem + END):
                    break
            else:
                raise ValueError(f"the vocabulary has no last token for {word!r}")
            found[word], before = ids[size - length] + code, word
        return found

    # -- texts

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks (runs without blanks) not seen before."""
        split = {c: self.words(c) for c in chunks if c not in self.added}
        coded = self.encode_words(sorted({w for parts in split.values() for w in parts}))
        found = {c: b"".join([coded[w] for w in parts]) if len(parts) > 1 else coded[parts[0]] if parts else b""
                 for c, parts in split.items()}
        return found | {c: self.added[c] for c in chunks if c in self.added}

    def words(self, run: str) -> list[str]:
        """The rules' words of a run; Latin letters are one word under them, and so is a mark after it."""
        if run.isascii():
            if run.isalpha():
                return [run.lower()]
            if run[-1:] in MARKS and run[:-1].isalpha():
                return [run[:-1].lower(), run[-1]]
        plain = LATIN.fullmatch(run)
        if plain:
            letters = plain[1].lower()
            letters = letters if letters.isascii() else letters.translate(self.letters)
            return [letters, plain[2]] if plain[2] else [letters]
        return [w for w, _ in self.pre_tokens(self.normalise(run))]

    def runs(self, text: str | None) -> list[str]:
        """The text as runs between blanks, special tokens on their own."""
        text, out, at = text or "", [], 0
        for m in [*self.specials.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part.isascii():
                part = part.lower()
            out += part.split() if not SEPARATORS.search(part) else [c for c in BLANKS.split(part) if c]
            if m:
                out.append(m[0])
                at = m.end()
        return out

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        runs = [self.runs(t) for t in texts]
        distinct = set().union(*runs)
        new = {c for c in distinct if c not in self.chunks}
        if self.letters_kept > MAX_LETTERS:
            self.chunks.clear()
            self.letters_kept, new = 0, distinct
        self.chunks |= self.learn(new)
        ids = [b"".join(map(self.chunks.__getitem__, r)) for r in runs]
        for c in new:
            if len(c) <= LONG:
                self.letters_kept += len(c)
            else:
                del self.chunks[c]
        return ids

    def forget(self) -> None:
        """Drop what was remembered of texts; the vocabulary stays."""
        for kept in (self.chunks, self.pairs, self.final_pairs, self.steps):
            kept.clear()
        self.letters_kept = 0


class Tokens:
    """The tokens of a vocabulary file by id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in ids.items()}

    def decode(self, ids: bytes | None) -> str:
        """Tokens joined by blanks; the vocabulary has no decoder. Unknown ids are passed over."""
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        try:
            return " ".join(map(self.by_id.__getitem__, numbers))
        except KeyError:
            return " ".join([self.by_id[i] for i in numbers if i in self.by_id])


@lru_cache(maxsize=1)
def encoder(path: str) -> Bpe:
    """The vocabulary at ``path``, read once per Python worker; the one used last stays."""
    return Bpe(path)


@lru_cache(maxsize=1)
def decoder(path: str) -> Tokens:
    return Tokens(path)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (packed little-endian uint32) of each whole text.

    Null and empty texts have no ids; an empty table gives an empty one, repeated
    rows stay, columns called like the new ones are replaced.  A worker remembers a
    bounded number of letters and token pairs; forgetting costs time, never results.
    ``path`` must be readable on every executor, like the installed libraries.
    """

    def make() -> Callable[[list], list[pa.Array]]:
        bpe = encoder(path)

        def compute(texts: list) -> list[pa.Array]:
            ids = bpe.encode(texts)
            return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]

        return compute

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return with_text_columns(df, text, make, fields, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``, the text of packed ids; null ids decode to the empty text.

    Repeated rows stay, an empty table stays empty, a column called ``decoded`` is replaced.
    """

    def make() -> Callable[[list], list[pa.Array]]:
        tokens = decoder(path)
        return lambda packed: [pa.array([tokens.decode(i) for i in packed], pa.string())]

    return with_text_columns(df, ids, make, [T.StructField("decoded", T.StringType())], keep, as_bytes=True)


def encode_and_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one pass of the texts.

    Same cases and columns as the two.  Apart, they would chain two Python workers
    in a task, and both would come to hold the vocabulary as workers change places.
    """

    def make() -> Callable[[list], list[pa.Array]]:
        bpe, tokens = encoder(path), decoder(path)

        def compute(texts: list) -> list[pa.Array]:
            ids = bpe.encode(texts)
            return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(map(tokens.decode, ids), pa.string())]

        return compute

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return with_text_columns(df, text, make, fields, keep)
