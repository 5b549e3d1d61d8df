"""Cross-tokenizer alignment against the two libraries on whole texts, pair by pair."""

import hashlib
import os
import re
import sys
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tareline.llm import alignment, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, block string"


def letters():
    """Byte of each letter of a byte-level vocabulary, by its rule: printable bytes are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def brute(texts):
    """The contract's columns of every text, from the libraries' own tokens."""
    a, b, letter = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    a.encode_special_tokens = True
    name = {i: t for t, i in a.get_vocab().items()}

    def spelt(piece):
        byte = re.fullmatch("<0x(..)>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    docs, held = [], Counter()
    for text in texts:
        ids = ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sides = [bytes(letter[c] for c in name[i]) for i in ids[0]], [spelt(b.id_to_piece(i)) for i in ids[1]]
        if any(b"".join(s) != (" " + (text or "")).encode() for s in sides):
            ids, sides = ([], []), ([], [])
        spans = []
        for side in sides:
            at, out = 0, []
            for t in side:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            parts = [",".join(str(i) for i, (s, e) in zip(ids[k], spans[k]) if before <= s and e <= cut) for k in (0, 1)]
            groups.append("|".join(parts))
            before = cut
        docs.append((len(ids[0]), len(ids[1]), len(cuts), links, ";".join(groups)))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(n_a, n_b, n_g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
             hashlib.sha256(groups.encode()).hexdigest() if n_a else "") for n_a, n_b, n_g, links, groups in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def short(text, most=400):
    return text if text is None else text[:most]


def test_op11_equals_the_libraries(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").assign(text=lambda d: d.text.map(short))
    df = spark.createDataFrame([(int(i), t, None, None) for i, t in zip(docs.doc_id, docs.text)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, A, B, keep=["doc_id"]).collect()}
    assert got == dict(zip(docs.doc_id, brute(list(docs.text))))


def test_op11_counts_of_whole_texts(spark):
    got = queries.QUERIES["op11_alignment"](spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        if got.n_a[i]:
            assert (got.n_a[i], got.n_b[i]) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
    assert (got.n_a > 0).mean() > 0.9


SPACY = st.text(st.sampled_from("ab cé'\n\t　▁\x1c\x850<|endoftext|>"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | SPACY, max_size=4))
def test_cut_texts_equal_whole_ones(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    block, known = alignment.Block(), alignment.Pieces(alignment.tokenizers(A, B))
    block.add(list(range(len(texts))), texts, known)
    assert [(*d[:4], d[4]) for d in block.digests] == [(*w[:4], w[6]) for w in brute(texts)]


@pytest.mark.parametrize("sizes", [(1 << 15, 48 << 20, 96 << 20), (3, 200, 2000)])
def test_counts_over_blocks_and_forgotten_pieces(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_DOCS", "BLOCK_BYTES", "MEMORY_BYTES"), sizes):
        monkeypatch.setattr(alignment, name, size)
    monkeypatch.setattr("tareline.llm.batches.PIECE_ROWS", 2)
    texts = ["the cat sat", "the cat the cat the cat", "Unbelievably, the cat!", "the the the the the the", "a  b\n c "] * 12
    texts += [None, "", " ", "a▁b", "<|endoftext|> and <s>", "word " * 3000, "x" * 5000]
    df = spark.createDataFrame([(i // 2, t, None, "x") for i, t in enumerate(texts)], SCHEMA).coalesce(2)
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in alignment.align(df, A, B, keep=["doc_id"]).collect())
    assert got == sorted((i // 2, *row) for i, row in enumerate(brute(texts)))


def test_pair_counts_are_popcounts(spark):
    texts = ["the cat", "the cat the cat the cat the cat the cat", "cat", None]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    index = alignment.indexed(df, A, B, "text", ["doc_id"])
    counts = {r.pair: (r.documents, r.links) for r in alignment.pair_counts(index).collect()}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    the = a.encode(" the").ids[0] << 32 | b.encode("the")[0]
    cat = a.encode(" cat").ids[0] << 32 | b.encode("cat")[0]
    assert counts[the] == (2, 6) and counts[cat] == (3, 7)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align(empty, A, B, keep=["doc_id"]).collect() == []
    row = alignment.align(spark.createDataFrame([(1, "the cat", "mine", "own")], SCHEMA), A, B, keep=["doc_id", "block"]).collect()[0]
    assert row.block == "own" and row.n_a == 2


ODD = [" plain", " a▁b", " Überraschung", " a", " \u00e9\u0301x", " \U0001f600", " x\n", " 0x1F", " naïve—dash", " ﬁ", " ½²", " \u3000y", " tail "]


def test_many_texts_are_aligned_as_one_by_one():
    tokens = alignment.tokenizers(A, B)
    spelt = [t for t, (a, b) in zip(ODD, tokens.encode(ODD)) if tokens.align(t, a, b)]
    assert 3 < len(spelt) < len(ODD)
    for texts in (ODD, spelt, ODD[:1]):
        a, b = zip(*tokens.encode(texts))
        *told, links, held = map(list, tokens.align_all(texts, a, b))
        one = [tokens.align(*x) or (0, 0, 0, None, []) for x in zip(texts, a, b)]
        assert list(zip(*told)) == [x[:4] for x in one]
        assert held == [len(x[4]) for x in one] and links == [n for x in one for n in x[4]]


def test_spelt_pieces_are_not_aligned_one_by_one(monkeypatch):
    monkeypatch.setattr(alignment.Tokenizers, "align", lambda *_: pytest.fail("a piece on its own"))
    monkeypatch.setattr(alignment, "LEARNT", 2, raising=False)
    known = alignment.Pieces(alignment.tokenizers(A, B))
    known.learn({" some", " plain", " words", " of", " text"})
    assert len(known.groups) == len(known.number) == len(known.starts) - 1 == 5 and None not in known.groups
