"""Alignment of two tokenizers against a plain version that uses the libraries alone."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trussline.llm import alignment
from trussline.llm.alignment import Aligner, PieceEncoder, align, align_tokenizers, text_slices

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    r = random.Random(3)
    vocabulary = ["Straße", "über", "naïve", "it's", "hello", "1234567", "don't!", "日本語", "x=1;", "e-mail", "ᚠ", "😀👍🏽", "supercalifragilistic", "www.a.b/c?d", "…", " ", "<|endoftext|>", "<s>", "<0x41>", "Á"]
    gaps = [" ", " ", " ", " ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", "   ", "　", "\x0b", "\x00"]
    made = ["".join(r.choice(vocabulary) + r.choice(gaps) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    odd = ["", None, " ", "  ", "\n", " a", "a ", "a  b", "\n\na", "▁", "a▁b", "hello world", "hello world", "x" * 700, "�", "<unk>", "a\n b", " \n", "é" * 300 + " z"]
    return made + odd


def plain(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = {t: i for i, t in alignment.byte_alphabet().items()}
    decode_a = lambda i: bytes(alignment.byte_alphabet()[c] for c in a.id_to_token(i))
    decode_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    assert len(own) == 256
    seen, documents = [], Counter()
    for text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        x, y = [decode_a(i) for i in ids[0]], [decode_b(i) for i in ids[1]]
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            seen.append(None)
            continue
        spans = [[(sum(map(len, z[:k])), sum(map(len, z[: k + 1]))) for k in range(len(z))] for z in (x, y)]
        links = [(i, j) for i, (p, q) in zip(ids[0], spans[0], strict=True) for j, (r, s) in zip(ids[1], spans[1], strict=True) if p < s and r < q]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for i, (p, q) in zip(z, s, strict=True) if lo <= p and q <= hi) for z, s in zip(ids, spans, strict=True)))
        seen.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        documents.update(set(links))
    most = {}
    for (i, _), n in documents.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if s is None else (s[0], s[1], s[2], len(s[3]), sum(documents[x] == most[x[0]] for x in s[3]), sum(documents[x] for x in s[3]), s[4])
        for s in seen
    ]


@pytest.mark.parametrize("settings", [{}, {"max_sent": 0}])
def test_equals_plain_version(spark, settings):
    rows = texts()
    docs = spark.createDataFrame([(None if i == 5 else i // 2, t, i, "mine") for i, t in enumerate(rows)], "doc_id int, text string, at int, pairs string")
    got = align_tokenizers(docs.repartition(3), A, B, **settings)
    assert got.columns == ["doc_id", *COLUMNS]
    want = [(None if i == 5 else i // 2, *x) for i, x in enumerate(plain(rows))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(x[1] > 0 for x in want) > 60


def test_no_rows(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_long_texts_in_slices(spark, monkeypatch):
    """Slices of any size give what the whole text gives."""
    rows = [t for t in texts() if t]
    whole = [(x.counts.tolist(), x.sha and x.sha.hexdigest(), x.links.tolist(), x.times.tolist()) for x in alignment._aligned(Aligner(A, B), [t.encode() for t in rows])]
    for limit in (1, 20, 90):
        monkeypatch.setattr(alignment, "SLICE", limit)
        monkeypatch.setattr(alignment.text_slices, "__defaults__", (limit,))
        again = [(x.counts.tolist(), x.sha and x.sha.hexdigest(), x.links.tolist(), x.times.tolist()) for x in alignment._aligned(Aligner(A, B), [t.encode() for t in rows])]
        assert again == whole
    assert all(b"".join(text_slices(t.encode(), 10)) == b" " + t.encode() for t in rows)


def test_windows_forget_and_collide(monkeypatch):
    """A full memo, or a hash that all windows share, changes nothing."""
    rows = [t.encode() for t in texts() if t]
    of = lambda aligner: [(x.counts.tolist(), x.links.tolist()) for x in alignment._aligned(aligner, rows)]
    whole = of(Aligner(A, B))
    assert of(Aligner(A, B, memo_windows=700)) == whole
    real = alignment.id_hashes
    monkeypatch.setattr(alignment, "id_hashes", lambda ids, start, size, seed: real(ids, start, size, seed) & np.uint64(3) if seed < 10 else real(ids, start, size, seed))
    aligner = Aligner(A, B)
    assert of(aligner) == whole and aligner.seed == 10


def test_pieces_are_the_models_own():
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    rows = [t for t in texts() if t and "▁" not in t]
    got = PieceEncoder(B, 1000)([b" " + t.encode() for t in rows])
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [model.encode(t) for t in rows]


def test_align_of_one_window():
    sizes = np.arange(5)
    a, b = np.array([2, 3, 1]), np.array([1, 4, 1])
    end_a, end_b, other, n = align(a, b, sizes, sizes)
    assert (end_a.tolist(), end_b.tolist()) == ([2, 3], [2, 3])
    assert list(zip(np.repeat(a, n).tolist(), other.tolist(), strict=True)) == [(2, 1), (2, 4), (3, 4), (1, 1)]
