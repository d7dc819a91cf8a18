import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plyforge.llm import bpe, pieces
from plyforge.llm.bpe import PairIndexBpe, bpe_decode, bpe_encode, bpe_round_trip, tokenized
from plyforge.llm.huffman import FILE_END, STEP, ByteEncoder, Codebook, code_lengths, file_head, read_file, token_files, write_block
from plyforge.llm.pieces import PieceTable, byte_letters, span_hashes
from plyforge.llm.queries import vocabulary
from plyforge.llm.textio import chunks

ODD = list("abcdefgh  \n\t\r\x0b\x0c'STReMvld0123.,!?éèßñüÀÉÞ×÷\xa0\x85\x1c\x1d\x1f 　日本Σςİ́½²٣ǅʰ​﻿\x00\x7f­ŉẞ<|>") + ["'s", "'re", "'LL", "<|endoftext|>", "   ", " \n ", "the", "The ", "\n\n", "😀"]
PLAIN = list("abC  \n\t'sTreVEll0.é\xa0!-")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in (ODD, PLAIN) for _ in range(3000)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def runs(texts, limit):
    for i, j, data, offs in chunks(pa.array(texts, pa.string()), limit):
        yield texts[i:j], data, offs


def test_bpe_equals_the_library(texts, library, long_texts):
    t, b = library["byte_bpe_50k.json"], PairIndexBpe(vocabulary("byte_bpe_50k.json"), 500, 20_000)  # small bounds: the table begins anew
    for some, data, offs in runs(texts + long_texts, 5000):
        for text, (n, ids, decoded) in zip(some, b.digests(data, offs), strict=True):
            want = t.encode(text, add_special_tokens=False).ids
            assert n == len(want), repr(text[:99])
            assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert decoded == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
            assert len(text) > 99 or b.encode(text) == want


def test_bpe_of_texts_cut_into_runs(library, monkeypatch):
    monkeypatch.setattr(bpe, "RUN_BYTES", 100)
    b, rng = PairIndexBpe(vocabulary("byte_bpe_50k.json")), random.Random(3)
    for text in ["".join(rng.choice(PLAIN if k % 2 else ["the ", "cat's ", "x", "  ", "\n", "é"]) for _ in range(900)) for k in range(20)] + ["_" * 999, "ab" * 300 + " <|endoftext|> c" * 30, "日本 " * 200]:
        assert b.encode(text) == library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("merges", [["b c", "a b", "a bc", "ab c", "abc d", "d d"], ["abc d", "a b", "ab c", "b c", "c c"], [], ["a a", "aa a", "aa aa", "b aa"]])
def test_merge_order_in_any_vocabulary(tmp_path, merges):
    """Rules that make a symbol twice, or use it before it's made, have no bands and are applied rank by rank."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    vocab = {c: i for i, c in enumerate(byte_letters().values())}
    for m in merges:
        vocab.setdefault(m.replace(" ", ""), len(vocab))
        for x in m.split():
            vocab.setdefault(x, len(vocab))
    t = Tokenizer(models.BPE(vocab=vocab, merges=[tuple(m.split()) for m in merges]))
    t.pre_tokenizer, t.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    t.save(str(tmp_path / "v.json"))
    b, rng = PairIndexBpe(str(tmp_path / "v.json")), random.Random(1)
    assert (b.v.bands is None) == (merges[:1] in (["b c"], ["abc d"]))
    for _ in range(300):
        text = "".join(rng.choice("aabbccd ") for _ in range(rng.randint(0, 30)))
        assert b.encode(text) == t.encode(text).ids, text


def test_bpe_tables(spark, odd, empty):
    path = vocabulary("byte_bpe_50k.json")
    rows = bpe_round_trip(odd, path).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert {r["ids_sha256"] for r in rows if r["doc_id"] == 1} == {hashlib.sha256(b"").hexdigest()}
    back = bpe_decode(bpe_encode(odd, path), path).collect()
    want = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    assert {(r["doc_id"], r["text"]) for r in back} == want
    t = tokenized(odd, path, ("doc_id", "lang", "row"))
    assert t.columns == ["doc_id", "lang", "row", "n_tokens", "ids", "round_trip"] and t.where("not round_trip or size(ids) <> n_tokens").count() == 0
    assert bpe_round_trip(empty, path).count() == 0


def test_word_ids_equal_the_library(texts, library, long_texts):
    t = library["word_bpe_49k.json"]
    enc = ByteEncoder(vocabulary("word_bpe_49k.json"), "<u2", 500, 20_000)  # small bounds: the table forgets
    for some, data, offs in runs(texts + long_texts, 5000):
        for text, ids in zip(some, enc.encode(data, offs), strict=True):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:99])


def test_pieces_of_thousands_of_ids(library):
    """Runs of letters or marks without a break, whose ids one byte can't count."""
    enc, t = ByteEncoder(vocabulary("word_bpe_49k.json"), "<u2"), library["word_bpe_49k.json"]
    texts = ["qzxjkvwp" * 150, "#$%&" * 1500, "a plain text", "qzxjkvwp" * 600 + " end"]
    for some, data, offs in runs(texts, 1 << 20):
        got = enc.encode(data, offs)
        assert len(got[0]) > 255 and [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in some]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_modulo_powers_of_two():
    """Polynomials modulo 2^64 give a Thue-Morse word of 1,024 letters and its inverse one hash, whatever the base."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    for size in (256, 1024):
        h = span_hashes(data, np.array([0, 1024, 2048]), np.array([size, 1024 + size, 2048 + size]))
        assert h[0] == h[2] != h[1]


def test_piece_table_tells_equal_hashes_apart(monkeypatch):
    """Whatever the hash, a hit agrees in all bytes."""
    keys = pieces.span_keys
    monkeypatch.setattr(pieces, "span_keys", lambda *x: (keys(*x)[0] & np.uint64(3), *keys(*x)[1:]))
    words = [("w%d" % (i % 40) + "x" * (i % 3 * 9) + "y" * (i % 2)).encode() for i in range(300)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    table = PieceTable("<i4", 100)

    def learn(s, e):
        return np.concatenate([data[a:b] for a, b in zip(s, e, strict=True)]).astype(np.int32), e - s

    for k in range(0, 300, 30):
        table.begin()
        ids, n = table.ids_of(table.numbers(data, starts[k : k + 30], ends[k : k + 30], learn))
        assert ids.astype(np.uint8).tobytes() == b"".join(words[k : k + 30]) and n.tolist() == [len(w) for w in words[k : k + 30]]


@pytest.mark.parametrize("n, vocab, limit", [(0, 5, 16), (1, 5, 16), (1000, 1, 16), (5000, 3000, 16), (60000, 40000, 16), (777, 500, 9), (3 * STEP, 4, 16)])
def test_huffman_round_trip(n, vocab, limit):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % vocab).astype(np.uint32)
    lengths = code_lengths(np.bincount(ids, minlength=vocab), limit)
    assert lengths.max(initial=0) <= limit
    used = lengths[lengths > 0].astype(float)
    assert len(used) < 2 or (2.0**-used).sum() == 1
    book = Codebook(lengths)
    raw, marks = book.pack(ids)
    assert (book.unpack(raw, marks, n) == ids).all()
    docs = [ids[: n // 3], ids[n // 3 : n // 3], ids[n // 3 :]]
    blocks = list(read_file(io.BytesIO(file_head(book) + write_block(book, [3, 5, 5], docs) + write_block(book, [7], [ids[:1]]) + FILE_END)))
    assert blocks[0][0].tolist() == [3, 5, 5] and blocks[0][1].tolist() == [len(d) for d in docs] and (blocks[0][2] == ids).all() and blocks[1][0].tolist() == [7]


def test_code_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 300)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    depth, k = np.zeros(300, int), 300
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
        k += 1
    assert (depth * counts).sum() == (code_lengths(counts, 20).astype(int) * counts).sum()
    with pytest.raises(ValueError):
        code_lengths(counts, 8)


def test_token_files(spark, documents, odd, empty, library):
    t = library["word_bpe_49k.json"]
    for df in (documents, odd):
        rows = sorted((r["doc_id"], r["text"] or "") for r in df.collect() if r["doc_id"] is not None)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files(df, vocabulary("word_bpe_49k.json")).collect())
        start = 0
        assert len(got) == len(rows)
        for (i, text), (at, doc, n, crc) in zip(rows, got, strict=True):
            ids = t.encode(text, add_special_tokens=False).ids + [2]
            assert (doc, at, n, crc) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += n
    assert token_files(empty, vocabulary("word_bpe_49k.json")).count() == 0
