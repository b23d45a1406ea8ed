"""op4: packing round trips, random access, and ids equal to the library's."""
import random
import zlib

import numpy as np
import pytest
from llm_brute import THUE_MORSE
from tokenizers import Tokenizer

from pagecurate.llm import token_files as tf

SF_SMALL = "/root/testdata/sf0.001"


def plain_ids(texts):
    t = Tokenizer.from_file(tf.default_tokenizer())  # the library as it comes
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = tf.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (tf.unpack(data, n, bits) == ids).all()


def test_bits_for():
    assert [tf.bits_for(v) for v in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(None, rng.integers(0, 1000, 5)), (-3, rng.integers(0, 1000, 0)), (7, rng.integers(0, 1000, 300)), (7, rng.integers(0, 1000, 70))]
    w = tf.PackedWriter(f"file://{tmp_path}/a.bin", 10, block=64)
    for d, ids in docs:
        w.add(d, ids.astype(np.uint32))
    w.close()
    f = tf.PackedFile(f"file://{tmp_path}/a.bin")
    every = np.concatenate([ids for _, ids in docs])
    assert f.n_ids == len(every) and f.doc_ids == [d for d, _ in docs]
    for a, b in ((0, 375), (63, 65), (64, 64), (100, 101), (370, 375)):
        assert (f.ids(a, b) == every[a:b]).all()
    assert (f.document(2) == docs[2][1]).all()
    assert [(d, s, len(i)) for d, s, i in f.documents(10)] == [(None, 0, 5), (-3, 5, 0), (7, 5, 300), (7, 305, 70)]


def test_piece_ids_equal_the_library():
    random.seed(5)
    parts = [" ", "  ", "\n", "a", "b'", "'s", " ", "　", "\x1c", "\x85", "é", "12", "!", "😀", "\t", "can't", "<|endoftext|>", "​", " Wort", "\r\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(3000)]
    texts += [None, "", "a  b c", "«x» y « z", "a\u2003b c\u00a0 d", "\u3000 x y", "x \u0085 y", " lead", "trail ", "ß ä.", "né à, la"]
    enc = tf.PieceEncoder(tf.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() + [0] for x in enc.encode(texts)] == plain_ids(texts)
        assert [enc.encode([t])[0].tolist() + [0] for t in texts[-300:]] == plain_ids(texts[-300:])


def test_special_strings_and_long_pieces():
    end = "<|endoftext|>"
    texts = [f"hello {end} world", f"{end}a", f"a{end}", end * 3, f" {end} {end} ", "<|endoftext|", "|> <|endoftext", *THUE_MORSE,
             *("x " + "abcdefgh" * 40 + c for c in "ab"), " ".join(THUE_MORSE), THUE_MORSE[0][:600] + "b"]
    enc = tf.PieceEncoder(tf.default_tokenizer())
    assert enc.encode(["hello <|endoftext|> world"])[0].tolist() == [31373, 220, 50256, 995]
    for _ in range(2):
        assert [x.tolist() + [0] for x in enc.encode(texts)] == plain_ids(texts)
        assert [enc.encode([t])[0].tolist() + [0] for t in texts] == plain_ids(texts)


def test_other_tokenizer_files(tmp_path):
    import json
    import public_tokenizers
    texts = ["Hello there,  World", "a\u00a0b C", " x", ""]
    own = json.loads(Tokenizer.from_file(tf.default_tokenizer()).to_str())
    own["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(own))
    for path in (public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "lower.json")):
        library, enc = Tokenizer.from_file(path), tf.PieceEncoder(path)
        assert not enc.by_piece
        assert [x.tolist() for x in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    texts = ["one two three", "four two one one", ""]
    first = []

    def few(raw, begin, end):
        first.append(0)
        return (end - begin).astype(np.uint64) if len(first) % 2 else real(raw, begin, end)

    real = tf.slice_hashes
    monkeypatch.setattr(tf, "slice_hashes", few)
    assert [x.tolist() + [0] for x in tf.PieceEncoder(tf.default_tokenizer()).encode(texts)] == plain_ids(texts)


def test_full_piece_memory(monkeypatch):
    monkeypatch.setattr(tf, "CACHE_PIECES", 3)
    enc = tf.PieceEncoder(tf.default_tokenizer())
    texts = ["one two three four", "five six one seven", "two eight nine"]
    for t in texts:
        assert enc.encode([t])[0].tolist() + [0] == plain_ids([t])[0]


def expected(rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain_ids([t])[0]
        out.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_query_equals_the_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tf.op4_tokens(spark, SF_SMALL).collect()]
    assert sorted(got, key=repr) == expected(docs)


def test_edge_rows(spark):
    rows = [(3, None), (1, ""), (2, "a b"), (2, "a b"), (None, "x"), (9, "word " * 300_000), (2, "a"), (-5, "neg"), (7, THUE_MORSE[0]), (8, THUE_MORSE[1]), (10, "to <|endoftext|> and on"), *((None, f"t {i}") for i in range(50))]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, start string").repartition(3)
    got = tf.tokens_of(df, tf.default_tokenizer(), block=128)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected(rows)
    assert tf.tokens_of(df.limit(0), tf.default_tokenizer()).count() == 0
