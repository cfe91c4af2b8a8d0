"""Token files against the library itself, shards against their law."""

import random
import zlib

import numpy as np
import pytest

from starfold.llm import shards, tokens

TEXTS = [
    "Plain words, one after another.", "", None, "two  blanks\n\nand lines \t x ", "wide space and nel\x85here",
    "it's we're '' 12345 ÄÖÜ ñandú 你好 <|endoftext|> !!!", "same text", "same text", "x" * 5000, " " * 40, "a\rb\r\nc",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 4, t, "other", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "o", 1), (8, "same text", "o", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, shard int").repartition(3)


def test_ids_are_those_of_the_library(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    parts = tokens.write_tokens(docs)
    got = tokens.read_tokens(spark, parts).collect()
    assert len(got) == docs.count()
    want = {}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    assert [r["start"] for r in order] == list(np.cumsum([0] + [r["n_tokens"] for r in order])[:-1])


def test_rows_and_masks_are_views(spark, docs):
    part = tokens.write_tokens(docs.coalesce(1)).first()
    file = tokens.TokenFile(part["path"], part["part"])
    row = file.sequence(0)
    assert len(row) == tokens.SEQUENCE and not row.flags.owndata
    masks = [sum(file.mask(i).to_pylist()) for i in range(file.rows.num_rows)]
    assert sum(masks) == part["n_tokens"]


def test_pieces_join_to_the_whole():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    encoder = tokens.Encoder(tokens.default_tokenizer())
    assert encoder.cuts
    dice = random.Random(11)
    some = ["a", "word", "it's", "don't", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "\u3000", "\u2003", "\u1680", "\x1c", "\x0b", "<|endoftext|>", "é", "ß", "Àx", "你好", "🙂", "12", "!?", "\x00", "ñ"]
    for size in (1, 3, 12, 400):
        texts = ["".join(dice.choice(some) for _ in range(dice.randrange(size + 1))) for _ in range(60)] + TEXTS[:2]
        for _ in range(2):  # anew and from memory
            ids, sizes = encoder.encode([t.encode() for t in texts])
            want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert encoder.encode([])[1].tolist() == [] and encoder.encode([b"", b""])[0].tolist() == [0, 0]


def test_special_tokens_are_those_of_the_library(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.encode_corpus(docs).collect())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got == [(1, 0, 5, crc([64, 220, 50256, 275, 0])), (2, 5, 2, crc([50256, 0]))]


def test_a_full_memory_and_other_tokenizers_change_no_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [" ".join(f"w{i * k % 97}x" for i in range(200)) for k in range(1, 6)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
        monkeypatch.setattr(tokens, "RECENT_PIECES", 10)
        path = public_tokenizers.path(name)
        encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
        assert encoder.cuts == name.startswith("byte")
        for t in texts * 2:
            ids, sizes = encoder.encode([t.encode()])
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids + [0] and sizes.tolist() == [len(ids)]


def test_runs_cross_record_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 3000) for i in range(120)], "doc_id long, text string")
    got = tokens.encode_corpus(docs).collect()
    assert len({(r["n_tokens"], r["ids_crc32"]) for r in got}) == 1 and len(got) == 120


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(none).count() == 0
    assert shards.read_shards(spark, shards.write_shards(none, 24)).count() == 0


@pytest.mark.parametrize("bucket_bytes", [1, 40, 1 << 20])
def test_shards_hold_every_record_once(spark, docs, bucket_bytes):
    path = shards.write_shards(docs, 4, bucket_bytes=bucket_bytes)
    got = shards.digest(shards.read_shards(spark, path)).collect()
    key = lambda i, t: (i is not None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        key(r["doc_id"], r["text"]) for r in docs.collect()
    )
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_are_reproducible_and_shuffled(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    seen = []
    for parts in (2, 5):
        path = shards.write_shards(docs.repartition(parts), 3, bucket_bytes=2000)
        rows = shards.read_shards(spark, path).collect()
        seen.append(sorted((r["shard"], r["slot"], r["doc_id"]) for r in rows))
    assert seen[0] == seen[1]
    first = [i for s, _, i in seen[0] if s == 0]
    assert first != sorted(first)


def test_texts_of_one_id_are_scattered(spark):
    docs = spark.range(300).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    assert shards._scatter(docs, 1).select("h").distinct().count() == 300
    path = shards.write_shards(docs, 3, bucket_bytes=500)
    got = shards.read_shards(spark, path).collect()
    assert sorted(r["text"] for r in got) == sorted(f"text {i}" for i in range(300))
