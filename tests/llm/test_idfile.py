"""Files of token ids: exact round trips, damage, and the library's own ids."""

import random
import zlib

import numpy as np
import pytest

from vectriage.llm import idfile
from vectriage.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)  # as it comes: the contract is the library's default
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def coded(ids, block=idfile.BLOCK):
    models = idfile.Models.of(ids)
    return idfile.Models.load(models.dump()), idfile.encode_blocks(ids, models, block)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 40000])
def test_round_trip_of_ids(n):
    rng = np.random.default_rng(n)
    for high in (1, 2, 300, 65536):
        ids = (rng.integers(0, high, n) ** 2 % 65536).astype(np.uint16)
        models, blocks = coded(ids, 256)
        assert (idfile.decode_blocks(models, 256, blocks).reshape(-1)[:n] == ids).all()


def test_every_id_comes_up():
    ids = np.random.default_rng(3).permutation(65536).astype(np.uint16)
    models, blocks = coded(np.concatenate([ids, ids[::-1]]))
    assert (idfile.decode_blocks(models, idfile.BLOCK, blocks).reshape(-1) == np.concatenate([ids, ids[::-1]])).all()


def test_repeats_cost_little_and_blocks_stand_alone():
    phrase = np.random.default_rng(1).integers(0, 50000, 40).astype(np.uint16)
    ids = np.tile(phrase, 10000)
    models, blocks = coded(ids)
    assert sum(map(len, blocks)) < 0.4 * 2 * len(ids)
    some = idfile.decode_blocks(models, idfile.BLOCK, blocks[3:5])
    assert (some.reshape(-1) == ids[3 * idfile.BLOCK : 5 * idfile.BLOCK]).all()


def test_real_texts_take_less_than_their_order_0_entropy(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    ids = np.frombuffer(b"".join(idfile.Tokenizer(PATH).encode(texts)), "<u2")
    data = idfile.to_segment(np.zeros(1), np.ones(1, bool), np.array([len(ids)]), ids)
    share = np.bincount(ids)[np.flatnonzero(np.bincount(ids))] / len(ids)
    assert 8 * len(data) < len(ids) * -(share * np.log2(share)).sum()


def test_damage_is_found():
    ids = np.arange(3000).astype(np.uint16)
    data = idfile.to_segment(np.array([4, 9]), np.array([True, False]), np.array([1000, 2000]), ids)
    both = list(idfile.from_file(data + data))
    assert len(both) == 2
    for keys, known, counts, back in both:
        assert keys.tolist() == [4, 9] and known.tolist() == [True, False] and counts.tolist() == [1000, 2000] and (back == ids).all()
    for at in (3, 60, len(data) - 900):
        broken = bytearray(data)
        broken[at] ^= 64
        with pytest.raises(ValueError):
            list(idfile.from_file(bytes(broken)))


def test_words_give_the_library_s_ids():
    rnd = random.Random(4)
    parts = ["the", "of", "größe", "日本", "'s", "don't", "\n", "\t", " ", "  ", " ", " ", "\x1c", "\x85", "<|endoftext|>", "123", "!!", "\r\n", "a.b", "é", "", "☃", "Ġ"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(400)] + ["", " ", "a ", " a", "a  b", "x" * 3000]
    found = idfile.Tokenizer(PATH).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == library_ids(texts)


def check(rows, got):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    start, want = 0, []
    for i, ids in zip(order, library_ids([rows[i][1] for i in order])):
        ids = [*ids, 0]
        want.append((rows[i][0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_by_their_bytes(monkeypatch):
    """Words that differ in length, zero bytes or place only, short and long ones, looked up a few at a time, with a memory
    that overflows and a table in which they collide."""
    rng = random.Random(5)
    words = [c * n for c in ("a", "é", "\0", "字", "a\0", "x,") for n in (1, 2, 3, 7, 8, 9, 11, 12, 15, 16, 17, 22, 23, 24, 25, 40)] + ["it's", "3.14,", "a.\nB", "\n", "\n\n", "e\u0301"]
    texts = ["", "a", "a a", words[3], "\n", "a\tb c", "  a", "b "] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(150)]
    want = library_ids(texts)
    for memory, held, some in ((1 << 20, 32 << 20, 1 << 17), (64, 1 << 20, 7), (100, 50, 1)):
        monkeypatch.setattr(idfile, "MEMO_WORDS", memory)
        monkeypatch.setattr(idfile, "MEMO_BYTES", held)
        monkeypatch.setattr(idfile, "WORDS", some)
        t = idfile.Tokenizer(PATH)
        for _ in range(2):
            assert [np.frombuffer(x, "<u2").tolist() for at in range(0, len(texts), 40) for x in t.encode(texts[at : at + 40])] == want
        assert t.memo.n <= memory + 2 * some and sum(len(w) for w, _ in t.memo.long) <= held + 80 * some


def test_added_tokens_are_the_library_s():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", " <|endoftext|>", "<|endoftext", "plain"]
    found = idfile.Tokenizer(PATH).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == library_ids(texts)
    assert np.frombuffer(found[0], "<u2").tolist() == [64, 220, 50256, 275]


def test_segments_other_columns_and_a_hot_id(spark, tmp_path):
    rows = [(1 if i % 3 else i, f"text {i % 50} of <|endoftext|> {i % 7}" if i % 5 else None, "file", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, start long")
    check([r[:2] for r in rows], [tuple(r) for r in idfile.round_trip(df, PATH).collect()])
    same = spark.createDataFrame([(None, "same text")] * 200, "doc_id long, text string")
    check([(None, "same text")] * 200, [tuple(r) for r in idfile.round_trip(same, PATH).collect()])


def test_a_task_goes_on_in_other_files(spark, tmp_path):
    rows = [(1, f"{'the same beginning ' * 5}{'a' * (i % 40)} {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = idfile.round_trip(df, PATH, str(tmp_path), segment=1000, segments=1)
    check(rows, [tuple(r) for r in out.collect()])
    names = sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("ids-"))
    assert len(names) >= 3 and len({int(n[4:-4]) // idfile.ROLLS for n in names}) < len(names)


def test_edges(spark):
    rows = [(7, "a b"), (7, "a a"), (3, None), (5, ""), (None, "null id"), (9, "the " * 20000), (-2, "neg  ative\n"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, [tuple(r) for r in idfile.round_trip(df, PATH).collect()])
    assert idfile.round_trip(df.limit(0), PATH).count() == 0


def test_query(spark, sf_dir):
    from vectriage.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, [tuple(r) for r in QUERIES["op10_token_id_files"](spark, sf_dir).collect()])
