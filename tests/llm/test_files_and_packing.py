import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.samples import odd_documents
from veritab.llm import op6_packing as op6
from veritab.llm.common import tokenizer_path
from veritab.llm.encoding import Encoder
from veritab.llm.op1_token_files import ShardReader, read_token_files, write_token_files
from veritab.llm.op6_packing import TIERS, pack, pack_documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_is_the_library(library):
    rnd, letters = random.Random(1), "aBéÉ×'.,!? \n\t12žŽ́<|>ß日K"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    texts += ["a\x85b\x0bc\x1cd", "ΣΑΣ İstanbul ﬃ Ǆ", "it's 'S don't", "<|endoftext|>a", "<|ENDOFTEXT|>", None, "", "é" * 9000]
    for keep in (1_000_000, 5):
        got = Encoder(tokenizer_path(), keep=keep)(pa.array(texts, pa.string()), 2)
        assert [g.tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_files_round_trip(spark, tmp_path, library):
    docs = odd_documents(spark).repartition(3)
    path = str(tmp_path / "ids")
    manifest = write_token_files(docs, path, tokenizer_path())
    rows = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    expected = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in rows] == [d for d, _ in expected]
    at = 0
    for row, (_, text) in zip(rows, expected, strict=True):
        ids = ids_of(library, text)
        assert (row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    wanted = spark.createDataFrame([(8,), (3,), (77,)], "doc_id long")
    some = read_token_files(manifest, wanted).collect()
    assert sorted(r.doc_id for r in some) == [3, 8]
    assert {r.doc_id: bytes(r.ids) for r in some} == {r.doc_id: bytes(r.ids) for r in rows if r.doc_id in (3, 8)}
    # a reader touches only the frames it needs and notices damage
    file = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".zst")), key=os.path.getsize)
    shard = ShardReader(file)
    data = bytearray(open(file, "rb").read())
    data[int(shard.at[1]) - 6] ^= 255
    open(file, "wb").write(bytes(data))
    with pytest.raises(Exception):
        ShardReader(file).ids(0, 5)


def test_empty_tables(spark, tmp_path):
    none = odd_documents(spark).filter("false")
    assert read_token_files(write_token_files(none, str(tmp_path / "e"), tokenizer_path())).count() == 0
    assert pack_documents(none, tokenizer_path()).count() == 0


def test_packing_places_each_id_once(spark, library):
    docs = odd_documents(spark).repartition(2)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(ids_of(library, r.text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, tokenizer_path()).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, own in texts.items():
        assert sum(map(len, own)) == sum(r.length for r in pieces[doc_id])
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[0])
                assert r.ids_crc32 == zlib.crc32(np.array(own[0][at: at + r.length], "<u4").tobytes())
                at += r.length
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and own[0].padded == (at if at & (at - 1) == 0 else 4096)


def test_windows_of_a_tier_are_full():
    rnd = random.Random(2)
    for _ in range(50):
        sizes = [rnd.choice([1, 5, 300, 511, 512, 513, 2047, 2049, 4095, 4096, 4097, 9000, rnd.randrange(1, 9000)]) for _ in range(rnd.randrange(60))]
        windows, rest = pack(sizes)
        seen = defaultdict(list)
        for tier, window in windows:
            assert tier in TIERS and sum(n for *_, n in window) == tier
        for window in [w for _, w in windows] + [rest]:
            for doc, start, n in window:
                seen[doc].append((start, n))
        assert sum(n for *_, n in rest) < 4096
        for doc, size in enumerate(sizes):
            at = 0
            for start, n in sorted(seen[doc]):
                assert start == at
                at += n
            assert at == size


def test_packing_encodes_small_slices(spark, monkeypatch):
    """What the encoder is given at once doesn't follow the size of Arrow batches."""
    made = op6.encoder

    def watched(path, by_word):
        encode = made(path, by_word)

        def small(column, end_id):
            assert sum(len(t) for t in column.to_pylist()) <= 1.1 * (1 << 20)
            return encode(column, end_id)

        return small

    monkeypatch.setattr(op6, "encoder", watched)
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text")
    assert pack_documents(docs, tokenizer_path()).selectExpr("sum(length)").first()[0] == 1000 * 801
