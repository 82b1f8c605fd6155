import hashlib
import os
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.samples import odd_documents
from veritab.llm import op12_alignment as op12
from veritab.llm.common import tokenizer_path
from veritab.llm.encoding import byte_letters

FULL = os.environ.get("VERITAB_ALL") == "1"
PATHS = tokenizer_path(op12.A), tokenizer_path(op12.B)


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def tokens_of(libraries, text):
    """Ids and bytes of whole texts, by the libraries alone."""
    a, b = libraries
    if not text:
        return [], []
    letter = {c: bytes([x]) for x, c in byte_letters().items()}
    x = [(i, b"".join(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return (x, y) if b"".join(t for _, t in x) == (" " + text).encode() == b"".join(t for _, t in y) else ([], [])


def brute(libraries, texts):
    """The contract, token by token."""
    links, docs = Counter(), []
    for text in texts:
        sides, spans = tokens_of(libraries, text), []
        for side in sides:
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        a, b = spans
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([], []) for _ in cuts]
        for which, side in enumerate(spans):
            for i, s, e in side:
                groups[bisect_left(cuts, e)][which].append(i)
        parts = ["|".join(",".join(map(str, side)) for side in group) for group in groups]
        pairs = [(i, j) for i, s, e in a for j, p, q in b if s < q and p < e] if len(a) < 400 else swept(a, b)
        links.update(pairs)
        docs.append((len(a), len(b), len(cuts), pairs, hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    most = {}
    for (_, j), n in links.items():
        most[j] = max(n, most.get(j, 0))
    return [(na, nb, ng, len(p), sum(links[x] == most[x[1]] for x in p), sum(links[x] for x in p), sha) for na, nb, ng, p, sha in docs]


def swept(a, b):
    out, k = [], 0
    for i, s, e in a:
        while k < len(b) and b[k][2] <= s:
            k += 1
        m = k
        while m < len(b) and b[m][1] < e:
            out.append((i, b[m][0]))
            m += 1
    return out


def odd_texts():
    rnd, letters = random.Random(5), ["a", "B", "é", "日", "本", "ж", " ", "  ", "\n", "\t", "'s", "12", " ", " ", "　", "\x1c", "\x85", "?", "ing", "́", "the "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(800)]
    return texts + [" ", "  ", "a ", "a  ", "▁", "a▁ b", "<s> </s> <unk> <0x41>", "<|endoftext|>", None, "", "\x00", "don't it's", "ﬁ İ ß", "x" * 5000, "᠎ a", "a  b"]


def test_ids_are_the_libraries(libraries, monkeypatch):
    texts = odd_texts()
    for run in (op12.RUN, 40):
        monkeypatch.setattr(op12, "RUN", run)
        got = op12.Tokenizers(*PATHS)
        for at in range(0, len(texts), 300):
            part = texts[at: at + 300]
            units = got(pa.array(part, pa.string()))
            sides = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((units.a, units.a_n), (units.b, units.b_n))]
            for text, x, y in zip(part, units.edges()[:-1], units.edges()[1:], strict=True):
                expected = [[i for i, _ in side] for side in tokens_of(libraries, text)]
                assert [[i for u in units.units[x:y] for i in side[u].tolist()] for side in sides] == expected, repr(text)


def test_both_ways_of_a_agree_on_all_characters(libraries):
    """tiktoken in place of the library, for every character in three surroundings."""
    ranked = op12.Tokenizers(*PATHS)
    assert ranked.a.__name__ == "encode_ordinary"
    texts = [f" a{c}b {c}1{c}{c} x" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000, 1 if FULL else 7)])]
    for at in range(0, len(texts), 20_000):
        part = texts[at: at + 20_000]
        expected = [e.ids for e in libraries[0].encode_batch_fast(part, add_special_tokens=False)]
        differ = [hex(ord(t[2])) for t, e in zip(part, expected, strict=True) if ranked.a(t) != e]
        assert not differ, differ


def test_aligned_against_brute_force(spark, libraries, monkeypatch):
    docs = odd_documents(spark, [(100 + i, t) for i, t in enumerate(odd_texts()[-300:])]).repartition(3)
    rows = docs.select("doc_id", "text").collect()
    expected = Counter((r.doc_id, *x) for r, x in zip(rows, brute(libraries, [r.text for r in rows]), strict=True))
    for size in (1 << 12, op12.SLICE):
        monkeypatch.setattr(op12, "SLICE", size)
        got = op12.aligned(docs, *PATHS)
        assert ", ".join(f"{n} {t}".replace("bigint", "long") for n, t in got.dtypes) == op12.RESULT
        assert Counter(map(tuple, got.collect())) == expected
    assert op12.aligned(docs.limit(0), *PATHS).isEmpty()


def test_groups_are_spelled(spark, libraries):
    docs = odd_documents(spark)
    tokens = op12.tokenized(docs, *PATHS)
    for row in op12.groups(tokens, *PATHS).join(docs.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        a, b = tokens_of(libraries, row.text)
        assert [i for g in row.groups for i in g.a] == [i for i, _ in a] and [i for g in row.groups for i in g.b] == [i for i, _ in b]
        at = 0
        for g in row.groups:
            assert g.start == at
            at = g.stop
        assert at == (len((" " + row.text).encode()) if a else 0)


def test_query_against_brute_force(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    got = {r[0]: tuple(r)[1:] for r in op12.op12_alignment(spark, sf).collect()}
    assert got == dict(zip(docs["doc_id"], brute(libraries, docs["text"]), strict=True))
