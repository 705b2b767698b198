"""Token files against whole-text encoding, and the boundary code against plain lists."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from eddymap.llm import token_files
from eddymap.llm.elias_fano import EliasFano
from eddymap.llm.queries import BYTE_LEVEL, PIECES_MODEL, file_text
from eddymap.llm.stretches import Memo, byte_level, encode_apart, sentence_pieces, stretches
from eddymap.store import Store


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(BYTE_LEVEL)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("top", [0, 1, 3, 600, 10**6, 10**12])
def test_boundary_code(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 2, 7, 255, 256, 257, 1500):
        values = np.sort(rng.integers(0, top + 1, n))
        code, end = EliasFano.from_bytes(b"??" + EliasFano.of(values).to_bytes() + b"!", 2)
        assert code.all().tolist() == values.tolist() == [code.select(i) for i in range(n)]
        assert end == 2 + len(code.to_bytes())
        if n == 1500:  # two bits and the bits of the mean gap, and a sample for every 256 values
            assert 8 * (len(code.low) + len(code.high)) <= n * (3 + np.log2(max(top / n, 1))) + 16
    with pytest.raises(IndexError):
        code.select(1500)


PARTS = [" ", "\n", "\r", "\t", "  ", "\n\n", "a", "foo", "bar;", "é", "\x1c", "\xa0", "　", "<|endoftext|>", "<s>",
         "<0x0A>", "'s", "12", "}\r", "{", "😀", "▁", "\x00", "\x85", "the", "中文"]


def test_stretches_keep_every_token():
    rng = random.Random(3)
    bytes_, pieces = byte_level(file_text(BYTE_LEVEL)), sentence_pieces(open(PIECES_MODEL, "rb").read())
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30)))
        parts = stretches(text)
        assert "".join(parts) == text
        assert b"".join(encode_apart(bytes_, parts)) == bytes_.encode([text])[0].astype("<u2").tobytes(), text
        whole = pieces.processor.encode(text)
        parts = stretches(" " + text)
        ids = encode_apart(pieces, parts)
        if pieces.spells(np.array(whole), (" " + text).encode()):
            assert b"".join(ids) == np.array(whole, "<u2").tobytes(), text
        else:
            assert not all(pieces.spells(np.frombuffer(i, "<u2"), p.encode()) for i, p in zip(ids, parts))


def written(spark, docs, **sizes):
    path = f"{Store(spark).folder}/files"
    token_files.write_files(docs, path, file_text(BYTE_LEVEL), **sizes)
    return path


@pytest.mark.parametrize("sizes", [{}, {"shard_chars": 900, "segment_ids": 100}, {"shard_chars": 4000, "segment_ids": 1}])
def test_files_hold_every_document(spark, docs, prose, plain, sizes):
    rng = random.Random(1)
    rows = [(i * 7 - 100, t) for i, t in prose]
    rows += [(5, "x y z"), (5, "x y z"), (5, "other"), (None, "no id"), (None, None), (900, "a" * 30_000), (901, " \n\t"), (-(1 << 63), "<|endoftext|>")]
    rng.shuffle(rows)
    path = written(spark, docs(rows, 5), **sizes)
    found = token_files.read_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    sums = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4"))) for i, t in rows for ids in [plain(t) + [0]])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sums
    held = {(r.doc_id, tuple(r.ids)) for r in token_files.read_documents(spark, path).collect()}
    assert held == {(i, (*plain(t), 0)) for i, t in rows}
    some = token_files.read_documents(spark, path, [5, 900, 77_777]).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in some) == sorted((i, len(plain(t)) + 1) for i, t in rows if i in (5, 900))


def test_odd_and_empty_tables(spark, odd_docs, empty_docs):
    assert token_files.read_files(spark, written(spark, odd_docs, segment_ids=10)).count() == 9
    assert token_files.read_files(spark, written(spark, empty_docs)).collect() == []


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        list(token_files.segments(b"x" * 100))


def test_memory_holds_what_a_call_asks_for_and_what_returns():
    asked = []
    memo = Memo(lambda parts: asked.extend(parts) or [part.upper() for part in parts], 8)
    for turn in range(6):
        memo.learn({"often", f"once{turn}", f"twice{turn // 2}"})
        assert memo["often"] == "OFTEN" and memo[f"once{turn}"] == f"ONCE{turn}"
        assert len(memo) + len(memo.older) <= 8
    assert asked.count("often") == 1
    memo.learn({str(i) for i in range(50)})  # more than the limit
    assert [memo[str(i)] for i in range(50)] == list(map(str, range(50)))
    memo.learn(set())
    memo.learn({"x"})
    assert memo["x"] == "X" and len(memo) == 1
