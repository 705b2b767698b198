"""Alignment against a walk over all token pairs, and fragments against each other."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from eddymap.llm import alignment
from eddymap.llm.alignment import Fragment, compose
from eddymap.llm.queries import BYTE_LEVEL, PIECES_MODEL, file_text

PARTS = [" ", "\n", "\r", "  ", "a", "foo", "barrel;", "é", "\xa0", "<|endoftext|>", "<s>", "<0x0A>", "'s", "1234", "}\r", "😀",
         "the", "中文字", "unbelievable", "tokenization", "xq", "zzzz"]


@pytest.fixture(scope="module")
def model():
    with open(PIECES_MODEL, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def tokens(model):
    """Both token sequences with their byte ranges, the plain way; None where they do not spell the text."""
    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=model)
    # The byte-level alphabet: printable characters stand for themselves, the rest from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

    def spans(ids, data):
        out, at = [], 0
        for number, spelt in zip(ids, data):
            out.append((number, at, at + len(spelt)))
            at += len(spelt)
        return out

    def both(text):
        if not text:
            return None
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        a_bytes = [bytes(letter[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, second.id_to_piece(i)) for i in b)]
        want = (" " + text).encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            return None
        return spans(a, a_bytes), spans(b, b_bytes)
    return both


def expected(rows, tokens):
    found, counts = [], Counter()
    for doc_id, text in rows:
        pair = tokens(text)
        if pair is None:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = pair
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        shared = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if p < x[2] <= q) + "|" + ",".join(str(y[0]) for y in b if p < y[2] <= q)
                  for p, q in zip([0, *shared], shared)]
        found.append((doc_id, len(a), len(b), len(shared), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((i, na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
                   for i, na, nb, g, links, digest in found), key=str)


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 40, "fold": 2, "heavy": 30, "memo": 50}, {"range_bytes": 7, "fold": 3, "heavy": 0}])
def test_documents_match_all_token_pairs(docs, tokens, model, sizes):
    rows = list(enumerate(texts(4, 60, 60)))
    rows += [(100, None), (101, ""), (102, "a ▁ b"), (103, "x" * 700), (104, " "), (105, "\n"), (106, "foo  "), (None, "the barrel"),
             (None, None), (5, "twice the same"), (5, "twice the same"), (-(1 << 62), "中文 " * 90), (107, "a▁b " * 40), (108, "é ﬁ x")]
    found = alignment.align_documents(docs(rows), file_text(BYTE_LEVEL), model, **sizes)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()]
    assert sorted(got, key=str) == expected(rows, tokens)


def test_fragments_compose_in_any_order(tokens, model):
    rng = random.Random(9)
    own = alignment.aligner(file_text(BYTE_LEVEL), model)
    for text in texts(8, 40, 80):
        if tokens(text) is None:
            continue
        parts = [own.range(part, at, start, stop) for start, stop, at, part in alignment.byte_ranges(text, rng.randint(3, 40))]
        left = Fragment()
        for part in parts:
            left = compose(left, part)
        while len(parts) > 1:  # neighbours meet in random order
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [compose(parts[i], parts[i + 1])]
        one, whole = parts[0], compose(Fragment(cut=True), left)
        assert (one.prefix, one.text, one.groups, one.suffix, b"".join(one.links)) == (left.prefix, left.text, left.groups, left.suffix, b"".join(left.links))
        own.learn([text])
        plain = own.document(text)
        assert (whole.text, whole.groups, whole.n_a, whole.n_b) == (plain.text, plain.groups, plain.n_a, plain.n_b)
        assert sorted(np.frombuffer(b"".join(whole.links), "<u4")) == sorted(np.frombuffer(b"".join(plain.links), "<u4"))


def test_odd_and_empty_tables(odd_docs, empty_docs, model):
    assert alignment.align_documents(odd_docs, file_text(BYTE_LEVEL), model, range_bytes=1000).count() == 9
    assert alignment.align_documents(empty_docs, file_text(BYTE_LEVEL), model).collect() == []
