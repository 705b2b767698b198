"""Substring dedup and the Jaccard join against brute force."""

import cProfile
import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eddymap.llm import jaccard_join, substring_dedup
from eddymap.llm.hashing import Spans, mixed, shingle_hashes
from eddymap.store import Store


def test_span_hashes_do_not_depend_on_the_place():
    words = mixed(np.arange(1, 50, dtype=np.uint64))
    long, short = Spans(np.concatenate([words, words])), Spans(words[5:20])
    at = np.array([5, 54])
    assert len(set(long.hashes(at, at + 15).tolist() + short.hashes(np.array([0]), np.array([15])).tolist())) == 1
    assert len(set(shingle_hashes(words, 3).tolist())) == 47


def passages(rows, width):
    count, words = Counter(), {}
    for at, (_, text) in enumerate(rows):
        w = words[at] = (text or "").encode().split()
        count.update(tuple(w[k:k + width]) for k in range(len(w) - width + 1))
    for at, (doc_id, _) in enumerate(rows):
        w = words[at]
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k:k + width])] > 1:
                gone.update(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        yield doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize("options", [{}, {"crowded": 1, "shard_rows": 5, "phrases": 3}, {"bits": 64}])
def test_repeats_are_removed(docs, prose, options):
    rows = prose + [(200, "again and again " * 30), prose[3]]
    found = substring_dedup.remove_repeats(docs(rows), width=35, **options).collect()
    assert sorted(map(tuple, found)) == sorted(passages(rows, 35))


def test_repeats_of_odd_and_empty_tables(odd_docs, empty_docs):
    found = {(r[0], r[1]): r[2] for r in substring_dedup.remove_repeats(odd_docs, keep_text=True).collect()}
    assert found == {(None, 0): 0, (1, 0): 0, (2, 0): 0, (3, 3): 0, (4, 1): 0, (5, 20_000): 20_000, (None, 3): 0, (6, 2): 0}
    assert substring_dedup.remove_repeats(empty_docs).collect() == []


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components(rows, cover):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(rows)))
    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= cover * len(x | y):
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label):
        least[v] = min(least.get(v, i), i)
    return sorted((i, len(s), least[v]) for (i, s), v in zip(sets, label))


@pytest.mark.parametrize("cover,options", [
    (85, {}), (85, {"least_frequent": 2}), (50, {"least_frequent": 2, "long_list": 2, "block": 3})])
def test_components_of_links(docs, prose, cover, options):
    found = jaccard_join.link_components(docs(prose), cover=cover, **options)
    assert sorted(tuple(r)[:3] for r in found.collect()) == components(prose, cover)


def test_small_sets_meet_through_subsets():
    rng = np.random.default_rng(3)
    for n in range(1, 15):
        a = np.sort(rng.integers(0, 1 << 60, n).astype(np.uint64))
        for big in range(n, 100 * n // 85 + 1):
            b = np.sort(np.r_[a, rng.integers(0, 1 << 60, big - n).astype(np.uint64)])
            assert set(jaccard_join.subset_keys(a, 85, 20)) & set(jaccard_join.subset_keys(b, 85, 20))
        assert len(jaccard_join.subset_keys(a, 85, 40)) == jaccard_join.subset_count(n, 85)


def test_sets_of_a_batch_match_sets_of_words(prose):
    odd = [None, "", " \t\n", "a", "A  b", "a\x0bb\x0cc\rd", "x" * 200 + " " + "x" * 200 + "y", "é Ü", "\x00", "\x00 \x00\x00", "a\xa0b c",
           " lead", "trail ", "a b c d e " * 9, "eightful eightfully eightful"]
    texts = odd + [t for _, t in prose]
    found = jaccard_join.sets_of(pa.array(texts, pa.string()), 4)
    known = {}
    for text, elements in zip(texts, found):
        assert len(elements) == len(shingles(text))
        assert elements.tolist() == sorted(set(elements.tolist()))
        assert elements.tolist() == jaccard_join.sets_of(pa.array([text], pa.string()), 4)[0].tolist()
        assert known.setdefault(shingles(text), elements.tolist()) == elements.tolist()
    assert len(set(map(tuple, known.values()))) == len(known)


def test_the_work_on_a_text_does_not_call_python_for_each_word():
    rng = random.Random(2)

    def calls(n):
        texts = pa.array([" ".join(rng.randbytes(4).hex() for _ in range(n)) for _ in range(20)])
        profile = cProfile.Profile()
        profile.runcall(jaccard_join.sets_of, texts, 4)
        return sum(entry.callcount for entry in profile.getstats())
    assert calls(2000) < 2 * calls(20) + 200


def test_heads_are_the_rarest_elements():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (0, 1, 3, 80, 300, 300)]
    frequent = np.sort(rng.permutation(500)[:400].astype(np.uint64))
    bounds = np.r_[0, np.cumsum([len(s) for s in sets])]
    lengths = np.array([0, 1, 0, 12, len(sets[4]), 40])
    for known in (frequent, frequent[:0]):
        found = jaccard_join.prefixes_of(np.concatenate(sets), bounds, jaccard_join.Frequent(known), lengths)
        want = [sorted(s.tolist(), key=lambda x: (x in known, x))[:n] for s, n in zip(sets, lengths)]
        assert found.tolist() == [x for w in want for x in w]


def test_overlaps_of_every_two_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 30, 50, 50, 9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (np.array(want) - jaccard_join.overlaps(sets, 7))[~np.eye(6, dtype=bool)].tolist() == [0] * 30


def test_links_of_odd_and_empty_tables(odd_docs, empty_docs):
    found = sorted((r[0] or -1, r[1], r[2] or -1) for r in jaccard_join.link_components(odd_docs).collect())
    assert found == [(-1, 0, -1), (-1, 1, -1), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 4), (5, 1, 5), (6, 1, 6)]
    assert jaccard_join.link_components(empty_docs).collect() == []


def test_the_joins_tables_go_when_they_have_been_read(spark, docs, prose):
    store = Store(spark)
    found = jaccard_join.link_components(docs(prose), store=store)
    assert [name.split("-", 1)[1] for name in os.listdir(store.folder.removeprefix("file:"))] == ["join-components"]
    assert found.count() == len(prose)
