"""Fingerprints, pieces, quality rules and toxicity."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from eddymap.llm import fingerprints, line_crf, pieces, toxicity
from eddymap.llm.queries import PIECES_MODEL


def test_prefix_hashes_answer_span_questions():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(1, 60))) for _ in range(2))
        x, y = fingerprints.Prefix(a), fingerprints.Prefix(b)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        common = next((k for k in range(99) if a[i + k:i + k + 1] != b[j + k:j + k + 1] or i + k >= len(a) or j + k >= len(b)), 0)
        assert x.extension(i, y, j) == common
        assert x.equal(i, y, j, 1) == (a[i] == b[j])


def test_fingerprints_of_edited_texts(docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc dé😀") for _ in range(rng.randint(0, 300)))) for i in range(120)] + [(500, None), (7, "tie")]
    found = fingerprints.fingerprint_documents(docs(rows), rows_per_part=10).collect()
    order = sorted(((t or "") for i, t in rows if i != 7), key=str) and sorted(rows, key=lambda r: (-r[0], hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        want[i, len(t)] = hashlib.sha256(edited.encode()).hexdigest()
    assert {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in found} == want
    long = [r for r in found if r["n_chars"] > 50]
    assert all(0.3 < r["near_edited"] <= 1 and 0 <= r["near_next"] < r["near_edited"] for r in long)


def test_likeness_sees_the_inside():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefg hijklmé😀") for _ in range(n))
    near = lambda a, b: fingerprints.likeness(fingerprints.Fingerprint(a), fingerprints.Fingerprint(b))
    body = text(8000)
    assert near("One title\n" + body + "\nfoot", "Another heading\n" + body + "\nthe end") > 0.95
    assert near(body, body[:3000] + "#" + body[3001:]) > 0.95
    assert near(body, text(8000)) < 0.05 and near("x" * 5000, "y" + "x" * 5000 + "y") > 0.9
    for n in (0, 1, 15, 16, 17, 400, 5000):
        for made in (text(n), "x" * n):
            found = fingerprints.Fingerprint(made)
            sizes = np.diff(found.cuts)
            assert sizes.sum() == n and (sizes <= fingerprints.LONGEST).all() and (sizes[:-1] >= fingerprints.WINDOW).all()


def test_fingerprints_of_odd_and_empty_tables(odd_docs, empty_docs):
    found = fingerprints.fingerprint_documents(odd_docs).collect()
    assert len(found) == 9 and all(0 <= r["near_next"] <= 1 for r in found)
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 3}) == 1
    assert fingerprints.fingerprint_documents(empty_docs).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    with open(PIECES_MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def test_pieces_are_optimal_in_chunks_too(vocabulary):
    rng = random.Random(5)
    for _ in range(120):
        alphabet = rng.choice(["the and ing", "abc", "a b\n", "über ▁x", "  in", "\n\t漢字 the"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 250)))
        ids = pieces.encode_texts(vocabulary, [text])[0]
        whole = pieces.marked(text)
        best = vocabulary.forward(whole, 0, len(whole))[0][len(whole)]
        assert int(vocabulary.worth[ids].sum()) == best
        assert pieces.decode_ids(vocabulary, ids.tolist()) == text


def test_documents_round_trip(docs, odd_docs, empty_docs, vocabulary):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("the ing\nabß▁漢") for _ in range(n))) for i, n in enumerate([0, 1, 39, 40, 41, 95, 500, 2000])]
    rows += [(20, "x" * 700), (21, None), (22, " " * 300)]
    encoded = pieces.encode_documents(docs(rows), PIECES_MODEL, chunk=40)
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, PIECES_MODEL).collect()}
    assert decoded == {i: t or "" for i, t in rows}
    for r in encoded.collect():
        text = dict(rows)[r["doc_id"]] or ""
        whole = pieces.marked(text) if text else ""
        assert r["score"] == (vocabulary.forward(whole, 0, len(whole))[0][len(whole)] if text else 0)
    assert pieces.encode_documents(odd_docs, PIECES_MODEL).count() == 9
    assert pieces.encode_documents(empty_docs, PIECES_MODEL).collect() == []


def test_matrices_combine_associatively(vocabulary):
    texts = ["the thing in", "gxyz" * 6, "and more of it"]
    a, b, c = (pieces.transfer(vocabulary, pieces.blanked(t), len(t) - 8) for t in texts)
    left, right = pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c))
    assert (np.where(left < pieces.NONE // 2, 0, left) == np.where(right < pieces.NONE // 2, 0, right)).all()


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(3)
    field = line_crf.LineField(rng.normal(size=(2, line_crf.FEATURES)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, line_crf.FEATURES))
    score = lambda y: sum(field.emit[k] @ v for k, v in zip(y, x)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))
    assert tuple(field.decode(x.tolist())) == max(itertools.product((0, 1), repeat=7), key=score)


def test_repeated_words_by_brute_force():
    rng = random.Random(8)
    for _ in range(80):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        count = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if count[tuple(words[k:k + 5])] > 1 for j in range(5)}
        assert line_crf.repeated_words(words) == len(inside)


def test_quality_rules_learn_from_labels(spark, docs, odd_docs, empty_docs):
    rng = random.Random(9)
    good = [" ".join(rng.choices(["sun", "moon", "tree", "rain", "wind", "stone", "fire"], k=60)) + "." for _ in range(60)]
    bad = ["\n".join(" ".join(f"{w}%%%" for w in rng.choices(["buy", "now", "win", "free", "deal", "shop", "sale"], k=12)) for _ in range(5))
           for _ in range(60)]
    table = docs(list(enumerate(good + bad)))
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, quality int")
    field = line_crf.fit_on_labels(table, labels)
    kept = {r["doc_id"]: r["kept"] for r in line_crf.apply_rules(table, field).collect() if not r["base_failed"]}
    assert all(kept[i] == (i < 60) for i in kept) and len(kept) > 90
    row = line_crf.judge_document("a #b\na #b\n\n|c| d", field)
    assert row[:6] == (6, 10, 4, 1, 0, True)
    assert line_crf.apply_rules(odd_docs, field).filter("kept").count() == 0
    assert line_crf.apply_rules(empty_docs, line_crf.fit_on_labels(empty_docs, labels)).collect() == []


def brute_kernel(s, t):
    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.LENGTH):
        for b in itertools.combinations(range(len(t)), toxicity.LENGTH):
            if [s[i] for i in a] == [t[j] for j in b]:
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def lcs(s, t):
    row = [0] * (len(t) + 1)
    for c in s:
        new = [0]
        for j, d in enumerate(t):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_kernel_and_common_lengths_by_brute_force():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    rows = toxicity.codes(words)
    marks = ["abcabd", "dcba", "aabbccdd", "abcdabcdab"] * 3
    for k, found in toxicity.CommonLengths(marks).of(rows):
        assert found.tolist() == [lcs(w, marks[k]) for w in words]
    other = toxicity.codes(words[::-1])
    assert np.allclose(toxicity.kernel(rows, other), [brute_kernel(a, b) for a, b in zip(words, words[::-1])])


def test_toxicity_holds_out_and_forgives_insertions(spark, docs, odd_docs, empty_docs):
    rng = random.Random(3)
    common = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(600):
        words = rng.choices(common, k=30)
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["blockhead", "dumbklutz", "foolzwump"])
        rows.append((i, " ".join(words) + "."))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs(rows), model).collect()}
    held = [i for i in found if found[i]["held_out"]]
    assert 80 < len(held) < 160
    assert sum(found[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    tried = docs([(1, "a bl-ockhead here"), (2, "you b l o c k h e a d now"), (3, "plain words only")])
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(tried, model).collect()}
    assert scored[2] > 0.9 and scored[1] > 2 * scored[3] and scored[3] < 0.2
    assert 3 in {r["doc_id"] for r in toxicity.clean_documents(tried, model).collect()} <= {1, 3}
    assert toxicity.score_documents(odd_docs, model).filter("predicted = 0").count() == 9
    nothing = toxicity.fit(empty_docs, labels)
    assert toxicity.score_documents(empty_docs, nothing).collect() == []


def test_toxicity_reads_altered_insults(spark, docs):
    rng = random.Random(3)
    common = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(600):
        words = rng.choices(common, k=30)
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["blockhead", "idiot", "foolzwump"])
        rows.append((i, " ".join(words) + "."))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    tried = ["an i-d-i-o-t here", "an id1ot here", "a bl-ockhead here", "a b-l-o-c-k-h-e-a-d", "an idi.ot", "plain words only", "a rainy-tin inter-state"]
    memo = toxicity.Memo(toxicity.Landmarks(model.landmarks))
    scores = toxicity._scores(memo, model, tried)
    assert min(scores[:5]) >= 0.5 and max(scores[5:]) < 0.5
    forms = ["i-d-i-o-t", "id1ot", "idxiot"]
    values = toxicity.Landmarks(["idiot"]).values(forms)
    for i, form in enumerate(forms):
        own = brute_kernel(form, form) * brute_kernel("idiot", "idiot")
        assert values[i][0] == pytest.approx(brute_kernel(form, "idiot") / own ** 0.5)
    # One letter inserted, doubled or left out, read by the kernel alone; nine of ten and more count.
    spoilt = [w[:i] + c + w[i:] for w in ("blockhead", "idiot", "foolzwump") for i in range(1, len(w)) for c in ("x", w[i])]
    spoilt += [w[:i] + w[i + 1:] for w in ("blockhead", "foolzwump") for i in range(1, len(w) - 1)]
    tried = [f"what a {w} here" for w in spoilt]
    memo.learn({x for t in tried for x in t.split()})
    scores = toxicity._scores(memo, model, tried)
    assert sum(x >= 0.5 for x in scores) >= 0.9 * len(scores)


def test_fingerprints_take_the_smallest_id(spark, docs):
    rows = [(-(1 << 63), "lowest id of all"), ((1 << 63) - 1, "highest id of all"), (0, "in between")]
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs(rows)).collect()}
    assert set(found) == {i for i, _ in rows}


def test_a_step_of_the_line_field_follows_the_likelihood():
    """One round moves the weights along the gradient of the likelihood summed over all label sequences."""
    numbers = np.random.default_rng(4)
    sequences, labels = [numbers.random((n, line_crf.FEATURES)) for n in (3, 1, 5, 3)], [1, 0, 0, 1]

    def likelihood(weights):
        emit, step = weights[:-4].reshape(2, -1), weights[-4:].reshape(2, 2)

        def score(x, path):
            return sum(x[t] @ emit[k] for t, k in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path))

        return sum(score(x, [y] * len(x)) - np.logaddexp.reduce([score(x, p) for p in itertools.product((0, 1), repeat=len(x))])
                   for x, y in zip(sequences, labels)) / sum(map(len, sequences))

    before = line_crf.fit(sequences, labels, rounds=2, decay=0.0)
    after = line_crf.fit(sequences, labels, rounds=3, decay=0.0)
    at = np.concatenate([before.emit.ravel(), before.step.ravel()])
    moved = np.concatenate([(after.emit - before.emit).ravel() / 5.0, (after.step - before.step).ravel() / 0.5])
    tiny = np.eye(len(at)) * 1e-6
    slopes = [(likelihood(at + d) - likelihood(at - d)) / 2e-6 for d in tiny]
    assert np.allclose(moved, slopes, atol=1e-6)
