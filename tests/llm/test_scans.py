"""Secrets and personal data against brute force."""

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from eddymap.llm import pii, secrets

SECRET = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def told(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def texts(seed, alphabets, extra):
    rng = random.Random(seed)
    made = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    made += ["".join(rng.choices(a, k=rng.randint(1, 70))) for a in alphabets for _ in range(150)]
    return [None, "", *made, *extra]


def test_fixed_secret_patterns(docs):
    rows = list(enumerate(texts(1, [["token", "=", " ", '"', "aB1", "API_KEY", ":"], "0af", ["AKIA", "AB", "9", "é"]],
                                ["Secret: 'abc.def-1' x", "token=short api_key = longer1", "f" * 5000, "ſecret=abcdefgh"])))
    found = {r["doc_id"]: r for r in secrets.scan_secrets(docs(rows)).collect()}
    for i, text in rows:
        spans = []
        for k, (kind, pattern) in enumerate(SECRET.items()):
            for m in pattern.finditer(text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    spans.append((m.start(), k, m.end()))
        assert found[i]["base_sha256"] == hashlib.sha256(told(spans, list(SECRET)).encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in SECRET] == [sum(s[1] == n for s in spans) for n in range(3)]


def test_random_tokens_are_added_and_ordinary_ones_are_not(docs):
    rng = random.Random(5)
    token = lambda: "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=40))
    rows = [(i, f"key {token()} end") for i in range(40)]
    rows += [(100 + i, "an " + "".join(rng.choices(["tion", "ing", "the", "er"], k=12)) + " word " + "7" * 30) for i in range(200)]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs(rows)).collect()}
    assert sum(found[i] == "random:4:44" for i in range(40)) >= 35
    assert sum("random" in found[i] for i in range(100, 300)) <= 4  # about one in twenty of what is added


def test_p_values_are_even_for_random_tokens():
    rng = random.Random(2)
    for alphabet in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits + "+/"):
        values = [secrets.p_random("".join(rng.choices(alphabet, k=32))) for _ in range(600)]
        assert all(abs(sum(v > t for v in values) / 600 - (1 - t)) < 0.09 for t in (0.1, 0.5, 0.8))


def test_secrets_of_odd_and_empty_tables(odd_docs, empty_docs):
    assert {r["spans"] for r in secrets.scan_secrets(odd_docs).collect()} == {""}
    assert secrets.scan_secrets(empty_docs).collect() == []


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        total = sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_fixed_personal_patterns(docs):
    rows = list(enumerate(texts(4, ["a@b.c-_ é😀", "0123 .-+()@a", "12.25 0", "+1 (2)34-", "@.a", "4 0-1"],
                                ["1" * 30_000, "a" * 30_000 + "@", "1 " * 9000, "4111 1111 1111 1111 or 4111111111111112",
                                 "000.000.000.256 0.0.0.0255", "a@b.c_d@e.f", "+1 (743) 555-3824, me@x.org, 10.0.0.1"])))
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs(rows)).collect()}
    for i, text in rows:
        spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PERSONAL.items())
                 for m in re.finditer(p, text or "") if passes(kind, m[0])]
        assert found[i]["base_sha256"] == hashlib.sha256(told(spans, list(PERSONAL)).encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in PERSONAL] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(told(spans, list(PERSONAL)).split(",")) <= set(found[i]["spans"].split(",")) | {""}


def test_trees_learn_and_redaction_keeps_the_rest(docs):
    cells = [(a, b, 0, 0, 0, 0, 0) for a in range(3) for b in range(4)]
    good = [9 if (c[0] == 2) != (c[1] > 1) else 0 for c in cells]
    trees = pii.boost(cells, good, [9 - g for g in good])
    assert all((sum(pii._apply(t, c) for t in trees) > 0) == (g > 0) for c, g in zip(cells, good))
    table = docs([(1, "mail me@x.org or +1 (743) 555-3824."), (2, None), (3, "clean é")])
    redactor = pii.fit(table.select(pii.candidates(F.coalesce("text", F.lit(""))).alias("found")))
    assert sorted(map(tuple, pii.redact(table, redactor).collect())) == [
        (1, "mail [PII] or [PII].", "s"), (2, None, "s"), (3, "clean é", "s")]


def test_personal_data_of_odd_and_empty_tables(odd_docs, empty_docs):
    assert {r["spans"] for r in pii.find_personal_data(odd_docs).collect()} == {""}
    assert pii.find_personal_data(empty_docs).collect() == []
    kept = pii.redact(odd_docs, pii.Redactor([], {}))
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))


def test_generators_end_on_a_digit(docs):
    rows = list(enumerate(["555-123-4567 now", "555-123-4567.", "123-45-6789 is", "call (555) 123-4567", "555-123-4567 555-987-6543",
                           "1-555-123-4567)", "1" * 40, f"{'4' * 16} {'5' * 16}"]))
    found = docs(rows).select("doc_id", F.explode(pii.candidates(F.col("text"))).alias("c")).filter(f"c.kind = {pii.KINDS.index('number')}")
    spans = {i: sorted(r["c"]["start"] for r in found.collect() if r["doc_id"] == i) for i, _ in rows}
    stops = {i: sorted(r["c"]["stop"] for r in found.collect() if r["doc_id"] == i) for i, _ in rows}
    assert spans == {0: [0], 1: [0], 2: [0], 3: [5], 4: [0, 13], 5: [0], 6: [], 7: [0, 17]}
    assert stops == {0: [12], 1: [12], 2: [11], 3: [19], 4: [12, 25], 5: [14], 6: [], 7: [16, 33]}


def test_local_phones_and_obfuscated_addresses_are_added(docs):
    rng = random.Random(12)
    n = lambda k: "".join(rng.choices(string.digits, k=k))
    rows = [(i, f"the +1 ({n(3)}) 555-{n(4)} and name.{n(2)}@mail{n(1)}.example.com rest") for i in range(60)]
    rows += [(100 + i, f"an {n(16)} of ab{n(8)}cd and 300.{n(2)}.{n(2)}.{n(2)} rest") for i in range(60)]
    rows += [(200 + i, f"so 555-{n(3)}-{n(4)} now") for i in range(20)] + [(300 + i, f"so (555) {n(3)}-{n(4)}.") for i in range(20)]
    rows += [(400, "write john.doe [at] example [dot] org now"), (401, "write jane at example dot com now"),
             (402, "look at the dot product now"), (403, "token 1234567890ab")]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs(rows)).collect()}
    assert all(found[200 + i] == "number:3:15" for i in range(20))
    assert all(found[300 + i] == "number:3:17" for i in range(20))
    assert found[400] == "contact:6:37" and found[401] == "contact:6:29" and found[402] == found[403] == ""
    assert not any("number" in found[100 + i] for i in range(60))


def test_parts_of_long_texts_hold_the_same_candidates(docs):
    rng = random.Random(3)
    bits = ["+49 30 1234567", "call", "at", "dot", "com", "joe@x.org", "joe at foo dot com", "joe (at) foo (dot) com", "555-123-4567",
            "4111 1111 1111 1111", "10.0.0.1", ",", "ü", "\n", "(030) 123", "x+y", "+", "word", "atlas", "dotted", "[at]", "é7", "12345678", "-", "."]
    rows = [(i, rng.choice([" ", "", " "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 120)))) for i in range(150)]
    text = F.col("text")
    found = docs([*rows, (998, ""), (999, "1 " * 500)]).select(
        text, F.array_sort(pii.candidates(text, 32)).alias("parted"), F.array_sort(pii.candidates(text, 1 << 20)).alias("whole"),
        pii._parts(text, 32).alias("parts")).collect()
    assert all(r["parted"] == r["whole"] for r in found)
    assert all("".join(p["body"] for p in r["parts"]) == r["text"] for r in found)
    assert sum(len(r["parts"]) for r in found) > 1000 and sum(len(r["whole"]) for r in found) > 1000


def test_a_long_text_of_phone_numbers(docs):
    n, text = 4000, " ".join(f"call +49 30 {1000000 + i} now" for i in range(4000))
    table = docs([(1, text), (2, "clean")])
    found = {r["doc_id"]: r for r in pii.find_personal_data(table).collect()}
    assert found[1]["n_phone"] == n and found[2]["spans"] == ""
    redactor = pii.fit(table.select(pii.candidate_parts(F.col("text")).alias("found")))
    assert sorted(r["text"] for r in pii.redact(table, redactor).collect()) == [" ".join(["call [PII] now"] * n), "clean"]
