"""Phrases against counting every run of words in plain Python."""

import cProfile
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eddymap.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, window string, f int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows, longest, least, top):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {key: f for key, f in counts.items() if f >= least and len(key) > 2}
    out = []
    for (lang, *words), a in often.items():
        if any(o[0] == lang and len(o) - 1 > len(words) and f >= a and any(list(o[i:i + len(words)]) == words for i in range(1, len(o)))
               for o, f in often.items()):
            continue
        score, k = min((1000 * a * sizes[lang] // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, counts[lang, *words[:k]], counts[lang, *words[k:]], sizes[lang], score))
    found = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        found += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "Of", "a", "new", "york", "é", "x\x01y", "x", "中文", "x\x1f", "tab\tbed", "b\xa0c", "LONG"]
    out = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ". ", "\n", "\t", ";"]) for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            text += " in the new york times today"
        out.append((text, rng.choice(["en", "en", "en", "de", None, ""])))
    return out + [(None, "en"), ("", None), ("word " * 300, "fr"), ("one two three four five six seven " * 30, "fr"), ("x" * 20_000, "de")] + [("same same", "es")] * 12


@pytest.mark.parametrize("options", [{"least": 5}, {"least": 3, "range_windows": 40, "held": 10}, {"least": 12, "sketch_bits": 17, "top": 4},
                                     {"least": 2, "longest": 3, "range_windows": 15}])
def test_phrases_match_counting(spark, options):
    rows = corpus(options["least"])
    docs = spark.createDataFrame([(i, *r, 1, "w", 2) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    found = sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())
    assert found == expected(rows, options.get("longest", 5), options["least"], options.get("top", 2000))
    assert found


def test_equal_partitions_of_a_quicksort():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, (400, 4))
    codes[rng.random(400) < 0.3, 2:] = -1
    weights = rng.integers(1, 9, 400)
    want = Counter()
    for row, weight in zip(codes.tolist(), weights.tolist()):
        for depth in range(1, 5):
            if -1 not in row[:depth]:
                want[tuple(row[:depth])] += weight
    for least in (1, 20, 100):
        found = {tuple(codes[i, :d].tolist()): w for i, d, w in phrases.equal_partitions(codes, weights, least)}
        assert found == {k: w for k, w in want.items() if w >= least}


@pytest.mark.parametrize("few", [0, 7, 60, 1000])
def test_few_rows_are_sorted_at_once(few):
    rng = np.random.default_rng(few)
    codes = rng.integers(0, 3, (400, 3))
    codes[rng.random(400) < 0.3, 1:] = -1
    weights = rng.integers(1, 9, 400)
    for least in (1, 30):
        found = sorted((tuple(codes[i, :d].tolist()), w) for i, d, w in phrases.equal_partitions(codes, weights, least, few))
        want = Counter()
        for row, weight in zip(codes.tolist(), weights.tolist()):
            for depth in range(1, 4):
                if -1 not in row[:depth]:
                    want[tuple(row[:depth])] += weight
        assert found == sorted((k, w) for k, w in want.items() if w >= least)


def texts_of_distinct_words(n, seed=2):
    rng = random.Random(seed)
    return [" ".join(rng.randbytes(4).hex() for _ in range(n)) for _ in range(20)]


def test_the_work_on_a_text_does_not_call_python_for_each_word():
    def calls(n):
        texts = pa.array(texts_of_distinct_words(n))
        profile = cProfile.Profile()
        profile.runcall(lambda: phrases._Words(texts, pa.array(["en"] * 20)).slots(32))
        return sum(entry.callcount for entry in profile.getstats())
    assert calls(2000) < 2 * calls(20) + 200


def test_rare_words_and_pairs_reach_no_range_however_many_there_are(spark):
    """With 2 ** 17 counters, 200,000 words and their pairs, no counter was certainly rare; the corpus has one frequent pair."""
    rows = [(text, "en") for text in texts_of_distinct_words(10_000)] + [("new york", "en")] * 40 + [(None, "en"), ("x", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    often = phrases.often_counters(docs, 40, phrases.SKETCH_BITS)
    found = phrases.windows_of(docs, often, 5, phrases.SKETCH_BITS).groupBy("lang", "window", "often").agg(phrases.F.sum("n").alias("n")).collect()
    assert {lang: sum(r["n"] for r in found if r["lang"] == lang) for lang in ("en", "de")} == {"en": 200_080, "de": 1}
    windows = {(r["lang"], r["window"]): r["n"] for r in found if r["often"]}
    assert {("en", "new york"): 40, ("en", "york"): 40}.items() <= windows.items() and len(windows) < 10_000


def test_many_parts_of_a_counter_are_added(spark):
    docs = spark.createDataFrame([("a b", "en")] * 300, "text string, lang string").repartition(150)
    found = [phrases.often_counters(docs, least, 32, held=1).any() for least in (300, 301)]
    assert found == [True, False]


def test_products_beyond_64_bits(spark):
    over, under = phrases._exact(phrases.F.lit(1000).cast("decimal(4,0)"), "a", "n"), phrases._exact("l", "r")
    row = spark.createDataFrame([(10**14, 10**18, 10**15, 10**12)], "a long, n long, l long, r long")
    assert row.select(over.alias("over"), under.alias("under")).selectExpr("over div under AS s").first()["s"] == 10**8


def test_odd_and_empty_tables(spark, odd_docs, empty_docs):
    assert phrases.collocations(odd_docs.withColumn("lang", phrases.F.lit(None).cast("string")), least=2).count() > 0
    assert phrases.collocations(empty_docs.withColumn("lang", phrases.F.lit("en"))).collect() == []
