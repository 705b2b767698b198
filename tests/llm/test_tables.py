"""Mixing, URL filter and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from eddymap.llm import mixing, url_filter

SF = "/root/testdata/sf0.001"


def shared(sizes, weights, cap):
    """Share the sum of ``sizes`` by weight, again and again, until none is above its cap."""
    target, total, open_ = {}, float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = (total - sum(target.values())) / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] >= cap * sizes[i]}
        if not over:
            target |= {i: unit * weights[i] for i in open_}
            break
        target |= {i: float(cap * sizes[i]) for i in over}
        open_ -= over
    return target


def test_targets_and_words_taken(docs):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * min(300, int(rng.paretovariate(1.1) * 8) - 8)), rng.choice(["a", "b", "é", None, "zz", "b", "b"]))
            for i in range(1500)]
    rows += [(2000 + i, "one two", "tiny") for i in range(3)] + [(3000, None, "none"), (5, rows[5][1], rows[5][2])]
    found = mixing.mix(docs(rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs(rows, 7)).collect()))
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = shared(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for i, name in enumerate(names):
        own = [r for r in found if r["source"] == name]
        assert all(r["source_size"] == sizes[i] and r["target"] == pytest.approx(want[i]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[i]) <= max(3, 0.01 * want[i]), name
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 for r in found)
    assert len(found) == len(rows)


def test_mixing_reads_written_steps(docs):
    """What the mix reads several times is written, or its plan grows beyond what the driver holds."""
    table = docs([(i, "w " * (5 + i % 7), "ab"[i % 2]) for i in range(200)])
    plan = mixing.mixed_documents(table)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") <= 4


def test_mixed_rows_are_whole(docs, odd_docs, empty_docs):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "ab"[i % 2]) for i in range(200)] + [(1, "w w w w w w", "b")] * 2
    table = docs(rows)
    taken = {}
    for r in mixing.mix(table).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copies"]
    counts = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(table).groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    assert mixing.mix(odd_docs).count() == 9
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mix(empty_docs).collect() == [] and mixing.mixed_documents(empty_docs).collect() == []


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def judged(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    key = host.removeprefix("www.") + path.rstrip("/")
    return host, path, rule, verdict or ("block" if key in listed else "allow")


def test_urls(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.net/es/?q",
            "http://x.org/bad/", "ftp://WWW.x.org/bad#f", "http://com?x", "http://com/a://b", "http://É.com/"]
    urls += ["http://" + rng.choice(["", "www.", "m."]) + rng.choice(["example.com", "b.net", "x.org"]) + rng.choice(
        ["/en/1", "/es/2", "/bad", "/bad/", "", "/", "?en/"]) for _ in range(300)]
    listed = {"x.org/bad", "b.net"}
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, block int, rule string")
    found = url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"),
                             spark.createDataFrame([(k,) for k in listed] + [(None,)], "key string")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {i: judged(u, listed) for i, u in enumerate(urls)}
    nothing = url_filter.judge(pages.limit(0), spark.createDataFrame([], "host string, path string, verdict string"),
                               spark.createDataFrame([], "key string"))
    assert nothing.collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        seen.append((docs.count(), docs.select("doc_id").distinct().count()))
    assert 150 < seen[1][0] <= seen[0][0] <= 200 and seen[1][0] == seen[1][1] == seen[2][0]
    assert docs.filter("text like '%@mail%.example.com%'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == seen[3][0] and last.filter(F.col("n_pieces") == 0).count() == docs.filter("text = ''").count()


def test_pipeline_joins_near_copies_and_null_ids(spark, docs):
    import corpus_pipeline

    words = [f"w{i}" for i in range(50)]
    base, near = " ".join(words), " ".join([*words[:25], "other", *words[26:]])  # 41 of 51 five-word shingles, 43 of 51 of four
    rows = [(1, base), (2, near), (3, "quite another text of six words"), (None, base), (None, near), (None, "only under null ids here"),
            (None, "only under null ids here"), (4, ""), (5, None), (None, ""), (None, "")]
    left = corpus_pipeline.one_of_each_group(spark, docs(rows), "")
    assert left.columns == ["doc_id", "text", "source"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [
        (1, base), (3, rows[2][1]), (4, ""), (5, None), (None, "only under null ids here"), (None, "")]))
