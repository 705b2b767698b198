"""The operators applied to the test tables, and the same as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddymap.llm import (
    alignment, fingerprints, jaccard_join, line_crf, mixing, phrases, pieces, pii, secrets, substring_dedup, token_files,
    toxicity, url_filter,
)
from eddymap.llm.common import table
from eddymap.store import Store


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


#: The public model that texts are encoded with; see /opt/tokenizers/README.md.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and the text its ids decode to, as digests."""
    encoded = pieces.encode_documents(documents(spark, sf_dir), PIECES_MODEL)
    decoded = pieces.decode_documents(encoded.select("doc_id", "ids"), PIECES_MODEL)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_crf.apply_rules(docs, line_crf.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


# Fixed values of the URL query: (host, path, verdict), and the names whose pages make up the list.
PREFIXES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
            ("net", "/es/", "block"), ("net", "/fr/", "block"))
LISTED_NAMES = "(^|[.-])(casino|adult|bets|spam)([.-]|$)"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    prefixes = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, PREFIXES)) + " AS t(host, path, verdict)")
    listed = pages.filter(url_filter.host_of(F.col("url")).rlike(LISTED_NAMES)).select(
        url_filter.canonical(F.col("url")).alias("key")).distinct()
    return url_filter.judge(pages, prefixes, listed)


#: The byte-level vocabulary of the queries on tokens.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(PIECES_MODEL, "rb") as file:
        model = file.read()
    return alignment.align_documents(documents(spark, sf_dir), file_text(BYTE_LEVEL), model)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files to the shared folder, and what the files say of them."""
    path = f"{Store(spark).folder}/token-files"
    token_files.write_files(documents(spark, sf_dir), path, file_text(BYTE_LEVEL))
    return token_files.read_files(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_secret_scan, op3_personal_data, op4_fingerprints, op5_mix_sources,
        op6_sentencepiece, op7_quality_rules, op8_toxicity, op9_jaccard_join, op10_url_filter, op11_token_alignment,
        op12_phrases, op13_token_files)
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id,
                   coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
        windows AS MATERIALIZED (
            SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
            FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM docs)),
        again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
        covered AS (SELECT DISTINCT r, i + k AS pos FROM windows SEMI JOIN again USING (h), range(35) AS t(k)),
        placed AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
                 FROM placed ANTI JOIN covered USING (r, pos) GROUP BY r)
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE docs AS MATERIALIZED (
            SELECT doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
            FROM documents),
        sets AS MATERIALIZED (
            SELECT doc_id, list_sort(list_distinct(CASE
                WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingles
            FROM docs),
        alike AS MATERIALIZED (SELECT min(doc_id) AS id, shingles, len(shingles) AS n FROM sets
                               WHERE len(shingles) > 0 GROUP BY shingles),
        flat AS MATERIALIZED (SELECT id, n, unnest(shingles) AS s FROM alike),
        links AS MATERIALIZED (
            SELECT a.id AS a, b.id AS b FROM flat a JOIN flat b ON a.s = b.s AND a.id <> b.id
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT id, id AS other FROM alike UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
        lowest AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
        SELECT d.doc_id, len(d.shingles) AS n_shingles, coalesce(low, d.doc_id) AS component_id
        FROM sets d LEFT JOIN alike a ON a.shingles = d.shingles LEFT JOIN lowest USING (id)""",
    "op10_url_filter": rf"""
        WITH parsed AS (
            SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                       '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        named AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$|\.$', ''), '^www\.', '')
                      || regexp_replace(path, '/+$', '') AS canon FROM parsed),
        listed AS (SELECT DISTINCT canon FROM named WHERE regexp_matches(host, '{LISTED_NAMES}')),
        rules AS (SELECT * FROM (VALUES {", ".join(map(str, PREFIXES))}) AS t(h, p, says)),
        ruled AS (
            SELECT page_id, url, max_by(h || p, len(h || p)) AS rule, max_by(says, len(h || p)) AS says
            FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            WHERE contains(url, '://') GROUP BY page_id, url)
        SELECT n.page_id, host, path, rule,
               coalesce(says, CASE WHEN listed.canon IS NOT NULL AND contains(n.url, '://') THEN 'block' ELSE 'allow' END) AS verdict
        FROM named n LEFT JOIN ruled r ON r.page_id = n.page_id AND r.url = n.url LEFT JOIN listed ON listed.canon = n.canon""",
    "op12_phrases": r"""
        WITH texts AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM texts),
        sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
        counts AS MATERIALIZED (
            SELECT lang, phrase, k, count(*) AS f FROM (
                SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
                FROM pieces, range(1, 6) AS t(k) WHERE len(words) >= k)
            GROUP BY ALL HAVING count(*) >= 100),
        cuts AS (
            SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS c FROM counts WHERE k > 1),
        scored AS (
            SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, c.c,
                   ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.c], ' ')
            JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.c + 1:], ' ')
            JOIN sizes s ON s.lang = c.lang),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        kept AS (
            SELECT * FROM weakest w WHERE NOT EXISTS (
                SELECT 1 FROM counts o WHERE o.lang = w.lang AND o.f >= w.a AND length(o.phrase) > length(w.phrase)
                    AND contains(' ' || o.phrase || ' ', ' ' || w.phrase || ' ')))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept QUALIFY rank <= 2000""",
}
