"""Registered queries of the text operators over the given tables, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshade.llm.common import keyed_texts, same_document, without_white
from rainshade.llm.exact import exact_duplicates
from rainshade.llm import html, licenses, lines, mixing, packing, quality, search, spelling, suffixes, urls
from rainshade.llm.fingerprints import edited_fingerprints
from rainshade.llm.simhash import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exact_duplicates(docs)
    digests = keyed_texts(docs, "doc_id", "text").select("doc_id", "version", F.sha2(without_white(F.col("text")), 256).alias("text_sha256")).distinct()
    return found.alias("f").join(digests.alias("d"), same_document("f", "d")).select("f.doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op2_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(text), doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (norm)
"""


@_query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents")).drop("version")


@_query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")), n_grades=3)
    scored = quality.scored(docs, model, grade=2)
    return scored.select("doc_id", F.round("_quality.expected_grade", 6).alias("expected_grade"), F.round("_quality.tail_probability", 6).alias("tail_probability"),
                         quality.selected().alias("selected"))


@_query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "_mix.source", "_mix.lang", "_mix.topic", "_mix.n_tokens", F.round("_mix.probability", 9).alias("probability"), "_mix.sampled")


def _mixing_sql() -> str:
    """The same raking pass by pass, with the scale found in the order of falling rates."""
    parts = [r"""
t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
             len(list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]'), lambda x: x <> '')) AS n_tokens FROM documents)""",
             """
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(lower(text), 'licens') OR contains(lower(text), 'copyright') THEN 'legal'
             WHEN contains(text, '@') THEN 'contact' WHEN 10 * (length(text) - length(replace(text, '|', ''))) > n_tokens THEN 'tabular'
             WHEN n_tokens < 50 THEN 'brief' WHEN n_tokens > 1000 THEN 'long' ELSE 'prose' END AS topic FROM t)""",
             """
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)"""]
    for dim, power in mixing.TEMPER.items():
        parts.append(f"""
to_{dim} AS (SELECT {dim}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS share FROM cells GROUP BY {dim})""")
    last, n = "start", 0
    parts.append("""
start AS (SELECT source, lang, topic, tokens, tokens AS weight FROM cells)""")
    for _ in range(mixing.PASSES):
        for dim in mixing.TEMPER:
            n += 1
            parts.append(f"""
p{n} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, CASE WHEN sum(weight) OVER (PARTITION BY c.{dim}) > 0
     THEN weight * share / sum(weight) OVER (PARTITION BY c.{dim}) ELSE 0 END AS weight FROM {last} c JOIN to_{dim} s ON c.{dim} = s.{dim})""")
            last = f"p{n}"
    parts.append(f"""
r AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate FROM {last})""")
    parts.append(f"""
k AS (SELECT *, row_number() OVER (ORDER BY rate DESC, source, lang, topic) AS no,
             ({mixing.KEEP} * sum(tokens) OVER () - coalesce(sum(tokens) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS scale
      FROM r WINDOW before AS (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    parts.append("""
prob AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, rate * (SELECT arg_min(scale, no) FROM k WHERE rate * scale < 1)) ELSE 1.0 END AS probability FROM r)""")
    return "WITH" + ",".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 9) AS probability,
       ('0x' || md5('{mixing.SEED}|' || doc_id::VARCHAR)[1:13])::UBIGINT * pow(16.0, -13) < probability AS sampled
FROM d JOIN prob USING (source, lang, topic)
"""


ORACLES["op6_source_mixing"] = _mixing_sql()


@_query
def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = licenses.paragraphs(table(spark, sf_dir, "documents"))
    return licenses.scan(paragraphs, licenses.fit(spark, paragraphs))


@_query
def op4_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_bytes", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@_query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("content", 256).alias("kept_sha256"))


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY 1, 2),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, CAST(floor(1000 * ln((2e0 * nn + 2) / (2e0 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, nn),
s AS (SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll))))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY 1, 2, 3),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@_query
def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


ORACLES["op13_url_rules"] = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rhost, rpath, verdict) AS (VALUES {", ".join(repr(r) for r in URL_RULES)}),
f AS (SELECT r, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS no
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM f WHERE no = 1) USING (r)
"""
