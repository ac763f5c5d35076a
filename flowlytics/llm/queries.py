"""One registered query for each operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlytics.llm import align, bpe, contamination, exact, html, jaccard, lines, packing, quality, repair, sharding, surrogates, urls
from flowlytics.llm.registry import ORACLE, QUERIES, register, table  # noqa: F401

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SURROGATE_KEY = "corpus-1"


@register("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 24)


@register("op2_line_dedup", f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
w AS (SELECT trim(line, ' ' || chr(9) || chr(13)) AS k FROM l GROUP BY k HAVING k <> '' AND count(DISTINCT site) >= {lines.MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (w.k IS NOT NULL) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (w.k IS NULL), '') AS text
FROM l LEFT JOIN w ON trim(line, ' ' || chr(9) || chr(13)) = w.k GROUP BY doc_id""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, sf_dir, "documents"))


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.scored(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def _level(name: str, children: str, key: str, parents: str, parent: str) -> str:
    """SQL of one step of the prior: the posterior of each child from its parent's."""
    low, high = urls.LEAST_STRENGTH, urls.MOST_STRENGTH
    return f"""p_{name} AS (SELECT c.*, p.alpha / (p.alpha + p.beta) AS mean FROM {children} c JOIN {parents} p USING ({parent})),
m_{name} AS (SELECT sum(power(bad - n * mean, 2) / n - mean * (1 - mean)) AS excess, sum((n - 1) * mean * (1 - mean)) AS room FROM p_{name} WHERE n > 1),
s_{name} AS (SELECT CASE WHEN excess > 0 AND room > 0 THEN least(greatest(room / excess - 1, {low}), {high}) ELSE {high} END AS s FROM m_{name}),
{name} AS (SELECT {key}, {parent}, n, bad, s * mean + bad AS alpha, s * (1 - mean) + n - bad AS beta FROM p_{name}, s_{name})"""


@register("op4_url_filter", f"""
WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.UPPER.lower()}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT host, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM u LEFT JOIN b ON b.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)(\\.html)?/?$', 1), '') AS BIGINT) GROUP BY host),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, '' AS root, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
top AS (SELECT '' AS root, sum(bad) + 1.0::DOUBLE AS alpha, sum(n) - sum(bad) + 1.0::DOUBLE AS beta FROM suffixes),
{_level('of_suffix', 'suffixes', 'suffix', 'top', 'root')},
{_level('of_domain', 'domains', 'domain', 'of_suffix', 'suffix')},
{_level('of_host', '(SELECT host, domain, n, bad FROM hosts)', 'host', 'of_domain', 'domain')},
blocked AS (SELECT host FROM of_host WHERE alpha / (alpha + beta) - {urls.Z} * sqrt(alpha / (alpha + beta) * (beta / (alpha + beta)) / (alpha + beta + 1)) > {urls.LIMIT}),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
  WHEN 'net/' THEN 'block' ELSE CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END END AS verdict FROM r""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its path; that one's label is the page's outcome: bad if low or toxic."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    shown = F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]+)(\\.html)?/?$", 1).try_cast("long")
    outcomes = pages.select("url", shown.alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return urls.judged(pages, outcomes, URL_RULES)


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


@register("op7_exact_dedup", """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"))


@register("op8_pii_surrogates")
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)


@register("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@register("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.digests(repair.repaired(repair.damaged(conversations)))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    whole = every.join(found, every["conv"].eqNullSafe(found["conv_id"]), "left")
    return whole.select(F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in repair.COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
