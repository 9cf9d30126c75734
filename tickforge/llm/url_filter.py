"""URL filters: explicit host/path rules, and association rules mined from labelled URLs (DataFrame functions only).

Spark's FP-growth finds combinations of URL tokens that occur with a label; rules below the least support or
confidence are pruned. A kept rule is indexed under its rarest token; a URL looks up its tokens in that
inverted index and tests the rest of each rule found. Token sets are matched once each, whatever the number of
URLs that share them, and joined back with a salt, so one host may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict): fixed values of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
#: Tokens in the antecedent of a mined rule: combinations, not single words.
ANTECEDENT = (2, 3)
SALTS = 16
#: Mined rules up to this number are broadcast (each has 3 tokens at most: under 40 MB), more are shuffled.
BROADCAST_RULES = 200_000


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # later ones, the longer, win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct labels of the host and parts of the path that hold a letter, sorted."""
    def tagged(tag, col, sep):
        return F.transform(F.filter(F.split(col, sep), lambda x: x.rlike("[a-z]")), lambda x: F.concat(F.lit(tag), x))
    return F.array_sort(F.array_distinct(F.concat(tagged("h=", host, r"\."), tagged("p=", F.translate(path, UPPER, LOWER), "/"))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """antecedent array, verdict, confidence, support from (tokens array, verdict)."""
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict="))
    found = found.where(F.size("antecedent").between(*ANTECEDENT) & ~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    return found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), 9, 100).alias("verdict"), "confidence", "support")


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct `tokens` array the verdict of the surest rule it holds (then best supported, then first by name); arrays without one are absent."""
    rules = Scratch(tokens.sparkSession, "url_filter").table(rules, "rules")  # mined once
    count = rules.count()
    df = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    keyed = rules.select("*", F.explode("antecedent").alias("token")).join(df, "token")
    index = keyed.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("uses", "token")).alias("token"))
    index = F.broadcast(index) if count <= BROADCAST_RULES else index
    sets = tokens.select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct((-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), F.concat_ws(" ", "antecedent").alias("c"), "verdict")
    return hits.groupBy("tokens").agg(F.min(rank).alias("best")).select("tokens", F.col("best.verdict").alias("mined"))


def filter_urls(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url",
                min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Columns id_col, host, path, rule, verdict for every row of pages.

    URLs that an explicit rule fits take its verdict and are the labelled rows of the mining; the rest take that
    of the best mined rule, and `allow` if none matches. A null url has empty host and path, no rule and
    `allow`. Rows with null or repeated ids are judged like others; URLs of any length are taken whole; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    host, path = url_host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("verdict"), url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(urls.where(F.col("verdict").isNotNull()).select("tokens", "verdict"), min_support, min_confidence)
    best = match_rules(urls.where(F.col("verdict").isNull()), mined)
    best = best.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = urls.where(F.col("verdict").isNull()).withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")).join(best, ["tokens", "salt"], "left")
    ruled = urls.where(F.col("verdict").isNotNull())
    out = ruled.select("id", "host", "path", "rule", "verdict").unionByName(
        rest.select("id", "host", "path", "rule", F.coalesce("mined", F.lit("allow")).alias("verdict")))
    return out.withColumnRenamed("id", id_col)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = f"""
WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: regexp_matches(x, '[a-z]')), lambda x: 'h=' || x),
    list_transform(list_filter(string_split(translate(path, '{UPPER}', '{LOWER}'), '/'), lambda x: regexp_matches(x, '[a-z]')), lambda x: 'p=' || x)))) AS tokens
  FROM h),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM r),
b AS (SELECT row_number() OVER () AS n, tokens, verdict FROM v WHERE verdict IS NOT NULL),
e AS (SELECT n, verdict, unnest(tokens) AS t FROM b),
a2 AS (SELECT [x.t, y.t] AS ant, x.verdict FROM e x JOIN e y ON x.n = y.n AND x.t < y.t),
a3 AS (SELECT [x.t, y.t, z.t] AS ant, x.verdict FROM e x JOIN e y ON x.n = y.n AND x.t < y.t JOIN e z ON z.n = y.n AND y.t < z.t),
g AS (SELECT ant, verdict, count(*) AS k FROM (SELECT * FROM a2 UNION ALL SELECT * FROM a3) GROUP BY ant, verdict),
c AS (SELECT *, sum(k) OVER (PARTITION BY ant) AS n FROM g),
m AS (SELECT ant, verdict, k, k::DOUBLE / n::DOUBLE AS conf FROM c WHERE k >= ceil({MIN_SUPPORT} * (SELECT count(*) FROM b)) AND k::DOUBLE / n::DOUBLE >= {MIN_CONFIDENCE}),
sets AS (SELECT DISTINCT tokens FROM v WHERE verdict IS NULL),
f AS (SELECT tokens, m.verdict, row_number() OVER (PARTITION BY tokens ORDER BY conf DESC, k DESC, array_to_string(ant, ' ')) AS o
  FROM sets JOIN m ON list_has_all(tokens, ant))
SELECT page_id, host, path, rule, coalesce(v.verdict, f.verdict, 'allow') AS verdict
FROM v LEFT JOIN f ON v.verdict IS NULL AND f.o = 1 AND f.tokens = v.tokens
"""
