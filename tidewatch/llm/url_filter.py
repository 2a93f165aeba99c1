"""URL filtering with host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that a rule could be stored under: the last
labels of its host, as many as any rule has, with the path's prefixes of the lengths that
rules have. Expressions and rules meet by equality of a short prefix of their digests; the
full digests confirm a hit and the longest confirmed rule decides. Rules of one number of
labels and one length of path are one expression of a URL. While rules have few such shapes and
are few enough to be broadcast, each shape is one equi-join on the short digest in the row's
place, without a shuffle; beyond that, expressions are exploded and joined. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.tables import cut, hot, salted, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHAPES = 24  # broadcast joins in a row
BROADCAST_RULES = 100_000
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")


def _host(url):
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def _path(url):
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", shapes: int = SHAPES, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages; rules has rule_host, rule_path, verdict.

    The host stands after the first "://" up to "/", "?" or "#", A-Z lower-cased; the path
    follows up to "?" or "#". A null url, or one without "://", has an empty host and path
    and gets the default, as does every url that no rule fits. A rule fits its host and all
    subdomains where the path starts with the rule's. The rule with the most characters
    wins; of equally long ones the longer host, and of the same host and path "block".
    Repeated rows each get their verdict; null page_ids are kept. Rules with a null part fit
    nothing. Up to broadcast_rules rules are broadcast, more are joined by shuffle.
    """
    rules = (
        rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull() & F.col("verdict").isNotNull())
        .select(F.translate("rule_host", _UPPER, _LOWER).alias("rule_host"), "rule_path", "verdict")
        .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
        .withColumn("rank", F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict")))
    )
    rules = rules.withColumns({"labels": F.size(F.split("rule_host", r"\.")), "chars": F.length("rule_path")})
    found = rules.groupBy("labels", "chars").agg(F.count("*").alias("n")).collect()  # as many as rules have shapes
    urls = pages.select("page_id", F.coalesce(_host(F.col(url)), F.lit("")).alias("host"), F.coalesce(_path(F.col(url)), F.lit("")).alias("path"))
    if not found:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    kinds = sorted((r["labels"], r["chars"]) for r in found)
    small = sum(r["n"] for r in found) <= broadcast_rules
    best = _in_place(urls, rules, kinds) if small and len(kinds) <= shapes else _by_join(urls, rules, kinds, small)
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _expression(labels: int, chars: int):
    """The digest of the host's last labels with the path's first characters; null where there are fewer."""
    parts = F.split("host", r"\.")
    suffix = F.array_join(F.slice(parts, -labels, labels), ".")
    return F.when((F.size(parts) >= labels) & (F.length("path") >= chars), _digest(suffix, F.substring("path", 1, chars)))


def _confirmed(held: str, full: str):
    """The rank of the rule in held whose full digest is the expression's; null where none is."""
    return F.get(F.filter(held, lambda r: r["full"] == F.col(full)), F.lit(0))["rank"]


def _in_place(urls: DataFrame, rules: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """urls with best, the rank of the longest confirmed rule: an equi-join on the short digest for each shape of rules.

    Rules of a shape that share a short digest are one row, so that a join never repeats a URL."""
    names = []
    for k, (labels, chars) in enumerate(kinds):
        held = rules.where((F.col("labels") == labels) & (F.col("chars") == chars)).groupBy(F.col("short").alias(f"_short{k}")).agg(F.collect_list(F.struct("full", "rank")).alias(f"_held{k}"))
        urls = urls.withColumn(f"_full{k}", _expression(labels, chars)).withColumn(f"_short{k}", F.substring(f"_full{k}", 1, PREFIX_HEX)).join(F.broadcast(held), f"_short{k}", "left")
        names.append(f"_rank{k}")
        urls = urls.withColumn(f"_rank{k}", _confirmed(f"_held{k}", f"_full{k}"))
    return urls.withColumn("best", F.greatest(*names) if len(names) > 1 else F.col(names[0]))


def _by_join(urls: DataFrame, rules: DataFrame, kinds: list[tuple[int, int]], small: bool) -> DataFrame:
    """The same by one equi-join of exploded expressions; each row has a key of its own, so that no group is large."""
    most, lengths = max(k for k, _ in kinds), F.array(*[F.lit(x) for x in sorted({c for _, c in kinds})])
    labels = F.split("host", r"\.")
    some = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - F.lit(most - 1)), F.least(F.size(labels), F.lit(most)))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(some)), lambda i: F.array_join(F.slice(some, i, F.size(some)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    urls = cut(urls.withColumn("row", F.monotonically_increasing_id()))
    asked = urls.select("row", F.explode(digests).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    held = rules.select("short", F.col("full").alias("rule_full"), "rank")
    met = asked.join(F.broadcast(held), "short") if small else salted(asked, held, "short", F.col("row"), hot(asked, "short"))
    best = met.where("full = rule_full").groupBy("row").agg(F.max("rank").alias("best"))
    return urls.join(best, "row", "left")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark))


OP4_SQL = r"""
WITH rules(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                       ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                 row_number() OVER () AS r
          FROM pages),
hits AS (SELECT parts.*, rh || rp AS rule, verdict,
                row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
         FROM parts LEFT JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""
