"""URL filters by a sort-merge range join.

Every rule is a host with a path prefix. A host is written label by label from the right, so a rule becomes the
interval of keys that start with ``reversed host + separator + path``. Each distinct URL gives one key for each
suffix of its host that is no longer than the longest rule host. Rules and URL keys are range-partitioned and
sorted together; a sweep over each partition keeps the stack of rules whose interval is open. Prefix intervals
nest, so the top of the stack is the longest rule for the key.

A partition may start inside intervals that were opened before it. For that, the least key of each partition
goes to the driver (one string for each partition), and the rules among its prefixes are handed to that partition:
at most partitions x longest rule key entries, however many URLs or rules there are. Rules themselves are never
broadcast. Partitions are cut by (key, page), so a host with a third of all URLs is spread over many of them.

Edge cases: a null URL or one without ``://`` has an empty host and path, matches no rule and gets the default
verdict; repeated rows come back as often as they came; an empty table gives an empty result; other columns are
not carried; rules that name the same host and path: the verdict that sorts first wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, table

SEP = "\x01"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({
        "host": ascii_lower(F.regexp_extract(u, "://([^/?#]*)", 1)),
        "path": F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1),
    })


def _reversed(host: str):
    return F.reverse(F.split(F.col(host), r"\."))


def _sweep(batches: Iterator[pa.RecordBatch], carried: dict[int, list[tuple[str, str, str]]]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, str, str]] = list(carried.get(TaskContext.get().partitionId(), ()))
    for batch in batches:
        keys, rules, verdicts, first = (batch.column(k).to_pylist() for k in ("key", "rule", "verdict", "first"))
        take, found, said = [], [], []
        for i, key in enumerate(keys):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rules[i] is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, rules[i], verdicts[i]))
            elif stack or first[i]:
                take.append(i)
                found.append(stack[-1][1] if stack else None)
                said.append(stack[-1][2] if stack else None)
        kept = batch.select(["page_id", "url", "n"]).take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string()), pa.array(said, pa.string())], names=["page_id", "url", "n", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict; ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    rules = (rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .where("host <> ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
             .select(F.concat(F.array_join(_reversed("host"), "."), F.lit(SEP), "path").alias("key"),
                     F.concat("host", "path").alias("rule"), "verdict", F.size(_reversed("host")).alias("labels")))
    most = rules.agg(F.max("labels"), F.max(F.length("key"))).first()
    labels, longest = most[0] or 1, most[1] or 0

    urls = with_host_path(pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n")))
    depth = F.least(F.size(_reversed("host")), F.lit(labels))
    keyed = urls.select("page_id", "url", "n", "path", _reversed("host").alias("rev"), F.explode(F.sequence(F.lit(1), depth)).alias("i"))
    points = keyed.select(
        F.concat(F.array_join(F.slice("rev", F.lit(1), F.col("i")), "."), F.lit(SEP), "path").alias("key"), F.lit(1).alias("kind"),
        "page_id", "url", "n", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), (F.col("i") == 1).alias("first"))
    opened = rules.select("key", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"),
                          F.lit(None).cast("string").alias("url"), F.lit(0).cast("long").alias("n"), "rule", "verdict", F.lit(False).alias("first"))
    ranged = checkpointed(points.unionByName(opened).repartitionByRange("key", "kind", "page_id", "url").sortWithinPartitions("key", "kind", "page_id", "url"))

    least = [(r.p, r.key) for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).collect()]
    heads = {k[:i] for _, k in least for i in range(1, min(len(k), longest) + 1)}
    carried: dict[int, list[tuple[str, str, str]]] = {}
    if heads:
        open_before = rules.join(spark.createDataFrame([(h,) for h in heads], "key string"), "key", "left_semi").select("key", "rule", "verdict").collect()
        for p, k in least:
            carried[p] = sorted(((r.key, r.rule, r.verdict) for r in open_before if k.startswith(r.key)), key=lambda r: len(r[0]))

    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}
    swept = ranged.mapInArrow(lambda b: _sweep(b, carried), f"page_id {kinds['page_id']}, url {kinds['url']}, n long, rule string, verdict string")
    best = swept.groupBy("page_id", "url", "n").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("len"), "rule", "verdict"))).alias("b"))
    rows = best.select("page_id", "url", "b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return with_host_path(rows).select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"), "url")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


SQL = r"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict, url FROM r
"""
