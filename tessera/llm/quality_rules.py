"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a boolean expression over the row that rejects a document; it computes its own figures. On a bounded random
sample the cost of each rule (seconds a row, net of what a job takes anyway) and its selectivity (share of rows it rejects)
are measured; rules are then ordered by rejections per cost and evaluated as one CASE, so that the figures of a later rule
are not computed for a document that an earlier one rejects. The order changes the time and the name in ``rejected_by``,
never the verdict. Figures that are wanted for every row anyway are given as ``figures``: they are computed once, before
the cascade, and rules read them as columns (``default_rules(counted=True)``); costs are then those of the rules alone.

Counts are computed inside the row, over whole texts: no shuffle, join or UDF. Repeated windows are found by sorting
the hashes (64 bits) of a text's windows; memory is linear in one text.
Edge cases: a null text has no words and fails; empty and very long texts are counted alike; repeated rows are judged
each on their own; other columns are carried through, but own columns named like a result give way to it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _covered(hashes: Column, width: int) -> Column:
    """Words in windows whose hash is met again, from sorted (h, i)."""
    # a window is repeated if its neighbour in the order of hashes has the same hash
    flagged = F.transform(hashes, lambda x, k: F.when(
        ((k > 0) & (F.get(hashes, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(hashes, k + 1)["h"] == x["h"], F.lit(False))), x["i"]))
    places = F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, zero, lambda s, i: F.struct((i + width).alias("to"), (s["n"] + (i + width - F.greatest(s["to"], i))).cast("long").alias("n")), lambda s: s["n"])


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    # each word is hashed once, a window from its words' hashes
    own = F.transform(words, lambda w: F.xxhash64(w))
    hashes = F.when(F.size(words) > width, let(own, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))))
    # most texts repeat no window: only the others are sorted
    again = lambda h: let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda x: _covered(x, width))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), again(h)).otherwise(F.lit(0).cast("long")))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, own = F.coalesce(F.col("text"), F.lit("")), [c for c in docs.columns if c not in COUNTS]
    by_word = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    name = "_" * (1 + max(map(len, own), default=0))
    made = docs.select(*[F.col(f"`{c}`") for c in own], by_word.alias(name), F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"), repeated_lines(text).alias("n_dup_lines"))
    return made.select(*[F.col(f"`{c}`") for c in own], f"{name}.n_words", f"{name}.word_chars", "n_symbols", "n_dup_lines", f"{name}.n_repeat_words")


def default_rules(counted: bool = False) -> list[Rule]:
    """Rules over the column ``text`` alone, or over it and the columns of ``with_counts``, with the same verdicts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if counted:
        n, chars, symbols, doubled = (F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines"))
        windows = 100 * F.col("n_repeat_words") > 30 * n
    else:
        n = F.size(words_of(text))
        chars = F.length(F.regexp_replace(text, SPACE, ""))
        symbols, doubled = F.length(F.regexp_replace(text, SYMBOLS, "")), repeated_lines(text)
        windows = let(words_of(text), lambda w: 100 * repeated_words(w) > 30 * F.size(w))
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        Rule("few_words", n < 20),
        Rule("repeated_windows", windows),
        Rule("symbols", symbols * 4 > n),
        Rule("short_words", chars < 2 * n),
        Rule("long_words", chars > 25 * n),
        Rule("duplicate_lines", doubled * 2 > F.size(F.split(text, "\n"))),
        Rule("few_letters", letters * 2 < chars),
        Rule("shouting", upper * 2 > letters),
        Rule("no_letters", ~F.rlike(text, F.lit(r"[A-Za-z\x80-\x{10FFFF}]"))),
    ]


def ordered_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 200, times: int = 8, figures: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost on ``sample_rows`` random rows, each evaluated ``times`` times: (rule, seconds a row, share rejected), best first.
    ``figures`` adds the columns that the rules read, to the sample alone."""
    # kept before its figures are added: a projection moved below the limit would turn the top rows into a sort of all
    drawn = docs.orderBy(F.rand(17)).limit(sample_rows).cache()
    sample = figures(drawn).cache() if figures else drawn
    try:
        n = max(1, sample.count())
        many = sample.withColumn("_" * (1 + max(map(len, sample.columns))), F.explode(F.sequence(F.lit(1), F.lit(times))))

        def took(*wanted: Column) -> tuple[float, int]:
            best, got = float("inf"), 0
            for _ in range(2):  # the first run compiles the code
                began = time.perf_counter()
                got = many.agg(F.count(F.lit(1)), *[F.count_if(x) for x in wanted]).first()[-1]
                best = min(best, time.perf_counter() - began)
            return best, got

        idle = took()[0]
        found = [(r, max(1e-8, (s - idle) / (n * times)), hits / (n * times)) for r in rules for s, hits in [took(r.rejects)]]
    finally:
        sample.unpersist()
        drawn.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 200, figures: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``rejected_by``: the first rule, in the measured order, that rejects the row; null for rows that pass.
    ``figures`` adds columns for every row, once, before the rules that read them."""
    verdict = F.lit(None).cast("string")
    for rule, _, _ in reversed(ordered_rules(docs, default_rules() if rules is None else rules, sample_rows, figures=figures)):
        verdict = F.when(rule.rejects, rule.name).otherwise(verdict)
    return (figures(docs) if figures else docs).withColumn("rejected_by", verdict)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), default_rules(counted=True), figures=with_counts)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, i, list_slice(w, i, i + 7) AS part FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, part) AS k FROM h) WHERE k > 1),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS pos FROM again) GROUP BY r),
c AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS upper
  FROM d LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 4 > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_dup_lines * 2 > len(string_split(t, chr(10)))
    OR letters * 2 < word_chars OR upper * 2 > letters OR letters = 0) AS kept
FROM f
"""
