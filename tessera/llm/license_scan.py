"""License scans by ordered signature rules, with DataFrame functions only.

The signatures are regular expressions written by hand (``license_signatures.txt``: a few hundred lines of keyword, label,
confidence and regex, the first line having the highest priority) over the normalised text: words (letters, digits, non-ASCII;
A-Z lower-cased). A text that holds no keyword is passed over after plain substring tests; for the others the rules whose
keyword occurs are tried, the places of those that match are put in order of (start, longest first, priority), and a place
contained in one before it is suppressed. The base phrases are counted apart from that and always stay.

All work is inside the row: no shuffle, join, UDF or broadcast of data; the rules are constants of the plan, so their
regexes are compiled once for each task. Time is linear in a text but for the sort of its places.
Edge cases: null text is an empty one (0 words, no label, score 0, null positions); repeated rows are scanned each on
their own; other columns stay where ``scan_licenses`` is called (own columns named like a result give way to it) and are
dropped by the query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .quality_rules import let

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    """``regex`` matches between a leading and a trailing space of the normalised text."""

    keyword: str
    regex: str
    label: str
    priority: int
    confidence: float


def signature_rules(path: str | Path | None = None) -> list[Rule]:
    """The rules of a file of lines ``keyword | label | confidence | regex``; a keyword between spaces is a word of its own."""
    lines = [x for x in Path(path or Path(__file__).with_name("license_signatures.txt")).read_text().split("\n") if x and not x.startswith("#")]
    split = [x.split(" | ", 3) for x in lines]
    return [Rule(keyword, regex, label, i, float(confidence)) for i, (keyword, label, confidence, regex) in enumerate(split)]


def must_hold(regex: str, word: str) -> bool:
    """Whether every match of a signature holds this word, as far as can be told without its groups."""
    before = ""
    while before != regex:
        before, regex = regex, re.sub(r"\(\?:[^()]*\)\?|\(\?:[^()|]*\|[^()]*\)", "", regex)
    return all(word in part for part in regex.split("|"))


def spaced(regex: str) -> str:
    """Between words of the normalised text stand two spaces, one for each, so that places side by side do not share one."""
    return f" (?:{regex.replace(' ?', chr(0)).replace(' ', '  ').replace(chr(0), '(?:  )?')}) "


def _places(norm: Column, regex: Column) -> Column:
    """Word positions [from, to) of all places of ``regex``, by a mark in front of each: no count of words starts anew."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    marked = words(F.regexp_replace(norm, F.concat(F.lit("("), regex, F.lit(")")), F.lit(" \x01 $1")))
    at = F.filter(F.transform(marked, lambda w, i: F.when(w == "\x01", i)), lambda i: i.isNotNull())
    sizes = F.transform(F.regexp_extract_all(norm, regex, F.lit(0)), lambda hit: F.size(words(hit)))
    return F.zip_with(F.transform(at, lambda i, k: i - k), sizes, lambda i, n: F.struct(i.alias("from"), (i + n).alias("to")))


def _kept(found: Column, chunk: int = 256) -> Column:
    """Of places in order those that reach further than all before them; in chunks, so that no long array is copied for each place."""
    kind = "array<struct<label:string,from:int,to:int,confidence:double>>"
    one = lambda s, x: F.struct(
        F.greatest(s["reach"], -x["minus_to"]).alias("reach"),
        F.when(-x["minus_to"] <= s["reach"], s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(x["label"].alias("label"), x["from"].alias("from"), (-x["minus_to"]).alias("to"), x["confidence"].alias("confidence"))))).alias("out"))
    some = lambda reach, part: F.aggregate(part, F.struct(reach.alias("reach"), F.array().cast(kind).alias("out")), one)
    starts = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(chunk))
    return F.aggregate(starts, F.struct(F.lit(-1).alias("reach"), F.array().cast(f"array<{kind}>").alias("out")),
                       lambda s, i: let(some(s["reach"], F.slice(found, i + 1, F.lit(chunk))), lambda x: F.struct(x["reach"].alias("reach"), F.concat(s["out"], F.array(x["out"])).alias("out"))),
                       lambda s: F.flatten(s["out"]))


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds license_n_words, license_base (array of label, from, to) and license_detections (those kept after suppression) to ``docs``."""
    rules = signature_rules() if rules is None else rules
    own = [c for c in docs.columns if not c.startswith("license_")]
    # a text that can match a rule holds its keyword; most signatures hold "licen", so that few words tell
    keywords = {"licen" if must_hold(r.regex, "licen") else r.keyword for r in rules} | {p.split()[-1] for p, _ in BASE} - {"by"} | {" cc "}
    plain, alone = {k for k in keywords if k == k.strip()}, sorted(k.strip() for k in keywords if k != k.strip())
    text = F.coalesce(F.col("text"), F.lit(""))

    def gate(low: Column) -> Column:
        some = F.rlike(low, F.lit(f"(?:^|{GAP[:-1]})(?:{'|'.join(alone)})(?:{GAP[:-1]}|$)"))
        for k in sorted(k for k in plain if not any(o != k and o in k for o in plain)):
            some = some | F.contains(low, F.lit(k))
        return some

    normal = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(text), GAP, "  "), F.lit(" "))
    norm = let(F.lower(text), lambda low: F.when(gate(low), normal))

    def base(norm: Column) -> Column:
        named = lambda places, label: F.transform(places, lambda x: F.struct(F.lit(label).alias("label"), x["from"].alias("from"), x["to"].alias("to")))
        return F.concat(*[named(_places(norm, F.lit(spaced(p))), label) for p, label in BASE])

    known = F.array(*[F.struct(F.lit(spaced(r.regex)).alias("regex"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in rules])

    def found(norm: Column) -> Column:
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            by_word.setdefault(r.keyword, []).append(i)
        tried = lambda some: F.array_compact(F.array(*[F.when(F.rlike(norm, F.lit(spaced(rules[i].regex))), F.lit(i)) for i in some]))
        fired = F.flatten(F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(k)), tried(some)) for k, some in by_word.items()])))
        places = lambda r: F.transform(_places(norm, r["regex"]), lambda x: F.struct(
            x["from"].alias("from"), (-x["to"]).alias("minus_to"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))
        return let(F.array_sort(F.flatten(F.transform(fired, lambda i: let(F.get(known, i), places)))), lambda x: F.when(F.size(x) == 0, F.lit(None)).otherwise(_kept(x)))

    name = "_" * (1 + max(map(len, own), default=0))
    scanned = let(norm, lambda n: F.when(n.isNotNull(), F.struct(base(n).alias("base"), found(n).alias("kept"))))
    out = docs.select(*[F.col(f"`{c}`") for c in own], F.size(F.filter(F.split(text, GAP), lambda w: w != "")).cast("long").alias("license_n_words"), scanned.alias(name))
    return out.select(*[F.col(f"`{c}`") for c in own], "license_n_words",
                      F.coalesce(F.col(f"{name}.base"), F.array().cast("array<struct<label:string,from:int,to:int>>")).alias("license_base"),
                      F.coalesce(F.col(f"{name}.kept"), F.array().cast("array<struct<label:string,from:int,to:int,confidence:double>>")).alias("license_detections"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, more = F.col("license_base.label"), F.col("license_detections.label")
    return found.select(
        "doc_id", F.col("license_n_words").alias("n_words"), F.size("license_base").cast("long").alias("n_base"),
        F.array_min("license_base.from").cast("long").alias("first_word"), F.array_max("license_base.from").cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.array_union(base, more)).alias("labels"),
        F.greatest(F.coalesce(F.array_max("license_detections.confidence"), F.lit(0.0)), F.when(F.size("license_base") > 0, 0.5).otherwise(0.0)).alias("score"))


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({text(r.keyword)}, {text(spaced(r.regex))}, {text(r.label)}, {r.priority}, {r.confidence}, false)" for r in signature_rules())
    base = ", ".join(f"({text(p.split()[-1])}, {text(spaced(p))}, {text(label)}, -1, 0.5, true)" for p, label in BASE)
    return rf"""
WITH rules(keyword, regex, label, priority, confidence, base) AS (VALUES {rules}, {base}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents),
w AS (SELECT r, doc_id, CAST(len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS BIGINT) AS n_words, ' ' || regexp_replace(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') || ' ' AS norm FROM d),
m AS (SELECT r, label, priority, confidence, base, regexp_extract_all(norm, regex) AS hits, string_split_regex(norm, regex) AS gaps FROM w JOIN rules ON contains(norm, keyword)),
k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (
  SELECT r, label, priority, confidence, base, CAST(len(hits[i].regexp_extract_all('[^ ]+')) AS BIGINT) AS n,
    CAST(len(regexp_extract_all(array_to_string(gaps[1:i], ' '), '[^ ]+')) + len(regexp_extract_all(array_to_string(hits[1:i - 1], ' '), '[^ ]+')) AS BIGINT) AS f FROM k),
s AS (SELECT *, max(f + n) OVER (PARTITION BY r, base ORDER BY f, f + n DESC, priority, label, confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
a AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(f) FILTER (base) AS first_word, max(f) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR reach IS NULL OR f + n > reach) AS labels, max(confidence) FILTER (base OR reach IS NULL OR f + n > reach) AS score
  FROM s GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN a USING (r)
"""


SQL = _sql()
