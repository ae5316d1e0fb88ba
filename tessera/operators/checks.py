"""Extensions: business checks over documents and their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sinks.scratch import kept
from .ordered import numbered


def business_duplicates(invoices: DataFrame) -> DataFrame:
    """number, kind, n: invoices that agree in number, vendor, currency and amount (DUPLICATE), and numbers that several vendors use (COLLISION)."""
    same = invoices.groupBy("number", "vendor", "currency", "amount").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("number", F.lit("DUPLICATE_CANDIDATE").alias("kind"), "n")
    used = invoices.groupBy("number").agg(F.count_distinct("vendor").alias("n")).where("n > 1").select("number", F.lit("NUMBER_COLLISION").alias("kind"), "n")
    return same.unionByName(used)


def item_lines(lines: DataFrame) -> DataFrame:
    """Lines that are items: no repeated headers, subtotals or totals; continuations are joined to the line they continue."""
    items = lines.where(F.col("row_type") == "ITEM")
    more = lines.where(F.col("row_type") == "CONTINUATION").groupBy(F.col("continues").alias("line_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("_more"))
    return items.join(more, "line_id", "left").withColumn("text", F.concat_ws(" ", "text", "_more")).drop("_more")


def sum_check(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str, tolerance: str = "0.01") -> DataFrame:
    """key, total, sum of the parts, difference and whether it keeps within the tolerance; a total without parts has none."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("parts"))
    made = totals.select(key, F.col(total).alias("total")).join(sums, key, "left")
    return made.withColumn("difference", F.col("parts") - F.col("total")).withColumn("agrees", F.abs("difference") <= F.lit(tolerance).cast("decimal(18,6)"))


def tax_check(base: Column, rate: Column, tax: Column, tolerance: str = "0.01") -> Column:
    return F.abs(base * rate - tax) <= F.lit(tolerance).cast("decimal(18,6)")


def total_check(subtotal: Column, discount: Column, tax: Column, total: Column, tolerance: str = "0.01") -> Column:
    return F.abs(subtotal - discount + tax - total) <= F.lit(tolerance).cast("decimal(18,6)")


def remaining_balances(allocations: DataFrame) -> DataFrame:
    """Allocations (source_id, position, quantity, available) with the balance before, what is granted and what remains: never more than there is."""
    w = Window.partitionBy("source_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.col("available") - F.coalesce(F.sum("quantity").over(w), F.lit(0)), F.lit(0))
    return allocations.withColumn("balance", before).withColumn("granted", F.least("quantity", "balance")).withColumn("remaining", F.col("balance") - F.col("granted"))


def difference_kind(document: Column, system: Column, document_date: Column, system_date: Column, document_currency: Column, system_currency: Column, rounding: str = "0.05") -> Column:
    """What separates a document's amount from the system's."""
    d = F.abs(document - system)
    return (F.when(system.isNull(), "MISSING_IN_SYSTEM").when(document.isNull(), "MISSING_DOCUMENT").when(document_currency != system_currency, "CURRENCY").when(d == 0, F.when(document_date != system_date, "TIMING").otherwise("NONE"))
            .when(d <= F.lit(rounding).cast("decimal(18,6)"), "ROUNDING").when(system == 2 * document, "DUPLICATE").when(system < document, "PARTIAL").otherwise("OTHER"))


def candidate_pairs(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """left_id, right_id, strength: pairs that agree in a key, each with its strongest (PRIMARY, SECONDARY, SUPPORTING); one equi-join for each key."""
    rank = {"PRIMARY": 0, "SECONDARY": 1, "SUPPORTING": 2}
    found = [left.select(F.col("record_id").alias("left_id"), F.col(k).alias("_k")).join(right.select(F.col("record_id").alias("right_id"), F.col(k).alias("_k")), "_k").select("left_id", "right_id", F.lit(rank[s]).alias("r")) for k, s in keys]
    best = reduce(DataFrame.unionByName, found).groupBy("left_id", "right_id").agg(F.min("r").alias("r"))
    return best.select("left_id", "right_id", F.get(F.array(*[F.lit(s) for s in rank]), F.col("r")).alias("strength"))


def version_edges(documents: DataFrame, pieces: int | None = None) -> DataFrame:
    """earlier, later, relationship of documents (document_id, number, version, status, sha256): copies of one content are EXACT_DUPLICATE, a draft before a final one DRAFT_FINAL, else SUPERSEDED_BY; a chain, not all pairs.

    Neighbours meet by (number, ordinal), so a number that many share is no single task."""
    made = numbered(documents.where("number IS NOT NULL").select("document_id", "number", "version", "status", "sha256"), ["number"], ["version", "document_id"], "_i", pieces=pieces)
    before = made.select("number", (F.col("_i") + 1).alias("_i"), F.col("document_id").alias("_id"), F.col("sha256").alias("_sha"), F.col("status").alias("_status"))
    return made.join(before, ["number", "_i"]).select(F.col("_id").alias("earlier"), F.col("document_id").alias("later"), F.when(F.col("_sha") == F.col("sha256"), "EXACT_DUPLICATE").when((F.col("_status") == "DRAFT") & (F.col("status") == "FINAL"), "DRAFT_FINAL").otherwise("SUPERSEDED_BY").alias("relationship"))


def version_chains(edges: DataFrame) -> DataFrame:
    """document_id, current, steps, state of all documents in edges (earlier, later): where the chain of later versions ends, and how far it is.

    state: CURRENT (no later one), SUPERSEDED, or CYCLE (the chain never ends: current and steps are null). Of several later versions the greatest id counts; an edge to
    itself is a cycle. The ends are found by doubling, so rounds grow with the logarithm of the longest chain; a round moves and writes the documents alone whose end is not
    known yet. A chain that ends has documents at each distance from its end, so each round but the last finds some: where one finds none, all that are left go round.
    """
    good = edges.where("earlier IS NOT NULL AND later IS NOT NULL")
    after = good.groupBy(F.col("earlier").alias("document_id")).agg(F.max("later").alias("at"))
    known = good.select(F.explode(F.array("earlier", "later")).alias("document_id")).distinct().join(after, "document_id", "left")
    first = kept(known.select("document_id", F.coalesce("at", "document_id").alias("at"), F.col("at").isNotNull().cast("long").alias("steps"), F.col("at").isNull().alias("ended")), "versions")
    ended, going = first.where("ended"), first.where("NOT ended")
    left, before = going.count(), -1
    while left and left != before:
        onward = ended.unionByName(going).select(F.col("document_id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
        moved = kept(going.join(onward, "at").select("document_id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended")), "versions")
        ended, going = ended.unionByName(moved.where("ended")), moved.where("NOT ended")
        left, before = going.count(), left
    known = ended.unionByName(going)
    return known.select("document_id", F.when(F.col("ended"), F.col("at")).alias("current"), F.when(F.col("ended"), F.col("steps")).alias("steps"), F.when(~F.col("ended"), "CYCLE").when(F.col("steps") == 0, "CURRENT").otherwise("SUPERSEDED").alias("state"))
