"""Deterministic reconciliation of two roles: typed comparators, keyed pairs, cardinality, links and what is left over.

Pairs are made by an equi-join on the normalised values of all required text components (``keyed``), since a pair can only
qualify if they agree. A rule without one makes its pairs by a band of its dates or decimals; one without these, or ``pairs="all"``,
compares all pairs under a budget that is checked first.
A hot key is joined by a splittable sort-merge join; statuses are plain expressions inside whole-stage codegen.
Decimal columns are compared as they are; texts behind a gate as DECIMAL(38,18) where they fit it, else as exact decimals of any width.
Values may be typed (variants, as JSON gives them): a text is never taken for a number nor a number for a text; pairs are made
by the canonical text, so that 5 and "5" meet and go to review.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, StringType, VariantType
from pyspark.sql.window import Window

from ..functions import decimals as D
from ..functions.fields import canonical_items, canonical_json, date_or_null, decimal_or_null, fraction_digits, kind_of, normalized, scaled_text, stable_id, text_of
from ..sinks.scratch import kept

TEXT = ("IDENTIFIER_EXACT", "EXACT_TEXT", "NORMALIZED_TEXT")
#: Worst first.
SEVERITY = ("CONFLICTING_MATCH", "HUMAN_REVIEW_REQUIRED", "AMBIGUOUS_MATCH", "UNMATCHED", "PARTIAL_MATCH", "WITHIN_TOLERANCE", "EXACT_MATCH", "NOT_APPLICABLE")
QUALIFYING = ("EXACT_MATCH", "WITHIN_TOLERANCE", "PARTIAL_MATCH")


@dataclass(frozen=True)
class Component:
    name: str
    left: str
    right: str
    comparator: str
    normalizers: tuple[str, ...] = ("NONE",)
    required: bool = True
    tolerance: float | str | None = None
    tolerance_approved: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    components: tuple[Component, ...]
    cardinality: str = "ONE_TO_ONE"
    missing: str = "HUMAN_REVIEW_REQUIRED"
    partial: str | None = None  # RIGHT_LESS_THAN_LEFT, LEFT_LESS_THAN_RIGHT or AGGREGATED_RIGHT_NOT_ABOVE_LEFT
    partial_approved: bool = False
    partial_review: bool = False  # decimals that differ go to review instead of conflicting
    left_role: str = ""
    right_role: str = ""
    aggregate: str | None = None  # right column with the group's total
    max_pairs: int = 1_000_000
    keys: tuple[Component, ...] = field(init=False, default=())

    def __post_init__(self):
        if self.cardinality not in ("ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_ONE", "MANY_TO_MANY"):
            raise ValueError(f"unknown cardinality {self.cardinality}")
        if len({c.name for c in self.components}) != len(self.components):
            raise ValueError("component names repeat")
        object.__setattr__(self, "keys", tuple(c for c in self.components if c.required and c.comparator in TEXT))


def approved(policy: dict | None, run_approved: bool = True) -> bool:
    """Whether a tolerance or partial policy is provided, approved in the run and itself, and says on whose word and what ground."""
    policy = policy or {}
    return bool(run_approved and policy.get("status", "PROVIDED") == "PROVIDED" and policy.get("approval_status") == "APPROVED" and all(str(policy.get(k) or "").strip() for k in ("basis", "owner", "approval_reference")))


def compared(c: Component, rule: Rule, left: Column, right: Column, aggregate: Column | None = None, numbers: tuple[Column, ...] | None = None, scales: tuple[int | None, ...] = (None, None), kinds: tuple[Column, Column] | None = None, days: tuple[Column, Column] | None = None, ranked: bool = False) -> Column:
    """struct(status, reason, difference) of one component, or with ``ranked`` the rank of its status alone; the first case that holds decides.

    ``numbers``: decimals and fraction digits of left, right and aggregate where they are at hand; ``scales``: of sides that are decimal columns;
    ``kinds``: JSON kinds of both sides' values where these are typed (left and right are their texts then, of sets arrays of canonical JSON);
    ``days``: both sides' dates as numbers of days where they are at hand. A rank is a plain number, so it costs no texts for what nobody reads."""
    whole = lambda status, reason, d=None: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), (F.lit(None).cast("string") if d is None else d.cast("string")).alias("difference"))
    out = (lambda status, reason, d=None: F.lit(SEVERITY.index(status))) if ranked else whole
    review = "HUMAN_REVIEW_REQUIRED"
    if not c.required:
        missing = out("NOT_APPLICABLE", "OPTIONAL_FIELD_MISSING")
    elif rule.missing == "UNMATCHED":
        missing = out("UNMATCHED", "REQUIRED_FIELD_MISSING")
    else:
        missing = out(review, "REQUIRED_FIELD_MISSING_BLOCKED" if rule.missing == "BLOCK_RULE" else "REQUIRED_FIELD_MISSING")
    case = F.when(left.isNull() | right.isNull(), missing)
    if kinds is not None:
        wrong = lambda kind: (kinds[0] != kind) | (kinds[1] != kind)
        case = F.when(kinds[0].isNull() | kinds[1].isNull() | (kinds[0] == "VOID") | (kinds[1] == "VOID"), missing)
        for kind, own, reason in (("STRING", TEXT, "NON_STRING_VALUE"), ("BOOLEAN", ("BOOLEAN_EXACT",), "NON_BOOLEAN_VALUE"), ("ARRAY", ("SET_CONTAINS",), "NON_ARRAY_SET_VALUE"), ("STRING", ("DATE_WINDOW",), "DATE_NOT_CANONICAL")):
            if c.comparator in own:
                case = case.when(wrong(kind), out(review, reason))
    if c.comparator in TEXT:
        same = normalized(left, c.normalizers) == normalized(right, c.normalizers)
        return case.when(same, out("EXACT_MATCH", "TEXT_EQUAL")).otherwise(out("CONFLICTING_MATCH", "TEXT_DIFFERENCE"))
    if c.comparator == "BOOLEAN_EXACT":
        return case.when(left == right, out("EXACT_MATCH", "BOOLEAN_EQUAL")).otherwise(out("CONFLICTING_MATCH", "BOOLEAN_DIFFERENCE"))
    if c.comparator == "SET_CONTAINS":
        return case.when(F.size(F.array_except(right, left)) == 0, out("EXACT_MATCH", "SET_CONTAINED")).otherwise(out("CONFLICTING_MATCH", "SET_DIFFERENCE"))
    if c.comparator == "DATE_WINDOW":
        l, r = days or (day_of(left), day_of(right))
        days = F.abs(r - l)
        case = case.when(l.isNull() | r.isNull(), out(review, "DATE_NOT_CANONICAL")).when(days == 0, out("EXACT_MATCH", "DATE_EQUAL", days))
        if c.tolerance is not None:
            case = case.when(days <= int(c.tolerance), out("WITHIN_TOLERANCE", "DATE_WITHIN_WINDOW", days) if c.tolerance_approved else out(review, "TOLERANCE_NOT_APPROVED", days))
        return case.otherwise(out("CONFLICTING_MATCH", "DATE_DIFFERENCE", days))
    if c.comparator not in ("DECIMAL_ABSOLUTE", "DECIMAL_RELATIVE"):
        raise ValueError(f"unknown comparator {c.comparator}")
    texts = [x if x is None else x.cast("string") for x in (left, right, aggregate)]
    if numbers is None:
        numbers = tuple(y for x in texts for y in ((decimal_or_null(x), fraction_digits(x)) if x is not None else (None, None)))
    if kinds is not None:
        case = case.when((kinds[0] != "STRING") | (kinds[1] != "STRING"), out(review, "DECIMAL_NOT_CANONICAL"))
    fast = numbers[0].isNotNull() & numbers[2].isNotNull()
    if rule.partial == "AGGREGATED_RIGHT_NOT_ABOVE_LEFT":
        fast = fast & (numbers[4].isNotNull() | texts[2].isNull())
    if ranked:
        shown = None
    elif None in scales:
        digits = F.greatest(numbers[1], numbers[3])
        shown = scaled_text(F.abs(numbers[2].cast("decimal(38,18)") - numbers[0].cast("decimal(38,18)")).cast("decimal(38,18)"), digits)
    else:
        shown = F.abs(numbers[2] - numbers[0]).cast("string")
    told = lambda decision, text: decision if ranked else F.struct(decision["status"].alias("status"), decision["reason"].alias("reason"), text.alias("difference"))
    narrow = told(_decision(c, rule, *_narrow_terms(c, numbers, scales, texts), ranked=ranked), shown)
    if None not in scales and numbers[4] is None:
        return case.otherwise(narrow)
    exact = D.is_decimal(texts[0]) & D.is_decimal(texts[1])
    wide = D.let(F.struct(D.order_key(texts[0]).alias("l"), D.order_key(texts[1]).alias("r"), *([] if texts[2] is None else [D.order_key(texts[2]).alias("total")])), lambda k: _decision(c, rule, *_wide_terms(c, texts, k), ranked=ranked))
    return case.when(fast, narrow).when(exact, told(wide, None if ranked else D.magnitude(D.difference(texts[0], texts[1])))).otherwise(out(review, "DECIMAL_NOT_CANONICAL"))


def _narrow_terms(c: Component, numbers: tuple, scales: tuple, texts: list) -> tuple:
    """What a decision needs of decimals that fit a type: equal, near, not negative, right < left, left < right, the total and whether it is at most left."""
    l, _, r, _, total, _ = numbers
    near = None
    if c.tolerance is not None and c.comparator == "DECIMAL_ABSOLUTE":
        near = F.coalesce(F.abs(r - l) <= F.lit(str(c.tolerance)).try_cast("decimal(38,18)"), D.within(texts[0], texts[1], str(c.tolerance)))
    elif c.tolerance is not None:
        read = [x if t is not None and t <= 8 else x.try_cast("decimal(24,8)") for x, t in zip((l, r), scales, strict=True)]
        whole, _, behind = str(c.tolerance).partition(".")
        fits = (read[0] == l) & (read[1] == r) if len(whole) <= 3 and len(behind) <= 6 else F.lit(False)
        near = F.when(fits, F.abs(read[1] - read[0]) <= F.lit(str(c.tolerance)).try_cast("decimal(9,6)") * F.greatest(F.abs(read[0]), F.abs(read[1]))).otherwise(D.within(texts[0], texts[1], str(c.tolerance), True))
    return l == r, near, (l >= 0) & (r >= 0), r < l, l < r, total, None if total is None else total <= l


def _wide_terms(c: Component, texts: list, keys: Column) -> tuple:
    """The same from texts of any width and their sorting keys."""
    l, r = keys["l"], keys["r"]
    near = None if c.tolerance is None else D.within(texts[0], texts[1], str(c.tolerance), c.comparator == "DECIMAL_RELATIVE")
    total = None if texts[2] is None else keys["total"]
    return l == r, near, (l >= "1") & (r >= "1"), r < l, l < r, total, None if total is None else total <= l


def _decision(c: Component, rule: Rule, equal: Column, near: Column | None, positive: Column, right_less: Column, left_less: Column, total: Column | None, fits: Column | None, ranked: bool = False) -> Column:
    """struct(status, reason) of two decimals, or the rank of the status; the first case that holds decides."""
    review = "HUMAN_REVIEW_REQUIRED"
    out = lambda status, reason: F.lit(SEVERITY.index(status)) if ranked else F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    case = F.when(equal, out("EXACT_MATCH", "DECIMAL_EQUAL"))
    if near is not None:
        case = case.when(near, out("WITHIN_TOLERANCE", "DECIMAL_WITHIN_TOLERANCE") if c.tolerance_approved else out(review, "TOLERANCE_NOT_APPROVED"))
    if rule.partial:
        if rule.partial == "AGGREGATED_RIGHT_NOT_ABOVE_LEFT":
            case = case.when(total.isNull(), out(review, "AGGREGATE_MISSING"))
            fits = positive & fits
        else:
            fits = positive & (right_less if rule.partial == "RIGHT_LESS_THAN_LEFT" else left_less)
        case = case.when(fits, out("PARTIAL_MATCH", rule.partial) if rule.partial_approved else out(review, "PARTIAL_POLICY_NOT_APPROVED"))
    if rule.partial_review:
        return case.otherwise(out(review, "PARTIAL_POLICY_REQUIRES_HUMAN_REVIEW"))
    return case.otherwise(out("CONFLICTING_MATCH", "DECIMAL_DIFFERENCE"))


def day_of(c: Column) -> Column:
    """The day of a canonical date text as a number; null for others."""
    return F.datediff(date_or_null(c), F.lit("1970-01-01").cast("date"))


def folded(ranks: list[Column]) -> Column:
    """The worst status of a pair, from the ranks of its components."""
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.least(*ranks, F.lit(len(SEVERITY) - 1)) + 1)


def pairs_of(left: DataFrame, right: DataFrame, rule: Rule, pairs: str = "keyed", told: bool = True, keys: bool = False, first: int | None = None) -> DataFrame:
    """left_id, right_id, status, comparisons (array of component, status, reason, difference and both values), n_conflicts (of them), partials (array of component
    and both values of what is allocated in part) and the sources of both records where these have a source_reference.

    Status and partials are made from the ranks of the components alone, so the texts of comparisons cost nothing where nobody reads them; without ``told`` there are none, which also spares the driver their expressions.
    With ``keys`` the columns _key0, ... tell what the pairs agree in, for ``resolved``; ``first``: so many keys deal the records, the others are compared inside of these."""
    dates = [c for c in rule.components if c.comparator == "DATE_WINDOW"]
    decimals = [c for c in rule.components if c.comparator.startswith("DECIMAL")]
    scale = lambda df, name: kind.scale if isinstance(kind := df.schema[name].dataType, DecimalType) else None
    typed = lambda df, name: isinstance(df.schema[name].dataType, VariantType)
    # a keyed join moves texts and their digits; numbers, which are twice as wide, are read again from the texts of a pair whose digits say that they fit
    late = pairs == "keyed" and bool(rule.keys)
    sets = {c.left for c in rule.components if c.comparator == "SET_CONTAINS"}, {c.right for c in rule.components if c.comparator == "SET_CONTAINS"}

    def side(df: DataFrame, mark: str, names: set[str], used: set[str], arrays: set[str], days: set[str]) -> DataFrame:
        # texts are read as decimals, and typed values as texts, once for each record, not for each pair
        made = df.select([F.col(f"`{c}`").alias(f"{mark}_{c}") for c in df.columns])
        made = made.withColumns({f"{mark}__kind_{n}": kind_of(F.col(f"{mark}_{n}")) for n in used if typed(df, n)})
        made = made.withColumns({f"{mark}_{n}": canonical_items(F.col(f"{mark}_{n}")) if n in arrays else text_of(F.col(f"{mark}_{n}")) for n in used if typed(df, n)})
        made = made.withColumns({f"{mark}__day_{n}": day_of(F.col(f"{mark}_{n}")) for n in sorted(days)})
        for n in sorted(names):
            text, k = F.col(f"{mark}_{n}").cast("string"), scale(df, n)
            number = decimal_or_null(text) if k is None else F.col(f"{mark}_{n}")
            made = made.withColumns({f"{mark}__digits_{n}": (F.when(number.isNotNull(), fraction_digits(text)) if late else fraction_digits(text)) if k is None else F.lit(k)} | ({} if late and k is None else {f"{mark}__number_{n}": number}))
        return made

    def kinds(c: Component) -> tuple[Column, Column] | None:
        """Kinds of both values where one of them is typed, or a column's type isn't the comparator's."""
        found = []
        for df, mark, n in ((left, "l", c.left), (right, "r", c.right)):
            kind = df.schema[n].dataType
            fixed = "STRING" if isinstance(kind, StringType) or c.comparator.startswith(("DECIMAL", "DATE")) else "BOOLEAN" if isinstance(kind, BooleanType) else "ARRAY" if isinstance(kind, ArrayType) else "NUMBER"
            found.append(F.col(f"{mark}__kind_{n}") if typed(df, n) else F.when(F.col(f"{mark}_{n}").isNotNull(), fixed))
        wanted = "STRING" if c.comparator in TEXT else "BOOLEAN" if c.comparator == "BOOLEAN_EXACT" else "ARRAY" if c.comparator == "SET_CONTAINS" else None
        plain = {"STRING": StringType, "BOOLEAN": BooleanType, "ARRAY": ArrayType}.get(wanted, object)
        return None if all(isinstance(df.schema[n].dataType, plain) and not typed(df, n) for df, n in ((left, c.left), (right, c.right))) else tuple(found)

    l = side(left, "l", {c.left for c in decimals}, {c.left for c in rule.components}, sets[0], {c.left for c in dates})
    r = side(right, "r", {c.right for c in decimals} | ({rule.aggregate} if rule.aggregate else set()), {c.right for c in rule.components}, sets[1], {c.right for c in dates})
    joined = _joined(l, r, rule, pairs, first)
    read_late = [F.when(F.col(f"{mark}__digits_{n}").isNotNull(), F.col(f"{mark}_{n}").cast("string").try_cast("decimal(38,18)")).alias(f"{mark}__number_{n}") for own, mark in ((l, "l"), (r, "r")) for n in sorted(x.removeprefix(f"{mark}__digits_") for x in own.columns if x.startswith(f"{mark}__digits_")) if f"{mark}__number_{n}" not in own.columns]
    if read_late:
        joined = joined.select("*", F.inline(F.array(F.struct(*read_late))))  # behind a generator, so that a filter on the status doesn't read them again
    aggregate = F.col(f"r_{rule.aggregate}") if rule.aggregate else None
    read = lambda mark, name: (F.col(f"{mark}__number_{name}"), F.col(f"{mark}__digits_{name}")) if name else (None, None)
    booleans = lambda c, x: x.cast("string") if c.comparator == "BOOLEAN_EXACT" else x

    def judged(c: Component, ranked: bool) -> Column:
        numbers = ((*read("l", c.left), *read("r", c.right), *read("r", rule.aggregate)), (scale(left, c.left), scale(right, c.right))) if c in decimals else ()
        days = (F.col(f"l__day_{c.left}"), F.col(f"r__day_{c.right}")) if c in dates else None
        return compared(c, rule, booleans(c, F.col(f"l_{c.left}")), booleans(c, F.col(f"r_{c.right}")), aggregate, *numbers, kinds=kinds(c), days=days, ranked=ranked)

    made = joined.withColumns({f"_{k}{i}": judged(c, k == "r") for i, c in enumerate(rule.components) for k in ("rc" if told else "r")})
    values = lambda c: (F.col(f"l_{c.left}").cast("string").alias("left_value"), F.col(f"r_{c.right}").cast("string").alias("right_value"))
    rows = F.array(*[F.struct(F.lit(c.name).alias("component"), *[F.col(f"_c{i}.{k}").alias(k) for k in ("status", "reason", "difference")], *values(c)) for i, c in enumerate(rule.components)])
    parts = [F.when(F.col(f"_r{i}") == SEVERITY.index("PARTIAL_MATCH"), F.struct(F.lit(c.name).alias("component"), *values(c))) for i, c in enumerate(rule.components) if c in decimals and rule.partial in ("RIGHT_LESS_THAN_LEFT", "LEFT_LESS_THAN_RIGHT")]
    partials = F.array_compact(F.array(*parts)) if parts else F.lit(None).cast("array<struct<component:string,left_value:string,right_value:string>>")
    # counted from the ranks, so that who only counts conflicts makes no comparisons
    conflicts = reduce(Column.__add__, [(F.col(f"_r{i}") == SEVERITY.index("CONFLICTING_MATCH")).cast("int") for i in range(len(rule.components))], F.lit(0))
    sources = [F.col(f"{mark}_source_reference").alias(f"{name}_source") for df, mark, name in ((left, "l", "left"), (right, "r", "right")) if "source_reference" in df.columns]
    sources += [normalized(F.col(f"l_{c.left}"), c.normalizers).alias(f"_key{i}") for i, c in enumerate(rule.keys)] if keys and late else []
    return made.select(F.lit(rule.name).alias("rule"), F.col("l_record_id").alias("left_id"), F.col("r_record_id").alias("right_id"), folded([F.col(f"_r{i}") for i in range(len(rule.components))]).alias("status"), *([rows.alias("comparisons")] if told else []), partials.alias("partials"), *([conflicts.alias("n_conflicts")] if told else []), *sources)


def band_of(rule: Rule) -> Component | None:
    """The component by which pairs of a rule without text keys can be made: none qualifies that lies outside of its tolerance."""
    fits = lambda c: c.required and (c.comparator == "DATE_WINDOW" or c.comparator == "DECIMAL_ABSOLUTE" and not rule.partial)
    return next((c for c in rule.components if fits(c)), None)


def decimal_bin(c: Column, digits: int) -> Column:
    """A decimal text cut towards zero at its digit of 10^digits, as a text: exact at any width. Values at most 10^digits apart have the same bin or neighbours."""
    whole, behind = F.regexp_extract(c, "^[+-]?([0-9]+)", 1), F.regexp_extract(c, r"\.([0-9]+)$", 1)
    cut = F.substring(whole, F.lit(1), F.length(whole) - digits) if digits >= 0 else F.concat(whole, F.rpad(F.substring(behind, 1, -digits), -digits, "0"))
    plain = F.regexp_replace(F.concat(F.lit("0"), cut), "^0+(?=[0-9])", "")
    return F.when(D.is_decimal(c), F.when(F.startswith(c, F.lit("-")) & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain))


def band_joined(l: DataFrame, r: DataFrame, c: Component, block: int = 10_000) -> DataFrame:
    """Pairs whose dates or decimals lie within the tolerance of a component, by bins as wide as it: each left record has one, each right one also both neighbours.

    The left records of a bin that has more than ``block`` are dealt into parts, each of which meets the bin's right records, so a hot bin is spread over tasks."""
    left, right = F.col(f"l_{c.left}"), F.col(f"r_{c.right}")
    if c.comparator == "DATE_WINDOW":
        width = int(c.tolerance or 0)
        bin_of = lambda x: F.floor(day_of(x) / max(width, 1))
        beside = lambda b: (b - 1, b, b + 1)
        near = F.abs(F.col("_rv") - F.col("_lv")) <= width
        value = day_of
    else:
        tolerance = format(Decimal(str(c.tolerance or 0)), "f")
        width = Decimal(tolerance)
        bin_of = (lambda x: decimal_bin(x.cast("string"), (width.next_minus().adjusted() + 1) if width else 0)) if width else (lambda x: D.order_key(x.cast("string")))
        beside = lambda b: (b, D.difference(F.lit("1"), b), D.difference(F.lit("-1"), b))
        value = lambda x: x.cast("string")
        fast = decimal_or_null(F.col("_rv")) - decimal_or_null(F.col("_lv"))
        near = F.coalesce(F.abs(fast) <= F.lit(tolerance).try_cast("decimal(38,18)"), D.within(F.col("_lv"), F.col("_rv"), tolerance))
    l = l.withColumns({"_lv": value(left), "_bin": bin_of(left)}).where("_bin IS NOT NULL")
    r = r.withColumns({"_rv": value(right), "_own": bin_of(right)}).where("_own IS NOT NULL")
    r = r.withColumn("_bin", F.explode(F.array(*beside(F.col("_own")))) if width else F.col("_own"))
    hot = l.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("_bin", F.ceil(F.col("_n") / block).alias("_parts"))
    l = l.join(hot, "_bin", "left").withColumn("_part", F.pmod(F.xxhash64("l_record_id"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    r = r.join(hot, "_bin", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", "_own")
    return l.join(r, ["_bin", "_part"]).where(near)


def _joined(l: DataFrame, r: DataFrame, rule: Rule, pairs: str, first: int | None = None) -> DataFrame:
    """Pairs by the rule's text components, else by a band of its dates or decimals, else all of them under the budget."""
    if pairs == "keyed" and rule.keys:
        both = [(normalized(F.col(f"l_{c.left}"), c.normalizers), normalized(F.col(f"r_{c.right}"), c.normalizers)) for c in rule.keys]
        # isin is an equality that Spark doesn't take for a key
        return l.join(r, [a == b if first is None or i < first else a.isin(b) for i, (a, b) in enumerate(both)])
    if pairs == "keyed" and (band := band_of(rule)):
        return band_joined(l, r, band)
    if l.count() * r.count() > rule.max_pairs:
        raise ValueError(f"{rule.name}: more than {rule.max_pairs} pairs")
    return l.crossJoin(r)


#: The sides whose records a cardinality allows one link each.
BOUNDED = {"ONE_TO_ONE": ("left", "right"), "ONE_TO_MANY": ("right",), "MANY_TO_ONE": ("left",), "MANY_TO_MANY": ()}


def resolved(pairs: DataFrame, *rules: Rule) -> DataFrame:
    """Qualifying pairs with ``selected`` by the cardinality of their rule, in one pass over all rules: records are counted only on the sides that a cardinality bounds.

    Where pairs of one rule tell their keys, records are counted inside of these: an id names one record, whose pairs share its keys, so the rows stay where the join dealt them."""
    q = pairs.where(F.col("status").isin(*QUALIFYING))
    keys = [c for c in pairs.columns if c.startswith("_key")]
    alone = lambda side: F.count(F.lit(1)).over(Window.partitionBy(*(keys or ["rule"]), f"{side}_id")) == 1
    by_side = {side: [r.name for r in rules if side in BOUNDED[r.cardinality]] for side in ("left", "right")}
    never = [r.name for r in rules if not BOUNDED[r.cardinality]]
    keep = ~F.col("rule").isin(*never) if never else F.lit(True)
    for side, names in by_side.items():
        if names:
            keep = keep & (alone(side) if len(names) == len(rules) else (~F.col("rule").isin(*names) | alone(side)))
    return q.withColumn("selected", keep).drop(*keys)


def shares(rule: Rule) -> bool:
    """Whether a record of the rule can hold parts of several links; one part alone is less than its holder, so others are never over-allocated."""
    holder = {"RIGHT_LESS_THAN_LEFT": "left", "LEFT_LESS_THAN_RIGHT": "right"}.get(rule.partial)
    return holder is not None and holder not in BOUNDED[rule.cardinality]


def lone_in_band(left: DataFrame, right: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The records of both sides that have exactly one partner within a tolerance: all that a ONE_TO_ONE rule of one decimal can link.

    Partners are counted without making pairs, so the work grows with the records, not with their pairs: all values and both ends of each record's band stand in one
    order, which is dealt by ranges, and a record has as many partners as values stand between its ends."""
    c = rule.components[0]
    if len(rule.components) > 1 or rule.cardinality != "ONE_TO_ONE" or c.comparator != "DECIMAL_ABSOLUTE" or not c.required or rule.partial or not c.tolerance_approved:
        raise ValueError(f"{rule.name} is no one-to-one rule of one decimal with an approved tolerance")
    tolerance = format(Decimal(str(c.tolerance or 0)), "f")
    kinds = [df.schema[n].dataType for df, n in ((left, c.left), (right, c.right))]
    narrow = all(isinstance(k, DecimalType) and k.precision <= 28 and k.scale <= 10 for k in kinds) and len(tolerance.partition(".")[0]) <= 18 and len(tolerance.partition(".")[2]) <= 10

    def marks(df: DataFrame, name: str, is_right: bool) -> DataFrame:
        if narrow:
            v, t = F.col(name).cast("decimal(36,10)"), F.lit(tolerance).cast("decimal(28,10)")
            low, own, high = ((x).cast("decimal(38,10)") for x in (v - t, v, v + t))
        else:
            v = F.col(name).cast("string")
            low, own, high = D.order_key(D.difference(F.lit(tolerance), v)), D.order_key(v), D.order_key(D.difference(F.lit(f"-{tolerance}"), v))
            low, high = F.when(own.isNotNull(), low), F.when(own.isNotNull(), high)
        # ends stand outside of the values that are equal to them
        ends = F.array(*[F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign")) for key, kind, sign in ((low, 0, -1), (own, 1, 0), (high, 2, 1))])
        return df.select(F.lit(is_right).alias("is_right"), F.col("record_id").alias("id"), F.inline(ends)).where("key IS NOT NULL")

    rows = marks(left, c.left, False).unionByName(marks(right, c.right, True))
    order, n = ["key", "kind", "id"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()), "bands")
    others = {True: F.count_if((F.col("kind") == 1) & ~F.col("is_right")), False: F.count_if((F.col("kind") == 1) & F.col("is_right"))}
    sums = dealt.groupBy("_piece").agg(others[False].alias("r"), others[True].alias("l"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    offsets = sums.select("_piece", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in "rl"])
    own = Window.partitionBy("_piece").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumns({"r": others[False].over(own), "l": others[True].over(own)}).where("sign <> 0").join(F.broadcast(offsets), "_piece")
    partners = F.when(F.col("is_right"), F.col("l") + F.col("_l")).otherwise(F.col("r") + F.col("_r"))
    lone = kept(here.groupBy("is_right", "id").agg(F.sum(F.col("sign") * partners).alias("n")).where("n = 1").select("is_right", F.col("id").alias("record_id")), "lone")
    return left.join(lone.where("NOT is_right").select("record_id"), "record_id", "left_semi"), right.join(lone.where("is_right").select("record_id"), "record_id", "left_semi")


def links_of(resolved_: DataFrame) -> DataFrame:
    more = [c for c in ("comparisons", "partials", "left_source", "right_source") if c in resolved_.columns]
    return resolved_.where("selected").select("rule", "left_id", "right_id", "status", *more, stable_id("link", F.col("rule"), F.col("left_id"), F.col("right_id")).alias("link_id"))


def ambiguities(resolved_: DataFrame) -> DataFrame:
    return resolved_.where("NOT selected").groupBy("rule", "left_id").agg(F.array_sort(F.collect_set("right_id")).alias("candidates"))


def unmatched(records: DataFrame, resolved_: DataFrame, side: str) -> DataFrame:
    """Records in no qualifying pair."""
    return records.join(resolved_.select(F.col(f"{side}_id").alias("record_id")), "record_id", "left_anti")


def allocations(links: DataFrame) -> DataFrame:
    """Partial comparisons of links as allocated part and capacity (exact texts); over-allocated groups are sent to review.

    The totals are joined back, so that the rows of a hot record can be split."""
    return _summed(_allocated_parts(links))


def _summed(rows: DataFrame) -> DataFrame:
    group = ["rule", "component", "holder"]
    made = rows.join(D.exact_sums(rows, group, "allocated"), group).withColumn("over", F.coalesce(decimal_or_null(F.col("total")) > decimal_or_null(F.col("capacity")), D.order_key(F.col("total")) > D.order_key(F.col("capacity"))))
    return made.select(*group, "left_id", "right_id", "allocated", "capacity", "total", F.when(F.col("over"), "HUMAN_REVIEW_REQUIRED").otherwise("PARTIAL_MATCH").alias("status"), F.when(F.col("over"), "PARTIAL_OVER_ALLOCATION").alias("reason"))


def _allocated_parts(links: DataFrame) -> DataFrame:
    """rule, left_id, right_id, component, allocated, capacity, holder: the smaller value is the part, the record of the larger one holds it."""
    parts = links.select("rule", "left_id", "right_id", F.explode("partials").alias("c"))
    l, r = F.col("c.left_value"), F.col("c.right_value")
    keyed = parts.select("rule", "left_id", "right_id", "c", F.coalesce(decimal_or_null(r) < decimal_or_null(l), D.order_key(r) < D.order_key(l)).alias("less"))
    return keyed.select("rule", "left_id", "right_id", "c.component", F.when(F.col("less"), r).otherwise(l).alias("allocated"), F.when(F.col("less"), l).otherwise(r).alias("capacity"), F.when(F.col("less"), F.col("left_id")).otherwise(F.col("right_id")).alias("holder"))


def over_allocations(links: DataFrame) -> DataFrame:
    """The allocations whose holder gave away more than it has. One part alone is less than its holder, so only holders of several are summed; these are
    written to the shared folder, so that their number is known before the parts are joined with them."""
    rows, group = _allocated_parts(links), ["rule", "component", "holder"]
    several = kept(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group), "holders")
    return _summed(rows.join(several, group, "left_semi")).where("reason IS NOT NULL")


def demoted(links: DataFrame, allocated: DataFrame) -> DataFrame:
    """Links with the status of their allocations (those over the top are enough): one that takes part in an over-allocation goes to review (with reason_code)."""
    over = allocated.where("reason IS NOT NULL").select("rule", "left_id", "right_id", "reason").distinct()
    return links.join(over, ["rule", "left_id", "right_id"], "left").withColumns({
        "status": F.when(F.col("reason").isNotNull(), "HUMAN_REVIEW_REQUIRED").otherwise(F.col("status")), "reason_code": F.col("reason")}).drop("reason")


def over_allocation_discrepancies(allocated: DataFrame) -> DataFrame:
    """One row for each over-allocated record and component."""
    some = allocated.where("reason IS NOT NULL").select("rule", "component", "holder", "capacity", "total").distinct()
    return some.select(stable_id("disc", F.lit("PARTIAL_OVER_ALLOCATION"), F.col("rule"), F.col("component"), F.col("holder")).alias("discrepancy_id"), "rule", "component", "holder", F.lit("PARTIAL_OVER_ALLOCATION").alias("type"), F.lit("MEDIUM").alias("severity"), "capacity", "total")


def overridden(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with the status and reason of their link where they are linked."""
    own = links.select("rule", "left_id", "right_id", F.col("status").alias("_status"), (F.col("reason_code") if "reason_code" in links.columns else F.lit(None).cast("string")).alias("_reason"))
    made = pairs.join(own, ["rule", "left_id", "right_id"], "left")
    status = F.coalesce("_status", "status")
    return made.withColumn("reason", F.coalesce("_reason", F.concat(F.lit("DETERMINISTIC_PAIR_STATUS_"), status))).withColumn("status", status).drop("_status", "_reason")


def quality_status(status: Column) -> Column:
    """What a match status means for the quality of the run."""
    return (F.when(status == "EXACT_MATCH", "PASS").when(status.isin("WITHIN_TOLERANCE", "PARTIAL_MATCH"), "PASS_WITH_WARNINGS").when(status.isin("STRONG_CANDIDATE", "AMBIGUOUS_MATCH", "HUMAN_REVIEW_REQUIRED"), "CONDITIONAL")
            .when(status.isin("CONFLICTING_MATCH", "UNMATCHED"), "FAIL").otherwise("NOT_TESTED"))


def result_rows(pairs: DataFrame, records: DataFrame | None, rule: Rule, run: dict[str, str]) -> DataFrame:
    """One canonical row for each evaluated pair: participants with their sources, component results, quality and review.

    ``pairs``: of overridden(); ``records``: record_id, source_reference (none: the pairs bring their sources along); ``run``: run_id, config_id, config_version, mode, grain and kinds of the two roles.
    """
    if records is None:
        both = pairs.withColumns({"_l": F.col("left_source"), "_r": F.col("right_source")})
    else:
        known = records.select("record_id", "source_reference")
        both = (pairs.join(known.select(F.col("record_id").alias("left_id"), F.col("source_reference").alias("_l")), "left_id", "left")
                .join(known.select(F.col("record_id").alias("right_id"), F.col("source_reference").alias("_r")), "right_id", "left"))
    kind = lambda side: run["grain"] if run.get("grain") in ("LINE_ITEM", "PAYMENT_ALLOCATION") else run.get(f"{side}_kind", "DOCUMENT")
    part = lambda side, role, ref: F.struct(F.lit(role).alias("role_id"), F.lit(kind(side)).alias("object_kind"), F.array(f"{side}_id").alias("record_ids"),
                                            F.when(F.trim(F.coalesce(F.col(ref), F.lit(""))) != "", F.array(ref)).otherwise(F.array().cast("array<string>")).alias("source_references"))
    review = ~F.col("status").isin(*QUALIFYING)
    fixed = [F.lit(run.get(k)).alias(k) for k in ("run_id", "config_id", "config_version", "mode", "grain")]
    return both.select(stable_id("recon", F.lit(run.get("run_id")), F.col("rule"), F.col("left_id"), F.col("right_id")).alias("reconciliation_id"), *fixed, "rule", "left_id", "right_id",
                       F.array(part("left", rule.left_role, "_l"), part("right", rule.right_role, "_r")).alias("participants"), F.col("comparisons").alias("rule_results"), "status", quality_status(F.col("status")).alias("quality_status"), "reason",
                       F.array().cast("array<string>").alias("supporting_evidence_ids"), review.alias("review_required"), F.when(review, "REQUIRED").otherwise("NOT_REQUIRED").alias("review_status"), *(["n_conflicts"] if "n_conflicts" in pairs.columns else []))


def output_view(results: DataFrame, view: str) -> DataFrame:
    """full: all rows; package: without those that need review; discrepancies: a row for each conflicting component."""
    if view == "full":
        return results
    if view == "package":
        return results.where(~F.col("review_required"))
    if view != "discrepancies":
        raise ValueError(f"unknown view {view}")
    return results.select("reconciliation_id", "rule", "left_id", "right_id", F.explode("rule_results").alias("c")).where("c.status = 'CONFLICTING_MATCH'").select("reconciliation_id", "rule", "left_id", "right_id", "c.component", "c.reason", "c.difference")


def view_counts(results: DataFrame) -> DataFrame:
    """view, n: the rows of each view (as in output_view), counted in one pass; results that bring n_conflicts along are counted without their comparisons."""
    conflicts = F.col("n_conflicts") if "n_conflicts" in results.columns else F.size(F.filter("rule_results", lambda c: c["status"] == "CONFLICTING_MATCH"))
    made = results.agg(F.count(F.lit(1)).alias("full"), F.count_if(~F.col("review_required")).alias("package"), F.coalesce(F.sum(conflicts), F.lit(0)).alias("discrepancies"))
    return made.unpivot([], ["full", "package", "discrepancies"], "view", "n")


def document_links(links: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Links with the sources of both documents (UNKNOWN where there is none), their keys and review status. The sources are those that the links bring along,
    or of documents (document_id, source_reference)."""
    named = lambda side: documents.select(F.col("document_id").alias(f"{side}_id"), F.col("source_reference").alias(f"_{side}"))
    made = links.withColumns({"_left": F.col("left_source"), "_right": F.col("right_source")}) if documents is None else links.join(named("left"), "left_id", "left").join(named("right"), "right_id", "left")
    if "match_keys" not in links.columns:
        made = made.withColumn("match_keys", F.array_sort("comparisons.component"))
    source = lambda side: F.coalesce(F.col(f"_{side}"), F.lit("UNKNOWN"))
    return made.select("link_id", F.col("left_id").alias("left_document_id"), F.col("right_id").alias("right_document_id"), F.col("status").alias("match_status"), "match_keys",
                       F.array_sort(F.array_distinct(F.array(source("left"), source("right")))).alias("source_references"), F.when(F.col("status").isin("PARTIAL_MATCH", "HUMAN_REVIEW_REQUIRED"), "PENDING").otherwise("NOT_REQUIRED").alias("human_review_status"))


#: The field names that decide a discrepancy's type, in the order in which they are tried.
FIELDS_OF_TYPE = (
    ("BANK_ACCOUNT_MISMATCH", ("account_number", "bank_account", "bank_account_number", "beneficiary_account", "beneficiary_account_number", "beneficiary_bank_account", "payee_account", "payee_bank_account")),
    ("QUANTITY_MISMATCH", ("quantity", "ordered_quantity", "received_quantity", "invoiced_quantity")),
    ("PRICE_MISMATCH", ("unit_price", "price", "unit_cost")),
    ("TAX_MISMATCH", ("tax", "tax_amount", "tax_rate", "vat_amount", "vat_rate")),
    ("CURRENCY_MISMATCH", ("currency", "currency_code")),
    ("AMOUNT_MISMATCH", ("amount", "gross_amount", "net_amount", "total_amount", "payment_amount")),
)
PARTY_FIELDS = ("party", "party_id", "vendor", "vendor_id", "customer", "customer_id")


def discrepancy_type_of(left: Column, right: Column, comparator: Column) -> Column:
    """The type of a conflict by whole field names, whatever their case, and the comparator."""
    names = F.array(F.lower(left), F.lower(right))
    named = lambda own: F.arrays_overlap(names, F.array(*map(F.lit, own)))
    case = F.when(named(FIELDS_OF_TYPE[0][1]), FIELDS_OF_TYPE[0][0])
    for kind, own in FIELDS_OF_TYPE[1:]:
        case = case.when(named(own), kind)
    dated = F.exists(names, lambda x: F.endswith(x, F.lit("_date")) | (x == "date"))
    return case.when((comparator == "DATE_WINDOW") | dated, "DATE_MISMATCH").when(named(PARTY_FIELDS), "PARTY_MISMATCH").when(comparator == "IDENTIFIER_EXACT", "REFERENCE_MISMATCH").otherwise("SYSTEM_DOCUMENT_MISMATCH")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the last by ``order``, with all its columns."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), F.col(order)).alias("_row")).select(key, "_row.*").select(*rows.columns)


def discrepancies(pairs: DataFrame, *rules: Rule) -> DataFrame:
    """A row for each conflicting component; a pair is evaluated once for a rule, so ids don't repeat."""
    known = F.create_map(*[F.lit(x) for r in rules for c in r.components for x in (f"{r.name}\n{c.name}", f"{c.left}\n{c.right}\n{c.comparator}")])
    rows = pairs.select("rule", "left_id", "right_id", F.explode("comparisons").alias("c")).where("c.status = 'CONFLICTING_MATCH'").withColumn("_of", F.split(known[F.concat_ws("\n", "rule", "c.component")], "\n"))
    rows = rows.withColumn("type", discrepancy_type_of(F.col("_of")[0], F.col("_of")[1], F.col("_of")[2]))
    return rows.select(stable_id("disc", F.col("rule"), F.col("left_id"), F.col("right_id"), F.col("c.component")).alias("discrepancy_id"), "rule", "left_id", "right_id", "c.component", "type",
                       F.when(F.col("type") == "BANK_ACCOUNT_MISMATCH", "HIGH").otherwise("MEDIUM").alias("severity"), "c.difference")


def group_key(records: DataFrame, name: str) -> Column:
    """What a group is known by: a typed value's canonical JSON, so that 1 and "1" are two groups and members' order doesn't matter; other columns as they are."""
    return F.when(kind_of(F.col(name)) != "VOID", F.to_json(F.col(name))) if isinstance(records.schema[name].dataType, VariantType) else F.col(name)


def _group_missing(keys: list[str]) -> Column:
    return F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1


def aggregated(records: DataFrame, keys: list[str], value: str, json_keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Of each group: sum, least and greatest of its decimals (with their own digits), number of all its records, id; and the rejected records with a reason.

    Records without a decimal count among n_records and are rejected for the others; those without a key, or with one of ``json_keys`` (texts of
    JSON) that is not strict JSON, are rejected for all. Texts are summed exactly at any width (a text), decimal columns as such.
    """
    kind = records.schema[value].dataType
    if isinstance(kind, VariantType):
        records = records.withColumn(value, F.when(kind_of(F.col(value)) == "STRING", text_of(F.col(value))))
    read = records.withColumns({f"_raw_{k}": F.col(k).isNotNull() for k in json_keys}).withColumns({k: canonical_json(F.col(k)) if k in json_keys else group_key(records, k) for k in keys})
    broken = F.greatest(*[(F.col(f"_raw_{k}") & F.col(k).isNull()).cast("int") for k in json_keys], F.lit(0), F.lit(0)) == 1
    text = F.col(value).cast("string")
    good_value = F.col(value).isNotNull() if isinstance(kind, DecimalType) else D.is_decimal(text)
    marked = read.withColumns({"_t": F.when(good_value, text), "reason": F.when(broken, "GROUP_VALUE_NOT_CANONICAL_JSON").when(_group_missing(keys), "GROUP_FIELD_MISSING").when(~good_value, "DECIMAL_VALUE_MISSING_OR_INVALID")})
    whole = marked.where(~_group_missing(keys))
    if isinstance(kind, DecimalType) and kind.precision <= 28:
        good = whole.groupBy(*keys).agg(F.sum(value).alias("sum_value"), F.count(F.lit(1)).alias("n_records"), F.min_by("_t", value).alias("min_value"), F.max_by("_t", value).alias("max_value"))
    else:
        good = D.exact_aggregates(whole, keys, "_t")
    return good.withColumn("aggregation_result_id", stable_id("agg", *[F.to_json(F.struct(k)) for k in keys])), marked.where("reason IS NOT NULL").select("record_id", "reason")


def aggregation_members(records: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the groups: a row for each record of a group, with the group's id."""
    records = records.withColumns({k: group_key(records, k) for k in keys})
    return records.where(~_group_missing(keys)).select(stable_id("agg", *[F.to_json(F.struct(k)) for k in keys]).alias("aggregation_result_id"), *keys, "record_id")


def run_status(statuses: DataFrame, n_discrepancies: Column | int) -> DataFrame:
    """PASS, PASS_WITH_WARNINGS or CONDITIONAL from link statuses (column status) and a count."""
    return statuses.agg(F.when((F.lit(n_discrepancies) > 0) | F.coalesce(F.bool_or(F.col("status") == "HUMAN_REVIEW_REQUIRED"), F.lit(False)), "CONDITIONAL")
                        .when(F.coalesce(F.bool_or(F.col("status").isin("WITHIN_TOLERANCE", "PARTIAL_MATCH")), F.lit(False)), "PASS_WITH_WARNINGS").otherwise("PASS").alias("run_status"))


def classified(documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """Role by document type: none, one or several roles give UNCLASSIFIED, the role or AMBIGUOUS; aliases: document_type, role."""
    roles = aliases.groupBy("document_type").agg(F.count_distinct("role").alias("n"), F.min("role").alias("role"))
    return documents.join(roles, "document_type", "left").withColumn("role", F.when(F.coalesce("n", F.lit(0)) == 0, "UNCLASSIFIED").when(F.col("n") > 1, "AMBIGUOUS").otherwise(F.col("role"))).drop("n")


def missing_roles(required: DataFrame, records: DataFrame) -> DataFrame:
    return required.join(records.select("role").distinct(), "role", "left_anti").withColumn("type", F.lit("MISSING_REQUIRED_ROLE"))


def with_group_total(records: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The group's sum at each record, by a join that can be split where a group is hot; a record without a key has none."""
    if isinstance(records.schema[value].dataType, DecimalType):
        totals = records.groupBy(*keys).agg(F.sum(value).alias(out))
    else:
        totals = D.exact_sums(records, keys, value).withColumnRenamed("total", out)
    return records.join(totals, keys, "left").select(*records.columns, out)


def readiness(run: DataFrame, issues: DataFrame) -> DataFrame:
    """BLOCKED where the run's status (run_status) isn't one of a finished run or a required role is missing, else READY_FOR_HUMAN_REVIEW; issues: issue_code."""
    missing = issues.agg(F.coalesce(F.bool_or(F.col("issue_code") == "MISSING_REQUIRED_ROLE"), F.lit(False)).alias("missing"))
    known = run.agg(F.coalesce(F.bool_and(F.col("run_status").isin("PASS", "PASS_WITH_WARNINGS", "CONDITIONAL")), F.lit(False)).alias("known"))
    return known.join(F.broadcast(missing)).select(F.when(~F.col("known") | F.col("missing"), "BLOCKED").otherwise("READY_FOR_HUMAN_REVIEW").alias("readiness"))  # a row each


def bridged(left: DataFrame, right: DataFrame, bridge: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left_id, right_id, n_bridges of records that the rows of ``bridge`` (left_key, right_key) connect.

    Bridge rows are counted before the joins, so a hot key meets once in each; rows with a null key connect nothing.
    """
    ways = bridge.where(F.col(left_key).isNotNull() & F.col(right_key).isNotNull()).groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("n_bridges"))
    l, r = left.select(left_key, F.col("record_id").alias("left_id")), right.select(right_key, F.col("record_id").alias("right_id"))
    return ways.join(l, left_key).join(r, right_key).select("left_id", "right_id", "n_bridges")
