"""Exact decimals of any width, in column expressions.

A canonical decimal text (of at most ``MAX_CHARACTERS``) needs no type that could hold it: it is compared by a key that sorts as the
numbers do, and added, subtracted and multiplied as an array of limbs of nine digits, most significant first, which
stand at fixed distances from the decimal point. A sum over a group adds the limbs of each place apart, which merges on both sides of a shuffle,
and carries once at the end. Narrow values take DECIMAL arithmetic; the callers choose by row.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARACTERS = 10_000
DECIMAL = "^[+-]?(0|[1-9][0-9]*)([.][0-9]+)?$"
LIMB = 9
_BASE = 10**LIMB
#: What the fast way of a sum takes: 18 digits before and 10 behind the point, so that 10^10 of them fit.
NARROW = "decimal(28,10)"

# The functions that start with an underscore make SQL texts from SQL texts: one text is parsed for a whole expression, where a call for each of its
# hundreds of nodes would take a second or more for each column.
_names = itertools.count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once, however often it is named."""
    v = f"v{next(_names)}"
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def applied(body: Callable[..., str], **columns: Column) -> Column:
    """The SQL text that ``body`` makes of these columns (each computed once)."""
    v = f"v{next(_names)}"
    made = F.expr(f"{v} -> {body(*[f'{v}.{k}' for k in columns])}")
    return F.call_function("transform", F.array(F.struct(*[c.alias(k) for k, c in columns.items()])), made)[0]


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(c), f)[0]


def _is_decimal(x: str) -> str:
    return f"coalesce(rlike({x}, '{DECIMAL}') AND length({x}) <= {MAX_CHARACTERS}, false)"


def _digits(x: str) -> str:
    """struct(negative, whole, behind): the digits before and behind the point; a zero is never negative."""
    return f"named_struct('negative', startswith({x}, '-') AND rlike({x}, '[1-9]'), 'whole', regexp_extract({x}, '^[+-]?([0-9]+)', 1), 'behind', regexp_extract({x}, '[.]([0-9]+)$', 1))"


def _order_key(x: str) -> str:
    def key(d: str) -> str:
        size = f"concat(lpad(CAST(length({d}.whole) AS STRING), 5, '0'), {d}.whole, trim(TRAILING '0' FROM {d}.behind))"
        return f"CASE WHEN {d}.negative THEN concat('0', translate({size}, '0123456789', '9876543210'), '~') ELSE concat('1', {size}) END"

    return f"CASE WHEN {_is_decimal(x)} THEN {_let(_digits(x), key)} END"


def _limbs(whole: str, behind: str, before: str, after: str) -> str:
    """Limbs of digits, padded to so many limbs before and behind the point."""
    return f"transform(regexp_extract_all(concat(lpad({whole}, CAST({before} * {LIMB} AS INT), '0'), rpad({behind}, CAST({after} * {LIMB} AS INT), '0')), '[0-9]{{{LIMB}}}', 0), x -> CAST(x AS BIGINT))"


def _count(n: str) -> str:
    return f"greatest(CAST(({n} + {LIMB - 1}) div {LIMB} AS INT), 1)"


def _carried(limbs: str) -> str:
    """Limbs of any sign and size brought to 0..10^9-1, with one more in front that takes what is left (below zero for a negative number)."""
    digit = f"pmod(x + s.carry, {_BASE}L)"
    return f"aggregate(reverse({limbs}), named_struct('carry', 0L, 'done', CAST(array() AS ARRAY<BIGINT>)), (s, x) -> named_struct('carry', (x + s.carry - {digit}) div {_BASE}L, 'done', concat(array({digit}), s.done)), s -> concat(array(s.carry), s.done))"


def _limbs_text(limbs: str, after: str, scale: str) -> str:
    """A number's text with ``scale`` digits behind the point, from carried limbs of which ``after`` stand behind it; any zero is 0 with no sign."""
    def text(v: str) -> str:
        cut = f"length({v}.text) - {after} * {LIMB}"
        whole = f"regexp_replace(substring({v}.text, 1, {cut}), '^0+(?=[0-9])', '')"
        return f"CASE WHEN rlike({v}.text, '[1-9]') THEN concat(CASE WHEN {v}.negative THEN '-' ELSE '' END, {whole}, CASE WHEN {scale} > 0 THEN concat('.', substring({v}.text, {cut} + 1, {scale})) ELSE '' END) ELSE '0' END"

    def shown(x: str) -> str:
        size = f"CASE WHEN {x}[0] < 0 THEN {_carried(f'transform({x}, y -> -y)')} ELSE {x} END"
        return _let(f"named_struct('negative', {x}[0] < 0, 'text', array_join(transform({size}, y -> lpad(CAST(y AS STRING), {LIMB}, '0')), ''))", text)

    return _let(limbs, shown)


def _difference(l: str, r: str) -> str:
    def of(v: str) -> str:
        size = f"named_struct('before', {_count(f'greatest(length({v}.l.whole), length({v}.r.whole))')}, 'scale', greatest(length({v}.l.behind), length({v}.r.behind)))"

        def made(n: str) -> str:
            after = _count(f"{n}.scale")
            signed = lambda d: _let(_limbs(f"{d}.whole", f"{d}.behind", f"{n}.before", after), lambda y: f"CASE WHEN {d}.negative THEN transform({y}, z -> -z) ELSE {y} END")
            return _limbs_text(_carried(f"zip_with({signed(f'{v}.r')}, {signed(f'{v}.l')}, (a, b) -> a - b)"), after, f"{n}.scale")

        return _let(size, made)

    return _let(f"named_struct('l', {_digits(l)}, 'r', {_digits(r)})", of)


def _scaled(x: str, factor: str) -> str:
    whole, _, behind = factor.lstrip("+").partition(".")
    if whole.startswith("-"):
        raise ValueError(f"a factor is not negative: {factor}")
    digits = whole + behind.ljust(-(-len(behind) // LIMB) * LIMB, "0")
    digits = digits.rjust(-(-len(digits) // LIMB) * LIMB, "0")
    parts = [int(digits[i:i + LIMB]) for i in range(0, len(digits), LIMB)]
    zeros = lambda n: f"CAST(array({', '.join(['0L'] * n)}) AS ARRAY<BIGINT>)"

    def of(d: str) -> str:
        after = _count(f"length({d}.behind)")

        def product(limbs: str) -> str:
            total = None
            for j, part in enumerate(parts):  # each product of limbs is below 10^18
                row = f"concat({zeros(j)}, {_carried(f'transform({limbs}, y -> y * {part}L)')}, {zeros(len(parts) - 1 - j)})"
                total = row if total is None else f"zip_with({total}, {row}, (a, b) -> a + b)"
            return _limbs_text(_carried(total), f"({after} + {-(-len(behind) // LIMB)})", f"(length({d}.behind) + {len(behind)})")

        return _let(_limbs(f"{d}.whole", f"{d}.behind", _count(f"length({d}.whole)"), after), product)

    return _let(_digits(x), of)


def _added(*texts: str) -> str:
    """The sum of texts; each may be taken from the sum by a minus in front of its name."""
    part = lambda x: f"named_struct('minus', {'true' if x.startswith('-') else 'false'}, 'd', {_digits(x.lstrip('-'))})"

    def of(v: str) -> str:
        most = lambda side: f"array_max(transform({v}, p -> length(p.d.{side})))"
        size = f"named_struct('before', {_count(most('whole'))}, 'scale', {most('behind')})"

        def made(n: str) -> str:
            after = _count(f"{n}.scale")
            signed = _let(_limbs("p.d.whole", "p.d.behind", f"{n}.before", after), lambda y: f"CASE WHEN p.d.negative != p.minus THEN transform({y}, z -> -z) ELSE {y} END")
            return _limbs_text(_carried(f"aggregate(transform({v}, p -> {signed}), transform(sequence(1, {n}.before + {after}), i -> 0L), (s, x) -> zip_with(s, x, (a, b) -> a + b))"), after, f"{n}.scale")

        return _let(size, made)

    return _let(f"array({', '.join(map(part, texts))})", of)


def _settled(sums: str) -> str:
    """Sums of limbs or of their products (an array of DECIMAL(38,0), which may have more digits than a long) as limbs; what is left goes to the first one."""
    zero = "CAST(0 AS DECIMAL(38,0))"
    digit = f"CAST(pmod(CAST(x + s.carry AS DECIMAL(38,0)), CAST({_BASE} AS DECIMAL(10,0))) AS BIGINT)"
    step = f"named_struct('carry', CAST((CAST(x + s.carry AS DECIMAL(38,0)) - CAST({digit} AS DECIMAL(10,0))) / CAST({_BASE} AS DECIMAL(10,0)) AS DECIMAL(38,0)), 'done', concat(array({digit}), s.done))"
    front = f"concat(array(s.done[0] + CAST(s.carry AS BIGINT) * {_BASE}L), slice(s.done, 2, 10000))"
    return f"aggregate(reverse({sums}), named_struct('carry', {zero}, 'done', CAST(array() AS ARRAY<BIGINT>)), (s, x) -> {step}, s -> {front})"


def _product(l: str, r: str) -> str:
    def of(v: str) -> str:
        before, after = (lambda d: _count(f"length({d}.whole)")), (lambda d: _count(f"length({d}.behind)"))
        limbs = lambda d: _limbs(f"{d}.whole", f"{d}.behind", before(d), after(d))

        def times(n: str) -> str:
            # limb k of the product: all products of limbs whose places add up to it
            own = f"aggregate(sequence(greatest(0, k - size({n}.r) + 1), least(k, size({n}.l) - 1)), CAST(0 AS DECIMAL(38,0)), (s, i) -> CAST(s + CAST({n}.l[i] * {n}.r[k - i] AS DECIMAL(20,0)) AS DECIMAL(38,0)))"
            sums = f"concat(array(CAST(0 AS DECIMAL(38,0))), transform(sequence(0, size({n}.l) + size({n}.r) - 2), k -> {own}))"
            signed = lambda x: f"CASE WHEN {v}.l.negative != {v}.r.negative THEN transform({x}, y -> -y) ELSE {x} END"
            return _limbs_text(_carried(_let(_settled(sums), signed)), f"({after(f'{v}.l')} + {after(f'{v}.r')})", f"(length({v}.l.behind) + length({v}.r.behind))")

        return _let(f"named_struct('l', {limbs(f'{v}.l')}, 'r', {limbs(f'{v}.r')})", times)

    return _let(f"named_struct('l', {_digits(l)}, 'r', {_digits(r)})", of)


def _magnitude(x: str) -> str:
    return f"regexp_replace({x}, '^[+-]', '')"


def _within(l: str, r: str, tolerance: str, relative: bool) -> str:
    larger = lambda v: f"CASE WHEN {_order_key(f'{v}.l')} >= {_order_key(f'{v}.r')} THEN {v}.l ELSE {v}.r END"
    bound = _let(f"named_struct('l', {_magnitude(l)}, 'r', {_magnitude(r)})", lambda v: _scaled(larger(v), tolerance)) if relative else f"'{tolerance}'"
    return f"{_let(_magnitude(_difference(l, r)), _order_key)} <= {_let(bound, _order_key)}"


def is_decimal(c: Column) -> Column:
    """Whether a text is a canonical decimal; false for null."""
    return F.coalesce(F.rlike(c, F.lit(DECIMAL)) & (F.length(c) <= MAX_CHARACTERS), F.lit(False))


def order_key(c: Column) -> Column:
    """A text that sorts, and is equal, as the numbers are: 1.50 and 1.5 have the same one; null for what is no decimal."""
    return applied(_order_key, c=c)


def magnitude(c: Column) -> Column:
    """The text without its sign."""
    return F.regexp_replace(c, "^[+-]", "")


def difference(l: Column, r: Column) -> Column:
    """The exact text of r - l, with as many digits behind the point as the finer of both."""
    return applied(_difference, l=l, r=r)


def added(parts: list[tuple[bool, Column]]) -> Column:
    """The exact text of a sum of few decimals, each with whether it is subtracted."""
    return applied(lambda *names: _added(*[("-" if minus else "") + n for (minus, _), n in zip(parts, names, strict=True)]), **{f"c{i}": c for i, (_, c) in enumerate(parts)})


def product(l: Column, r: Column) -> Column:
    """The exact text of l times r, with the digits behind the point of both."""
    return applied(_product, l=l, r=r)


def scaled(c: Column, factor: str) -> Column:
    """The exact text of a decimal's magnitude times a factor that is a decimal text known when the plan is made."""
    return applied(lambda x: _scaled(x, factor), c=c)


def within(l: Column, r: Column, tolerance: str, relative: bool = False) -> Column:
    """|r - l| <= tolerance, or <= tolerance times the larger magnitude."""
    if not re.fullmatch(DECIMAL, tolerance):
        raise ValueError(f"a tolerance is a canonical decimal text: {tolerance}")
    return applied(lambda l, r: _within(l, r, tolerance, relative), l=l, r=r)


def narrow(c: Column) -> Column:
    """The decimal where the fast sum takes it, else null."""
    return F.when(F.length(F.regexp_extract(c, r"\.([0-9]+)$", 1)) <= 10, c.try_cast(NARROW))


def exact_aggregates(rows: DataFrame, keys: list[str], value: str, extremes: bool = True) -> DataFrame:
    """keys, sum_value, n_records (and min_value, max_value) of each group of canonical decimal texts, of any width, as texts.

    Rows without a decimal count among n_records alone. The sum has the digits behind the point of its finest value; least and greatest value stand as they were written.
    Each row gives its narrow part, or the limbs of a wide one by their place, so partial sums are made before the shuffle. Places are few (a value has
    ``MAX_CHARACTERS`` at most), so a group's limbs come together in one row.
    """
    def places(d: str) -> str:
        # place 0 stands before the point, -1 behind it; a narrow value is one row without a place
        before = _count(f"length({d}.whole)")
        return f"transform({_limbs(f'{d}.whole', f'{d}.behind', before, _count(f'length({d}.behind)'))}, (x, i) -> named_struct('place', {before} - 1 - i, 'limb', CASE WHEN {d}.negative THEN -x ELSE x END, 'first', i = 0))"

    dealt_out = F.expr(f"CASE WHEN _text IS NOT NULL AND _fast IS NULL THEN {_let(_digits('_text'), places)} ELSE array(named_struct('place', CAST(NULL AS INT), 'limb', CAST(NULL AS BIGINT), 'first', true)) END")
    read = rows.select(*keys, F.when(is_decimal(F.col(value)), F.col(value)).alias("_text")).select("*", narrow(F.col("_text")).alias("_fast"), F.length(F.regexp_extract("_text", r"\.([0-9]+)$", 1)).alias("_scale"))
    marked = read.select("*", F.explode(dealt_out).alias("_l"))
    dealt = marked.groupBy(*keys, F.col("_l.place").alias("_place")).agg(
        F.sum(F.when(F.col("_l.first"), F.col("_fast"))).alias("_fast"), F.sum(F.col("_l.limb").cast("decimal(18,0)")).alias("_limb"), F.max("_scale").alias("_scale"), F.count_if("_l.first").alias("_n"))
    grouped = dealt.groupBy(*keys).agg(F.sum("_fast").alias("_fast"), F.max("_scale").alias("_scale"), F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", "_limb"))).alias("_limbs"), F.sum("_n").alias("n_records"))
    if extremes:
        # texts are compared in a pass of their own: an aggregate that holds texts sorts its rows, and beside the sums it would sort a value once for each of its places
        key = F.when(F.col("_text").isNotNull(), F.struct(order_key(F.col("_text")).alias("key"), F.col("_text").alias("text")))
        ends = read.select(*[F.col(k).alias(f"_of_{k}") for k in keys], key.alias("_key")).groupBy(*[f"_of_{k}" for k in keys]).agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
        grouped = grouped.join(ends, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True)))
    narrow_text = F.col("_fast").cast("string")
    plain = F.when(F.col("_scale") == 0, F.substring_index(narrow_text, ".", 1)).otherwise(F.substring(narrow_text, F.lit(1), F.length(narrow_text) - 10 + F.col("_scale")))
    plain = F.when(F.col("_fast") == 0, "0").otherwise(plain)
    total = F.when(F.size("_limbs") == 0, plain).otherwise(F.expr(_summed()))
    return grouped.select(*keys, total.alias("sum_value"), "n_records", *([F.col("_least.text").alias("min_value"), F.col("_most.text").alias("max_value")] if extremes else []))


def exact_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and ``total``: the exact sum of each group."""
    return exact_aggregates(rows, keys, value, extremes=False).select(*keys, F.col("sum_value").alias("total"))


def _summed() -> str:
    """The text of a group's sums of limbs by place (_limbs) and its narrow sum (_fast, null: none)."""
    def settled(v: str) -> str:
        return _settled(f"transform(sequence({v}.high, {v}.low, -1), p -> coalesce(try_element_at({v}.at, p), CAST(0 AS DECIMAL(38,0))))")

    def total(v: str) -> str:
        own = _let(_limbs(f"{v}.fast.whole", f"{v}.fast.behind", f"({v}.high + 1)", f"(-{v}.low)"), lambda x: f"CASE WHEN {v}.fast.negative THEN transform({x}, y -> -y) ELSE {x} END")
        return _limbs_text(_carried(f"zip_with({settled(v)}, {own}, (a, b) -> a + b)"), f"(-{v}.low)", "_scale")

    at = "map_from_entries(transform(_limbs, x -> named_struct('place', x._place, 'limb', CAST(x._limb AS DECIMAL(38,0)))))"
    place = "transform(_limbs, x -> x._place)"
    return _let(f"named_struct('low', least(array_min({place}), -2), 'high', greatest(array_max({place}) + 2, 4), 'at', {at}, 'fast', {_digits("coalesce(CAST(_fast AS STRING), '0')")})", total)
