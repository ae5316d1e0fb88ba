"""Rules of document types: declared as text, compiled into column expressions, applied in one projection.

``type name`` opens a type; ``rule level id kind severity field ...`` declares a rule of its documents (level header) or of their lines (level line).
A field may be ``-name`` (subtracted in sums), ``sum(name)`` (the exact sum of a field over the document's lines) or
``~0.01`` (a tolerance); FORMAT takes ``/pattern/`` last. Sums and products have as many digits as they need.

Records: document_id, document_type, fields (a map of variants). Every rule gives one outcome:
PASS, FAIL, REVIEW (can't be decided: not canonical, ambiguous, or only a reader can) or NOT_APPLICABLE (a value that it needs is missing), and a reason.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decimals as D
from ..functions.fields import date_or_null, fraction_digits, iso_date_or_same, kind_of, scaled_text

#: The rules that the document types declare, with the signs of their sums.
BUNDLED = """
type INVOICE
rule header invoice.required-status REQUIRED_STATUS CRITICAL invoice_number invoice_date seller_name buyer_name currency total_amount
rule header invoice.identifier-text IDENTIFIER_AS_TEXT HIGH invoice_number seller_tax_id buyer_tax_id seller_bank_account po_number contract_number grn_number
rule header invoice.date-ambiguity DATE_AMBIGUITY HIGH invoice_date due_date
rule line invoice.line-total MULTIPLICATION HIGH quantity unit_price line_total
rule header invoice.grand-total ARITHMETIC_SUM CRITICAL subtotal -discount_amount tax_amount freight_amount rounding_amount total_amount
rule header invoice.amount-words AMOUNT_IN_WORDS_COMPARE MEDIUM amount_in_words total_amount currency
type PURCHASE_ORDER
rule header po.required-status REQUIRED_STATUS CRITICAL po_number po_date buyer_name vendor_name currency total_po_amount
rule header po.identifier-text IDENTIFIER_AS_TEXT HIGH po_number vendor_code vendor_tax_id contract_number amendment_number
rule line po.line-total MULTIPLICATION HIGH ordered_quantity unit_price line_value
rule header po.grand-total ARITHMETIC_SUM CRITICAL sum(line_value) total_po_amount
type BANK_STATEMENT
rule header bank-statement.required-status REQUIRED_STATUS CRITICAL statement_reference account_number account_holder_name statement_start_date statement_end_date statement_currency
rule header bank-statement.identifier-text IDENTIFIER_AS_TEXT HIGH statement_reference account_number iban swift_code bank_transaction_id transaction_reference counterparty_account payment_request_number invoice_number
rule header bank-statement.period-order DATE_ORDER CRITICAL statement_start_date statement_end_date statement_generated_date
rule line bank-statement.amount-representation CROSS_FIELD_CONSISTENCY CRITICAL credit_amount -debit_amount signed_amount
rule header bank-statement.balance ARITHMETIC_SUM CRITICAL opening_balance -total_debits total_credits closing_balance
type RECEIPT
rule header receipt.required-status REQUIRED_STATUS CRITICAL merchant_name transaction_date total_amount currency
rule header receipt.line-total ARITHMETIC_SUM HIGH sum(line_total) tax_amount tip_amount total_amount
rule header receipt.identifier-text IDENTIFIER_AS_TEXT HIGH receipt_number merchant_tax_id expense_claim_number employee_reference card_last_four
rule header receipt.date-ambiguity DATE_AMBIGUITY HIGH transaction_date
type PAYMENT
rule header payment.required-status REQUIRED_STATUS CRITICAL payment_reference payment_date payer_name beneficiary_name amount currency
rule header payment.net-amount ARITHMETIC_SUM HIGH amount -bank_fee -withholding_amount net_amount
rule header payment.identifier-text IDENTIFIER_AS_TEXT CRITICAL payment_reference payer_account beneficiary_account transaction_id bank_reference invoice_references
rule header payment.date-order DATE_ORDER MEDIUM payment_date value_date posting_date
"""
#: What may be said of a signature, and the severities.
PRESENCE = ("PRESENT", "NOT_PRESENT", "ILLEGIBLE", "UNKNOWN")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
OUTCOME = "struct<outcome:string,reason:string>"


@dataclass(frozen=True)
class TypeRule:
    document_type: str
    level: str
    rule_id: str
    kind: str
    severity: str
    fields: tuple[str, ...]
    tolerance: str = "0"
    pattern: str | None = None


def load_rules(text: str = BUNDLED) -> list[TypeRule]:
    """The declared rules, checked: known kinds, levels and severities, ids of their own, enough fields."""
    rules, now = [], None
    for line in filter(None, map(str.strip, text.splitlines())):
        what, *w = line.split(" ", 5)
        if what == "type":
            now = w[0]
            continue
        if what != "rule" or now is None or len(w) < 5:
            raise ValueError(f"unknown line: {line}")
        level, rule_id, kind, severity, rest = w
        pattern = m[1] if (m := re.search(r" ?/(.*)/$", rest)) else None
        names = (rest[:m.start()] if m else rest).split()
        tolerance = next((n[1:] for n in names if n.startswith("~")), "0")
        fields = tuple(n for n in names if not n.startswith("~"))
        if kind not in KINDS or level not in ("header", "line") or severity not in SEVERITIES or rule_id in {r.rule_id for r in rules}:
            raise ValueError(f"rule {rule_id}: unknown kind, level or severity, or declared twice")
        if len(fields) < KINDS[kind][1] or (kind == "FORMAT") != (pattern is not None) or kind == "MULTIPLICATION" and len(fields) != 3:
            raise ValueError(f"rule {rule_id}: {kind} needs other fields")
        if not re.fullmatch(D.DECIMAL, tolerance) or tolerance.startswith("-"):
            raise ValueError(f"rule {rule_id}: a tolerance is a decimal that is not negative")
        rules.append(TypeRule(now, level, rule_id, kind, severity, fields, tolerance, pattern))
    return rules


def _known(name: str) -> str:
    return re.sub(r"\W", "_", name.lstrip("-"))


def _kind(name: str) -> Column:
    """The kind of a field's value; null where it is missing or a JSON null."""
    return F.col(f"_f.{_known(name)}.kind")


def _any(name: str) -> Column:
    """A field's value as a text, whatever its kind."""
    return F.col(f"_f.{_known(name)}.text")


def _text(name: str) -> Column:
    return F.when(_kind(name) == "STRING", _any(name))


def _read(fields: str, rules: list[TypeRule]) -> Column:
    """struct(kind, text) of each field that a rule of the record's type names, read once for each record."""
    types: dict[str, set[str]] = {}
    for r in rules:
        for n in r.fields:
            types.setdefault(n.lstrip("-"), set()).add(r.document_type)

    def one(n: str) -> Column:
        text = lambda v, k: F.when(k == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        made = D.let(F.try_element_at(fields, F.lit(n)), lambda v: D.let(kind_of(v), lambda k: F.when(k != "VOID", F.struct(k.alias("kind"), text(v, k).alias("text")))))
        return F.when(F.col("document_type").isin(*sorted(types[n])), made).alias(_known(n))

    return F.struct(*[one(n) for n in sorted(types)])


def _said(outcome: str, reason: str | Column | None = None) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), (reason if isinstance(reason, Column) else F.lit(reason).cast("string")).alias("reason"))


def _listed(names: tuple[str, ...], is_: Callable[[str], Column]) -> Column:
    """The names for which something holds, sorted, in one text."""
    return F.concat_ws(",", *[F.when(F.coalesce(is_(n), F.lit(False)), n.lstrip("-")) for n in sorted(names, key=lambda n: n.lstrip("-"))])


def _wrong(names: Column, failing: str, code: str) -> Column:
    return F.when(names != "", _said(failing, F.concat(F.lit(f"{code}:"), names)))


def _required(r: TypeRule) -> Column:
    return _wrong(_listed(r.fields, lambda n: _kind(n).isNull() | (F.trim(_any(n)) == "")), "FAIL", "MISSING").otherwise(_said("PASS"))


def _identifiers(r: TypeRule) -> Column:
    none = F.greatest(*[_kind(n).isNotNull().cast("int") for n in r.fields], F.lit(0)) == 0
    return _wrong(_listed(r.fields, lambda n: ~_kind(n).isin("STRING", "ARRAY")), "FAIL", "NOT_TEXT").when(none, _said("NOT_APPLICABLE")).otherwise(_said("PASS"))


def _format(r: TypeRule) -> Column:
    none = F.greatest(*[_kind(n).isNotNull().cast("int") for n in r.fields], F.lit(0)) == 0
    return _wrong(_listed(r.fields, lambda n: _kind(n).isNotNull() & ~F.coalesce(F.rlike(_text(n), F.lit(f"^(?:{r.pattern})$")), F.lit(False))), "FAIL", "FORMAT").when(none, _said("NOT_APPLICABLE")).otherwise(_said("PASS"))


def _ambiguous(r: TypeRule) -> Column:
    none = F.greatest(*[_kind(n).isNotNull().cast("int") for n in r.fields], F.lit(0)) == 0
    return _wrong(_listed(r.fields, lambda n: _kind(n).isNotNull() & date_or_null(iso_date_or_same(_text(n))).isNull()), "REVIEW", "AMBIGUOUS_DATE").when(none, _said("NOT_APPLICABLE")).otherwise(_said("PASS"))


def _order(r: TypeRule) -> Column:
    unclear = _listed(r.fields, lambda n: _kind(n).isNotNull() & date_or_null(_text(n)).isNull())
    # canonical dates sort as texts
    few = reduce(Column.__add__, [_kind(n).isNotNull().cast("int") for n in r.fields]) < 2
    turned = reduce(Column.__or__, [F.coalesce(_text(a) > _text(b), F.lit(False)) for a, b in itertools.combinations(r.fields, 2)])
    return _wrong(unclear, "REVIEW", "DATE_NOT_CANONICAL").when(few, _said("NOT_APPLICABLE")).when(turned, _said("FAIL", "DATES_OUT_OF_ORDER")).otherwise(_said("PASS"))


def _compared(parts: Column, total: Column, r: TypeRule, fast: Column, digits: Column) -> Column:
    """Whether a sum or product agrees with the stated value; the reason names the exact difference.

    ``fast``: what the stated value has more, as a DECIMAL(38,18) where nothing is rounded, else null; ``digits``: those that the difference shows. Only wider values are taken apart."""
    slow = D.let(F.struct(parts.alias("l"), total.alias("r")), lambda v: F.when(D.within(v["l"], v["r"], r.tolerance), _said("PASS")).otherwise(_said("FAIL", F.concat(F.lit("DIFFERENCE:"), D.difference(v["l"], v["r"])))))
    quick = F.when(F.abs(fast) <= F.lit(r.tolerance).try_cast("decimal(38,18)"), _said("PASS")).otherwise(_said("FAIL", F.concat(F.lit("DIFFERENCE:"), scaled_text(fast, digits))))
    return F.when(fast.isNotNull() & (digits <= 18) & F.lit(r.tolerance).try_cast("decimal(38,18)").isNotNull() & F.lit(len(r.tolerance.partition(".")[2]) <= 18), quick).otherwise(slow)


def _sum(r: TypeRule) -> Column:
    *parts, total = r.fields
    unclear = _listed(r.fields, lambda n: _kind(n).isNotNull() & ~D.is_decimal(_text(n)))
    none = _kind(total).isNull() | (F.greatest(*[_kind(n).isNotNull().cast("int") for n in parts], F.lit(0)) == 0)
    # missing parts are left out, never invented
    added = D.added([(n.startswith("-"), F.coalesce(_text(n), F.lit("0"))) for n in parts])
    narrow = lambda n: F.coalesce(D.narrow(_text(n)), F.when(_text(n).isNull(), F.lit("0").cast(D.NARROW)))
    fast = narrow(total)
    for n in parts:
        fast = fast + narrow(n) if n.startswith("-") else fast - narrow(n)
    digits = F.greatest(*[F.coalesce(fraction_digits(_text(n)), F.lit(0)) for n in r.fields], F.lit(0))
    return _wrong(unclear, "REVIEW", "DECIMAL_NOT_CANONICAL").when(none, _said("NOT_APPLICABLE")).otherwise(_compared(added, _text(total), r, fast.try_cast("decimal(38,18)"), digits))


def _times(r: TypeRule) -> Column:
    a, b, total = r.fields
    unclear = _listed(r.fields, lambda n: _kind(n).isNotNull() & ~D.is_decimal(_text(n)))
    none = F.greatest(*[_kind(n).isNull().cast("int") for n in r.fields], F.lit(0)) == 1
    narrow = lambda n, scale, kind: F.when(fraction_digits(_text(n)) <= scale, _text(n).try_cast(kind))
    digits = F.greatest(fraction_digits(_text(a)) + fraction_digits(_text(b)), fraction_digits(_text(total)))
    return _wrong(unclear, "REVIEW", "DECIMAL_NOT_CANONICAL").when(none, _said("NOT_APPLICABLE")).otherwise(_compared(D.product(_text(a), _text(b)), _text(total), r, narrow(total, 18, "decimal(37,18)") - narrow(a, 9, "decimal(18,9)") * narrow(b, 9, "decimal(18,9)"), digits))


def _same(fold: Callable[[Column], Column], code: str) -> Callable[[TypeRule], Column]:
    def compiled(r: TypeRule) -> Column:
        unclear = _listed(r.fields, lambda n: _kind(n).isNotNull() & (_kind(n) != "STRING"))
        values = F.array_distinct(F.array_compact(F.array(*[fold(_text(n)) for n in r.fields])))
        return _wrong(unclear, "REVIEW", "NOT_TEXT").otherwise(D.let(values, lambda v: F.when(F.size(v) == 0, _said("NOT_APPLICABLE")).when(F.size(v) == 1, _said("PASS")).otherwise(_said("FAIL", F.concat(F.lit(f"{code}:"), F.array_join(F.array_sort(v), ","))))))

    return compiled


def _words(r: TypeRule) -> Column:
    both = _kind(r.fields[0]).isNotNull() & _kind(r.fields[1]).isNotNull()
    return F.when(both, _said("REVIEW", "WORDS_NEED_A_READER")).otherwise(_said("NOT_APPLICABLE"))


def _signed(r: TypeRule) -> Column:
    none = F.greatest(*[_kind(n).isNotNull().cast("int") for n in r.fields], F.lit(0)) == 0
    return _wrong(_listed(r.fields, lambda n: _kind(n).isNotNull() & ~F.coalesce(_text(n).isin(*PRESENCE), F.lit(False))), "FAIL", "NO_PRESENCE_STATUS").when(none, _said("NOT_APPLICABLE")).otherwise(_said("PASS"))


#: Compiler and least number of fields of each kind.
KINDS: dict[str, tuple[Callable[[TypeRule], Column], int]] = {
    "REQUIRED_STATUS": (_required, 1), "IDENTIFIER_AS_TEXT": (_identifiers, 1), "FORMAT": (_format, 1), "DATE_AMBIGUITY": (_ambiguous, 1), "DATE_ORDER": (_order, 2), "ARITHMETIC_SUM": (_sum, 2), "MULTIPLICATION": (_times, 3),
    "CURRENCY_CONSISTENCY": (_same(lambda c: F.upper(F.trim(c)), "CURRENCIES"), 2), "AMOUNT_IN_WORDS_COMPARE": (_words, 2), "REFERENCE_CONSISTENCY": (_same(lambda c: c, "REFERENCES"), 2), "PAGE_TOTAL_RECONCILIATION": (_sum, 2),
    "SIGNATURE_PRESENCE_ONLY": (_signed, 1), "CROSS_FIELD_CONSISTENCY": (_sum, 2)}


def with_line_sums(documents: DataFrame, lines: DataFrame, rules: list[TypeRule]) -> DataFrame:
    """Documents whose fields hold ``sum(name)`` for each such field that a rule names: exact sums over their lines, joined by document_id."""
    wanted = sorted({f.lstrip("-")[4:-1] for r in rules for f in r.fields if f.lstrip("-").startswith("sum(")})
    out = documents
    for name in wanted:
        v = F.try_element_at("fields", F.lit(name))
        # no filter on the lines' texts, since it would be pushed below what reads them and read them again
        sums = D.exact_sums(lines.select("document_id", v.alias("_v")).select("document_id", F.when(kind_of("_v") == "STRING", F.try_variant_get("_v", "$", "string")).alias("_v")), ["document_id"], "_v").where("total IS NOT NULL")
        sums = sums.select("document_id", F.create_map(F.lit(f"sum({name})"), F.parse_json(F.concat(F.lit('"'), "total", F.lit('"')))).alias("_more"))
        out = out.join(sums, "document_id", "left").withColumn("fields", F.when(F.col("_more").isNotNull(), F.map_concat("fields", "_more")).otherwise(F.col("fields"))).drop("_more")
    return out


def rule_outcomes(records: DataFrame, rules: list[TypeRule], level: str = "header") -> DataFrame:
    """All columns of the records and ``outcomes``: an array of struct(rule_id, kind, severity, outcome, reason) with the rules of each record's type."""
    own = [r for r in rules if r.level == level]
    one = lambda r: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), KINDS[r.kind][0](r).cast(OUTCOME).alias("said"))
    kind = f"array<struct<rule_id:string,kind:string,severity:string,said:{OUTCOME}>>"
    made = F.array().cast(kind)
    # a choice among types, not a filter over all rules: functions that take other functions are evaluated without compiled code, and all that stands in them
    for t in sorted({r.document_type for r in own}):
        made = F.when(F.col("document_type") == t, F.array(*[one(r) for r in own if r.document_type == t]).cast(kind)).otherwise(made)
    if not own:
        return records.withColumn("outcomes", made)
    return records.select("*", _read("fields", own).alias("_f")).withColumn("outcomes", made).drop("_f")


def failing(outcomes: DataFrame) -> DataFrame:
    """A row for each rule that failed or needs a review: document_id, rule_id, kind, severity, outcome, reason."""
    # filtered inside: behind a plain column Spark would ask for its size first, which makes all outcomes twice
    rows = outcomes.select("document_id", F.explode(F.filter("outcomes", lambda o: o["said"]["outcome"].isin("FAIL", "REVIEW"))).alias("o"))
    return rows.select("document_id", "o.rule_id", "o.kind", "o.severity", "o.said.outcome", "o.said.reason")
