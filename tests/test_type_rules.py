import pytest
from pyspark.sql import functions as F

from tessera.functions.fields import strict_json
from tessera.operators import type_rules as T

RULES = """
type X
rule header x.required REQUIRED_STATUS CRITICAL a b
rule header x.text IDENTIFIER_AS_TEXT HIGH a b
rule header x.format FORMAT LOW a /[A-Z]{2}-[0-9]+/
rule header x.date DATE_AMBIGUITY HIGH d
rule header x.order DATE_ORDER HIGH d e f
rule header x.sum ARITHMETIC_SUM HIGH p -q r ~0.01
rule header x.times MULTIPLICATION HIGH p q s
rule header x.currency CURRENCY_CONSISTENCY HIGH c1 c2
rule header x.words AMOUNT_IN_WORDS_COMPARE INFO w r
rule header x.reference REFERENCE_CONSISTENCY HIGH a a2
rule header x.pages PAGE_TOTAL_RECONCILIATION HIGH sum(page) r
rule header x.sign SIGNATURE_PRESENCE_ONLY HIGH g
"""


def outcomes(spark, documents, lines=()):
    rules = T.load_rules(RULES)
    make = lambda rows: spark.createDataFrame([(i, "X", t) for i, t in rows], "document_id string, document_type string, t string").select("document_id", "document_type", F.try_variant_get(F.parse_json("t"), "$", "map<string,variant>").alias("fields"))
    rows = T.rule_outcomes(T.with_line_sums(make(documents), make(lines), rules), rules).collect()
    return {r.document_id: {o.rule_id[2:]: (o.said.outcome, o.said.reason) for o in r.outcomes} for r in rows}


def test_outcomes(spark):
    got = outcomes(spark, [
        ("good", '{"a":"AB-1","b":"0","d":"31.12.2024","e":"2024-12-31","p":"10.00","q":"0.5","r":"9.51","s":"5","c1":"usd","c2":"USD ","a2":"AB-1","g":"ILLEGIBLE"}'),
        ("bad", '{"a":7,"b":" ","d":"03/04/2024","e":"2024-02-01","f":"2024-01-01","p":"1e3","q":"1","r":"9","s":"2","c1":"usd","c2":"EUR","a2":"AB-2","g":"signed","w":"nine"}'),
        ("off", '{"a":"ab-1","b":null,"d":"2024-02-30","p":"123456789012345678901234567890.5","q":"-2","r":"1","s":"-246913578024691357802469135781.0","a2":"AB-1"}'),
        ("none", "{}")], [("off", '{"page":"0.4"}'), ("off", '{"page":"0.6"}'), ("off", '{"page":7}'), ("bad", '{"page":"8"}'), ("bad", '{"page":"0.5"}')])
    good, bad, off, none = (got[k] for k in ("good", "bad", "off", "none"))
    assert {k for k, v in good.items() if v[0] == "PASS"} == {"required", "text", "format", "date", "sum", "times", "currency", "reference", "sign"} and good["order"] == ("REVIEW", "DATE_NOT_CANONICAL:d") and good["pages"][0] == "NOT_APPLICABLE"
    assert bad["required"] == ("FAIL", "MISSING:b") and bad["text"] == ("FAIL", "NOT_TEXT:a") and bad["format"] == ("FAIL", "FORMAT:a") and bad["date"] == ("REVIEW", "AMBIGUOUS_DATE:d")
    assert bad["sum"] == bad["times"] == ("REVIEW", "DECIMAL_NOT_CANONICAL:p") and bad["currency"] == ("FAIL", "CURRENCIES:EUR,USD") and bad["words"][0] == "REVIEW" and bad["sign"] == ("FAIL", "NO_PRESENCE_STATUS:g") and bad["reference"] == ("REVIEW", "NOT_TEXT:a") and bad["pages"] == ("FAIL", "DIFFERENCE:0.5")
    assert off["required"] == ("FAIL", "MISSING:b") and off["format"] == ("FAIL", "FORMAT:a") and off["date"] == ("REVIEW", "AMBIGUOUS_DATE:d") and off["times"] == ("PASS", None) and off["sum"] == ("FAIL", "DIFFERENCE:-123456789012345678901234567891.5") and off["reference"] == ("FAIL", "REFERENCES:AB-1,ab-1") and off["pages"] == ("PASS", None)
    assert none["required"] == ("FAIL", "MISSING:a,b") and {v[0] for k, v in none.items() if k != "required"} == {"NOT_APPLICABLE"}


def test_dates_in_order(spark):
    got = outcomes(spark, [("up", '{"d":"2024-01-01","f":"2024-01-01"}'), ("down", '{"d":"2024-01-02","e":"2024-01-01"}')])
    assert (got["up"]["order"][0], got["down"]["order"]) == ("PASS", ("FAIL", "DATES_OUT_OF_ORDER"))


def test_declarations_are_checked():
    assert len(T.load_rules()) == 23
    for line in ("rule header x UNKNOWN HIGH a", "rule page x FORMAT HIGH a /b/", "rule header x FORMAT HIGH a", "rule header x MULTIPLICATION HIGH a b", "rule header x ARITHMETIC_SUM HIGH a b ~-1", "rule header x DATE_ORDER LOUD a b"):
        with pytest.raises(ValueError):
            T.load_rules(f"type X\n{line}")


def test_narrow_and_wide_sums_and_products_tell_the_same_difference(spark):
    rules = T.load_rules("type X\nrule header s ARITHMETIC_SUM LOW a -b total ~0.01\nrule header p MULTIPLICATION LOW a b total")
    rows = [("1", "2.50", "0.50", "2.00"), ("2", "2.50", "0.50", "1.000"), ("3", "1" + "0" * 40, "1", "1" + "0" * 40), ("4", "-0.3", "0.3", "-0.600")]
    df = spark.createDataFrame(rows, "document_id string, a string, b string, total string").select("document_id", F.lit("X").alias("document_type"), F.create_map(*[x for n in ("a", "b", "total") for x in (F.lit(n), F.parse_json(F.concat(F.lit('"'), n, F.lit('"'))))]).alias("fields"))
    found = {(r.document_id, r.rule_id): r.reason for r in T.failing(T.rule_outcomes(df, rules)).collect()}
    assert found == {("1", "p"): "DIFFERENCE:0.7500", ("2", "s"): "DIFFERENCE:-1.000", ("2", "p"): "DIFFERENCE:-0.2500", ("3", "s"): "DIFFERENCE:1", ("4", "p"): "DIFFERENCE:-0.510"}


def test_outcomes_and_line_sums_are_made_once(spark):
    rules = T.load_rules("type X\nrule header x.pages ARITHMETIC_SUM HIGH sum(page) r\nrule header x.order DATE_ORDER HIGH d e f\ntype Y\nrule header y.text IDENTIFIER_AS_TEXT HIGH r")
    make = lambda rows: spark.createDataFrame(rows, "document_id string, document_type string, t string").select("document_id", "document_type", F.try_variant_get(strict_json(F.col("t")), "$", "map<string,variant>").alias("fields"))
    documents = make([("a", "X", '{"r":"3","d":"2024-01-02","f":"2024-01-01"}'), ("b", "X", '{"r":"3","d":"2024-01-02","e":null}'), ("c", "Y", '{"r":3}'), ("d", None, '{"r":3}'), ("e", "X", '{"r":"3"} x')])
    found = T.failing(T.rule_outcomes(T.with_line_sums(documents, make([("a", "X", '{"page":"1"}'), ("a", "X", '{"page":"+3.5"}'), ("b", "X", '{"page":"x"}'), ("b", "X", '{"page":3}'), ("e", "X", '{"page":"1"}')]), rules), rules))
    assert {(r.document_id, r.rule_id): r.reason for r in found.collect()} == {("a", "x.pages"): "DIFFERENCE:-1.5", ("a", "x.order"): "DATES_OUT_OF_ORDER", ("c", "y.text"): "NOT_TEXT:r"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("x.pages") == plan.count("y.text") == 1
    assert plan.count("[page]") + plan.count(", page,") == 1 and plan.count('{"v":') == 2
