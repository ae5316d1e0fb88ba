"""Validation as rows: a JSON-Schema interpreter, package files, record packages, canonical blocks, and their summary."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TYPES = {"null": type(None), "boolean": bool, "string": str, "array": list, "object": dict}
ERRORS = "array<struct<path:string,keyword:string,message:string>>"


def _is(x: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(x, (int, float)) and not isinstance(x, bool) and (kind == "number" or float(x).is_integer())
    return isinstance(x, _TYPES[kind])


def _same(a: object, b: object) -> bool:
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) and isinstance(a, bool) == isinstance(b, bool)


def _date(x: str) -> None:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
        raise ValueError(x)
    date.fromisoformat(x)


def _date_time(x: str) -> None:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})", x):
        raise ValueError(x)
    datetime.fromisoformat(x.upper().replace("Z", "+00:00"))


class Schema:
    """A JSON schema with local references: types, const, enum, combinations, conditions and the bounds of all kinds of values."""

    def __init__(self, root: dict | bool, depth: int = 128):
        self.root, self.depth = root, depth

    def _target(self, ref: str) -> object:
        if not ref.startswith("#"):
            raise ValueError(f"only local references are followed: {ref}")
        at: object = self.root
        for part in ref[1:].split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            at = at[int(part)] if isinstance(at, list) else at[part]
        return at

    def errors(self, x: object, schema: object = None, path: str = "$", level: int = 0) -> Iterator[tuple[str, str, str]]:
        """(path, keyword, message) in the order of keywords."""
        schema = self.root if schema is None else schema
        if level > self.depth:
            raise ValueError("references are nested too deeply")
        if isinstance(schema, bool):
            if not schema:
                yield path, "false", "no value is allowed"
            return
        more = lambda s, y=x, p=path: self.errors(y, s, p, level + 1)
        fits = lambda s: next(more(s), None) is None
        if "$ref" in schema:
            yield from more(self._target(schema["$ref"]))
        for s in schema.get("allOf", ()):
            yield from more(s)
        if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
            yield path, "anyOf", "no alternative fits"
        if "oneOf" in schema and (n := sum(map(fits, schema["oneOf"]))) != 1:
            yield path, "oneOf", f"{n} alternatives fit"
        if "not" in schema and fits(schema["not"]):
            yield path, "not", "a value that is excluded"
        if "if" in schema:
            yield from more(schema.get("then" if fits(schema["if"]) else "else", True))
        kinds = schema.get("type")
        if kinds is not None and not any(_is(x, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            yield path, "type", f"not of type {kinds if isinstance(kinds, str) else ', '.join(kinds)}"
            return
        if "const" in schema and not _same(x, schema["const"]):
            yield path, "const", "not the value that is asked for"
        if "enum" in schema and not any(_same(x, y) for y in schema["enum"]):
            yield path, "enum", "not one of the values"
        if isinstance(x, dict):
            yield from self._object(x, schema, path, level)
        elif isinstance(x, list):
            yield from self._array(x, schema, path, level)
        elif isinstance(x, str):
            yield from self._text(x, schema, path)
        elif _is(x, "number"):
            for key, bad in (("minimum", lambda b: x < b), ("maximum", lambda b: x > b), ("exclusiveMinimum", lambda b: x <= b), ("exclusiveMaximum", lambda b: x >= b), ("multipleOf", lambda b: (x / b) % 1)):
                if key in schema and bad(schema[key]):
                    yield path, key, f"{key} is {schema[key]}"

    def _sized(self, n: int, schema: dict, path: str, least: str, most: str) -> Iterator[tuple[str, str, str]]:
        if n < schema.get(least, 0):
            yield path, least, f"{n} are fewer than {schema[least]}"
        if n > schema.get(most, n):
            yield path, most, f"{n} are more than {schema[most]}"

    def _object(self, x: dict, schema: dict, path: str, level: int) -> Iterator[tuple[str, str, str]]:
        known = schema.get("properties", {})
        for key in schema.get("required", ()):
            if key not in x:
                yield path, "required", f"{key} is missing"
        yield from self._sized(len(x), schema, path, "minProperties", "maxProperties")
        for key, value in x.items():
            if key in known:
                yield from self.errors(value, known[key], f"{path}.{key}", level + 1)
            elif "additionalProperties" in schema:
                if schema["additionalProperties"] is False:
                    yield path, "additionalProperties", f"{key} is not expected"
                else:
                    yield from self.errors(value, schema["additionalProperties"], f"{path}.{key}", level + 1)

    def _array(self, x: list, schema: dict, path: str, level: int) -> Iterator[tuple[str, str, str]]:
        yield from self._sized(len(x), schema, path, "minItems", "maxItems")
        if schema.get("uniqueItems") and len({json.dumps(y, sort_keys=True) for y in x}) < len(x):
            yield path, "uniqueItems", "items repeat"
        if "items" in schema:
            for i, y in enumerate(x):
                yield from self.errors(y, schema["items"], f"{path}[{i}]", level + 1)

    def _text(self, x: str, schema: dict, path: str) -> Iterator[tuple[str, str, str]]:
        yield from self._sized(len(x), schema, path, "minLength", "maxLength")
        if "pattern" in schema and not re.search(schema["pattern"], x):
            yield path, "pattern", "the pattern isn't found"
        check = {"date": _date, "date-time": _date_time}.get(schema.get("format", ""))
        if check:
            try:
                check(x)
            except ValueError:
                yield path, "format", f"not a {schema['format']}"


def _strict(text: str) -> object:
    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a member is named twice")
        return dict(pairs)

    def never(x: str) -> None:
        raise ValueError(f"{x} is no JSON number")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


def schema_errors(records: DataFrame, schema: dict, text: str = "text", most: int = 200) -> DataFrame:
    """``records`` with ``errors``: the first ``most`` of each; null or broken JSON gives one error with keyword parse. Own columns stay."""
    kept = [c for c in records.columns if c != "errors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checked = Schema(schema)
        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                try:
                    value = _strict(t if t is not None else "")
                except ValueError:
                    out.append([("$", "parse", "not strict JSON")])
                    continue
                found = []
                for e in checked.errors(value):
                    found.append(e)
                    if len(found) == most:
                        break
                out.append(found)
            kind = pa.list_(pa.struct([("path", pa.string()), ("keyword", pa.string()), ("message", pa.string())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([[dict(zip(("path", "keyword", "message"), e)) for e in x] for x in out], kind)], names=[*kept, "errors"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name in kept)
    return records.select(*kept).mapInArrow(run, f"{fields}, errors {ERRORS}")


def error_rows(checked: DataFrame, key: str) -> DataFrame:
    return checked.select(key, F.posexplode("errors").alias("position", "e")).select(key, "position", "e.path", "e.keyword", "e.message")


def validation_summary(checked: DataFrame, package_errors: DataFrame | None = None) -> DataFrame:
    """n_records, n_valid, n_invalid, n_errors, n_package_errors and the status of the whole."""
    counts = checked.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.size("errors") == 0).alias("n_valid"), F.count_if(F.size("errors") > 0).alias("n_invalid"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("n_errors"))
    package = package_errors.agg(F.count(F.lit(1)).alias("n_package_errors")) if package_errors is not None else checked.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_package_errors"))
    return counts.join(F.broadcast(package)).withColumn("status", F.when((F.col("n_invalid") == 0) & (F.col("n_package_errors") == 0), "VALID").otherwise("INVALID"))  # a row each


def package_file_errors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, error: declared files (path, sha256) that are missing, differ or have no proper digest; files: path, content."""
    made = manifest.join(files.select("path", F.sha2("content", 256).alias("_found")), "path", "left")
    error = F.when(~F.coalesce(F.rlike("sha256", F.lit("^[0-9a-f]{64}$")), F.lit(False)), "BAD_DIGEST").when(F.col("_found").isNull(), "MISSING").when(F.col("_found") != F.col("sha256"), "MISMATCH")
    return made.select("path", error.alias("error")).where("error IS NOT NULL")


def path_collisions(paths: DataFrame) -> DataFrame:
    """path, error: paths that are unsafe, that fold to the same one, or that are a folder of another; paths: path."""
    from ..functions.fields import folded_path, safe_relative_path

    named = paths.select("path", folded_path(F.col("path")).alias("_folded"))
    parents = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_folded", "/")) - 1), lambda i: F.array_join(F.slice(F.split("_folded", "/"), F.lit(1), i), "/"))).alias("_folded")).where("_folded <> ''").distinct()
    same = named.groupBy("_folded").agg(F.count_distinct("path").alias("n")).where("n > 1").select("_folded")
    return (paths.where(~safe_relative_path(F.col("path"))).select("path", F.lit("UNSAFE").alias("error"))
            .unionByName(named.join(same, "_folded", "left_semi").select("path", F.lit("CASE_COLLISION").alias("error")))
            .unionByName(named.join(parents, "_folded", "left_semi").select("path", F.lit("PREFIX_COLLISION").alias("error"))))


def record_errors(records: DataFrame, roles: list[str]) -> DataFrame:
    """record_id, error of a record package: id grammar, ids that repeat, unknown roles, evidence ids that repeat or break the grammar."""
    grammar = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"
    checks = F.array_compact(F.array(F.when(~F.coalesce(F.rlike("record_id", F.lit(grammar)), F.lit(False)), "INVALID_ID"), F.when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "UNKNOWN_ROLE"),
                                     F.when(F.size(F.array_distinct("evidence_ids")) < F.size("evidence_ids"), "EVIDENCE_REPEATS"), F.when(F.exists("evidence_ids", lambda e: ~F.coalesce(F.rlike(e, F.lit(grammar)), F.lit(False))), "INVALID_EVIDENCE_ID")))
    repeated = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id", F.lit("ID_REPEATS").alias("error"))
    return records.select("record_id", F.explode(checks).alias("error")).unionByName(repeated)


def block_errors(blocks: DataFrame, slack: float = 0.0) -> DataFrame:
    """document_id, block_id, error of canonical blocks: ids and orders that repeat, order, parents and caption targets that aren't there,
    row widths and boxes; blocks: document_id, position, block_id, block_type, reading_order, parent_block_id, target_block_id, columns, rows, box."""
    doc = Window.partitionBy("document_id").orderBy("position")
    count = lambda c: F.count(F.lit(1)).over(Window.partitionBy("document_id", c))
    box = lambda a, b, c: F.coalesce(F.col(f"box.{a}") + F.col(f"box.{b}") > F.col(f"box.{c}") + slack, F.lit(False))
    own = blocks.withColumns({"_ids": count("block_id"), "_orders": count("reading_order"), "_before": F.lag("reading_order").over(doc)})
    found = F.array_compact(F.array(F.when(F.col("_ids") > 1, "ID_REPEATS"), F.when(F.col("_orders") > 1, "ORDER_REPEATS"), F.when(F.col("reading_order") <= F.col("_before"), "ORDER_NOT_INCREASING"),
                                    F.when((F.col("block_type") == "TABLE") & F.exists("rows", lambda r: F.size(r) != F.size("columns")), "ROW_WIDTH"),
                                    F.when(box("x", "width", "page_width"), "BOX_TOO_WIDE"), F.when(box("y", "height", "page_height"), "BOX_TOO_HIGH"), F.when((F.col("block_type") == "CAPTION") & F.col("target_block_id").isNull(), "DANGLING_TARGET")))
    rows = own.select("document_id", "block_id", F.explode(found).alias("error"))
    for column, error in (("parent_block_id", "DANGLING_PARENT"), ("target_block_id", "DANGLING_TARGET")):
        known = blocks.select("document_id", F.col("block_id").alias(column)).distinct()
        some = blocks.where(F.col(column).isNotNull() & ((F.col("block_type") == "CAPTION") if column == "target_block_id" else F.lit(True)))
        rows = rows.unionByName(some.join(known, ["document_id", column], "left_anti").select("document_id", "block_id", F.lit(error).alias("error")))
    return rows.unionByName(parent_cycles(blocks).select("document_id", "block_id", F.lit("PARENT_CYCLE").alias("error")))


def parent_cycles(blocks: DataFrame) -> DataFrame:
    """document_id, block_id of blocks whose chain of parents doesn't end. Of blocks that share an id the last one's parent counts.

    The parents of one document, which bounds them, are walked together; each block is met once, so it takes linear time."""
    parents = blocks.groupBy("document_id", "block_id").agg(F.max_by("parent_block_id", "position").alias("to"))
    maps = parents.groupBy("document_id").agg(F.collect_list("block_id").alias("ids"), F.collect_list(F.coalesce("to", F.lit(""))).alias("to"))
    kind = blocks.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, ids, to in zip(batch.column("document_id"), batch.column("ids").to_pylist(), batch.column("to").to_pylist()):
                above, ends = dict(zip(ids, to)), {}
                for start in ids:
                    path, at = [], start
                    while at in above and at not in ends:
                        ends[at] = False  # until it is known, a chain that comes back here doesn't end
                        path.append(at)
                        at = above[at]
                    good = ends.get(at, True)
                    for x in path:
                        ends[x] = good
                bad = [x for x in ids if not ends[x]]
                yield pa.RecordBatch.from_arrays([pa.array([document.as_py()] * len(bad), batch.column("document_id").type), pa.array(bad, pa.string())], names=["document_id", "block_id"])

    return maps.mapInArrow(run, f"document_id {kind}, block_id string")
