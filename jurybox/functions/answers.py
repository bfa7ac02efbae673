"""Parsers from a model's raw answer to a label, as Column expressions.

A parser maps the raw text to struct<label int, score double, confidence double,
rationale string, warnings array<string>>. `register_parser` adds one by name; a
user parser may wrap a `pandas_udf`, the ones here never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jurybox.functions.text import label_id, once, score_from_label

# The answer pattern and the warnings of the graded-score parser.
SCORE_OBJECT = r'\{[^}]*"O"\s*:\s*\d+[^}]*\}'
NO_OBJECT = "No JSON object with 'O' field found in response"
BAD_JSON = "Failed to parse JSON: "
NO_FIELD = "Missing 'O' field in parsed JSON"

# Same for the label/confidence/rationale answer form.
LABEL_OBJECT = r'\{[^}]*"label"\s*:[^}]*\}'
NO_LABEL_OBJECT = "No JSON object with 'label' field found in response"
NO_LABEL = "Missing 'label' field in parsed JSON"

_STRICT = {"allowSingleQuotes": "false"}


def _first_match(raw: Column, pattern: str) -> Column:
    # (?U): \d and \s cover the Unicode classes.
    return F.regexp_substr(raw, F.lit("(?U)" + pattern))


def _with_bad(js: Column, fields: str) -> Column:
    options = {**_STRICT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return F.from_json(js, fields + ", _bad string", options)


def _warn(*cases: tuple[Column, Column]) -> Column:
    """Array holding the message of the first case that applies, else empty."""
    out = None
    for condition, message in cases:
        out = F.when(condition, message) if out is None else out.when(condition, message)
    return F.array_compact(F.array(out))


def parse_label(raw: Column) -> Column:
    """Graded score `O` in {0, 1, 2} from the first matching JSON object.

    The text value of O comes from one parse, its integer value from a second
    one, which is null for 2.0, 1e0 or "2".
    """

    def parsed(js: Column) -> Column:
        loose, strict = _with_bad(js, "O string"), _with_bad(js, "O bigint")
        return F.struct(
            js.alias("js"), loose["_bad"].isNotNull().alias("bad"), loose["O"].alias("value"),
            # A repeated key leaves its earlier value behind when the last one is bad.
            F.when(strict["_bad"].isNull(), strict["O"]).alias("number"),
        )

    def judged(a: Column) -> Column:
        label = F.when(~a["bad"] & a["number"].isin(0, 1, 2), a["number"].cast("int"))
        invalid = F.concat(F.lit("Invalid O score: "), a["value"], F.lit(" (expected 0, 1, or 2)"))
        warnings = _warn(
            (a["js"].isNull(), F.lit(NO_OBJECT)),
            (a["bad"], F.concat(F.lit(BAD_JSON), a["js"])),
            (a["value"].isNull(), F.lit(NO_FIELD)),
            (label.isNull(), invalid),
        )
        return _answer(label, warnings)

    return once(once(_first_match(raw, SCORE_OBJECT), parsed), judged)


def _answer(label: Column, warnings: Column, confidence: Column | None = None, rationale: Column | None = None) -> Column:
    """The struct every parser gives."""
    return F.struct(
        label.alias("label"),
        score_from_label(label).alias("score"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
        (F.lit(None) if rationale is None else rationale).cast("string").alias("rationale"),
        warnings.alias("warnings"),
    )


def parse_aspects(raw: Column) -> Column:
    """The aspect scores M, T and O of the same object, null where not integers."""

    def fields(js: Column) -> Column:
        # Parsed one by one: a value of the wrong type voids only itself.
        return F.struct(
            *[
                F.when(obj["_bad"].isNull(), obj[k].try_cast("int")).alias(k.lower())
                for k in ("M", "T", "O") for obj in [_with_bad(js, f"{k} bigint")]
            ]
        )

    return once(_first_match(raw, SCORE_OBJECT), fields)


def parse_relevance_v1(raw: Column) -> Column:
    """Label name, confidence and rationale from the first object with a label."""

    def parsed(js: Column) -> Column:
        obj = _with_bad(js, "label string, rationale string, confidence string")
        return F.struct(
            js.alias("js"), obj["_bad"].isNotNull().alias("bad"), obj["label"].alias("name"),
            obj["rationale"].alias("rationale"), obj["confidence"].alias("said"),
            # Apart, so that a confidence of the wrong type does not void the label.
            F.from_json(js, "confidence double", _STRICT)["confidence"].alias("confidence"),
        )

    def judged(a: Column) -> Column:
        label = F.when(~a["bad"], label_id(a["name"]))
        in_range = F.coalesce(a["confidence"].between(0.0, 1.0), F.lit(False))
        of_label = _warn(
            (a["js"].isNull(), F.lit(NO_LABEL_OBJECT)),
            (a["bad"], F.concat(F.lit(BAD_JSON), a["js"])),
            (a["name"].isNull(), F.lit(NO_LABEL)),
            (label.isNull(), F.concat(F.lit("Invalid label: "), a["name"])),
        )
        of_confidence = _warn(
            (~a["bad"] & a["said"].isNotNull() & ~in_range, F.concat(F.lit("Invalid confidence: "), a["said"]))
        )
        return _answer(
            label, F.concat(of_label, of_confidence), F.when(~a["bad"] & in_range, a["confidence"]),
            F.when(~a["bad"], a["rationale"]),
        )

    return once(once(_first_match(raw, LABEL_OBJECT), parsed), judged)


Parser = Callable[[Column], Column]

# `parse_thomas_response` is the name prompt configurations use for `parse_label`.
PARSERS: dict[str, Parser] = {
    "parse_thomas_response": parse_label,
    "parse_label": parse_label,
    "parse_relevance_v1": parse_relevance_v1,
}


def register_parser(name: str, parser: Parser) -> None:
    PARSERS[name] = parser


def parser(name: str) -> Parser:
    if name not in PARSERS:
        raise KeyError(f"Unknown response parser: {name}. Known: {', '.join(sorted(PARSERS))}")
    return PARSERS[name]

