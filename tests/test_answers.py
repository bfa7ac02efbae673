"""Answer parsers, branch by branch and against plain Python."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jurybox.functions import answers, text

NONE, BAD, FIELD, SCORE = answers.NO_OBJECT, answers.BAD_JSON, answers.NO_FIELD, "Invalid O score: "

CASES = [
    ('{"O": 2}', 2, None),
    ('The answer is {"O": 1} based on...', 1, None),
    ('{"M": 2, "T": 1, "O": 0}', 0, None),
    ('{"O": 1} and {"O": 2}', 1, None),
    ('{"O": 1, "O": 2}', 2, None),
    ('{"O" : 1 ,\n "x": "y"}', 1, None),
    ("invalid", None, NONE),
    ("", None, NONE),
    (None, None, NONE),
    ('{"O": -1}', None, NONE),
    ('{"O": "2"}', None, NONE),
    ('{"M": {"x": 1}, "O": 2}', None, NONE),
    ('{"O": 01}', None, BAD),
    ('{"O": 2,}', None, BAD),
    ('{ x {"O": 2}', None, BAD),
    ("{'M': 1, \"O\": 2}", None, BAD),
    ('{"x": "a\nb", "O": 2}', None, BAD),
    ('{"O": 1, "O": null}', None, FIELD),
    ('{"O": 12}', None, SCORE + "12"),
    ('{"O": 7}', None, SCORE + "7 (expected 0, 1, or 2)"),
    ('{"O": 1.5}', None, SCORE + "1.5"),
    ('{"O": 2.0}', None, SCORE + "2.0"),
    ('{"O": 1e0}', None, SCORE),
    ('{"O": 1, "O": "2"}', None, SCORE + "2"),
]


def test_parse_label_case_by_case(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    got = {r["i"]: r["p"] for r in df.select("i", answers.parse_label(F.col("raw")).alias("p")).collect()}
    for i, (raw, label, warning) in enumerate(CASES):
        assert got[i]["label"] == label, raw
        assert got[i]["score"] == (None if label is None else float(label))
        if warning is None:
            assert got[i]["warnings"] == [], raw
        else:
            assert len(got[i]["warnings"]) == 1 and got[i]["warnings"][0].startswith(warning), (raw, got[i])


def plain_label(raw):
    """The rule in plain Python: label, and the warning's kind."""
    match = re.search(answers.SCORE_OBJECT, raw)
    if match is None:
        return None, NONE
    try:
        value = json.loads(match.group(0)).get("O")
    except json.JSONDecodeError:
        return None, BAD
    if value is None:
        return None, FIELD
    if type(value) is int and value in (0, 1, 2):
        return value, None
    return None, SCORE


pieces = st.lists(
    st.sampled_from(['{"O": 1}', '{"O": 2}', '{"O": 3}', '{"M": 1, ', '"O": 0}', '"O":', "{", "}", " ", "1", "2.0", "\n", "x", '"', ",", '{"O": 1, "O": ', "null}"]),
    max_size=6,
).map("".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(pieces, min_size=200, max_size=300))
def test_parse_label_against_plain_python(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    for r in df.select("raw", answers.parse_label(F.col("raw")).alias("p")).collect():
        label, warning = plain_label(r["raw"])
        assert r["p"]["label"] == label, r["raw"]
        assert [w[: len(warning or "")] for w in r["p"]["warnings"]] == ([] if warning is None else [warning]), r["raw"]


def test_parse_aspects(spark):
    df = spark.createDataFrame([('x {"M": 2, "T": 1, "O": 1} y',), ('{"M": "a", "O": 2}',), ("none",)], "raw string")
    got = [tuple(r["p"]) for r in df.select(answers.parse_aspects(F.col("raw")).alias("p")).collect()]
    assert got == [(2, 1, 1), (None, None, 2), (None, None, None)]


RELEVANCE = [
    ('{"label": "relevant", "confidence": 0.9, "rationale": "on topic"}', 2, 0.9, "on topic", []),
    ('ok {"label": "Partially", "confidence": 1} done', 1, 1.0, None, []),
    ('{"label": "irrelevant"}', 0, None, None, []),
    ('{"label": "relevant", "confidence": 1.5}', 2, None, None, ["Invalid confidence: 1.5"]),
    ('{"label": "relevant", "confidence": "high"}', 2, None, None, ["Invalid confidence: high"]),
    ('{"label": "maybe", "confidence": 0.5}', None, 0.5, None, ["Invalid label: maybe"]),
    ('{"label": null}', None, None, None, [answers.NO_LABEL]),
    ("nothing", None, None, None, [answers.NO_LABEL_OBJECT]),
    (None, None, None, None, [answers.NO_LABEL_OBJECT]),
]


def test_parse_relevance_v1(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(RELEVANCE)], "i int, raw string")
    got = {r["i"]: r["p"] for r in df.select("i", answers.parse_relevance_v1(F.col("raw")).alias("p")).collect()}
    for i, (raw, label, confidence, rationale, warnings) in enumerate(RELEVANCE):
        p = got[i]
        assert (p["label"], p["confidence"], p["rationale"], p["warnings"]) == (label, confidence, rationale, warnings), raw


def test_parser_registry():
    assert answers.parser("parse_thomas_response") is answers.parse_label
    with pytest.raises(KeyError, match="Unknown response parser"):
        answers.parser("nope")


def test_text_helpers(spark):
    row = spark.createDataFrame([("　\x1c a b \x85", " a\x00b \n\n c　", "qwen-0.5b é/" + "x" * 40)], "s string, t string, h string").select(
        text.strip(F.col("s")).alias("s"), text.clean_text(F.col("t")).alias("t"),
        text.run_id(F.lit("2025-01-15 14:30:22").cast("timestamp"), F.col("h")).alias("r"),
        text.label_name(F.lit(1)).alias("n"), text.label_name(F.lit(5)).alias("m"), text.label_id(F.lit(" Relevant ")).alias("i"),
        text.token_estimate(F.lit("abcde")).alias("k"),
    ).first()
    assert row["s"] == "　\x1c a b \x85".strip() and row["t"] == "a b c"
    assert row["r"] == "20250115_143022_" + ("qwen-05bé" + "x" * 40)[:30]
    assert (row["n"], row["m"], row["i"], row["k"]) == ("partially", None, 2, 2)
