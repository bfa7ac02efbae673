"""Exact prompt texts and the prompt registry."""

import pytest

from jurybox.functions import prompts

SCALE = """
Given a query and a web page, you must
provide a score on an integer scale of 0 to 2 with the
following meanings:
2 = highly relevant, very helpful for this query
1 = relevant, may be partly helpful but might contain
other irrelevant content
0 = not relevant, should never be shown for this query
Assume that you are writing a report on the subject of the
topic. If you would use any of the information contained
in the web page in such a report, mark it 1. If the web page
is primarily about the topic, or contains vital information
about the topic, mark it 2. Otherwise, mark it 0.

Query
A person has typed [test] into a search engine.
"""
ROLE = "\nYou are a search quality rater evaluating the relevance\nof web pages.\n"
PAGE = """

Result
Consider the following web page.
—BEGIN WEB PAGE CONTENT—
content
—END WEB PAGE CONTENT—

Instructions
Split this problem into steps:
Consider the underlying intent of the search.
"""
OVERALL = """
Decide on a final relevance score for the page (O) without providing
any reasoning. Example: {"O": 2}
"""


@pytest.fixture
def render(spark):
    pair = spark.createDataFrame([("test", "content")], "query_text string, doc string")

    def run(name="thomas-et-al-prompt", **variables):
        return prompts.render_prompt(pair, name, **variables).first()["prompt"]

    return run


def test_default_text(render):
    assert render() == "\n\n" + ROLE + SCALE + PAGE + OVERALL


def test_without_role(render):
    assert render(role=False) == "\n\n" + SCALE + PAGE + OVERALL


@pytest.mark.parametrize(
    "description, narrative, wanted",
    [("a", "b", " a b"), ("a", None, " a"), (None, "b", " b"), ("a", "", " a")],
)
def test_description_and_narrative(render, description, narrative, wanted):
    text = render(description=description, narrative=narrative)
    assert text == "\n\n" + ROLE + SCALE + "\nThey were looking for:" + wanted + "\n" + PAGE + OVERALL


def test_empty_strings_are_absent(render):
    assert render(description="", narrative="") == render()


def test_aspects(render):
    text = render(aspects=True)
    assert text.startswith("\n\n" + ROLE + SCALE + PAGE + "\nMeasure how well the content matches a likely intent of\nthe query (M).\n")
    assert text.endswith('\nProduce a JSON array of scores without providing any\nreasoning. Example: {"M": 2, "T": 1, "O": 1}\n')


def test_relevance_v1(render):
    assert render("relevance_v1") == (
        "You are a judge assessing relevance.\nGiven a query and a candidate answer, return JSON with keys:\n"
        '{ "label": "relevant|partially|irrelevant", "confidence": 0-1, "rationale": "short reason" }.\n\n'
        "Query: test\nCandidate: content"
    )


def test_registry(render):
    spec = prompts.prompt("thomas-et-al-prompt")
    assert spec.variables["role"] is True and spec.variables["aspects"] is False
    assert spec.expected_output_format == "json" and spec.response_parser == "parse_thomas_response"
    with pytest.raises(KeyError, match="Prompt config not found"):
        prompts.prompt("nonexistent-prompt")
    own = prompts.PromptSpec("own", lambda q, d, foo: prompts.F.concat_ws("|", q, d, prompts.F.lit(foo)), {"foo": "bar"})
    prompts.register_prompt(own)
    assert render("own") == "test|content|bar"
    del prompts.PROMPTS["own"]
