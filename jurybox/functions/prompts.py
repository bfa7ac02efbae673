"""Prompt specifications and their rendering as one `concat` Column.

A prompt is constant per run, so the optional parts are chosen while the plan is
built; per row only the query and the document text are inserted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: prompt texts, verbatim -----------------------------------
RATER_ROLE = """
You are a search quality rater evaluating the relevance
of web pages.
"""
RATER_SCALE = """
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
A person has typed ["""
RATER_QUERY_END = """] into a search engine.
"""
RATER_LOOKING_FOR = """
They were looking for:"""
RATER_PAGE = """

Result
Consider the following web page.
—BEGIN WEB PAGE CONTENT—
"""
RATER_PAGE_END = """
—END WEB PAGE CONTENT—

Instructions
Split this problem into steps:
Consider the underlying intent of the search.
"""
RATER_ASPECTS = """
Measure how well the content matches a likely intent of
the query (M).
Measure how trustworthy the web page is (T).
Consider the aspects above and the relative importance
of each, and decide on a final score (O).

Produce a JSON array of scores without providing any
reasoning. Example: {"M": 2, "T": 1, "O": 1}
"""
RATER_OVERALL = """
Decide on a final relevance score for the page (O) without providing
any reasoning. Example: {"O": 2}
"""
JUDGE_INTRO = """You are a judge assessing relevance.
Given a query and a candidate answer, return JSON with keys:
{ "label": "relevant|partially|irrelevant", "confidence": 0-1, "rationale": "short reason" }.

Query: """
JUDGE_CANDIDATE = """
Candidate: """
# ---- End of fixed values ----------------------------------------------------

Renderer = Callable[..., Column]


def render_rater(
    query: Column,
    page_text: Column,
    role: bool = True,
    description: str | None = None,
    narrative: str | None = None,
    aspects: bool = False,
) -> Column:
    """Search-quality-rater prompt; empty description or narrative counts as absent."""
    head = "\n\n" + (RATER_ROLE if role else "") + RATER_SCALE
    wanted = [text for text in (description, narrative) if text]
    middle = RATER_QUERY_END
    if wanted:
        middle += RATER_LOOKING_FOR + "".join(" " + text for text in wanted) + "\n"
    tail = RATER_PAGE_END + (RATER_ASPECTS if aspects else RATER_OVERALL)
    return F.concat(F.lit(head), query, F.lit(middle + RATER_PAGE), page_text, F.lit(tail))


def render_judge(query: Column, candidate: Column) -> Column:
    """Label, confidence and rationale prompt."""
    return F.concat(F.lit(JUDGE_INTRO), query, F.lit(JUDGE_CANDIDATE), candidate)


@dataclass(frozen=True)
class PromptSpec:
    name: str
    renderer: Renderer
    variables: dict[str, Any] = field(default_factory=dict)
    description: str | None = None
    expected_output_format: str | None = None
    response_parser: str | None = None


# Names and variables are fixed values of the prompt registry.
PROMPTS: dict[str, PromptSpec] = {}


def register_prompt(spec: PromptSpec) -> None:
    PROMPTS[spec.name] = spec


register_prompt(
    PromptSpec(
        name="thomas-et-al-prompt",
        renderer=render_rater,
        variables={"role": True, "aspects": False, "description": None, "narrative": None},
        description="Search quality rater prompt with JSON output, optionally by aspects.",
        expected_output_format="json",
        response_parser="parse_thomas_response",
    )
)
register_prompt(
    PromptSpec(
        name="relevance_v1",
        renderer=render_judge,
        description="Relevance prompt asking for label, confidence and rationale.",
        expected_output_format="json",
        response_parser="parse_relevance_v1",
    )
)


def prompt(name: str) -> PromptSpec:
    if name not in PROMPTS:
        known = "\n".join(f"  - {n}" for n in sorted(PROMPTS))
        raise KeyError(f"Prompt config not found: {name}\nAvailable prompts:\n{known}")
    return PROMPTS[name]


def render_prompt(samples: DataFrame, name: str = "thomas-et-al-prompt", **variables: Any) -> DataFrame:
    """Add the column `prompt`; `variables` override those of the specification."""
    spec = prompt(name)
    text = spec.renderer(F.col("query_text"), F.col("doc"), **{**spec.variables, **variables})
    return samples.withColumn("prompt", text)
