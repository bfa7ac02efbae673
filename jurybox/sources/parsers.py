"""Line parsers of the ingest stage.

`mark_*` takes numbered lines (line_no, value) and gives one row per line that
is not blank: its fields, or the reason why it is rejected and the raw text.
`parse_*` is the same split in two: (good, rejects). A job over large files
writes the marked table once and splits what it wrote; see the ingest stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jurybox.functions.text import blank, split_words, strip, to_bigint
from jurybox.sources.lines import read_lines

# File names of the dataset and the name every sample carries.
DATASET = "llm-judge-2024"
DATASET_NAMES = ("llm-judge", "llm-judge-2024")
QUERY_FILE = "llm4eval_query_2024.txt"
DOCUMENT_FILE = "llm4eval_document_2024.jsonl"
QREL_FILE = "llm4eval_test_qrel_2024.txt"

Parsed = tuple[DataFrame, DataFrame]


def parsed_lines(lines: DataFrame, keep: Column, **parts: Column) -> DataFrame:
    """Lines with `keep`, and the columns `parts` evaluated once per line.

    The parts come out of a generator, because a filter on a computed column
    would be pushed below the projection and compute it again.
    """
    row = F.struct(*[c.alias(name) for name, c in parts.items()])
    return lines.select("line_no", "value", F.inline(F.when(keep, F.array(row))))


def mark(parsed: DataFrame, reason: Column, good: Sequence[Column]) -> DataFrame:
    """(line_no, reason, raw, fields...): `reason` is null for a good row, `raw` else."""
    return parsed.select(
        "line_no",
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.col("value")).alias("raw"),
        *good,
    )


def split_marked(marked: DataFrame, source: str) -> Parsed:
    """(good, rejects) of a marked table."""
    good = marked.where(F.col("reason").isNull()).drop("reason", "raw")
    rejects = marked.where(F.col("reason").isNotNull())
    return good, rejects.select(F.lit(source).alias("source"), "line_no", "reason", "raw")


def mark_queries(lines: DataFrame) -> DataFrame:
    """Tab-separated query_id and text, split at the first tab, both stripped."""
    parts = parsed_lines(lines, F.col("value") != "", _p=F.split("value", "\t", 2))
    reason = F.when(F.size("_p") != 2, F.lit("Invalid query line"))
    good = [strip(F.col("_p")[0]).alias("query_id"), strip(F.try_element_at("_p", F.lit(2))).alias("query_text")]
    return mark(parts, reason, good)


def json_object(value: Column, fields: Sequence[str]) -> Column:
    """The line's JSON object with its fields as VARIANT; null if it is not one.

    The line is parsed as the first of two array elements, so that text after
    the object is an error; VARIANT fields keep a number from passing as a
    string. JSON itself allows the usual spaces around; others are stripped only
    where the first parse fails.
    """
    schema = "array<struct<" + ",".join(f"{f}:variant" for f in fields) + ">>"

    def parse(text: Column) -> Column:
        wrapped = F.concat(F.lit("["), text, F.lit(',{"' + fields[0] + '":""}]'))
        return F.from_json(wrapped, schema, {"allowSingleQuotes": "false"})

    both = F.coalesce(parse(value), parse(strip(value)))
    return F.transform(F.filter(F.array(both), lambda o: F.size(o) == 2), lambda o: o[0])


def variant_text(v: Column | str) -> Column:
    return F.try_variant_get(v, "$", "string")


def is_text(*variants: Column | str) -> Column:
    """Whether every VARIANT is a JSON string."""
    return reduce(Column.__and__, [F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)) for v in variants])


def mark_documents(lines: DataFrame) -> DataFrame:
    """One JSON object per line with string fields docid and doc.

    The fields leave the generator as strings. Spark's size estimate takes a VARIANT for 2 kB and what is
    read out of it for 20 bytes: large tables of documents would pass for small ones and be broadcast.
    """
    value = F.col("value")

    def fields(o: Column) -> Column:
        reason = F.when(o.isNull(), F.lit("Invalid JSONL")).when(~is_text(o["docid"], o["doc"]), F.lit("Missing docid/doc"))
        return F.struct(reason.alias("reason"), variant_text(o["docid"]).alias("docid"), variant_text(o["doc"]).alias("doc"))

    # A lambda's argument is evaluated once per line, a shared expression of the struct's fields is not.
    parsed = F.transform(F.array(F.get(json_object(value, ["docid", "doc"]), F.lit(0))), fields)
    parts = parsed_lines(lines, ~blank(value), _d=F.get(parsed, F.lit(0)))
    return mark(parts, F.col("_d.reason"), [F.col("_d.docid").alias("docid"), F.col("_d.doc").alias("doc")])


def mark_qrels(lines: DataFrame) -> DataFrame:
    """query_id, relevance, docid, separated by whitespace; any integer relevance."""
    value = F.col("value")
    parts = parsed_lines(lines, ~blank(value), _p=split_words(value))
    number = to_bigint(F.try_element_at("_p", F.lit(2)))
    reason = F.when(F.size("_p") != 3, F.lit("Invalid qrel line")).when(number.isNull(), F.lit("Invalid relevance"))
    good = [
        F.col("_p")[0].alias("query_id"),
        F.try_element_at("_p", F.lit(3)).alias("docid"),
        number.alias("relevance"),
    ]
    return mark(parts, reason, good)


def parse_queries(lines: DataFrame) -> Parsed:
    return split_marked(mark_queries(lines), "queries")


def parse_documents(lines: DataFrame) -> Parsed:
    return split_marked(mark_documents(lines), "documents")


def parse_qrels(lines: DataFrame) -> Parsed:
    return split_marked(mark_qrels(lines), "qrels")


def check(rejects: DataFrame, strict: bool = True) -> DataFrame:
    """Raise on the first rejected line, by number, if `strict`; else pass on."""
    if strict:
        first = rejects.agg(F.min_by(F.struct("reason", "line_no", "raw"), "line_no").alias("r")).first()["r"]
        if first is not None:
            raise ValueError(f"{first['reason']} at line {first['line_no']}: {first['raw']!r}")
    return rejects


@dataclass(frozen=True)
class Rejects:
    """Counts the rejects of a marked table while it is written, without reading it again."""

    seen: Observation

    @classmethod
    def of(cls, marked: DataFrame) -> tuple[Rejects, DataFrame]:
        """The counter and the table to write; the counts are there once that is done."""
        seen = Observation()
        bad = F.col("reason").isNotNull()
        first = F.min_by(F.when(bad, F.struct("reason", "line_no", "raw")), F.when(bad, F.col("line_no")))
        return cls(seen), marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejects"), first.alias("first"))

    @property
    def count(self) -> int:
        return self.seen.get["rejects"]

    def check(self, strict: bool = True) -> int:
        """Raise on the first rejected line, by number, if `strict`; else give the number of rejects."""
        first = self.seen.get["first"]
        if strict and first is not None:
            raise ValueError(f"{first['reason']} at line {first['line_no']}: {first['raw']!r}")
        return self.count


def resolve_dataset(name: str) -> str:
    """Accepted spellings of the dataset name to the one the samples carry."""
    if name.lower().strip() not in DATASET_NAMES:
        raise ValueError("Unsupported dataset. Try: llm-judge")
    return DATASET


def read_judge_dataset(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The three files of the dataset directory as marked tables."""
    root = base.rstrip("/")
    return {
        "queries": mark_queries(read_lines(spark, f"{root}/{QUERY_FILE}")),
        "documents": mark_documents(read_lines(spark, f"{root}/{DOCUMENT_FILE}")),
        "qrels": mark_qrels(read_lines(spark, f"{root}/{QREL_FILE}")),
    }


# Dataset adapters by name: function (spark, directory) -> {table: marked table}, and the dataset its samples carry.
Adapter = Callable[[SparkSession, str], dict[str, DataFrame]]
ADAPTERS: dict[str, Adapter] = {name: read_judge_dataset for name in DATASET_NAMES}
DATASETS: dict[str, str] = {name: DATASET for name in DATASET_NAMES}


def register_adapter(name: str, reader: Adapter, dataset: str | None = None) -> None:
    """Add a dataset by name; its samples carry `dataset`, or the name itself."""
    ADAPTERS[name] = reader
    DATASETS[name] = dataset or name
