"""Ingest operators: building, limiting and reshaping judging examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.functions.text import clean_text, label_name, sample_id, split_words, token_estimate
from jurybox.operators.joins import fits_broadcast, hot_keys, last_wins, lookup_join
from jurybox.operators.order import smallest
from jurybox.sources.parsers import DATASET

TEXT_BYTES = 4096  # about a document's text, which a join repeats for each of its qrels
NO_LINE = -(1 << 63)  # stands for a null line_no, which loses to any other

def build_samples(
    qrels: DataFrame, queries: DataFrame, documents: DataFrame, salted: bool | None = None, dataset: str = DATASET,
) -> DataFrame:
    """qrels joined to their query and document; duplicate qrels are kept.

    Queries and documents may hold several rows per key; the one with the
    highest line_no wins. For large documents this is settled on
    (docid, line_no) alone and the text is fetched by the winning line_no: it
    is shuffled once, and replaced or unreferenced texts find no partner.
    `salted=True` takes that form for documents of unique line numbers; by
    default the size decides, and the rows are those of `last_wins` in both.
    """
    greatest = None
    if salted is None:
        salted, greatest = not fits_broadcast(documents), "doc"
    texts = last_wins(queries, "query_id").select("query_id", "query_text")
    keyed = lookup_join(qrels, texts, "query_id", spread_by=["line_no"])
    if salted:
        if greatest:
            documents = documents.withColumn("line_no", F.coalesce("line_no", F.lit(NO_LINE)))
        winners = documents.groupBy("docid").agg(F.max("line_no").alias("_line"))
        by_line = documents.select("docid", F.col("line_no").alias("_line"), "doc")
        hot = hot_keys(qrels, ["docid"], row_bytes=TEXT_BYTES)
        keyed = lookup_join(keyed, winners, "docid", spread_by=["line_no"], salted=True, hot=hot)
        joined = lookup_join(keyed, by_line, ["docid", "_line"], spread_by=["line_no"], salted=True, hot=hot, hot_on=["docid"], greatest=greatest)
    else:
        joined = lookup_join(keyed, last_wins(documents, "docid").select("docid", "doc"), "docid", salted=False)
    return joined.select(
        "line_no",
        F.lit(dataset).alias("dataset"),
        "query_id",
        "query_text",
        "docid",
        "doc",
        F.col("relevance").alias("gold_relevance"),
    )


def missing_counts(
    qrels: DataFrame, queries: DataFrame, documents: DataFrame, salted: bool | None = None
) -> DataFrame:
    """Qrels without a query, and qrels with a query but without a document.

    qrels are counted per (query_id, docid) before any join, and per key where
    only the key matters.
    """
    known_q = queries.select("query_id").distinct().withColumn("_q", F.lit(True))
    known_d = documents.select("docid").distinct().withColumn("_d", F.lit(True))
    pairs = qrels.groupBy("query_id", "docid").agg(F.count(F.lit(1)).alias("n"))
    with_q = lookup_join(pairs, known_q, "query_id", "left", salted=salted)
    per_doc = with_q.groupBy("docid").agg(
        F.sum(F.when(F.col("_q").isNull(), F.col("n")).otherwise(0)).alias("no_query"),
        F.sum(F.when(F.col("_q").isNotNull(), F.col("n")).otherwise(0)).alias("has_query"),
    )
    both = per_doc.join(known_d, "docid", "left")
    return both.agg(
        F.coalesce(F.sum("no_query"), F.lit(0)).alias("missing_query"),
        F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("has_query"))), F.lit(0)).alias("missing_doc"),
    )


def skip_message(counts: DataFrame) -> DataFrame:
    """The skip summary as text; no row if nothing was skipped."""
    text = F.format_string(
        "Skipped %d qrels with missing query and %d with missing doc", "missing_query", "missing_doc"
    )
    return counts.where((F.col("missing_query") > 0) | (F.col("missing_doc") > 0)).select(text.alias("message"))


def ingest_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("sample_count"))


def limit_samples(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples in qrel order; a limit below one still gives one."""
    return smallest(samples, "line_no", max(n, 1))


def limit_examples(samples: DataFrame, n: int) -> DataFrame:
    """Like a slice `[:n]`: zero gives none, a negative n drops the last |n|."""
    return smallest(samples, "line_no", n)


def to_canonical_sample(samples: DataFrame) -> DataFrame:
    return samples.select(
        sample_id(F.col("query_id"), F.col("docid")).alias("sample_id"),
        F.col("query_text").alias("query"),
        F.col("doc").alias("candidate"),
        F.lit(None).cast("array<string>").alias("references"),
        label_name(F.col("gold_relevance")).alias("gold_label"),
        F.struct(
            F.col("dataset").alias("domain"), F.length("doc").cast("bigint").alias("length")
        ).alias("metadata"),
    )


def clean_samples(samples: DataFrame) -> DataFrame:
    """Optional text cleanup of query and document; ingest leaves it off."""
    return samples.withColumns({c: clean_text(F.col(c)) for c in ("query_text", "doc")})


def token_budget(samples: DataFrame, models: DataFrame, text: str = "doc") -> DataFrame:
    """Token estimate per (sample, model) of fanned-out samples and its fit."""
    limits = models.select(
        "model_id",
        "context_window",
        F.coalesce(F.element_at("default_params", "max_tokens").try_cast("int"), F.lit(256)).alias("max_tokens"),
    )
    estimated = samples.withColumn("n_tokens_est", token_estimate(F.col(text)))
    out = lookup_join(estimated, limits, "model_id")
    return out.withColumn(
        "over_budget", F.col("n_tokens_est") + F.col("max_tokens") > F.col("context_window")
    )


def chunk_documents(docs: DataFrame, words: int, overlap: int = 0) -> DataFrame:
    """(docid, chunk_no, chunk): at most `words` words, `overlap` shared with the next.

    Chunks start every words - overlap words until one reaches the end of the text.
    """
    if not 0 <= overlap < words:
        raise ValueError("overlap must be at least 0 and smaller than words")
    step = words - overlap
    split = docs.select("docid", split_words(F.col("doc")).alias("_w"))
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - words) / step)).cast("int")

    def chunk(i: Column) -> Column:
        return F.array_join(F.slice("_w", i * step + 1, F.lit(words)), " ")

    # Chunks are cut before the rows multiply, so no row carries all the words.
    chunks = F.when(F.size("_w") > 0, F.transform(F.sequence(F.lit(0), last), chunk))
    return split.select("docid", F.posexplode(chunks).alias("chunk_no", "chunk"))
