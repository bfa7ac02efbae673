"""Driver queries of the operators, `opN_<name>`, and the SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurybox.llm import (
    conversation_repair, decontaminate, html_text, jaccard_join, licenses, lm_score, packing, pii, prefix_trie, quality_rules, repeats,
    token_files, warc_fixity,
)
from jurybox.llm.common import scratch, settle

END_OF_TOKENS = 1
END_OF_PACKED = 0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """The tokenizer file of the contract; it is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select(
        "row.doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept",
    )


@query
def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "row.doc_id", *[pii.of_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listing(base).cast("binary"), 256).alias("base_sha256"), pii.listing(F.col("spans")).alias("spans"),
    )


@query
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contaminated(docs, table(spark, sf, "benchmark"))
    return marked.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query
def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    packed = packing.pack(docs, vocabulary(), END_OF_PACKED)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents").select("doc_id", "text"), path, vocabulary(), END_OF_TOKENS)
    return token_files.checksums(token_files.read_tokens(spark, path))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), n=3, threshold=90)


@query
def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf, "pages"))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


FLIPS, LOSSES = 97, 211


@query
def op4_warc_fixity(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the archive of all pages that its decayed replica has lost or changed."""
    files = warc_fixity.archive(table(spark, sf, "pages").select("page_id", "url", "html"))
    found = warc_fixity.audit(warc_fixity.build_tree(files), warc_fixity.build_tree(warc_fixity.decay(files, FLIPS, LOSSES)))
    return found.select(F.col("record_id").alias("page_id"), "status")


@query
def op7_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.fit_and_score(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every original conversation; one that lost all its rows has no fault and nothing to repair."""
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversation_repair.damage(talks)
    found = settle(conversation_repair.diagnose(rows), "audits")
    hashes = conversation_repair.repaired_digests(rows, found)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = talks.select("conv_id").unionByName(found, True).unionByName(hashes, True).groupBy("conv_id")
    return every.agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def op13_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Score: that of the surest place, 0 without one."""
    found = licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])

    def listed(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    def start_of(pick: Callable[[Column], Column]) -> Column:
        return pick(F.transform(base, lambda p: p["start"]))

    return found.select(
        "row.doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), start_of(F.array_min).alias("first_word"),
        start_of(F.array_max).alias("last_word"), listed(base).alias("base_labels"), listed(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


@query
def op11_conversation_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
