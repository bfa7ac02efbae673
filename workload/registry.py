"""One query per operator over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurybox.functions import answers, prompts, text
from jurybox.operators import joins, requests, samples, scores, telemetry, votes
from jurybox.sources import parsers, readers, registry, sinks
from jurybox.sources.lines import read_lines
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: str) -> Column:
    return F.concat_ws(",", c)


# ---- ingest -------------------------------------------------------------------


@query
def parse_queries(spark, sf):
    return t.queries(spark, sf)


@query
def parse_documents(spark, sf):
    return t.documents(spark, sf)


@query
def parse_qrels(spark, sf):
    return t.qrels(spark, sf)


@query
def reject_rows(spark, sf):
    """Lines broken on purpose by their number; every table, every reason."""
    n = F.col("line_no")
    value = F.col("value")
    q = t.query_lines(spark, sf).withColumn("value", F.when(n % 7 == 3, F.replace(value, F.lit("\t"), F.lit(" "))).when(n % 7 == 5, F.lit("")).otherwise(value))
    d = t.document_lines(spark, sf).withColumn(
        "value",
        F.when(n % 9 == 1, F.concat(value, F.lit(" tail")))
        .when(n % 9 == 2, F.replace(value, F.lit('{"docid":'), F.lit('{"id":')))
        .when(n % 9 == 3, F.concat(F.lit('{"docid":5,"doc":"x"}')))
        .when(n % 9 == 4, F.lit("  "))
        .otherwise(value),
    )
    r = t.qrel_lines(spark, sf).withColumn(
        "value",
        F.when(n % 5 == 1, F.concat(value, F.lit(" more")))
        .when(n % 5 == 2, F.regexp_replace(value, " [0-9]+ ", " high "))
        .otherwise(value),
    )
    rejects = (
        parsers.parse_queries(q)[1]
        .unionByName(parsers.parse_documents(d)[1])
        .unionByName(parsers.parse_qrels(r)[1])
    )
    return rejects.groupBy("source", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")
    )


def _samples(spark, sf):
    return samples.build_samples(t.qrels(spark, sf), t.queries(spark, sf), t.documents(spark, sf))


@query
def build_samples(spark, sf):
    return _samples(spark, sf)


@query
def parse_samples(spark, sf):
    """The samples written as NDJSON lines and read back."""
    s = _samples(spark, sf)
    body = F.to_json(F.struct(*[c for c in s.columns if c != "line_no"]))
    return readers.parse_samples(s.select("line_no", body.alias("value")))[0]


@query
def build_samples_spread(spark, sf):
    """The same through the form for large tables: hot keys spread, text fetched by line."""
    return samples.build_samples(t.qrels(spark, sf), t.queries(spark, sf), t.documents(spark, sf), salted=True)


@query
def limit_samples(spark, sf):
    return samples.limit_samples(_samples(spark, sf), 25)


@query
def limit_examples(spark, sf):
    return samples.limit_examples(_samples(spark, sf), -10).select("line_no", "query_id", "docid")


@query
def missing_counts(spark, sf):
    return samples.missing_counts(t.qrels(spark, sf), t.queries(spark, sf), t.documents(spark, sf))


@query
def skip_message(spark, sf):
    return samples.skip_message(missing_counts(spark, sf))


@query
def ingest_summary(spark, sf):
    return samples.ingest_summary(_samples(spark, sf))


@query
def last_wins(spark, sf):
    """Documents three to a key: the last of each three stays."""
    docs = t.table(spark, sf, "documents").select(
        F.expr("doc_id div 3").cast("string").alias("docid"), F.col("text").alias("doc"), F.col("doc_id").alias("line_no")
    )
    return joins.last_wins(docs, "docid")


@query
def last_wins_ties(spark, sf):
    """Orders that repeat and are null: the greatest row of a key by (order, columns) stays."""
    d = F.col("doc_id")
    docs = t.table(spark, sf, "documents").select(
        F.expr("nullif(doc_id div 7, 3)").alias("docid"), F.col("text").alias("doc"), "lang", F.when(d % 4 > 0, d % 3).alias("line_no")
    )
    return joins.last_wins(docs.unionByName(docs.where(d % 5 == 0)), "docid")


@query
def to_canonical_sample(spark, sf):
    c = samples.to_canonical_sample(_samples(spark, sf))
    return c.select("sample_id", "query", "candidate", "gold_label", "metadata.domain", "metadata.length")


@query
def map_label_space(spark, sf):
    rel = t.qrels(spark, sf).select("line_no", "relevance", text.label_name(F.col("relevance")).alias("name"))
    return rel.withColumn("back", text.label_id(F.upper("name")))


@query
def clean_text(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query
def token_budget(spark, sf):
    fanned = requests.fan_out(_samples(spark, sf), t.PANEL_MODELS)
    return samples.token_budget(fanned, registry.models_df(spark, t.PANEL_MODELS)).select(
        "query_id", "docid", "model_id", "n_tokens_est", "max_tokens", "over_budget"
    )


@query
def chunk_documents(spark, sf):
    return samples.chunk_documents(t.documents(spark, sf), 200, 20)


# ---- infer --------------------------------------------------------------------


def _prompt(name, spark, sf, **variables):
    out = prompts.render_prompt(_samples(spark, sf), name, **variables)
    return out.select("query_id", "docid", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


QUERIES["render_prompt"] = partial(_prompt, "thomas-et-al-prompt")
QUERIES["render_prompt_aspects"] = partial(
    _prompt, "thomas-et-al-prompt", role=False, description="a page for raters", narrative="The user wants facts.", aspects=True
)
QUERIES["render_relevance_v1"] = partial(_prompt, "relevance_v1")


def _requests(spark, sf):
    ready, _ = requests.attach_model(
        requests.fan_out(_samples(spark, sf), t.PANEL_MODELS), registry.models_df(spark, t.PANEL_MODELS)
    )
    return requests.build_requests(prompts.render_prompt(ready))


@query
def fan_out(spark, sf):
    return requests.fan_out(_samples(spark, sf), t.PANEL_MODELS).select("query_id", "docid", "model_id")


@query
def attach_model(spark, sf):
    """Good rows by model, and the rejects of a panel with two unusable models."""
    specs = (
        *t.PANEL_MODELS,
        registry.ModelSpec("no-route", "openrouter", 1024),
        registry.ModelSpec("odd", "elsewhere", 1024),
    )
    good, bad = requests.attach_model(
        requests.fan_out(_samples(spark, sf), specs), registry.models_df(spark, specs)
    )
    kept = good.groupBy("model_id", "provider", "temperature", "max_tokens").agg(F.count(F.lit(1)).alias("n"))
    dropped = bad.groupBy("model_id", F.col("reason").alias("provider")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(dropped, allowMissingColumns=True)


@query
def build_requests(spark, sf):
    return _requests(spark, sf).select(
        "query_id",
        "docid",
        "model_id",
        "prompt_sha256",
        F.col("request.model").alias("provider_model"),
        F.col("request.messages")[0]["role"].alias("role"),
        F.length(F.col("request.messages")[0]["content"]).alias("content_length"),
        F.col("request.temperature").alias("temperature"),
        F.col("request.max_tokens").alias("max_tokens"),
        F.col("request.timeout").alias("timeout"),
    )


@query
def judge(spark, sf):
    """Through the Python stage; a stand-in model scores the prompt's length modulo 3."""

    def factory():  # local, so that it is sent by value and executors need not have this module
        def complete(request):
            n = len(request["messages"][0]["content"])
            return {"raw_text": '{"O": %d}' % (n % 3), "latency_ms": float(n % 500), "version": request["model"] + "-v1"}

        return complete

    judged = requests.judge(_requests(spark, sf), factory)
    return requests.to_judgement(judged).select("query_id", "docid", "model_id", "version", "label", "score", "latency_ms", "retries")


@query
def judge_offline(spark, sf):
    """Requests answered from the table of completions."""
    answered = requests.judge_offline(_requests(spark, sf), t.completions(spark, sf))
    return requests.to_judgement(answered).select(
        "query_id", "docid", "model_id", "provider", "version", "label", "score", "raw_text", "latency_ms",
        "retries", r6("cost_estimate").alias("cost_estimate"), joined("warnings").alias("warnings"),
    )


@query
def cache_split(spark, sf):
    """Requests of the graded-1-or-2 samples count as judged before, by two of three models."""
    asked = _requests(spark, sf)
    gold = t.qrels(spark, sf).select("line_no", "relevance")
    judged = asked.join(gold, "line_no").where((F.col("relevance") > 0) & (F.col("model_id") != "phi3-mini"))
    return requests.mark_cached(asked, judged).select("query_id", "docid", "model_id", "cache_hit")


@query
def cache_split_unanswered(spark, sf):
    """The panel split per sample, by the prompt's hash alone; stored rows without an answer are asked again."""
    rendered = requests.hash_prompts(prompts.render_prompt(_samples(spark, sf)))
    asked = requests.fan_out(rendered.select("line_no", "prompt_sha256"), t.PANEL_MODELS)
    gold = t.qrels(spark, sf).select("line_no", "relevance")
    answer = F.when((F.col("relevance") > 0) & (F.col("model_id") != "phi3-mini"), '{"O": 1}')
    judged = asked.join(gold, "line_no").withColumn("raw_text", answer)
    split = requests.split_panel(rendered, judged, t.PANEL_MODELS)
    names = [F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ",")).alias(c) for c in ("cached", "to_ask")]
    return split.select("query_id", "docid", *names)


def _broken(df, body):
    """NDJSON lines of a table, every 13th cut short and every 17th without its first field."""
    n = F.col("line_no") % 221
    first = body[0]
    whole, part = F.to_json(F.struct(*body)), F.to_json(F.struct(*[c for c in body if c != first]))
    text = F.when(n % 13 == 0, F.left(whole, F.length(whole) - 1)).when(n % 17 == 0, part).otherwise(whole)
    return df.select("line_no", text.alias("value"))


def _both(good, rejects, *columns):
    """Good rows and rejected line numbers in one table."""
    kept = good.select(*columns, F.lit(None).cast("bigint").alias("rejected"), F.lit(None).cast("string").alias("reason"))
    lost = rejects.select(*[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in columns], F.col("line_no").alias("rejected"), "reason")
    return kept.unionByName(lost)


@query
def parse_judgements(spark, sf):
    """Judgements through NDJSON with planted bad lines: nothing of a row's identity is lost."""
    rows = t.completions(spark, sf).select(
        "model_id", F.col("doc_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("docid"), "raw_text",
        F.lit("run_1").alias("run_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("prompt_sha256"),
        (F.col("doc_id") + 1).alias("line_no"))
    good, bad = readers.parse_judgements(_broken(rows, ["model_id", "query_id", "docid", "raw_text", "run_id", "prompt_sha256", "line_no"]))
    return _both(good, bad, "model_id", "docid", "raw_text", "run_id", "prompt_sha256", "line_no")


@query
def parse_splits(spark, sf):
    """Canonical samples with references and metadata, with planted bad lines."""
    rows = t.table(spark, sf, "documents").select(
        (F.col("doc_id") + 1).alias("line_no"), F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("query"),
        F.col("source").alias("candidate"), F.array("lang", "source").alias("references"),
        F.create_map(F.lit("n"), F.col("n_chars").cast("string")).alias("metadata"))
    good, bad = readers.parse_splits(_broken(rows, ["sample_id", "query", "candidate", "references", "metadata"]), "train", "ch", "1")
    good = good.withColumns({"refs": joined("references"), "n": F.element_at("metadata", "n")})
    return _both(good, bad, "sample_id", "query", "candidate", "refs", "n", "split", "dataset", "version")


@query
def reject_logs(spark, sf):
    """Log lines, every tenth cut short: what the parser keeps and what it rejects."""
    lines = t.log_lines(spark, sf, "event_id").withColumnRenamed("event_id", "line_no")
    cut = lines.select("line_no", F.when(F.col("line_no") % 10 == 0, F.left("value", F.length("value") - 1)).otherwise(F.col("value")).alias("value"))
    kept = readers.parse_logs(cut).agg(F.count("*").alias("n")).withColumn("reason", F.lit(None).cast("string"))
    return kept.unionByName(readers.reject_logs(cut).groupBy("reason").agg(F.count("*").alias("n")))


@query
def parse_label(spark, sf):
    c = t.completions(spark, sf).withColumn("p", answers.parse_label(F.col("raw_text")))
    return c.select("doc_id", "model_id", "p.label", "p.score", joined("p.warnings").alias("warnings"))


@query
def parse_aspects(spark, sf):
    c = t.completions(spark, sf).withColumn("p", answers.parse_aspects(F.col("raw_text")))
    return c.select("doc_id", "model_id", "p.m", "p.t", "p.o")


@query
def parse_relevance_v1(spark, sf):
    """Answers made from the labels: names, a bad name, a confidence above one, no JSON."""
    d = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("irrelevant", "Partially", "relevant", "maybe")]), (d % 4 + 1).cast("int"))
    conf = F.format_string("%.2f", (d % 120) / F.lit(100.0).cast("double"))
    raw = F.when(d % 13 == 0, F.lit("no answer")).otherwise(
        F.concat(F.lit('Here: {"label": "'), name, F.lit('", "confidence": '), conf, F.lit(', "rationale": "row '), d.cast("string"), F.lit('"}'))
    )
    c = t.table(spark, sf, "labels").select("doc_id", answers.parse_relevance_v1(raw).alias("p"))
    return c.select("doc_id", "p.label", "p.confidence", "p.rationale", joined("p.warnings").alias("warnings"))


@query
def validate_judgements(spark, sf):
    """Generated judgements with scores and confidences pushed out of range."""
    d = F.length("docid")
    j = t.judgements(spark, sf).withColumn("lat", F.col("latency_ms").cast("int"))
    j = j.withColumns({
        "score": F.when(F.col("lat") % 10 == 1, F.col("score") + 3).otherwise(F.col("score")),
        "confidence": F.when(F.col("lat") % 10 == 2, F.lit(1.5)).otherwise(F.col("confidence")),
        "raw_text": F.when(F.col("lat") % 10 == 3, F.lit(None)).otherwise(F.col("raw_text")),
    })
    good, bad = requests.validate_judgements(j)
    return (
        good.withColumn("reason", F.lit("good")).unionByName(bad, allowMissingColumns=True)
        .groupBy("model_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("longest_docid"))
    )


@query
def infer_summary(spark, sf):
    s = requests.infer_summary(t.judgements(spark, sf), ["model_id"])
    return s.select("model_id", "judgement_count", "error_count", r6("avg_latency_ms").alias("avg_latency_ms"))


@query
def cost_latency(spark, sf):
    return _rounded_cost(telemetry.cost_latency(t.judgements(spark, sf)))


@query
def cost_latency_ranks(spark, sf):
    """The same where a few rows took a million times as long."""
    rare = F.col("latency_ms") % 1000 == 137
    j = t.judgements(spark, sf).withColumn("latency_ms", F.when(rare, F.col("latency_ms") * F.lit(1e6)).otherwise(F.col("latency_ms")))
    return _rounded_cost(telemetry.cost_latency(j))


def _rounded_cost(df):
    doubles = ("mean_latency_ms", "cost", "p50_latency_ms", "p95_latency_ms")
    return df.select("model_id", "n", "retries", *[r6(c).alias(c) for c in doubles])


# ---- aggregate ----------------------------------------------------------------


def _decision(df):
    return df.select(
        "sample_id", "final_label", r6("final_confidence").alias("final_confidence"), joined("flags").alias("flags")
    )


def _ensemble(spark, sf, **options):
    return votes.vote(t.judgements(spark, sf), t.PANEL_WEIGHTS, per_model=False, **options)


@query
def majority_vote(spark, sf):
    return _decision(votes.majority_vote(t.judgements(spark, sf), per_model=False))


@query
def weighted_vote(spark, sf):
    return _decision(_ensemble(spark, sf))


@query
def partial_vote(spark, sf):
    """Labelled judgements of two models, against the panel of three and the full list of pairs."""
    some = t.judgements(spark, sf).where((F.col("model_id") != "phi3-mini") & F.col("label").isNotNull())
    return _decision(votes.vote(some, t.PANEL_WEIGHTS, n_models=3, samples=t.gold(spark, sf), per_model=False))


@query
def latest_run_vote(spark, sf):
    """Two runs of every model: the later run's judgement is the vote."""
    both = t.judgements(spark, sf).unionByName(t.judgements(spark, sf, shift=1))
    return _decision(votes.vote(both, t.PANEL_WEIGHTS, per_model=False))


@query
def attach_weight(spark, sf):
    """Weights from a table, the default for the model that is not in it."""
    weights = registry.weights_df(spark, {"gpt-oss-20b": 2.5, "qwen-0.5b": 0.25})
    j = votes.attach_weight(t.judgements(spark, sf), weights, 1.5)
    return j.groupBy("model_id").agg(F.sum("weight").cast("double").alias("weight"), F.count(F.lit(1)).alias("n"))


@query
def per_model_votes(spark, sf):
    e = votes.vote(t.judgements(spark, sf), t.PANEL_WEIGHTS)
    return e.select("sample_id", F.posexplode("per_model_votes").alias("pos", "v"), "aggregation_strategy").select(
        "sample_id", "pos", "v.model_id", "v.label", F.col("v.weight").cast("double").alias("weight"),
        F.col("aggregation_strategy.name").alias("strategy"),
        F.col("aggregation_strategy.params")["default_weight"].alias("default_weight"),
    )


@query
def disagreement_metrics(spark, sf):
    m = votes.disagreement_metrics(t.judgements(spark, sf))
    rounded = ("vote_entropy", "pairwise_agreement", "score_stddev")
    return m.select("query_id", "docid", "n_votes", "n_valid", "n_distinct", "label_range", *[r6(c).alias(c) for c in rounded])


@query
def disagreement_sets(spark, sf):
    s = votes.disagreement_sets(t.judgements(spark, sf))
    return s.select("query_id", "docid", "n_distinct", *[joined(f"models_{k}").alias(f"models_{k}") for k in (0, 1, 2)])


@query
def disagreement_pairs(spark, sf):
    return votes.disagreement_pairs(t.judgements(spark, sf))


# ---- evaluate -----------------------------------------------------------------


def _scored(spark, sf):
    return scores.join_gold(_ensemble(spark, sf), t.gold(spark, sf))


@query
def join_gold(spark, sf):
    return _scored(spark, sf).select("query_id", "docid", "gold", "pred", "n", r6("confidence").alias("confidence"))


@query
def confusion_matrix(spark, sf):
    return scores.confusion_matrix(_scored(spark, sf))


@query
def confusion_wide(spark, sf):
    return scores.confusion_wide(_scored(spark, sf))


def _metrics(df, *keys):
    return df.select(*keys, "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def classification_metrics(spark, sf):
    return _metrics(scores.classification_metrics(_scored(spark, sf)))


@query
def model_metrics(spark, sf):
    rows = scores.judgement_scores(t.judgements(spark, sf), t.gold(spark, sf))
    return _metrics(scores.classification_metrics(rows, ["model_id"]), "model_id")


@query
def error_slices(spark, sf):
    rows = scores.judgement_scores(t.judgements(spark, sf), t.gold(spark, sf))
    return _metrics(scores.error_slices(rows, ["model_id", "query_id", "gold"]), "slice", "value")


@query
def error_slices_by_length(spark, sf):
    """Accuracy by document length, of the samples that have a text."""
    s = _samples(spark, sf)
    e = scores.join_gold(_ensemble(spark, sf), s).join(
        s.select("query_id", "docid", scores.length_bucket(F.col("doc")).alias("length")).distinct(), ["query_id", "docid"]
    )
    return _metrics(scores.error_slices(e, ["length"]), "slice", "value")


def _confident(spark, sf):
    return scores.judgement_scores(t.judgements(spark, sf), t.gold(spark, sf))


@query
def calibration_bins(spark, sf):
    b = scores.calibration_bins(_confident(spark, sf))
    return b.select("bin", "n", r6("mean_confidence").alias("mean_confidence"), r6("accuracy").alias("accuracy"))


@query
def expected_calibration_error(spark, sf):
    e = scores.expected_calibration_error(scores.calibration_bins(_confident(spark, sf)))
    return e.select(r6("ece").alias("ece"))


@query
def fit_calibration(spark, sf):
    # Confidences of many digits: none may be rounded before the fit.
    rows = _confident(spark, sf).withColumn("confidence", F.col("confidence") / 3.0)
    fitted = scores.calibrate(scores.fit_calibration(rows), scores.confidence_table(rows))
    return fitted.select("confidence", "n", r6("calibrated").alias("calibrated"))


# ---- logs and runs ------------------------------------------------------------


def _described(df, *keys):
    names = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return df.select(*keys, F.col("count").alias("n"), *[r6(c).alias(c) for c in names])


@query
def parse_logs(spark, sf):
    kind = F.expr("try_variant_get(fields, '$.kind', 'string')")
    return t.logs(spark, sf).select(
        "event", "cli", "run_id", "level", "latency_ms", kind.alias("kind"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
    )


@query
def filter_events(spark, sf):
    slow = telemetry.filter_events(t.logs(spark, sf), event="inference_success", level="info", min_latency_ms=100.0)
    return slow.select("run_id", "latency_ms")


@query
def describe_latency(spark, sf):
    ok = telemetry.filter_events(t.logs(spark, sf), event="inference_success")
    return _described(telemetry.describe_latency(ok))


@query
def describe_latency_by_run(spark, sf):
    ok = telemetry.filter_events(t.logs(spark, sf), event="inference_success")
    return _described(telemetry.describe_latency(ok, ["run_id"]), "run_id")


@query
def count_errors(spark, sf):
    return telemetry.count_errors(t.logs(spark, sf), ["run_id"])


@query
def mean_latency(spark, sf):
    return telemetry.mean_latency(t.logs(spark, sf), ["run_id"]).select("run_id", r6("mean_latency_ms").alias("mean_latency_ms"))


@query
def run_report(spark, sf):
    r = telemetry.run_report(t.logs(spark, sf))
    at = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return r.select(
        "run_id", "entries", joined("events").alias("events"), "git_sha",
        F.date_format("started", at).alias("started"), F.date_format("completed", at).alias("completed"),
    )


@query
def warning_counts(spark, sf):
    return telemetry.warning_counts(t.judgements(spark, sf), ["run_id", "model_id"])


@query
def problem_summary(spark, sf):
    p = telemetry.problem_summary(t.judgements(spark, sf), ["run_id", "model_id"])
    return p.withColumn("cost", r6("cost"))


@query
def run_id(spark, sf):
    hint = F.concat("event_type", F.lit(".v/"), F.col("user_id").cast("string"))
    return t.table(spark, sf, "events").select("event_id", text.run_id(F.col("ts"), hint).alias("run_id"))


@query
def list_runs(spark, sf):
    """Runs of one stage, taking every event as one run's manifest."""
    manifests = t.table(spark, sf, "events").select(
        F.col("event_type").alias("cli_name"), text.run_id(F.col("ts"), F.lit("panel")).alias("run_id")
    )
    return telemetry.list_runs(manifests, "click")


@query
def dataset_checksum(spark, sf):
    """Row count and checksum of the documents, with repeated and null values planted."""
    docs = t.documents(spark, sf)
    null = F.lit(None).cast("string")
    planted = docs.where(F.col("line_no") % 5 == 0).unionByName(docs.where(F.col("line_no") % 7 == 0).withColumn("doc", null))
    c = telemetry.dataset_checksum(docs.unionByName(planted))
    return c.select("n_rows", F.col("checksum").cast("string").alias("checksum"))


@query
def peek(spark, sf):
    """How many of the rows peeked at are rows of the table, whole."""
    return readers.peek(spark, f"{sf}/documents.parquet").intersect(t.table(spark, sf, "documents")).agg(F.count(F.lit(1)).alias("n"))


@query
def write_samples(spark, sf):
    """Samples written as NDJSON in the order of their qrels, read back by line number."""
    path = t.scratch(spark, "samples")
    sinks.write_samples(_samples(spark, sf).repartition(5, "docid"), path)
    good, _ = readers.read_samples(spark, path)
    return good.select("line_no", "query_id", "docid", "gold_relevance")


@query
def write_judgements(spark, sf):
    """Judgements written in the order of their samples and models, read back by line number."""
    path = t.scratch(spark, "judgements")
    judged = t.judgements(spark, sf).withColumn("line_no", F.regexp_extract("docid", "[0-9]+", 0).cast("bigint"))
    sinks.write_judgements(judged.repartition(5, "raw_text"), path)
    lines = read_lines(spark, path)
    return lines.select("line_no", F.get_json_object("value", "$.docid").alias("docid"), F.get_json_object("value", "$.model_id").alias("model_id"))
