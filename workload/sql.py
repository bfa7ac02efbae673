"""SQL twins of the queries, for DuckDB over the same tables.

They are written from the meaning of each operator: labels come from the
generator's arithmetic, not from a second parser.
"""

from __future__ import annotations

from jurybox.functions import prompts as p


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


Q = "q AS (SELECT item_id + 1 AS line_no, CAST(item_id AS VARCHAR) AS query_id, trim(replace(text, chr(10), ' ')) AS query_text FROM benchmark)"
D = "d AS (SELECT doc_id + 1 AS line_no, CAST(doc_id AS VARCHAR) AS docid, text AS doc FROM documents)"
KEYS = """CAST(doc_id % 50 + CASE WHEN doc_id % 11 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS query_id,
    CAST(doc_id + CASE WHEN doc_id % 7 = 0 THEN 10000000 ELSE 0 END AS VARCHAR) AS docid"""
RELEVANCE = "CAST(CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS BIGINT)"
R = f"r AS (SELECT doc_id + 1 AS line_no, {KEYS}, {RELEVANCE} AS relevance FROM labels)"
S = f"""{Q}, {D}, {R}, s AS (
  SELECT r.line_no, 'llm-judge-2024' AS dataset, r.query_id, q.query_text, r.docid, d.doc, r.relevance AS gold_relevance
  FROM r JOIN q ON r.query_id = q.query_id JOIN d ON r.docid = d.docid)"""
PANEL = "(VALUES ('gpt-oss-20b', 1, 2.0), ('qwen-0.5b', 5, 1.0), ('phi3-mini', 7, 1.0)) AS m(model_id, k, w)"


def _judged(shift: int = 0, name: str = "j") -> str:
    return f"""{name}0 AS (
  SELECT doc_id, {KEYS}, {RELEVANCE} AS gold, model_id, k, CAST(w AS DECIMAL(18,6)) AS w,
    (doc_id * k + quality + doc_id // k + {shift}) % 6 AS r
  FROM labels, {PANEL}),
{name} AS (
  SELECT doc_id, query_id, docid, gold, model_id, w, r,
    CASE WHEN r <= 2 THEN CAST(r AS INT) WHEN r = 5 THEN 1 END AS label,
    CASE WHEN r = 3 THEN 'No JSON object with ''O'' field found in response'
         WHEN r = 4 THEN 'Invalid O score: 7 (expected 0, 1, or 2)' ELSE '' END AS warnings,
    CASE WHEN r <= 2 THEN '{{"O": ' || r || '}}' WHEN r = 3 THEN 'cannot judge this page'
         WHEN r = 4 THEN '{{"O": 7}}' ELSE 'Sure: {{"M": 1, "T": 2, "O": 1}} done' END AS raw_text,
    CAST(100 + (doc_id * k) % 400 AS DOUBLE) AS latency_ms,
    CAST(doc_id % 3 AS INT) AS retries,
    CAST(doc_id % 1000 AS DOUBLE) * 0.000001 AS cost_estimate,
    CAST((doc_id * k) % 101 AS DOUBLE) / 100 AS confidence,
    'run_{9 - shift}' AS run_id
  FROM {name}0)"""


J = _judged()


def _vote(source: str, weight: str = "w", panel: str = "3", pairs: str | None = None) -> str:
    """CTEs ending in `v`: the decision per pair."""
    base = pairs or f"SELECT DISTINCT query_id, docid FROM {source}"
    return f"""
t AS (SELECT query_id, docid,
    sum(CASE WHEN label = 0 THEN {weight} END) AS w0, sum(CASE WHEN label = 1 THEN {weight} END) AS w1,
    sum(CASE WHEN label = 2 THEN {weight} END) AS w2, count(label) AS n_valid, bool_or(warnings <> '') AS fallback
  FROM {source} GROUP BY query_id, docid),
u AS (SELECT b.query_id, b.docid, w0, w1, w2, coalesce(n_valid, 0) AS n_valid, coalesce(fallback, false) AS fallback,
    greatest(coalesce(w0, -1), coalesce(w1, -1), coalesce(w2, -1)) AS best,
    coalesce(w0, 0) + coalesce(w1, 0) + coalesce(w2, 0) AS total
  FROM ({base}) b LEFT JOIN t ON b.query_id = t.query_id AND b.docid = t.docid),
x AS (SELECT *, CASE WHEN n_valid = 0 THEN 0.0 ELSE CAST(best AS DOUBLE) / CAST(total AS DOUBLE) END AS conf,
    CASE WHEN w0 = best THEN 1 ELSE 0 END + CASE WHEN w1 = best THEN 1 ELSE 0 END + CASE WHEN w2 = best THEN 1 ELSE 0 END AS at_best
  FROM u),
v AS (SELECT query_id, docid, query_id || ':' || docid AS sample_id,
    CAST(CASE WHEN n_valid = 0 THEN NULL WHEN w0 = best THEN 0 WHEN w1 = best THEN 1 ELSE 2 END AS INT) AS final_label,
    round(conf, 6) AS final_confidence,
    concat_ws(',', CASE WHEN at_best > 1 THEN 'tie' END, CASE WHEN n_valid > 0 AND conf < 0.5 THEN 'low_agreement' END,
      CASE WHEN fallback THEN 'parser_fallback' END, CASE WHEN n_valid > 0 AND n_valid < {panel} THEN 'partial_votes' END,
      CASE WHEN n_valid = 0 THEN 'no_valid_votes' END) AS flags
  FROM x)"""


DECISION = "SELECT sample_id, final_label, final_confidence, flags FROM v"
SCORED = f"""{J}, {_vote('j')},
g AS (SELECT {KEYS}, {RELEVANCE} AS gold, CAST(1 AS BIGINT) AS n FROM labels),
sc AS (SELECT g.query_id, g.docid, g.gold, v.final_label AS pred, g.n, v.final_confidence AS confidence
  FROM g JOIN v ON g.query_id = v.query_id AND g.docid = v.docid)"""


def _metrics(source: str, keys: str = "") -> str:
    """n, accuracy and macro F1 of (gold, pred) rows, by keys."""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""
acc AS (SELECT {lead}CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM {source} {group}),
lab AS (SELECT {lead}gold AS label, CASE WHEN gold = pred THEN 1 ELSE 0 END AS tp, CASE WHEN gold = pred THEN 0 ELSE 1 END AS fn, 0 AS fp FROM {source}
  UNION ALL SELECT {lead}pred, 0, 0, CASE WHEN gold = pred THEN 0 ELSE 1 END FROM {source} WHERE pred IS NOT NULL),
f AS (SELECT {lead}label, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM lab GROUP BY {lead}label),
mf AS (SELECT {lead}avg(f1) AS macro_f1 FROM f {group})
SELECT {lead}n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM acc JOIN mf {using}"""


def _rater(role: bool, wanted: str, aspects: bool) -> str:
    head = "\n\n" + (p.RATER_ROLE if role else "") + p.RATER_SCALE
    middle = p.RATER_QUERY_END + wanted + p.RATER_PAGE
    tail = p.RATER_PAGE_END + (p.RATER_ASPECTS if aspects else p.RATER_OVERALL)
    return f"{_lit(head)} || query_text || {_lit(middle)} || doc || {_lit(tail)}"


RATER = _rater(True, "", False)
RATER_ASPECTS = _rater(False, p.RATER_LOOKING_FOR + " a page for raters The user wants facts.\n", True)
RELEVANCE_V1 = f"{_lit(p.JUDGE_INTRO)} || query_text || {_lit(p.JUDGE_CANDIDATE)} || doc"


def _prompt(text: str) -> str:
    return f"WITH {S} SELECT query_id, docid, length({text}) AS prompt_length, md5({text}) AS prompt_md5 FROM s"


MODELS = """(VALUES ('gpt-oss-20b', 'openrouter', 'openai/gpt-oss-20b:free', 8192, 256),
  ('qwen-0.5b', 'openrouter', 'qwen/qwen-0.5b-chat', 2048, 256),
  ('phi3-mini', 'hf', 'microsoft/Phi-3-mini-4k-instruct', 4096, 128)) AS m(model_id, provider, provider_model, context_window, max_tokens)"""
REQ = f"{S}, rq AS (SELECT s.*, m.*, {RATER} AS prompt FROM s, {MODELS})"
LOGS = """l AS (SELECT CASE WHEN event_type = 'error' THEN 'inference_failed' ELSE 'inference_success' END AS event,
  'run_' || (user_id % 10) AS run_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
  value AS latency_ms, event_type AS kind, ts FROM events)"""


def _describe(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean, round(stddev_samp(latency_ms), 6) AS std,
  round(min(latency_ms), 6) AS min, round(quantile_cont(latency_ms, 0.25), 6) AS p25, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
  round(quantile_cont(latency_ms, 0.75), 6) AS p75, round(max(latency_ms), 6) AS max FROM {source} {group}"""


COST = f"""WITH {J} SELECT model_id, count(*) AS n, CAST(sum(retries) AS BIGINT) AS retries, round(avg(latency_ms), 6) AS mean_latency_ms,
  round(sum(cost_estimate), 6) AS cost, round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms FROM j GROUP BY model_id"""
CONFIDENT = f"{J}, cf AS (SELECT confidence, CASE WHEN label = gold THEN 1 ELSE 0 END AS correct FROM j)"
BINS = f"""{CONFIDENT}, b AS (SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n,
  avg(confidence) AS mean_confidence, avg(CAST(correct AS DOUBLE)) AS accuracy FROM cf GROUP BY 1)"""
SAMPLES = f"WITH {S} SELECT * FROM s"

ORACLE: dict[str, str] = {
    "parse_queries": f"WITH {Q} SELECT line_no, query_id, query_text FROM q",
    "parse_documents": f"WITH {D} SELECT line_no, docid, doc FROM d",
    "parse_qrels": f"WITH {R} SELECT line_no, query_id, docid, relevance FROM r",
    "reject_rows": """WITH x AS (
      SELECT 'queries' AS source, item_id + 1 AS n, CASE WHEN (item_id + 1) % 7 = 3 THEN 'Invalid query line' END AS reason FROM benchmark
      UNION ALL SELECT 'documents', doc_id + 1, CASE (doc_id + 1) % 9 WHEN 1 THEN 'Invalid JSONL' WHEN 2 THEN 'Missing docid/doc' WHEN 3 THEN 'Missing docid/doc' END FROM documents
      UNION ALL SELECT 'qrels', doc_id + 1, CASE (doc_id + 1) % 5 WHEN 1 THEN 'Invalid qrel line' WHEN 2 THEN 'Invalid relevance' END FROM labels)
      SELECT source, reason, count(*) AS n, min(n) AS first_line FROM x WHERE reason IS NOT NULL GROUP BY source, reason""",
    "build_samples": SAMPLES,
    "parse_samples": SAMPLES,
    "build_samples_spread": SAMPLES,
    "limit_samples": f"WITH {S} SELECT * FROM s ORDER BY line_no LIMIT 25",
    "limit_examples": f"""WITH {S}, o AS (SELECT *, row_number() OVER (ORDER BY line_no DESC) AS rn FROM s)
      SELECT line_no, query_id, docid FROM o WHERE rn > 10""",
    "missing_counts": f"""WITH {Q}, {D}, {R}
      SELECT count(*) FILTER (query_id NOT IN (SELECT query_id FROM q)) AS missing_query,
        count(*) FILTER (query_id IN (SELECT query_id FROM q) AND docid NOT IN (SELECT docid FROM d)) AS missing_doc FROM r""",
    "skip_message": f"""WITH {Q}, {D}, {R}, c AS (
      SELECT count(*) FILTER (query_id NOT IN (SELECT query_id FROM q)) AS a,
        count(*) FILTER (query_id IN (SELECT query_id FROM q) AND docid NOT IN (SELECT docid FROM d)) AS b FROM r)
      SELECT 'Skipped ' || a || ' qrels with missing query and ' || b || ' with missing doc' AS message FROM c WHERE a > 0 OR b > 0""",
    "ingest_summary": f"WITH {S} SELECT count(*) AS sample_count FROM s",
    "last_wins": """SELECT CAST(doc_id // 3 AS VARCHAR) AS docid, arg_max(text, doc_id) AS doc, max(doc_id) AS line_no
      FROM documents GROUP BY doc_id // 3""",
    "last_wins_ties": """WITH x AS (SELECT nullif(doc_id // 7, 3) AS docid, text AS doc, lang, CASE WHEN doc_id % 4 > 0 THEN doc_id % 3 END AS line_no FROM documents),
      o AS (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY line_no DESC NULLS LAST, doc DESC NULLS LAST, lang DESC NULLS LAST) AS rn FROM x)
      SELECT docid, doc, lang, line_no FROM o WHERE rn = 1""",
    "to_canonical_sample": f"""WITH {S} SELECT query_id || ':' || docid AS sample_id, query_text AS query, doc AS candidate,
      CASE gold_relevance WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'partially' WHEN 2 THEN 'relevant' END AS gold_label,
      dataset AS domain, length(doc) AS length FROM s""",
    "map_label_space": f"""WITH {R} SELECT line_no, relevance,
      CASE relevance WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'partially' WHEN 2 THEN 'relevant' END AS name,
      CAST(relevance AS INT) AS back FROM r""",
    "clean_text": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents""",
    "token_budget": f"""WITH {S} SELECT query_id, docid, model_id, (length(doc) + 3) // 4 AS n_tokens_est, max_tokens,
      (length(doc) + 3) // 4 + max_tokens > context_window AS over_budget FROM s, {MODELS}""",
    "chunk_documents": r"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS docid, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS w FROM documents),
      c AS (SELECT docid, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 200) / 180.0) AS BIGINT)))) AS i FROM w WHERE len(w) > 0)
      SELECT docid, CAST(i AS INT) AS chunk_no, array_to_string(list_slice(w, i * 180 + 1, i * 180 + 200), ' ') AS chunk FROM c""",
    "render_prompt": _prompt(RATER),
    "render_prompt_aspects": _prompt(RATER_ASPECTS),
    "render_relevance_v1": _prompt(RELEVANCE_V1),
    "fan_out": f"WITH {S} SELECT query_id, docid, model_id FROM s, {PANEL}",
    "attach_model": f"""WITH {S}, n AS (SELECT count(*) AS n FROM s)
      SELECT x.*, n FROM (VALUES ('gpt-oss-20b', 'openrouter', CAST(0.0 AS DOUBLE), 256), ('qwen-0.5b', 'openrouter', 0.0, 256), ('phi3-mini', 'hf', 0.0, 128),
        ('no-route', 'Missing openrouter_model_id: no-route', NULL, NULL), ('odd', 'Unsupported provider: elsewhere', NULL, NULL))
      AS x(model_id, provider, temperature, max_tokens), n""",
    "build_requests": f"""WITH {REQ} SELECT query_id, docid, model_id, sha256(prompt) AS prompt_sha256, provider_model, 'user' AS role,
      length(prompt) AS content_length, CAST(0.0 AS DOUBLE) AS temperature, max_tokens, 30 AS timeout FROM rq""",
    "judge": f"""WITH {REQ} SELECT query_id, docid, model_id, provider_model || '-v1' AS version, CAST(length(prompt) % 3 AS INT) AS label,
      CAST(length(prompt) % 3 AS DOUBLE) AS score, CAST(length(prompt) % 500 AS DOUBLE) AS latency_ms, 0 AS retries FROM rq""",
    "judge_offline": f"""WITH {REQ}, {J} SELECT rq.query_id, rq.docid, rq.model_id, rq.provider, provider_model AS version, label,
      CAST(label AS DOUBLE) AS score, raw_text, latency_ms, retries, round(cost_estimate, 6) AS cost_estimate, warnings
      FROM rq JOIN j ON rq.query_id = j.query_id AND rq.docid = j.docid AND rq.model_id = j.model_id""",
    "cache_split": f"""WITH {REQ}, known AS (SELECT DISTINCT model_id, prompt FROM rq WHERE gold_relevance > 0 AND model_id <> 'phi3-mini')
      SELECT query_id, docid, model_id, EXISTS (SELECT 1 FROM known k WHERE k.model_id = rq.model_id AND k.prompt = rq.prompt) AS cache_hit FROM rq""",
    "parse_label": f"WITH {J} SELECT doc_id, model_id, label, CAST(label AS DOUBLE) AS score, warnings FROM j",
    "parse_aspects": f"""WITH {J} SELECT doc_id, model_id, CASE WHEN r = 5 THEN 1 END AS m, CASE WHEN r = 5 THEN 2 END AS t,
      CASE WHEN r <= 2 THEN CAST(r AS INT) WHEN r = 4 THEN 7 WHEN r = 5 THEN 1 END AS o FROM j""",
    "parse_relevance_v1": """WITH x AS (SELECT doc_id, doc_id % 13 = 0 AS none, doc_id % 4 AS k, CAST(doc_id % 120 AS DOUBLE) / 100 AS c FROM labels)
      SELECT doc_id, CASE WHEN NOT none AND k < 3 THEN CAST(k AS INT) END AS label, CASE WHEN NOT none AND c <= 1 THEN c END AS confidence,
        CASE WHEN NOT none THEN 'row ' || doc_id END AS rationale,
        CASE WHEN none THEN 'No JSON object with ''label'' field found in response' ELSE
          concat_ws(',', CASE WHEN k = 3 THEN 'Invalid label: maybe' END, CASE WHEN c > 1 THEN 'Invalid confidence: ' || CAST(c AS VARCHAR) END) END AS warnings
      FROM x""",
    "validate_judgements": f"""WITH {J}, x AS (SELECT model_id, length(docid) AS n, CASE
        WHEN CAST(latency_ms AS INT) % 10 = 3 THEN 'Missing required: raw_text'
        WHEN CAST(latency_ms AS INT) % 10 = 1 AND label IS NOT NULL THEN 'Invalid score'
        WHEN CAST(latency_ms AS INT) % 10 = 2 THEN 'Invalid confidence' ELSE 'good' END AS reason FROM j)
      SELECT model_id, reason, count(*) AS n, CAST(max(n) AS INT) AS longest_docid FROM x GROUP BY model_id, reason""",
    "infer_summary": f"""WITH {J} SELECT model_id, count(*) AS judgement_count, count(*) - count(label) AS error_count,
      round(avg(latency_ms), 6) AS avg_latency_ms FROM j GROUP BY model_id""",
    "cost_latency": COST,
    "cost_latency_ranks": COST.replace("SELECT model_id, count", ", k AS (SELECT * REPLACE (CASE WHEN latency_ms % 1000 = 137 THEN latency_ms * 1e6 ELSE latency_ms END AS latency_ms) FROM j) SELECT model_id, count").replace("FROM j GROUP", "FROM k GROUP"),
    "majority_vote": f"WITH {J}, {_vote('j', 'CAST(1 AS DECIMAL(18,6))')} {DECISION}",
    "weighted_vote": f"WITH {J}, {_vote('j')} {DECISION}",
    "partial_vote": f"""WITH {J}, jp AS (SELECT * FROM j WHERE model_id <> 'phi3-mini' AND label IS NOT NULL),
      {_vote('jp', pairs=f'SELECT DISTINCT {KEYS} FROM labels')} {DECISION}""",
    "latest_run_vote": f"""WITH {J}, {_judged(1, 'o')}, both_runs AS (SELECT * FROM j UNION ALL SELECT * FROM o),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, docid, model_id ORDER BY run_id DESC) AS rn FROM both_runs),
      latest AS (SELECT * FROM ranked WHERE rn = 1), {_vote('latest')} {DECISION}""",
    "attach_weight": f"""WITH {J} SELECT model_id, CAST(count(*) * CASE model_id WHEN 'gpt-oss-20b' THEN 2.5 WHEN 'qwen-0.5b' THEN 0.25 ELSE 1.5 END AS DOUBLE) AS weight,
      count(*) AS n FROM j GROUP BY model_id""",
    "per_model_votes": f"""WITH {J} SELECT query_id || ':' || docid AS sample_id,
      CAST(row_number() OVER (PARTITION BY query_id, docid ORDER BY model_id) - 1 AS INT) AS pos, model_id, label, CAST(w AS DOUBLE) AS weight,
      'weighted_majority' AS strategy, '1.0' AS default_weight FROM j""",
    "disagreement_metrics": f"""WITH {J}, c AS (SELECT query_id, docid, label, count(*) AS c FROM j WHERE label IS NOT NULL GROUP BY ALL),
      n AS (SELECT query_id, docid, sum(c) AS t FROM c GROUP BY ALL),
      e AS (SELECT query_id, docid, sum(-(c / t) * log2(c / t)) AS h, sum(c * (c - 1)) AS same FROM c JOIN n USING (query_id, docid) GROUP BY ALL),
      b AS (SELECT query_id, docid, count(*) AS n_votes, count(label) AS n_valid, CAST(count(DISTINCT label) AS INT) AS n_distinct,
        max(label) - min(label) AS label_range, stddev_pop(CAST(label AS DOUBLE)) AS sd FROM j GROUP BY ALL)
      SELECT query_id, docid, n_votes, n_valid, n_distinct, label_range, round(h, 6) AS vote_entropy,
        CASE WHEN n_valid >= 2 THEN round(same / (n_valid * (n_valid - 1)), 6) END AS pairwise_agreement, round(sd, 6) AS score_stddev
      FROM b LEFT JOIN e USING (query_id, docid)""",
    "disagreement_sets": f"""WITH {J} SELECT query_id, docid, count(DISTINCT label) AS n_distinct,
      coalesce(string_agg(CASE WHEN label = 0 THEN model_id END, ',' ORDER BY model_id), '') AS models_0,
      coalesce(string_agg(CASE WHEN label = 1 THEN model_id END, ',' ORDER BY model_id), '') AS models_1,
      coalesce(string_agg(CASE WHEN label = 2 THEN model_id END, ',' ORDER BY model_id), '') AS models_2
      FROM j GROUP BY query_id, docid HAVING count(DISTINCT label) > 1""",
    "disagreement_pairs": f"""WITH {J} SELECT a.model_id AS model_a, b.model_id AS model_b,
      count(*) FILTER (a.label IS NOT NULL AND b.label IS NOT NULL) AS n_both, count(*) FILTER (a.label <> b.label) AS n_different
      FROM j a JOIN j b ON a.query_id = b.query_id AND a.docid = b.docid AND a.model_id < b.model_id GROUP BY 1, 2""",
    "join_gold": f"WITH {SCORED} SELECT * FROM sc",
    "confusion_matrix": f"WITH {SCORED} SELECT gold, pred, count(*) AS n FROM sc GROUP BY gold, pred",
    "confusion_wide": f"""WITH {SCORED} SELECT gold, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1,
      count(*) FILTER (pred = 2) AS pred_2, count(*) FILTER (pred IS NULL) AS pred_null FROM sc GROUP BY gold""",
    "classification_metrics": f"WITH {SCORED}, {_metrics('sc')}",
    "model_metrics": f"WITH {J}, ms AS (SELECT model_id, gold, label AS pred FROM j), {_metrics('ms', 'model_id')}",
    "error_slices": f"""WITH {J}, ms AS (
      SELECT 'model_id' AS slice, model_id AS value, gold, label AS pred FROM j UNION ALL
      SELECT 'query_id', query_id, gold, label FROM j UNION ALL
      SELECT 'gold', CAST(gold AS VARCHAR), gold, label FROM j), {_metrics('ms', 'slice, value')}""",
    "error_slices_by_length": f"""WITH {Q}, {D}, {R}, {SCORED}, ms AS (
      SELECT 'length' AS slice, CASE WHEN length(doc) < 1000 THEN 'short' WHEN length(doc) < 10000 THEN 'medium' ELSE 'long' END AS value, gold, pred
      FROM sc JOIN q ON sc.query_id = q.query_id JOIN d ON sc.docid = d.docid), {_metrics('ms', 'slice, value')}""",
    "calibration_bins": f"WITH {BINS} SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM b",
    "expected_calibration_error": f"WITH {BINS} SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM b",
    # Isotonic fit by its max-min formula over the counted confidences.
    "fit_calibration": f"""WITH {CONFIDENT}, pt AS (SELECT confidence / 3.0 AS c, count(*) AS n, sum(correct) AS s FROM cf GROUP BY 1),
      o AS (SELECT c, n, s, row_number() OVER (ORDER BY c) AS i, sum(n) OVER (ORDER BY c) AS cn, sum(s) OVER (ORDER BY c) AS cs FROM pt),
      lowest AS (SELECT a.i AS i, b.i AS f, min((z.cs - b.cs + b.s) / (z.cn - b.cn + b.n)) AS v
        FROM o a JOIN o b ON b.i <= a.i JOIN o z ON z.i >= a.i GROUP BY 1, 2)
      SELECT c AS confidence, n, round(max(v), 6) AS calibrated FROM o JOIN lowest USING (i) GROUP BY c, n""",
    "parse_logs": f"""WITH {LOGS} SELECT event, 'infer' AS cli, run_id, level, latency_ms, kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "at" FROM l""",
    "filter_events": f"WITH {LOGS} SELECT run_id, latency_ms FROM l WHERE level = 'info' AND latency_ms > 100",
    "describe_latency": f"WITH {LOGS}, ok AS (SELECT * FROM l WHERE level = 'info') {_describe('ok')}",
    "describe_latency_by_run": f"WITH {LOGS}, ok AS (SELECT * FROM l WHERE level = 'info') {_describe('ok', 'run_id')}",
    "count_errors": f"WITH {LOGS} SELECT run_id, count(*) FILTER (level = 'error') AS error_count FROM l GROUP BY run_id",
    "mean_latency": f"WITH {LOGS} SELECT run_id, round(avg(latency_ms) FILTER (level = 'info'), 6) AS mean_latency_ms FROM l GROUP BY run_id",
    "run_report": f"""WITH {LOGS} SELECT run_id, count(*) AS entries, string_agg(DISTINCT event, ',' ORDER BY event) AS events, '0000000' AS git_sha,
      strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS completed FROM l GROUP BY run_id""",
    "warning_counts": f"""WITH {J} SELECT run_id, model_id, split_part(warnings, ':', 1) AS warning, count(*) AS n FROM j WHERE warnings <> '' GROUP BY ALL""",
    "problem_summary": f"""WITH {J} SELECT run_id, model_id, count(*) FILTER (warnings <> '') AS warnings, CAST(sum(retries) AS BIGINT) AS retries,
      count(*) - count(label) AS errors, round(sum(cost_estimate), 6) AS cost FROM j GROUP BY run_id, model_id""",
    "run_id": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(event_type || 'v' || user_id, 1, 30) AS run_id FROM events""",
    "list_runs": """SELECT DISTINCT strftime(ts, '%Y%m%d_%H%M%S') || '_panel' AS run_id FROM events WHERE event_type = 'click'""",
    "parse_judgements": f"""WITH {J}, c AS (SELECT model_id, CAST(doc_id AS VARCHAR) AS docid, raw_text, 'run_1' AS run_id,
        sha256(CAST(doc_id AS VARCHAR)) AS prompt_sha256, doc_id + 1 AS line_no FROM j),
      m AS (SELECT *, CASE WHEN line_no % 221 % 13 = 0 THEN 'Invalid JSON' WHEN line_no % 221 % 17 = 0 THEN 'Invalid judgement' END AS reason FROM c)
      SELECT model_id, docid, raw_text, run_id, prompt_sha256, line_no, NULL::BIGINT AS rejected, NULL::VARCHAR AS reason FROM m WHERE reason IS NULL
      UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, line_no, reason FROM m WHERE reason IS NOT NULL""",
    "parse_splits": """WITH m AS (SELECT *, doc_id + 1 AS l, CASE WHEN (doc_id + 1) % 221 % 13 = 0 THEN 'Invalid JSON'
        WHEN (doc_id + 1) % 221 % 17 = 0 THEN 'Invalid sample' END AS reason FROM documents)
      SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS query, source AS candidate, lang || ',' || source AS refs, CAST(n_chars AS VARCHAR) AS n,
        'train' AS split, 'ch' AS dataset, '1' AS version, NULL::BIGINT AS rejected, NULL::VARCHAR AS reason FROM m WHERE reason IS NULL
      UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, l, reason FROM m WHERE reason IS NOT NULL""",
    "reject_logs": """SELECT count(*) FILTER (event_id % 10 <> 0) AS n, NULL::VARCHAR AS reason FROM events
      UNION ALL SELECT count(*), 'Invalid JSON' FROM events WHERE event_id % 10 = 0 GROUP BY 2""",
    "cache_split_unanswered": f"""WITH {REQ}, known AS (SELECT DISTINCT model_id, prompt FROM rq WHERE gold_relevance > 0 AND model_id <> 'phi3-mini')
      SELECT query_id, docid, string_agg(model_id, ',' ORDER BY model_id) FILTER (hit) AS cached,
        string_agg(model_id, ',' ORDER BY model_id) FILTER (NOT hit) AS to_ask
      FROM (SELECT line_no, query_id, docid, model_id, EXISTS (SELECT 1 FROM known k WHERE k.model_id = rq.model_id AND k.prompt = rq.prompt) AS hit FROM rq)
      GROUP BY line_no, query_id, docid""",
    "dataset_checksum": f"""WITH {D}, x AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE line_no % 5 = 0
        UNION ALL SELECT line_no, docid, NULL FROM d WHERE line_no % 7 = 0),
      c AS (SELECT coalesce('V' || strlen(line_no::VARCHAR) || ':' || line_no, 'N') || coalesce('V' || strlen(docid) || ':' || docid, 'N')
        || coalesce('V' || strlen(doc) || ':' || doc, 'N') AS t FROM x)
      SELECT count(*) AS n_rows, (sum(('0x' || left(md5(t), 16))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR AS checksum FROM c""",
    "peek": "SELECT least(count(*), 50) AS n FROM documents",
    "write_samples": f"""WITH {S} SELECT row_number() OVER (ORDER BY line_no) AS line_no, query_id, docid, gold_relevance FROM s""",
    "write_judgements": f"""WITH {J} SELECT row_number() OVER (ORDER BY CAST(docid AS BIGINT), model_id) AS line_no, docid, model_id FROM j""",
}
