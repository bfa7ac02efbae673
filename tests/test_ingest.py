"""Line parsers, line numbers, last-wins and the sample join."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jurybox.operators import joins, samples
from jurybox.sources import lines as ln
from jurybox.sources import parsers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_queries_good_lines(lines):
    good, bad = parsers.parse_queries(lines("q1\tWhat is AI?", "", "q2\t Define\tML \t", "q3\t"))
    assert rows(good, "line_no", "query_id", "query_text") == [
        (1, "q1", "What is AI?"), (3, "q2", "Define\tML"), (4, "q3", ""),
    ]
    assert bad.count() == 0


def test_queries_bad_lines(lines):
    _, bad = parsers.parse_queries(lines("q1\tx", "   ", "q1_missing_query"))
    assert rows(bad, "line_no", "reason") == [(2, "Invalid query line"), (3, "Invalid query line")]
    with pytest.raises(ValueError, match="Invalid query line at line 2"):
        parsers.check(bad)
    assert parsers.check(bad, strict=False) is bad


DOCUMENT_LINES = [
    ('{"docid":"d1","doc":"Text 1"}', None),
    (' {"docid":"d2","doc":" x "}\x0b', None),
    ("", "blank"),
    ("  　", "blank"),
    ("{not valid json}", "Invalid JSONL"),
    ('{"doc":"Text"}', "Missing docid/doc"),
    ('{"docid":"d1"}', "Missing docid/doc"),
    ('{"docid":5,"doc":"x"}', "Missing docid/doc"),
    ('{"docid":"d","doc":null}', "Missing docid/doc"),
    ('{"docid":"d","doc":["x"]}', "Missing docid/doc"),
    ('{"docid":"d","doc":"x"} tail', "Invalid JSONL"),
    ('{"docid":"d","doc":"x"},{"docid":"e","doc":"y"}', "Invalid JSONL"),
    ('{"docid":"d","doc":"x"}] tail [', "Invalid JSONL"),
    ("{'docid':'d','doc':'x'}", "Invalid JSONL"),
    ('{"docid":"d","doc":"x",}', "Invalid JSONL"),
    ('{"docid":"a","docid":"d9","doc":"x"}', None),
    ('{"docid":"d8","doc":"\\ud83d\\ude00\\n\\t\\"","n":NaN}', None),
]


def test_documents_case_by_case(lines):
    good, bad = parsers.parse_documents(lines(*[text for text, _ in DOCUMENT_LINES]))
    reasons = dict(rows(bad, "line_no", "reason"))
    kept = {r["line_no"]: (r["docid"], r["doc"]) for r in good.collect()}
    for number, (text, reason) in enumerate(DOCUMENT_LINES, start=1):
        if reason is None:
            parsed = json.loads(text.strip())
            assert kept[number] == (parsed["docid"], parsed["doc"])
        elif reason == "blank":
            assert number not in kept and number not in reasons
        else:
            assert reasons[number] == reason, text


def test_qrels(lines):
    good, bad = parsers.parse_qrels(
        lines("q1 1 d1", "", " q2\t-3  d2 ", "q1 1", "q1 bad d1", "q1 1.5 d1", "q1 +2 d3", "q1 1_0 d4", "a 1 b c", "q 7 d5")
    )
    assert rows(good, "line_no", "query_id", "relevance", "docid") == [
        (1, "q1", 1, "d1"), (3, "q2", -3, "d2"), (7, "q1", 2, "d3"), (8, "q1", 10, "d4"), (10, "q", 7, "d5"),
    ]
    assert rows(bad, "line_no", "reason") == [
        (4, "Invalid qrel line"), (5, "Invalid relevance"), (6, "Invalid relevance"), (9, "Invalid qrel line"),
    ]


alphabet = st.sampled_from(list("ab1 \t \x1c+-_.{}\":,"))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet, max_size=12), min_size=150, max_size=200))
def test_parsers_against_plain_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts, start=1)), "line_no bigint, value string")
    want_q, want_r = {}, {}
    for number, text in enumerate(texts, start=1):
        parts = text.split("\t", 1)
        if len(parts) == 2:
            want_q[number] = (parts[0].strip(), parts[1].strip())
        words = text.split()
        if len(words) == 3:
            try:
                want_r[number] = (words[0], int(words[1]), words[2])
            except ValueError:
                pass
    got_q = {r["line_no"]: (r["query_id"], r["query_text"]) for r in parsers.parse_queries(df)[0].collect()}
    got_r = {r["line_no"]: (r["query_id"], r["relevance"], r["docid"]) for r in parsers.parse_qrels(df)[0].collect()}
    assert got_q == want_q
    assert got_r == want_r


def test_line_numbers_over_many_splits(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 37) if i % 5 else "" for i in range(1, 4001)]
    (tmp_path / "a.txt").write_text("\n".join(texts) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = ln.read_lines(spark, str(tmp_path / "a.txt"))
        assert df.rdd.getNumPartitions() > 5
        got = {r["line_no"]: r["value"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(texts, start=1))


def test_line_breaks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\rthree\n\nfive".encode())
    got = {r["line_no"]: r["value"] for r in ln.read_lines(spark, str(tmp_path / "a.txt")).collect()}
    assert got == {1: "one", 2: "two", 3: "three", 4: "", 5: "five"}


def tables(lines, queries, documents, qrels):
    docs = [json.dumps({"docid": k, "doc": v}) for k, v in documents]
    return (
        parsers.parse_qrels(lines(*qrels))[0],
        parsers.parse_queries(lines(*queries))[0],
        parsers.parse_documents(lines(*docs))[0],
    )


@pytest.mark.parametrize("salted", [None, True])
def test_build_samples(lines, salted):
    made = tables(
        lines,
        ["q1\told", "q2\tDefine machine learning", "q1\tWhat is AI?"],
        [("d1", "AI was..."), ("d2", "ML is..."), ("d1", "AI is...")],
        ["q1 1 d1", "q2 0 d2", "q9 1 d1", "q1 2 d9", "q9 1 d9", "q1 1 d1"],
    )
    got = samples.build_samples(*made, salted=salted).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [
        (1, "llm-judge-2024", "q1", "What is AI?", "d1", "AI is...", 1),
        (2, "llm-judge-2024", "q2", "Define machine learning", "d2", "ML is...", 0),
        (6, "llm-judge-2024", "q1", "What is AI?", "d1", "AI is...", 1),
    ]
    counts = samples.missing_counts(*made, salted=salted)
    assert tuple(counts.first()) == (2, 1)
    assert samples.skip_message(counts).first()[0] == "Skipped 2 qrels with missing query and 1 with missing doc"


def test_nothing_missing(lines):
    made = tables(lines, ["q1\tx"], [("d1", "t")], ["q1 1 d1"])
    counts = samples.missing_counts(*made)
    assert tuple(counts.first()) == (0, 0)
    assert samples.skip_message(counts).count() == 0


def test_limits(lines):
    made = tables(lines, ["q1\tx"], [("d1", "t")], ["q1 1 d1", "q1 2 d1", "q1 3 d1"])
    built = samples.build_samples(*made)

    def gold(df):
        return [r["gold_relevance"] for r in df.orderBy("line_no").collect()]

    assert gold(samples.limit_samples(built, 2)) == [1, 2]
    assert gold(samples.limit_samples(built, 0)) == [1]
    assert gold(samples.limit_examples(built, 0)) == []
    assert gold(samples.limit_examples(built, -1)) == [1, 2]
    assert gold(samples.limit_examples(built, -5)) == []
    assert samples.ingest_summary(built).first()[0] == 3


def test_dataset_names():
    assert parsers.resolve_dataset(" LLM-Judge ") == "llm-judge-2024"
    with pytest.raises(ValueError, match="Unsupported dataset"):
        parsers.resolve_dataset("unknown")


def test_chunks(spark):
    docs = spark.createDataFrame([("a", " one two\nthree  four five "), ("b", ""), ("c", "x y")], "docid string, doc string")
    got = rows(samples.chunk_documents(docs, 3, 1), "docid", "chunk_no", "chunk")
    assert got == [("a", 0, "one two three"), ("a", 1, "three four five"), ("c", 0, "x y")]
    with pytest.raises(ValueError):
        samples.chunk_documents(docs, 3, 3)


def test_one_key_with_a_third_of_all_rows(spark):
    """Hot and null keys: the spread join equals the plain one, and the hot rows are spread."""
    k = F.when(F.col("line_no") % 3 == 0, F.lit("hot")).when(F.col("line_no") % 9 == 1, F.lit(None)).otherwise(F.col("line_no").cast("string"))
    left = spark.range(30_000).select(F.col("id").alias("line_no")).withColumn("k", k)
    right = spark.range(15_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1)], "k string, v bigint")
    )
    names = {r["h"]: r["k"] for r in left.select("k", joins.key_hash(["k"]).alias("h")).distinct().collect()}
    hot = {names[r["_hot"]]: r["_parts"] for r in joins.hot_keys(left, ["k"], min_rows=100).collect()}
    assert set(hot) == {"hot", None} and hot["hot"] > 300
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        spread = joins.lookup_join(left, right, "k", how, ["line_no"], min_rows=100, salted=True)
        assert spread.columns == plain.columns
        assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0


def test_same_result_for_any_partitioning(spark, lines):
    made = tables(
        lines, [f"q{i % 7}\ttext {i}" for i in range(40)], [(f"d{i % 11}", f"doc {i}") for i in range(60)],
        [f"q{i % 9} {i % 3} d{i % 13}" for i in range(200)],
    )
    want = None
    for n in (1, 7):
        qrels, queries, documents = (t.repartition(n) for t in made)
        for salted in (None, True):
            got = sorted(tuple(r) for r in samples.build_samples(qrels, queries, documents, salted=salted).collect())
            want = want or got
            assert got == want
    assert len(want) > 100


def test_parsed_documents_keep_their_size(spark, tmp_path):
    """What decides on a broadcast is near the size of the texts, not a small part of it."""
    words = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sha2((F.col("id") * 20 + i).cast("string"), 256))
    made = spark.range(1000).select(F.col("id").cast("string").alias("docid"), F.array_join(words, " ").alias("doc"))
    made.select((F.col("docid").cast("bigint") + 1).alias("line_no"), F.to_json(F.struct("docid", "doc")).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/lines")
    stored = spark.read.parquet(f"{tmp_path}/lines")
    good = parsers.parse_documents(stored)[0]
    assert joins.estimated_bytes(stored) > 500_000
    assert joins.estimated_bytes(good) > joins.estimated_bytes(stored) / 3
    assert good.agg(F.sum(F.length("doc"))).first()[0] == 1000 * (20 * 65 - 1)


def test_large_documents_with_repeated_and_null_lines(spark):
    """Chosen by size, the spread form takes the row that `last_wins` takes."""
    rows = [("d0", 1, "old"), ("d0", 2, "new"), ("d1", 1, "a"), ("d1", 1, "a"), ("d2", 3, "b"), ("d2", 3, "c"), ("d3", None, "n"), ("d3", None, "m"),
            ("d4", None, "z"), ("d4", -5, "y"), (None, 4, "x")]
    documents = spark.createDataFrame([(n, k, v) for k, n, v in rows], "line_no bigint, docid string, doc string")
    queries = spark.createDataFrame([(1, "q", "text")], "line_no bigint, query_id string, query_text string")
    qrels = spark.createDataFrame([(i + 1, "q", f"d{i % 6}", 1) for i in range(12)], "line_no bigint, query_id string, docid string, relevance bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = samples.build_samples(qrels, queries, documents)
        assert "_salt" in spread._jdf.queryExecution().executedPlan().toString()
        got = [(r["line_no"], r["doc"]) for r in spread.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = samples.build_samples(qrels, queries, documents, salted=False)
    assert got == [(r["line_no"], r["doc"]) for r in plain.orderBy("line_no").collect()]
    assert [v for _, v in got] == ["new", "a", "c", "n", "y"] * 2


def test_hot_query_and_document(spark, monkeypatch):
    """One query and one document hold a third of all qrels; their rows reach many tasks."""
    monkeypatch.setattr(joins, "HOT_BYTES", 100 * 4096)
    n = F.col("line_no")
    qrels = spark.range(1, 6001).select(F.col("id").alias("line_no")).select(
        n,
        F.when(n % 3 == 0, F.lit("q0")).otherwise(F.concat(F.lit("q"), (n % 700).cast("string"))).alias("query_id"),
        F.when(n % 3 == 1, F.lit("d0")).otherwise(F.concat(F.lit("d"), (n % 900).cast("string"))).alias("docid"),
        (n % 3).alias("relevance"),
    )
    keys = spark.range(1, 1201).select(F.col("id").alias("line_no"))
    queries = keys.select(n, F.concat(F.lit("q"), (n % 600).cast("string")).alias("query_id"), F.concat(F.lit("text "), n).alias("query_text"))
    documents = keys.select(n, F.concat(F.lit("d"), (n % 800).cast("string")).alias("docid"), F.concat(F.lit("doc "), n).alias("doc"))
    plain = samples.build_samples(qrels, queries, documents, salted=False)
    spread = samples.build_samples(qrels, queries, documents, salted=True)
    assert plain.count() > 4000
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0
    hot = joins.hot_keys(qrels, ["docid"], row_bytes=4096).join(qrels.select("docid", joins.key_hash(["docid"]).alias("_hot")).distinct(), "_hot")
    assert {r["docid"] for r in hot.collect()} == {"d0"}


def test_a_key_below_a_hundred_thousand_rows_is_spread(spark):
    qrels = spark.range(60_000).select(F.col("id").alias("line_no"), F.lit("q").alias("query_id"), F.lit(1).cast("bigint").alias("relevance"),
                                       F.when(F.col("id") < 50_000, "hot").otherwise(F.concat(F.lit("d"), F.col("id"))).alias("docid"))
    queries = spark.createDataFrame([("q", "text", 1)], "query_id string, query_text string, line_no bigint")
    documents = qrels.select("docid").distinct().select("docid", F.when(F.col("docid") == "hot", F.repeat(F.lit("x"), F.lit(20_000))).otherwise("y").alias("doc"),
                                                        F.xxhash64("docid").alias("line_no"))
    assert [r["_parts"] for r in joins.hot_keys(qrels, ["docid"], row_bytes=samples.TEXT_BYTES).collect()] == [834]
    plain, spread = (samples.build_samples(qrels, queries, documents, salted=s).select("line_no", "docid", F.length("doc").alias("n")) for s in (False, True))
    totals = [df.agg(F.count("*"), F.sum("n"), F.sum(F.xxhash64("line_no", "docid", "n").cast("decimal(38,0)"))).first() for df in (plain, spread)]
    assert totals[0] == totals[1] and totals[0][0] == 60_000
    sizes = joins.lookup_join(qrels, documents, "docid", spread_by=["line_no"], salted=True, row_bytes=samples.TEXT_BYTES).withColumn(
        "p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 40_000


def test_last_wins_with_repeated_and_null_orders(spark):
    from jurybox.operators.joins import last_wins

    rows = [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b1"), ("b", 2, "b2"), ("b", 2, "b2"), ("b", 2, "b0"), ("c", 1, "c1"),
            ("d", None, "d0"), ("d", None, None), (None, 3, "n"), (None, None, "m"), ("e", -1, "e"), ("e", None, "z")]
    df = spark.createDataFrame(rows, "k string, line_no bigint, v string")
    want = {("a", 2, "new"), ("b", 2, "b2"), ("c", 1, "c1"), ("d", None, "d0"), (None, 3, "n"), ("e", -1, "e")}
    for parts in (1, 5):
        got = [tuple(r) for r in last_wins(df.repartition(parts), "k").collect()]
        assert set(got) == want and len(got) == len(want)
    assert last_wins(df, ["k", "v"]).count() == 12
    plan = last_wins(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan and "partial_max" in plan


def test_lines_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ln, "FILES_AT_ONCE", 64)
    want = []
    for i in range(1000):
        lines_ = [f"{i}-{k}" for k in range(i % 4)]
        (tmp_path / f"f{i:05d} x.txt").write_text("".join(x + "\n" for x in lines_))
        want += lines_
    df = ln.read_lines(spark, str(tmp_path))
    got = [tuple(r) for r in df.orderBy("line_no").collect()]
    assert got == [(n + 1, x) for n, x in enumerate(want)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("[_path#" in line or "[_group#" in line for line in windows)
