"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A text's word k-grams are hashed; of every `window - k + 1` consecutive hashes the least
is a fingerprint. Two texts that share `window` words share all hashes of that span, so
they share its least one at the same place: every shared span is found. A hit of
fingerprints is extended to the whole span by the hashes of the k-grams that make it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import evaluated, text_key

K = 5
WINDOW = 10
MAX_BROADCAST_WINDOWS = 200_000  # about 80 bytes each: at most 16 MB are sent to executors


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case; null text has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(
        F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _starts(n: Column, width: int | Column) -> Column:
    """0 to n - width, none where the text is shorter."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, k: int) -> Column:
    return F.transform(_starts(F.size(words), k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _least(hashes: Column, start: Column, span: int) -> Column:
    """Place of the first least hash among `span` from `start` on."""
    part = F.slice(hashes, start + 1, span)
    return (start + F.array_position(part, F.array_min(part)) - 1).cast("int")


def benchmark_windows(bench: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per distinct window of an item: length n, fingerprint fp, its offset, hashes a and b, item.

    Texts of fewer words than `window`, but not none, are one window of their length;
    its fp and a are two hashes of all its words.
    """
    span = window - k + 1
    words = bench.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    hashed = words.select("item", "w", _grams(F.col("w"), k).alias("h"))
    long = hashed.where(F.size("w") >= window).select("item", F.explode(F.transform(_starts(F.size("h"), span), lambda s: F.struct(
        F.lit(window).alias("n"), F.get("h", _least(F.col("h"), s, span)).alias("fp"),
        (_least(F.col("h"), s, span) - s).alias("offset"), F.get("h", s).alias("a"), F.get("h", s + window - k).alias("b")))).alias("x"))
    short = words.where(F.size("w") < window).select("item", F.struct(
        F.size("w").alias("n"), F.xxhash64("w").alias("fp"), F.lit(0).alias("offset"),
        F.xxhash64(F.lit(1), "w").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("x"))
    return long.unionByName(short).select("item", "x.*").distinct()


def _fingerprints(words: DataFrame, lengths: list[int], k: int, window: int) -> DataFrame:
    """One row per fingerprint of a document: n, fp, place p and the k-gram hashes around it."""
    span = window - k + 1
    hashed = words.select("id", "key", "w", _grams(F.col("w"), k).alias("h"))
    parts = []
    if window in lengths:
        placed = hashed.select("id", "key", "h", F.array_distinct(F.transform(
            _starts(F.size("h"), span), lambda s: _least(F.col("h"), s, span))).alias("at"))
        parts.append(placed.select("id", "key", F.explode(F.transform("at", lambda p: F.struct(
            F.lit(window).alias("n"), F.get("h", p).alias("fp"), p.alias("p"),
            F.transform(F.sequence(F.lit(1 - span), F.lit(window - k)), lambda i: F.get("h", p + i)).alias("near")))).alias("x")))
    parts += [_short(words, n) for n in sorted(set(lengths) - {window})]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("id", "key", "x.*")


def _short(words: DataFrame, n: int) -> DataFrame:
    gram = lambda i: F.slice("w", i + 1, n)
    return words.select("id", "key", F.explode(F.transform(_starts(F.size("w"), n), lambda i: F.struct(
        F.lit(n).alias("n"), F.xxhash64(gram(i)).alias("fp"), i.alias("p"),
        F.array(F.xxhash64(F.lit(1), gram(i)), F.lit(0).cast("bigint")).alias("near")))).alias("x"))


def find_hits(
    docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", k: int = K, window: int = WINDOW,
) -> DataFrame:
    """Per contaminated document: id, key (hash of its text), covered words n_hit, sorted item ids.

    A document is known by id and text: rows that repeat both share one result. Items
    with a null id hit words but are not listed; equal item ids count once.
    """
    windows = benchmark_windows(bench, item_id, item_text, k, window)
    sizes = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # at most `window` rows
    words = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), words_of(F.col(text)).alias("w"))
    prints = _fingerprints(words, list(sizes) or [window], k, window)
    if sum(sizes.values()) <= MAX_BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    d, b = prints.alias("d"), windows.alias("b")
    middle = window - k
    first = F.when(F.col("d.n") == window, middle - F.col("b.offset")).otherwise(0)
    last = F.when(F.col("d.n") == window, 2 * middle - F.col("b.offset")).otherwise(1)
    hits = d.join(b, (F.col("d.n") == F.col("b.n")) & (F.col("d.fp") == F.col("b.fp"))
                  & (F.get("d.near", first) == F.col("b.a")) & (F.get("d.near", last) == F.col("b.b")))
    hits = hits.select("id", "key", (F.col("p") - F.col("offset")).alias("start"), F.col("d.n").alias("n"), "item")
    grouped = hits.groupBy("id", "key").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["covered"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(s["start"], a["end"]))).alias("covered"),
        F.greatest(a["end"], s["start"] + s["n"]).alias("end")))["covered"]
    return grouped.select("id", "key", covered.cast("bigint").alias("n_hit"), "items", "spans")


def mark_contaminated(
    docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", k: int = K, window: int = WINDOW,
) -> DataFrame:
    """Rows of `docs` as struct `row`, with n_words, n_hit, items, spans and contaminated (n_hit > 0).

    Null and empty texts have no words and no hits; an empty benchmark hits nothing.
    Repeated rows each get the same result; columns of any name stay inside `row`.
    """
    hits = find_hits(docs, bench, doc_id, text, item_id, item_text, k, window)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(text).alias("key"),
        F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    joined = rows.alias("r").join(hits.alias("h"), F.col(f"r.row.{doc_id}").eqNullSafe(F.col("h.id")) & (F.col("r.key") == F.col("h.key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that share no window with the benchmark, with the columns of `docs`; cases are decided as in `mark_contaminated`."""
    marked = mark_contaminated(docs, bench, doc_id, text).select("row", "contaminated")
    return evaluated(marked).where(~F.col("contaminated")).select("row.*")
