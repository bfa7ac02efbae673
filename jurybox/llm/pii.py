"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is DataFrame expressions. A pattern's places come from the lengths of the
pieces between its matches: `split` gives the pieces, `regexp_extract_all` the matches.
Quantifiers are possessive and a candidate may begin only where a run begins or where
the match before ended, so every pattern is linear in the length of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
CONTEXT_CHARS = 40
MIN_SCORE = 0.5
CONTEXT_GAIN = 0.25


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\.", -1), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _card(match: Column) -> Column:
    return F.when(F.length(_digits(match)).between(16, 19), luhn(_digits(match))).otherwise(F.lit(False))


def _iban(match: Column) -> Column:
    return mod97(F.regexp_replace(match, " ", ""))


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: cheap test, pattern, validator, score and words that raise it."""

    name: str
    hint: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True


KINDS = (
    Kind("email", "@",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 0.7, r"(?i)\b(?:e-?mail|contact|write|adres\w*|correo)\b"),
    Kind("ip", r"[0-9]\.[0-9]",
         r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         _ip, 0.6, r"(?i)\b(?:ip|host|server|address|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15}",
         r"[0-9]++(?:[\x20-][0-9]++)*+",
         _card, 0.7, r"(?i)\b(?:card|credit|visa|payment|tarjeta|carte|karte)\b"),
    Kind("phone", r"\+[0-9]",
         r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: F.length(_digits(m)).between(8, 15), 0.6, r"(?i)\b(?:phone|tel|call|mobile|fax|telefon\w*)\b"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}",
         r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
         _iban, 0.7, r"(?i)\b(?:iban|account|konto|cuenta|compte|bank)\b", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"(?i)\b(?:ssn|social|security|tax)\b", base=False),
)


def running_sum(values: Column) -> Column:
    """Sums up to and including each element, over blocks: no step copies a long list."""
    n = F.size(values)

    def within(block: Column) -> Column:
        sums = F.aggregate(block, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(sums, 2, F.size(block))

    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, within)
    before = F.aggregate(F.transform(sums, lambda s: F.element_at(s, -1)), F.array(F.lit(0).cast("bigint")),
                         lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    added = F.flatten(F.zip_with(sums, F.slice(before, 1, F.size(sums)), lambda s, o: F.transform(s, lambda x: x + o)))
    return F.when(n > 0, added).otherwise(F.array().cast("array<bigint>"))


def find_spans(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Rows of `df` as struct `row`, its text as `text`, and `spans`: kind, start, end, match, score, base.

    Starts and ends are code points, the end exclusive. Spans come by kind as listed,
    then by start. Base kinds keep every match their validator accepts; the others
    need a score of MIN_SCORE, which words within CONTEXT_CHARS of the match raise.
    Null text counts as empty and has no spans. Rows are independent: repeated rows and
    ids give the same spans each; an empty table gives an empty table; columns of any
    name stay inside `row`.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), t.alias("text"))
    cut = found.select("row", "text", *[
        c for k in kinds for c in (
            F.when(F.col("text").rlike(k.hint), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).alias(f"m_{k.name}"),
            F.when(F.col("text").rlike(k.hint), F.split("text", k.pattern, -1)).alias(f"p_{k.name}"),
        )])

    def ends(k: Kind) -> Column:
        return running_sum(F.transform(
            f"m_{k.name}", lambda m, i: (F.length(F.get(f"p_{k.name}", i)) + F.length(m)).cast("bigint")))

    ended = cut.select("*", *[ends(k).alias(f"e_{k.name}") for k in kinds])

    def spans(k: Kind) -> Column:
        def span(m: Column, i: Column) -> Column:
            p, end = F.col(f"p_{k.name}"), F.get(f"e_{k.name}", i)
            near = F.concat(F.right(F.get(p, i), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(p, i + 1), F.lit(CONTEXT_CHARS)))
            score = F.lit(k.score) + F.when(near.rlike(k.words), CONTEXT_GAIN).otherwise(0.0)
            return F.struct(F.lit(k.name).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"),
                            m.alias("match"), score.alias("score"), F.lit(k.base).alias("base"))

        good = F.filter(F.transform(f"m_{k.name}", span), lambda s: k.valid(s["match"]) & (s["base"] | (s["score"] >= MIN_SCORE)))
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,match:string,score:double,base:boolean>>")
        return F.coalesce(good, none)

    return ended.select("row", "text", F.concat(*[spans(k) for k in kinds]).alias("spans"))


def listing(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`df` with each span of its text replaced by `[KIND]`; overlapping spans become one, under the first's kind (the longest of those that begin there).

    Other columns stay as they are; null text stays null.
    """
    placed = find_spans(df, text, kinds).select("row", "text", F.sort_array(F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("longest"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,longest:bigint,end:bigint,kind:string>>")

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), last["longest"].alias("longest"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < F.get(done, F.size(done) - 1)["end"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    merged = placed.select("row", "text", F.aggregate("spans", empty, join).alias("spans"))
    t, s = F.col("text"), F.col("spans")
    end = F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0))
    parts = F.transform(s, lambda x, i: F.concat(
        F.substring(t, (F.coalesce(F.get(s, i - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (x["start"] - F.coalesce(F.get(s, i - 1)["end"], F.lit(0))).cast("int")),
        F.lit("["), F.upper(x["kind"]), F.lit("]")))
    clean = F.concat(F.array_join(parts, ""), F.substring(t, (end + 1).cast("int"), F.length(t)))
    done = merged.select("row", F.when(F.size(s) > 0, clean).alias("clean"))
    return done.select(*[
        (F.coalesce("clean", F.col("row")[c]) if c == text else F.col("row")[c]).alias(c) for c in df.columns])
