"""Personal data by patterns, checksums and context words, in DataFrame operations only.

A regular expression proposes spans of each kind; validators confirm them (octets of an address,
Luhn for cards, mod 97 for account numbers, the number of digits for phones); words close to a span
raise or lower its score. Spans count in code points and do not depend on how the table is split.

Spark gives the matches of a pattern and, by ``split``, the text between them, but not their places:
a match starts where the pieces and matches before it end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """pattern: equal to the plain pattern of the kind, written without backtracking. hint: a cheap test that no text with a match fails. score: of a confirmed span without context. near: words close by that raise it. far: that lower it."""

    name: str
    pattern: str
    hint: str
    score: float
    near: str
    far: str = r"(?i)\b(?:example|sample|test|dummy|version|order|invoice|isbn)\b"


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, r"(?i)\b(?:ip|host|server|address|login|logged)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pay)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax)\b"),
)
#: Spans that the method adds. Account numbers stand on their checksum; the others need a context word.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "", 0.8, r"(?i)\b(?:iban|account|bank|transfer)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"(?i)\b(?:ssn|social|security)\b"),
)
#: How far context reaches on each side, how much it moves a score, and the least score of an added span.
CONTEXT, SHIFT, LEAST = 40, 0.3, 0.5
#: Numbers that are summed in one fold, and code points of the pages that context is read from.
BLOCK, PAGE = 128, 512


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test: from the right, every second digit doubled, its digits added up."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    parts = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number leaves 1 modulo 97: its first four characters go to the end, letters count from 10."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).when(code >= 48, (a * 10 + code - 48) % 97).otherwise(a)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    digits = digits_of(match)
    n = F.length(digits)
    if kind.name == "ip":
        # leading zeros aside, at most 255
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255))
    if kind.name == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind.name == "phone":
        return n.between(10, 15)
    if kind.name == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod97(match)
    return F.lit(True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use needs it, lambdas included."""
    return F.get(F.transform(F.array(value), use), 0)


def running_sums(sizes: Column) -> Column:
    """The sum of each number and those before it.

    A fold copies what it has gathered at each step, so it goes by blocks: first from block to block,
    then inside each.
    """
    none = F.array().cast("array<int>")

    def sums(values: Column, start: Column, value: Callable[[Column], Column]) -> Column:
        """start, and the running sums from there on."""
        first = F.struct(start.alias("at"), none.alias("sums"))
        return F.aggregate(values, first, lambda a, x: F.struct((a["at"] + value(x)).alias("at"), F.concat(a["sums"], F.array(a["at"] + value(x))).alias("sums")), lambda a: a["sums"])

    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(sizes, at + 1, BLOCK))
    inside = lambda blocks, ends: F.flatten(F.transform(blocks, lambda block, i: sums(block, F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), lambda x: x)))
    return once(blocks, lambda b: once(sums(F.transform(b, total), F.lit(0), lambda x: x), lambda ends: inside(b, ends)))


def placed_matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern as array<struct<start, end, match>>."""
    pairs = F.arrays_zip(F.split(text, pattern).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))
    size = lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["match"]), F.lit(0))
    span = lambda end, x: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match"))
    placed = lambda pairs, ends: F.filter(F.transform(pairs, lambda x, i: span(F.get(ends, i), x)), lambda s: s["match"].isNotNull())
    return once(pairs, lambda p: once(F.transform(p, size), lambda sizes: once(running_sums(sizes), lambda ends: placed(p, ends))))


def around(pages: Column, start: Column, end: Column) -> Column:
    """Up to CONTEXT code points before start and after end, taken from the pages they lie on, so that no span scans the whole text."""
    page, last = F.floor(start / PAGE).cast("int"), F.floor(end / PAGE).cast("int")
    get = lambda i: F.coalesce(F.get(pages, i), F.lit(""))
    before, first = F.concat(get(page - 1), get(page)), F.greatest(page - 1, F.lit(0)) * PAGE
    least = F.greatest(start - CONTEXT, F.lit(0))
    return F.concat(F.substr(before, least - first + 1, start - least), F.lit(" "), F.substr(F.concat(get(last), get(last + 1)), end - last * PAGE + 1, F.lit(CONTEXT)))


def found_spans(kind: Kind, order: int, text: Column, pages: Column, added: bool) -> Column:
    """The confirmed spans of a kind as array<struct<start, end, order, kind, score>>."""
    kept = F.filter(placed_matches(text, kind.pattern), lambda s: confirmed(kind, s["match"]))

    def scored(s: Column) -> Column:
        context = around(pages, s["start"], s["end"])
        up, down = F.when(context.rlike(kind.near), SHIFT).otherwise(0.0), F.when(context.rlike(kind.far), SHIFT).otherwise(0.0)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.score) + up - down))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), F.round(score, 3).alias("score"))

    spans = F.transform(kept, scored)
    if added:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST)
    none = F.array().cast("array<struct<start:int,end:int,order:int,kind:string,score:double>>")
    hint = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    return F.when(hint & text.rlike(kind.pattern), spans).otherwise(none)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii_base and pii_added: confirmed spans by place, each with its kind and score."""
    text, pages = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col("_pii_pages")
    of = lambda kinds, first, added: F.sort_array(F.concat(*(found_spans(k, first + i, text, pages, added) for i, k in enumerate(kinds))))
    paged = docs.withColumn("_pii_pages", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), 0)))
    return paged.withColumns({"pii_base": of(BASE, 0, False), "pii_added": of(ADDED, len(BASE), True)}).drop("_pii_pages")


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("as"))))
    return F.array_join(F.transform(keyed, lambda s: s["as"]), ",")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data of every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and added ones as
    kind:start:end, joined by commas) and scored (the spans with their scores). A null text counts as
    empty: no spans, the hash of an empty string. Null ids stay null; repeated rows are searched each;
    other columns are not read; an empty table gives an empty result. Of overlapping spans of different
    kinds all stay.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_spans(slim)
    count = lambda name: F.size(F.filter("pii_base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    every = F.concat("pii_base", "pii_added")
    return out.select("doc_id", *(count(k.name) for k in BASE), F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(every).alias("spans"), F.sort_array(every).alias("scored"))
