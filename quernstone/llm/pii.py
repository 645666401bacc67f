"""Personal data in whole texts, with Spark's own functions only.

Regular expressions propose spans, validators (value ranges, digit counts, Luhn, mod-97) confirm
them, and words shortly before or after a span raise its score. Spans are in code points, the end exclusive.
Kinds whose shape alone is evidence start above the threshold; others pass only with a context word.
A text is split at the matches and positions are running sums of the lengths of gaps and matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.support.names import unused

THRESHOLD = 0.5
CONTEXT_CHARACTERS = 48
CONTEXT_BONUS = 0.3
# Matches on each side that context is looked for across; with a digit and a sign each they fill its length.
CONTEXT_MATCHES = 10


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _parts_below_256(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _luhn(match: Column) -> Column:
    return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))


def _nine_to_fifteen_digits(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _mod_97(match: Column) -> Column:
    """Country and check digits last, letters as 10 to 35: the number leaves 1 when divided by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, sign: Column) -> Column:
        value = F.ascii(sign)
        return F.when(value < 58, (rest * 10 + value - 48) % 97).otherwise((rest * 100 + value - 55) % 97)

    signs = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.length(plain).between(15, 34) & (F.aggregate(signs, F.lit(0), step) == 1)


def _issued_number(match: Column) -> Column:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000."""
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """``hint`` is text that every match holds, looked for before the pattern is tried."""

    name: str
    pattern: str
    score: float
    valid: Callable[[Column], Column] | None
    context: str
    hint: str | None = None


# The shapes of the four base kinds. Loops are possessive, which cannot change a match
# where the next sign is outside the class, and a match cannot start inside a run that was tried
# from its start (or from the end of the match before), so no text takes quadratic time.
BASE_KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        None,
        "mail|contact|write",
        "@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6,
        _parts_below_256,
        "ip|host|server|address",
        ".",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, _luhn, "card|visa|credit|payment"),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.6,
        _nine_to_fifteen_digits,
        "phone|call|tel|mobile",
        "+",
    ),
)

# Characters of an account number by country, its code and check digits included.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban_pattern() -> str:
    """Groups of four, with or without a space before each, as many as the country has."""
    shapes = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        shapes.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{last}")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(shapes)})(?![A-Za-z0-9])"


MORE_KINDS = (
    Kind(
        "iban",
        _iban_pattern(),
        0.6,
        _mod_97,
        "iban|account|bank",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        0.3,
        _issued_number,
        "ssn|social|security",
        "-",
    ),
)
KINDS = BASE_KINDS + MORE_KINDS

_SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running ``combine`` over an array of numbers (not empty), by doubling the reach."""

    def step(done: Column, k: Column) -> Column:
        reach = F.lit(1).cast("int") * F.pow(F.lit(2), k).cast("int")
        moved = F.concat(
            F.array_repeat(F.lit(None).cast("bigint"), F.least(reach, F.size(done))),
            F.slice(done, 1, F.greatest(F.size(done) - reach, F.lit(0))),
        )
        merged = F.zip_with(done, moved, lambda a, b: F.when(b.isNull(), a).otherwise(combine(b, a)))
        return F.when(F.size(done) > reach, merged).otherwise(done)

    return F.aggregate(F.sequence(F.lit(0), F.lit(29)), values, step)


def _spans(text: Column, kind: Kind) -> Column:
    """All confirmed matches of a kind, leftmost first, none overlapping another of the kind."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    nothing = F.array().cast(f"array<{_SPAN}>")
    near = F.lit(CONTEXT_CHARACTERS)

    def place(found: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        steps = F.transform(both, lambda x: (F.length(x["gap"]) + F.length(x["match"])).cast("bigint"))
        placed = F.zip_with(
            both, _scan(steps, lambda a, b: a + b), lambda x, p: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), p.alias("end"))
        )
        # The ends of the text between two matches are all that context can reach into.
        before = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.concat(F.right(g, near), m))
        after = F.zip_with(found, F.slice(gaps, 2, F.size(found)), lambda m, g: F.concat(m, F.left(g, near)))
        sides = F.array(F.struct(before.alias("before"), after.alias("after"), gaps.alias("gaps")))
        numbered = F.transform(placed, lambda x, i: F.struct(x["match"].alias("match"), x["end"].alias("end"), (i + 1).alias("i")))
        if kind.valid is not None:
            numbered = F.filter(numbered, lambda x: kind.valid(x["match"]))
        words = rf"(?i)\b(?:{kind.context})"

        def score(side: Column, i: Column) -> Column:
            first = F.greatest(i - CONTEXT_MATCHES, F.lit(1))
            left = F.concat(F.array_join(F.slice(side["before"], first, i - first), ""), F.element_at(side["gaps"], i))
            here = F.left(F.element_at(side["gaps"], i + 1), near)
            right = F.concat(here, F.array_join(F.slice(side["after"], i + 1, F.lit(CONTEXT_MATCHES)), ""))
            met = F.right(left, near).rlike(words) | F.left(right, near).rlike(words)
            return F.lit(kind.score) + F.when(met, CONTEXT_BONUS).otherwise(0.0)

        def spans(side: Column) -> Column:
            return F.transform(
                numbered,
                lambda x: F.struct(
                    F.lit(kind.name).alias("kind"),
                    (x["end"] - F.length(x["match"])).alias("start"),
                    x["end"].alias("end"),
                    score(side, x["i"]).alias("score"),
                ),
            )

        # A one-element transform names the sides, so that they are cut once.
        return F.transform(sides, spans)[0]

    # A one-element transform names the matches, so that they are found once.
    located = F.transform(F.array(matches), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(nothing))[0]
    if kind.hint is not None:
        located = F.when(F.contains(text, F.lit(kind.hint)), located).otherwise(nothing)
    return located.cast(f"array<{_SPAN}>")


def find(
    docs: DataFrame,
    text_column: str = "text",
    kinds: tuple[Kind, ...] = KINDS,
    threshold: float = THRESHOLD,
    into: str = "spans",
) -> DataFrame:
    """``docs`` with a column ``into``: (kind, start, end, score) by kind as listed, then by start.

    A null or empty text has an empty array, an empty table no rows; a text is read whole, however long. Matches that a validator refuses are dropped and not
    tried again from a later place. Equal rows give equal spans; other columns are kept, but one named
    ``into`` is replaced.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    every = F.concat(*[_spans(text, kind) for kind in kinds])
    return docs.withColumn(into, F.filter(every, lambda x: x["score"] >= threshold))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


def counted(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of a table with spans."""
    names = [k.name for k in BASE_KINDS]
    base = F.filter("spans", lambda x: x["kind"].isin(names))

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *map(count, names),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in brackets; overlapping spans by one,
    the kind of the first and then longest.

    Texts without a span, null ones among them, stay as they are.
    """
    spans, until = unused(docs.columns, "_spans", "_reach")
    found = find(docs, into=spans, **options)
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], -x["end"], x["end"], x["kind"])))
    found = found.withColumn(spans, ordered)
    reach = _scan(F.transform(spans, lambda x: x["end"]), F.greatest)
    found = found.withColumn(until, F.when(F.size(spans) > 0, reach))
    text = F.col("text")

    def piece(span: Column, i: Column) -> Column:
        # The text between all spans before and this one; nothing if this one starts inside them.
        done = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(until, F.greatest(i, F.lit(1))))
        between = F.substring(text, (done + 1).cast("int"), (span["start"] - done).cast("int"))
        return F.when(span["start"] < done, F.lit("")).otherwise(
            F.concat(between, F.lit("["), F.upper(span["kind"]), F.lit("]"))
        )

    rest = F.substring(text, (F.element_at(until, -1) + 1).cast("int"), F.length(text))
    masked = F.concat(F.array_join(F.transform(spans, piece), ""), rest)
    return found.withColumn("text", F.when(F.size(spans) > 0, masked).otherwise(text)).select(docs.columns)
