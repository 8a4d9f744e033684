"""Personal data by patterns, checksum validators and context words, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# The base patterns. Each is written so that a search takes time in proportion to the text:
# a match never starts inside a run whose start has failed already (or right after a match), and runs are not given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The added patterns.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(F.reverse(number), i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check: the first four characters go last, letters count from 10."""
    compact = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, "(?!^|$)"), F.lit(0), add) == 1


def octets(match: Column) -> Column:
    """Whether each part of a dotted number is at most 255, leading zeros aside."""
    return F.forall(F.split(match, r"\."), lambda part: bind(F.ltrim(part, F.lit("0")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, what a text must have for a search to be worth while, its validator
    (null: none), the score of a match, what a passed check and a context word nearby add, and the words.
    A match counts when it reaches THRESHOLD; a failed check drops it."""

    name: str
    pattern: str
    needs: str
    check: object = None
    score: float = 0.5
    checked: float = 0.4
    context: tuple[str, ...] = ()
    near: float = 0.4


THRESHOLD = 0.5
BLOCK = 256
WINDOW = 40  # code points of the text looked at on each side of a match for context words

KINDS = (
    Kind("email", EMAIL, "@"),
    Kind("ip", IP, ".", octets, 0.1),
    Kind("card", CARD, "", lambda m: bind(digits(m), lambda d: F.length(d).between(13, 19) & luhn(d)), 0.1, context=("card", "visa", "credit", "mastercard")),
    Kind("phone", PHONE, "+", lambda m: F.length(digits(m)).between(9, 15), 0.1, context=("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", IBAN, "", mod97, 0.2, context=("iban", "account", "konto", "compte", "cuenta")),
    Kind("secret", SECRET, "", None, 0.2, context=("token", "secret", "key", "password", "passwd", "pwd", "api", "apikey", "credential")),
    Kind("ssn", SSN, "-", None, 0.2, context=("ssn", "social security", "tax id", "insurance")),
)
BASE = ("email", "ip", "card", "phone")


def spans_of(text: Column, kind: Kind) -> Column:
    """Spans (kind, start, end, score) of one kind: leftmost, not overlapping, in code points, end exclusive.

    The pieces between matches and the matches have known lengths, which add up to the places. Context words are looked
    for on both sides, other matches included: the ends of at most WINDOW pieces and matches make up a side, so that
    a text of very many matches costs no square of them.
    """
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def joined(a: Column, b: Column, cut) -> Column:
        """The strings of a and b in turn, each cut to what a window can need of it."""
        return F.array_join(F.zip_with(a, b, lambda x, y: F.concat(cut(x, F.lit(WINDOW + 1)), cut(y, F.lit(WINDOW + 1)))), "")

    def near(pieces: Column, matches: Column, i: Column) -> Column:
        """Whether a context word stands in the window on the left or on the right of match i."""
        first, n = F.greatest(i - WINDOW - 1, F.lit(0)), F.greatest(F.least(F.size(matches) - 1 - i, F.lit(WINDOW + 1)), F.lit(0))
        left = F.concat(joined(F.slice(pieces, first + 1, i - first), F.slice(matches, first + 1, i - first), F.right), F.right(F.get(pieces, i), F.lit(WINDOW + 1)))
        right = F.concat(F.left(F.get(pieces, i + 1), F.lit(WINDOW + 1)), joined(F.slice(matches, i + 2, n), F.slice(pieces, i + 3, n), F.left))
        # a word that the window cuts is no context, nor is a part of a longer word: each side is taken with one more code point
        longer = F.lit(WINDOW + 1)
        left = bind(F.right(left, longer), lambda t: F.when(F.length(t) > WINDOW, F.regexp_replace(t, r"^[^\p{L}]|^\p{L}+", "")).otherwise(t))
        right = bind(F.left(right, longer), lambda t: F.when(F.length(t) > WINDOW, F.regexp_replace(t, r"(?:[^\p{L}]|\p{L}+)$", "")).otherwise(t))
        return F.exists(F.array(left, right), lambda side: F.regexp_like(side, F.lit(rf"(?i)(?<!\p{{L}})(?:{'|'.join(kind.context)})s?(?!\p{{L}})")))

    def located(pieces: Column, matches: Column) -> Column:
        state = lambda at: F.struct(at.alias("at"), empty.alias("found"))

        def step(acc: Column, i: Column) -> Column:
            piece, match = F.get(pieces, i), F.get(matches, i)
            start = acc["at"] + F.length(piece)
            end = start + F.length(match)
            score = F.lit(kind.score)
            good = F.lit(True)
            if kind.check is not None:
                good = F.coalesce(kind.check(match), F.lit(False))
                score = score + kind.checked
            if kind.context:
                score = score + F.when(near(pieces, matches, i), F.lit(kind.near)).otherwise(F.lit(0.0))

            def spans(total: Column) -> Column:
                span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), F.least(total, F.lit(1.0)).alias("score"))
                return F.when(total >= THRESHOLD, F.array(span)).otherwise(empty)

            # the windows are made for matches that pass their check only
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], bind(score, spans))).otherwise(acc["found"]).alias("found"))

        # matches are taken in blocks, so that a growing array is copied once a block
        def block(acc: Column, b: Column) -> Column:
            inside = F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(matches)) - 1)
            return F.aggregate(inside, state(acc["at"]), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["found"], x["found"]).alias("found")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, state(F.lit(0)), block, lambda acc: acc["found"])

    found = bind(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(bind(F.split(text, kind.pattern, -1), lambda p: located(p, m))))
    worth = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(worth & text.rlike(kind.pattern), found).otherwise(empty)


def find(docs: DataFrame, *, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with the column `out`: all spans (kind, start, end, score), by kind as in KINDS and then by start.

    A null or empty text has none. Every row is treated by itself, so repeated rows give repeated results. A column named `out`
    must not be there yet.
    """
    if out.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {out} already")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumn(out, F.concat(*[spans_of(text, kind) for kind in KINDS]))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; of overlapping spans the union is replaced, named
    by the first. A null text stays null; n_chars_col, where there is such a column, is counted anew. Other columns stay as they are,
    whatever their names."""
    out = "pii_spans"
    while out.lower() in map(str.lower, docs.columns):
        out += "_"
    found = find(docs, text_col=text_col, out=out)
    text = F.col(f"`{text_col}`")

    def rebuild(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            out = F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))

    by_start = F.sort_array(F.transform(F.col(out), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["end"].alias("end"), s["kind"].alias("kind"))))
    new = F.when(F.size(out) == 0, text).otherwise(bind(by_start, lambda spans: rebuild(text, spans)))
    clean = found.withColumn(text_col, new).drop(out)
    if n_chars_col and n_chars_col in docs.columns:
        clean = clean.withColumn(n_chars_col, F.length(text).cast(docs.schema[n_chars_col].dataType))
    return clean
