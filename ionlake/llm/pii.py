"""Personal data in texts, in DataFrame expressions only.

Each kind has a pattern that proposes spans, a validator that confirms them and words
whose presence nearby raises the score. Patterns are possessive and anchored so that a
scan is linear in the text, also over very long runs of one kind of character. The place
of a match follows from the texts between matches: ``split`` and ``regexp_extract_all``
with one pattern give pieces and matches in turn.

Kinds: email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15
digits), and, added by the validators, iban (mod-97). A span's score starts from its
kind's base, gains from a validator that few random strings pass and from context words
in the ``NEAR`` code points on both sides, up to the next match of its kind. Spans of the first four kinds are always reported;
an iban is reported from ``LEAST`` on.

Edge cases: null and empty texts have no spans; texts of any length are read whole;
matches of a kind don't overlap, those of different kinds may; repeated rows give repeated
results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR, LEAST = 40, 0.5
#: Matches that are placed together.
RUN = 128
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: kind -> pattern, the code point or string without which no match exists, base score, gain by validation, context words.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.0, "mail|contact|reach|write|schreib|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.5, 0.1, "ip|host|server|address|port|adresse"),
    "card": (r"[0-9](?:[ -]?[0-9])++", None, 0.4, 0.3, "card|visa|credit|karte|carte|tarjeta|payment"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.5, 0.1, "phone|call|tel|mobile|fax|anruf"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None, 0.3, 0.5, "iban|bank|account|konto|compte|cuenta|transfer"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """Remainder of an IBAN's number, first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda r, c: (F.when(code(c) >= 10, r * 100 + code(c)).otherwise(r * 10 + code(c)) % 97).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0).cast("int"), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": n.between(14, 19) & F.coalesce(F.call_function("luhn_check", _digits(match)), F.lit(False)),
        "phone": n.between(10, 15),
        "iban": F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(match) == 1),
    }[kind]


def proposals(kind: str, text: Column) -> Column:
    """array<struct<gap, before, match, after>> of a kind's matches: code points since the match before, and what is near on both sides."""
    pattern, needed, *_ = KINDS[kind]
    may = F.contains(text, F.lit(needed)) if needed else text.rlike("[0-9][ -]?[0-9]" if kind == "card" else "[A-Z]{2}[0-9]{2}")
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern)
    gaps = F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(NEAR)).alias("before"), F.left(p, F.lit(NEAR)).alias("after")))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g["gap"].alias("gap"), g["before"].alias("before"), m.alias("match")))
    out = F.zip_with(pairs, F.slice(gaps, 2, 1 << 30), lambda p, g: F.struct(p["gap"].alias("gap"), p["before"].alias("before"), p["match"].alias("match"), g["after"].alias("after")))
    return F.when(may, F.filter(out, lambda p: p["match"].isNotNull()))


def spans_of(kind: str, proposed: Column) -> Column:
    """array<struct<start, rank, kind, end, score>> of the confirmed spans of one kind; ``proposed`` should be a column, as it is read often."""
    _, _, base, gain, context = KINDS[kind]
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>")
    # Matches are placed run by run, so that no list of a whole text's matches is copied for each of them.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(proposed) - 1) / RUN).cast("int")), lambda k: F.slice(proposed, k * RUN + 1, RUN))
    lengths = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda n, p: n + p["gap"] + F.length(p["match"])))
    begins = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def span(start: Column, p: Column) -> Column:
        around = F.lower(F.concat(p["before"], p["match"], p["after"]))
        score = F.least(F.lit(1.0), F.lit(base + gain) + F.when(around.rlike(rf"\b(?:{context})"), F.lit(0.2)).otherwise(F.lit(0.0)))
        end = (start + F.length(p["match"])).cast("long")
        return F.struct(start.alias("start"), F.lit([*KINDS].index(kind)).cast("int").alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), score.alias("score"))

    def place(state: Column, p: Column) -> Column:
        start = (state["at"] + p["gap"]).cast("long")
        found = F.when(confirmed(kind, p["match"]), F.concat(state["found"], F.array(span(start, p)))).otherwise(state["found"])
        return F.struct((start + F.length(p["match"])).cast("long").alias("at"), found.alias("found"))

    placed = F.zip_with(runs, begins, lambda r, at: F.aggregate(F.coalesce(r, F.slice(proposed, 1, 0)), F.struct(at.alias("at"), empty.alias("found")), place)["found"])
    out = F.flatten(placed)
    if kind not in BASE:
        out = F.filter(out, lambda s: s["score"] >= LEAST)
    return F.when(F.size(proposed) > 0, out).otherwise(empty)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text and spans (start, rank, kind, end, score) by start, then kind as listed."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    near = rows.select(id_col, "text", *[proposals(kind, F.col("text")).alias(f"_{kind}") for kind in KINDS])
    found = near.select(id_col, "text", *[spans_of(kind, F.col(f"_{kind}")).alias(f"_{kind}") for kind in KINDS])
    return found.select(id_col, "text", F.sort_array(F.concat(*[f"_{kind}" for kind in KINDS])).alias("spans"))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text with every span replaced by its kind in square brackets; of overlapping spans the first counts."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>").alias("own"))

    def step(state: Column, s: Column) -> Column:
        mine = F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), F.concat(state["own"], mine).alias("own")))

    own = find(docs, id_col, text_col).select(id_col, "text", F.aggregate("spans", zero, step)["own"].alias("own"))
    parts = own.select(id_col, "text", "own", F.when(F.size("own") > 0, F.split("text", "")).alias("points"), F.concat(F.array(F.lit(0).cast("long")), F.col("own.end")).alias("after"))
    said = lambda a, b: F.array_join(F.slice("points", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")
    pieces = F.zip_with("after", "own", lambda a, s: F.when(s.isNull(), said(a, F.length("text"))).otherwise(F.concat(said(a, s["start"]), F.lit("["), s["kind"], F.lit("]"))))
    return parts.select(id_col, F.when(F.size("own") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias(text_col))


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def counts(spans: Column) -> list[Column]:
    """n_<kind> for each base kind."""
    return [F.size(of_kinds(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE]


def base_only(spans: Column) -> Column:
    return of_kinds(spans, *BASE)
