"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float          # before context
    context: str          # words that raise the score, as a pattern
    base: bool = True
    least: float = 0.0    # spans of the method's own kinds below this score are dropped
    hint: str = ""        # a text without this pattern has no confirmed span; the pattern itself if empty


# The base kinds, as patterns for Java's engine. Possessive loops and start guards do not change what
# matches (no class meets what follows it, and a match that could start inside a run could start at the run's first
# character); they keep matching linear and free of recursion on very long runs. Of an IBAN the pattern takes the first
# four characters only and looks ahead at the longest run that may belong to it (at most 34 letters and digits); where
# it ends, iban_within tells.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write|courriel|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|adresse|direcci"),
    Kind("card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", 0.7, "card|visa|credit|payment|karte|carte|tarjeta",
         hint=r"(?:[0-9][\x20-]?){13}[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax|anruf|appel|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|konto|compte|cuenta", False, 0.5),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, "ssn|social|security|insurance", False, 0.5),
)
#: Letters and digits of an IBAN by country, as in the registry.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
#: Code points looked at on either side for context words, and what such a word adds.
NEAR, RAISE = 40, 0.2


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Doubles every second digit from the right; the sum of all digits must end in 0."""
    nth = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.floor(d.cast("int") / 5).cast("int") + (d.cast("int") * 2) % 10))
    return F.aggregate(nth, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """First four characters to the end, letters as 10 to 35; the number must leave 1 when divided by 97."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def iban_within(run: Column) -> Column:
    """The IBAN that a run of letters and digits begins with, or null.

    It ends at a space or with the run, has its country's length and leaves 1 modulo 97. A country that the registry does
    not know may have 15 to 34 letters and digits; the longest such part that passes is taken.
    """
    parts = F.split(run, " ")
    ends = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    known = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))

    def passes(part: Column) -> Column:
        n = F.length(F.regexp_replace(part, " ", ""))
        return F.coalesce(n == F.try_element_at(known, F.substring(run, 1, 2)), n >= 15) & mod97(part)

    return F.get(F.filter(ends, passes), F.lit(0))


def confirmed(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda part: F.coalesce(part.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return (n >= 14) & (n <= 19) & luhn(_digits(found))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "iban":
        return found.isNotNull()
    return F.lit(True)


def _proposed(text: Column, kind: Kind) -> Column:
    """Spans (start, end, nth, found) of one kind: running lengths of what lies between the matches and of the matches.

    Of IBANs the match is only the head, so every head gets its turn; one inside an IBAN already found is passed over.
    """
    iban = kind.name == "iban"
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), int(iban))
    if iban:
        matches = F.transform(matches, iban_within)
    between = F.transform(F.split(text, kind.pattern, -1), lambda gap: F.char_length(gap))

    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"),
                         F.array().cast("array<struct<start:int,end:int,kind:string,nth:int,found:string>>").alias("spans"))

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            end = begin + F.char_length(x["m"])
            span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind.name).alias("kind"),
                            F.lit(KINDS.index(kind)).alias("nth"), x["m"].alias("found"))
            taken = confirmed(kind.name, x["m"]) & (begin >= state["to"])
            return F.struct((begin + 4 if iban else end).alias("at"), F.when(taken, end).otherwise(state["to"]).alias("to"),
                            F.when(taken, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(lengths, start, step, lambda s: s["spans"])

    none = F.array().cast("array<struct<start:int,end:int,kind:string,nth:int,found:string>>")
    return F.when(F.regexp_like(text, F.lit(kind.hint or kind.pattern)), F.element_at(F.transform(F.array(matches), placed), 1)).otherwise(none)


def _scored(text: Column, spans: Column) -> Column:
    """Adds the score: the kind's own, raised when one of its context words stands near."""
    def one(span: Column) -> Column:
        around = F.lower(F.substring(text, F.greatest(span["start"] + 1 - NEAR, F.lit(1)), span["end"] - span["start"] + 2 * NEAR))
        score = F.lit(0.0)
        for kind in KINDS:
            near = F.when(F.regexp_like(around, F.lit(kind.context)), RAISE).otherwise(0.0)
            score = F.when(span["kind"] == kind.name, F.lit(kind.score) + near).otherwise(score)
        return F.struct(span["start"], span["nth"], span["end"], span["kind"], F.least(F.round(score, 2), F.lit(1.0)).alias("score"))

    bounds = F.array(*(F.lit(kind.least) for kind in KINDS))
    return F.array_sort(F.filter(F.transform(spans, one), lambda s: s["score"] >= F.get(bounds, s["nth"])))


def spans_of(text: Column) -> Column:
    """All confirmed spans of a text, by start and kind: array of (start, nth, end, kind, score), code points, end exclusive."""
    return _scored(text, F.concat(*(_proposed(text, kind) for kind in KINDS)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """Counts and spans of personal data in every whole text; one scan, no shuffle.

    Base kinds (email, ip, card, phone) are the four given patterns with their checks; iban (country's length, mod 97) and ssn (kept only
    with a context word near) are the method's own. Null text counts as empty. Rows are independent of each
    other, so repeated rows and ids give repeated results. Columns other than doc_id and text are not read.
    """
    base = F.filter("found", lambda s: s["nth"] < sum(k.base for k in KINDS))

    def counted(name: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    names = [kind.name for kind in KINDS]
    rows = documents.select("doc_id", spans_of(F.coalesce(F.col("text"), F.lit(""))).alias("found"))
    return rows.select("doc_id", *map(counted, names[:4]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                       _joined(F.col("found")).alias("spans"), *map(counted, names[4:]),
                       F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first one names all."""
    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= state["at"], F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
