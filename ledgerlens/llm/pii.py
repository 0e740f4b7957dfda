"""Personal data in texts (operator 4), by DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for IBANs, value ranges for addresses), and context words near a span
raise its score. Positions come from the pieces that ``split`` leaves between
the matches of ``regexp_extract_all``: both walk the same matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Repetitions are possessive, which changes no
# match here, as nothing that follows could use a character given back, and
# keeps the matcher off the stack. A proposal starts where its run starts or
# where the previous match ended, which is where the leftmost match starts.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# The patterns that the method adds.
CARD_RUN = r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9-])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])"
PHONE_GROUPS = r"\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-][0-9]{2,4}(?![0-9])){1,5}"
#: Countries by their IBANs' number of characters.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """A known country's IBAN ends where its length says, whatever follows after
    a blank; other countries' take all groups that follow."""
    known = [f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()]
    other = f"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{2,7}}(?:\\x20?[A-Z0-9]{{1,3}})?"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|{other})(?![A-Za-z0-9])"


IBAN = _iban()
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

# Context words, matched without case near a span.
EMAIL_WORDS = r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel)\b"
IP_WORDS = r"(?i)\b(?:ip|address|host|server|login|adresse)\b"
CARD_WORDS = r"(?i)\b(?:card|credit|debit|visa|mastercard|karte|carte|tarjeta|cc)\b"
PHONE_WORDS = r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|telefono|number)\b"
IBAN_WORDS = r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"
SSN_WORDS = r"(?i)\b(?:ssn|social security|social insurance|tax id)\b"

#: Characters on either side of a span in which context words count, and what
#: they add to its score.
NEAR = 48
CONTEXT_GAIN = 0.25
#: Proposals that are walked through at a time.
STEP = 256
#: A span that the method adds needs this score; base spans stay at any score.
MIN_SCORE = 0.5


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (blanks allowed) leaves 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _card_ok(hit: Column) -> Column:
    d = _digits(hit)
    return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)


def _ip_ok(hit: Column) -> Column:
    def part(p: Column) -> Column:
        return F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False))

    return F.forall(F.split(hit, r"\."), part)


def _phone_ok(hit: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


@dataclass(frozen=True)
class Kind:
    """A kind of span: what proposes it, what confirms it, and its score."""

    name: str
    pattern: str
    confirm: object
    words: str
    score: float


BASE_KINDS = (
    Kind("email", EMAIL, None, EMAIL_WORDS, 0.75),
    Kind("ip", IP, _ip_ok, IP_WORDS, 0.5),
    Kind("card", CARD, _card_ok, CARD_WORDS, 0.7),
    Kind("phone", PHONE, _phone_ok, PHONE_WORDS, 0.5),
)
ADDED_KINDS = (
    Kind("card", CARD_RUN, _card_ok, CARD_WORDS, 0.7),
    Kind("phone", PHONE_GROUPS, _phone_ok, PHONE_WORDS, 0.5),
    Kind("iban", IBAN, mod97, IBAN_WORDS, 0.75),
    Kind("ssn", SSN, None, SSN_WORDS, 0.35),
)
#: Order of kinds in joined spans.
ORDER = ("email", "ip", "card", "phone", "iban", "ssn")

_SPAN = "array<struct<rank:int,start:int,end:int,kind:string,score:double>>"


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind: code points, end exclusive, in order.

    Proposals are walked through in blocks of ``STEP``, each from place 0, and only
    confirmed ones are kept; then the blocks are moved to their places. Appending
    to one array for the whole text would copy it at every span.
    """
    pieces, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    state = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc.getField("at") + F.length(x.getField("p"))
        end = start + F.length(x.getField("h"))
        more = F.concat(acc.getField("found"), F.array(F.struct(start.alias("start"), end.alias("end"))))
        if kind.confirm is not None:
            more = F.when(kind.confirm(x.getField("h")), more).otherwise(acc.getField("found"))
        return F.struct(end.alias("at"), more.alias("found"))

    def moved(acc: Column, x: Column) -> Column:
        part = F.transform(x.getField("found"), lambda s: F.struct((s.getField("start") + acc.getField("at")).alias("start"), (s.getField("end") + acc.getField("at")).alias("end")))
        return F.struct((acc.getField("at") + x.getField("at")).alias("at"), F.concat(acc.getField("parts"), F.array(part)).alias("parts"))

    def walked(ps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ps) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.aggregate(F.slice(ps, i + 1, F.lit(STEP)), state, step))
        start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<array<struct<start:int,end:int>>>").alias("parts"))
        return F.aggregate(blocks, start, moved, lambda acc: F.flatten(acc.getField("parts")))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    found = F.element_at(F.transform(F.array(pairs), walked), 1)  # proposals are found once
    rank = ORDER.index(kind.name)

    def scored(s: Column) -> Column:
        a, b = s.getField("start"), s.getField("end")
        first = F.greatest(a - NEAR, F.lit(0))
        near = F.concat(F.substring(text, first + 1, a - first), F.lit(" "), F.substring(text, b + 1, F.lit(NEAR)))
        return F.struct(F.lit(rank).alias("rank"), a.alias("start"), b.alias("end"), F.lit(kind.name).alias("kind"),
                        (F.lit(kind.score) + F.when(near.rlike(kind.words), CONTEXT_GAIN).otherwise(0.0)).alias("score"))

    # Most texts hold no proposal: one pass of the matcher tells.
    return F.when(text.rlike(kind.pattern), F.transform(found, scored)).otherwise(F.lit([]).cast(_SPAN)).cast(_SPAN)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: the base spans and all spans of each row's text,
    each ``(rank, start, end, kind, score)`` by kind, then start.

    A null text is empty and has none. A span that the method adds stands only
    where no base span of its kind overlaps it and its score suffices. Rows are
    judged one by one: repeated rows and null ids keep their rows; other
    columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id", *[_spans(F.col("text"), k).alias(f"base_{i}") for i, k in enumerate(BASE_KINDS)],
        *[_spans(F.col("text"), k).alias(f"added_{i}") for i, k in enumerate(ADDED_KINDS)])
    same = {k.name: F.col(f"base_{i}") for i, k in enumerate(BASE_KINDS)}

    def kept(i: int, kind: Kind) -> Column:
        def stands(s: Column) -> Column:
            enough = s.getField("score") >= MIN_SCORE
            if kind.name not in same:
                return enough
            return enough & ~F.exists(same[kind.name], lambda b: (b.getField("start") < s.getField("end")) & (s.getField("start") < b.getField("end")))

        return F.filter(F.col(f"added_{i}"), stands)

    base = F.concat(*same.values())
    added = F.concat(*[kept(i, k) for i, k in enumerate(ADDED_KINDS)])
    return rows.select("doc_id", base.alias("base"), F.when(F.size(added) == 0, base).otherwise(F.array_sort(F.concat(base, added))).alias("spans"))
