"""Operator 10: personal data. DataFrame functions only: regular expressions propose spans, checksums confirm them,
context words move their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Characters of an account number by country, spaces left out (the registry of ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban_pattern() -> str:
    """Account numbers cut to their country's length, in groups of four; of other countries, as many groups as there are."""
    by_length = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n - 4, []).append(country)
    known = [rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in by_length.items()]
    other = rf"(?!{'|'.join(IBAN_LENGTHS)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}}+)?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|{other})(?![A-Za-z0-9])"


#: Fixed values. Kinds in the order in which spans of one start are listed; patterns use possessive loops, which take no
#: stack, and look-behinds, which keep them from trying every place inside a run.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried at all.
MARKS = {"email": "@", "phone": "+", "ssn": "-"}
BASE = ("email", "ip", "card", "phone")
#: Scores: what a proposal has alone, what a checksum adds, what a context word in the characters before or after it adds; the least that is reported.
ALONE = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.3}
CHECKSUM, CONTEXT, REACH, LEAST = 0.5, 0.3, 48, 0.5
#: Proposals that REACH characters can hold; the shortest has four.
NEIGHBOURS = REACH // 4 + 1
WORDS = {
    "email": r"(?i)e-?mail|contact|write to",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|master|amex|credit|payment|carte|tarjeta|karte",
    "phone": r"(?i)phone|call|mobile|\btel|fax",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)\bssn\b|social security|taxpayer",
}


def digits(x: F.Column) -> F.Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: F.Column) -> F.Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(number), "")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    value = lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: F.Column) -> F.Column:
    """Whether an account number's remainder is 1: its first four characters go last, letters count 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(F.rlike(c, F.lit("[0-9]")), 48).otherwise(55)
    fold = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), fold) == 1


def valid(kind: str, m: F.Column) -> F.Column:
    """Whether a proposal is well formed; others are dropped and not tried again."""
    if kind == "ip":
        # the number of digits first, so that a part of any length can be compared
        part = lambda p: F.rlike(p, F.lit("^0*[0-9]{1,3}$")) & (F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def let(value: F.Column, body) -> F.Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Elements of a block, as a power of two.
BLOCK = 7


def running(values: F.Column, merge) -> F.Column:
    """For each element of an array that is not empty, what merge makes of 0 and all elements before it. In blocks: first
    of the blocks before the element's own, then of the elements before it there; merging an array into itself one element
    at a time would copy it as often."""
    fold = lambda part: F.aggregate(part, F.lit(0), merge)
    size = 1 << BLOCK
    block = lambda v, k: F.slice(v, F.shiftleft(k, BLOCK) + 1, size)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, BLOCK)), lambda k: fold(block(v, k)))
    before = lambda bl: F.transform(bl, lambda _, k: fold(F.slice(bl, F.lit(1), k)))
    inside = lambda v, i: fold(F.slice(v, F.shiftleft(F.shiftright(i, BLOCK), BLOCK) + 1, i.bitwiseAND(F.lit(size - 1))))
    each = lambda v, start: F.transform(v, lambda _, i: merge(F.get(start, F.shiftright(i, BLOCK)), inside(v, i)))
    return let(values, lambda v: let(blocks(v), lambda bl: let(before(bl), lambda start: each(v, start))))


def spans_of(kind: str, found: F.Column, between: F.Column) -> F.Column:
    """Array of (start, rank, kind, end, score) of the proposals that are well formed. `between` holds what lies before,
    between and after the proposals, so running sums of lengths give the places, in time that grows with their number."""
    lengths = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.length(m) + F.length(b))
    head, tail = (lambda x: F.left(x, F.lit(REACH))), (lambda x: F.right(x, F.lit(REACH)))
    # context: what lies within REACH characters, of which so many neighbours and what is between them are enough
    ahead = lambda x: F.zip_with(F.slice(between, x["i"] + 2, NEIGHBOURS), F.slice(found, x["i"] + 2, NEIGHBOURS), lambda b, m: F.concat(head(b), head(F.coalesce(m, F.lit("")))))
    after = lambda x: head(F.array_join(ahead(x), ""))
    low = lambda x: F.greatest(F.lit(0), x["i"] - NEIGHBOURS)
    behind = lambda x: F.zip_with(F.slice(found, low(x) + 1, x["i"] - low(x)), F.slice(between, low(x) + 2, x["i"] - low(x)), lambda m, b: F.concat(tail(m), tail(b)))
    before = lambda x: tail(F.concat(tail(F.get(between, low(x))), F.array_join(behind(x), "")))
    near = lambda x: F.rlike(before(x), F.lit(WORDS[kind])) | F.rlike(after(x), F.lit(WORDS[kind]))
    sure, rank = ALONE[kind] + (CHECKSUM if kind in ("card", "iban") else 0), list(PATTERNS).index(kind)
    placed = lambda at: F.transform(found, lambda m, i: F.struct((F.get(at, i) + F.length(F.get(between, i))).alias("s"), m.alias("m"), i.alias("i")))
    span = lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), F.least(F.lit(1.0), F.lit(sure) + F.when(near(x), CONTEXT).otherwise(0.0)).alias("score"))
    return let(running(lengths, lambda a, x: a + x), lambda at: F.transform(F.filter(placed(at), lambda x: valid(kind, x["m"])), span))


SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, text (as searched) and spans: (start, rank, kind, end, score),
    in code points with the end exclusive, by start, then kind as PATTERNS lists them.

    The four base kinds stay whatever their score; IBANs need their checksum and national numbers a context word to
    reach the least score. A null text counts as empty and has no spans; repeated rows stay repeated; a null id is kept;
    an empty table gives no rows. Other columns of docs are not read. Narrow: no shuffle.
    """
    step = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], text_or_empty(text_col).alias("_text"))
    text = F.col("_text")
    all_of = lambda kind: F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    step = step.withColumns({f"_{k}": F.when(F.contains(text, F.lit(MARKS[k])), all_of(k)).otherwise(none) if k in MARKS else all_of(k) for k in PATTERNS})
    step = step.withColumns({f"_between_{k}": F.when(F.size(f"_{k}") > 0, F.split(text, PATTERNS[k], -1)) for k in PATTERNS})
    step = step.withColumns({f"_{k}": F.when(F.size(f"_{k}") > 0, spans_of(k, F.col(f"_{k}"), F.col(f"_between_{k}"))).otherwise(F.array().cast(SPANS)) for k in PATTERNS})
    more = [F.filter(f"_{k}", lambda x: x["score"] >= LEAST) if k not in BASE else F.col(f"_{k}") for k in PATTERNS]
    return step.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep if c != id_col], text.alias("text"), F.array_sort(F.concat(*more)).alias("spans"))


def joined(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: F.Column, spans: F.Column) -> F.Column:
    """The text with each span, or run of spans that overlap, replaced by its first kind in angle brackets. spans: by
    start. A span starts a run if none before it ends after its start; what lies between runs is cut from the text in
    blocks, so that no more than a block is searched for each."""
    ends = F.transform(spans, lambda x: x["end"])
    firsts = lambda reach: F.filter(F.zip_with(spans, reach, lambda x, r: F.struct(r.alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"])
    size = 1 << BLOCK
    cut = lambda part, origin, x: F.concat(F.substring(part, x["from"] - origin + 1, x["start"] - x["from"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
    piece = lambda g: let(F.substring(text, F.get(g, 0)["from"] + 1, F.element_at(g, -1)["start"] - F.get(g, 0)["from"]), lambda part: F.array_join(F.transform(g, lambda x: cut(part, F.get(g, 0)["from"], x)), ""))
    pieces = lambda runs: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(runs) - 1, BLOCK)), lambda k: let(F.slice(runs, F.shiftleft(k, BLOCK) + 1, size), piece))
    whole = let(running(ends, lambda a, x: F.greatest(a, x)), lambda reach: let(firsts(reach), lambda runs: F.concat(F.array_join(pieces(runs), ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
