r"""Personal data: patterns propose spans, checksums confirm them, context words score them.

DataFrame functions only, no shuffle: each text is scanned where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import table

# The patterns of the kinds. The possessive loops and the guards
# before them (not inside a run of the same characters, unless a match ended
# there) find what the plain patterns find, but in one pass over long runs.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\x20]?[=:][\x20]?[\"']?[a-z0-9+/_-]{16,200}+",
}
#: Texts without a match of this hold no match of the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "national_id": r"[0-9]-[0-9]{2}-[0-9]", "secret": r"(?i)(?:token|secret|passw(?:or)?d|key)[\x20]?[=:]"}
#: Words that raise a span's score where they stand just before it, in English, German, Spanish and French.
CONTEXT = {
    "email": r"\b(e-?mail|mail|contact|write|kontakt|correo|courriel|contacto)",
    "ip": r"\b(ip|address|host|server|client|adresse|servidor|serveur)\b",
    "card": r"\b(card|visa|credit|debit|payment|pay|karte|kredit|tarjeta|carte|zahlung|pago|paiement)",
    "phone": r"\b(phone|tel|call|mobile|fax|cell|telefon|handy|anruf|teléfono|llamar|téléphone|portable|appel)",
    "iban": r"\b(iban|account|bank|transfer|konto|cuenta|compte|überweisung|virement)",
    "national_id": r"\b(ssn|social security|national id|identity|tax|steuer|ausweis|identidad|identité|seguridad social|sécurité sociale)",
    "secret": r"\b(secret|private|credential|geheim|passwort|secreto|clave|contraseña|mot de passe)",
}
#: Score of a confirmed span without context words; those after BASE need MIN_SCORE.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3, "secret": 0.8}
BASE = ("email", "ip", "card", "phone")
CONTEXT_GAIN, CONTEXT_CHARS, MIN_SCORE = 0.4, 40, 0.6
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


#: Matches of a kind are placed in blocks of so many, so that a text's cost grows with its matches.
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column, width: int = 19) -> Column:
    """True if the digits pass; leading zeros, which add nothing, make up the width."""

    def sum_of(padded: Column) -> Column:
        total = F.lit(0)
        for i in range(1, width + 1):
            d = F.substring(padded, i, 1).cast("int")
            total = total + (d if (width - i) % 2 == 0 else (d * 2) % 10 + F.floor(d / 5).cast("int"))
        return total

    return let(F.lpad(number, width, "0"), sum_of) % 10 == 0


def mod97(iban: Column) -> Column:
    """The account number's remainder; 1 if it is right."""
    flat = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v < 10, 10).otherwise(100) + v) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(m), lambda d: F.char_length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.char_length(digits(m)).between(8, 15)
    if kind == "iban":
        return F.char_length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(m) == 1)
    if kind == "secret":  # random characters: letters and digits
        return m.rlike(r"[=:].*[A-Za-z]") & m.rlike(r"[=:].*[0-9]")
    if kind == "national_id":
        return ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    return F.lit(True)


SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind with their scores.

    The text between matches gives their places. They are added up within
    blocks of matches, and then over the blocks; a span's context is looked up
    in its block's text and what stands before it.
    """
    pattern = PATTERNS[kind]

    def blocks(s: Column) -> Column:
        n = F.size(s["m"])
        piece = lambda i: F.struct(F.get(s["gaps"], i).alias("gap"), F.get(s["m"], i).alias("m"))
        parts = F.transform(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), lambda b: F.transform(F.sequence(b, F.least(b + BLOCK, n) - 1), piece))
        return F.transform(parts, lambda p: F.struct(p.alias("parts"), F.array_join(F.transform(p, lambda x: F.concat(x["gap"], x["m"])), "").alias("text")))

    def place(acc: Column, x: Column) -> Column:
        """Adds a match to the places in its block."""
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        new = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("pos"), F.when(confirmed(kind, x["m"]), F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    def add(acc: Column, block: Column) -> Column:
        """Adds a block's spans."""
        none = F.array().cast("array<struct<start:int,end:int,m:string>>")
        found = F.aggregate(block["parts"], F.struct(F.lit(0).alias("pos"), none.alias("found")), place, lambda a: a["found"])
        before = F.char_length(acc["tail"])

        def span(s: Column, around: Column) -> Column:
            at = s["start"] + before
            left = F.substr(around, F.greatest(at - CONTEXT_CHARS, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT_CHARS)))
            score = F.least(F.lit(PRIOR[kind]) + F.when(F.lower(left).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0), F.lit(1.0))
            return F.struct(F.lit(kind).alias("kind"), (s["start"] + acc["pos"]).alias("start"), (s["end"] + acc["pos"]).alias("end"), s["m"].alias("value"), score.alias("score"))

        spans = let(F.concat(acc["tail"], block["text"]), lambda around: F.transform(found, lambda s: span(s, around)))
        kept = spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
        tail = F.right(F.concat(acc["tail"], block["text"]), F.lit(CONTEXT_CHARS))
        return F.struct((acc["pos"] + F.char_length(block["text"])).alias("pos"), tail.alias("tail"), F.concat(acc["spans"], F.array(kept)).alias("spans"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.array().cast(f"array<{SPANS}>").alias("spans"))
    some = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    matches = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    found = let(matches, lambda s: F.when(F.size(s["m"]) > 0, F.aggregate(blocks(s), zero, add, lambda a: F.flatten(a["spans"]))))
    return F.coalesce(F.when(some, found), F.array().cast(SPANS))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and pii of every row: array of (kind, start, end, value, score).

    start and end count code points, the end is exclusive. Matches are leftmost
    and don't overlap within a kind; one that fails its check is dropped without
    another try. email, ip, card and phone spans stay whatever their score;
    iban (mod 97), national_id and secret spans need MIN_SCORE, which a
    national_id reaches only with a context word in the CONTEXT_CHARS before it.

    Null or empty text gives an empty array; repeated rows give a row each. Very
    long texts are scanned whole, at a cost that grows with their length and
    matches. Only doc_id and text are read of docs. An empty table gives an
    empty one.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.concat(*[spans_of(k, F.col("text")) for k in PATTERNS]).alias("pii"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents")).drop("text")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), (F.size("pii") > 0).alias("has_pii"), F.round(F.array_max("pii.score"), 2).alias("top_score"))
