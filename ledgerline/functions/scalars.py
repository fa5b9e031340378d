"""Column functions for noisy document text, amounts and names. All are built-in expressions; null in gives null out
unless a docstring says otherwise."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sequences that a wrongly decoded rupee sign or dash leaves, and what they stand for.
MOJIBAKE = [("â‚¹", " rs "), ("Ã¢â€šÂ¹", " rs "), ("|", " | "), ("â€”", "-"), ("â€“", "-")]

# Patterns of misread field words and their repair, in order.
OCR_REPAIRS = [
    (r"([:;.,\-])\1+", "$1"),
    (r"(?i)\b(qty|quantity|qnty)(\d)", "$1 $2"),
    (r"(?i)\b(price|rate|amount|tax|gst|vat)(\d)", "$1 $2"),
    (r"(?i)(\d)(qty|quantity|qnty|price|rate|amount|tax|gst|vat)\b", "$1 $2"),
    (r"(?i)\bq\s*t\s*y\b", "qty"),
    (r"(?i)\bq\s*u\s*a\s*n\s*t\s*i\s*t\s*y\b", "quantity"),
    (r"(?i)\bpr1ce\b", "price"),
    (r"(?i)\bprlce\b", "price"),
    (r"(?i)\bp\s*r\s*i\s*c\s*e\b", "price"),
    (r"(?i)\br\s*a\s*t\s*e\b", "rate"),
    (r"(?i)\bam0unt\b", "amount"),
    (r"(?i)\bqt[yv]\b", "qty"),
    (r"(?i)\b1tem\b", "item"),
    (r"[ \t]+", " "),
]

# Names that are never items by themselves.
GARBAGE_NAMES = ["i", "j", "l", "s", "o", "x", "r", "n", "oty", "oiy", "otr", "prlce", "qty", "price", "total", "subtotal", "no", "sr", "sl", "sno", "s.no"]

# How names are trimmed, in order.
NAME_STEPS = [
    (r"(?i)^(?:invoice|invoice no|invoice number|purchase order|po|po no|po number)\b[\s:#-]*[a-z0-9-]*\s*", ""),
    (r"^\d+\s+", ""),
    (r"^[\W_]+", ""),
    (r"[\W_]+$", ""),
    (r"(?i)\b(?:item|description|desc|particulars)\b\s*[:\-]?\s*", ""),
    (r"^\d+\s*[.)\-]\s*", ""),
    (r"[^\w\s\-./&]", " "),
    (r"\s+", " "),
]

# Words of summary lines.
SUMMARY_WORDS = ["cgst", "sgst", "igst", "utgst", "gst", "tax", "vat", "subtotal", "total", "rounding", "cess", "hsn", "sac", "taxable", "discount", "handling", "shipping", "freight"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _u(pattern: str) -> str:
    """Word characters, borders and white space by Unicode, as the source texts are in many languages."""
    return f"(?U){pattern}"


#: Repairs that leave a field word as it is where it is written well already, and that word.
_WELL_WRITTEN = {r"(?i)\bq\s*t\s*y\b": "qty", r"(?i)\bq\s*u\s*a\s*n\s*t\s*i\s*t\s*y\b": "quantity", r"(?i)\bp\s*r\s*i\s*c\s*e\b": "price", r"(?i)\br\s*a\s*t\s*e\b": "rate", r"(?i)\bqt[yv]\b": "qty"}


def _changing(pattern: str) -> str:
    """The pattern without the places that its repair leaves as they are."""
    word = _WELL_WRITTEN.get(pattern)
    return pattern if word is None else rf"(?!{word}\b){pattern}"


#: First letters of the field words, and what their second ones are: places that have not both need no further look.
_FIELD_STARTS = r"[qQ]\s*[tTuUnN]|[pP]\s*[rR]|[rR]\s*[aA]|[aA][mM]|[tT][aA]|[gG][sSſ]|[vV][aA]|1[tT]|(?:[0-9]|[^\x00-\x7F])[qQpPrRaAtTgGvV]"
#: Anything that a repair would change. A bar between single blanks gets blanks that go again, so that only others count.
_SPOILT = _u(
    r"[\r\t]|  |(?<! )\||\|(?! )|([:;.,\-])\1|" + "|".join(re.escape(bad) for bad, _ in MOJIBAKE if bad != "|")
    + rf"|(?={_FIELD_STARTS})(?:" + "|".join(f"(?:{_changing(p)})" for p, _ in OCR_REPAIRS[1:] if p != r"[ \t]+") + ")"
)


#: Texts in which repairs and the cleaner change nothing but the case of field words, told in one pass: letters with at most one mark behind them and plain numbers, between
#: single blanks or line ends. Not among them are words that a repair changes, pieces of field words that stand apart, and totals with a colon
#: inside a line. A bar has blanks, or an end of the text, on both sides.
_PIECES = r"(?:q(?:t|u(?:a(?:n(?:t(?:it?)?)?)?)?)?|p(?:r(?:ic?)?)?|r(?:at?)?)[ \n]"
_PLAIN_WORD = rf"(?!{_PIECES}|(?:prlce|qtv)\b)(?:(?<![^\n])total(?: amount)?:|(?!(?:total|amount):)[a-z]++[.,;:!?]?+)"
_PLAIN = rf"(?i)^(?:(?:{_PLAIN_WORD}|[0-9]++(?:\.[0-9]++)?+|(?<![^ ])\|(?![^ ]))(?:[ \n](?=[a-z0-9|])|\z))++\z"
#: White space by Unicode.
_SPACE = "".join(chr(c) for c in (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def is_plain(col: Column) -> Column:
    """A text that repairs and cleaning leave as it is, but for the case of field words; some others that they leave are not told so."""
    return col.rlike(_PLAIN)


def _cased(col: Column) -> Column:
    """A plain text with its field words as a repair writes them."""
    words, text = ("qty", "quantity", "price", "rate"), col
    for w in words:
        text = F.regexp_replace(text, rf"(?i)\b{w}\b", w)
    return F.when(col.rlike(rf"\b(?!(?:{'|'.join(words)})\b)(?i:{'|'.join(words)})\b"), text).otherwise(col)


def strip(col: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(col, F.lit(_SPACE))


def squeeze(col: Column) -> Column:
    # single blanks stay as they are
    return strip(F.regexp_replace(col, _u(r"\s{2,}|[\s&&[^ ]]"), " "))


def normalize_ocr_text(col: Column) -> Column:
    """Repair field words and separators; case and lines stay. Null gives the empty text.

    Most texts need no repair: a look for plain texts, then one for anything that a repair would change, saves the repairs.
    """
    raw = F.coalesce(col.cast("string"), F.lit(""))
    text = F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for bad, good in MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    for pattern, to in OCR_REPAIRS:
        text = F.regexp_replace(text, _u(pattern), to)
    return F.when(is_plain(raw), _cased(raw)).when(raw.rlike(_SPOILT), strip(text)).otherwise(strip(raw))


def clean_numeric_token(col: Column) -> Column:
    """Letters that stand for digits become digits, in tokens that have a digit or one of .,-%$ and no other letter."""
    t = strip(col)
    numeric = t.rlike(r"(?U)[\d.,\-%$]") & ~t.rlike(r"(?U)[\p{L}&&[^oilszgbOILSZGB]]")
    return F.when(numeric, F.translate(t, "oOiIlL|!sSzZgGbB", "0011111155229988")).otherwise(t)


def parse_number(text: Column) -> Column:
    """A number in digits, point and minus only, rounded to 2 places; null for anything else."""
    return F.round(F.when(text.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), text).try_cast("double"), 2)


def normalize_currency(col: Column) -> Column:
    """One amount. Currency marks go, misread digits are repaired, words give null."""

    def amount(t: Column) -> Column:
        usable = t.rlike(r"(?U)[\d.,\-%$]") & ~t.rlike(r"(?U)[\p{L}&&[^oilszgbOILSZGB]]")
        d = F.regexp_replace(F.translate(t, "oOiIlL|!sSzZgGbB", "0011111155229988"), r"(\d)\s*,\s*(\d)", "$1$2")
        return F.when(usable, parse_number(F.regexp_replace(d, r"[^0-9.\-]", "")))

    worked_out = let(strip(F.regexp_replace(normalize_ocr_text(col), r"(?i)(?U)\b(?:rs|inr)\.?\s*", "")), amount)
    text = col.cast("string")
    # plain digits between blanks are what all of that leaves them; without a digit or mark, or what a repair makes one of, there is no amount
    return F.when(text.rlike("^ *[0-9]+(?:\\.[0-9]+)? *$"), F.round(text.try_cast("double"), 2)).when(text.rlike(r"(?U)[\d.,\-%$âÃ]"), worked_out)


def normalize_quantity(col: Column) -> Column:
    return normalize_currency(col)


def normalize_percentage(col: Column) -> Column:
    """An amount with or without a percent sign; null if negative."""
    return let(normalize_currency(F.replace(normalize_ocr_text(col), F.lit("%"), F.lit(""))), lambda v: F.when(v >= 0, v))


def trim_name(col: Column) -> Column:
    """Item name in lower case, without document numbers, serial numbers, field words and edge punctuation.

    Words that look like field labels have to be gone already (see ``names``).
    """
    t = squeeze(F.lower(col))
    for pattern, to in NAME_STEPS:
        t = F.regexp_replace(t, _u(pattern), to)
    return t


def normalize_for_matching(col: Column) -> Column:
    """Matching key: lower case, digits that look like letters as letters, no punctuation, no residue tokens. Null gives ''."""
    t = F.translate(F.lower(F.coalesce(col, F.lit(""))), "01358", "oleso")
    t = F.regexp_replace(t, _u(r"[^a-z0-9\s]"), " ")
    t = F.regexp_replace(t, r"\b(?:j|l|i|o|0|s|oty|oiy|otr|ltem|ltems)\b", " ")
    return squeeze(t)


def safe_number(col: Column) -> Column:
    """A number from loose text: currency marks, commas and all other characters go; null if none is left."""
    t = F.regexp_replace(col, r"(?i)(?U)\b(?:rs|inr)\.?\s*", "")
    return parse_number(F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), r"[^0-9.\-]", ""))


def item_quality(col: Column) -> Column:
    """struct<score, reason>: how much a name looks like an item name, from 0 to 0.7."""
    return let(strip(F.coalesce(col, F.lit(""))), lambda s: let(F.lower(s), lambda low: _quality(col, s, low)))


def _quality(col: Column, s: Column, low: Column) -> Column:
    garbage = F.array(*(F.lit(g) for g in GARBAGE_NAMES))
    core = strip(F.rtrim(low, F.lit(".")))
    tokens = F.filter(F.split(low, r"(?U)\s+"), lambda t: t != "")

    def bad(t: Column) -> Column:
        bare = F.regexp_replace(t, "[^a-z0-9]", "")
        inner = F.when(F.length(t) > 2, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise("")
        return (F.length(bare) <= 1) | F.array_contains(garbage, bare) | inner.rlike(r"(?U)[^a-zA-Z0-9\s]")

    counts = F.struct(F.length(s).alias("n"), F.length(F.regexp_replace(s, r"(?U)\P{L}", "")).alias("alpha"), F.length(F.regexp_replace(s, r"(?U)[\p{L}\p{N}\s]", "")).alias("punct"))
    return let(counts, lambda c: _graded(col, s, low, c["n"], c["alpha"], c["punct"], F.array_contains(garbage, core), core, (F.size(tokens) > 0) & F.forall(tokens, bad)))


def _graded(col: Column, s: Column, low: Column, n: Column, alpha: Column, punct: Column, is_garbage: Column, core: Column, all_garbage: Column) -> Column:
    vowel_ok = low.rlike("[aeiou]") | ((alpha <= 3) & low.rlike(r"(?U)[\p{L}&&[^aeiou]]"))
    raw = F.round(F.least(alpha / n, F.lit(1.0)) * 0.5 - F.least(punct / n * 2.0, F.lit(1.0)) * 0.3 + F.when(vowel_ok, 1.0).otherwise(0.4) * 0.2, 4)
    fail = (
        F.when(F.coalesce(col, F.lit("")) == "", "empty")
        .when(is_garbage, F.concat(F.lit("garbage_token:'"), core, F.lit("'")))
        .when(all_garbage, "all_tokens_garbage")
        .when(s.rlike(r"([^a-zA-Z\s])\1{2,}"), "repeated_symbol")
        .when(alpha < 2, F.concat(F.lit("too_few_alpha:"), alpha))
    )

    def told(score: Column) -> Column:
        low_reason = F.when(punct / n >= 0.5, F.format_string("punct_heavy:%.2f", punct / n)).when(~vowel_ok, "no_vowel_long_word").otherwise(F.format_string("low_quality_score:%.4f", score))
        return F.struct(score.alias("score"), F.when(score < 0.30, low_reason).otherwise("ok").alias("reason"))

    good = let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), told)
    return let(fail, lambda f: F.when(f.isNotNull(), F.struct(F.lit(0.0).alias("score"), f.alias("reason"))).otherwise(good))


def is_tax_line(col: Column) -> Column:
    """A line that sums up or taxes, rather than names an item."""
    low = F.lower(col)
    words = F.split(F.regexp_replace(low, r"(?U)[^a-z0-9\s%]", " "), r"(?U)\s+")
    return F.arrays_overlap(words, F.array(*(F.lit(w) for w in SUMMARY_WORDS))) | low.rlike(r"(?U)\b(?:cgst|sgst|igst|utgst|gst|tax|vat)\b.*\b\d+")


def is_trailing_drift(a: Column, b: Column) -> Column:
    """Two amounts whose difference looks like a misread last digit or two."""
    by_base = [
        (F.rint(a / base) * base == F.rint(b / base) * base) & (F.pmod(a, F.lit(float(base))).isin(0.0, 8.0, 9.0, 98.0, 99.0) | F.pmod(b, F.lit(float(base))).isin(0.0, 8.0, 9.0, 98.0, 99.0))
        for base in (10, 100)
    ]
    return F.abs(a - b).isin(1.0, 2.0, 8.0, 9.0, 18.0, 19.0, 98.0, 99.0) | by_base[0] | by_base[1]


def difference(a: Column, b: Column) -> Column:
    return F.round(F.abs(a - b), 2)


# What the cleaner breaks and repairs, in order.
_CLEANING = [
    (r"[ \t]+", " "),
    (r"(?i)\bqty(?=\d)", "qty "),
    (r"(?i)\bprice(?=\d)", "price "),
    (r"(?i)\brate(?=\d)", "rate "),
    (r"(?i)\b(tax|gst|vat)(?=\d)", "$1 "),
    (r"(?<!\n)(\b\d+\.\s+[A-Za-z])", "\n$1"),
    (r"(?i)(?<!\n)(\b(?:total|grand total|total amount)\b\s*:)", "\n$1"),
    (r"\n{3,}", "\n\n"),
]
#: Anything that the cleaner would change; words and numbers are looked at only where their first characters stand.
_UNCLEAN = _u(
    r"\t|  |\n\n\n|(?<![0-9\n])\d(?=[\d.])(?<=(?:\b\d))\d*\.\s+[A-Za-z]|(?=[qQ][tT]|[pP][rR]|[rR][aA]|[tT][aAoO]|[gG][sSſrR]|[vV][aA])(?:" + "|".join(f"(?:{p})" for p, _ in (*_CLEANING[1:5], _CLEANING[6])) + ")"
)


def clean_ocr_text(col: Column) -> Column:
    """Repaired text with a new line before numbered rows and totals. Most texts need none: one look for all of it comes first."""

    def cleaned(text: Column) -> Column:
        t = text
        for pattern, to in _CLEANING:
            t = F.regexp_replace(t, _u(pattern), to)
        return F.when(text.rlike(_UNCLEAN), strip(t)).otherwise(text)

    return F.when(is_plain(col), _cased(col)).otherwise(let(normalize_ocr_text(col), cleaned))


def preview(col: Column, n: int = 300) -> Column:
    return F.substring(F.replace(F.coalesce(col, F.lit("")), F.lit("\n"), F.lit("\\n")), 1, n)


def entry_text(some: Column) -> Column:
    """Entries as a reader sees them: quantity x price, by semicolons; a dash for what is not known."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.array_join(F.transform(some, lambda e: F.concat(shown(e["qty"]), F.lit(" x "), shown(e["price"]))), "; ")


def safe_render(col: Column, kind: str = "string") -> Column:
    """Text for display: N/A for null, the number of items of an array, JSON of a struct, else the value. ``kind`` is the type's name."""
    shown = F.concat(F.lit("["), F.size(col), F.lit(" items]")) if kind == "array" else F.to_json(col) if kind == "struct" else col.cast("string")
    return F.when(col.isNull(), "N/A").otherwise(shown)


def parse_float_prefix(col: Column, default: float) -> Column:
    """The number that a text like '99.8%' starts with; the default if there is none or it is 0."""
    v = F.regexp_extract(col, r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return F.coalesce(F.nullif(v, F.lit(0.0)), F.lit(default))


def clean_text(col: Column) -> Column:
    """Line ends as line feeds, blanks collapsed, at most one empty line in a row. Null gives ''."""
    t = F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def split_alpha_digit(col: Column) -> Column:
    """A blank at each border of a letter and a digit."""
    return F.regexp_replace(F.regexp_replace(col, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")


def is_coordinate_payload(col: Column) -> Column:
    """Text that is only pairs of box coordinates."""
    t = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", "")
    pairs = F.regexp_count(t, F.lit(r"\[\d+(?:\.\d+)?,\d+(?:\.\d+)?\]"))
    return F.coalesce(col, F.lit("")).contains("[") & (pairs >= 2) & ~t.rlike("[A-Za-z]{2,}") & (F.regexp_count(t, F.lit(r"-?\d+(?:\.\d+)?")) >= pairs * 2)


def severity(n: Column, amount: Column) -> Column:
    """Severity of a run: none without discrepancies."""
    d = F.abs(F.coalesce(amount, F.lit(0.0)))
    return F.when(n == 0, "NONE").when((n >= 5) | (d > 5000), "HIGH").when((n >= 2) | (d > 1000), "MEDIUM").otherwise("LOW")


def risk(rate: Column) -> Column:
    return F.when(rate > 20, "HIGH").when(rate > 10, "MEDIUM").otherwise("LOW")


def discrepancy_severity(amount: Column) -> Column:
    d = F.coalesce(amount, F.lit(0.0))
    return F.when(d > 5000, "HIGH").when(d > 1000, "MEDIUM").otherwise("LOW")


def reconcile_math(qty: Column, price: Column, tax: Column, total: Column) -> Column:
    """struct<qty, price, total, swapped, reconstructed>: swap an obvious mix-up, then fill the one amount that is missing."""
    swapped = F.coalesce(total.isNull() & (qty > 200) & (price <= 200) & (qty > price), F.lit(False))
    q, p = F.when(swapped, price).otherwise(qty), F.when(swapped, qty).otherwise(price)
    factor = 1 + F.coalesce(tax, F.lit(0.0)) / 100.0

    def whole(x: Column) -> Column:
        return (F.abs(x - F.rint(x)) < 0.01) & (x > 0) & (x <= 1000)

    plain, ex_tax = F.try_divide(total, p), F.try_divide(total / factor, p)
    new_total = F.when(q.isNotNull() & p.isNotNull() & total.isNull(), F.round(q * p * factor, 2))
    new_qty = F.when(q.isNull() & (p > 0) & total.isNotNull(), F.when(whole(plain), F.rint(plain)).when(whole(ex_tax), F.rint(ex_tax)))
    new_price = F.when((q > 0) & p.isNull() & total.isNotNull(), F.round(F.try_divide(total, q) / factor, 2))
    return F.struct(
        F.coalesce(q, new_qty).alias("qty"),
        F.coalesce(p, new_price).alias("price"),
        F.coalesce(total, new_total).alias("total"),
        swapped.alias("swapped"),
        F.coalesce(new_total, new_qty, new_price).isNotNull().alias("reconstructed"),
    )
