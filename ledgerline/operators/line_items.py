"""Line items from noisy document text: candidate lines, three ways to read a line, diagnostics and totals.

Documents have doc_id and text. All of a document's work stays in its row until its lines are taken apart, so only the removal of
duplicate rows and the diagnostics shuffle, by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import has_no_labels, without_labels
from ..functions.scalars import SUMMARY_WORDS, clean_ocr_text, is_coordinate_payload, is_plain, is_tax_line, let, normalize_currency, normalize_ocr_text, normalize_percentage, reconcile_math, squeeze, strip, trim_name
from ..sources.tables import many_tasks, written

QUANTITY_MAX = 1000.0
#: From so many rows on a line may be hot; places over which a hot one is spread.
HOT_ROWS, HOT_PARTS = 10_000, 32

# Patterns of field words, heading words and totals.
KEYWORDS = r"(?=[qQpPrRaAtTgGvV])(?i)(?U)\b(?:qty|quantity|qnty|price|rate|amount|tax|gst|vat|total)\b"
HEADINGS = r"(?=[iIıİpPvVdDbBsSſgGtThH])(?i)(?U)\b(invoice|purchase\s*order|po\s*number|vendor|date|bill to|ship to|subtotal|grand total|total amount|hsn|sac)\b"
TOTAL_LED = r"(?i)(?U)^(?:total|grand total|total amount)\b"
SPLITTERS = r"(?i)\s*;\s*|\s*[;,]\s*(?:[| \-_]*)(?=(?:item|nem|wem)\b)"
FIELDS = {
    "qty": r"(?i)(?U)\b(?:qty|quantity|qnty)\s*[:=\-]?\s*([0-9][0-9., ]*)",
    "price": r"(?i)(?U)\b(?:price|rate|unit\s*price|amount)\s*[:=\-]?\s*((?:rs\.?\s*)?[0-9][0-9, .]*)",
    "tax": r"(?i)(?U)\b(?:tax|gst|vat)\s*[:=\-]?\s*([0-9][0-9., ]*\s*%?)",
    "total": r"(?i)(?U)\b(?:total|line\s*total|amount)\s*[:=\-]?\s*((?:rs\.?\s*)?[0-9][0-9, .]*)",
}
DOCUMENT_TOTALS = r"(?i)(?U)\b(?:grand total|total amount|invoice total|net amount|subtotal)\b\s*[:=\-]?\s*(?:rs\.?\s*)?[0-9][0-9, .]*"
NUMBER = r"(?i)(?U)(?<![A-Za-z])(?:rs\.?\s*)?[0-9oilszgb]+(?:[.,][0-9oilszgb]+)?\s*%?"
AMOUNT_WORDS = r"(?i)(?U)\b(?:qty|quantity|qnty|price|rate|amount)\b\s*[:=\-]?\s*"
HEADER_FIELDS = ("item", "qty", "price", "total", "hsn", "taxable", "gst")
HEADER_WORDS = ["item", "description", "particulars", "qty", "quantity", "price", "rate", "total", "amount", "hsn", "sac"]

# Rows that are plain from end to end: a name of lower-case words, and amounts behind it, behind their labels, or in the cells of a table.
PLAIN_NUMBER, PLAIN_NAME = r"[0-9]++(?:\.[0-9]++)?+", r"[a-z]++(?: (?!qty |[0-9])[a-z]++)*+"
PLAIN_ROWS = {
    "labeled": rf"^{PLAIN_NAME} qty {PLAIN_NUMBER} price {PLAIN_NUMBER}\z",
    "trailing_numeric": rf"^{PLAIN_NAME} {PLAIN_NUMBER} {PLAIN_NUMBER} {PLAIN_NUMBER}\z",
    "columnar": rf"^[0-9]++ \| {PLAIN_NAME} \| {PLAIN_NUMBER} \| {PLAIN_NUMBER} \| {PLAIN_NUMBER}\z",
}
#: What may mean more than a name, in any word or as one.
NOT_PLAIN = "qty|quantity|qnty|price|rate|amount|tax|gst|vat|total|\\b(?:rs|inr|invoice|purchase|po|item|description|desc|particulars|" + "|".join(SUMMARY_WORDS) + ")\\b"

ITEM = "struct<item:string,qty:double,price:double,tax:double,total:double,swapped:boolean,reconstructed:boolean,confidence:double,parse_strategy:string>"


def candidate_texts(text: Column) -> Column:
    """The lines of a document: what stands before the first 'items:' is left out, and rows joined by semicolons are taken apart."""
    # most texts have no such word: they are looked at once
    behind = lambda c: F.when(c.rlike(r"(?i)(?U)items?\s*:"), F.regexp_replace(c, r"(?is)(?U)^.*?\bitems?\s*:", "")).otherwise(c)
    t = let(clean_ocr_text(text), behind)

    def parts(line: Column) -> Column:
        some = F.filter(F.transform(F.split(line, SPLITTERS), strip), lambda p: p.rlike("[A-Za-z0-9]"))
        return F.when((line.contains(";") | line.contains(",")) & line.rlike(SPLITTERS), let(some, lambda x: F.when(F.size(x) > 1, x).otherwise(F.array(line)))).otherwise(F.array(line))

    return F.flatten(F.transform(F.transform(F.split(t, "\n"), strip), parts))


def merge_lines(lines: Column) -> Column:
    """Join lines that continue the one before; a fold over the lines of one document.

    Each line is looked at once: what the fold asks of the lines joined so far follows from their marks. Only a heading of two words may
    stand on both sides of a joint, so that the words at the joint are looked at as well. Lines have no white space at their ends.
    """
    numbers = lambda x: F.regexp_count(x, F.lit(r"\d+(?:\.\d+)?"))
    goes_on = r"(?i)(?U)^(?:[-:|]|qty|price|rate|tax|gst|vat|total)\b"
    word = lambda x, k: F.substring_index(x, " ", k)

    def marked(x: Column) -> Column:
        marks = {"letter": x.rlike("[A-Za-z]"), "n": numbers(x), "field": x.rlike(KEYWORDS), "heading": x.rlike(HEADINGS), "total": x.rlike(TOTAL_LED), "more": x.rlike(goes_on), "first": word(x, 1), "last": word(x, -1)}
        return F.struct(x.alias("text"), *(c.alias(k) for k, c in marks.items()))

    held = ("letter", "n", "field", "heading", "last")

    def state(out: Column, buf: Column, marks: dict[str, Column]) -> Column:
        return F.struct(buf.alias("buf"), *(marks[k].alias(k) for k in held), out.alias("out"))

    def step(s: Column, line: Column) -> Column:
        buf, text = s["buf"], line["text"]
        flushed = F.when(buf != "", F.array_append(s["out"], buf)).otherwise(s["out"])
        none = {"letter": F.lit(False), "n": F.lit(0), "field": F.lit(False), "heading": F.lit(False), "last": F.lit("")}
        alone = {k: line[k] for k in held}
        both = {k: s[k] | line[k] for k in ("letter", "field")} | {"n": s["n"] + line["n"], "last": line["last"]}
        both["heading"] = s["heading"] | line["heading"] | F.concat(s["last"], F.lit(" "), line["first"]).rlike(HEADINGS)
        complete = lambda x: x["letter"] & (x["n"] >= 2)
        restart = (s["heading"] & line["field"]) | (complete(s) & complete(line))
        return (
            F.when(text == "", state(flushed, F.lit(""), none))
            .when(line["total"], state(F.array_append(flushed, text), F.lit(""), none))
            .when((buf == "") | restart | (s["field"] & ~line["more"]), state(flushed, text, alone))
            .otherwise(state(s["out"], F.concat(buf, F.lit(" "), text), both))
        )

    start = F.expr("named_struct('buf', '', 'letter', false, 'n', 0, 'field', false, 'heading', false, 'last', '', 'out', cast(array() as array<string>))")
    return F.aggregate(F.transform(lines, marked), start, step, lambda s: F.when(s["buf"] != "", F.array_append(s["out"], s["buf"])).otherwise(s["out"]))


def is_candidate(line: Column) -> Column:
    """A line that may hold an item."""
    heading = line.rlike(HEADINGS) & ~line.rlike(r"(?i)(?U)\b(?:qty|price|rate)\b")
    likely = line.rlike(KEYWORDS) | (line.contains("|") & line.rlike(r"\d")) | (line.rlike("[A-Za-z]") & (F.regexp_count(line, F.lit(r"\d+(?:\.\d+)?")) >= 2))
    return ~line.rlike(TOTAL_LED) & ~heading & likely


def header_map(text: Column) -> Column:
    """struct<item, qty, price, total, hsn, taxable, gst> of column numbers from 0, from the first table heading; null without one."""
    words = F.array(*(F.lit(w) for w in HEADER_WORDS))

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, r"\|"), lambda p: F.lower(strip(p)))

    def field(p: Column) -> Column:
        has = lambda *ws: p.rlike("|".join(ws))
        return (
            F.when(p == "", None)
            .when(has("item", "desc", "particulars"), "item")
            .when(has("qty", "quantity", "qnty"), "qty")
            .when(has("price", "rate"), F.when(~has("total", "taxable"), "price"))
            .when(has("total", "amount"), F.when(~has("taxable"), "total"))
            .when(has("hsn", "sac"), "hsn")
            .when(has("taxable"), "taxable")
            .when(has("gst"), "gst")
        )

    def places(named: Column) -> Column:
        last = lambda f: F.array_max(F.transform(named, lambda x, i: F.when(x == f, i)))
        return F.named_struct(*(x for f in HEADER_FIELDS for x in (F.lit(f), last(f))))

    likely = lambda x: x.contains("|") & x.rlike("(?i)" + "|".join(HEADER_WORDS))
    heads = F.filter(F.transform(F.filter(F.split(text, "\n"), likely), cells), lambda c: F.arrays_overlap(c, words))
    return let(F.transform(F.get(heads, F.lit(0)), field), lambda named: F.when(named.isNotNull(), places(named)))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw, cleaned, header) of the candidate lines, and ``confidence`` if the documents have it."""
    extra = ["confidence"] if "confidence" in docs.columns else []
    usable = docs.where(F.col("text").isNotNull() & (strip(F.col("text")) != "") & ~is_coordinate_payload(F.col("text")))
    # lines are chosen inside the array, and no filter is inferred from an outer explode: the cleaning is done once
    lines = F.transform(merge_lines(candidate_texts(F.col("text"))), lambda raw, i: F.named_struct(F.lit("line_no"), i, F.lit("raw"), raw, F.lit("cleaned"), clean_ocr_text(raw)))
    chosen = F.filter(lines, lambda x: is_candidate(x["cleaned"]))
    out = usable.select("doc_id", *extra, header_map(F.col("text")).alias("header"), F.explode_outer(chosen).alias("x"))
    return out.where("x is not null").select("doc_id", *extra, "header", "x.*")


def _mark(pieces: Column, gaps: Column, raw: Column, i: Column) -> Column:
    """What is at mark ``i``. A piece is a gap and the mark behind it, so 16 characters reach over 16 pieces at most."""
    near = lambda first, n: F.array_join(F.slice(pieces, first, n), "")
    left = F.lower(F.right(F.concat(near(F.greatest(i - 15, F.lit(1)), F.least(i, F.lit(16))), F.get(gaps, i)), F.lit(16)))
    right = F.lower(F.substring(near(i + 2, F.lit(16)), 1, 16))
    percent = lambda x: raw.contains("%") | F.concat(x, F.lower(strip(raw)), right).rlike("tax|gst|vat")
    value = F.when(raw.rlike("[0-9.,%]"), normalize_currency(raw))
    # what stands around a mark is asked of amounts only
    around = lambda v: let(F.when(v.isNotNull(), left), lambda x: F.struct(i.alias("i"), raw.alias("raw"), v.alias("value"), x.alias("left"), F.when(v.isNotNull(), percent(x)).alias("is_percent")))
    return let(value, around)


def line_marks(line: Column) -> Column:
    """struct<gaps, marks, pieces>: the line cut at all that may be a number; a gap stands before each mark and after the last one.

    A mark has its text, its value (null if it is no amount), and for amounts up to 16 characters to its left and whether it is a percentage.
    """
    cut = F.struct(F.split(line, NUMBER, -1).alias("gaps"), F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)).alias("texts"))

    def marks(c: Column) -> Column:
        gaps, texts = c["gaps"], c["texts"]
        pieces = F.zip_with(gaps, texts, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        return let(pieces, lambda p: F.struct(gaps.alias("gaps"), F.transform(texts, lambda m, i: _mark(p, gaps, m, i)).alias("marks"), p.alias("pieces")))

    return let(cut, marks)


def numeric_tokens(line: Column) -> Column:
    """The marks of a line that are amounts."""
    return F.filter(line_marks(line)["marks"], lambda t: t["value"].isNotNull())


def _whole(v: Column) -> Column:
    """A number that may count rows."""
    return F.coalesce((v == F.rint(v)) & (v > 0) & (v <= 200), F.lit(False))


def assign_roles(tokens: Column, head: Column) -> Column:
    """struct<qty, price, tax, total> from the numeric tokens of a line and what stands before its first mark: labels first, then places."""

    def first(cond) -> Column:
        return F.get(F.filter(tokens, cond), F.lit(0))["value"]

    def labelled(words: str) -> Column:
        return first(lambda t: t["left"].rlike(words))

    lead = F.get(tokens, F.lit(0))
    serial = (F.size(tokens) >= 3) & (lead["i"] == 0) & ~head.rlike("[A-Za-z0-9]") & _whole(lead["value"])
    rest = let(F.coalesce(serial, F.lit(False)), lambda s: F.transform(F.filter(tokens, lambda t, i: ~t["is_percent"] & ~(s & (i == 0))), lambda t: t["value"]))
    fits = lambda a: F.get(F.filter(a, lambda v: v <= QUANTITY_MAX), F.lit(0))
    but_last = lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))

    def qty(v: Column) -> Column:
        return F.coalesce(labelled("qty|quantity|qnty"), fits(but_last(v)), fits(v), F.when(F.size(v) == 1, F.get(v, F.lit(0))))

    def price(v: Column, q: Column) -> Column:
        n = F.size(v)
        open_ = F.filter(F.when(n >= 3, but_last(v)).otherwise(v), lambda x: q.isNull() | (x != q))
        by_place = let(open_, lambda o: F.when(F.size(o) > 0, F.get(o, F.size(o) - 1)).when(n >= 2, F.get(v, n - 2)).when((n > 0) & q.isNull(), F.get(v, F.lit(0))))
        return F.coalesce(labelled("price|rate|amount"), by_place)

    tax = F.coalesce(first(lambda t: t["is_percent"] | t["left"].rlike("tax|gst|vat")), first(lambda t: (t["value"] <= 100) & t["is_percent"]))
    total = lambda v: F.when(F.size(v) >= 3, F.get(v, F.size(v) - 1))
    return let(rest, lambda v: let(qty(v), lambda q: F.struct(q.alias("qty"), price(v, q).alias("price"), tax.alias("tax"), total(v).alias("total"))))


def with_marks(lines: DataFrame) -> DataFrame:
    """Add what the readers share: marks, tokens, roles and words."""
    out = lines.withColumn("m", line_marks(F.col("cleaned"))).withColumn("words", F.split(strip(F.col("cleaned")), r"(?U)\s+"))
    out = out.withColumn("tokens", F.filter("m.marks", lambda t: t["value"].isNotNull()))
    return out.withColumn("roles", assign_roles(F.col("tokens"), F.get("m.gaps", F.lit(0))))


def with_cells(lines: DataFrame) -> DataFrame:
    """Add the cells of a table row: ``cells`` as they stand, ``flat`` without empty ones and with joined amounts apart, ``numbers`` of
    these, ``skip`` (1 behind a serial number), and ``head``: the amounts under the heading's columns."""

    def spread(p: Column) -> Column:
        return let(F.split(p, r"(?U)\s+"), lambda t: F.when((F.size(t) >= 2) & F.forall(t, lambda x: normalize_currency(x).isNotNull()), t).otherwise(F.array(p)))

    def flat(cells: Column) -> Column:
        return let(F.filter(cells, lambda p: p != ""), lambda some: F.when(F.size(some) >= 2, F.flatten(F.transform(some, spread))))

    out = lines.withColumn("cells", F.transform(F.split("cleaned", r"\|"), strip)).withColumn("flat", flat(F.col("cells")))
    out = out.withColumn("numbers", F.transform("flat", normalize_currency))
    serial = (F.size("flat") >= 3) & F.get("numbers", F.lit(1)).isNull() & _whole(F.get("numbers", F.lit(0)))
    widest = F.greatest(*(F.coalesce(F.col(f"header.{f}"), F.lit(-1)) for f in HEADER_FIELDS))
    mapped = F.col("header.item").isNotNull() & F.coalesce("header.qty", "header.price", "header.total").isNotNull() & (F.size("cells") > widest)
    at = lambda f: F.when(mapped, F.get(F.col("cells"), F.col(f"header.{f}")))
    head = let(F.struct(at("item").alias("item"), *(F.when(at(f).isNotNull(), normalize_currency(at(f))).alias(f) for f in ("qty", "price", "total"))), lambda h: h)
    return out.withColumn("skip", F.when(F.coalesce(serial, F.lit(False)), 1).otherwise(0)).withColumn("head", head)


def _name_texts() -> Column:
    """The texts that may name a line's item: without its amounts; the heading's cell; the first cell; without anything like a
    number; before its last two amounts."""
    line, m, tokens = F.col("cleaned"), F.col("m"), F.col("tokens")
    bare = F.zip_with(m["gaps"], m["marks"], lambda g, t: F.concat(g, F.when(t["value"].isNotNull() & ~t["is_percent"], " ").otherwise(F.coalesce(t["raw"], F.lit("")))))
    no_amounts = squeeze(F.regexp_replace(F.array_join(bare, ""), AMOUNT_WORDS, " "))
    two = F.size(tokens) >= 2
    plain = F.filter(tokens, lambda t: ~t["is_percent"])
    pivot = let(plain, lambda p: F.when(F.size(p) >= 2, F.get(p, F.size(p) - 2)["i"]).otherwise(F.get(tokens, F.lit(0))["i"]))
    left = F.when(two, let(pivot, lambda i: F.concat(F.array_join(F.slice(m["pieces"], F.lit(1), i), ""), F.get(m["gaps"], i))))
    return F.array(no_amounts, F.col("head.item"), F.get("flat", F.col("skip")), F.when(two, F.regexp_replace(line, NUMBER, " ")), left)


def _label_name(words: Column, flags: Column) -> Column:
    """The name before the first label behind it: the first run of words that are no labels, up to a field word."""

    def run(first: Column) -> Column:
        rest = lambda x: F.slice(x, F.greatest(first, F.lit(1)), F.size(x))
        n = lambda stop: F.when(stop > 0, stop - 1).otherwise(F.size(words))
        return F.when(first > 0, let(F.array_position(rest(flags), True).cast("int"), lambda stop: F.slice(rest(words), F.lit(1), n(stop))))

    text = F.coalesce(F.array_join(let(F.array_position(flags, False).cast("int"), run), " "), F.col("cleaned"))
    return trim_name(normalize_ocr_text(F.replace(F.get(F.split(text, KEYWORDS, 2), F.lit(0)), F.lit("|"), F.lit(" "))))


def _candidates() -> list[Column]:
    """What each reader makes of a line, in the order in which they count: by the heading's columns, by place in a table row, by
    labels, and by a name with trailing amounts. Null where a reader has nothing."""
    # a name is trimmed where a reader asks for it
    name = lambda k: F.coalesce(trim_name(F.get("told.texts", F.lit(k))), F.lit(""))
    null = F.lit(None).cast("double")
    v = F.filter(F.slice("numbers", F.col("skip") + 2, F.greatest(F.size("numbers") - F.col("skip") - 1, F.lit(0))), lambda x: x.isNotNull())

    def made(own: Column, qty: Column, price: Column, tax: Column, total: Column, confidence: Column, strategy: str, ok: Column) -> Column:
        stated = F.coalesce(qty, price, tax, total).isNotNull() if strategy != "trailing_numeric" else F.size("tokens") >= 2
        c = lambda n: F.struct(
            F.coalesce(F.nullif(name(0), F.lit("")), n).alias("item"), F.coalesce(qty, "roles.qty").alias("qty"), F.coalesce(price, "roles.price").alias("price"),
            F.coalesce(tax, "roles.tax").alias("tax"), F.coalesce(total, "roles.total").alias("total"), confidence.alias("confidence"), F.lit(strategy).alias("parse_strategy"),
        )
        return F.when(F.coalesce(ok & stated, F.lit(False)), let(own, lambda n: F.when(n != "", c(n))))

    def by_place(v: Column) -> Column:
        third = F.get(v, F.lit(2))
        is_tax = (third >= 0) & (third <= 100)
        total = F.coalesce(F.get(v, F.lit(3)), F.when(~is_tax, third))
        return made(name(2), F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.when(is_tax, third), total, F.lit(0.95), "columnar", F.size(v) > 0)

    def by_label(x: Column) -> Column:
        n = sum(F.when(x[f].isNotNull(), 1).otherwise(0) for f in FIELDS)
        return made(F.coalesce(_label_name(F.col("words"), F.col("told.flags")), F.lit("")), x["qty"], x["price"], x["tax"], x["total"], F.when(n >= 2, 0.9).otherwise(0.78), "labeled", F.lit(True))

    found = {f: F.nullif(F.regexp_extract("cleaned", p, 1), F.lit("")) for f, p in FIELDS.items()}
    stated = F.struct(*(F.when(c.isNotNull(), (normalize_percentage if f == "tax" else normalize_currency)(c)).alias(f) for f, c in found.items()))
    head = made(name(1), F.col("head.qty"), F.col("head.price"), null, F.col("head.total"), F.lit(0.98), "columnar", F.lit(True))
    trailing_name = F.coalesce(F.nullif(name(0), F.lit("")), F.nullif(name(3), F.lit("")), name(4))
    trailing = made(trailing_name, null, null, null, null, null, "trailing_numeric", F.lit(True))
    return [head, let(v, by_place), let(stated, by_label), trailing]


def with_plain_rows(lines: DataFrame) -> DataFrame:
    """Add ``plain``: what the readers make of a row that is plain from end to end; null for any other line, which they have to look at.

    A name without labels, field words and misread words is what every reader leaves of it, and each amount has one role only: behind its
    label, in order behind the name, or under the heading of a table of number, item, quantity, price and total.
    """
    line, h = F.col("cleaned"), F.col("header")
    heads = (h["item"] == 1) & (h["qty"] == 2) & (h["price"] == 3) & (h["total"] == 4) & F.coalesce(h["hsn"], h["taxable"], h["gst"]).isNull()
    kind = F.when(h.isNull(), F.when(line.rlike(PLAIN_ROWS["labeled"]), "labeled").when(line.rlike(PLAIN_ROWS["trailing_numeric"]), "trailing_numeric")).when(heads & line.rlike(PLAIN_ROWS["columnar"]), "columnar")
    out = lines.withColumn("kind", F.when(is_plain(line), kind))
    of = lambda labeled, trailing, columnar: F.when(F.col("kind") == "labeled", labeled).when(F.col("kind") == "trailing_numeric", trailing).when(F.col("kind") == "columnar", columnar)
    word = lambda k: F.substring_index(F.substring_index(line, " ", k), " ", 1)
    before = F.substring(line, F.lit(1), F.length(line) - F.length(F.substring_index(line, " ", -3)) - 1)
    name = of(F.substring_index(line, " qty ", 1), before, F.substring_index(F.substring_index(line, " | ", 2), " | ", -1))
    out = out.withColumn("name", name).withColumn("name", F.when(~F.col("name").rlike(NOT_PLAIN), F.col("name")))
    amount = lambda *texts: F.round(of(*texts).cast("double"), 2)
    none = F.lit(None).cast("string")
    out = out.withColumns({"qty": amount(word(-3), word(-3), word(-5)), "price": amount(word(-1), word(-2), word(-3)), "total": amount(none, word(-1), word(-1)), "free": has_no_labels(F.col("name"))})
    # the first amount that may be a quantity is one, where no label or heading tells
    usable = F.col("free") & ((F.col("kind") != "trailing_numeric") | (F.col("qty") <= QUANTITY_MAX))
    sure = F.when(F.col("kind") == "labeled", 0.9).when(F.col("kind") == "columnar", 0.98)
    made = F.struct(F.col("name").alias("item"), "qty", "price", F.lit(None).cast("double").alias("tax"), "total", sure.alias("confidence"), F.col("kind").alias("parse_strategy"))
    return out.select(*lines.columns, F.when(usable, made).alias("plain"))


def _finalized(c: Column, checked: bool = False) -> Column:
    """A reader's item with its amounts made consistent; null for summary lines, unless that is checked, and where no amount is left."""

    def item(m: Column) -> Column:
        amounts = (m["qty"], m["price"], c["tax"], m["total"])
        n = sum(F.when(x.isNotNull(), 1).otherwise(0) for x in amounts)
        sure = F.coalesce(c["confidence"], F.when(n >= 2, 0.72).otherwise(0.62))
        made = F.struct(c["item"], m["qty"], m["price"], c["tax"], m["total"], m["swapped"], m["reconstructed"], sure, c["parse_strategy"]).cast(ITEM)
        return F.when(F.coalesce(*amounts).isNotNull(), made)

    kept = c.isNotNull() if checked else c.isNotNull() & ~F.col("summary") & ~is_tax_line(c["item"])
    return F.when(kept, let(reconcile_math(c["qty"], c["price"], c["tax"], c["total"]), item))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``parsed``, from the first reader that gives an item, and ``reason`` where none does.

    With a document confidence, an item's is the mean of both. Each step is a column that is computed once: values that are
    used several times are bound by ``let``, so that the plan stays as small as it reads.
    """
    out = with_cells(with_marks(lines)).withColumn("summary", is_tax_line(F.col("cleaned")))
    out = out.withColumn("told", without_labels(F.col("words"), _name_texts()))
    # a reader is asked only where those before it have nothing
    parsed = F.coalesce(*(let(c, lambda x: _finalized(x)) for c in _candidates()))
    parsed = _with_document(parsed, lines)
    # what no reader makes an item of, none has left a quantity or price of either
    hints = F.col("cleaned").rlike(KEYWORDS) | F.col("cleaned").contains("|")
    reason = (
        F.when(strip(F.col("cleaned")) == "", "no rows found")
        .when(_label_name(F.col("words"), F.col("told.flags")) == "", "regex mismatch")
        .when((F.size("tokens") < 2) & ~hints, "regex mismatch")
        .when(hints | (F.size("tokens") > 0), "qty missing")
        .otherwise("regex mismatch")
    )
    both = let(parsed, lambda p: F.struct(p.alias("parsed"), F.when(p.isNull(), reason).alias("reason")))
    # behind an explode, as filters on what was read would else be pushed down, with all that leads to it repeated in each
    return out.select("doc_id", "line_no", "raw", "cleaned", F.explode_outer(F.array(both)).alias("x")).select("doc_id", "line_no", "raw", "cleaned", "x.parsed", "x.reason")


def _with_document(parsed: Column, lines: DataFrame) -> Column:
    """``parsed`` with the mean of its and its document's confidence, if the lines carry that."""
    if "confidence" not in lines.columns:
        return parsed
    return let(parsed, lambda p: F.when(p.isNotNull(), p.withField("confidence", F.coalesce(F.round((p["confidence"] + F.col("confidence")) / 2, 4), p["confidence"]))))


def parse_distinct(lines: DataFrame) -> DataFrame:
    """``parse_lines`` by a dictionary: each distinct line under each distinct heading is parsed once, and lines find theirs by both. Plain rows
    are told apart before, so that the readers look at the others only.

    ``lines`` should be a written table, as it is read for the dictionary and for the join. A line that more than one row in a thousand has
    (headings, footers of a form) is spread over HOT_PARTS places in the join; there are fewer than a thousand such lines at any size.
    """
    # a hash of a struct passes over nulls: headings with the same places under other fields have to differ
    places = (F.coalesce(F.col(f"header.{f}"), F.lit(-1)) for f in HEADER_FIELDS)
    key = F.xxhash64("cleaned", F.col("header").isNull(), *places).alias("key")
    # dealt over a number of tasks that is said, as parsing is long for the few bytes of a line
    many = many_tasks(lines.sparkSession)
    known = written(with_plain_rows(lines.groupBy("cleaned", "header").agg(F.count("*").alias("n")).repartition(many, "cleaned", "header")).withColumn("key", key), "distinct-lines")
    rest = known.where("plain is null").repartition(many, "cleaned", "header")
    parsed = parse_lines(rest.select(F.struct("key", "n").alias("doc_id"), F.lit(0).alias("line_no"), F.col("cleaned").alias("raw"), "cleaned", "header"))
    plain = known.where("plain is not null").select("key", "n", "cleaned", let(F.col("plain"), lambda c: _finalized(c, checked=True)).alias("parsed"), F.lit(None).cast("string").alias("reason"))
    found = written(plain.unionByName(parsed.select("doc_id.key", "doc_id.n", "cleaned", "parsed", "reason")), "line-dictionary")
    least = max(HOT_ROWS, lines.count() // 1_000)
    hot = [r.key for r in found.where(F.col("n") > least).select("key").distinct().collect()]
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    spread = F.when(is_hot, F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(HOT_PARTS))).otherwise(0)
    every = F.when(is_hot, F.array(*(F.lit(k).cast("long") for k in range(HOT_PARTS)))).otherwise(F.array(F.lit(0).cast("long")))
    left = lines.withColumn("key", key).withColumn("place", spread.cast("long"))
    right = found.withColumn("place", F.explode(every)).select("key", "place", "cleaned", "parsed", "reason")
    both = left.join(right, ["key", "place", "cleaned"])
    return both.select("doc_id", "line_no", "raw", "cleaned", _with_document(F.col("parsed"), lines).alias("parsed"), "reason")


def dedup_items(rows: DataFrame) -> DataFrame:
    """Mark rows of a document that repeat an item with the same amounts (nulls equal): the first stays, the others get a reason."""
    w = Window.partitionBy("doc_id", "parsed.item", "parsed.qty", "parsed.price", "parsed.tax", "parsed.total").orderBy("line_no")
    again = F.col("parsed").isNotNull() & (F.row_number().over(w) > 1)
    return rows.withColumn("again", again).withColumn("reason", F.when(F.col("again"), "duplicate_row").otherwise(F.col("reason"))).withColumn("parsed", F.when(~F.col("again"), F.col("parsed"))).drop("again")


def items_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("parsed").isNotNull()).select("doc_id", "line_no", "parsed.*")


def skipped_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("parsed").isNull()).select("doc_id", "line_no", "raw", "cleaned", "reason")


def _per_document(rows: DataFrame, *more: Column) -> DataFrame:
    counts = (F.count("*").alias("candidates"), F.count("parsed").alias("items"), F.avg("parsed.confidence").alias("mean"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return rows.groupBy("doc_id").agg(*counts, *more)


def _diagnosed(docs: DataFrame, per: DataFrame, *more: str) -> DataFrame:
    j = docs.join(per, "doc_id", "left")
    n, c = F.coalesce("items", F.lit(0)), F.coalesce("candidates", F.lit(0))
    score = F.when(n > 0, F.round(F.col("mean") * 0.7 + F.try_divide(n, c) * 0.3, 4)).otherwise(0.0)
    only = F.when((F.size("reasons") == 1) & F.get("reasons", F.lit(0)).isin("regex mismatch", "qty missing", "price missing"), F.get("reasons", F.lit(0))).otherwise("all rows skipped")
    failure = F.when(F.col("is_payload"), "coordinate_payload_detected").when(c == 0, "no rows found").when(n == 0, only)
    return j.select("doc_id", c.alias("candidates"), n.alias("items"), (c - n).alias("skipped"), score.alias("score"), failure.alias("failure_reason"), *more)


def _headers(docs: DataFrame, *more: Column) -> DataFrame:
    payload = is_coordinate_payload(F.col("text")) if "text" in docs.columns else F.lit(False)
    return docs.select("doc_id", payload.alias("is_payload"), *more)


def doc_diagnostics(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts, score and failure reason of every document. ``docs`` with a text tells coordinate payloads apart."""
    return _diagnosed(_headers(docs), _per_document(rows))


def stated_totals(text: Column) -> Column:
    """Array of struct<label, value> of the totals that a text states, in their order; the last of a label counts."""

    def total(m: Column) -> Column:
        label = F.regexp_replace(F.lower(strip(F.element_at(F.split(F.element_at(F.split(m, ":"), 1), "-"), 1))), r"(?U)\s+", "_")
        return F.struct(label.alias("label"), normalize_currency(F.regexp_extract(m, r"(?i)((?:rs\.?\s*)?[0-9][0-9, .]*)$", 1)).alias("value"))

    known = F.filter(F.transform(F.regexp_extract_all(text, F.lit(DOCUMENT_TOTALS), F.lit(0)), total), lambda x: x["value"].isNotNull())
    return let(known, lambda k: F.filter(k, lambda x, i: ~F.exists(F.slice(k, i + 2, F.size(k)), lambda y: y["label"] == x["label"])))


def extract_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, label, value) of the totals that a document states; the last of a label counts."""
    return docs.select("doc_id", F.explode(stated_totals(F.col("text"))).alias("t")).select("doc_id", "t.label", "t.value")


def structured_documents(docs: DataFrame, dictionary: bool = False) -> DataFrame:
    """One row for each document: its items in order, totals, skipped rows, diagnostics, and whether anything was found.

    Lines are parsed once, with ``dictionary`` each distinct one once, which writes them first; their rows are dealt by doc_id once, for the
    repeated rows and for the lists of a document.
    """
    lines = split_lines(docs)
    parsed = parse_distinct(written(lines, "lines")) if dictionary else parse_lines(lines)
    rows = dedup_items(parsed.repartition("doc_id"))
    item = F.when(F.col("parsed").isNotNull(), F.struct("line_no", *(f"parsed.{f}" for f in ("item", "qty", "price", "tax", "total", "confidence", "parse_strategy", "swapped", "reconstructed"))))
    skipped = F.when(F.col("parsed").isNull(), F.struct("line_no", "raw", "cleaned", "reason"))
    some = lambda c: F.when(F.size(c) > 0, F.array_sort(c))
    per = _per_document(rows, some(F.collect_list(item)).alias("line_items"), some(F.collect_list(skipped)).alias("skipped_rows"))
    totals = let(stated_totals(F.col("text")), lambda t: F.when(F.size(t) > 0, F.map_from_entries(t)))
    out = _diagnosed(_headers(docs, totals.alias("totals")), per, "line_items", "skipped_rows", "totals")
    return out.withColumn("parse_success", F.col("line_items").isNotNull() | F.col("totals").isNotNull())


def to_structured_json(structured: DataFrame, keep: bool = False) -> DataFrame:
    """The structured document as one JSON text; with ``keep`` beside its columns."""
    names = ["line_items", "totals", "skipped_rows", "score", "failure_reason"]
    text = F.to_json(F.struct(*names)).alias("structured_json")
    return structured.select("*", text) if keep else structured.select("doc_id", text)
