"""Items from semi-structured model responses: doc_id, raw_response and ocr_text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import item_quality, let, safe_number, strip

MIN_ITEM_QUALITY, MIN_OCR_CONFIDENCE, MAX_PROMPT_CHARS = 0.30, 0.45, 4_000
META = ["document_type", "invoice_number", "vendor", "date"]

PROMPT_HEAD = "Read the document below and answer with one JSON object with document_type, invoice_number, vendor, date and items (each with item, qty and price).\n---\n"
PROMPT_TAIL = "\n---"


def build_prompts(docs: DataFrame, max_chars: int = MAX_PROMPT_CHARS) -> DataFrame:
    """doc_id and prompt: the first characters of the text in a fixed frame. The cut is what a model takes at once."""
    return docs.select("doc_id", F.concat(F.lit(PROMPT_HEAD), F.substring(F.coalesce("text", F.lit("")), 1, max_chars), F.lit(PROMPT_TAIL)).alias("prompt"))


def strip_fences(col: Column) -> Column:
    """Without the code fence around a response."""
    return strip(F.regexp_replace(F.regexp_replace(strip(col), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def parse_response(responses: DataFrame) -> DataFrame:
    """Add metadata, raw_items (one JSON value each; null if items is no list), error and metadata_ok.

    The whole text counts, else its outermost braces, else its outermost brackets as the list of items. Metadata that is
    there but no text makes metadata_ok false: the document falls back to the parser.
    """
    valid = lambda c, kind: F.try_parse_json(c).isNotNull() & F.startswith(strip(c), F.lit(kind))

    def listed(text: Column) -> Column:
        return let(F.regexp_extract(text, r"(?s)\[.*\]", 0), lambda x: F.when((x != "") & valid(x, "["), F.concat(F.lit('{"items":'), x, F.lit("}"))))

    def chosen(text: Column) -> Column:
        braced = let(F.regexp_extract(text, r"(?s)\{.*\}", 0), lambda x: F.when(x != "", F.when(valid(x, "{"), x)).otherwise(listed(text)))
        return F.when(F.try_parse_json(text).isNotNull(), F.when(F.startswith(text, F.lit("{")), text)).otherwise(braced)

    def read(payload: Column) -> Column:
        value = lambda k: F.get_json_object(payload, f"$.{k}")
        items = let(value("items"), lambda x: F.when(F.startswith(strip(x), F.lit("[")), F.from_json(x, "array<string>")))
        no_text = lambda fields: sum(F.when(F.map_contains_key(fields, k) & fields[k].isNull(), 1).otherwise(0) for k in META[1:])
        ok = let(F.from_json(payload, "map<string,string>"), lambda fields: F.coalesce(no_text(fields) == 0, F.lit(True)))
        error = F.when(payload.isNull(), "no JSON object in response")
        return F.struct(*(F.coalesce(value(k), F.lit("")).alias(k) for k in META), items.alias("raw_items"), ok.alias("metadata_ok"), error.alias("error"))

    names = [*META, "raw_items", "metadata_ok", "error"]
    made = let(let(strip_fences(F.coalesce("raw_response", F.lit(""))), chosen), read)
    # behind an explode, as a filter on any of it would else be pushed down, with all that leads to it repeated at each of its uses
    return responses.withColumn("response", F.explode_outer(F.array(made))).withColumns({k: F.col(f"response.{k}") for k in names}).drop("response")


def _entry(j: Column) -> Column:
    """item, qty and price of an entry as texts; null for what is no object."""
    get = lambda k: F.get_json_object(j, f"$.{k}")
    return F.when(F.startswith(strip(j), F.lit("{")), F.struct(get("item").alias("item"), get("qty").alias("qty"), get("price").alias("price")))


def raw_entries(parsed: DataFrame) -> DataFrame:
    """(doc_id, pos, item, qty, price) of the entries that are objects, amounts as texts."""
    # an outer explode: no filter on the list is inferred from it, which would read each response once more
    rows = parsed.select("doc_id", F.posexplode_outer(F.transform("raw_items", lambda j: _entry(j))).alias("pos", "e")).where("e is not null")
    return rows.select("doc_id", "pos", "e.item", "e.qty", "e.price")


def _checked(item: Column, qty: Column, price: Column) -> Column:
    return let(strip(item), lambda x: F.struct(x.alias("item"), qty.alias("qty"), price.alias("price"), item_quality(x)["score"].alias("score")))


def _is_good(e: Column) -> Column:
    return (e["item"] != "") & (e["qty"] > 0) & (e["price"] >= 0) & (e["score"] >= MIN_ITEM_QUALITY)


def validate_items(entries: DataFrame, confidences: DataFrame | None = None) -> DataFrame:
    """Entries with a good name, a positive quantity and a price that is not negative; of equal ones the first.

    ``confidences`` (doc_id, name, confidence) may name what the recognition was unsure of.
    """
    number = lambda c: safe_number(F.col(c)) if dict(entries.dtypes)[c] == "string" else F.round(F.col(c).cast("double"), 2)
    others = [c for c in entries.columns if c not in ("item", "qty", "price")]
    cleaned = _checked(F.col("item"), number("qty"), number("price"))
    # one pass over each entry, behind an explode as in parse_response
    out = entries.select(*others, F.explode_outer(F.array(cleaned)).alias("e")).where(_is_good(F.col("e"))).select(*others, "e.*").select(*entries.columns)
    if confidences is not None:
        out = gate_ocr_conf(out, confidences)
    w = Window.partitionBy("doc_id", F.lower("item"), "qty", "price").orderBy("pos")
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def gate_ocr_conf(items: DataFrame, confidences: DataFrame) -> DataFrame:
    """Without items whose name was recognized with too little confidence; unknown names stay."""
    c = confidences.select("doc_id", F.lower("name").alias("name"), F.col("confidence").alias("name_confidence"))
    j = items.withColumn("name", F.lower("item")).join(c, ["doc_id", "name"], "left")
    return j.where(F.col("name_confidence").isNull() | (F.col("name_confidence") >= MIN_OCR_CONFIDENCE)).drop("name", "name_confidence")


def score_extraction(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Confidence of each document's items: their number, the metadata present, and the share of names found in the text.

    ``docs``: doc_id, ocr_text, n_meta (0 to 3).
    """
    low, name = F.lower("ocr_text"), F.lower("item")
    grounded = F.contains(low, name) | F.exists(F.split(name, r"(?U)\s+"), lambda w: (F.length(w) > 2) & F.contains(low, w))
    per = items.join(docs.select("doc_id", "ocr_text"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.when(grounded, 1.0).otherwise(0.0)).alias("g"))
    score = F.round(F.least(F.col("n") / F.greatest(F.col("n"), F.lit(5)), F.lit(1.0)) * 0.4 + F.col("n_meta") / 3.0 * 0.2 + F.col("g") * 0.4, 4)
    return docs.join(per, "doc_id", "left").select("doc_id", F.coalesce(score, F.lit(0.0)).alias("confidence"))


def select_source(model: DataFrame, parsed: DataFrame, docs: DataFrame) -> DataFrame:
    """Items of the model where a document has any, else those of the parser; mode and fallback_used of each document.

    ``docs``: doc_id, text. Gives (doc_id, mode, fallback_used, item, qty, price); a document without items has one row with null item.
    """
    cols = ["doc_id", "item", "qty", "price"]
    both = model.select(*cols, F.lit(True).alias("is_model")).unionByName(parsed.select(*cols, F.lit(False).alias("is_model")))
    # the model's rows are read once: where a document has any, its others go
    best = F.max("is_model").over(Window.partitionBy("doc_id"))
    items = both.withColumn("best", best).where("is_model = best").select(*cols, F.when(F.col("is_model"), "model").otherwise("regex_fallback").alias("mode"))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    mode = F.when(empty, "empty_input").otherwise(F.coalesce("mode", F.lit("failed")))
    j = docs.select("doc_id", "text").join(items, "doc_id", "left")
    return j.select("doc_id", mode.alias("mode"), (mode != "model").alias("fallback_used"), *(F.when(~empty, F.col(c)).alias(c) for c in cols[1:]))


def used_fallback(parsed: DataFrame) -> DataFrame:
    """doc_id and whether ``select_source`` would take no item of the model, worked out on each parsed response with its text, without its items' rows.

    ``parsed``: one row for each document, doc_id, raw_items and text.
    """
    good = lambda e: let(_checked(e["item"], safe_number(e["qty"]), safe_number(e["price"])), lambda x: _is_good(x))
    some = F.exists("raw_items", lambda j: let(_entry(j), lambda e: F.when(e.isNotNull(), good(e))))
    return parsed.select("doc_id", ((F.trim(F.coalesce("text", F.lit(""))) == "") | ~F.coalesce(some, F.lit(False))).alias("fallback_used"))


def deviation(model: DataFrame, parsed: DataFrame) -> DataFrame:
    """Whether model and parser differ in an amount of a name both have; of a name's rows the last counts."""
    last = lambda df, p: df.groupBy("doc_id", F.lower("item").alias("name")).agg(F.max_by(F.struct("qty", "price"), "pos").alias(p))
    j = last(model, "m").join(last(parsed, "p"), ["doc_id", "name"])
    differs = ~(F.col("m.qty").eqNullSafe(F.col("p.qty")) & F.col("m.price").eqNullSafe(F.col("p.price")))
    return j.groupBy("doc_id").agg(F.bool_or(differs).alias("has_deviation"))
