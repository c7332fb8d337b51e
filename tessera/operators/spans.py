"""Quotes and where they lie: spans of one text in another, and the checks a claim must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import carries, squash


def find_span(text: Column, quote: Column) -> Column:
    """start, end (0-based, null: not found) and how a text holds a quote: exact; squashed, its white space made single; or flexible, any white space for white space."""
    tight = squash(quote)
    exact = F.call_function("locate", quote, text)
    squashed = F.call_function("locate", tight, text)
    # the quote as a pattern: every special sign escaped, runs of white space made flexible
    pattern = F.regexp_replace(F.regexp_replace(tight, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), " ", r"\\s+")
    whole = F.concat(F.lit("(?s)^(.*?)("), pattern, F.lit(")"))
    before, held = (F.length(F.call_function("regexp_extract", text, whole, F.lit(k))) for k in (1, 2))
    how = F.when(F.length(tight) == 0, None).when(exact > 0, "exact").when(squashed > 0, "squashed").when(F.regexp_like(text, pattern), "flexible")
    start = F.when(how == "exact", exact - 1).when(how == "squashed", squashed - 1).when(how == "flexible", before)
    size = F.when(how == "exact", F.length(quote)).when(how == "squashed", F.length(tight)).when(how == "flexible", held)
    return F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"), how.alias("how"))


def on_token_boundary(text: Column, start: Column, end: Column) -> Column:
    """No letter, digit or underscore lies on both sides of either end."""
    at = lambda k: F.substring(text, k, F.lit(1))
    word = lambda c: c.rlike(r"^[\p{L}\p{N}_]$")
    left = (start > 0) & word(at(start)) & word(at(start + 1))
    right = word(at(end)) & word(at(end + 1))
    return ~left & ~right


def verified_claims(
    drafts: DataFrame, documents: DataFrame, permitted: DataFrame, *, declared: DataFrame | None = None, forms: DataFrame | None = None, vocabulary: DataFrame | None = None, stop: list[str] | None = None
) -> DataFrame:
    """draft, reason, start, end, column: the first reason that holds, else verified.

    Reasons: field_not_permitted (on no document), field_not_permitted_for_doc, unknown_document, span_not_found,
    quote_is_a_typed_column (it lies wholly inside a span that the record declares; column is its name), not_entailed (the quote
    carries neither the value nor another form of it), not_in_vocabulary (the field has one, and the value carries none of it).

    drafts: draft, doc, field, value, quote. documents: doc, role, text and, if permissions tell scopes, scope. permitted: role,
    field (and scope). declared: id, start, end, attribute, as ``declared_spans`` gives them. forms: field, value, form.
    vocabulary: field, form. A value is carried as a substring, or by all its tokens but ``stop``. start and end are
    those of the quote's place, null where it has none."""
    stop = stop or []
    on = ["role", "scope", "field"] if "scope" in permitted.columns else ["role", "field"]
    rows = drafts.join(documents.select("doc", *on[:-1], "text", F.lit(True).alias("there")), "doc", "left")
    rows = rows.join(permitted.select(*on, F.lit(True).alias("may")).distinct(), on, "left")
    rows = rows.join(permitted.select("field", F.lit(True).alias("known")).distinct(), "field", "left")
    rows = rows.withColumn("span", find_span(F.col("text"), F.col("quote"))).drop("text")
    if declared is None:
        rows = rows.withColumn("column", F.lit(None).cast("string"))
    else:
        spans = declared.select(F.col("id").alias("doc"), F.col("start").alias("from"), F.col("end").alias("to"), "attribute")
        inside = rows.join(spans, "doc").where((F.col("from") <= F.col("span.start")) & (F.col("span.end") <= F.col("to")))
        inside = inside.groupBy("draft").agg(F.min(F.struct("from", "to", "attribute")).getField("attribute").alias("column"))
        rows = rows.join(inside, "draft", "left")
    entailed = carries(F.col("quote"), F.col("value"), stop)
    if forms is not None:
        others = rows.join(forms, ["field", "value"]).groupBy("draft").agg(F.bool_or(carries(F.col("quote"), F.col("form"), stop)).alias("otherwise"))
        rows = rows.join(others, "draft", "left")
        entailed = entailed | F.coalesce("otherwise", F.lit(False))
    foreign = F.lit(False)
    if vocabulary is not None:
        words = rows.join(vocabulary, "field").groupBy("draft").agg(F.bool_or(carries(F.col("value"), F.col("form"), stop)).alias("named"))
        rows = rows.join(words, "draft", "left")
        foreign = F.col("named").isNotNull() & ~F.col("named")
    reason = (
        F.when(F.col("known").isNull(), "field_not_permitted").when(F.col("there").isNotNull() & F.col("may").isNull(), "field_not_permitted_for_doc")
        .when(F.col("there").isNull(), "unknown_document").when(F.col("span.how").isNull(), "span_not_found").when(F.col("column").isNotNull(), "quote_is_a_typed_column")
        .when(~F.coalesce(entailed, F.lit(False)), "not_entailed").when(foreign, "not_in_vocabulary").otherwise("verified")
    )
    return rows.select("draft", reason.alias("reason"), "span.start", "span.end", "column")


def page_offsets(pages: DataFrame, gap: int = 2) -> DataFrame:
    """doc, page, start, end of pages (doc, page, text) joined with ``gap`` characters in between."""
    order = Window.partitionBy("doc").orderBy("page")
    size = F.length("text").cast("long")
    end = F.sum(size + gap).over(order) - gap
    return pages.select("doc", "page", (end - size).alias("start"), end.alias("end"))


def page_of(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """span, page: the page that holds a place; null between pages and in documents without. spans: span, doc, at, span being unique.

    Places and pages are put in one order by document: a place takes the page before it, so a document's places never meet all
    its pages."""
    starts = offsets.select("doc", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("start", "end", "page").alias("on"), F.lit(None).cast(spans.schema["span"].dataType).alias("span"))
    places = spans.select("doc", "at", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["on"].dataType).alias("on"), "span")
    before = F.last("on", ignorenulls=True).over(Window.partitionBy("doc").orderBy("at", "kind"))
    rows = starts.unionByName(places).withColumn("on", before).where("kind = 1")
    return rows.select("span", F.when(F.col("at") < F.col("on.end"), F.col("on.page")).alias("page"))


def joined_documents(rows: DataFrame) -> DataFrame:
    """A text per key of (key, part, text): its parts in order, parted by blank lines. A key is one sample's few records."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return rows.where("text is not null").groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x.text), "\n\n").alias("text"))
