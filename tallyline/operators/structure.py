"""Structural rules: row tags, shapes, previews, positive evidence, ordered reasons, signatures, proposals, handoffs
(P1, P3, P6, P13, J3, A25, A26, K29, O5, O7, U1, U3, U5, F83)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.let import let

# fixed values: diagnostics of rows and their tags; the tags of rows that go on from the one before
ROW_TAGS = {
    "merchant_prefix_continuation": "description_continuation",
    "subordinate_detail_continuation": "subordinate_detail_continuation",
    "subordinate_auxiliary_continuation": "subordinate_auxiliary_continuation",
    "leading_subordinate_detail_continuation": "leading_subordinate_detail_continuation",
    "foreign_conversion_detail_block": "foreign_conversion_detail_block",
    "bounded_card_identifier_detail_block": "bounded_card_identifier_detail_block",
    "bounded_hebrew_note_detail": "bounded_hebrew_note_detail",
}
CONTINUATION_TAGS = ("subordinate_detail_continuation", "subordinate_auxiliary_continuation", "leading_subordinate_detail_continuation")

# fixed values: phrases that prove what a document without transactions is
NO_ACTIVITY = (
    "no activity this month",
    "no activity this period",
    "no transactions this month",
    "no transactions this period",
    "לא בוצעו עסקאות החודש",
    "לא בוצעו עסקאות בתקופה זו",
    "לא בוצעו עסקות החודש",
    "לא בוצעו עסקות בתקופה זו",
)
FORM_TITLES = (
    "application form",
    "card application",
    "card cancellation",
    "card cancellation form",
    "cancellation form",
    "request form",
    "טופס ביטול",
    "טופס בקשה",
    "בקשה לביטול כרטיס",
)
FORM_FIELDS = ("applicant name", "date of birth", "identity number", "signature", "שם המבקש", "מספר זהות", "חתימה")
CANCELLATION = ("card cancellation", "cancellation of card", "ביטול כרטיס")
HISTORY_TITLES = ("transaction details", "transactions details", "פירוט עסקאות", "פירוט עסקות")
HISTORY_ROUTE = r"(?i)https?://\S*/transactions(?:/|\b)"


def row_tags(diagnostics: Column) -> Column:
    """The tags of a row's diagnostics, each once, in the diagnostics' order."""
    known = F.create_map(*(F.lit(x) for pair in ROW_TAGS.items() for x in pair))
    return F.array_distinct(F.array_compact(F.transform(diagnostics, lambda d: known[d])))


def is_continuation(tags: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, CONTINUATION_TAGS)))


def shape_counts(cells: Column) -> Column:
    """(dates, amounts, installments) that an array of cell texts has the shape of."""
    count = lambda test: F.size(F.filter(cells, test))
    return F.struct(
        count(lambda c: dates.isolated_date_token(c).isNotNull()).alias("dates"),
        count(money.money_shaped).alias("amounts"),
        count(dates.is_installment).alias("installments"),
    )


def preview(rows: DataFrame, partition: Sequence[str], order: Sequence[str], stops: Column, shaped: Column, most: int = 3, preamble: int = 4) -> DataFrame:
    """The first ``most`` rows from the first shaped one on, up to a row that stops; more than ``preamble`` rows before it and
    there are none (O7). Rows come in order after a header."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = rows.withColumn("__at", F.row_number().over(w)).withColumn("__stop", F.max(stops.cast("int")).over(w)).filter("__stop = 0")
    first = F.min(F.when(shaped, F.col("__at"))).over(Window.partitionBy(*partition))
    begun = marked.withColumn("__first", first).filter((F.col("__first") <= preamble + 1) & (F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__first") + most))
    return begun.withColumn("place", F.col("__at") - F.col("__first")).drop("__at", "__stop", "__first")


def positive_evidence(cells: DataFrame, document: str, row: str, cell_text: str = "text") -> DataFrame:
    """(document, zero_activity, form, cancellation, history_export): what phrases of its cells prove of a document.

    A form has a title and two fields or more; a cancellation's purpose may go over a row's cells; an export has a title
    and the address of a list of transactions.
    """
    cell = F.col(cell_text)
    tokens = cells.select(document, row, cell.alias("t"), text.padded(text.phrase_tokens(cell, drop_acronym_quotes=True)).alias("__flat"))
    has = lambda phrases: text.phrase_in(F.col("__flat"), phrases)
    # tokens of a row's cells side by side are the tokens of its text
    found = tokens.select(document, row, has(NO_ACTIVITY).alias("none"), has(FORM_TITLES).alias("title"), has(FORM_FIELDS).alias("field"), has(HISTORY_TITLES).alias("history"), F.col("t").rlike(HISTORY_ROUTE).alias("route"))
    whole = cells.groupBy(document, row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", cell_text))), lambda c: c[cell_text]), " ").alias("t"))
    purpose = whole.withColumn("__flat", text.padded(text.phrase_tokens(F.col("t"), drop_acronym_quotes=True))).withColumn("p", has(CANCELLATION)).groupBy(document).agg(F.bool_or("p").alias("cancellation"))
    made = found.groupBy(document).agg(
        F.bool_or("none").alias("zero_activity"),
        (F.bool_or("title") & (F.count_if("field") >= 2)).alias("form"),
        (F.bool_or("history") & F.bool_or("route")).alias("history_export"),
    )
    return made.join(purpose, document).select(document, "zero_activity", "form", "cancellation", "history_export")


def same_place(left: DataFrame, right: DataFrame, page: str, box: str = "box") -> DataFrame:
    """Rows of two tables that have one page and box; the box's sides are the join keys."""
    sides = ("x0", "y0", "x1", "y1")
    keyed = lambda df: df.withColumns({f"__{s}": F.col(f"{box}.{s}") for s in sides})
    keys = [page, *(f"__{s}" for s in sides)]
    return keyed(left).join(keyed(right).drop(box), keys).drop(*keys[1:])


def in_policy_order(reasons: Column, policy: Sequence[str]) -> Column:
    """The reasons, each once, in the order of a closed policy."""
    return F.filter(F.array(*map(F.lit, policy)), lambda r: F.array_contains(reasons, r))


def union_words(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All words of several readings, with the name of theirs as ``source``."""
    return reduce(DataFrame.unionByName, (df.withColumn("source", F.lit(name)) for name, df in sources.items()))


def set_relation(a: Column, b: Column) -> Column:
    """(common, subset, overlaps) of two arrays taken as sets."""
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("common"), (F.size(F.array_except(a, b)) == 0).alias("subset"), F.coalesce(F.arrays_overlap(a, b), F.lit(False)).alias("overlaps"))


def signature(reading: Column) -> Column:
    """The multiset of a text's characters without white space: equal for readings that differ in order alone."""
    return F.array_join(F.sort_array(F.split(F.regexp_replace(reading, r"(?U)\s", ""), "", -1)), "")


def category_counts(rows: DataFrame, categories: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each of the categories that an array column lists, and their share of all rows."""
    exploded = rows.select(*by, F.explode(F.array_distinct(categories)).alias("category"))
    counted = exploded.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counted.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("of"))))  # one row
    return counted.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("of")), list(by))


def coverage(labels: DataFrame, fields: DataFrame, row: Sequence[str], row_type: str, types: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Labels, fields and labels of each type."""
    n = fields.groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    typed = (F.count_if(F.col(row_type) == kind).alias(kind.lower()) for kind in types)
    joined = labels.join(n, list(row), "left")
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("fields"), *typed)


def summaries(rows: DataFrame, key: Sequence[str], **parts: Sequence[str]) -> DataFrame:
    """``rows`` as one struct for each part of a summary, which together hold every column they name."""
    return rows.select(*key, *(F.struct(*columns).alias(name) for name, columns in parts.items()))


def rendered(atoms: DataFrame, proposals: DataFrame, row: Sequence[str]) -> DataFrame:
    """``proposals`` (row, role, atom_ids) with ``text``, their atoms' texts in the order they name them; null where an atom is
    missing or named twice (F83)."""
    named = proposals.withColumn("__p", F.xxhash64(*row, "role", F.to_json("atom_ids")))
    placed = named.select(*row, "role", "__p", F.posexplode("atom_ids").alias("place", "atom_id"))
    found = placed.join(atoms.select(*row, "atom_id", "text"), [*row, "atom_id"], "left").groupBy(*row, "role", "__p")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    whole = (F.count("text") == F.count(F.lit(1))) & (F.count_distinct("atom_id") == F.count(F.lit(1)))
    made = found.agg(F.when(whole, line).alias("text"))
    return named.join(made, [*row, "role", "__p"], "left").drop("__p")


def canonical_value(role: Column, written: Column, currency: Column) -> Column:
    """The value of a field's text as its role has it, or null if it has none."""
    amount = lambda t: money.parse_amount(t, currency)
    kind = lambda p: F.when(p["amount"] < 0, "CREDIT").when(p["amount"] > 0, "CHARGE")
    plain = F.when(text.normalize_text(written) != "", text.normalize_text(written))
    pair = let(dates.installment(written), lambda i: F.when(i["current"].isNotNull(), F.concat_ws("/", i["current"], i["total"])))
    return (
        F.when(role.isin("description", "ancillary"), plain)
        .when(role.isin("transaction_date", "posting_date", "conversion_date"), dates.parse_date(written)["date"].cast("string"))
        .when(role.isin("billing_currency", "original_currency"), money.canonical_currency(written))
        .when(role == "installment", pair)
        .when(role.isin("billed_amount", "original_amount"), let(amount(written), lambda p: F.when(p["currency"].isNotNull(), money.plain_decimal(p["amount"]))))
        .when(role == "kind", let(amount(written), kind))
        .when(role == "fx_rate", F.when(text.normalize_text(written).rlike(r"^[+-]?\d+(\.\d+)?$"), text.normalize_text(written)))
    )


def handoff_violations(artifacts: DataFrame, consumers: DataFrame, name: str, digest: str) -> DataFrame:
    """Names that a locked handoff may not have: given twice, without a consumer, asked for but not given, or of another digest."""
    given = artifacts.groupBy(name).agg(F.count(F.lit(1)).alias("times"), F.max(digest).alias("given"), F.min(digest).alias("least"))
    asked = consumers.groupBy(name).agg(F.max(digest).alias("asked"), F.min(digest).alias("asked_least"))
    joined = given.join(asked, name, "full_outer")
    checks = F.array(
        F.when(F.col("times") > 1, "repeated"),
        F.when(F.col("asked").isNull(), "unclaimed"),
        F.when(F.col("given").isNull(), "missing"),
        F.when((F.col("given") != F.col("asked")) | (F.col("least") != F.col("asked_least")), "digest_mismatch"),
    )
    return joined.select(name, F.array_join(F.array_compact(checks), "|").alias("violations")).filter("violations != ''")
