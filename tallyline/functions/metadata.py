"""Document metadata: statement dates, PDF date anchors, card numbers, issuers, merchants, paths, provenance (F6, F10, F11, F48, F85, A15, SNK5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import FIRST_YEAR, LAST_YEAR, calendar_date
from .let import let
from .text import normalize_text, padded, phrase_tokens

# fixed values
ISSUERS = {
    "max": (("max", "מקס", "לאומי קארד"), ("max co il", "max it", "לקוחותינו", "הנפקה")),
    "cal": (("cal", "כאל", "ויזה כאל"), ("cal co il", "cal online co il")),
    "amex": (("amex", "american express", "אמריקן אקספרס"), ()),
}
WHOLE_ONLY = ("max", "cal")
CARD_LABELS = ("credit card number", "card number", "card no", "מספר כרטיס")
SUFFIX_LABELS = (
    "card ending in",
    "card ending with",
    "card ending with digits",
    "כרטיס שמסתיים ב",
    "כרטיס שמסתיים בספרות",
    "לכרטיס שמסתיים ב",
    "הודעה לכרטיס המסתיים ב",
)


def statement_date(value: Column) -> Column:
    """The date of ``y m d`` or ``d m y`` with any of ``/ . -`` or spaces between; two-digit years are of this century."""
    gap = r"(?:\s*[/.-]\s*|\s+)"
    first = rf"^\s*(\d{{4}}){gap}(\d{{1,2}}){gap}(\d{{1,2}})\s*$"
    last = rf"^\s*(\d{{1,2}}){gap}(\d{{1,2}}){gap}(\d{{4}}|\d{{2,3}})\s*$"
    part = lambda p, i: F.regexp_extract(value, p, i)
    year = F.when(value.rlike(first), part(first, 1)).otherwise(part(last, 3))
    month = F.when(value.rlike(first), part(first, 2)).otherwise(part(last, 2))
    day = F.when(value.rlike(first), part(first, 3)).otherwise(part(last, 1))
    whole = F.when(F.length(year) == 2, year.try_cast("int") + 2000).otherwise(year.try_cast("int"))
    return F.when(whole.between(FIRST_YEAR, LAST_YEAR), calendar_date(whole, month, day))


def pdf_date(value: Column) -> Column:
    """The day of ``D:YYYYMMDD...``."""
    part = lambda i: F.regexp_extract(value, r"^D:(\d{4})(\d{2})(\d{2})", i)
    return F.when(part(1).try_cast("int").between(FIRST_YEAR, LAST_YEAR), calendar_date(part(1), part(2), part(3)))


def pdf_year_anchor(created: Column, modified: Column) -> Column:
    """The year of creation, if both dates are read, modification is no earlier and at most a year later."""
    return let(
        F.struct(pdf_date(created).alias("c"), pdf_date(modified).alias("m")),
        lambda d: F.when((d["m"] >= d["c"]) & (F.year(d["m"]) - F.year(d["c"]) <= 1), F.year(d["c"])),
    )


def card_value(text: Column) -> Column:
    """Digits after a card label: 4 to 19 of a number, the first four after a label that announces the last digits."""
    folded = F.array_join(phrase_tokens(text, drop_acronym_quotes=True), " ")

    def read(t: Column) -> Column:
        digits = lambda labels: F.regexp_replace(F.regexp_extract(t, rf"(?:^|\s)(?:{'|'.join(labels)})((?:\s+\d+)+)", 1), r"\s", "")
        suffix, number = digits(SUFFIX_LABELS), digits(CARD_LABELS)
        return F.when(F.length(suffix) >= 4, F.substring(suffix, 1, 4)).when(F.length(number).between(4, 19), number)

    return let(folded, read)


def issuers(text: Column) -> Column:
    """Issuers that a text names; short brand names count only as the whole text or in a phrase of their own."""

    def named(tokens: Column) -> Column:
        found = []
        for issuer, (brands, phrases) in ISSUERS.items():
            hit = F.lit(False)
            for brand in brands:
                if brand in WHOLE_ONLY:
                    hit = hit | (F.array_join(tokens, " ") == brand)
                else:
                    hit = hit | padded(tokens).contains(f" {brand} ")
            for phrase in phrases:
                hit = hit | padded(tokens).contains(f" {phrase} ")
            found.append(F.when(hit, F.lit(issuer)))
        return F.array_compact(F.array(*found))

    return let(phrase_tokens(text, drop_acronym_quotes=True), named)


def merchant(description: Column) -> Column:
    """The whole description, its quote marks between Hebrew letters as the acronym sign, or null if nothing is left."""
    text = F.regexp_replace(normalize_text(description), '(?<=[\u0590-\u05ff])\\s*"\\s*(?=[\u0590-\u05ff])', "״")
    return F.when(text != "", text)


def is_safe_path(path: Column) -> Column:
    """Relative, not empty, and without a step to a parent."""
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    return ~path.startswith("/") & (F.size(parts) > 0) & ~F.array_contains(parts, "..")


def provenance(references: Column) -> Column:
    """(pages, boxes): distinct pages in order, and ``page:x0,y0,x1,y1`` of every reference; coordinates in their shortest form."""
    short = lambda v: F.regexp_replace(F.call_function("format_number", v, F.lit("0.###############")), r"^-0$", "0")
    box = lambda r: F.concat_ws(":", r["page"].cast("string"), F.concat_ws(",", *(short(r["box"][s]) for s in ("x0", "y0", "x1", "y1"))))
    return F.struct(
        F.array_join(F.array_distinct(F.transform(references, lambda r: r["page"].cast("string"))), ";").alias("pages"),
        F.array_join(F.transform(references, box), ";").alias("boxes"),
    )


def page_baseline(row_type: Column, has_previous: Column, roles: Column, resolved: Column) -> Column:
    """(decision, reason) of the rule-based arm (K26); ``roles``: those of the row's columns that hold atoms, nulls for columns without one."""
    known = F.array_compact(roles)
    rules = (
        (row_type == "STRUCTURAL", "IGNORE", "page_baseline_structural_row"),
        (row_type == "AMBIGUOUS", "ABSTAIN", "page_baseline_ambiguous_row"),
        ((row_type == "CONTINUATION") & ~has_previous, "ABSTAIN", "page_baseline_continuation_without_previous_row"),
        (F.size(known) > F.size(F.array_distinct(known)), "ABSTAIN", "page_baseline_duplicate_role"),
        (F.size(known) == 0, "ABSTAIN", "page_baseline_no_supported_field"),
        (~resolved, "ABSTAIN", "page_baseline_unresolved_proposal"),
    )
    chain = F.struct(F.lit("ACCEPT").alias("decision"), F.lit("page_baseline_supported_fields").alias("reason"))
    for condition, decision, reason in reversed(rules):
        chain = F.when(condition, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(chain)
    return chain
