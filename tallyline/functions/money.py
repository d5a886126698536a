"""Money grammar (F20-F26): one strict monetary lexeme, or a reason why not.

The grammar is a chain of expressions over one bound intermediate each, so a
whole column of amounts stays in the JVM. Values are DECIMAL(38,2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import diagnostics, let
from .text import CLITICS, normalize_text, padded, phrase_in, phrase_tokens

# fixed values
CURRENCIES = {
    "₪": "ILS", "ILS": "ILS", "NIS": "ILS", "שח": "ILS", "ש ח": "ILS",
    "$": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR", "EU": "EUR",
    "£": "GBP", "GBP": "GBP", "GB": "GBP", "JPY": "JPY", "CHF": "CHF", "AUD": "AUD", "CAD": "CAD",
}
CURRENCY = r"""(?i)(?<![A-Z])(?:ILS|NIS|USD|EUR|EU|GBP|GB|JPY|CHF|AUD|CAD)(?![A-Z])|[₪$€£]|ש[\s"״']*ח|ב\s*-\s*\{|\{(?=\s*[+-]?\d)"""
CREDIT = ("credit", "credited", "refund", "refunded", "זיכוי", "החזר")
CHARGE = ("charge", "charged", "debit", "חיוב")

AMOUNT = "decimal(38,2)"
#: A number with no more than a point in it, and one currency on one side: what the grammar says of it needs no grammar.
UNIT = r"(?:[$€£₪]|ILS|NIS|USD|EUR|GBP|JPY|CHF|AUD|CAD)"
PLAIN = rf"\A(?:\d+(?:\.\d\d?)? ?{UNIT}|{UNIT} ?\d+(?:\.\d\d?)?)\z"


def canonical_currency(value: Column) -> Column:
    """ISO code of a whole known code, symbol or alias, else null."""
    table = F.create_map(*(F.lit(x) for pair in CURRENCIES.items() for x in pair))
    known = lambda code: F.try_element_at(table, code)
    # most codes are known as they stand, so the rest is not tried for them
    return let(normalize_text(value), lambda plain: F.coalesce(known(plain), known(F.upper(plain)), known(F.upper(F.array_join(phrase_tokens(plain), " ")))))


def currencies_in(text: Column) -> Column:
    """Distinct known currencies of a text in source order."""
    found = F.regexp_extract_all(text, F.lit(CURRENCY), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(found, lambda m: F.when(m.contains("{"), F.lit("ILS")).otherwise(canonical_currency(m)))))


def is_currency_shaped(text: Column) -> Column:
    return canonical_currency(text).isNotNull()


def _without_markers(text: Column) -> Column:
    words = sorted((*CREDIT, *CHARGE), key=len, reverse=True)
    hebrew = "|".join(w for w in words if ord(w[0]) > 0x500)
    latin = "|".join(w for w in words if ord(w[0]) < 0x80)
    return F.regexp_replace(text, rf"(?iU)(?<!\w)(?:{latin}|[{CLITICS}]?(?:{hebrew}))(?!\w)", " ")


def signed_core(text: Column) -> Column:
    """(core, negative, positive, bad): at most one sign at either end, or full parentheses."""

    def read(t: Column) -> Column:
        wrapped = t.rlike(r"^\([^()]*\)$")
        core = F.when(wrapped, F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
        return let(
            F.struct(core.alias("core"), wrapped.alias("wrapped"), F.regexp_count(core, F.lit("[+-]")).alias("signs")),
            lambda s: let(
                F.struct(
                    s["core"].alias("core"),
                    s["wrapped"].alias("wrapped"),
                    s["signs"].alias("signs"),
                    ((t.rlike(r"[()]") & ~s["wrapped"]) | (s["wrapped"] & (s["signs"] > 0)) | (s["signs"] > 1) | ((s["signs"] == 1) & ~s["core"].rlike(r"^[+-]|[+-]$"))).alias("bad"),
                ),
                lambda c: F.struct(
                    F.when(c["bad"], c["core"]).otherwise(F.trim(F.regexp_replace(c["core"], "[+-]", ""))).alias("core"),
                    (~c["bad"] & (c["wrapped"] | c["core"].contains("-"))).alias("negative"),
                    (~c["bad"] & c["core"].contains("+")).alias("positive"),
                    c["bad"].alias("bad"),
                ),
            ),
        )

    return let(F.trim(text), read)


def canonical_number(text: Column) -> Column:
    """(digits, problem): digits with a point, or the reason that there is no single reading.

    The right-most of two kinds of separators is the decimal one; a lone
    separator before exactly three digits could be either, so it is ambiguous.
    """
    spaced = F.trim(F.regexp_replace(F.replace(text, F.lit("'"), F.lit(" ")), r"\s+", " "))

    def read(t: Column) -> Column:
        whole = F.element_at(F.split(t["spaced"], "[.,]", 2), 1)
        bad_groups = t["spaced"].contains(" ") & whole.contains(" ") & ~whole.rlike(r"^\d{1,3}( \d{3})*$")
        return let(F.struct(t["text"].alias("text"), bad_groups.alias("bad_groups"), F.replace(t["spaced"], F.lit(" "), F.lit("")).alias("c")), judge)

    def judge(t: Column) -> Column:
        c = t["c"]
        marks = F.regexp_replace(c, "[^.,]", "")
        parts = F.struct(
            t["text"].alias("text"),
            t["bad_groups"].alias("bad_groups"),
            c.alias("c"),
            F.regexp_count(marks, F.lit(",")).alias("commas"),
            F.regexp_count(marks, F.lit(r"\.")).alias("dots"),
            F.regexp_extract(c, "([^.,]*)$", 1).alias("fraction"),
        )
        return let(parts, split)

    def split(t: Column) -> Column:
        head = F.substr(t["c"], F.lit(1), F.length(t["c"]) - F.length(t["fraction"]) - 1)
        last = F.substr(t["c"], F.length(t["c"]) - F.length(t["fraction"]), F.lit(1))
        return let(F.struct(t.alias("t"), head.alias("head"), last.alias("last")), decide)

    def decide(u: Column) -> Column:
        t, head, last = u["t"], u["head"], u["last"]
        c, commas, dots, fraction = t["c"], t["commas"], t["dots"], t["fraction"]
        both, lone, several = (commas > 0) & (dots > 0), (commas + dots) == 1, ((commas > 1) & (dots == 0)) | ((dots > 1) & (commas == 0))
        grouped = F.when(last == ",", head.rlike(r"^\d{1,3}(\.\d{3})*$")).otherwise(head.rlike(r"^\d{1,3}(,\d{3})*$"))
        digits = lambda x: F.regexp_replace(x, r"\D", "")
        problem = (
            F.when((t["text"] == "") | t["text"].rlike(r"[^\d.,'\s]"), "invalid_amount_text")
            .when(t["bad_groups"], "invalid_grouping_separator")
            .when(both & ~fraction.rlike(r"^\d{1,2}$"), "ambiguous_decimal_separator")
            .when(both & ~grouped, "invalid_grouping_separator")
            .when(several & ~c.rlike(r"^\d{1,3}(?:(?:,\d{3})+|(?:\.\d{3})+)$"), "invalid_grouping_separator")
            .when(lone & ~(head.rlike(r"^\d+$") & fraction.rlike(r"^\d+$")), "invalid_amount_text")
            .when(lone & (F.length(fraction) == 3), "ambiguous_decimal_separator")
            .when(lone & (F.length(fraction) > 2), "invalid_decimal_separator")
            .when((commas + dots == 0) & ~c.rlike(r"^\d+$"), "invalid_amount_text")
        )
        number = F.when(both | lone, F.concat(digits(head), F.lit("."), fraction)).otherwise(digits(c))
        return let(problem, lambda p: F.struct(F.when(p.isNull(), number).alias("digits"), p.alias("problem")))

    return let(F.struct(F.trim(text).alias("text"), spaced.alias("spaced")), read)


def parse_amount(text: Column, hint: Column | None = None) -> Column:
    """(amount, currency, confidence, diagnostics) of one whole lexeme; any diagnostic leaves the amount null."""
    whole = F.lit(False) if hint is not None else text.rlike(PLAIN)
    hint = F.lit(None).cast("string") if hint is None else hint

    def lexical(s: Column) -> Column:
        explicit = F.when(F.size(s["found"]) == 1, F.element_at(s["found"], 1))
        return let(
            F.struct(
                s["hint"].alias("hint"),
                canonical_currency(s["hint"]).alias("hinted"),
                F.size(s["found"]).alias("n"),
                explicit.alias("explicit"),
                (s["lettered"] & phrase_in(s["line"], CREDIT, clitic=True)).alias("credit"),
                (s["lettered"] & phrase_in(s["line"], CHARGE, clitic=True)).alias("charge"),
                signed_core(F.regexp_replace(F.when(s["lettered"], _without_markers(s["raw"])).otherwise(s["raw"]), CURRENCY, " ")).alias("core"),
            ),
            lambda t: let(F.struct(t.alias("t"), canonical_number(t["core"]["core"]).alias("number")), outcome),
        )

    def outcome(u: Column) -> Column:
        t, number = u["t"], u["number"]
        currency = F.coalesce(t["explicit"], t["hinted"])
        raised = diagnostics(
            (t["hint"].isNotNull() & t["hinted"].isNull(), "unknown_currency_hint"),
            (t["n"] > 1, "conflicting_currency"),
            (t["explicit"] != t["hinted"], "currency_hint_conflict"),
            (currency.isNull() & (t["n"] <= 1), "unknown_currency"),
            (t["credit"] & t["charge"], "conflicting_sign_marker"),
            (t["core"]["bad"], "invalid_sign_syntax"),
            ((t["core"]["negative"] & t["charge"]) | (t["core"]["positive"] & t["credit"]), "conflicting_sign_marker"),
            (number["problem"] == "invalid_grouping_separator", "invalid_grouping_separator"),
            (number["problem"] == "ambiguous_decimal_separator", "ambiguous_decimal_separator"),
            (number["problem"] == "invalid_decimal_separator", "invalid_decimal_separator"),
            (number["problem"] == "invalid_amount_text", "invalid_amount_text"),
        )
        value = F.expr("null").cast(AMOUNT)
        value = F.when(number["digits"].isNotNull(), number["digits"].try_cast(AMOUNT)).otherwise(value)
        return let(
            F.struct(
                F.when(t["core"]["negative"] | t["credit"], -value).otherwise(value).alias("value"),
                currency.alias("currency"),
                t["explicit"].alias("explicit"),
                (t["n"] > 1).alias("conflict"),
                raised.alias("diagnostics"),
            ),
            lambda v: F.struct(
                F.when(F.size(v["diagnostics"]) == 0, v["value"]).cast(AMOUNT).alias("amount"),
                F.when(~v["conflict"], v["currency"]).alias("currency"),
                F.when(F.size(v["diagnostics"]) > 0, F.lit(0.0)).when(v["explicit"].isNotNull(), F.lit(1.0)).otherwise(F.lit(0.95)).alias("confidence"),
                v["diagnostics"].alias("diagnostics"),
                v["value"].alias("value"),
            ),
        )

    def scan(raw: Column) -> Column:
        return let(F.struct(raw.alias("raw"), padded(phrase_tokens(raw)).alias("line"), currencies_in(raw).alias("found"), hint.alias("hint"), raw.rlike(r"\p{L}").alias("lettered")), lexical)

    value = F.regexp_extract(text, r"[\d.]+", 0).try_cast(AMOUNT)
    unit = F.try_element_at(F.create_map(*(F.lit(x) for pair in CURRENCIES.items() for x in pair)), F.regexp_extract(text, r"[^\d. ]+", 0))
    plain = F.struct(value.alias("amount"), unit.alias("currency"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("diagnostics"), value.alias("value"))
    return F.when(whole, plain).otherwise(let(normalize_text(text), scan))


def money_shaped(text: Column) -> Column:
    """``is_money_shaped`` of a text; one with a slash or without a digit cannot be, and is not parsed."""
    return F.when(text.contains("/") | ~text.rlike(r"\d"), False).otherwise(is_money_shaped(parse_amount(text)))


def is_money_shaped(parsed: Column) -> Column:
    """Of a parsed amount: a value, and nothing wrong but an unknown currency."""
    return let(parsed, lambda p: p["value"].isNotNull() & (F.size(F.array_except(p["diagnostics"], F.array(F.lit("unknown_currency")))) == 0))


def is_exact_multiple(value: Column, unit: Column) -> Column:
    return value % unit == 0


def plain_decimal(value: Column) -> Column:
    """Digits without exponent or trailing zeros; no negative zero."""
    text = value.cast("string")
    stripped = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(stripped.isin("-0", ""), F.lit("0")).otherwise(stripped)


def net_fee(gross: Column, discount: Column, gross_currency: Column, discount_currency: Column) -> Column:
    """Gross less discount; null if that is negative or the currencies differ."""
    net = gross - discount
    return F.when((net >= 0) & (gross_currency == discount_currency), net)


def fx_plausible(billed: Column, original: Column, rate: Column) -> Column:
    """The rate explains the billed amount to 5 %."""
    return F.abs(rate * original - billed) <= F.lit(0.05) * F.abs(billed)


def fee_plausible(gross: Column, billed: Column, percent: Column, discount: Column) -> Column:
    """The percentage explains the gross fee to 5 % of it, or 1 in hundredths, and the discount fits in it."""
    off = F.abs(F.lit(100) * gross - F.abs(billed) * percent)
    return (percent > 0) & (percent <= 100) & (discount >= 0) & (discount <= gross) & (off <= F.greatest(F.lit(1.0), F.lit(5.0) * gross))


def percentage_explains(amount: Column, amount_scale: Column, base: Column, base_scale: Column, percent: Column, percent_scale: Column) -> Column:
    """Whether base * percent / 100 and the amount can be equal within half a unit of what is printed of each."""
    half = lambda scale: F.lit(0.5) * F.pow(F.lit(10.0), -scale)
    low = (base - half(base_scale)) * (percent - half(percent_scale)) / 100
    high = (base + half(base_scale)) * (percent + half(percent_scale)) / 100
    return (high >= amount - half(amount_scale)) & (low <= amount + half(amount_scale))
