"""Text grammar: normalisation, phrase tokens, phrase search, direction and quality."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# fixed values
FORMAT_CONTROLS = r"[\u00AD\u061C\u200E\u200F\u202A-\u202E\u2060\u2066-\u2069\uFEFF]"
CLITICS = "ובכלמהש"
ACRONYM_QUOTES = "[\"'\u2018\u2019\u201c\u201d\u05f3\u05f4]"
CATEGORIES = (
    ("REFUND", ("credit", "refund", "זיכוי", "החזר")),
    ("INTEREST", ("interest", "ריבית")),
    ("FEE", ("commission", "fee", "עמלה", "דמי")),
    ("ADJUSTMENT", ("adjustment", "correction", "התאמה", "תיקון")),
    ("PURCHASE", ("purchase", "purchased", "רכישה", "קנייה", "עסקה")),
)


#: What case folding does to a lower-case character beyond lower case: one character for another, or several for one.
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x30000)) if c.lower() == c != c.casefold()}
ONE_FOLDED = {c: f for c, f in FOLDED.items() if len(f) == 1}
MORE_FOLDED = {c: f for c, f in FOLDED.items() if len(f) > 1}


def _ranges(characters: Iterable[str]) -> str:
    """The inside of a regular expression's class, runs of characters as ranges."""
    points, out = sorted(map(ord, characters)), ""
    for i, c in enumerate(points):
        if i == 0 or c != points[i - 1] + 1:
            out += f"\\x{{{c:X}}}"
        elif i + 1 == len(points) or points[i + 1] != c + 1:
            out += f"-\\x{{{c:X}}}"
    return out


def nfc(text: Column) -> Column:
    """Canonical composition, by the Unicode library that Spark itself carries; only texts beyond U+02FF can need it."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x{2FF}]"), composed).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Composed, without format controls, zero-width spaces as spaces, white space runs as one space, trimmed."""
    shown = F.replace(F.regexp_replace(nfc(text), FORMAT_CONTROLS, ""), F.lit("\u200b"), F.lit(" "))
    # printable ASCII with single spaces inside is as it should be already
    return F.when(text.rlike(r"[^ -~]|\A | \z|  "), F.trim(F.regexp_replace(shown, r"(?U)[\s\x1C-\x1F]+", " "))).otherwise(text)


def casefold(text: Column) -> Column:
    """Full case folding: lower case, and the characters of FOLDED where a text has any."""

    def more(low: Column) -> Column:
        pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in MORE_FOLDED.items()))
        folded = F.aggregate(pairs, F.translate(low, "".join(ONE_FOLDED), "".join(ONE_FOLDED.values())), lambda t, p: F.replace(t, p["c"], p["f"]))
        return F.when(low.rlike(f"[{_ranges(FOLDED)}]"), folded).otherwise(low)

    return F.when(text.rlike(r"[^\x00-\x7F]"), let(F.lower(text), more)).otherwise(F.lower(text))


def phrase_tokens(text: Column, drop_acronym_quotes: bool = False) -> Column:
    """Case-folded runs of letters and digits, joiners dropped."""
    folded = F.regexp_replace(casefold(normalize_text(text)), "[\u200c\u200d]", "")
    if drop_acronym_quotes:
        folded = F.regexp_replace(folded, rf"(?<=\p{{L}}){ACRONYM_QUOTES}(?=\p{{L}})", "")
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+", -1), "")


def padded(tokens: Column) -> Column:
    """Tokens as one string with a space before and after each, in which a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def has_phrase(tokens: Column, phrases: Sequence[str], clitic: bool = False) -> Column:
    """Whether any of the phrases (already folded) stands in the tokens.

    ``clitic``: a Hebrew phrase may have one prefix letter on its first word.
    """
    return let(padded(tokens), lambda p: phrase_in(p, phrases, clitic))


def phrase_in(line: Column, phrases: Sequence[str], clitic: bool = False) -> Column:
    """``has_phrase`` on tokens that are already one padded string."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | line.contains(f" {phrase} ")
        if clitic and any("\u0590" <= c <= "\u05ff" for c in phrase):
            found = found | line.rlike(f" [{CLITICS}]{phrase} ")
    return found


def category(description: Column, has_installment: Column | None = None) -> Column:
    """First category of the vocabulary that the description has a word of; an installment overrides it."""

    def first(line: Column) -> Column:
        chain = F.lit("UNKNOWN")
        for name, phrases in reversed(CATEGORIES):
            chain = F.when(phrase_in(line, phrases), F.lit(name)).otherwise(chain)
        return chain

    chain = let(padded(phrase_tokens(F.coalesce(description, F.lit("")))), first)
    return chain if has_installment is None else F.when(has_installment, F.lit("INSTALLMENT")).otherwise(chain)


def sign_contradicts(category_: Column, kind: Column) -> Column:
    """A refund that is no credit; a purchase, fee, interest or installment that is no charge."""
    return ((category_ == "REFUND") & (kind != "CREDIT")) | (category_.isin("PURCHASE", "FEE", "INTEREST", "INSTALLMENT") & (kind != "CHARGE"))


def direction(text: Column) -> Column:
    """``rtl`` where right-to-left letters outnumber the left-to-right ones, else ``ltr``."""
    rtl = F.regexp_count(text, F.lit(r"[\p{IsHebrew}\p{IsArabic}]"))
    ltr = F.regexp_count(text, F.lit(r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]"))
    return F.when(text.rlike(r"[^\x00-\x7F]") & (rtl > ltr), "rtl").otherwise("ltr")


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.lit(1), F.length(reference))


def quality(text: Column, image_ratio: Column, n_words: Column) -> Column:
    """Extraction quality of a page: counts, ratios and the reasons to read it by OCR."""
    measured = F.struct(
        F.length(text).alias("characters"),
        F.length(F.regexp_replace(text, r"(?U)[\s\x{FFFD}\p{C}]", "")).alias("usable"),
        (F.regexp_count(text, F.lit("\ufffd")) / F.greatest(F.length(text), F.lit(1))).alias("replaced"),
        (F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cf}]")) / F.greatest(F.length(text), F.lit(1))).alias("control"),
        F.least(image_ratio, F.lit(1.0)).alias("image"),
    )

    def judged(m: Column) -> Column:
        reasons = F.array_compact(
            F.array(
                F.when(m["usable"] < 8, "nearly_empty_text"),
                F.when(m["replaced"] > 0.05, "excessive_replacement_characters"),
                F.when(m["control"] > 0.02, "excessive_control_characters"),
                F.when((n_words == 0) & (m["image"] > 0.5), "image_dominant_without_words"),
            )
        )
        return F.struct(*(m[k].alias(k) for k in ("characters", "usable", "replaced", "control", "image")), reasons.alias("reasons"))

    return let(measured, judged)


def word_error_counts(reference: Column, hypothesis: Column) -> Column:
    """(edits, words) of token edit distance by a fold over rows of the distance table; ``words`` is at least 1."""
    tokens = lambda c: F.filter(F.split(c, r"(?U)\s+", -1), lambda t: t != "")

    def edits(pair: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(pair["h"]))

        def row(before: Column, word: Column) -> Column:
            start = F.array(F.element_at(before, 1) + 1)
            step = lambda acc, j: F.array_append(
                acc,
                F.least(
                    F.element_at(acc, -1) + 1,
                    F.element_at(before, j + 1) + 1,
                    F.element_at(before, j) + (F.element_at(pair["h"], j) != word).cast("int"),
                ),
            )
            columns = F.when(F.size(pair["h"]) > 0, F.sequence(F.lit(1), F.size(pair["h"]))).otherwise(F.array().cast("array<int>"))
            return F.aggregate(columns, start, step)

        table = F.aggregate(pair["r"], first, row)
        return F.struct(F.element_at(table, -1).alias("edits"), F.greatest(F.lit(1), F.size(pair["r"])).alias("words"))

    return let(F.struct(tokens(reference).alias("r"), tokens(hypothesis).alias("h")), edits)
