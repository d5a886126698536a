"""Structural rules on generated rows, cells and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import structure as s
from .base import Tables, query, spread
from .relational import BOXES, _boxes


def picked(index: Column, *texts: str) -> Column:
    """One of the texts by a number."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(index, F.lit(len(texts))) + 1).cast("int"))


def listed(index: str, texts: tuple[str, ...]) -> str:
    """``picked`` as SQL."""
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in texts)
    return f"list_extract([{quoted}], CAST({index} % {len(texts)} AS INTEGER) + 1)"


DATES = ("31/12/2023", "a 5.6.2024", "29/02/2023", "29-2-2024", "7/8", "30/2", "x 7/8 y", "12/13/2024", "2024.01.05", "0001/02/03", "3/4 5/6", "1 3/4/2020", "none", "29/2", "3 . 4 . 21 q", "123/1/2020")
#: What each of DATES is: the one date beside a letter at most, and whether there is a whole date.
TOKENS = ("31/12/2023", "5.6.2024", None, "29-2-2024", "7/8", None, None, None, "2024.01.05", "0001/02/03", None, None, None, "29/2", "3 . 4 . 21", None)
WHOLE = (0, 1, 3, 8, 9, 11, 14)


@query(f"""
WITH f AS (SELECT event_id, event_id % {len(DATES)} AS k FROM events)
SELECT event_id, {listed("k", tuple(x or "" for x in TOKENS))} AS token, k IN {WHOLE} AS has_date FROM f
""")
def date_tokens(t: Tables) -> DataFrame:
    """F47."""
    written = picked(F.col("event_id"), *DATES)
    return t.events.select("event_id", F.coalesce(dates.isolated_date_token(written), F.lit("")).alias("token"), dates.contains_date_token(written).alias("has_date"))


TAGS = (*s.ROW_TAGS, "gap", "low_confidence")


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{listed("l_partkey", TAGS)}, {listed("l_suppkey", TAGS)}, 'gap', {listed("l_partkey", TAGS)}] AS d FROM lineitem),
k AS (SELECT *, list_filter(list_distinct(d), lambda x: x NOT IN ('gap', 'low_confidence')) AS known FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_aggregate(list_sort(list_transform(known, lambda x: CASE x WHEN 'merchant_prefix_continuation' THEN 'description_continuation' ELSE x END)), 'string_agg', ',') AS tags,
       list_has_any(known, ['subordinate_detail_continuation', 'subordinate_auxiliary_continuation', 'leading_subordinate_detail_continuation']) AS continues
FROM k
""")
def row_tags(t: Tables) -> DataFrame:
    """P3."""
    named = F.array(picked(F.col("l_partkey"), *TAGS), picked(F.col("l_suppkey"), *TAGS), F.lit("gap"), picked(F.col("l_partkey"), *TAGS))
    tagged = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.row_tags(named).alias("found"))
    joined = F.when(F.size("found") > 0, F.array_join(F.array_sort("found"), ","))
    return tagged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", joined.alias("tags"), s.is_continuation(F.col("found")).alias("continues"))


@query("""
SELECT o_orderkey, (CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END) + 1 AS dates, CASE WHEN o_orderkey % 4 > 0 THEN 1 ELSE 0 END AS amounts, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS installments FROM orders
""")
def shape_counts(t: Tables) -> DataFrame:
    """P6."""
    k = F.col("o_orderkey")
    cells = F.array(
        F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.when(k % 3 > 0, F.date_format("o_orderdate", "d.M.yyyy")).otherwise("31.2.2024"),
        F.when(k % 4 > 0, F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" $"))).otherwise("amount"),
        F.when(k % 5 == 0, "31 / 36").otherwise("3 of 12"),
    )
    return spread(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")).select("o_orderkey", s.shape_counts(cells).alias("c")).select("o_orderkey", *(F.col(f"c.{n}").alias(n) for n in ("dates", "amounts", "installments")))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at_ FROM events),
f AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN at_ END) AS stop FROM r GROUP BY user_id),
g AS (SELECT r.user_id, min(at_) AS first_ FROM r JOIN f USING (user_id) WHERE event_type = 'purchase' AND at_ < coalesce(stop, 1000000000) GROUP BY r.user_id)
SELECT r.user_id, r.event_id, CAST(at_ - first_ AS BIGINT) AS place FROM r JOIN f USING (user_id) JOIN g USING (user_id)
WHERE first_ <= 5 AND at_ >= first_ AND at_ < first_ + 3 AND at_ < coalesce(stop, 1000000000)
""")
def preview_rows(t: Tables) -> DataFrame:
    """A user's events after a header; a signup ends them, a purchase has the shape of a transaction."""
    kind = F.col("event_type")
    found = s.preview(t.events, ["user_id"], ["ts", "event_id"], kind == "signup", kind == "purchase")
    return found.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


LINES = ("No activity this month.", "Application form", "Date of birth:", "Signature", "cancellation of", "card", "Transactions details", "see HTTPS://bank.example/transactions/2024", "plain words", "signatures", "לא בוצעו עסק\"אות החודש", "שם המבקש")
#: Tokens of LINES, a space before and after each.
FLAT = "' ' || trim(regexp_replace(regexp_replace(lower(text), '(\\p{Hebrew})\"(\\p{Hebrew})', '\\1\\2', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"


def _any_of(line: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({line}, ' {p} ')" for p in phrases) + ")"


@query(f"""
WITH c AS (SELECT doc_id, k // 2 AS line, k AS cell, {listed("(doc_id * 7 + k * (1 + doc_id % 5))", LINES)} AS text FROM documents, range(4) r(k)),
f AS (SELECT *, {FLAT} AS flat FROM c),
p AS (SELECT doc_id, bool_or({_any_of("flat", s.CANCELLATION)}) AS cancellation FROM (SELECT doc_id, line, replace(string_agg(flat, '' ORDER BY cell), '  ', ' ') AS flat FROM f GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, bool_or({_any_of("flat", s.NO_ACTIVITY)}) AS zero_activity, bool_or({_any_of("flat", s.FORM_TITLES)}) AND count_if({_any_of("flat", s.FORM_FIELDS)}) >= 2 AS form,
       max(cancellation) AS cancellation, bool_or({_any_of("flat", s.HISTORY_TITLES)}) AND bool_or(contains(lower(text), '/transactions')) AS history_export
FROM f JOIN p USING (doc_id) GROUP BY doc_id
""")
def positive_evidence(t: Tables) -> DataFrame:
    """P13."""
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cell")
    cells = t.documents.select("doc_id", k).select("doc_id", F.floor(F.col("cell") / 2).alias("line"), "cell", picked(F.col("doc_id") * 7 + F.col("cell") * (1 + F.col("doc_id") % 5), *LINES).alias("text"))
    return s.positive_evidence(cells, "doc_id", "line")


@query(f"""
WITH {BOXES}
SELECT a.page, count(*) AS n FROM (SELECT DISTINCT page, x0, y0, x1, y1 FROM b) a JOIN b c ON (a.page, a.x0, a.y0, a.x1, a.y1) = (c.page, c.x0, c.y0, c.x1, c.y1) AND c.part % 2 = 1 GROUP BY a.page
""")
def same_place(t: Tables) -> DataFrame:
    """Boxes found by one step with what another found there."""
    boxes = _boxes(t)
    other = boxes.filter(F.col("part") % 2 == 1).select("page", "box", "part")
    return s.same_place(boxes.select("page", "box").distinct(), other, "page").groupBy("page").agg(F.count(F.lit(1)).alias("n"))


POLICY = ("runtime", "membership", "rows", "digest", "order")


@query("""
SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 4 THEN 'runtime' END, CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN 'membership' END, CASE WHEN event_id % 2 = 1 THEN 'digest' END) AS reasons FROM events
""")
def ordered_reasons(t: Tables) -> DataFrame:
    """Reasons as they came up, repeated ones too, in the order of the policy; one that it doesn't have is none."""
    i = F.col("event_id")
    raised = F.array_compact(F.array(F.when(i % 2 == 1, "digest").otherwise("membership"), F.lit("unheard"), F.when(i % 5 == 4, "runtime"), F.when(i % 3 == 0, "membership")))
    return t.events.select("event_id", F.array_join(s.in_policy_order(raised, POLICY), ",").alias("reasons"))


@query(f"""
WITH {BOXES}
SELECT source, count(*) AS n, count(DISTINCT page) AS pages, min(word) AS least FROM (
  SELECT 'digital' AS source, page, word FROM b UNION ALL SELECT 'symbol', page, '$' FROM b WHERE line = 1 UNION ALL SELECT 'ocr', page, lower(word) FROM b WHERE part % 3 = 0)
GROUP BY source
""")
def union_words(t: Tables) -> DataFrame:
    """Words of the text layer, of the symbol pass and of recognition."""
    words = _boxes(t).select("page", "line", "part", "word")
    every = s.union_words({"digital": words, "symbol": words.filter("line = 1").withColumn("word", F.lit("$")), "ocr": words.filter("part % 3 = 0").withColumn("word", F.lower("word"))})
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"), F.min("word").alias("least"))


@query("""
WITH c AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0) AS a, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 3 > 0) AS b FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM c)
SELECT o_custkey, coalesce(array_to_string(list_sort(list_intersect(a, b)), ','), '') AS common, list_has_all(b, a) AS subset, list_has_any(a, b) AS overlaps FROM f
""")
def set_relations(t: Tables) -> DataFrame:
    """A customer's priorities on even orders against those on orders that three doesn't divide."""
    some = lambda condition: F.collect_set(F.when(condition, F.col("o_orderpriority")))
    sets = t.orders.groupBy("o_custkey").agg(some(F.col("o_orderkey") % 2 == 0).alias("a"), some(F.col("o_orderkey") % 3 > 0).alias("b"))
    related = sets.select("o_custkey", s.set_relation(F.col("a"), F.col("b")).alias("r"))
    return related.select("o_custkey", F.array_join("r.common", ",").alias("common"), F.col("r.subset").alias("subset"), F.col("r.overlaps").alias("overlaps"))


@query(r"""
WITH r AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN reverse(text) WHEN 1 THEN text || 'x' ELSE ' ' || text END AS again FROM documents)
SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS characters, list_sort(string_split(regexp_replace(text, '\s', '', 'g'), '')) = list_sort(string_split(regexp_replace(again, '\s', '', 'g'), '')) AS equal FROM r
""")
def reading_signatures(t: Tables) -> DataFrame:
    """A second reading of a whole text has its characters in another order, or one more."""
    again = F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.concat(F.lit(" "), "text"))
    signed = t.documents.select("doc_id", s.signature(F.col("text")).alias("a"), s.signature(again).alias("b"))
    return signed.select("doc_id", F.length("a").cast("long").alias("characters"), (F.col("a") == F.col("b")).alias("equal"))


@query("""
WITH c AS (SELECT unnest(list_distinct(list_filter([CASE WHEN quality = 0 THEN 'segmentation' END, CASE WHEN toxic = 1 THEN 'row_type' END, CASE WHEN doc_id % 4 = 0 THEN 'segmentation' END], lambda x: x IS NOT NULL))) AS category FROM labels)
SELECT category, count(*) AS n, (SELECT count(*) FROM labels) AS of FROM c GROUP BY category
""")
def defect_counts(t: Tables) -> DataFrame:
    """A25."""
    found = F.array_compact(F.array(F.when(F.col("quality") == 0, "segmentation"), F.when(F.col("toxic") == 1, "row_type"), F.when(F.col("doc_id") % 4 == 0, "segmentation")))
    return s.category_counts(t.labels.select(found.alias("categories")), "categories")


ROW_TYPES = ("PRIMARY", "CONTINUATION", "STRUCTURAL", "AMBIGUOUS")


@query(f"""
WITH l AS (SELECT o_orderkey, o_orderstatus, {listed("o_orderkey", ROW_TYPES)} AS kind FROM orders),
f AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey)
SELECT o_orderstatus, count(*) AS labels, CAST(coalesce(sum(n), 0) AS BIGINT) AS fields, {", ".join(f"count_if(kind = '{k}') AS {k.lower()}" for k in ROW_TYPES)}
FROM l LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY o_orderstatus
""")
def annotation_coverage(t: Tables) -> DataFrame:
    """A26."""
    labels = t.orders.select("o_orderkey", "o_orderstatus", picked(F.col("o_orderkey"), *ROW_TYPES).alias("kind"))
    fields = t.lineitem.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return s.coverage(labels, fields, ["o_orderkey"], "kind", ROW_TYPES, ["o_orderstatus"])


@query("""
SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS state, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey AS BIGINT) AS owner FROM orders
""")
def summary_parts(t: Tables) -> DataFrame:
    """An order as the parts of a summary, from which every value can be read again."""
    parts = s.summaries(t.orders, ["o_orderkey"], classification=["o_orderstatus", "o_orderpriority"], period=["o_orderdate"], owner=["o_custkey"])
    return parts.select(
        "o_orderkey",
        F.concat_ws("/", "classification.o_orderstatus", "classification.o_orderpriority").alias("state"),
        F.date_format("period.o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("owner.o_custkey").cast("long").alias("owner"),
    )


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS text FROM lineitem GROUP BY ALL),
p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [2, 1] WHEN 1 THEN [1, 1] WHEN 2 THEN [1, 99] ELSE [1] END AS ids FROM orders),
x AS (SELECT o_orderkey, ids, i, ids[i] AS id FROM p, range(1, 3) r(i) WHERE i <= len(ids)),
j AS (SELECT x.o_orderkey, string_agg(text, ' ' ORDER BY i) AS t, count(text) AS n, count(*) AS of, count(DISTINCT id) AS d FROM x LEFT JOIN a ON l_orderkey = o_orderkey AND l_linenumber = id GROUP BY x.o_orderkey)
SELECT o_orderkey, CASE WHEN n = of AND d = of THEN t ELSE '' END AS text FROM j
""")
def rendered_proposals(t: Tables) -> DataFrame:
    """fields that name atoms of their row, some twice and some that it doesn't have."""
    atoms = t.lineitem.groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("atom_id")).agg(F.min("l_returnflag").alias("text"))
    k = F.col("o_orderkey") % 4
    ids = F.when(k == 0, F.array(F.lit(2), F.lit(1))).when(k == 1, F.array(F.lit(1), F.lit(1))).when(k == 2, F.array(F.lit(1), F.lit(99))).otherwise(F.array(F.lit(1)))
    made = s.rendered(atoms, t.orders.select(F.col("o_orderkey").alias("row"), F.lit("description").alias("role"), ids.alias("atom_ids")), ["row"])
    return made.select(F.col("row").alias("o_orderkey"), F.coalesce("text", F.lit("")).alias("text"))


ROLES = ("description", "transaction_date", "billing_currency", "installment", "billed_amount", "kind", "fx_rate")


@query(f"""
WITH f AS (SELECT o_orderkey, {listed("o_orderkey", ROLES)} AS role, o_orderkey % 2 AS odd, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT o_orderkey, role, CASE role
  WHEN 'description' THEN CASE WHEN odd = 1 THEN 'a shop' ELSE '' END WHEN 'transaction_date' THEN CASE WHEN odd = 1 THEN strftime(d, '%Y-%m-%d') ELSE '' END
  WHEN 'billing_currency' THEN CASE WHEN odd = 1 THEN 'ILS' ELSE '' END WHEN 'installment' THEN CASE WHEN odd = 1 THEN '2/12' ELSE '' END
  WHEN 'billed_amount' THEN CASE WHEN odd = 1 THEN rtrim(rtrim(CAST(amount AS VARCHAR), '0'), '.') ELSE '' END
  WHEN 'kind' THEN CASE WHEN amount = 0 THEN '' WHEN odd = 1 THEN 'CREDIT' ELSE 'CHARGE' END ELSE CASE WHEN odd = 1 THEN '3.25' ELSE '' END END AS value
FROM f
""")
def canonical_values(t: Tables) -> DataFrame:
    """the value of a field's text by its role."""
    odd = F.col("o_orderkey") % 2 == 1
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    good = {
        "description": F.lit(" a  shop "), "transaction_date": F.date_format("o_orderdate", "dd/MM/yyyy"), "billing_currency": F.lit("NIS"), "installment": F.lit("2 / 12"),
        "billed_amount": amount, "kind": F.concat(F.lit("-"), amount), "fx_rate": F.lit(" 3.25"),
    }
    bad = {"description": F.lit(" ‏ "), "transaction_date": F.lit("31/02/2024"), "billing_currency": F.lit("shekel"), "installment": F.lit("13/12"), "billed_amount": F.lit("a lot"), "kind": amount, "fx_rate": F.lit("3,25x")}
    role = picked(F.col("o_orderkey"), *ROLES)
    written = F.lit(None).cast("string")
    for name in ROLES:
        written = F.when(role == name, F.when(odd, good[name]).otherwise(bad[name])).otherwise(written)
    return t.orders.select("o_orderkey", role.alias("role"), F.coalesce(s.canonical_value(role, written, F.lit("ILS")), F.lit("")).alias("value"))


@query("""
WITH g AS (SELECT o_custkey % 300 AS name, count(*) AS times, max(o_orderstatus) AS hi, min(o_orderstatus) AS lo FROM orders WHERE o_orderkey % 5 > 0 GROUP BY ALL),
a AS (SELECT c_custkey % 350 AS name, max(CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END) AS hi, min(CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END) AS lo FROM customer GROUP BY ALL)
SELECT name, concat_ws('|', CASE WHEN times > 1 THEN 'repeated' END, CASE WHEN a.hi IS NULL THEN 'unclaimed' END, CASE WHEN g.hi IS NULL THEN 'missing' END, CASE WHEN g.hi <> a.hi OR g.lo <> a.lo THEN 'digest_mismatch' END) AS violations
FROM g FULL JOIN a USING (name) WHERE violations <> ''
""")
def handoff_violations(t: Tables) -> DataFrame:
    """K29."""
    given = t.orders.filter("o_orderkey % 5 > 0").select((F.col("o_custkey") % 300).alias("name"), F.col("o_orderstatus").alias("digest"))
    asked = t.customer.select((F.col("c_custkey") % 350).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "O").otherwise("F").alias("digest"))
    return s.handoff_violations(given, asked, "name", "digest")
