"""Corpus flows: digests, drift, audit, claims, samples, splits and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import digests, graph, splits
from ..sources import files
from .base import Tables, query


@query("""
WITH RECURSIVE l AS (
  SELECT doc_id AS node, 't' || sha256(text) AS grp FROM documents UNION SELECT doc_id, 'n' || lang || n_chars FROM documents),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM l a JOIN l b USING (grp)),
r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS unit FROM r GROUP BY node
""")
def connected_documents(t: Tables) -> DataFrame:
    """Documents that share a text, or a language and length, directly or through others."""
    d = t.documents
    groups = F.array(F.concat(F.lit("t"), F.sha2(F.col("text").cast("binary"), 256)), F.concat(F.lit("n"), F.col("lang"), F.col("n_chars").cast("string")))
    return graph.shared_groups(d.select("doc_id", F.explode(groups).alias("grp")), "doc_id", "grp")


@query("""
WITH r AS (SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS left_id, p_partkey AS right_id FROM part)
SELECT left_id, right_id FROM r WHERE left_id < right_id
""")
def fingerprint_pairs(t: Tables) -> DataFrame:
    """Parts of equal structure, each with the smallest id of its structure on the left, from which all pairs follow."""
    printed = t.part.select("p_partkey", digests.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("fp"))
    first = printed.groupBy("fp").agg(F.min("p_partkey").alias("left_id"))
    return printed.join(first, "fp").filter("left_id < p_partkey").select("left_id", F.col("p_partkey").alias("right_id"))


@query("""
SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey
""")
def best_candidate(t: Tables) -> DataFrame:
    """The best row of a group by a tuple."""
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))).alias("best"))


@query("""
SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS value,
       CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'conflicting_metadata' ELSE '' END AS diagnostic
FROM orders GROUP BY o_custkey
""")
def metadata_conflict(t: Tables) -> DataFrame:
    """A value holds only where all sources agree."""
    n = F.count_distinct("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(
        n.alias("n_values"), F.when(n == 1, F.max("o_orderstatus")).alias("value"), F.when(n > 1, "conflicting_metadata").otherwise("").alias("diagnostic")
    )


@query("""
WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('sample' || chr(0) || 'seed' || chr(0) || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, source FROM h WHERE k <= 2
""")
def stable_hash_sample(t: Tables) -> DataFrame:
    """Two documents of each source in hash order (the cap is the feature)."""
    return splits.quota_sample(t.documents.select("doc_id", "source"), "doc_id", "source", "seed", 2)


@query()
def staged_sample(t: Tables) -> DataFrame:
    """Quotas by stage, one document of a source over all stages; tested against a plain loop."""
    stages = [("long", 3, F.col("n_chars") > 2000), ("english", 4, F.col("lang") == "en"), ("any", 5, F.lit(True))]
    picked = splits.staged_quota(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id", "source", "seed", stages, 1)
    return picked.select("doc_id", "source", "stage")


@query("""
WITH h AS (SELECT source, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
p AS (SELECT source, substr(h, 1, 2) AS b, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM h GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, ',' ORDER BY b)) AS digest FROM p GROUP BY source
""")
def membership_digest(t: Tables) -> DataFrame:
    """A6."""
    return digests.membership_digest(t.documents, F.col("doc_id").cast("string"), ["source"])


@query("""
WITH h AS (SELECT lang, doc_id, sha256(text) AS h, doc_id // 10000 AS b FROM documents),
p AS (SELECT lang, b, count(*) AS n, sha256(string_agg(h, ',' ORDER BY doc_id)) AS d FROM h GROUP BY lang, b)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, ',' ORDER BY b)) AS digest FROM p GROUP BY lang
""")
def ordered_digest(t: Tables) -> DataFrame:
    """A5."""
    return digests.ordered_digest(t.documents, "doc_id", F.col("text"), ["lang"])


@query("""
WITH m AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(doc_id) AS last_id FROM documents WHERE doc_id % 17 > 0 GROUP BY source),
b AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(doc_id) AS last_id FROM documents WHERE source <> 'src3' GROUP BY source)
SELECT coalesce(m.source, b.source) AS source,
       CASE WHEN b.source IS NULL THEN 'not_in_baseline' WHEN m.source IS NULL THEN 'missing'
            ELSE concat_ws('|', CASE WHEN m.n <> b.n THEN 'n_changed' END, CASE WHEN m.chars > b.chars * (1 + 0.2) THEN 'chars_changed' END, CASE WHEN m.last_id <> b.last_id THEN 'last_id_changed' END) END AS reasons
FROM m FULL JOIN b ON m.source = b.source
""")
def baseline_drift(t: Tables) -> DataFrame:
    """A run's manifest against a baseline, one figure with a tolerance of 0.2."""
    of = lambda d: d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("last_id"))
    return digests.drift(of(t.documents.filter("doc_id % 17 > 0")), of(t.documents.filter("source != 'src3'")), ["source"], ["n", "chars", "last_id"], {"chars": 0.2})


@query("""
WITH c AS (SELECT l_orderkey, l_partkey AS atom, CASE WHEN l_linenumber % 2 = 0 THEN 'description' ELSE 'billed' END AS owner FROM lineitem),
a AS (SELECT l_orderkey, atom, count(DISTINCT owner) AS owners FROM c GROUP BY ALL),
o AS (SELECT l_orderkey, count(*) FILTER (owners > 1) AS n_conflicts, count(*) AS n_atoms FROM a GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(n_atoms, 0) AS n_atoms, CASE WHEN n_atoms IS NULL THEN 'unclaimed' WHEN n_conflicts > 0 THEN 'conflict' ELSE 'ok' END AS state
FROM orders LEFT JOIN o ON l_orderkey = o_orderkey
""")
def claim_conflicts(t: Tables) -> DataFrame:
    """Atoms with two owners, and pages that nothing claims."""
    claims = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("atom"), F.when(F.col("l_linenumber") % 2 == 0, "description").otherwise("billed").alias("owner"))
    owned = claims.groupBy("l_orderkey", "atom").agg(F.count_distinct("owner").alias("owners"))
    per = owned.groupBy("l_orderkey").agg(F.count_if(F.col("owners") > 1).alias("c"), F.count(F.lit(1)).alias("a"))
    state = F.when(F.col("a").isNull(), "unclaimed").when(F.col("c") > 0, "conflict").otherwise("ok")
    return t.orders.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("c", F.lit(0)).alias("n_conflicts"), F.coalesce("a", F.lit(0)).alias("n_atoms"), state.alias("state"))


@query("""
WITH l AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'STATEMENT' WHEN toxic = 1 OR doc_id % 2 = 0 THEN 'NOT_STATEMENT' ELSE 'AMBIGUOUS' END AS classification,
         (80 + doc_id % 20) / 100.0 AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'form_marker' ELSE 'no_tables' END AS reason FROM labels)
SELECT doc_id, CASE WHEN classification = 'STATEMENT' THEN 'KEEP' WHEN classification = 'NOT_STATEMENT' AND confidence >= 0.9 AND reason = 'form_marker' THEN 'QUARANTINE' ELSE 'REVIEW' END AS action,
       concat_ws('|', reason, CASE WHEN classification = 'NOT_STATEMENT' AND confidence < 0.9 THEN 'non_statement_confidence_below_threshold'
                                   WHEN classification = 'NOT_STATEMENT' AND reason <> 'form_marker' THEN 'non_statement_positive_evidence_missing' END) AS reasons
FROM l
""")
def audit_decision(t: Tables) -> DataFrame:
    """Only a sure non-statement with positive evidence is quarantined."""
    kind = F.when(F.col("quality") == 1, "STATEMENT").when((F.col("toxic") == 1) | (F.col("doc_id") % 2 == 0), "NOT_STATEMENT").otherwise("AMBIGUOUS")
    found = t.labels.select("doc_id", kind.alias("kind"), ((80 + F.col("doc_id") % 20) / 100.0).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, "form_marker").otherwise("no_tables").alias("reason"))
    other, unsure, bare = F.col("kind") == "NOT_STATEMENT", F.col("confidence") < 0.9, F.col("reason") != "form_marker"
    action = F.when(F.col("kind") == "STATEMENT", "KEEP").when(other & ~unsure & ~bare, "QUARANTINE").otherwise("REVIEW")
    added = F.when(other & unsure, "non_statement_confidence_below_threshold").when(other & bare, "non_statement_positive_evidence_missing")
    return found.select("doc_id", action.alias("action"), F.concat_ws("|", "reason", added).alias("reasons"))


@query(r"""
WITH w AS (SELECT conv_id, turn, role, unnest(string_split_regex(trim(text), '\s+')) AS w, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) AS i FROM conversations),
k AS (SELECT *, (i - 1) // 3 AS field, (i - 1) % 3 AS off FROM w)
SELECT conv_id, turn, string_agg(CASE WHEN field % 2 = 1 THEN 'O' WHEN off = 0 THEN 'B:' || role ELSE 'I:' || role END, ' ' ORDER BY i) AS tags FROM k GROUP BY conv_id, turn
""")
def bio_tags(t: Tables) -> DataFrame:
    """every other run of three tokens is a field; its first token begins it."""
    tokens = F.split(F.trim("text"), r"\s+")
    tag = lambda _, i: F.when(F.floor(i / 3) % 2 == 1, F.lit("O")).otherwise(F.concat(F.when(i % 3 == 0, F.lit("B:")).otherwise(F.lit("I:")), F.col("role")))
    return t.conversations.select("conv_id", "turn", F.array_join(F.transform(tokens, tag), " ").alias("tags"))


def _units(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("unit"))
    return splits.atomic_units(docs, "unit", "lang")


@query()
def split_assign(t: Tables) -> DataFrame:
    """3:1:1 by documents and languages, copies together; a greedy sequence, tested against a plain one."""
    units = _units(t)
    assigned = splits.assign(units, "seed")
    return assigned.join(units.select("unit", "n"), "unit").groupBy("split").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("units"))


@query()
def fold_assign(t: Tables) -> DataFrame:
    """Four folds of even size."""
    units = _units(t)
    return splits.folds(units, "seed", 4).join(units.select("unit", "n"), "unit").groupBy("fold").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("units"))


@query("""
SELECT CAST(o.o_orderkey AS VARCHAR) AS statement_id, coalesce(l.l_orderkey || '-' || l.l_linenumber, '') AS transaction_id,
       coalesce(CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '') AS billed_amount, o.o_orderstatus AS status, '' AS merchant, '' AS exchange_rate
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
""")
def csv_projection(t: Tables) -> DataFrame:
    """SNK3, SNK6: a statement without transactions keeps one row."""
    statements = t.orders.select(F.col("o_orderkey").alias("statement_id"), F.col("o_orderstatus").alias("status"))
    transactions = t.lineitem.select(F.col("l_orderkey").alias("statement_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("billed_amount"))
    rows = files.csv_rows(statements, transactions)
    return rows.select("statement_id", "transaction_id", "billed_amount", "status", "merchant", "exchange_rate")


@query("""
SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS line FROM customer
""")
def canonical_json(t: Tables) -> DataFrame:
    """SNK1."""
    return t.customer.select("c_custkey", digests.canonical_json(["c_name", "c_custkey", "c_mktsegment"]).alias("line"))


@query("""
WITH RECURSIVE n AS (
  SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN NULL WHEN turn % 7 = 6 THEN conv_id * 1000 + turn WHEN turn % 11 = 10 THEN -1 ELSE conv_id * 1000 + turn - 1 END AS owner FROM conversations),
r(id, pos, k) AS (SELECT id, id, 0 FROM n UNION ALL SELECT r.id, n.owner, k + 1 FROM r JOIN n ON n.id = r.pos WHERE n.owner IS NOT NULL AND k < 64),
e AS (SELECT r.id, max(r.k) AS k, arg_max(r.pos, r.k) AS last FROM r GROUP BY r.id)
SELECT e.id AS row_id, CASE WHEN n.id IS NOT NULL AND n.owner IS NULL THEN e.last END AS root,
       CASE WHEN n.id IS NULL THEN 'missing' WHEN n.owner IS NULL THEN 'ok' ELSE 'cycle' END AS state
FROM e LEFT JOIN n ON n.id = e.last
""")
def ownership_chain(t: Tables) -> DataFrame:
    """Where each turn's chain of owners ends; some own themselves, some an unknown turn."""
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    owner = F.when(F.col("role") == "user", F.lit(None)).when(F.col("turn") % 7 == 6, id_).when(F.col("turn") % 11 == 10, F.lit(-1)).otherwise(id_ - 1)
    return graph.owner_chains(t.conversations.select(id_.alias("id"), owner.alias("owner")), "id", "owner").withColumnRenamed("row", "row_id")


@query("""
WITH d AS (SELECT source || '/doc.pdf' AS relative_path, sha256(text) AS h, doc_id FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY h, doc_id) - CASE WHEN relative_path LIKE 'src1%' THEN 0 ELSE 1 END AS n FROM d),
q AS (SELECT relative_path, CASE WHEN n = 0 THEN relative_path WHEN n = 1 THEN replace(relative_path, '.pdf', '') || '-' || substr(h, 1, 12) || '.pdf'
             ELSE replace(relative_path, '.pdf', '') || '-' || substr(h, 1, 12) || '-' || n || '.pdf' END AS quarantine_path FROM k)
SELECT relative_path, count(*) AS n, sha256(string_agg(quarantine_path, ',' ORDER BY quarantine_path)) AS names FROM q GROUP BY relative_path
""")
def quarantine_names(t: Tables) -> DataFrame:
    """SNK9."""
    decisions = t.documents.select(F.concat("source", F.lit("/doc.pdf")).alias("relative_path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    taken = decisions.filter("relative_path like 'src1%'").select("relative_path").distinct()
    named = files.quarantine_names(decisions, taken)
    return named.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("quarantine_path")), ",").cast("binary"), 256).alias("names"))


@query("""
SELECT p_partkey, concat_ws('|', CASE WHEN p_size < 1 OR p_size > 45 THEN 'size_out_of_range' END, CASE WHEN p_retailprice < 950 THEN 'price_below_minimum' END,
                            CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[1-4][0-9]') THEN 'brand_pattern' END) AS violations
FROM part
""")
def record_invariants(t: Tables) -> DataFrame:
    """P15."""
    checks = F.array(
        F.when(~F.col("p_size").between(1, 45), "size_out_of_range"), F.when(F.col("p_retailprice") < 950, "price_below_minimum"), F.when(~F.col("p_brand").rlike("^Brand#[1-4][0-9]$"), "brand_pattern")
    )
    return t.part.select("p_partkey", F.concat_ws("|", F.array_compact(checks)).alias("violations"))


@query("""
WITH r AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'DATE' WHEN '2-HIGH' THEN 'AMOUNT' WHEN '3-MEDIUM' THEN 'DESCRIPTION' ELSE 'UNKNOWN' END AS role, count(*) AS n FROM orders GROUP BY ALL),
m(role, most) AS (VALUES ('DATE', 2), ('AMOUNT', 1), ('DESCRIPTION', 3))
SELECT r.o_custkey, string_agg('unsupported_role_cardinality:' || r.role, '|' ORDER BY r.role) AS diagnostics FROM r JOIN m ON m.role = r.role WHERE r.n > m.most GROUP BY r.o_custkey
""")
def role_contract(t: Tables) -> DataFrame:
    """Roles that occur more often than a row may have them."""
    p = F.col("o_orderpriority")
    role = F.when(p == "1-URGENT", "DATE").when(p == "2-HIGH", "AMOUNT").when(p == "3-MEDIUM", "DESCRIPTION").otherwise("UNKNOWN")
    most = F.broadcast(t.spark.createDataFrame([("DATE", 2), ("AMOUNT", 1), ("DESCRIPTION", 3)], "role string, most int"))
    over = t.orders.groupBy("o_custkey", role.alias("role")).agg(F.count(F.lit(1)).alias("n")).join(most, "role").filter("n > most")
    return over.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("unsupported_role_cardinality:"), "role"))), "|").alias("diagnostics"))


@query("""
WITH a AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) / 200 AS share FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN share = 0 THEN 0 WHEN share < 0.25 THEN 1 WHEN share < 0.75 THEN 2 ELSE 3 END::BIGINT AS bucket FROM a
""")
def area_bucket(t: Tables) -> DataFrame:
    """A29."""
    share = t.lineitem.groupBy("l_orderkey").agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")) / 200).alias("share"))
    return share.select("l_orderkey", F.when(F.col("share") == 0, 0).when(F.col("share") < 0.25, 1).when(F.col("share") < 0.75, 2).otherwise(3).cast("long").alias("bucket"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_custkey FROM orders)
SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus IS NOT NULL) AS n_status, CAST(sum(p) AS DOUBLE) AS total, bool_and(k >= 1) AND max(k) = count(*) AS contiguous FROM s GROUP BY o_custkey
""")
def run_projection(t: Tables) -> DataFrame:
    """A5, SNK10, K18: counts, presence and gapless ordinals of a run."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t.orders.select("o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("p"), k.alias("k"))
    return rows.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderstatus").alias("n_status"), F.sum("p").cast("double").alias("total"), ((F.max("k") == F.count(F.lit(1))) & F.bool_and(F.col("k") >= 1)).alias("contiguous")
    )
