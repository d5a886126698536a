"""Operators against plain models on small tables."""

import datetime
import hashlib
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyline.functions import geometry as g
from tallyline.operators import dedup, digests, evaluate, evidence, graph, joins, layout, reconcile, splits, windows
from tallyline.sources import extract, files, tsv
from tallyline.streaming import flows

TX = "statement_id string, input_index int, transaction_id string, billed_amount decimal(18,2), billing_currency string, group_ids array<string>, ambiguities array<string>"
TOTAL = "statement_id string, input_index int, group_id string, amount decimal(18,2), currency string, minor_unit decimal(18,2)"


def outcome(spark, transactions, totals):
    tx = spark.createDataFrame([("s", i, t, Decimal(a), c, list(gs), list(am)) for i, (t, a, c, gs, am) in enumerate(transactions)], TX)
    total = spark.createDataFrame([("s", i, gid, Decimal(a), c, Decimal(u)) for i, (gid, a, c, u) in enumerate(totals)], TOTAL)
    judged = reconcile.judge(tx, total)
    grouped = reconcile.groups(judged, total)
    made = reconcile.statements(judged, grouped, total).collect()
    return judged.collect(), {(r.group_id, r.input_index): r for r in grouped.collect()}, made[0].status if made else None


def test_reconcile_groups(spark):
    rows, groups, status = outcome(spark, [("a", "10.00", "ILS", ["g"], []), ("b", "-2.50", "ILS", ["g"], []), ("c", "3.00", "USD", ["h"], [])], [("g", "7.50", "ILS", "0.01"), ("h", "3.00", "USD", "0.01")])
    assert status == "RECONCILED" and all(r.rejection is None for r in rows)
    assert groups["g", 0].transaction_ids == ["a", "b"] and groups["g", 0].difference == 0


def test_reconcile_rejections(spark):
    rows, groups, status = outcome(
        spark,
        [("a", "1.00", "ILS", ["g"], []), ("a", "1.00", "ILS", ["g"], []), ("b", "1.00", "ILS", ["x"], []), ("c", "1.00", "ILS", [], []), ("d", "1.00", "USD", ["g"], ["odd"])],
        [("g", "2.00", "ILS", "0.01")],
    )
    why = {r.input_index: r.rejection for r in rows}
    assert why == {
        0: None,
        1: "duplicate transaction id 'a'",
        2: "transaction 'b' references unknown reconciliation group 'x'",
        3: "transaction 'c' must belong to exactly one reconciliation group; found 0",
        4: None,
    }
    # a foreign currency is noted, and the row is still a member
    assert groups["g", 0].calculated == 2 and status == "UNRECONCILED"
    assert groups["g", 0].diagnostics == ["transaction 'd' currency USD does not match group currency ILS", "transaction 'd' has unresolved ambiguity: odd"]


def test_reconcile_minor_unit_and_repeated_total(spark):
    _, groups, status = outcome(spark, [("a", "1.03", "ILS", ["g"], [])], [("g", "1.03", "ILS", "0.05"), ("g", "1.03", "ILS", "0.01")])
    assert len(groups) == 2 and status == "UNRECONCILED"
    assert groups["g", 0].diagnostics[0] == "printed total is not representable at currency minor unit 0.05"
    assert groups["g", 1].n_members == 1


def test_reconcile_nothing(spark):
    rows, groups, status = outcome(spark, [], [("g", "0.00", "ILS", "0.01")])
    assert groups["g", 0].status == status == "RECONCILED" and rows == []
    assert outcome(spark, [("a", "1.00", "ILS", ["g"], [])], [])[2] == "UNRECONCILED"


@pytest.mark.parametrize(
    "statuses, want",
    [(["RECONCILED"] * 2, ("RECONCILED", "")), (["RECONCILED", "UNRECONCILED"], ("UNRECONCILED", "documents_not_reconciled:1")), (["NOT_STATEMENT"], ("NOT_STATEMENT", "documents_not_reconciled:1")), (["NOT_STATEMENT", "RECONCILED"], ("UNSUPPORTED", "documents_not_reconciled:1"))],
)
def test_disposition(spark, statuses, want):
    row = reconcile.disposition(spark.createDataFrame([("b", s) for s in statuses], "batch string, status string"), ["batch"]).first()
    assert (row.status, row.diagnostics) == want


def test_greedy_dedup():
    word = lambda text, box, confidence=1.0, source="digital": {"text": text, "box": dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)), "confidence": confidence, "source": source}
    words = [word("a", (0, 0, 10, 10), 0.5), word("a", (0, 0, 10, 9)), word("b", (0, 0, 10, 10)), word("a", (20, 0, 30, 10)), word("a", (20, 0, 30, 10), source="ocr")]
    assert dedup.survivors(words) == [1, 2, 3]


def lines_of(boxes, texts):
    """line_numbers of words in any order."""
    order = sorted(range(len(boxes)), key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, boxes[i][0], texts[i]))
    numbers, typical = layout.line_numbers(*zip(*(((b[1] + b[3]) / 2, b[3] - b[1], b[1]) for b in (boxes[i] for i in order)), strict=True))
    out, heights = dict(zip(order, numbers, strict=True)), dict(zip(order, typical, strict=True))
    return [out[i] for i in range(len(boxes))], [heights[i] for i in range(len(boxes))]


def test_lines_are_invariant():
    boxes = [(0, 0, 10, 10), (12, 1, 30, 11), (0, 20, 10, 30), (12, 22, 20, 30), (0, 0, 4, 40)]
    texts = list("abcde")
    base, heights = lines_of(boxes, texts)
    assert base[0] == base[1] and base[2] == base[3] and base[0] < base[2] and base[4] not in base[:4]
    assert heights == [10, 10, 9, 9, 40]
    moved = [(3 * x0 + 7, 3 * y0 + 7, 3 * x1 + 7, 3 * y1 + 7) for x0, y0, x1, y1 in boxes]
    assert lines_of(moved, texts)[0] == base


def test_lines_by_the_rule():
    """Every line of the page is asked, against the sweep that asks those within a word's reach."""
    rnd = random.Random(17)
    for _ in range(200):
        words = sorted((rnd.choice((rnd.uniform(0, 60), rnd.randrange(12) * 5)), rnd.choice((4, 5, 8, 10, 20, 0, 13)), rnd.uniform(0, 50)) for _ in range(rnd.randrange(1, 25)))
        groups, want = [], []
        for center, height, _ in words:
            ranked = []
            for k, group in enumerate(groups):
                typical, middle = statistics.median(h for _, h in group), statistics.median(c for c, _ in group)
                small, large = sorted((height, typical))
                if small > 0 and large <= 2.5 * small and abs(center - middle) <= 0.6 * large:
                    ranked.append((abs(center - middle), k))
            if ranked:
                groups[min(ranked)[1]].append((center, height))
                want.append(min(ranked)[1])
            else:
                groups.append([(center, height)])
                want.append(len(groups) - 1)
        got, _ = layout.line_numbers([c for c, _, _ in words], [h for _, h, _ in words], list(range(len(words))))
        assert got == want  # tops in the order of the words, so lines are numbered as they begin


def test_rows_confidence(spark):
    words = spark.createDataFrame([("d", 1, t, (x, 0.0, x + 5, 10.0), c, "digital") for t, x, c in (("a", 0.0, 1.0), ("b", 20.0, 0.5))], "document_id string, page int, text string, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double, source string")
    lined = layout.lines(words)
    row = layout.rows(lined).first()
    assert (row.confidence, row.direction, row.n_words) == (0.75, "ltr", 2)
    assert {r.text for r in layout.cells(lined).collect()} == {"a", "b"}


def test_pareto(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), i, rnd.randrange(6), rnd.randrange(6), rnd.randrange(4)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id int, x int, y int, z int")

    def plain(axes):
        front = set()
        for r in rows:
            others = [o for o in rows if o[0] == r[0]]
            if not any(all(s * o[a] >= s * r[a] for a, s in axes) and any(s * o[a] > s * r[a] for a, s in axes) for o in others):
                front.add(r[1])
        return front

    assert {r.id for r in joins.pareto_front(df, ["g"], "id", ["x"], ["y"]).collect()} == plain([(2, 1), (3, -1)])
    assert {r.id for r in joins.pareto_front(df, ["g"], "id", ["x", "z"], ["y"]).collect()} == plain([(2, 1), (4, 1), (3, -1)])


def test_spaced_and_sessions(spark):
    row = spark.sql("select array(1D, 1.1D, 1.3D, 2D) v, array() e").select(windows.spaced(F.col("v"), F.lit(0.2)).alias("k"), windows.spaced(F.col("e").cast("array<double>"), F.lit(1.0)).alias("n")).first()
    assert row.k == [1.0, 1.3, 2.0] and row.n == []


def test_graph(spark):
    members = spark.createDataFrame([(i, f"g{i // 2}") for i in range(20)] + [(i, f"h{(i + 1) // 2}") for i in range(1, 10)], "node long, grp string")
    units = {r.node: r.unit for r in graph.shared_groups(members, "node", "grp").collect()}
    assert all(units[i] == 0 for i in range(10)) and units[11] == 10 and units[19] == 18
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 9)], "r long, o long")
    chains = {r.row: (r.root, r.state) for r in graph.owner_chains(rows, "r", "o").collect()}
    assert chains == {1: (1, "ok"), 2: (1, "ok"), 3: (1, "ok"), 4: (None, "cycle"), 5: (None, "cycle"), 6: (None, "missing")}


def test_long_chains(spark):
    """A chain to a root, one to an unknown owner and one into a cycle, each longer than 64 rows."""
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 300)] + [(1000 + i, 999 + i) for i in range(150)] + [(2000, 2002), *((2000 + i, 1999 + i) for i in range(1, 150))]
    found = {r.row: (r.root, r.state) for r in graph.owner_chains(spark.createDataFrame(rows, "r long, o long"), "r", "o").collect()}
    assert found == {r: (0, "ok") if r < 1000 else (None, "missing" if r < 2000 else "cycle") for r, _ in rows}


def test_digests(spark):
    rows = [(i, f"v{i}") for i in range(50)]
    a = spark.createDataFrame(rows, "o long, v string")
    b = spark.createDataFrame(list(reversed(rows)), "o long, v string").repartition(5)
    of = lambda df, f: f(df).first().digest
    assert of(a, lambda d: digests.ordered_digest(d, "o", F.col("v"), block=7)) == of(b, lambda d: digests.ordered_digest(d, "o", F.col("v"), block=7))
    assert of(a, lambda d: digests.membership_digest(d, F.col("v"))) == of(b, lambda d: digests.membership_digest(d, F.col("v")))
    changed = spark.createDataFrame([(49 - i, v) for i, v in rows], "o long, v string")
    assert of(a, lambda d: digests.ordered_digest(d, "o", F.col("v"), block=7)) != of(changed, lambda d: digests.ordered_digest(d, "o", F.col("v"), block=7))


def test_splits(spark):
    docs = spark.createDataFrame([(i, f"u{i // 3}", "ab"[i % 2]) for i in range(90)], "doc_id long, unit string, stratum string")
    units = splits.atomic_units(docs, "unit", "stratum")
    got = {r.unit: r.split for r in splits.assign(units, "s").collect()}
    order = sorted({f"u{i}" for i in range(30)}, key=lambda u: (hashlib.sha256(f"split\0s\0{u}".encode()).hexdigest(), u))
    members = {u: [d for d in docs.collect() if d.unit == u] for u in order}
    totals = {"a": 45, "b": 45}
    held = {n: 0 for n, _ in splits.TARGETS}
    strata = {s: dict(held) for s in totals}
    for u in order:
        own = {s: sum(d.stratum == s for d in members[u]) for s in totals}

        def off(choice, u=u, own=own):
            return sum(abs(5 * (held[n] + (n == choice) * len(members[u])) - k * 90) + sum(abs(5 * (strata[s][n] + (n == choice) * own[s]) - k * t) for s, t in totals.items()) for n, k in splits.TARGETS)

        best = min((n for n, _ in splits.TARGETS), key=off)
        assert got[u] == best
        held[best] += len(members[u])
        for s in totals:
            strata[s][best] += own[s]
    fold = {r.unit: r.fold for r in splits.folds(units, "s", 3).collect()}
    assert sorted(list(fold.values()).count(i) for i in range(3)) == [10, 10, 10]


def test_staged_quota(spark):
    rows = [(i, f"o{i % 7}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, owner string, odd int")
    got = {r.id: r.stage for r in splits.staged_quota(df, "id", "owner", "s", [("odd", 3, F.col("odd") == 1), ("any", 4, F.lit(True))], 1).collect()}
    want, owners = {}, set()
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"sample\0s\0{r[0]}".encode()).hexdigest(), r[0]))
    for stage, quota, ok in (("odd", 3, lambda r: r[2] == 1), ("any", 4, lambda r: True)):
        for r in order:
            if quota and r[0] not in want and r[1] not in owners and ok(r):
                want[r[0]], quota = stage, quota - 1
                owners.add(r[1])
    assert got == want


def test_tsv(spark):
    line = "\t".join(["5", "1", "1", "1", "1", "1", "300", "600", "30", "15", "96.5", " word "])
    bad = ["", line.replace("96.5", "-1"), line.replace("\t30\t", "\t0\t"), line.replace("300", "x"), line[: line.rindex("\t")]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([line, *bad])], "i int, line string")
    (row,) = tsv.words_of_lines(df, "line", 300, (1.0, 2.0)).collect()
    assert (row.i, row.text, row.confidence) == (0, "word", 0.965)
    assert tuple(row.box) == pytest.approx((73.0, 146.0, 80.2, 149.6))


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("b.PDF", "a/x.pdf", "a/y.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.scan(spark, str(tmp_path)).collect()
    assert [(r.relative_path, r.source_ordinal) for r in sorted(found, key=lambda r: r.source_ordinal)] == [("a/x.pdf", 0), ("b.PDF", 1)]
    assert found[0].sha256 == hashlib.sha256(found[0].relative_path.encode()).hexdigest()
    df = spark.createDataFrame([(1, "b"), (2, None)], "n int, a string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "out"), "n int, a string").collect()) == sorted(df.collect())
    target = tmp_path / "t.csv"
    files.publish(spark, str(target), files.csv_bytes(["1,2"], ("x", "y")))
    assert target.read_bytes() == b"\xef\xbb\xbfx,y\r\n1,2\r\n"

    def broken():
        yield b"half"
        raise OSError

    with pytest.raises(OSError):
        files.publish_pair(spark, (str(target), [b"new"]), (str(tmp_path / "u"), broken()))
    assert target.read_bytes().endswith(b"1,2\r\n") and not (tmp_path / "u").exists()
    assert sorted(p.name for p in tmp_path.glob("[tu]*") if not p.name.startswith(".")) == ["t.csv"]
    files.publish_pair(spark, (str(target), [b"new"]), (str(tmp_path / "u"), [b"a", b"b"]))
    assert target.read_bytes() == b"new" and (tmp_path / "u").read_bytes() == b"ab"
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder/x").write_bytes(b"")
    with pytest.raises(Exception):  # a folder can't be replaced by a file
        files.publish_pair(spark, (str(target), [b"newer"]), (str(tmp_path / "folder"), [b"b"]))
    assert target.read_bytes() == b"new"
    quoted = spark.createDataFrame([('a"b', "c,d")], "x string, y string")
    assert files.csv_lines(quoted).first().line == '"a""b","c,d"'


def test_cache_misses(spark):
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "x string, y int")
    keyed = files.cache_misses(requests, spark.createDataFrame([], "cache_key string"), ["x", "y"])
    assert keyed.count() == 2
    assert files.cache_misses(requests, keyed.filter("x = 'a'"), ["x", "y"]).count() == 1


def test_streams(spark, tmp_path):
    tx = spark.createDataFrame([("s", 0, "a", Decimal("1.00"), "ILS", ["g"], [])], TX)
    total = spark.createDataFrame([("s", 0, "g", Decimal("1.00"), "ILS", Decimal("0.01"))], TOTAL)
    tx.write.parquet(str(tmp_path / "in"))
    seen = []
    q = flows.reconcile_arrivals(flows.arriving(spark, str(tmp_path / "in"), TX), total, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.status for r in seen] == ["RECONCILED"]
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, at, "purchase"), (1, at + datetime.timedelta(hours=5), "view"), (1, at + datetime.timedelta(hours=12), "view")], "user_id long, ts timestamp, event_type string")
    assert sorted((r.n, r.purchases) for r in flows.user_sessions(events).collect()) == [(1, 0), (2, 1)]


def test_fuse(spark):
    box = lambda *b: g.box(*(F.lit(float(v)) for v in b))
    page = spark.range(1).select(F.lit("d").alias("page"))
    primary = page.select("page", F.lit(0).alias("ordinal"), F.lit("12").alias("text"), box(0, 0, 10, 10).alias("box"), F.lit(0.9).alias("confidence")).union(
        page.select("page", F.lit(1), F.lit("1O5"), box(20, 0, 30, 10), F.lit(0.9))
    )
    more = page.select("page", F.lit("12.50").alias("text"), box(0, 0, 11, 10).alias("box"), F.lit(0.8).alias("confidence")).union(page.select("page", F.lit("105"), box(20, 0, 30, 10), F.lit(0.5)))
    got = {r.ordinal: r.text for r in joins.fuse_words(primary, more, ["page"]).collect()}
    assert got == {0: "12.50", 1: "105"}


def test_reading_order(spark):
    df = spark.createDataFrame([(0, [(0.0, "abc"), (10.0, "12"), (20.0, "def")]), (1, [(0.0, "ג"), (10.0, "ב"), (20.0, "abc"), (30.0, "x"), (40.0, "שלום")])], "i int, w array<struct<x:double,text:string>>")
    got = {r.i: r.o for r in df.select("i", evidence.reading_order(F.col("w")).alias("o")).collect()}
    assert got == {0: "abc 12 def", 1: "שלום abc x ב ג"}


def test_column_clusters():
    rows = [[(0, 10, "a"), (50, 70, "b")], [(1, 9, "c"), (52, 68, "d"), (90, 99, "e")], [(49, 71, "f")]]
    assert evidence.column_clusters(rows, 100.0) == [[0, 1], [0, 1, 2], [1]]
    # the earlier of two columns that are equally near, whatever the order of the rest
    assert evidence.column_clusters([[(0, 10, "a"), (20, 30, "b")], [(10, 20, "c")]], 30.0) == [[0, 2], [1]]
    # two cells of one row never share a column
    assert evidence.column_clusters([[(0, 10, "a"), (1, 11, "b")]], 100.0) == [[0, 1]]


@pytest.mark.parametrize(
    "shorts, years, want",
    [
        ([(25, [5])], [2025], {25: 2025}),
        ([(25, [5])], [2024, 2026], {25: 2025}),
        ([(25, [5])], [2024], None),
        ([(25, [12]), (26, [1])], [2026], {25: 2025, 26: 2026}),
        ([(25, [9]), (26, [1])], [2026], None),
        ([(25, [5])], [1925, 2025], None),
        ([], [2025], None),
    ],
)
def test_resolved_years(spark, shorts, years, want):
    df = spark.createDataFrame([(shorts, years)], "s array<struct<suffix:int,months:array<int>>>, y array<int>")
    assert df.select(evidence.resolved_years(F.col("s"), F.col("y"))).first()[0] == want


def test_drift_and_agreement(spark):
    now = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 10.0), ("d", 1, 12.5)], "k string, n int, s double")
    base = spark.createDataFrame([("a", 1, 10.0), ("b", 3, 10.0), ("c", 1, 1.0), ("d", 1, 10.0)], "k string, n int, s double")
    got = {r.k: r.reasons for r in digests.drift(now, base, ["k"], ["n", "s"], {"s": 0.2}).collect()}
    assert got == {"a": "", "b": "n_changed", "c": "missing", "d": "s_changed"}
    slots = lambda rows: spark.createDataFrame(rows, "row int, role string, value string")
    rate = evaluate.agreement(slots([(1, "x", "a"), (2, "x", "b")]), slots([(1, "x", "a"), (3, "x", "b")]), ["row"]).first()
    assert (rate.slots, rate.agreed) == (3, 1)


def test_extractors_and_results(spark, tmp_path):
    import json

    (tmp_path / "x.pdf").write_bytes(b"one two")
    found = files.scan(spark, str(tmp_path)).select("path")
    content = spark.read.format("binaryFile").load(str(tmp_path / "x.pdf"))
    words = extract.words_of_files(content, lambda b: [(1, w, (i, 0.0, i + 1.0, 1.0), "digital", 1.0) for i, w in enumerate(b.decode().split())]).collect()
    assert [w.text for w in words] == ["one", "two"] and words[0].document_id == hashlib.sha256(b"one two").hexdigest() and found.count() == 1
    with pytest.raises(Exception, match="not installed"):
        extract.recogniser_lines(spark.createDataFrame([("d", 1, bytearray(b"x"))], "document_id string, page int, content binary"), binary="no-such-binary").collect()
    statements = spark.createDataFrame([(1, "b", None), (0, "a", "x")], "o int, id string, note string")
    made = json.loads(b"".join(files.results_bytes(statements, "o", "RECONCILED", ["code"])))
    assert made == {"diagnostics": ["code"], "statements": [{"id": "a", "note": "x"}, {"id": "b", "note": None}], "status": "RECONCILED"}
    assert files.summary(spark.createDataFrame([("A",), ("B",), ("A",)], "status string")) == "A: 2, B: 1"
