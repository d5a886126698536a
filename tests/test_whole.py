"""Registered queries on texts and groups that go on behind their heads."""

import random

import __spark_entry__


def ask(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def error_rate_tables():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ש😀 \n") for _ in range(n))
    items = [(0, "head " * 20 + text(150)), (1, text(200)), (2, "")]
    docs = [(0, "x", items[0][1][:100] + text(400)), (1, "x", items[1][1][:90] + "é" + items[1][1][91:]), (2, "y", text(30)), (3, "y", ""), (4, "x", text(900)), (5, "y", "")]
    return {"documents": (docs, "doc_id long, lang string, text string"), "benchmark": (items, "item_id long, text string")}


def test_error_rates(spark, tmp_path):
    tables = error_rate_tables()
    items = dict(tables["benchmark"][0])
    for name, parts in (("char_error_rate", list), ("word_error_rate", str.split)):
        want = {}
        for i, lang, h in tables["documents"][0]:
            r, h = parts(items[i % 3]), parts(h)
            edits, units = want.get(lang, (0, 0))
            want[lang] = edits + plain_distance(r, h), units + max(1, len(r))
        found = ask(spark, tmp_path / name, name, **tables)
        assert sorted(found) == [(lang, e, n, round(e / n, 9)) for lang, (e, n) in sorted(want.items())]


def test_direction_behind_the_head(spark, tmp_path):
    docs = [(1, "a" * 40 + "ש" * 41), (2, "ש" * 40 + "a" * 41), (3, "z" * 40 + "a" * 41), (4, "a" * 41 + "ש" * 40), (6, "a" * 40 + "z" * 41)]
    found = ask(spark, tmp_path, "text_direction", documents=(docs, "doc_id long, text string"))
    assert dict(found) == {1: "rtl", 2: "ltr", 3: "rtl", 4: "ltr", 6: "ltr"}


def test_policy_of_many_rows(spark, tmp_path):
    schemas = {"labels": "doc_id long, quality int, toxic int", "documents": "doc_id long, lang string, source string, n_chars long"}
    # 40 rows of "a" with 25 % errors, 40 of "b" with 50 %, 40 of "c" with 60 %: a guess is 1
    share = {"a": 10, "b": 20, "c": 24}
    labels = [(i, int(i % 40 >= share["abc"[i // 40]]), 0) for i in range(120)]
    docs = [(i, "x", "abc"[i // 40], 7) for i in range(120)]
    many = [(200 + 120 * k + i, q, t) for k in range(5) for i, q, t in labels], [(200 + 120 * k + i, *rest) for k in range(5) for i, *rest in docs]
    found = lambda name, rows: ask(spark, tmp_path / name, "policy_choice", **{t: (r, schemas[t]) for t, r in zip(("labels", "documents"), rows, strict=True)})
    assert found("few", (labels, docs)) == [("a", 30, 10)]
    assert found("many", many) == [("a", 150, 50)]
    assert found("worst", ([x for x in labels if x[0] >= 80], docs)) == [(None, 0, 0)]


def test_provenance_of_every_line(spark, tmp_path):
    lines = [(1, 1), (1, 2), (1, 3), (1, 4), (1, 2), (2, 6), (3, 5)]
    found = ask(spark, tmp_path, "provenance_strings", lineitem=(lines, "l_orderkey long, l_linenumber int"))
    box = lambda n: f"{n % 2 + 1}:{n / 2:.15g},0,{n + 10},0.25"
    assert sorted(found) == [(1, "1;2", ";".join(map(box, (2, 4, 1, 3)))), (2, "1", box(6)), (3, "2", box(5))]
