import duckdb

from cairn.llm import licenses
from tests.llm.fixtures import frame, rows, with_clashes

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""

CASES = [
    ("Some text.\nReleased under the MIT License.", "MIT"),
    ("Licensed under CC BY-NC 4.0.\nThe rest", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public Licence, version 3.", "GPL-3.0"),
    ("x###\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("© 2020 Someone. All rights reserved.", "All-Rights-Reserved"),
    ("foo. " + MIT, "MIT"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + MIT.split("\n\n")[0], ""),  # wrong order
    ("This driver holds a license to drive.", ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: nothing.", ""),
]


def data():
    return rows() + [(300 + i, t, "en", "s", 0) for i, (t, _) in enumerate(CASES)]


def test_cases(spark):
    out = {r.doc_id: r.licenses for r in licenses.scan_licenses(with_clashes(frame(spark, data()))).collect()}
    assert [out[300 + i] for i in range(len(CASES))] == [want for _, want in CASES]
    assert {out[i] for i in (100, 101, 102, 103)} == {""}


def test_equals_sql(spark, tmp_path):
    df = frame(spark, data())
    df.toPandas().to_parquet(tmp_path / "d.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet' WHERE doc_id IS NOT NULL")
    want = set(db.execute(licenses.oracle()).fetchall())
    got = {(r.doc_id, r.sentence_ids, r.licenses) for r in licenses.scan_licenses(df).collect() if r.doc_id is not None}
    assert got == want


def test_empty_table_and_native_plan(spark):
    out = licenses.scan_licenses(frame(spark, []))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_every_name_without_another_licence_word(spark):
    names = [(name, words) for name, all_words in {**licenses.NAMES, **licenses._creative_commons()}.items() for words in all_words]
    texts = [f"Some text.\nReleased under {words}.\nMore of it" for _, words in names] + ["RELEASED UNDER\tTHE TERMS OF THE GPL V2!", "This work is released under the CC BY-SA 4.0.", "Under Unlicence"]
    want = [name for name, _ in names] + ["GPL-2.0", "CC-BY-SA-4.0", "Unlicense"]
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    out = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert [out[i] for i in range(len(texts))] == want


def test_every_known_sentence_has_an_anchor(spark):
    known = licenses.known_sentences()
    df = frame(spark, [(i, s.upper(), "en", "s", 0) for i, s in enumerate(known)])
    out = {r.doc_id: r.sentence_ids for r in licenses.scan_licenses(df).collect()}
    assert [out[i] for i in range(len(known))] == list(known.values())
