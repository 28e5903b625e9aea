"""Licence scans."""

import hashlib
import pathlib
import re

import duckdb
import pytest

from vectriage.llm import licences


def test_equivalent_writings(spark):
    mit = next(t for i, t in licences.KNOWN if i == "MIT" and len(t) > 100)
    rows = [
        (1, "MIT", None), (2, "\n\n  Copyright (c) 2020 A. Person\n\n" + mit.upper() + "\nAll rights reserved.", None), (3, mit.replace("sublicense", "sub-licence").replace(" ", "\n\t"), None),
        (4, mit + " And more.", None), (5, None, None), (6, "", None), (7, "***", None), (8, "copyright 1999 someone", None), (9, "licensed under cc by 4.0", None), (9, "licensed under cc by 4.0", None), (10, "x " * 200000, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence_id string")
    got = [(r.doc_id, r.licence_id) for r in licences.scan(df, licences.known(spark)).collect()]
    assert len(got) == len(rows) and got.count((9, "CC-BY-4.0")) == 2
    assert dict(got) == {1: None, 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "CC-BY-4.0", 10: None}
    assert licences.scan(df.limit(0), licences.known(spark)).count() == 0
    assert licences.scan(df, licences.known(spark, [])).where("licence_id is not null").count() == 0


def test_ties_go_to_the_smallest_name(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert licences.scan(df, licences.known(spark, [("z", "A, B"), ("y", "a-b")])).first().licence_id == "y"


def test_query_and_sql(spark, sf_dir):
    from vectriage.llm.queries import ORACLE, QUERIES

    got = sorted(tuple(r) for r in QUERIES["op1_licence_scan"](spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    assert got == sorted(con.execute(ORACLE["op1_licence_scan"]).fetchall())


def test_no_python_in_the_plan(spark, sf_dir):
    from vectriage.llm.queries import QUERIES

    plan = QUERIES["op1_licence_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_form(text):
    """The canonical form in plain Python."""
    out = (text or "").lower()
    out = re.sub(r"(^|\n)[^\n]*(copyright (\(c\)|©|[0-9])|\(c\) [0-9]|© ?[0-9]|all rights reserved)[^\n]*", r"\1", out)
    for a, b in (("licenc", "licens"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"), ("https://", "http://"), ("&", " and ")):
        out = out.replace(a, b)
    return re.sub(r"[\W_]+", " ", out).strip()


def planted():
    rows = []
    for i, t in licences.titled():
        rows += [(i, t), (i, f"Copyright (c) 2019 Some One\n{t.upper()}"), (i, f"  {t}\n\n(c) 2001-2004 X".replace(",", " ,")), (None, t + " and a word more"), (None, "x" + t)]
    title, mit = "MIT License", next(t for i, t in licences.KNOWN if i == "MIT" and len(t) > 100)
    rows += [("MIT", f"{title}\n\nCopyright (c) 2022 A Company\n\n{mit}"), (None, f"{title}\n{title}\n{mit}"), (None, ""), (None, None), (None, "all rights reserved")]
    return [(k, t, want) for k, (want, t) in enumerate(rows)]


def test_planted_texts_in_both_engines(spark):
    from vectriage.llm.queries import OP1_SQL

    rows = planted()
    want = {k: (hashlib.sha256(plain_form(t).encode()).hexdigest(), i) for k, t, i in rows}
    assert sum(i is not None for _, i in want.values()) > 60
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    assert {r.doc_id: (r.text_digest, r.licence_id) for r in licences.scan(df, licences.known(spark)).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, t, _ in rows])
    assert {k: (d, i) for k, d, i in con.execute(OP1_SQL).fetchall()} == want


FILES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not pathlib.Path("/usr/share/common-licenses").is_dir(), reason="the system has no licence files")
def test_whole_files_of_the_system_are_known(spark):
    there = [(i, pathlib.Path(f"/usr/share/common-licenses/{f}").read_text(errors="replace")) for f, i in FILES.items() if pathlib.Path(f"/usr/share/common-licenses/{f}").is_file()]
    df = spark.createDataFrame(there, "want string, text string")
    assert all(r.licence_id == r.want for r in licences.scan(df, licences.known(spark)).collect()) and there
