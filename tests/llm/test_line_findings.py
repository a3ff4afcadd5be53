import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from leakwright.llm import line_dedup
from leakwright.llm.line_dedup import drop_boilerplate
from leakwright.llm.oracles import SQL
from leakwright.llm.registry import queries

#: White space that lines are freed of, and other that stays: NEL, LS and PS, which Java's ``$`` stops before, and more.
GOES, STAYS = ["", " ", "\t\r", "\x0b ", "\x0c"], ["\x85", "\u2028", "\u2029", "\u00a0", "\u3000", "\x1c"]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_lines_are_freed_of_white_space_as_the_sql_says(spark, tmp_path, monkeypatch, broadcast):
    """The last line of a text too: it was compared without blanks before a line separator that ends it."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    monkeypatch.setattr(line_dedup, "BROADCAST_TEXTS", broadcast)
    pages = [("http://a/", f"<p>own {a!r} {b!r}</p>{a}menu{b}<br>{b}<li> \t{b}end{a}") for a in GOES for b in [*GOES, STAYS[0]]]
    pages += [(None, f"<p>{c}menu{d}<br>own {i}<br>foot{b}{c}") for c in STAYS for i, (b, d) in enumerate([("", " "), (" ", ""), ("\t", "\r"), ("", "")])]
    pages += [(f"x://B{k}/x", f"own {i}<br>foot{b}{c}") for k, c in enumerate(STAYS) for i, b in enumerate(["", " ", "\t", ""])]
    pages += [("http://b/", html) for html in [None, "", " ", "\n", "menu", "menu  ", "<P>", "menu", "\tmenu \n menu"]]
    pages = [(i, *page) for i, page in enumerate(pages)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        found = db.execute(SQL["op8_line_dedup"])
        columns = [c[0] for c in found.description]
        want = found.fetchall()
    got = [tuple(r) for r in queries()["op8_line_dedup"](spark, os.fspath(tmp_path)).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[columns.index("n_dropped")] for r in got) > 20


def test_long_runs_of_blanks_take_time_in_proportion(spark):
    texts = [f"menu{' ' * 300_000}end\n\t{' ' * 300_000}\nown {i}" for i in range(4)]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string").withColumn("site", F.lit("s"))
    began = time.time()
    got = drop_boilerplate(pages, site="site", max_ratio=0.5).select("text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == [(f"\t{' ' * 300_000}\nown {i}", 3, 1) for i in range(4)]
    assert time.time() - began < 30
