"""Every query against its SQL on the small tables, as the driver does at the next size; entry points and imports."""

import hashlib
import io
import subprocess
import sys
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lexforge.plans import catalogue, curation
from lexforge.sources import archives

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "to_integral_value") and v == v.to_integral_value() else str(v)

    return sorted(tuple(cell(float(v) if hasattr(v, "to_integral_value") else v) for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in catalogue.ORACLES:
        assert got.columns
        return
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert norm([[float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r] for r in rows], got.columns) == norm([[float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "to_integral_value") else v for v in r] for r in want.fetchall()], columns)


def test_fingerprints_against_hashlib(spark, sf):
    """SQL lacks the hash: each fingerprint is that of the terms, which SQL checks."""
    terms = {(r["doc_id"], r["pos"]): r["terms"] for r in catalogue.QUERIES["sentence_fingerprint_terms"](spark, sf).collect()}
    got = catalogue.QUERIES["sentence_fingerprint"](spark, sf).collect()
    assert len(got) == len(terms) > 1000
    assert all(r["fingerprint"] == hashlib.blake2s(terms[r["doc_id"], r["pos"]].encode(), digest_size=10).hexdigest() for r in got)


def zipped(data: bytes, method: int) -> int:
    with zipfile.ZipFile(io.BytesIO(), "w", compression=method, compresslevel=9) as z:
        z.writestr("x", data)
        return z.infolist()[0].compress_size


def test_codecs_against_real_members(spark, sf):
    """Each choice and size against archives that are written with all four methods."""
    lines = {r["doc_id"]: r["line"].encode() for r in catalogue.documents(spark, sf).select("doc_id", archives.serialised(["doc_id", "text"]).alias("line")).collect()}
    for r in catalogue.QUERIES["codec_choice"](spark, sf).collect():
        sizes = {m: zipped(lines[r["doc_id"]], code) for m, code in archives.METHODS.items()}
        assert r["size"] == sizes[r["method"]] == min(sizes.values()) and (r["method"] != "stored" or list(sizes.values()).count(r["size"]) == 1)
    p = curation.packed(catalogue._curated(spark, sf), "auto").where("status = 'stored'").collect()
    made = {}
    for r in p:
        assert r["member_bytes"] == r["all_sizes"][r["method"]] == min(r["all_sizes"].values())
        site = r["url"].split("/")[2].lower()
        made[site] = made.get(site, 0) + r["member_bytes"]
    assert {r["site"]: r["compressed_bytes"] for r in catalogue.QUERIES["archive_members"](spark, sf).collect() if r["stored"]} == made


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_need_no_session_and_no_llm():
    hide = "import sys; sys.modules['lexforge.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    for code in ("import __spark_entry__ as e; e.queries(); e.oracle_sql()", hide):
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_native_plans_stay_in_the_jvm(spark, sf, capsys):
    for name in ("sentence_search", "quality_assessment", "classify_topics", "fulltext_query", "archive_inspect"):
        catalogue.QUERIES[name](spark, sf).explain("formatted")
    out = capsys.readouterr().out
    assert "Python" not in out and "Arrow" not in out and "CartesianProduct" not in out


def test_block_lists_without_entries(spark, tmp_path):
    """Texts of commas and blanks only, and addresses without a site, make empty lists, as SQL says of the texts."""
    spark.createDataFrame([(1, " ,\n, "), (2, ""), (3, "b, A,b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, " , ", ""), (5, "http://H.com/a/", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["doc_id"]: (r["kind"], r["n"], r["first"]) for r in catalogue.QUERIES["block_lists"](spark, str(tmp_path)).collect()}
    assert got == {1: ("words", 0, ""), 2: ("words", 0, ""), 3: ("words", 2, "b"), 4: ("sites", 0, ""), 5: ("sites", 1, "h.com/a")}


def test_batches_of_pages_are_bounded(spark, tmp_path):
    """A Python worker is handed a bounded part of a task's pages at a time, whatever the session began with."""
    from lexforge.functions import html as H

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.range(3000).selectExpr("id AS page_id", "'http://h/' AS url", "'<p>x</p>' AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert catalogue.QUERIES["page_full_text"](spark, str(tmp_path)).count() == 3000

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    p = catalogue.raw_pages(spark, str(tmp_path)).select("page_id", H.read(F.col("html"), F.col("url"), "visible")["visible"].alias("t"))
    assert max(r["n"] for r in p.mapInArrow(sizes, "n long").collect()) <= 1000
