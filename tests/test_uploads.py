"""Documents as files: each has its own, written by the task that holds it."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline.plans import text_queries as T
from ledgerline.sources import files

SF = "/root/testdata/sf0.001"


def test_each_row_is_a_file_and_a_repeated_task_replaces_it(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k % 3}/doc_id={k}.txt", f"é {k}\n") for k in range(50)], "name string, content string").repartition(4)
    assert files.write_each(rows, str(tmp_path / "top")) == 50
    assert files.write_each(rows.withColumn("content", F.concat(F.lit("new "), "content")), str(tmp_path / "top")) == 50
    assert files.write_each(rows.where("false"), str(tmp_path / "none")) == 0
    made = {p.name: p.read_text() for p in (tmp_path / "top").rglob("*") if p.is_file()}
    assert made == {f"doc_id={k}.txt": f"new é {k}\n" for k in range(50)}


@pytest.mark.parametrize("name", ["a1_read_text_docs", "a2_gate_uploads"])
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    told = con.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(repr, told)) == sorted(repr(tuple(r)) for r in entry.queries()[name](spark, SF).collect())


@pytest.mark.parametrize("disk", [True, False])
def test_files_share_folders_where_tasks_see_the_disk(spark, monkeypatch, disk):
    """Elsewhere Spark's own writers give each file a folder; both ways the same files are found."""
    if not disk:
        monkeypatch.setattr(files, "on_disk", lambda spark, path: None)
    top = T._written_files(spark, SF)
    found = files.read_uploads(spark, top).where(F.col("path").contains("doc_id=")).select("path", T._file_id(), "content").collect()
    n, folders = len({r.doc_id for r in found}), len({r.path.rsplit("/", 1)[0] for r in found})
    assert n == len(found) == spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").count()
    assert folders == n if not disk else folders <= 2 * T.FOLDERS
    assert all(r.path.endswith(".csv") == (r.doc_id % 3 == 0) for r in found)
