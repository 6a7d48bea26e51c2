"""Work folders, kept tables and the guard around the corpus queries."""

import sys

import __spark_entry__
from twinside.plans import base
from twinside.session import drop_work, on_drop, run_dir, scratch, settle


def listed(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName().partition("-")[0] for f in files.listStatus(path)} if files.exists(path) else set()


def test_scratch_leaves_only_lasting_work(spark):
    with scratch(spark):
        first = settle(spark.range(5), "gone1")
        with scratch(spark):
            settle(spark.range(2), "gone2")
            inner = settle(first.filter("id > 1"), "inner", lasting=True)
        kept = settle(inner, "kept1", lasting=True)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4]
    assert "kept1" in listed(spark) and not {"gone1", "gone2", "inner", "scratch"} & listed(spark)


def test_scratch_is_deleted_when_a_step_fails(spark):
    try:
        with scratch(spark):
            settle(spark.range(3), "broken")
            raise KeyError
    except KeyError:
        pass
    assert not {"broken", "scratch"} & listed(spark)


def test_kept_tables_follow_the_files_and_the_work(spark, tmp_path):
    root, built = str(tmp_path), []
    spark.range(3).write.parquet(f"{root}/a.parquet")

    def build():
        built.append(1)
        return spark.read.parquet(f"{root}/a.parquet")

    count = lambda: base.shared(spark, root, "a", build).count()
    assert (count(), count(), len(built)) == (3, 3, 1)
    spark.range(4).write.mode("append").parquet(f"{root}/a.parquet")
    assert (count(), len(built)) == (7, 2)
    told = []
    on_drop(lambda: told.append(1))
    drop_work(spark)
    assert (count(), len(built), told) == (7, 3, [1])


def test_corpus_queries_that_cannot_be_imported_are_left_out(monkeypatch):
    monkeypatch.setitem(sys.modules, "twinside.llm.queries", None)
    assert __spark_entry__.corpus() == ({}, {})
    assert "A_06_form_last_n" in __spark_entry__.queries() and "op1_token_files" not in __spark_entry__.oracle_sql()


def test_settled_work_is_written_small(spark):
    """Spark's default leaves ids, which are hexadecimal texts, nearly as large as they are."""
    df = settle(spark.range(2_000).selectExpr("sha1(CAST(id AS STRING)) AS key"), "small")
    assert all(".zstd." in f for f in df.inputFiles()) and df.distinct().count() == 2_000
