import pytest

from verdictlake.sources import readers
from verdictlake.streaming import submission_stream, windowed_status_counts

HEADER = "submission_id,problem_id,user_id,date,language,original_language,filename_ext,status,cpu_time,memory,code_size,accuracy\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "p1.csv").write_text(HEADER + "s1,p1,u1,1700000000,C++,C++,cpp,Accepted,10,20,30,1/1\ns2,p1,u1,1700000001,C++,C++,cpp,Wrong Answer,x,20,30,\n")
    (tmp_path / "p2.csv").write_text("h\n")
    (tmp_path / "list.csv").write_text("id,name,dataset\np2,B - x,Site\np1,A - y,Site\np3,C - z,Else\np4,D,\n")
    (tmp_path / "p1.html").write_text("Score <var>7</var>\nmore", encoding="utf-8")
    return str(tmp_path)


def test_submissions_pass_over_missing_and_header_only_files(spark, folder):
    rows = readers.load_submissions(spark, folder, ["p1", "p2", "absent"], ["problem_id", "status", "date"])
    assert sorted(r["status"] for r in rows.collect()) == ["Accepted", "Wrong Answer"]
    assert rows.dtypes == [("problem_id", "string"), ("status", "string"), ("date", "string")]
    assert len(readers.load_submissions(spark, folder, ["p1"], []).columns) == 12
    with pytest.raises(ValueError, match="2 submission files"):
        readers.load_submissions(spark, folder, ["p2", "absent"])


def test_columns_in_another_order_are_not_read_by_position(spark, tmp_path):
    (tmp_path / "p1.csv").write_text("problem_id,submission_id" + HEADER[len("submission_id,problem_id") :] + "p1,s1,u1,1700000000,C++,C++,cpp,Accepted,10,20,30,1/1\n")
    with pytest.raises(Exception, match="header"):
        readers.load_submissions(spark, str(tmp_path), ["p1"]).collect()


def test_corrupt_rows_are_counted(spark, folder):
    got = readers.corrupt_submissions(spark, folder, ["p1", "p2", "absent"]).collect()
    assert [tuple(r)[:3] for r in got] == [("p1", 2, 1)]
    assert readers.corrupt_submissions(spark, folder, ["absent"]).count() == 0


def test_a_folder_is_no_catalogue(spark, folder):
    with pytest.raises(ValueError, match="not one file"):
        readers.load_problem_list(spark, folder)


def test_catalogue_keeps_file_order_and_site(spark, folder):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "dataset")])
    rows = readers.load_problem_list(spark, f"{folder}/list.csv", schema).where("dataset = 'Site'").orderBy("source_pos").collect()
    assert [r["id"] for r in rows] == ["p2", "p1"]


def test_statements(spark, folder):
    got = readers.load_statements(spark, folder, ["p1", "p9"]).collect()
    assert [(r["problem_id"], r["html"].split("\n")[0]) for r in got] == [("p1", "Score <var>7</var>")]
    assert readers.load_statements(spark, folder, ["p9"]).count() == 0


def test_stream_counts_equal_the_batch(spark, tmp_path):
    data = spark.createDataFrame([(i, "a" if i % 3 else "b", "Accepted" if i % 2 else "Wrong Answer") for i in range(40)], "n long, problem_id string, status string").selectExpr(
        "problem_id", "status", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, n) as date"
    )
    labels = spark.createDataFrame([("a", "A"), ("b", "B")], "problem_id string, difficulty string")
    data.coalesce(2).write.parquet(f"{tmp_path}/in")
    stream = windowed_status_counts(submission_stream(spark, f"{tmp_path}/in", data.schema), labels)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("verdicts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from verdicts").collect()}
    assert got == {tuple(r) for r in windowed_status_counts(data, labels).collect()}
