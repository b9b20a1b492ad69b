from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.plans import pipeline
from credtrace.sources import corpus
from tests.cases import frame


def test_directory_scan(spark, tmp_path):
    files = {
        "app.py": b"a = 1\r\nb = 2\r\n", "sub/Dockerfile": b"FROM x\n", "sub/.env.local": b"A=1", "bad.py": b"x = '\xff\xfe'\n",
        "node_modules/x.js": b"var a;", "sub/Build/y.py": b"a", "photo.png": b"x", "empty.py": b"",
        "pkg/__init__.py": b"x = 1", ".ci/run.yml": b"a: 1",
        "nul.py": b"a\x00b", "big.py": b"x\n" * (C.MAX_FILE_SIZE // 2 + 1), "min.js": b"a" * 3000 + b"\n" + b"b" * 10 + b"\n",
        "extra/z.py": b"z", "long.py": b"\n" * 50001, "late.py": b"a" * 9000 + b"\x00"}
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = {r.file_path: r for r in corpus.scan_directory(spark, str(tmp_path), "s", "r", ["extra"]).collect()}
    assert set(rows) == {"app.py", "sub/Dockerfile", "sub/.env.local", "bad.py", "late.py", "pkg/__init__.py",
                         ".ci/run.yml"}
    assert rows["app.py"].content == "a = 1\nb = 2\n" and rows["app.py"].line_count == 3 and rows["app.py"].size == 14
    assert rows["bad.py"].content == "x = ''\n"
    assert (rows["sub/Dockerfile"].language, rows["sub/.env.local"].language) == ("Dockerfile", "Environment")


def test_uri_root_reads_what_a_plain_root_reads(spark, tmp_path):
    root = tmp_path / "build"
    for name in ("sub/a.py", ".env", "pkg/__init__.py", "node_modules/x.js", "build/b.py", "photo.png", ".ci/run.yml"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("a = 1")
    plain, uri = (sorted(tuple(r) for r in corpus.scan_directory(spark, x, "s", "r").collect()) for x in (str(root), f"file://{root}"))
    assert plain == uri and [r[2] for r in uri] == [".ci/run.yml", ".env", "pkg/__init__.py", "sub/a.py"]


def test_raised_limits_reach_the_scan(spark, tmp_path):
    (tmp_path / "big.py").write_text("x = 1\n" * 200000 + 'key = "ghp_' + "A1b2" * 9 + '"\n')
    files = corpus.scan_directory(spark, str(tmp_path), "s", "r", max_file_size=4 << 20, max_line_count=1 << 20)
    assert pipeline.baseline_scan(files).count() >= 1
    assert corpus.scan_directory(spark, str(tmp_path), "s", "r").isEmpty()


def test_text_tables_are_taken_whole_and_where_they_are(spark):
    documents = corpus.documents(spark, "/root/testdata/sf0.001")
    assert documents.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert "Exchange" not in documents._jdf.queryExecution().executedPlan().toString()
    assert pipeline.full_scan(documents)._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1


def test_lines_and_summary(spark):
    df = frame(spark, {"a.py": "x\n\n", "b.js": "y"})
    assert sorted((r.file_path, r.line_no, r.line) for r in corpus.lines(df).collect()) == [
        ("src/a.py", 1, "x"), ("src/a.py", 2, ""), ("src/a.py", 3, ""), ("src/b.js", 1, "y")]
    row = corpus.file_summary(df).first()
    assert (row.total_files, row.total_lines, row.total_bytes, row.languages) == (2, 4, 4, {"Python": 1, "JavaScript": 1})


def test_minified(spark):
    df = spark.createDataFrame([("a" * 1600 + "\n\n",), ("a" * 1500 + "\n\n",), ("a" * 9000,)], "t string")
    assert [r[0] for r in df.select(corpus.is_minified(F.col("t"))).collect()] == [True, False, False]
