"""Trees of many small files are read in few tasks, whole."""

from textloom.sources import text


def test_small_files_share_tasks(spark, tmp_path):
    (tmp_path / "pls" / "s").mkdir(parents=True)
    for k in range(600):
        (tmp_path / "pls" / "s" / f"{k}.txt").write_bytes(f"text {k}".encode() + b"\xff" * (k % 2))
    read = text.documents(spark, str(tmp_path), "pls")
    assert read.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    assert {(r.doc_id, r.text) for r in read.collect()} == {(str(k), f"text {k}") for k in range(600)}


def test_files_are_listed_on_executors_with_empty_ones(spark, tmp_path):
    for path in ("a.txt", "b/c.md", "b/d/e.md", "b/f.json", "b/_g.txt", ".h/i.txt", "j k/l%20.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * (len(path) % 2))
    read = text.read_texts(spark, str(tmp_path), text.TXT_OR_MD, "latin-1", required=True)
    assert "binaryFile" not in read._jdf.queryExecution().optimizedPlan().toString()
    names = ["a.txt", "b/c.md", "b/d/e.md", "j k/l%20.txt"]
    assert {(r.path, r.text) for r in read.collect()} == {(f"file:{tmp_path}/{n}", "x" * (len(n) % 2)) for n in names}
    assert {(r.path, r.size) for r in text.list_files(spark, str(tmp_path), text.TXT_OR_MD).collect()} == {(f"file:{tmp_path}/{n}", len(n) % 2) for n in names}
