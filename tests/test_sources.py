import json
from pathlib import Path

from pyspark.sql import functions as F

from lodeseek.functions import text
from lodeseek.sources.repositories import (
    indexable,
    list_tree,
    read_files,
    scan_tree,
)
from lodeseek.sources.responses import parse_responses, response_errors


def tree(tmp_path, files):
    for path, content in files.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path)


FILES = {
    "alpha/src/a.py": "def a(): pass\n",
    "alpha/src/B.PY": "x = 1\n",
    "alpha/node_modules/m.js": "skip",
    "alpha/deep/build/x/y.go": "skip",
    "alpha/.py": "skip: no suffix",
    "alpha/notes.txt": "skip: unknown",
    "alpha/blank.md": " \n\t ",
    "alpha/sp ace/ü#%41.ts": "let a",
    "beta/x.tar.sh": "echo\r\nhi\rthere",
    "beta/builder/k.rs": "fn main() {}",
    "gone/z.c": "int z;",
    "beta/pkg/__init__.py": "import os",
    "beta/.github/deep/er/.hook.sh": "exit 0",
    "toplevel.py": "x",
}


def test_scan_of_several_repositories(spark, tmp_path):
    # The root itself lies below a directory with a skipped name.
    root = tree(tmp_path / "build" / "my root", FILES)
    rows = scan_tree(spark, root, exclude=["gone"]).collect()
    assert {(r.repo_name, r.rel_path, r.language) for r in rows} == {
        ("alpha", "src/a.py", "python"),
        ("alpha", "src/B.PY", "python"),
        ("alpha", "sp ace/ü#%41.ts", "typescript"),
        ("beta", "x.tar.sh", "bash"),
        ("beta", "builder/k.rs", "rust"),
        ("beta", "pkg/__init__.py", "python"),
        ("beta", ".github/deep/er/.hook.sh", "bash"),
    }
    assert {r.content for r in rows if r.rel_path == "x.tar.sh"} == {"echo\nhi\nthere"}


def test_scan_of_one_repository_and_manifest(spark, tmp_path):
    root = tree(tmp_path, FILES)
    manifest = spark.createDataFrame([("one", "alpha/src/a.py"), ("two", "beta/x.tar.sh")],
                                     "repo_name string, rel_path string")
    rows = scan_tree(spark, root, "one", manifest).collect()
    assert [(r.repo_name, r.rel_path) for r in rows] == [("one", "alpha/src/a.py")]


def test_listing_enters_no_skipped_or_linked_directory(spark, tmp_path):
    root = tree(tmp_path, FILES)
    (tmp_path / "alpha/loop").symlink_to(tmp_path / "alpha")
    listed = {f"{r.repo_name}/{r.rel_path}": r.size for r in list_tree(spark, root).collect()}
    visible = [p for p in FILES if "node_modules" not in p and "/build/" not in p and "/" in p]
    assert listed == {p: len(FILES[p].encode()) for p in visible}
    below_file_url = {f"{r.repo_name}/{r.rel_path}" for r in list_tree(spark, f"file://{root}").collect()}
    assert below_file_url == set(visible)


def test_unreadable_files_have_an_error(spark, tmp_path):
    root = tree(tmp_path, FILES)
    listing = indexable(list_tree(spark, root)).withColumn(
        "size", F.when(F.col("rel_path") == "z.c", F.lit(2**31)).otherwise(F.col("size"))
    )
    files = read_files(listing, root, False)
    (tmp_path / "alpha/src/a.py").unlink()
    rows = {r.rel_path: r for r in files.collect()}
    assert "more than a row can hold" in rows["z.c"].error
    assert rows["src/a.py"].content is None and rows["src/a.py"].error
    assert rows["src/B.PY"].error is None and bytes(rows["src/B.PY"].content) == b"x = 1\n"


def test_reading_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodeseek.sources.repositories.BATCH_BYTES", 10)
    root = tree(tmp_path, {f"r/f{i}.c": f"int x{i};" for i in range(50)})
    rows = scan_tree(spark, root).collect()
    assert {r.rel_path: r.content for r in rows} == {f"f{i}.c": f"int x{i};" for i in range(50)}


def test_lenient_decoding(spark):
    samples = [
        b"plain\r\nx\ry\n",
        b"a\xffb\xc3(c",
        b"cut \xe2\x82",
        "real \ufffd stays".encode(),
        b"\xed\xa0\x80surrogate \xf5",
        "both \ue0f1 \ue0f10 \ue0f11".encode() + b"\x80\xe2\x82" + "\ufffdend".encode(),
        b"\xef\xbb\xbfbom",
        b"",
    ]
    frame = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(samples)], "id int, content binary")
    rows = frame.select("id", text.lenient_utf8(F.col("content")).alias("t")).collect()
    got = {r.id: r.t for r in rows}
    for i, sample in enumerate(samples):
        expected = sample.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
        assert got[i] == expected


def test_blank_and_language_rules(spark):
    blanks = ["", " ", "\n\t\r", "\x1c\x1d\x1e\x1f", "\u00a0\u3000\x85", "a", " \u200b", "\ufeff", None]
    frame = spark.createDataFrame(list(enumerate(blanks)), "id int, t string")
    got = {r.id: r.b for r in frame.select("id", text.not_blank(F.col("t")).alias("b")).collect()}
    assert got == {i: bool(b and b.strip()) for i, b in enumerate(blanks)}

    paths = ["a.py", "A/B.TSX", ".py", "..py", "a.b/c", "x.", "x.tar.md", "d.go/e", "ab.h", "a.PY\n"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = {r.p: r.lang for r in frame.select("p", text.language_of(F.col("p")).alias("lang")).collect()}
    for path in paths:
        assert rows[path] == text.LANGUAGE_BY_EXTENSION.get(Path(path).suffix.lower()), path


def test_bytes_and_numbers_as_text(spark):
    frame = spark.createDataFrame([(bytearray("é".encode()), 7)], "b binary, n int")
    row = frame.select(text.decoded_text(F.col("b")), text.decoded_text(F.col("n"))).first()
    assert tuple(row) == ("é", "7")


def test_responses_of_both_shapes(spark):
    bodies = [
        (1, 2, json.dumps({"embeddings": [[1, 0.5], [2, 0.25]]})),
        (2, 2, json.dumps({"data": [{"index": 1, "embedding": [4, 4]}, {"index": 0, "embedding": [3, 3]}]})),
        (3, 1, json.dumps({"embeddings": [[1, 2, 3]]})),
        (4, 3, json.dumps({"embeddings": [[1, 2]]})),
        (5, 1, json.dumps({})),
    ]
    frame = spark.createDataFrame(bodies, "batch_id bigint, inputs int, body string")
    rows = parse_responses(frame.filter("batch_id < 3")).collect()
    assert sorted((r.batch_id, r.position, list(r.embedding)) for r in rows) == [
        (1, 0, [1.0, 0.5]), (1, 1, [2.0, 0.25]), (2, 0, [3.0, 3.0]), (2, 1, [4.0, 4.0]),
    ]
    errors = {r.batch_id: r.error for r in response_errors(frame, 2).collect()}
    assert errors == {
        1: None,
        2: None,
        3: "a vector has 3 components, not 2",
        4: "3 texts went in, 1 vectors came out",
        5: "1 texts went in, 0 vectors came out",
    }
