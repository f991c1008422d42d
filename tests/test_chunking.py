import re
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from lodeseek.functions import chunking, hashing
from lodeseek.functions.chunking import definition_lists
from lodeseek.functions.hashing import token_vectors
from lodeseek.plans.oracle import CHUNKS, CODE_FILES

GOLDEN = [
    ("def \u0663x():\n    pass\n", [("function", "\u0663x", 1, 3)]),
    ("class \u00e9t\u00e9(A):\n    pass\n", [("class", "\u00e9t\u00e9", 1, 3)]),
    ("def\x1df():\n    pass\n\x1c\n", [("function", "f", 1, 4)]),
    ("class\u00e9 x\n", [("file", "t.py", 1, 2)]),
    ("def a():\n    return 1\n\ndef b():\n    return 2\n", [("function", "a", 1, 3), ("function", "b", 4, 6)]),
    (
        "class K:\n    def m(self):\n        pass\n\n    def n(self):\n        pass\nx = 1\n",
        [("class", "K", 1, 6)],
    ),
    ("def f(\n    a,\n) -> int:\n    return a\n", [("function", "f", 1, 2)]),
    ("async def q():\n    await z\n", [("file", "t.py", 1, 3)]),
    ("async def q():\n    def inner():\n        pass\n    y\n", [("function", "inner", 2, 3)]),
    ("@dec\ndef f():\n    pass\n", [("function", "f", 2, 4)]),
    ("def f():\n    pass\n# tail\n# tail2\nx=1\n", [("function", "f", 1, 4)]),
    ("class K:\n    a=1\n# note\n    b=2\n", [("class", "K", 1, 2)]),
    ("if X:\n\tdef f():\n\t\tpass\n\tdef g():\n\t\tpass\n", [("function", "f", 2, 6)]),
    (
        'def f():\n    """\ntext at col 0\n    """\n    return 1\n',
        [("function", "f", 1, 2)],
    ),
    ("x = 1\ny = 2\n", [("file", "t.py", 1, 3)]),
    (
        "    class In:\n        def m(self): pass\n    z = 1\ndef o(): pass",
        [("class", "In", 1, 3), ("function", "o", 4, 4)],
    ),
    ("def f(): pass", [("function", "f", 1, 1)]),
    ("  \n\t\n", []),
]


def chunk_all(spark, sources, language="python"):
    frame = spark.createDataFrame(list(enumerate(sources)), "id int, content string")
    chunks = chunking.chunks_of(F.col("content"), F.lit("pkg/t.py"), F.lit(language))
    found = {i: [] for i in range(len(sources))}
    rows = frame.select("id", F.posexplode(chunks).alias("pos", "c")).collect()
    for row in sorted(rows, key=lambda r: (r.id, r.pos)):
        found[row.id].append(row.c)
    return [found[i] for i in range(len(sources))]


def test_golden_cases(spark):
    for (_, expected), chunks in zip(GOLDEN, chunk_all(spark, [g[0] for g in GOLDEN])):
        assert [(c.chunk_type, c.name, c.start_line, c.end_line) for c in chunks] == expected


def test_content_is_the_line_range(spark):
    source = "import x\ndef a():\n    return 1\n\n\ndef b(): pass\n"
    chunks = chunk_all(spark, [source])[0]
    assert [c.content for c in chunks] == ["def a():\n    return 1\n\n", "def b(): pass\n"]


def test_other_languages_are_one_file_chunk(spark):
    chunks = chunk_all(spark, ["func f() {}\n\n"], "go")[0]
    assert [tuple(c) for c in chunks] == [("file", "t.py", "func f() {}\n\n", 1, 3)]


line_parts = st.tuples(
    st.sampled_from(["", " ", "    ", "        ", "\t", "\t\t", " \t", "     "]),
    st.sampled_from(
        ["", "def f(x):", "def  g (", "class K:", "class Two(A):", "# note", "x = 1", ")",
         "async def a():", "def f:", "@dec", "classy = 1"]
    ),
)
soups = st.lists(
    st.lists(line_parts.map("".join), min_size=0, max_size=25).map("\n".join),
    min_size=150,
    max_size=150,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(sources=soups)
def test_random_sources_match_the_rules(spark, sources):
    """The SQL form of the rules, which knows the ranges from joins, gives the same chunks."""
    connection = duckdb.connect()
    rows = pa.table({"doc_id": range(len(sources)), "content": sources})
    connection.register("sources", rows)
    given = """code_files AS (
      SELECT doc_id, doc_id::VARCHAR AS repo_name, 't.py' AS rel_path, 'python' AS language, content FROM sources
    )"""
    sql = CHUNKS.replace(CODE_FILES, given)
    assert sql != CHUNKS
    expected = connection.execute(
        f"WITH RECURSIVE {sql} SELECT repo_name::INT, chunk_type, name, start_line, end_line, content FROM chunks"
    ).fetchall()
    got = [
        (i, c.chunk_type, c.name, c.start_line, c.end_line, c.content)
        for i, chunks in enumerate(chunk_all(spark, sources))
        for c in chunks
    ]
    assert sorted(got) == sorted(expected)


def test_many_definitions_in_one_file(spark):
    source = "\n".join(f"def f{i}():\n    return {i}" for i in range(20000))
    chunks = chunk_all(spark, [source])[0]
    assert len(chunks) == 20000
    assert [c.name for c in chunks] == [f"f{i}" for i in range(20000)]
    assert all(c.end_line == c.start_line + 1 for c in chunks)


def test_plan_sends_batches_of_python_files_only(spark):
    frame = spark.createDataFrame([("x", "go")], "content string, language string")
    chunks = chunking.chunks_of(F.col("content"), F.lit("a.py"), F.col("language"))
    plan = plan_of(frame.select(F.explode(chunks)))
    assert "BatchEvalPython" not in plan and plan.count("ArrowEvalPython") == 1
    assert re.search(r"ArrowEvalPython \[find\(CASE WHEN", plan)


@pytest.mark.parametrize("kind", ["def", "class"])
def test_trailing_blank_lines_belong_to_the_chunk(spark, kind):
    source = f"{kind} a(): \n    x\n\n\n"
    chunks = chunk_all(spark, [source])[0]
    assert (chunks[0].start_line, chunks[0].end_line) == (1, 5)


def test_memory_beside_a_batch_is_bounded(monkeypatch):
    monkeypatch.setattr(hashing, "TOKENS_AT_ONCE", 1 << 15)
    monkeypatch.setattr(chunking, "BYTES_AT_ONCE", 1 << 15)

    # Twice the batch takes no more beside it.
    def peaks(rows):
        tokens = pa.array([[f"w{(i * 7 + n) % 900}" for n in range(400)] for i in range(rows)])
        texts = pa.array([f"def f{i}(x):\n    return {i}\n" * 10 for i in range(rows)])
        for work in (lambda: token_vectors(tokens, 64), lambda: definition_lists(texts)):
            tracemalloc.start()
            assert len(work()) == rows
            yield tracemalloc.get_traced_memory()[1] / 1e6
            tracemalloc.stop()

    few, many = list(peaks(500)), list(peaks(1000))
    assert many[0] < 1.3 * few[0] and many[1] < 1.3 * few[1]


def test_batches_in_parts_equal_whole_ones(monkeypatch):
    tokens = pa.array([["a", "b", "a"], None, [], ["c"] * 50, ["b"], []])
    texts = pa.array(["def f(x):\n    pass\ndef g(y):\n    pass", None, "", "x = 1", "class C:\n    pass"])
    whole = token_vectors(tokens, 8), definition_lists(texts)
    monkeypatch.setattr(hashing, "TOKENS_AT_ONCE", 2)
    monkeypatch.setattr(chunking, "BYTES_AT_ONCE", 2)
    assert token_vectors(tokens, 8).equals(whole[0]) and definition_lists(texts).equals(whole[1])
    assert [n and len(n) for n in whole[1].to_pylist()] == [2, None, [], [], 1]
    assert token_vectors(tokens.slice(3, 2), 8).equals(whole[0].slice(3, 2))
    assert len(token_vectors(tokens.slice(0, 0), 8)) == len(definition_lists(texts.slice(0, 0))) == 0
