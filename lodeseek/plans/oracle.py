"""The registered queries once more, as SQL over the given tables (DuckDB dialect).

Written from the meaning of each operator, not from its Spark plan: chunk ranges come
from a self-join and a recursive walk, vectors from a relational count of tokens.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the engine does not pass.
DIRECTORIES = [
    "src", "lib/core", "docs", "app", "pkg/x", "tests", "node_modules/a", ".git", "__pycache__",
    ".venv/lib", "venv", "dist", "build", ".next", ".cache/y", "pkg/vendor/x", "target",
]
ENDINGS = [
    ".py", ".js", ".go", ".md", ".txt", ".PY", ".tsx", ".ts", ".jsx", ".py", ".rs", ".java",
    ".cpp", ".c", ".h", ".rb", ".php", ".sql", ".sh",
]
SKIPPED_DIRECTORIES = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".cache",
    "vendor", "target",
]
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".cpp": "cpp", ".c": "c",
    ".h": "c", ".rb": "ruby", ".php": "php", ".sql": "sql", ".sh": "bash", ".md": "markdown",
}
BATCH_SIZES = {"view": 1, "click": 4, "purchase": 8, "signup": 16, "error": 32}
WORKERS = {"view": 1, "click": 2, "purchase": 4, "signup": 8, "error": 16}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(values: dict[str, object], column: str) -> str:
    cases = " ".join(
        f"WHEN '{k}' THEN {v!r}" if isinstance(v, str) else f"WHEN '{k}' THEN {v}"
        for k, v in values.items()
    )
    return f"CASE {column} {cases} END"


def _extension(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/](\.[^./]+)$', 1))"


LF = "chr(10)"

FILES = f"""
files AS (
  SELECT doc_id, lang, source AS repo_name, text AS content,
         {_list(DIRECTORIES)}[(doc_id % {len(DIRECTORIES)} + 1)::INT] || '/doc_' || doc_id
         || {_list(ENDINGS)}[(doc_id % {len(ENDINGS)} + 1)::INT] AS rel_path
  FROM documents
)"""


def _python(text: str, number: str) -> str:
    return f"""array_to_string(list_transform(string_split({text}, {LF}), lambda line, i:
      CASE ({number} * 7 + (i - 1) * 3) % 11
        WHEN 0 THEN 'def f' || (i - 1) || '(x):'
        WHEN 1 THEN 'class C' || (i - 1) || ':'
        WHEN 2 THEN '    def m' || (i - 1) || '(self):'
        WHEN 3 THEN '# note'
        WHEN 4 THEN ''
        WHEN 5 THEN chr(9) || 'y = 1'
        WHEN 6 THEN 'x = 2'
        ELSE '    ' || line END), {LF})"""


CODE_FILES = f"""{FILES},
coded AS (
  SELECT *, {_map(LANGUAGE_BY_EXTENSION, _extension("rel_path"))} AS language FROM files
),
code_files AS (
  SELECT doc_id, repo_name, rel_path, language,
         CASE WHEN language = 'python' THEN {_python("content", "doc_id")} ELSE content END
           AS content
  FROM coded WHERE language IS NOT NULL
)"""


def _definitions(source: str) -> str:
    """``definitions`` (doc_id, chunk_type, name, start_line, end_line, chunk) of a table
    ``source`` (doc_id, content) of Python files. Needs WITH RECURSIVE."""
    return rf"""
split AS (SELECT doc_id, string_split(content, {LF}) AS lines FROM {source}),
numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1)::INT AS n FROM split
),
described AS (
  SELECT doc_id, n,
         CASE WHEN regexp_matches(line, '^\s*def\s+\w+\s*\(') THEN 'function'
              WHEN regexp_matches(line, '^\s*class\s+\w+') THEN 'class' END AS kind,
         regexp_extract(line, '^\s*(?:def|class)\s+(\w+)', 1) AS name,
         length(regexp_extract(line, '^(\s*)', 1)) AS indent,
         length(line) - length(ltrim(line, ' ')) AS spaces,
         length(line) - length(ltrim(line, chr(9))) AS tabs,
         regexp_matches(line, '^\s*#') AS remark,
         regexp_matches(line, '\S') AS filled
  FROM numbered
),
spans AS (
  SELECT s.doc_id, s.n AS first, any_value(s.kind) AS kind, any_value(s.name) AS name,
         min(e.n) AS stop
  FROM described s LEFT JOIN described e
    ON e.doc_id = s.doc_id AND e.n > s.n AND e.filled
   AND CASE WHEN s.kind = 'function'
            THEN e.spaces <= s.indent AND e.tabs <= s.indent // 4 AND NOT e.remark
            ELSE e.spaces = 0 AND e.tabs = 0 END
  WHERE s.kind IS NOT NULL
  GROUP BY s.doc_id, s.n
),
follow AS (
  SELECT a.doc_id, a.first, any_value(a.kind) AS kind, any_value(a.name) AS name,
         any_value(a.stop) AS stop, min(b.first) AS next
  FROM spans a LEFT JOIN spans b ON b.doc_id = a.doc_id AND b.first >= a.stop
  GROUP BY a.doc_id, a.first
),
walk AS (
  SELECT f.* FROM follow f
  JOIN (SELECT doc_id, min(first) AS first FROM spans GROUP BY doc_id) m USING (doc_id, first)
  UNION ALL
  SELECT f.* FROM walk w JOIN follow f ON f.doc_id = w.doc_id AND f.first = w.next
),
definitions AS (
  SELECT w.doc_id, w.kind AS chunk_type, w.name, w.first::INT AS start_line,
         coalesce(w.stop - 1, len(s.lines))::INT AS end_line,
         array_to_string(
           list_slice(s.lines, w.first, coalesce(w.stop - 1, len(s.lines))), {LF}) AS chunk
  FROM walk w JOIN split s USING (doc_id)
)"""


# Chunks of the code files, as the index holds them.
CHUNKS = f"""{CODE_FILES},
python_files AS (SELECT doc_id, content FROM code_files WHERE language = 'python'),
{_definitions("python_files")},
chunks AS (
  SELECT f.repo_name, f.rel_path AS file_path, d.chunk_type, d.name, d.chunk AS content,
         d.start_line, d.end_line, f.language
  FROM code_files f JOIN definitions d USING (doc_id)
  UNION ALL
  SELECT f.repo_name, f.rel_path, 'file', regexp_extract(f.rel_path, '[^/]+$'),
         f.content, 1, len(string_split(f.content, {LF}))::INT, f.language
  FROM code_files f
  WHERE f.doc_id NOT IN (SELECT doc_id FROM definitions) AND regexp_matches(f.content, '\\S')
),
chunk_texts AS (
  SELECT *, CASE WHEN chunk_type IN ('function', 'class')
                 THEN language || ' ' || chunk_type || ' ' || name || ': '
                 ELSE file_path || ': ' END || substr(content, 1, 500) AS plain
  FROM chunks
)"""


def _tokens(text: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'),"
        " lambda w: w <> '')"
    )


def _vectors(name: str, source: str, id_: str, text: str, dims: int) -> str:
    """``name`` (id, dim, x): non-zero components of hashed unit vectors, as float32."""
    return f"""
{name}_hashed AS (
  SELECT {id_} AS id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h
  FROM (SELECT {id_}, unnest({_tokens(text)}) AS w FROM {source})
),
{name}_counts AS (
  SELECT id, h % {dims} AS dim, sum(CASE WHEN (h // {dims}) % 2 = 0 THEN 1 ELSE -1 END) AS c
  FROM {name}_hashed GROUP BY ALL
),
{name} AS (
  SELECT id, dim, (c / sqrt(sum(c * c) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x
  FROM {name}_counts WHERE c <> 0
)"""


def _similarities(name: str, documents: str, queries: str, all_documents: str) -> str:
    """``name`` (query_id, id, similarity) for all pairs; unrelated texts have 0."""
    return f"""
{name}_dots AS (
  SELECT q.id AS query_id, d.id AS id, sum(q.x * d.x) AS dot
  FROM {queries} q JOIN {documents} d USING (dim) GROUP BY ALL
),
{name}_query_norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM {queries} GROUP BY id),
{name}_document_norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM {documents} GROUP BY id),
{name} AS (
  SELECT qn.id AS query_id, a.id AS id,
         round(CASE WHEN dn.norm IS NULL THEN NULL
                    ELSE coalesce(s.dot, 0) / (qn.norm * dn.norm) END, 9) + 0.0 AS similarity
  FROM {name}_query_norms qn CROSS JOIN {all_documents} a
  LEFT JOIN {name}_document_norms dn ON dn.id = a.id
  LEFT JOIN {name}_dots s ON s.query_id = qn.id AND s.id = a.id
)"""


ORACLE: dict[str, str] = {}


ORACLE["search_chunks"] = f"""
WITH RECURSIVE {CHUNKS},
index_texts AS (
  SELECT *, row_number() OVER (ORDER BY repo_name, file_path, chunk_type, name, start_line) AS id
  FROM chunk_texts
),
{_vectors("stored", "index_texts", "id", "'passage: ' || plain", 1024)},
{_vectors("asked", "benchmark", "item_id", "'query: ' || text", 1024)},
{_similarities("scored", "stored", "asked", "(SELECT id FROM index_texts)")},
ranked AS (
  SELECT query_id, id, similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM scored
)
SELECT r.query_id, t.repo_name, t.file_path, t.chunk_type, t.name, t.start_line,
       round(r.similarity, 6) AS similarity, r.rank::INT AS rank
FROM ranked r JOIN index_texts t USING (id) WHERE r.rank <= 5
"""

_WINDOWS = f"""{CHUNKS},
index_texts AS (
  SELECT *, row_number() OVER (ORDER BY repo_name, file_path, chunk_type, name, start_line) AS id
  FROM chunk_texts
),
windows AS (
  SELECT id, w, CASE WHEN chunk_type IN ('function', 'class')
                     THEN language || ' ' || chunk_type || ' ' || name || ': '
                     ELSE file_path || ': ' END || substr(content, 400 * w + 1, 500) AS plain
  FROM (SELECT *, unnest(generate_series(0, ceil(greatest(length(content) - 500, 0) / 400)::BIGINT)) AS w
        FROM index_texts)
),
numbered_windows AS (SELECT *, row_number() OVER (ORDER BY id, w) AS part FROM windows),
{_vectors("stored", "numbered_windows", "part", "'passage: ' || plain", 1024)},
{_vectors("asked", "benchmark", "item_id", "'query: ' || text", 1024)},
{_similarities("scored", "stored", "asked", "(SELECT part AS id FROM numbered_windows)")},
nearest AS (
  SELECT s.query_id, n.id, max(s.similarity) AS similarity
  FROM scored s JOIN numbered_windows n ON n.part = s.id GROUP BY ALL
)"""

ORACLE["search_windows"] = f"""
WITH RECURSIVE {_WINDOWS},
ranked AS (
  SELECT query_id, id, similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM nearest
)
SELECT r.query_id, t.repo_name, t.file_path, t.chunk_type, t.name, t.start_line,
       round(r.similarity, 6) AS similarity, r.rank::INT AS rank
FROM ranked r JOIN index_texts t USING (id) WHERE r.rank <= 5
"""

ORACLE["filtered_windows"] = f"""
WITH RECURSIVE {_WINDOWS},
ranked AS (
  SELECT query_id, id, similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM nearest JOIN index_texts USING (id)
  WHERE chunk_type = 'file' AND (query_id % 2 = 1 OR language = 'markdown')
)
SELECT r.query_id, t.repo_name, t.file_path, t.chunk_type, t.name, t.start_line,
       round(r.similarity, 6) AS similarity, r.rank::INT AS rank
FROM ranked r JOIN index_texts t USING (id) WHERE r.rank <= 3
"""

_WHOLE_DOCUMENTS = f"""
{_vectors("stored", "documents", "doc_id", "text", 384)},
{_vectors("asked", "benchmark", "item_id", "text", 384)},
{_similarities("scored", "stored", "asked", "(SELECT doc_id AS id FROM documents)")}"""

ORACLE["multi_query_topk"] = f"""
WITH {_WHOLE_DOCUMENTS},
ranked AS (
  SELECT query_id, id AS doc_id, similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM scored
)
SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank::INT AS rank
FROM ranked WHERE rank <= 3
"""

ORACLE["filtered_multi_query"] = f"""
WITH {_WHOLE_DOCUMENTS},
ranked AS (
  SELECT query_id, id AS doc_id, similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM scored JOIN documents ON doc_id = id
  WHERE query_id % 3 = 0 OR source = 'src' || (query_id % 20)
)
SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank::INT AS rank
FROM ranked WHERE rank <= 2
"""

ORACLE["cosine_topk"] = """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
scored AS (
  SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s
  FROM embeddings, q
)
SELECT vec_id, label, round(s, 6) AS similarity,
       row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank
FROM scored ORDER BY s DESC, vec_id LIMIT 10
"""

ORACLE["filtered_topk"] = f"""
WITH RECURSIVE {CHUNKS},
index_texts AS (
  SELECT *, row_number() OVER (ORDER BY repo_name, file_path, chunk_type, name, start_line) AS id
  FROM chunk_texts
  WHERE repo_name = 'src3' AND language = 'markdown' AND chunk_type = 'file'
),
first_item AS (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 1),
{_vectors("stored", "index_texts", "id", "'passage: ' || plain", 1024)},
{_vectors("asked", "first_item", "item_id", "'query: ' || text", 1024)},
{_similarities("scored", "stored", "asked", "(SELECT id FROM index_texts)")}
SELECT t.file_path, t.name, t.start_line, t.end_line, round(s.similarity, 6) AS similarity
FROM scored s JOIN index_texts t USING (id)
ORDER BY s.similarity DESC NULLS LAST, id LIMIT 10
"""

ORACLE["dot_rank"] = f"""
WITH first_item AS (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 1),
{_vectors("stored", "documents", "doc_id", "text", 384)},
{_vectors("asked", "first_item", "item_id", "text", 384)},
dots AS (
  SELECT d.id, sum(q.x * d.x) AS dot FROM asked q JOIN stored d USING (dim) GROUP BY d.id
),
scored AS (
  SELECT doc_id, round(coalesce(dot, 0), 9) + 0.0 AS s
  FROM documents LEFT JOIN dots ON id = doc_id
)
SELECT doc_id AS position, round(s, 6) AS score,
       row_number() OVER (ORDER BY s DESC, doc_id)::BIGINT AS rank
FROM scored
"""

_CELLS = """
parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
         generate_subscripts(embedding, 1) AS pos
  FROM embeddings
),
means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL),
centroids AS (
  SELECT label, list(m ORDER BY pos) AS c, row_number() OVER (ORDER BY label) - 1 AS cell
  FROM means GROUP BY label
),
scored AS (
  SELECT vec_id, cell, label AS query_id,
         round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS s
  FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN centroids
),
placed AS (
  SELECT vec_id, cell FROM scored
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) = 1
),
probed AS (
  SELECT a.label AS query_id, b.cell
  FROM centroids a CROSS JOIN centroids b
  QUALIFY row_number() OVER (
    PARTITION BY a.label ORDER BY round(list_cosine_similarity(a.c, b.c), 9) DESC, b.cell) <= 2
),
near AS (
  SELECT s.query_id, s.vec_id, s.s,
         row_number() OVER (PARTITION BY s.query_id ORDER BY s.s DESC, s.vec_id) AS rank
  FROM scored s JOIN placed p USING (vec_id)
  JOIN probed b ON b.query_id = s.query_id AND b.cell = p.cell
),
truth AS (
  SELECT query_id, vec_id,
         row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
  FROM scored
)"""

ORACLE["ann_topk"] = f"""
WITH {_CELLS}
SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM near WHERE rank <= 10
"""

ORACLE["stored_cells"] = f"""
WITH {_CELLS},
wanted AS (
  SELECT s.query_id, s.vec_id, s.s,
         row_number() OVER (PARTITION BY s.query_id ORDER BY s.s DESC, s.vec_id) AS rank
  FROM scored s JOIN placed p USING (vec_id)
  JOIN probed b ON b.query_id = s.query_id AND b.cell = p.cell
  JOIN embeddings e ON e.vec_id = s.vec_id
  WHERE s.query_id % 2 = 1 OR s.query_id = 0 OR e.label = s.query_id
)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM wanted WHERE rank <= 10
"""

ORACLE["ann_recall"] = f"""
WITH {_CELLS}
SELECT t.query_id, round(count(n.vec_id) / count(*), 6) AS recall
FROM (SELECT * FROM truth WHERE rank <= 10) t
LEFT JOIN (SELECT * FROM near WHERE rank <= 10) n
  ON n.query_id = t.query_id AND n.vec_id = t.vec_id
GROUP BY t.query_id
"""

_CODES = f"""
{_CELLS.strip()},
unit_parts AS (
  SELECT vec_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM parts
),
centroid_parts AS (
  SELECT cell, label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m
  FROM means JOIN centroids USING (label)
),
rests AS (
  SELECT u.vec_id, p.cell, pos, x - m AS r
  FROM unit_parts u JOIN placed p USING (vec_id) JOIN centroid_parts c USING (cell, pos)
),
books AS (
  SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS code, pos, r AS b FROM rests
  WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 16)
),
codes AS (
  SELECT vec_id, any_value(cell) AS cell, (pos - 1) // 8 AS part, code, sum(b * b - 2 * r * b) AS d
  FROM rests JOIN books USING (pos) GROUP BY vec_id, (pos - 1) // 8, code
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY round(d, 9), code) = 1
),
tables AS (
  SELECT c.label AS query_id, (pos - 1) // 8 AS part, code, sum(m * b) AS t
  FROM centroid_parts c JOIN books USING (pos) GROUP BY ALL
),
bases AS (
  SELECT a.label AS query_id, b.cell, sum(a.m * b.m) AS base
  FROM centroid_parts a JOIN centroid_parts b USING (pos) GROUP BY ALL
),
three AS (
  SELECT a.label AS query_id, b.cell
  FROM centroids a CROSS JOIN centroids b
  QUALIFY row_number() OVER (
    PARTITION BY a.label ORDER BY round(list_cosine_similarity(a.c, b.c), 9) DESC, b.cell) <= 3
),
estimates AS (
  SELECT query_id, vec_id, round(any_value(base) + sum(t), 9) AS estimate
  FROM codes JOIN three USING (cell) JOIN tables USING (query_id, part, code) JOIN bases USING (query_id, cell)
  GROUP BY query_id, vec_id
),
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY estimate DESC, vec_id) AS rank FROM estimates
  QUALIFY rank <= 40
),
compared AS (
  SELECT query_id, vec_id, s.s, row_number() OVER (PARTITION BY query_id ORDER BY s.s DESC, vec_id) AS rank
  FROM (SELECT query_id, vec_id FROM candidates) JOIN scored s USING (query_id, vec_id) QUALIFY rank <= 10
)"""

ORACLE["pq_topk"] = f"""
WITH {_CODES}
SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM compared
"""

ORACLE["pq_candidates"] = f"""
WITH {_CODES}
SELECT query_id, vec_id, round(estimate, 6) AS estimate, rank::INT AS rank FROM candidates
"""

ORACLE["pq_recall"] = f"""
WITH {_CODES}
SELECT t.query_id, round(count(n.vec_id) / count(*), 6) AS recall
FROM (SELECT * FROM truth WHERE rank <= 10) t
LEFT JOIN compared n ON n.query_id = t.query_id AND n.vec_id = t.vec_id
GROUP BY t.query_id
"""


def _trained_cells(steps: int) -> str:
    """Centroids ``c`` by steps from the sixteen vectors with the smallest ids."""
    ctes = [
        "c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding::DOUBLE[] AS c"
        " FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id) <= 16)",
        "units AS (SELECT vec_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM parts)",
    ]
    for n in range(steps):
        ctes.append(
            f"a{n} AS (SELECT vec_id, cell FROM embeddings CROSS JOIN c{n} QUALIFY row_number() OVER ("
            "PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], c), 9) DESC, cell) = 1)"
        )
        ctes.append(
            f"m{n} AS (SELECT cell, pos, avg(x) AS m FROM units JOIN a{n} USING (vec_id) GROUP BY ALL)"
        )
        ctes.append(
            f"c{n + 1} AS (SELECT o.cell, coalesce(v.c, o.c) AS c FROM c{n} o LEFT JOIN ("
            f"SELECT cell, list(m ORDER BY pos) AS c FROM m{n} GROUP BY cell) v USING (cell))"
        )
    return ",\n".join(ctes)


ORACLE["ann_trained_recall"] = f"""
WITH parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
),
{_trained_cells(3)},
asked AS (
  SELECT label AS query_id, list(m ORDER BY pos) AS q
  FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label
),
placed AS (
  SELECT vec_id, cell FROM embeddings CROSS JOIN c3 QUALIFY row_number() OVER (
    PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], c), 9) DESC, cell) = 1
),
probed AS (
  SELECT query_id, cell FROM asked CROSS JOIN c3 QUALIFY row_number() OVER (
    PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, c), 9) DESC, cell) <= 4
),
scored AS (
  SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS s FROM embeddings CROSS JOIN asked
),
truth AS (
  SELECT query_id, vec_id FROM scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10
),
near AS (
  SELECT s.query_id, s.vec_id FROM scored s JOIN placed USING (vec_id) JOIN probed b
    ON b.query_id = s.query_id AND b.cell = placed.cell
  QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY s DESC, vec_id) <= 10
)
SELECT t.query_id, round(count(n.vec_id) / count(*), 6) AS recall
FROM truth t LEFT JOIN near n ON n.query_id = t.query_id AND n.vec_id = t.vec_id GROUP BY t.query_id
"""

_PARTS = """
parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
         (generate_subscripts(embedding, 1) - 1)::INT AS pos
  FROM embeddings
)"""

ORACLE["mean_pool"] = f"""
WITH {_PARTS}
SELECT label, pos,
       round(sum(x * coalesce(quality, 0)) / greatest(sum(coalesce(quality, 0)), 1e-9), 6) + 0.0
         AS mean
FROM parts LEFT JOIN labels ON doc_id = vec_id GROUP BY label, pos
"""

ORACLE["pool_tokens"] = f"""
WITH {_PARTS},
masked AS (
  SELECT vec_id, pos % 8 AS pos, x,
         (first_value(x) OVER (PARTITION BY vec_id, pos // 8 ORDER BY pos) > 0)::INT AS mask
  FROM parts
)
SELECT vec_id, pos::INT AS pos,
       round((sum(x * mask) / greatest(sum(mask), 1e-9))::FLOAT::DOUBLE, 6) + 0.0 AS value
FROM masked GROUP BY vec_id, pos
"""

ORACLE["pooled_or_mean"] = f"""
WITH {_PARTS},
means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL)
SELECT vec_id, p.pos, round(CASE WHEN doc_id IS NOT NULL THEN x ELSE m END, 6) AS value
FROM parts p JOIN means USING (label, pos) LEFT JOIN labels ON doc_id = vec_id
"""

ORACLE["l2_normalize"] = f"""
WITH {_PARTS}
SELECT vec_id, pos,
       round(coalesce(x * label / nullif(sqrt(sum(x * label * x * label)
         OVER (PARTITION BY vec_id)), 0), 0), 6) + 0.0 AS value
FROM parts
"""

ORACLE["cosine_pairs"] = f"""
WITH {_PARTS},
means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL),
sums AS (
  SELECT vec_id, sum(x * m) AS dot, sqrt(sum(x * x)) * sqrt(sum(m * m)) AS norms
  FROM parts JOIN means USING (label, pos) GROUP BY vec_id
)
SELECT vec_id, round(dot, 6) AS dot, round(dot / norms, 6) AS similarity,
       round(1 - dot / norms, 6) AS distance
FROM sums
"""

ORACLE["vector_text"] = """
WITH back AS (SELECT vec_id, embedding::VARCHAR::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, len(v)::INT AS dims, round(list_sum(v), 6) AS total FROM back
"""

ORACLE["dim_check"] = """
SELECT label, count(*) AS vectors,
       count(*) FILTER (label = 5) AS missing,
       count(*) FILTER (label <> 5 AND len(embedding) - (label = 3)::INT <> 64) AS wrong_dims
FROM embeddings GROUP BY label
"""

ORACLE["tokenize"] = f"""
WITH words AS (SELECT doc_id, {_tokens("text")} AS words FROM documents),
kept AS (SELECT doc_id, words, list_slice(words, 1, 256) AS kept FROM words)
SELECT doc_id, len(words)::INT AS n_tokens, len(kept)::INT AS n_kept,
       coalesce(list_sum(list_transform(kept,
         lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT)), 0)::BIGINT AS id_sum,
       256::INT AS n_padded, len(kept)::BIGINT AS mask_sum
FROM kept
"""

ORACLE["embed_hash"] = f"""
WITH {_vectors("stored", "documents", "doc_id", "text", 64)}
SELECT id AS doc_id, dim::INT AS dim, round(x, 6) AS value FROM stored
"""

ORACLE["embed_text"] = f"""
WITH RECURSIVE {CHUNKS}
SELECT file_path, start_line, 'passage: ' || plain AS e5_document,
       'query: ' || plain AS e5_query, plain AS minilm_document
FROM chunk_texts
"""

ORACLE["content_cap"] = """
SELECT doc_id, length(substr(text, 1, 10000))::INT AS n_chars,
       md5(substr(text, 1, 10000)) AS digest
FROM documents
"""

ORACLE["model_plugin"] = """
WITH counted AS (
  SELECT doc_id, contains(text, 'Licensed') AS refused,
         [length(text) - length(replace(text, 'a', '')),
          length(text) - length(replace(text, 'e', '')),
          length(text) - length(replace(text, 'i', '')),
          length(text) - length(replace(text, 'o', ''))]::DOUBLE[] AS c
  FROM documents
),
scaled AS (
  SELECT *, greatest(sqrt(c[1]*c[1] + c[2]*c[2] + c[3]*c[3] + c[4]*c[4]), 1e-9) AS norm
  FROM counted
)
SELECT doc_id, CASE WHEN refused THEN 'not embedded: a license line' END AS error,
       CASE WHEN NOT refused THEN round((c[1] / norm)::FLOAT::DOUBLE, 5) END AS v0,
       CASE WHEN NOT refused THEN round((c[2] / norm)::FLOAT::DOUBLE, 5) END AS v1,
       CASE WHEN NOT refused THEN round((c[3] / norm)::FLOAT::DOUBLE, 5) END AS v2,
       CASE WHEN NOT refused THEN round((c[4] / norm)::FLOAT::DOUBLE, 5) END AS v3
FROM scaled
"""

ORACLE["dense_score"] = f"""
WITH {_PARTS}
SELECT vec_id, round(sum(x * (1.0::DOUBLE / (pos + 1)))::FLOAT::DOUBLE, 6) AS score
FROM parts WHERE pos < 51 GROUP BY vec_id
"""

ORACLE["dedup_infer"] = f"""
SELECT doc_id, len({_tokens("text")})::INT AS n_tokens FROM documents
"""

ORACLE["cached_infer"] = f"""
SELECT doc_id, len({_tokens("text")})::INT AS n_tokens,
       text NOT IN (SELECT text FROM documents WHERE lang = 'en') AS fresh
FROM documents
"""

ORACLE["chunk_python"] = f"""
WITH RECURSIVE sources AS (
  SELECT doc_id, {_python("text", "doc_id")} AS content FROM documents
),
{_definitions("sources")}
SELECT doc_id, chunk_type, name, start_line, end_line, md5(chunk) AS digest FROM definitions
"""

ORACLE["chunk_file"] = f"""
WITH {FILES}
SELECT doc_id, 'file' AS chunk_type, regexp_extract(rel_path, '[^/]*$') AS name,
       1 AS start_line, len(string_split(content, {LF}))::INT AS end_line,
       length(content)::INT AS n_chars
FROM files
"""

ORACLE["chunk_fallback"] = f"""
WITH RECURSIVE {FILES},
sources AS (
  SELECT doc_id, rel_path,
         CASE WHEN lang = 'en' THEN {_python("content", "doc_id")} ELSE content END AS content
  FROM files
),
{_definitions("sources")},
firsts AS (
  SELECT doc_id, count(*) AS n, arg_min(chunk_type, start_line) AS chunk_type,
         arg_min(name, start_line) AS name, arg_min(end_line, start_line) AS end_line
  FROM definitions GROUP BY doc_id
)
SELECT s.doc_id,
       CASE WHEN f.n IS NOT NULL THEN f.n WHEN regexp_matches(content, '\\S') THEN 1 ELSE 0
         END::INT AS n_chunks,
       CASE WHEN f.n IS NOT NULL THEN f.chunk_type
            WHEN regexp_matches(content, '\\S') THEN 'file' END AS first_type,
       CASE WHEN f.n IS NOT NULL THEN f.name
            WHEN regexp_matches(content, '\\S') THEN regexp_extract(rel_path, '[^/]*$')
         END AS first_name,
       CASE WHEN f.n IS NOT NULL THEN f.end_line
            WHEN regexp_matches(content, '\\S') THEN len(string_split(content, {LF}))
         END::INT AS first_end
FROM sources s LEFT JOIN firsts f USING (doc_id)
"""

ORACLE["ext_language"] = f"""
WITH {FILES},
paths AS (
  SELECT 'page' AS kind, page_id AS id, url AS path FROM pages
  UNION ALL SELECT 'file', doc_id, rel_path FROM files
)
SELECT kind, id, {_extension("path")} AS extension,
       {_map(LANGUAGE_BY_EXTENSION, _extension("path"))} AS language
FROM paths
"""

ORACLE["skip_dirs"] = f"""
WITH {FILES},
coded AS (
  SELECT doc_id, rel_path, {_map(LANGUAGE_BY_EXTENSION, _extension("rel_path"))} AS language
  FROM files
)
SELECT * FROM coded
WHERE language IS NOT NULL
  AND NOT list_has_any(string_split(rel_path, '/'), {_list(SKIPPED_DIRECTORIES)})
"""

ORACLE["blank_filter"] = """
SELECT doc_id, lang FROM documents
WHERE regexp_matches(
  CASE WHEN lang = 'de' THEN regexp_replace(text, '[^ \\n]', '', 'g') ELSE text END, '\\S')
"""

ORACLE["lenient_read"] = f"""
WITH decoded AS (
  SELECT doc_id,
         CASE WHEN doc_id % 2 = 0 THEN '(' || text || chr(65533) || {LF} ELSE text END AS t
  FROM documents
)
SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM decoded
"""

ORACLE["manifest_semi"] = f"""
WITH {FILES}
SELECT doc_id, repo_name, rel_path FROM files f
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1)
"""

ORACLE["exclude_repositories"] = """
SELECT source AS repo_name, count(*) AS files FROM documents
WHERE source NOT IN ('src3', 'src7') GROUP BY source
"""

_NOT_SKIPPED = f"NOT list_has_any(string_split(rel_path, '/'), {_list(SKIPPED_DIRECTORIES)})"

_TREE = f"""{FILES},
coded AS (
  SELECT *, {_map(LANGUAGE_BY_EXTENSION, _extension("rel_path"))} AS language FROM files
),
tree AS (
  SELECT doc_id, repo_name, rel_path, language,
         CASE WHEN language = 'python' THEN {_python("content", "doc_id")} ELSE content END AS content
  FROM coded WHERE {_NOT_SKIPPED}
)"""

ORACLE["tree_files"] = f"""
WITH {_TREE}
SELECT repo_name, rel_path, octet_length(encode(content)) AS size, false AS failed FROM tree
"""

ORACLE["tree_reads"] = f"""
WITH {_TREE}
SELECT repo_name, rel_path, toxic IS NOT NULL AS failed,
       CASE WHEN toxic IS NULL THEN octet_length(encode(content)) END AS n_bytes
FROM tree LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) USING (doc_id) WHERE language IS NOT NULL
"""

ORACLE["tree_counters"] = f"""
WITH RECURSIVE {CHUNKS}
SELECT (SELECT count(*) FROM code_files
        WHERE {_NOT_SKIPPED} AND repo_name NOT IN ('src3', 'src7') AND regexp_matches(content, '\\S')) AS files,
       count(*) AS chunks, 0::BIGINT AS failed
FROM (SELECT *, file_path AS rel_path FROM chunks)
WHERE {_NOT_SKIPPED} AND repo_name NOT IN ('src3', 'src7')
"""

ORACLE["refreshed_index"] = f"""
WITH RECURSIVE {CHUNKS}
SELECT c.repo_name, c.file_path, c.chunk_type, c.name, c.start_line, c.end_line, false AS failed,
       md5(substr(CASE WHEN l.doc_id IS NOT NULL AND c.language <> 'python' THEN 'v2: ' ELSE '' END
                  || c.content, 1, 10000)) AS digest
FROM chunks c JOIN files f ON f.rel_path = c.file_path LEFT JOIN labels l USING (doc_id)
WHERE {_NOT_SKIPPED}
UNION ALL
SELECT source, 'lib/gone_' || doc_id || '.go', NULL, NULL, NULL, NULL, true, NULL
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
"""

ORACLE["decoded_values"] = """
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN length(text) END::INT AS n_chars,
       CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS digest, doc_id::VARCHAR AS number
FROM documents
"""

_STORED = f"""{FILES},
stored AS (
  SELECT doc_id, repo_name, rel_path AS file_path, 'file' AS chunk_type,
         regexp_extract(rel_path, '[^/]*$') AS name, content, 1 AS start_line,
         len(string_split(content, {LF}))::INT AS end_line, lang AS language,
         1704067200 + doc_id * 3600 AS indexed_at
  FROM files
)"""

_DIGESTED = """repo_name, file_path, chunk_type, name, start_line, md5(content) AS digest,
       end_line, language, indexed_at"""

ORACLE["index_upsert"] = f"""
WITH {_STORED},
merged AS (
  SELECT s.* REPLACE (
    CASE WHEN l.doc_id IS NULL THEN s.content ELSE 'v2: ' || s.content END AS content,
    CASE WHEN l.doc_id IS NULL THEN s.indexed_at ELSE 1735689600 END AS indexed_at)
  FROM stored s LEFT JOIN labels l USING (doc_id)
  UNION ALL
  SELECT page_id, 'web', url, 'file', NULL, html, 1, 1, 'html', 1735689600 FROM pages
)
SELECT {_DIGESTED} FROM merged
"""

ORACLE["index_replace"] = f"""
WITH {_STORED},
merged AS (
  SELECT * FROM stored WHERE repo_name NOT IN ('src3', 'src7')
  UNION ALL
  SELECT s.* REPLACE ('v2: ' || s.content AS content)
  FROM stored s WHERE repo_name = 'src3' AND doc_id IN (SELECT doc_id FROM labels)
)
SELECT {_DIGESTED} FROM merged
"""

ORACLE["stored_upsert"] = ORACLE["index_upsert"]
ORACLE["stored_replace"] = ORACLE["index_replace"]

ORACLE["stored_search"] = f"""
WITH {_STORED.replace("stored AS (", "kept AS (")},
{_WHOLE_DOCUMENTS.strip()},
ranked AS (
  SELECT query_id, file_path, similarity, content,
         row_number() OVER (PARTITION BY query_id
                            ORDER BY similarity DESC NULLS LAST, repo_name, file_path) AS rank
  FROM scored JOIN kept ON doc_id = scored.id
)
SELECT query_id, rank::INT AS rank, file_path, round(similarity, 6) AS similarity,
       md5(content) AS digest
FROM ranked WHERE rank <= 3
"""

ORACLE["stored_cells_search"] = f"""
WITH {_STORED.replace("stored AS (", "kept AS (")},
{_WHOLE_DOCUMENTS.strip()},
centres AS (
  SELECT dense_rank() OVER (ORDER BY id) - 1 AS id, dim, x FROM stored
  WHERE id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 8)
),
{_similarities("to_centres", "stored", "centres", "(SELECT doc_id AS id FROM documents)")},
{_similarities("to_asked", "centres", "asked", "(SELECT DISTINCT id FROM centres)")},
placed AS (
  SELECT id, query_id AS cell FROM to_centres WHERE similarity IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, query_id) = 1
),
probed AS (
  SELECT query_id, id AS cell FROM to_asked
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 2
),
ranked AS (
  SELECT s.query_id, file_path, s.similarity, content,
         row_number() OVER (PARTITION BY s.query_id
                            ORDER BY s.similarity DESC NULLS LAST, repo_name, file_path) AS rank
  FROM scored s JOIN placed p ON p.id = s.id JOIN probed b ON b.query_id = s.query_id AND b.cell = p.cell
  JOIN kept ON doc_id = s.id
)
SELECT query_id, rank::INT AS rank, file_path, round(similarity, 6) AS similarity,
       md5(content) AS digest
FROM ranked WHERE rank <= 3
"""

ORACLE["reconcile_contents"] = f"""
WITH {_STORED}
SELECT 'one' AS model, repo_name, file_path, chunk_type, name, start_line,
       CASE WHEN toxic = 1 THEN 'only first' ELSE 'changed' END AS difference,
       1::BIGINT AS first_count, CASE WHEN toxic = 1 THEN 0 ELSE 1 END::BIGINT AS second_count
FROM stored JOIN labels USING (doc_id)
UNION ALL
SELECT 'one', 'web', url, 'file', NULL, 1, 'only second', 0, count(*) FROM pages GROUP BY url
"""

ORACLE["index_summary"] = """
SELECT source AS repo_name, count(*) AS chunks,
       (DATE '2024-01-01' + (max(doc_id) // 24)::INT)::DATE AS indexed_on
FROM documents GROUP BY source
"""

ORACLE["index_total"] = f"""
WITH RECURSIVE {CHUNKS} SELECT count(*) AS chunks FROM chunks
"""

ORACLE["reconcile"] = """
SELECT source AS repo_name, count(*) AS first_count,
       count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS second_count,
       count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS difference
FROM documents GROUP BY source
"""

ORACLE["result_format"] = f"""
WITH {_STORED},
hits AS (
  SELECT doc_id, repo_name, file_path, CASE WHEN language <> 'fr' THEN name END AS name,
         end_line, content, (doc_id * 37 % 1301) / 1000.0::DOUBLE - 0.3::DOUBLE AS sim
  FROM stored
),
parts AS (
  SELECT *, trunc(sim * 20)::INT AS n,
         CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END
           AS cut
  FROM hits
),
lined AS (SELECT *, string_split(cut, {LF}) AS lines FROM parts),
headed AS (
  SELECT *, '[' || printf('%.3f', sim) || '] ' || repeat('█', greatest(n, 0))
         || repeat('░', 20 - n) || {LF} || '  📁 ' || repo_name || '/' || file_path
         || coalesce(' :: file ' || name, '') || ' (L1-' || end_line || ')' AS heading
  FROM lined
)
SELECT doc_id, heading,
       heading || {LF}
       || array_to_string(list_transform(lines[1:8], lambda l: '  │ ' || l), {LF})
       || CASE WHEN len(lines) - 1 > 8
               THEN {LF} || '  │ ... (' || (len(lines) - 1 - 8) || ' more lines)' ELSE '' END
         AS shown
FROM headed
"""

ORACLE["parse_saved_responses"] = """
SELECT vec_id // 10 AS batch_id, (vec_id % 10)::INT AS position, len(embedding)::INT AS dims,
       round(list_sum(embedding::DOUBLE[]), 6) AS total
FROM embeddings
"""

ORACLE["latency_stats"] = f"""
WITH samples AS (
  SELECT {_map(BATCH_SIZES, "event_type")} AS batch_size, value AS v FROM events
  WHERE ts >= TIMESTAMP '2024-01-01 01:00:00'
)
SELECT batch_size::INT AS batch_size, count(v) AS iterations, round(avg(v), 6) AS mean_ms,
       round(quantile_cont(v, 0.5), 6) AS median_ms, round(quantile_cont(v, 0.95), 6) AS p95_ms,
       round(quantile_cont(v, 0.99), 6) AS p99_ms, round(min(v), 6) AS min_ms,
       round(max(v), 6) AS max_ms, round(batch_size * 1000.0::DOUBLE / avg(v), 6) AS throughput
FROM samples GROUP BY batch_size
"""

ORACLE["throughput_stats"] = f"""
WITH timed AS (
  SELECT {_map(WORKERS, "event_type")} AS workers, epoch_us(ts) AS s,
         epoch_us(ts) + round(value * 1000)::BIGINT AS e
  FROM events
)
SELECT workers::INT AS workers, count(*) AS total_requests, count(*) * 4 AS total_sentences,
       round((max(e) - min(s)) / 1e6, 6) AS total_time_sec,
       round(count(*) * 4 / ((max(e) - min(s)) / 1e6), 6) AS throughput,
       round(avg((e - s) / 1000.0::DOUBLE), 6) AS mean_latency_ms,
       round(quantile_cont((e - s) / 1000.0::DOUBLE, 0.95), 6) AS p95_latency_ms
FROM timed GROUP BY workers
"""

ORACLE["batch_throughput"] = """
WITH runs AS (
  SELECT event_type, count(*) // 16 AS batches, sum(value) / 1000.0::DOUBLE AS sec
  FROM events GROUP BY event_type
)
SELECT event_type, batches, batches * 16 AS encoded, round(batches * 16 / sec, 4) AS throughput,
       round(sec * 1000 / batches, 4) AS ms_per_batch
FROM runs
"""

ORACLE["batch_grouping"] = """
SELECT source, doc_id,
       (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS batch
FROM documents
"""
