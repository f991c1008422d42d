"""Schemas of the given tables and of the engine's own tables, as DDL."""

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ),
    "events": (
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double,"
        " props string"
    ),
    "documents": (
        "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ),
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

SOURCE_FILES = "repo_name string, rel_path string, content string, language string"

CHUNK_ARRAY = (
    "array<struct<chunk_type:string,name:string,content:string,start_line:int,end_line:int>>"
)

CHUNK_COLUMNS = [
    "repo_name",
    "file_path",
    "chunk_type",
    "name",
    "content",
    "start_line",
    "end_line",
    "language",
]

INDEX = (
    "file_path string, chunk_type string, name string, content string, start_line int,"
    " end_line int, embedding array<float>, language string, indexed_at timestamp,"
    " model string, repo_name string"
)
INDEX_COLUMNS = [
    "file_path",
    "chunk_type",
    "name",
    "content",
    "start_line",
    "end_line",
    "embedding",
    "language",
    "indexed_at",
    "model",
    "repo_name",
]

# The stored index has partition columns, which Spark puts last on reading. Those of a
# group are replaced together.
INDEX_GROUP = ["model", "repo_name", "bucket"]
INDEX_PARTITIONS = [*INDEX_GROUP, "cell"]
STORED_INDEX = INDEX + ", bucket string, cell string"

NATURAL_KEY = ["repo_name", "file_path", "chunk_type", "name", "start_line"]

# Longest values the store accepts, in characters (fixed values).
LENGTH_LIMITS = {
    "repo_name": 255,
    "file_path": 1024,
    "chunk_type": 50,
    "name": 255,
    "language": 50,
}

HIT_COLUMNS = CHUNK_COLUMNS + ["similarity"]

# The two shapes an embedding service answers in, merged into one schema.
EMBEDDING_RESPONSE = (
    "embeddings array<array<double>>, data array<struct<index:bigint,embedding:array<double>>>"
)
