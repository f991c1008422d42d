import hashlib
import random

import pytest
from llm_data import no_docs, odd_docs, odd_rows, prose

from pyspark.sql import functions as F

from lodeseek.llm.merkle import folded, leaf_hash, merkle_manifest, proof_hash, tampered_leaves


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(digests, fanout):
    """Root, and per leaf the (before, after) texts level by level."""
    paths, owners, nodes = [[] for _ in digests], [[n] for n in range(len(digests))], list(digests)
    while len(nodes) > 1:
        above, owned = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for slot in range(len(run)):
                for leaf in owners[at + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            above.append(sha("".join(run)))
            owned.append([leaf for part in owners[at : at + fanout] for leaf in part])
        nodes, owners = above, owned
    return nodes[0], paths


def brute_manifest(rows, fanout):
    """(id, leaf) -> (subroot, root, path) of rows (group, id, leaf)."""
    groups = {}
    for group, i, leaf in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(group, []).append((i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf for _, leaf in groups[g]], fanout) for g in names}
    root, above = brute_tree([trees[g][0] for g in names], fanout)
    found = []
    for g, top in zip(names, above):
        for (i, leaf), path in zip(groups[g], trees[g][1]):
            found.append((g, i, leaf, trees[g][0], root, path + top))
    return found


@pytest.mark.parametrize("fanout", [2, 3, 8])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 65, "b": 1, None: 9, "é": 64, "": 2}, {f"g{n}": 1 for n in range(9)}])
def test_manifest_equals_brute_force(spark, fanout, sizes):
    rng = random.Random(fanout)
    rows = [(g, rng.choice([None, n, n // 2]), sha(f"{g}{n // 2}")) for g, size in sizes.items() for n in range(size)]
    rng.shuffle(rows)
    # Repeated rows, a column that looks like one of the operator's own, and one more.
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, doc_id long, leaf string, path int, __tree string")
    frame = frame.drop("path").withColumn("__row", F.lit(3))
    got = merkle_manifest(frame.repartition(4), "lang", ["doc_id"], fanout=fanout)
    assert got.columns == [*frame.columns, "subroot", "root", "path"]
    text = lambda b: bytes(b).hex()
    found = [
        (r.lang, r.doc_id, r.leaf, r.subroot, r.root, [(text(p.before), text(p.after)) for p in r.path])
        for r in got.collect()
    ]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_manifest(rows, fanout)))
    proved = got.select("root", "path", proof_hash(F.col("path")).alias("proof"), folded(F.col("leaf"), F.col("path")).alias("folded"))
    for r in proved.collect():
        assert r.folded == r.root
        assert r.proof == sha("".join(text(p.before) + text(p.after) for p in r.path))


def test_leaves_tell_null_from_text_and_fields_apart(spark):
    rows = [(None, "-"), ("", None), ("1:", "a"), ("é", "🙂")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in frame.select(leaf_hash(F.col("a"), F.col("b"))).collect()]
    field = lambda v: "-" if v is None else f"{len(v.encode())}:{v}"
    assert got == [sha(field(a) + field(b)) for a, b in rows] and len(set(got)) == 4


def test_odd_rows_and_nothing(spark):
    leaves = tampered_leaves(odd_docs(spark))
    rows = merkle_manifest(leaves, "lang", ["doc_id"]).collect()
    assert len(rows) == len(odd_rows()) and len({r.root for r in rows}) == 1
    assert all(r.tampered == r.leaf for r in rows if r.doc_id is None)
    assert merkle_manifest(tampered_leaves(no_docs(spark)), "lang", ["doc_id"]).count() == 0


def test_a_changed_leaf_is_noticed(spark):
    rows = [(n, prose(n, 5).upper() if n % 2 else prose(n, 5).lower(), "en", "s", 1) for n in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    manifest = merkle_manifest(tampered_leaves(docs), "lang", ["doc_id"])
    seen = {
        r.doc_id: r.same
        for r in manifest.select(
            "doc_id", (folded(F.col("tampered"), F.col("path")) == F.col("root")).alias("same")
        ).collect()
    }
    import zlib

    hit = {n for n in range(70) if zlib.crc32(str(n).encode()) % 3 == 0}
    assert {n for n, same in seen.items() if not same} == {n for n in hit if n % 2}
