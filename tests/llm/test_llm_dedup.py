import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_data import no_docs, odd_docs, odd_rows, prose

from lodeseek.llm.components import components
from lodeseek.llm.exact_dedup import drop_exact_duplicates, exact_groups
from lodeseek.llm.simhash import ball, drop_near_duplicates, fingerprints, links_within, near_groups


def test_exact_groups_of_odd_rows(spark):
    rows = exact_groups(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    groups = defaultdict(list)
    for i, text, *_ in odd_rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, text or ""))
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    # Equal without white space: the longest original stays, though its id is not the least.
    assert {r.keep_id for i in (1, 3, 4) for r in by_id[i]} == {4}
    # Blank texts are one group; the blank with most code points stays.
    assert {r.keep_id for i in (5, 6, 7) for r in by_id[i]} == {7}
    assert sum(r.kept for r in rows) == len(groups)
    assert sorted(r.group_size for r in by_id[13]) == [1, 2, 2]


def test_exact_duplicates_leave_whole_rows(spark):
    kept = drop_exact_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    texts = [re.sub(r"\s", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", t or "") for _, t, *_ in odd_rows()})


def test_exact_dedup_of_nothing(spark):
    assert exact_groups(no_docs(spark)).count() == 0
    assert drop_exact_duplicates(no_docs(spark)).count() == 0


def reference_fingerprint(text, words=3):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    total = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, seed=42) >> bit & 1 for s in shingles)
        total |= (2 * ones > len(shingles)) << bit
    return total


def test_fingerprints_equal_brute_force(spark):
    rows = fingerprints(odd_docs(spark)).collect()
    wanted = sorted((str(i), reference_fingerprint(t)) for i, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), r.fingerprint % 2**64) for r in rows) == wanted


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("flips", [1, 3])
def test_links_and_components_equal_brute_force(spark, flips):
    rng = np.random.default_rng(flips)
    values = [int(v) for v in rng.integers(0, 2**63, 40)] + [0, 2**63, 2**64 - 1]
    for _ in range(160):
        base = values[rng.integers(len(values))]
        for bit in rng.choice(64, rng.integers(1, flips + 1), replace=False):
            base ^= 1 << int(bit)
        values.append(base)
    values = sorted(set(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    links = {(r.a, r.b) for r in links_within(frame).collect()}
    wanted = {
        (min(a, b), max(a, b))
        for i, a in enumerate(signed)
        for j, b in enumerate(signed[:i])
        if bin(values[i] ^ values[j]).count("1") <= 3
    }
    assert links == wanted
    roots = {r.node: r.root for r in components(links_within(frame)).collect()}
    groups = defaultdict(set)
    for v, g in zip(signed, brute_components(values)):
        groups[g].add(v)
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_of_odd_rows(spark):
    rows = near_groups(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    component = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert component[1] == component[3] == component[4] == 1
    # Texts without words have fingerprint 0 and share a component, with NULL ids too.
    assert component[5] == component[6] == component[7] == 5
    assert near_groups(no_docs(spark)).count() == 0


def test_near_duplicates_leave_one_row_of_each_group(spark):
    near = prose(20, 900)
    changed = " ".join(w if n != 450 else "other" for n, w in enumerate(near.split()))
    more = [(30, near), (31, changed), (32, near)]
    frame = odd_docs(spark).select("doc_id", "text", "source", "part").unionByName(
        spark.createDataFrame([(i, t, "s", 1) for i, t in more], "doc_id long, text string, source string, part int")
    )
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    prints = [reference_fingerprint(r.text) for r in frame.collect()]
    assert kept.count() == len(set(brute_components(prints)))
    ids = [r.doc_id for r in kept.collect()]
    assert 30 in ids and 31 not in ids and 32 not in ids
    assert ids.count(13) == len({prose(13, 50), prose(14, 50)})


def test_ball_has_every_mask_once():
    assert len(ball(32, 1)) == len(set(ball(32, 1))) == 33
    assert len(ball(8, 2)) == 1 + 8 + 28 and all(bin(m).count("1") <= 2 for m in ball(8, 2))


def test_group_hash_is_of_the_normalised_text(spark):
    rows = [r for r in exact_groups(odd_docs(spark)).collect() if r.doc_id in (1, 4)]
    wanted = hashlib.sha256(prose(1, 60).replace(" ", "").encode()).hexdigest()
    assert {r.group_hash for r in rows} == {wanted}
