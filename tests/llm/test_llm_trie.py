import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lodeseek.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt_conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, `__row` int"


def brute_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5 if c < 0 else c % 5
        made[c] = tuple(own.get(c - base, [])[:h] + own[c][h:])
    return made


def brute_trie(made):
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    found = []
    for node, convs in members.items():
        below = [u for u in members if u[: len(node)] == node]
        childless = [u for u in below if not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in members)]
        ends = sorted(c for c in convs if made[c] == node)
        found.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                sum(len(u) == len(node) + 1 for u in below),
                len(childless),
                sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below if u),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(map(repr, found))


def got_trie(spark, rows, partitions=4):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(partitions)
    turns = numbered_turns(frame, "conv_id", "turn", "role", "text")
    trie = prefix_trie(*rebuilt_conversations(turns))
    assert trie.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    return sorted(repr(tuple(r)) for r in trie.collect())


def conversations(seed, count, vocabulary, most):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for turn in range(rng.randrange(1, most)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(vocabulary) * (1 + turn % 2)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,vocabulary,most", [(1, ["a", "é"], 6), (2, ["a"], 14), (3, list("abcdefgh"), 4)])
def test_trie_equals_brute_force(spark, seed, vocabulary, most):
    rows = conversations(seed, 60, vocabulary, most)
    assert got_trie(spark, rows) == brute_trie(brute_rebuilt(rows))


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "belongs to none"),
        (7, None, "user", "first"),
        (7, 0, None, None),
        (7, 1, "", "x"),
        # Turns that repeat, and turns of one number.
        (8, 1, "user", "same"),
        (8, 1, "user", "same"),
        (8, 1, "bot", "other"),
        (-3, 0, "user", "below zero"),
        (-5, 0, "user", "below zero"),
        (13, 0, "u", "a:b"),
        (14, 0, "u:", "ab"),
        (15, 0, "u", "z" * 200_000),
        (2**62, 5, "user", "far"),
    ]
    assert got_trie(spark, rows) == brute_trie(brute_rebuilt(rows))


def test_one_long_conversation_and_many_copies(spark):
    rows = [(100, n, "user", f"t{n % 3}") for n in range(700)]
    rows += [(1000 + c, n, "user", t) for c in range(600) for n, t in enumerate("pqrstuvwxyz")]
    made = brute_rebuilt(rows)
    got = got_trie(spark, rows, 7)
    assert got == brute_trie(made)
    # The end list of the copies is longer than one piece.
    assert max(sum(made[c] == made[d] for d in made) for c in (1000, 1001, 1005)) > 1


def test_no_conversations(spark):
    assert got_trie(spark, []) == []


def test_end_list_of_several_pieces(spark):
    # h is at most 8: conversations with one base and at least nine equal turns are equal.
    rows = [(c, n, "user", "same") for c in range(1200) for n in range(9)]
    made = brute_rebuilt(rows)
    assert len(set(made.values())) == 1
    ids = hashlib.sha256(",".join(map(str, range(1200))).encode()).hexdigest()
    got = got_trie(spark, rows)
    assert len(got) == 10 and sum(ids in r for r in got) == 1
