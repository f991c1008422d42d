"""Whole results that a shortened operator would miss."""

import hashlib
from collections import Counter

import pyarrow as pa
from llm_data import prose

from pyspark.sql import functions as F

from lodeseek.llm.decontamination import drop_contaminated, held_items
from lodeseek.llm.sharding import shuffle_into_shards

def held(spark, items, rows):
    """Which texts hold which items; also checks the stage's drop on the same tables."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    digests = {hashlib.md5(t.encode()).hexdigest(): n for n, t in enumerate(rows)}
    found = {(digests[r.text_md5], r.item): r.reparameterised for r in held_items(docs, bench).collect()}
    left = {r.doc_id for r in drop_contaminated(docs, bench).collect()}
    assert left == set(range(len(rows))) - {text for text, _ in found}
    return found


def test_names_that_open_sentences_are_placeholders(spark):
    items = ["Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"]
    rows = [
        "Anna has 7 apples. Anna buys 2 more apples. How many apples does Anna have now?",
        f"{prose(1, 30)}. {items[0]} {prose(2, 30)}",
        # The name does not stay the same throughout.
        "Anna has 7 apples. Eve buys 2 more apples. How many apples does Mia have now?",
    ]
    assert held(spark, items, rows) == {(0, 0): True, (1, 0): False}


def test_verbatim_copies_are_never_exempt(spark):
    long = prose(31, 400)
    items = [
        "12 + 7 - 3 + 9 - 4 + 8 equals what?",
        "小明有五个苹果，他又买了三个苹果，现在一共有多少个苹果？",
        "A train leaves Paris with 40 passengers and 12 km later 40 passengers meet 7 others on board near Lyon.",
        long,
    ]
    passage = " ".join(long.split()[100:200])
    rows = [
        f"{prose(32, 20)}. {items[0]}",
        f"他说：{items[1]}谢谢。",
        # One of two equal numbers is changed; the words around it stay.
        items[2].replace("40", "51", 1),
        f"{prose(33, 900)}. {passage}. {prose(34, 900)}",
        f"{prose(35, 900)}. {' '.join(long.split()[100:115])}. {prose(36, 900)}",
        "小明有两只猫，他的妹妹没有猫，现在家里一共有多少只猫？",
    ]
    assert held(spark, items, rows) == {(0, 0): False, (1, 1): False, (2, 2): False, (3, 3): False}


def test_repeated_rows_scatter_over_all_buckets(spark):
    rows = [(n, prose(n, 20)) for n in range(2000)] + [(7, prose(7, 20))] * 1000 + [(None, None)] * 3000
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    def sizes(batches):
        batches = list(batches)
        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in batches)]})

    def places(df):
        return Counter((r.doc_id, r["shard"], r.slot) for r in shuffle_into_shards(df, 9, bucket_bytes=9000).collect())

    once = shuffle_into_shards(frame, 9, bucket_bytes=9000)
    held = [r.n for r in once.mapInArrow(sizes, "n long").collect()]
    # Before, one task held all 3,000 equal rows, or all 1,001.
    assert sum(held) == len(rows) and max(held) < 800
    first = places(frame)
    assert first == places(frame.orderBy(F.rand(3)).repartition(11))
    assert Counter(i for i, _, _ in first.elements()) == Counter(i for i, _ in rows)
    assert len({(s, t) for _, s, t in first}) == len(rows)
    assert {s for i, s, _ in first if i == 7} == set(range(9))
