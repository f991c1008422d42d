"""Inputs beyond what operators once took."""

import time
from collections import Counter

import numpy as np
import pytest
from llm_data import prose

from pyspark.sql import functions as F

from lodeseek.llm import html_extraction
from lodeseek.llm.html_blocks import blocks_of
from lodeseek.llm.language_id import identify, language_profiles, letter_tables, ngram_counts


def test_long_attribute_values_keep_their_tag():
    long = "x" * 9000
    page = f'<div class="nav" data-x="{long}"><p>menu</p></div><div class="a" data-y=\'{long}>{long}\'>text</div>'
    blocks = blocks_of(page)
    assert [b.text for b in blocks] == ["menu", "text"]
    assert ("div", ("nav",)) in blocks[0].path and ("div", ("a",)) in blocks[1].path


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<p class='a>b'>one</p>", ["one"]),
        ('<p title="a\'b">one</p>', ["one"]),
        ('<p title="never closed>one</p><p>two</p>', ["one", "two"]),
        ("a < b and c > d <", ["a < b and c > d <"]),
        ("<p>x</p><div", ["x", "<div"]),
        ("<p>before <math><mi>x</mi><mo>=</mo><mn>2</mn></math> after</p>", ["before x=2 after"]),
    ],
)
def test_tags_with_quotes(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


def test_broken_quotes_take_time_in_proportion():
    def seconds(count):
        page = "<a b=\"" * count + ">" + "'" * 3
        begun = time.perf_counter()
        blocks_of(page)
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(80_000) < 20 * max(seconds(8000), 0.02)


def test_every_block_of_a_long_page_is_trained(monkeypatch):
    seen = []
    monkeypatch.setattr(html_extraction, "EPOCHS", 1)
    monkeypatch.setattr(html_extraction, "ARRANGED", 0)
    gradients = html_extraction.Labeller.gradients

    def counted(self, x, lengths, y):
        seen.extend(lengths.tolist())
        return gradients(self, x, lengths, y)

    monkeypatch.setattr(html_extraction.Labeller, "gradients", counted)
    page = "<nav><p>menu</p></nav><article>" + "".join(f"<p>{prose(n, 12)}</p>" for n in range(700)) + "</article><footer>end</footer>"
    html_extraction.fit_labeller([page])
    assert sum(seen) == 702 and max(seen) <= html_extraction.TRAINED_TOGETHER


def brute_language(text, profiles, size):
    """Prediction and score by sums written out over dictionaries."""
    keys, counts = ngram_counts(text, letter_tables())
    grams = (keys & np.uint64((1 << 48) - 1)).view(np.int64).tolist()
    ranked = [g for _, _, g in sorted((-int(c), n, g) for n, (g, c) in enumerate(zip(grams, counts)))][:size]
    by_lang = {}
    for lang, gram, rank in profiles:
        by_lang.setdefault(lang, {})[gram] = rank
    if not ranked or not by_lang:
        return "und", 0.0
    sums = {
        lang: sum(abs(known[g] - r) if g in known else size for r, g in enumerate(ranked)) for lang, known in by_lang.items()
    }
    best = min(sorted(sums), key=lambda lang: sums[lang])
    return best, 1 - sums[best] / (len(ranked) * size)


@pytest.mark.parametrize("size", [5, 400])
def test_out_of_place_distance_equals_brute_force(spark, size):
    import pyarrow as pa

    rows = [(n, prose(n, 30) if n % 2 else " ".join(reversed(prose(n, 30).split())).upper(), f"l{n % 4}") for n in range(60)]
    rows += [(100, "", "l1"), (101, None, "l2"), (102, "ünïcode çà æ", "l9"), (103, "12 34", "l1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_profiles(frame, "text", "lang", size)
    assert max(Counter(p[0] for p in profiles).values()) <= size
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(frame.drop("lang"), profiles, size=size).collect()}
    for i, text, _ in rows:
        lang, score = brute_language(pa.array([text or ""]), profiles, size)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-12


def test_more_languages_than_a_thousand(spark):
    rows = [(n, f"{chr(0x4E00 + n)}{chr(0x4E00 + n)} {prose(n % 7, 3)}", f"lang{n:04d}") for n in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_profiles(frame, "text", "lang")
    assert len({p[0] for p in profiles}) == 1500
    got = {r.doc_id: r.lang_pred for r in identify(frame.drop("lang"), profiles).collect()}
    assert sum(got[n] == f"lang{n:04d}" for n in range(1500)) > 1400


def test_counts_beyond_23_bits_keep_their_order(spark):
    # More repeats of both n-grams than 23 bits hold, one more of "b" than of "a".
    text = "a " * 8_400_000 + "b " * 8_400_001
    profiles = [("first", gram, rank) for gram, rank in _grams_of("b", "a")] + [
        ("second", gram, rank) for gram, rank in _grams_of("a", "b")
    ]
    frame = spark.createDataFrame([(1,)], "doc_id int").withColumn(
        "text", F.concat(F.repeat(F.lit("a "), 8_400_000), F.repeat(F.lit("b "), 8_400_001))
    )
    assert len(text) == 33_600_002
    assert identify(frame, profiles).first().lang_pred == "first"


def _grams_of(*letters):
    """The n-grams of single letters, those of the first letter before those of the second."""
    import pyarrow as pa

    found = []
    for letter in letters:
        keys, _ = ngram_counts(pa.array([letter]), letter_tables())
        found += (keys & np.uint64((1 << 48) - 1)).view(np.int64).tolist()
    distinct = list(dict.fromkeys(found))
    return [(gram, rank) for rank, gram in enumerate(distinct)]
