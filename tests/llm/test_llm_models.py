import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import no_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F

from lodeseek.llm import lm_scoring
from lodeseek.llm.elias_fano import EliasFano, MappedFile, NgramTrie, quantised, raised, restored
from lodeseek.llm.language_id import identify, language_profiles, letter_tables, ngram_counts
from lodeseek.llm.lm_scoring import PAIR_SHARE, PRIOR, score_texts
from lodeseek.llm.sampling import sampled_ids
from lodeseek.llm.text import crc_class, hash_runs
from lodeseek.llm.toxicity import BlockMaxIndex, drop_toxic, fit, score_toxicity


@pytest.mark.parametrize("bits,count", [(64, 0), (64, 1), (64, 5000), (41, 3000), (12, 4000), (5, 300)])
def test_elias_fano_equals_a_sorted_array(bits, count):
    rng = np.random.default_rng(count)
    top = 2**bits - 1
    values = np.sort(rng.integers(0, top, count, dtype=np.uint64, endpoint=True))
    store = MappedFile()
    packed = EliasFano(values, bits, store)
    assert np.array_equal(packed.at(np.arange(count)), values)
    keys = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
    place, equal = packed.successor(keys)
    assert np.array_equal(place, np.searchsorted(values, keys))
    assert np.array_equal(equal, np.isin(keys, values))
    if count == 5000:
        used = packed.high.nbytes + packed.low.nbytes
        assert used < 0.95 * values.nbytes
    store.close()


def test_trie_answers_words_and_contexts():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    pairs = sorted({(int(rng.integers(len(words))), int(rng.integers(2**40))) for _ in range(900)})
    parents = np.array([p for p, _ in pairs])
    contexts = np.array([c for _, c in pairs], dtype=np.uint64)
    below = sorted({(int(rng.integers(len(pairs))), int(rng.integers(2**32))) for _ in range(2000)})
    places = np.array([p for p, _ in below])
    seconds = np.array([c for _, c in below], dtype=np.uint64)
    one, two, three = rng.uniform(-12, -9, len(words)), rng.uniform(-9, -5, len(pairs)), rng.uniform(-5, 0, len(below))
    after, later = rng.uniform(0, 6, len(words)), rng.uniform(0, 6, len(pairs))
    trie = NgramTrie(
        words, np.arange(len(words)), one, after, (parents, contexts, two, later), (places, seconds, three)
    )
    rank, found = trie.find(words)
    assert found.all() and np.array_equal(rank, np.arange(len(words)))
    for level, up, here, weights, top, known in (
        (trie.pairs, parents, contexts, two, 2**40, set(pairs)),
        (trie.triples, places, seconds, three, 2**32, set(below)),
    ):
        place, hit = level.find(up, here)
        assert hit.all() and np.array_equal(place, np.arange(len(up)))
        assert np.abs(restored(level.weights[place]) - weights).max() <= 1 / 2048
        other = (here + np.uint64(1)) & np.uint64(top - 1)
        present = [(int(p), int(c)) in known for p, c in zip(up, other)]
        assert level.find(up, other)[1].tolist() == present
    assert (restored(quantised(two)) <= two).all() and (restored(raised(later)) >= later).all()
    assert np.abs(restored(trie.follows) - after).max() <= 1 / 2048
    trie.close()


def brute_scores(rows, train):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())) + [None] for t in rows]
    one, two, three = Counter(), Counter(), Counter()
    starts = 0
    for words, learn in zip(texts, train):
        if learn:
            one.update(words)
            two.update(zip(["start", *words[:-1]], words))
            three.update(zip(["start", "start", *words[:-2]], ["start", *words[:-1]], words))
            starts += 1
    n, v = sum(one.values()), len(one)
    for words in texts:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in words)
        score = 0.0
        for second, before, w in zip(["start", "start", *words[:-2]], ["start", *words[:-1]], words):
            context = starts if before == "start" else one[before]
            both = starts if before == "start" else two[second, before]
            own = three[second, before, w] + PAIR_SHARE * two[before, w] + PRIOR * (one[w] + 1) / (n + v + 1)
            score += math.log10(own / (both + PAIR_SHARE * context + PRIOR))
        yield len(words), sum(one[w] > 0 for w in words), n, base, score


@pytest.mark.parametrize("parts", [48, 3, 700])
def test_scores_equal_a_dictionary_model(spark, monkeypatch, parts):
    # Few parts make no words, pairs or triples frequent, many make all three.
    monkeypatch.setattr(lm_scoring, "LEAST_PARTS", parts)
    monkeypatch.setattr(lm_scoring, "SLICE_TOKENS", 200)
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(50 + i, "the same pair " * 40) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scored = score_texts(frame, crc_class("doc_id", 7) != 2).collect()
    train = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2 for i, _ in rows]
    wanted = sorted(
        (str(i), *numbers) for (i, _), numbers in zip(rows, brute_scores([t for _, t in rows], train))
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert w[5] - 2 * (g[1] + 1) / 2048 - 1e-6 <= g[5] <= w[5] + 1e-6


def test_words_that_fill_a_part_are_spread(spark, monkeypatch):
    # Each of these words has nearly 1/48 of all tokens, so each would fill a part.
    found = []
    frequent = lm_scoring.frequent_words
    monkeypatch.setattr(lm_scoring, "frequent_words", lambda *a: found.append(frequent(*a)) or found[0])
    rows = [(i, " ".join(f"w{n}" for n in range(49)) + f" x{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert score_texts(frame, F.lit(True)).count() == 200
    assert sorted(found[0].values()) == [200] * 50


def test_scores_without_training_rows_and_of_nothing(spark):
    rows = score_texts(odd_docs(spark), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert all(abs(r.base_score) < 1e-9 and abs(r.score) <= r.n_tokens / 2048 for r in rows)
    assert score_texts(no_docs(spark), F.lit(True)).count() == 0


def test_words_with_equal_bytes_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"abc abcdefgh abcdefghi abc abcdefghi", dtype=np.uint8)
    starts, ends = np.array([0, 4, 13, 23, 27]), np.array([3, 12, 22, 26, 36])
    h = hash_runs(data, starts, ends)
    assert h[0] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 3


def brute_ngrams(text):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        edged = f"_{word}_"
        counts.update(word)
        counts.update(edged[i : i + 2] for i in range(len(edged) - 1))
        counts.update(edged[i : i + 3] for i in range(len(edged) - 2))
    return counts


def test_ngram_counts_equal_brute_force():
    texts = ["Der Baum, der 2 Bäume!", "", "x", "a1b", "das ist's", "ÉTÉ été", None, "tail word"]
    keys, counts = ngram_counts(pa.array(texts), letter_tables())
    for row, text in enumerate(texts):
        mine = keys >> np.uint64(48) == row
        got = Counter()
        for key, n in zip(keys[mine].tolist(), counts[mine].tolist()):
            codes = [key >> s & 0xFFFF for s in (32, 16, 0)]
            got["".join(chr(c) for c in codes if c)] += n
        assert got == brute_ngrams(text or "")


def test_languages_are_told_apart(spark):
    samples = {
        "en": "the house and the river with that which there other would have been from this they",
        "de": "der baum und die straße nicht eine schön über auch werden können ist sich mit dem",
        "fr": "le fleuve et les maisons dans une très être pour que avec nous vous était cette",
    }
    rng = np.random.default_rng(0)
    rows = [
        (i, " ".join(rng.choice(samples[lang].split(), 12)), lang)
        for i, lang in enumerate(["en", "de", "fr"] * 40)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_profiles(frame.filter("doc_id % 4 > 0"), "text", "lang")
    found = identify(frame.filter("doc_id % 4 = 0"), profiles).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    profiles = language_profiles(docs, "text", "lang")
    assert {p[0] for p in profiles} == {"en"}
    found = identify(docs, profiles)
    assert found.columns.count("score") == 1 and set(docs.columns) <= set(found.columns)
    rows = found.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if letters else "und")
    assert identify(no_docs(spark), profiles).count() == 0
    nothing = language_profiles(no_docs(spark), "text", "lang")
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("common_share", [2.0, 0.087, 0.0])
def test_block_max_index_equals_brute_force(common_share):
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        terms = np.sort(rng.choice(40, rng.integers(1, 7), replace=False))
        weights = rng.uniform(0.1, 2, len(terms)).round(1)
        vectors.append((terms, weights / np.sqrt((weights**2).sum())))
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    # No term has rows in place of postings, some have, all have.
    index = BlockMaxIndex(vectors, 40, common_share)
    for terms, weights in vectors[:80]:
        who, similar = index.search(terms, weights, 9)
        scores = np.round(dense[:, terms] @ weights, 12)
        order = np.lexsort((np.arange(700), -scores))[:9]
        assert np.allclose(similar, scores[order])
        assert np.allclose(scores[who], scores[order])
    who, _ = BlockMaxIndex([], 40).search(np.array([1]), np.array([1.0]), 5)
    assert not len(who)


def labelled(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = prose(1000 + i, 40).split()
        if toxic:
            text[rng.integers(40)] = str(rng.choice(["idiot", "vequabc", "vequxyz", "vequ" + "abcdefghij"[i % 10]])) + ","
        rows.append((i, " ".join(text), 1))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxic_texts_are_found(spark):
    docs, labels = labelled(spark)
    model = fit(docs, labels, F.col("doc_id") % 5 > 0)
    rows = score_toxicity(docs.filter("doc_id % 5 = 0"), model).collect()
    right = sum((r.doc_id % 6 == 0) == (r.predicted == 1) for r in rows)
    assert right / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # Every example has a vector, and is its own nearest.
    _, terms, _, index, clean, toxic, ids, blank = model
    assert index.size == len(ids) == 720 and blank == (0, 0)
    assert all(r.evidence for r in rows)
    own = score_toxicity(docs.filter("doc_id % 5 > 0"), model).collect()
    assert all(r.evidence[0]["id"] == str(r.doc_id) and r.evidence[0]["similarity"] > 0.999 for r in own)
    evidence = [r.evidence for r in rows if r.predicted == 1]
    assert all(e and all(n["similarity"] > 0 for n in e) for e in evidence)


def test_toxicity_of_odd_rows_and_without_labels(spark):
    docs, labels = labelled(spark)
    model = fit(docs, labels, F.lit(True))
    scored = score_toxicity(odd_docs(spark), model)
    assert scored.columns.count("score") == 1
    assert scored.count() == len(odd_rows())
    empty = fit(docs, labels.limit(0), F.lit(True))
    assert {(r.score, r.predicted) for r in score_toxicity(odd_docs(spark), empty).collect()} == {(0.0, 0)}
    assert score_toxicity(no_docs(spark), model).count() == 0


def test_toxic_documents_go(spark, tmp_path):
    docs, labels = labelled(spark)
    labels.withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    kept = drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in range(900) if i % 6 and i not in ids]) < 15
    assert len([i for i in ids if i % 6 == 0]) < 5


def test_samples_are_bounded_and_stable(spark):
    frame = spark.range(20_000).withColumn("id", F.when(F.col("id") % 5 > 0, F.col("id") % 9000))
    first = [r[0] for r in sampled_ids(frame, "id", 300).collect()]
    assert len(first) == len(set(first)) == 300 and None not in first
    assert set(first) == {r[0] for r in sampled_ids(frame.repartition(7), "id", 300).collect()}
    assert sampled_ids(frame, "id", 10**6).count() == 7200
    assert sampled_ids(frame.limit(0), "id", 5).count() == 0
