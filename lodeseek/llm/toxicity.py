"""Toxicity scores by nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.sampling import sampled_ids
from lodeseek.llm.text import (
    bytes_of,
    crc_class,
    hash_runs,
    in_parts,
    is_letter_byte,
    lowered,
    ragged_ranges,
    word_runs,
)
from lodeseek.session import load_table, materialize

# The labelled rows that are learnt from, at most (chosen by a hash of their id), and how
# long a text may be that is learnt from: together they bound what tasks hold.
MOST_EXAMPLES, MOST_TEXT_BYTES = 4_000, 1 << 18
# Telling terms: chi-squared of at least LEAST_CHI, and toxic examples LEAST_LIFT times as
# frequent among those that hold the term as among all (frequent words pass the first test
# already because toxic texts are a little longer); the MOST_TERMS best weigh in full.
MOST_TERMS, LEAST_CHI, LEAST_LIFT = 4096, 40.0, 3.0
# What every other word of the examples weighs: little enough that topics do not outvote
# telling terms, enough that copies and kindred texts are found without any.
ORDINARY = 0.03
PREFIX_BYTES = (4, 5, 6)
NEIGHBOURS, SHARPNESS, PRIOR_WEIGHT = 12, 4.0, 0.5
THRESHOLD = 0.3
BLOCK = 64
# Blocks of examples that a search opens at first; twice as many each time after.
FIRST_BLOCKS = 16
# Terms that over COMMON_SHARE of the examples hold, COMMON_TERMS at most, have full rows of
# weights in place of postings.
COMMON_SHARE, COMMON_TERMS = 1 / 16, 256
# Scores of texts that a task remembers for their copies.
_REMEMBERED = 20_000


def term_hits(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, term) of every word and then of every word beginning of a text column, and the
    number of words.

    Words are runs of letters, A-Z as a-z; a term is a word or its first 4, 5 or 6 bytes.
    """
    data, offsets = bytes_of(column)
    data = lowered(data)
    starts, ends, rows = word_runs(data, offsets, is_letter_byte())
    found_rows, found_terms = [], []
    for size in (0, *PREFIX_BYTES):
        longer = np.flatnonzero(ends - starts > size)
        begin = starts[longer]
        found_terms.append(
            hash_runs(data, begin, begin + size if size else ends[longer], seed=size)
        )
        found_rows.append(rows[longer])
    return np.concatenate(found_rows), np.concatenate(found_terms), len(starts)


def term_counts(
    column: pa.Array, telling: np.ndarray
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row its terms in order, and how often each occurs: all words, telling beginnings."""
    rows, terms, words = term_hits(column)
    if len(telling):
        at = np.minimum(np.searchsorted(telling, terms[words:]), len(telling) - 1)
        begins = words + np.flatnonzero(telling[at] == terms[words:])
    else:
        begins = np.zeros(0, dtype=np.int64)
    rows = np.concatenate([rows[:words], rows[begins]])
    terms = np.concatenate([terms[:words], terms[begins]])
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    heads = np.flatnonzero(first)
    counts = np.diff(np.append(heads, len(rows)))
    cuts = np.searchsorted(rows[heads], np.arange(len(column) + 1))
    terms = terms[heads]
    return [(terms[a:b], counts[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class BlockMaxIndex:
    """Unit vectors in an inverted index whose postings lie in blocks with their maximum.

    A query adds up the maxima of its terms per block. Blocks are opened in falling order
    of that bound, until it lies below the k-th best similarity: the result is exact.
    The commonest terms would touch every block: their weights stand in full rows, whose
    exact sums enter the bounds.
    """

    def __init__(
        self,
        vectors: list[tuple[np.ndarray, np.ndarray]],
        terms: int,
        common_share: float = COMMON_SHARE,
    ):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        example = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int32)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)]).astype(np.float32)
        held_by = np.bincount(term, minlength=terms)
        common = np.argsort(-held_by, kind="stable")[:COMMON_TERMS]
        common = common[held_by[common] > common_share * self.size]
        self.column = np.full(terms, -1, dtype=np.int16)
        self.column[common] = np.arange(len(common))
        inside = self.column[term] >= 0
        self.rows = np.zeros((len(common), self.blocks * BLOCK))
        self.rows[self.column[term[inside]], example[inside]] = weight[inside]
        example, term, weight = example[~inside], term[~inside], weight[~inside]
        order = np.lexsort((example, term))
        self.example, self.weight, term = example[order], weight[order], term[order]
        block = self.example // BLOCK
        change = np.ones(len(term), dtype=bool)
        change[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        # An entry per term and block: where its postings begin, and their maximum.
        begin = np.flatnonzero(change)
        self.begin = np.append(begin, len(term)).astype(np.int32)
        self.block = block[begin]
        self.most = np.maximum.reduceat(self.weight, begin) if len(term) else np.zeros(0, np.float32)
        self.of_term = np.searchsorted(term[begin], np.arange(terms + 1)).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (ties: lower number first) and their similarities."""
        columns = self.column[terms]
        common = columns >= 0
        shared = weights[common] @ self.rows[columns[common]]
        first = self.of_term[terms]
        count = self.of_term[terms + 1] - first
        entry = ragged_ranges(first, count)
        weight = np.repeat(weights, count)
        block = self.block[entry]
        bound = np.bincount(block, weights=weight * self.most[entry], minlength=self.blocks)
        bound = bound + shared.reshape(-1, BLOCK).max(axis=1, initial=0.0)
        by_block = np.argsort(block.astype(np.uint16) if self.blocks < 65_536 else block, kind="stable")
        entry, weight = entry[by_block], weight[by_block]
        cuts = np.searchsorted(block[by_block], np.arange(self.blocks + 1))
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        who, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step = 0, FIRST_BLOCKS
        while at < len(order) and (len(best) < k or bound[order[at]] >= best[-1] - 1e-9):
            opened = np.sort(order[at : at + step])
            mine = ragged_ranges(cuts[opened], cuts[opened + 1] - cuts[opened])
            begin = self.begin[entry[mine]]
            sizes = self.begin[entry[mine] + 1] - begin
            posting = ragged_ranges(begin, sizes)
            scores = np.bincount(
                self.example[posting],
                weights=np.repeat(weight[mine], sizes) * self.weight[posting],
                minlength=len(shared),
            )
            members = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores = scores[members] + shared[members]
            members, scores = members[scores > 0], scores[scores > 0]
            best = np.append(best, np.round(scores, 12))
            who = np.append(who, members)
            if len(best) > k:
                near = np.flatnonzero(best >= np.partition(best, -k)[-k])
                best, who = best[near], who[near]
            keep = np.lexsort((who, -best))[:k]
            best, who = best[keep], who[keep]
            at, step = at + step, step * 2
        return who, best


class NearestExamples:
    """The fitted model: terms and their weights, the index of distinct example vectors, votes."""

    def __init__(
        self,
        telling: np.ndarray,
        terms: np.ndarray,
        weights: np.ndarray,
        index: BlockMaxIndex,
        clean: np.ndarray,
        toxic: np.ndarray,
        ids: list,
        blank: tuple[int, int],
    ):
        self.telling, self.terms, self.weights, self.index = telling, terms, weights, index
        self.clean, self.toxic, self.ids = clean, toxic, ids
        total = int(clean.sum() + toxic.sum()) + sum(blank)
        self.rate = (int(toxic.sum()) + blank[1]) / total if total else 0.0
        # Texts without any word of the examples are like the examples without words.
        self.blank = blank[1] / sum(blank) if sum(blank) else self.rate
        self.known: dict[bytes, tuple[float, list]] = {}

    def score(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        """Share of toxic votes, and the three nearest examples (id, similarity, toxic share)."""
        if not len(self.terms) or not len(hashes):
            return self.blank, []
        key = hashlib.blake2b(hashes.tobytes() + counts.tobytes(), digest_size=16).digest()
        if key not in self.known:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[key] = self._voted(hashes, counts)
        return self.known[key]

    def _voted(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        here = self.terms[at] == hashes
        if not here.any():
            return self.blank, []
        terms, vector = at[here], unit_vector(self.weights[at[here]], counts[here])
        who, similar = self.index.search(terms, vector, NEIGHBOURS)
        vote = similar**SHARPNESS
        toxic, clean = self.toxic[who], self.clean[who]
        share = ((vote * toxic).sum() + PRIOR_WEIGHT * self.rate) / (
            (vote * (toxic + clean)).sum() + PRIOR_WEIGHT
        )
        evidence = [
            (self.ids[w], float(s), float(t / (t + c)))
            for w, s, t, c in zip(who[:3].tolist(), similar, toxic, clean)
        ]
        return float(min(max(share, 0.0), 1.0)), evidence


def unit_vector(weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    vector = (1.0 + np.log(counts)) * weights
    return vector / np.sqrt((vector**2).sum())


def examples(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, most: int
) -> DataFrame:
    """(id, text, toxic) of at most ``most`` labelled rows, stored; equal texts count once.

    Texts over MOST_TEXT_BYTES are not learnt from.
    Labels without id or value are left out; an id labelled twice is toxic if one says so.
    """
    usable = labels.filter(learn & F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    # At most ``most`` rows of one and of two numbers.
    ids = F.broadcast(sampled_ids(usable, id_col, most))
    chosen = (
        usable.select(F.col(id_col).alias("__id"), "toxic")
        .join(ids, "__id")
        .groupBy("__id")
        .agg(F.max("toxic").cast("int").alias("__toxic"))
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    joined = texts.filter(F.octet_length("__text") <= MOST_TEXT_BYTES).join(F.broadcast(chosen), "__id")
    by_text = joined.groupBy("__text").agg(
        F.min("__id").alias("__id"), F.max("__toxic").alias("__toxic")
    )
    return materialize(by_text, "toxic-examples")


def telling_terms(stored: DataFrame) -> np.ndarray:
    """Terms that toxic examples hold more often than chance allows, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                rows, terms, _ = term_hits(batch.column("__text"))
                toxic = batch.column("__toxic").to_numpy()
                order = np.lexsort((rows, terms))
                rows, terms = rows[order], terms[order]
                first = np.ones(len(rows), dtype=bool)
                first[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
                distinct, inverse = np.unique(terms[first], return_inverse=True)
                n = np.bincount(inverse, minlength=len(distinct))
                t = np.bincount(inverse, weights=toxic[rows[first]], minlength=len(distinct))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct.view(np.int64)), pa.array(n), pa.array(t.astype(np.int64))],
                    names=["term", "n", "t"],
                )

    total = stored.agg(F.count(F.lit(1)), F.sum("__toxic")).first()
    rows, toxic = total[0], int(total[1] or 0)
    if not toxic or toxic == rows:
        return np.zeros(0, dtype=np.uint64)
    rate = toxic / rows
    counted = (
        stored.mapInArrow(count, "term long, n long, t long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    )
    # Where labels are even, three times the rate is more than all.
    least = min(LEAST_LIFT * rate, (1 + rate) / 2)
    apart = F.col("t") - F.col("n") * rate
    chi = apart * apart / (F.col("n") * rate * (1 - rate)) * rows / (rows - F.col("n") + 1)
    best = (
        counted.withColumn("chi", chi)
        .filter((F.col("chi") >= LEAST_CHI) & (F.col("t") >= least * F.col("n")))
        .orderBy(F.desc("chi"), "term")
        .limit(MOST_TERMS)
        .collect()
    )
    return np.sort(np.array([r["term"] for r in best], dtype=np.int64).view(np.uint64))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = MOST_EXAMPLES,
) -> tuple:
    """Arguments of NearestExamples, learnt from at most ``most`` labelled rows.

    Every word of every example is indexed, and the telling beginnings of words.
    """
    stored = examples(docs, labels, learn, id_col, text_col, most)
    telling = telling_terms(stored)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                found = term_counts(batch.column("__text"), telling)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("__id"),
                        batch.column("__toxic"),
                        pa.array([t.tobytes() for t, _ in found], pa.binary()),
                        pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary()),
                    ],
                    names=["__id", "__toxic", "terms", "counts"],
                )

    schema = T.StructType([*stored.select("__id", "__toxic").schema.fields])
    for name in ("terms", "counts"):
        schema = schema.add(name, T.BinaryType())
    # Distinct vectors of at most ``most`` examples of bounded length.
    rows = (
        stored.mapInArrow(vectors, schema)
        .groupBy("terms", "counts")
        .agg(
            F.min("__id").alias("id"),
            F.sum("__toxic").alias("toxic"),
            F.sum(1 - F.col("__toxic")).alias("clean"),
        )
        .orderBy("terms", "counts")
        .collect()
    )
    blank = [(int(r["clean"]), int(r["toxic"])) for r in rows if not r["terms"]]
    rows = [r for r in rows if r["terms"]]
    hashes = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    counts = [np.frombuffer(r["counts"], np.uint32).astype(np.int64) for r in rows]
    votes = [np.array([r[name] for r in rows], dtype=np.int64) for name in ("clean", "toxic")]
    terms, held_by = np.zeros(0, dtype=np.uint64), np.zeros(0)
    if rows:
        terms, places = np.unique(np.concatenate(hashes), return_inverse=True)
        sizes = [len(h) for h in hashes]
        held_by = np.bincount(places, weights=np.repeat(votes[0] + votes[1], sizes))
    total = int(votes[0].sum() + votes[1].sum()) + sum(map(sum, blank))
    weights = (np.log((1 + total) / (1 + held_by)) + 1) * np.where(np.isin(terms, telling), 1.0, ORDINARY)
    found = [np.searchsorted(terms, h) for h in hashes]
    order = _kindred(found, held_by)
    unit = [(found[i], unit_vector(weights[found[i]], counts[i])) for i in order]
    return (
        telling,
        terms,
        weights,
        BlockMaxIndex(unit, len(terms)),
        votes[0][order],
        votes[1][order],
        [rows[i]["id"] for i in order],
        blank[0] if blank else (0, 0),
    )


def _kindred(found: list[np.ndarray], held_by: np.ndarray) -> np.ndarray:
    """An order in which texts that share the commonest words, those of a language, stand
    together, so that few blocks of the index have large bounds for a text."""
    common = np.argsort(-held_by, kind="stable")[:48]
    signs = np.array([np.isin(common, t) for t in found], dtype=bool).reshape(len(found), len(common))
    return np.lexsort(signs.T[::-1]) if len(found) else np.zeros(0, dtype=np.int64)


def score_toxicity(df: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """``df`` with ``score``, ``predicted`` and ``evidence`` (the nearest labelled examples).

    A text's vector counts all its words that the examples have, and the telling beginnings of
    words. The nearest distinct example
    vectors vote by a power of their cosine; a weak prior is the rate of the examples. A
    text without words (NULL and empty ones too), or with unknown ones alone, has the rate
    of the examples without words, if there are any, else of all;
    without examples every score is 0. Columns of ``df`` with those names are replaced.
    """
    df = df.drop("score", "predicted", "evidence")
    text = df.columns.index(text_col)
    id_type = T.StringType()
    evidence = T.ArrayType(
        T.StructType(
            [
                T.StructField("id", id_type),
                T.StructField("similarity", T.DoubleType()),
                T.StructField("toxic", T.DoubleType()),
            ]
        )
    )
    schema = T.StructType([*df.schema.fields]).add("score", "double").add("predicted", "integer").add(
        "evidence", evidence
    )
    # Bounded by MOST_EXAMPLES and MOST_TEXT_BYTES.
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = NearestExamples(*shared.value)
        for whole in batches:
            for batch in in_parts(whole, text):
                counted = term_counts(batch.column(text), nearest.telling)
                found = [nearest.score(t, c) for t, c in counted]
                scores = np.array([s for s, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(scores),
                        pa.array((scores >= THRESHOLD).astype(np.int32)),
                        pa.array(
                            [
                                [{"id": str(i), "similarity": s, "toxic": t} for i, s, t in e]
                                for _, e in found
                            ],
                            pa.list_(
                                pa.struct(
                                    [("id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.float64())]
                                )
                            ),
                        ),
                    ],
                    names=schema.names,
                )

    return df.mapInArrow(work, schema)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple:
    """Fitted on the labels of ``docs`` whose crc32 modulo 4 is not 2."""
    labels = load_table(spark, sf_dir, "labels")
    return fit(docs, labels, crc_class("doc_id", 4) != 2)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    scored = score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.filter("predicted = 0").select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = load_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        (crc_class("doc_id", 4) == 2).alias("held_out"),
        "score",
        "predicted",
        _written(F.col("evidence")).alias("evidence"),
    )


def _written(evidence: Column) -> Column:
    """The nearest examples as ``id:similarity:toxic share``, nearest first."""
    one = lambda e: F.format_string("%s:%.3f:%.2f", e["id"], e["similarity"], e["toxic"])
    return F.array_join(F.transform(evidence, one), ",")
