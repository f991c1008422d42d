"""Secrets in whole texts: fixed patterns, and a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.sampling import sampled_ids
from lodeseek.llm.text import bytes_of, hash_runs, in_parts, lowered, word_runs
from lodeseek.session import load_table

# The base patterns and their least lengths, in the order of their kinds.
ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "crf")

# Documents that the field is fitted on, at most, and windows of them of each sort.
MOST_DOCUMENTS, MOST_WINDOWS = 20_000, 3000
HALF_WINDOW = 6
WINDOW = 2 * HALF_WINDOW + 1
STEPS, LEARNING_RATE, RIDGE = 200, 0.2, 1e-4

O, B, I = 0, 1, 2  # noqa: E741  the usual names of the tags
WORD_BUCKETS = 1024
# Sizes of the feature groups, in the order of `features`.
GROUPS = (8, 5, 4, 5, 4, 2, 6, 3, WORD_BUCKETS, WORD_BUCKETS, 5, 5, 4)
STARTS = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
FEATURES = int(sum(GROUPS))

_TOKEN = np.zeros(256, dtype=bool)
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _TOKEN[_first : _last + 1] = True
_TOKEN[list(b"_+/.-")] = True
_TOKEN[128:] = True
_DIGIT, _UPPER, _LOWER, _HEX, _SIGN = (np.zeros(256, dtype=bool) for _ in range(5))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
_HEX[48:58] = _HEX[97:103] = True
_SIGN[list(b"_+/.-")] = True
_BEFORE = np.zeros(256, dtype=np.int64)
for _code, _byte in ((1, b"="), (2, b":"), (3, b"\"'"), (4, b"@"), (5, b",;()[]{}<>|")):
    _BEFORE[list(_byte)] = _code


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, by start and then kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [
            ("assign", m.start(), m.end())
            for m in ASSIGN.finditer(text)
            if len(m.group(2)) >= LEAST_ASSIGN
        ]
    if "AKIA" in text:
        spans += [
            ("access", m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST_ACCESS
        ]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(spans)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets, and starts, ends and rows of the runs that a secret may consist of."""
    data, offsets = bytes_of(column)
    return (data, offsets, *word_runs(data, offsets, _TOKEN))


def _bucket(values: np.ndarray, edges: list[int]) -> np.ndarray:
    return np.searchsorted(np.array(edges), values, "right")


def features(
    data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray
) -> np.ndarray:
    """One active feature per group and token, as columns of the weight table.

    Shape: length, digits, capitals, changes between letters and digits, signs, only
    hexadecimal digits. Surroundings: what stands just before, how far, the words before
    and after. File: its length, its share of digits and its assignment signs.
    """
    length = ends - starts

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return total[ends] - total[starts]

    digit = _DIGIT[data]
    switch = np.zeros(len(data), dtype=bool)
    switch[1:] = digit[1:] != digit[:-1]
    switches = np.concatenate([[0], np.cumsum(switch, dtype=np.int64)])
    changes = switches[ends] - switches[np.minimum(starts + 1, len(data))]
    opens = np.zeros(len(starts), dtype=bool)
    opens[1:] = rows[1:] == rows[:-1]
    previous_end = np.where(opens, np.concatenate([[0], ends[:-1]]), starts)
    gap = starts - previous_end
    beside = _BEFORE[data[np.maximum(starts - 1, 0)]]
    beside[gap == 0] = 0
    words = hash_runs(lowered(data), starts, ends) % np.uint64(WORD_BUCKETS - 1) + np.uint64(1)
    words = words.astype(np.int64)
    before = np.where(opens, np.concatenate([[0], words[:-1]]), 0)
    follows = np.zeros(len(starts), dtype=bool)
    follows[:-1] = opens[1:]
    after = np.where(follows, np.concatenate([words[1:], [0]]), 0)
    size = np.diff(offsets)
    marks = np.concatenate([[0], np.cumsum((data == 61) | (data == 58), dtype=np.int64)])
    total_digits = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
    share = (total_digits[offsets[1:]] - total_digits[offsets[:-1]]) / np.maximum(size, 1)
    file = [
        _bucket(size, [200, 1000, 4000, 16000]),
        _bucket(share, [0.0001, 0.005, 0.02, 0.1]),
        _bucket(marks[offsets[1:]] - marks[offsets[:-1]], [1, 2, 8]),
    ]
    columns = [
        _bucket(length, [4, 6, 9, 13, 17, 24, 40]),
        _bucket(within(_DIGIT), [1, 3, 6, 12]),
        _bucket(within(_UPPER), [1, 2, 6]),
        _bucket(changes, [1, 2, 4, 7]),
        _bucket(within(_SIGN), [1, 2, 4]),
        (within(_HEX) == length).astype(np.int64),
        beside,
        _bucket(gap, [1, 2]),
        before,
        after,
        *[f[rows] for f in file],
    ]
    return np.stack(columns, axis=1) + STARTS


@dataclass
class Field:
    """Weights of a linear-chain conditional random field over O, B and I."""

    emit: np.ndarray
    step: np.ndarray

    def certain_margin(self) -> float:
        """How far O must lead for the best path to be O whatever the neighbours are."""
        others = [
            self.step[a, y] + self.step[y, b] - self.step[a, O] - self.step[O, b]
            for y in (B, I)
            for a in (O, B, I)
            for b in (O, B, I)
        ]
        ends = [abs(self.step).max() * 2]
        return float(max(*others, *ends))

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a stretch between two places that are O."""
        best, back = scores[0] + self.step[O], []
        for row in scores[1:]:
            paths = best[:, None] + self.step
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        tag = int((best + self.step[:, O]).argmax())
        tags = [tag]
        for pointers in reversed(back):
            tag = int(pointers[tag])
            tags.append(tag)
        return tags[::-1]


def fit_field(x: np.ndarray, y: np.ndarray) -> Field:
    """Maximum likelihood by forward-backward over equally long windows, full batches.

    ``x`` holds features of (windows, WINDOW, groups), -1 outside a text; ``y`` the tags.
    """
    emit, step = np.zeros((FEATURES + 1, 3)), np.zeros((3, 3))
    n, length, groups = x.shape
    if not n:
        # Nothing was learnt: every token is outside.
        emit[:, O] = 1.0
        return Field(emit[:FEATURES], step)
    flat = np.where(x < 0, FEATURES, x).reshape(n * length, groups)
    target = np.eye(3)[y]
    pairs = np.einsum("nta,ntb->ab", target[:, :-1], target[:, 1:])
    square = [np.full_like(emit, 1e-8), np.full_like(step, 1e-8)]
    for _ in range(STEPS):
        emit[FEATURES] = 0.0
        scores = emit[flat].sum(axis=1).reshape(n, length, 3)
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, length):
            forward[:, t] = scores[:, t] + _log_sum(forward[:, t - 1, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            backward[:, t] = _log_sum(step + (scores[:, t + 1] + backward[:, t + 1])[:, None], 2)
        whole = _log_sum(forward[:, -1], 1)
        marginal = np.exp(forward + backward - whole[:, None, None])
        expected = np.zeros((3, 3))
        for t in range(length - 1):
            joint = forward[:, t, :, None] + step
            joint += (scores[:, t + 1] + backward[:, t + 1])[:, None] - whole[:, None, None]
            expected += np.exp(joint).sum(axis=0)
        error = (target - marginal).reshape(-1, 3)
        slope = np.stack(
            [
                np.bincount(flat.ravel(), np.repeat(error[:, k], flat.shape[1]), FEATURES + 1)
                for k in range(3)
            ],
            axis=1,
        )
        for values, gradient, seen in (
            (emit, slope / n - RIDGE * emit, square[0]),
            (step, (pairs - expected) / n - RIDGE * step, square[1]),
        ):
            seen += gradient**2
            values += LEARNING_RATE * gradient / np.sqrt(seen)
    return Field(emit[:FEATURES], step)


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - most).sum(axis=axis)) + most.squeeze(axis)


def token_tags(
    text: str, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[str, int, int]]
) -> np.ndarray:
    """Tags of a text's tokens (byte places) from its base spans: the secret part of each."""
    tags = np.zeros(len(starts), dtype=np.int64)
    for kind, begin, end in spans:
        if kind == "assign":
            begin = end - len(ASSIGN.match(text[begin:end]).group(2))
        a = len(text[:begin].encode())
        e = a + len(text[begin:end].encode())
        inside = np.flatnonzero((starts < e) & (ends > a))
        tags[inside] = I
        tags[inside[:1]] = B
    return tags


def training_windows(
    docs: DataFrame, id_col: str, text_col: str, most_documents: int, most_windows: int
) -> tuple[np.ndarray, np.ndarray]:
    """Windows around the base spans of a bounded sample, and as many of other places.

    The sample is the ``most_documents`` smallest hashes of non-NULL ids. The base spans are
    the labels; shape and surroundings are what the field takes from them.
    """
    chosen = sampled_ids(docs, id_col, most_documents)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(chosen), "__id"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                data, offsets, starts, ends, rows = tokens(batch.column("__text"))
                if not len(starts):
                    continue
                x = features(data, offsets, starts, ends, rows)
                cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                found: list[tuple] = []
                for i, text in enumerate(batch.column("__text").to_pylist()):
                    a, b = int(cuts[i]), int(cuts[i + 1])
                    if not text or a == b:
                        continue
                    shift = offsets[i]
                    tags = token_tags(text, starts[a:b] - shift, ends[a:b] - shift, base_spans(text))
                    marked = np.flatnonzero(tags == B)
                    # One more place, fixed by the text's length.
                    other = (len(text) * 2654435761) % (b - a)
                    for at, positive in [*[(m, True) for m in marked.tolist()], (other, False)]:
                        places = np.arange(at - HALF_WINDOW, at + HALF_WINDOW + 1)
                        inside = (places >= 0) & (places < b - a)
                        places = np.clip(places, 0, b - a - 1)
                        part = np.where(inside[:, None], x[a:b][places], -1)
                        found.append(
                            (
                                int(starts[a + at] - shift),
                                positive,
                                part.ravel().tolist(),
                                np.where(inside, tags[places], O).tolist(),
                                batch.column("__id")[i].as_py(),
                            )
                        )
                if found:
                    place, positive, part, tags, ids = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([str(i) for i in ids]),
                            pa.array(place, pa.int64()),
                            pa.array(positive, pa.bool_()),
                            pa.array(part, pa.list_(pa.int32())),
                            pa.array(tags, pa.list_(pa.int32())),
                        ],
                        names=["id", "place", "positive", "x", "y"],
                    )

    windows = rows.mapInArrow(
        work, "id string, place long, positive boolean, x array<int>, y array<int>"
    )
    # At most 2 * most_windows windows of some hundred numbers reach the driver.
    ranked = [
        windows.filter(F.col("positive") == sort)
        .orderBy(F.xxhash64("id", "place"), "id", "place")
        .limit(most_windows)
        .collect()
        for sort in (True, False)
    ]
    rows = [r for part in ranked for r in part]
    x = np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), WINDOW, len(GROUPS))
    y = np.array([r["y"] for r in rows], dtype=np.int64).reshape(len(rows), WINDOW)
    return x, y


def fit_on(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_documents: int = MOST_DOCUMENTS,
    most_windows: int = MOST_WINDOWS,
) -> Field:
    return fit_field(*training_windows(docs, id_col, text_col, most_documents, most_windows))


def field_spans(field: Field, column: pa.Array) -> dict[int, list[tuple[int, int]]]:
    """Per row, byte spans that Viterbi tags B or I.

    Where O leads by more than any transitions could give back, the best path is O, so the
    path falls apart into short stretches between such places; each is decoded exactly.
    """
    data, offsets, starts, ends, rows = tokens(column)
    found: dict[int, list[tuple[int, int]]] = {}
    if not len(starts):
        return found
    x = features(data, offsets, starts, ends, rows)
    scores = np.zeros((len(starts), 3))
    for group in range(x.shape[1]):
        scores += field.emit[x[:, group]]
    lead = scores[:, O] - scores[:, 1:].max(axis=1)
    open_at = np.flatnonzero(lead <= field.certain_margin())
    if not len(open_at):
        return found
    breaks = np.flatnonzero((np.diff(open_at) != 1) | (np.diff(rows[open_at]) != 0)) + 1
    for stretch in np.split(open_at, breaks):
        tags = field.viterbi(scores[stretch])
        at = 0
        while at < len(tags):
            if tags[at] == O:
                at += 1
                continue
            last = at
            while last + 1 < len(tags) and tags[last + 1] == I:
                last += 1
            row = int(rows[stretch[at]])
            begin = int(starts[stretch[at]] - offsets[row])
            found.setdefault(row, []).append((begin, int(ends[stretch[last]] - offsets[row])))
            at = last + 1
    return found


def scan_secrets(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``df`` with ``spans``: (kind, start, end) in code points, by start and kind.

    Base patterns stay as they are; spans of the field that touch none of them are added
    as kind ``crf``. NULL and empty texts have none. A column named ``spans`` is replaced.
    """
    df = df.drop("spans", "__text")
    columns = df.columns
    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    schema = T.StructType([*df.schema.fields, T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                added = field_spans(field, batch.column("__text"))
                result = []
                for i, text in enumerate(batch.column("__text").to_pylist()):
                    spans = base_spans(text)
                    if i in added:
                        spans = in_order(spans + _apart(text, added[i], spans))
                    result.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in columns], pa.array(result, kind)], names=schema.names
                )

    return df.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(work, schema)


def _apart(
    text: str, byte_spans: list[tuple[int, int]], spans: list[tuple[str, int, int]]
) -> list[tuple[str, int, int]]:
    """Byte spans as code point spans, without closing points, if no base span is touched."""
    raw = text.encode()
    result = []
    for begin, end in byte_spans:
        value = raw[begin:end].decode().rstrip(".-")
        start = len(raw[:begin].decode())
        stop = start + len(value)
        if value and all(stop <= s or start >= e for _, s, e in spans):
            result.append(("crf", start, stop))
    return result


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = load_table(spark, sf_dir, "documents")
    found = scan_secrets(docs.select("doc_id", "text"), fit_on(docs))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
