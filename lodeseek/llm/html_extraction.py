"""Main text of web pages by a recurrent labeller of their blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.html_blocks import Block, blocks_of
from lodeseek.llm.sampling import sampled_ids
from lodeseek.llm.text import bytes_of, hash_runs, lowered, word_runs
from lodeseek.session import load_table

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 320, 32, 5
INPUTS = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
HIDDEN = 12
# Pages that are learnt from, at most, and the longest of them.
MOST_PAGES, LONGEST_PAGE = 160, 200_000
# Blocks of a page that are trained as one sequence; longer pages are several.
TRAINED_TOGETHER = 512
# Arranged pages per real one, and how long the labeller is fitted.
ARRANGED, EPOCHS, BATCH, RATE = 6, 8, 24, 0.02
# Pages that are labelled together, and blocks of them.
PAGES_AT_ONCE, BLOCKS_AT_ONCE = 64, 20_000

# Elements and names (of class, id or role) that surround main text and
# that surround other text.
MAIN_PLACES = (
    "article", "main", "div.content", "div#content", "div.post", "div.entry-content",
    "div.article-body", "section.story", "div#main", "div.post-content", "article.post",
    "main#main-content", "div.text", "div.page", "div.body-copy",
)
WRAPPERS = (
    "div", "div.wrapper", "div.container", "div.layout", "div.row", "div.col", "div#page",
    "div.inner", "section", "div.grid", "div.columns", "div#root", "div.outer", "div.site",
)
OTHER_PLACES = (
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "nav.menu", "ul.nav", "ul.menu",
    "div.menu", "div.nav", "div.navbar", "div#navigation", "div.breadcrumb", "ol.breadcrumbs",
    "div.header", "div#header", "div.site-header", "header.masthead", "div.footer", "div#footer",
    "div.site-footer", "div.copyright", "div.sidebar", "div#sidebar", "aside.sidebar", "aside.widget",
    "div.widget", "div.related", "section.related", "div.recommended", "div.ad", "div.ads",
    "div.advert", "div.advertisement", "div.banner", "div.sponsored", "div.promo", "aside.ad",
    "section.promo", "div.cookie", "div.cookie-notice", "div.cookie-banner", "div#cookie-consent",
    "div.notice", "div.alert", "div.gdpr", "div.popup", "div.modal", "div.overlay", "div.consent",
    "div.newsletter", "div.subscribe", "form.search", "form.signup", "div.login", "div.search",
    "div.comments", "div#comments", "section.comments", "section#comments", "ol.comment-list",
    "ul.comments", "div.comment", "article.comment", "div.reader-comments", "div.responses",
    "div.discussion", "div#disqus", "div.replies", "div.social", "div.share", "ul.share-buttons",
    "div.tags", "div.pagination", "div.pager", "div.skip-link", "div.toolbar", "div.author-box",
)
_OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "option"}


def _bucket(name: str, buckets: int) -> int:
    return zlib.crc32(name.encode()) % buckets


def path_features(path: tuple) -> list[int]:
    """Buckets of a path: its elements, the names on them, and pairs of neighbours."""
    found = []
    for depth, (tag, names) in enumerate(path):
        found.append(_bucket(tag, PATH_BUCKETS))
        found += [_bucket(f".{n}", PATH_BUCKETS) for n in names]
        if depth:
            found.append(_bucket(f"{path[depth - 1][0]}>{tag}", PATH_BUCKETS))
    return sorted(set(found))


def block_vectors(blocks: list[Block]) -> np.ndarray:
    """One input vector per block: path buckets, hashed words, lengths and links."""
    x = np.zeros((len(blocks), INPUTS), dtype=np.float32)
    known: dict[tuple, list[int]] = {}
    for i, block in enumerate(blocks):
        if block.path not in known:
            known[block.path] = path_features(block.path)
        x[i, known[block.path]] = 1.0
    data, offsets = bytes_of(pa.array([b.text for b in blocks], pa.string()))
    data = lowered(data)
    starts, ends, rows = word_runs(data, offsets)
    buckets = (hash_runs(data, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    counts = np.bincount(rows * WORD_BUCKETS + buckets, minlength=len(blocks) * WORD_BUCKETS)
    words = np.bincount(rows, minlength=len(blocks))
    x[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts.reshape(
        len(blocks), WORD_BUCKETS
    ) / np.maximum(words, 1)[:, None]
    letters = np.diff(offsets)
    x[:, -5] = np.log1p(words) / 4
    x[:, -4] = [b.linked for b in blocks]
    x[:, -3] = [b.text[-1:] in ".!?…\"'”" for b in blocks]
    x[:, -2] = np.log1p(letters) / 6
    x[:, -1] = [min(1.0, len(b.path) / 10) for b in blocks]
    return x


@dataclass
class Labeller:
    """A bidirectional LSTM over a page's blocks and a logistic output per block."""

    forward: list[np.ndarray]
    backward: list[np.ndarray]
    out: list[np.ndarray]

    @staticmethod
    def new(seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)

        def direction() -> list[np.ndarray]:
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            return [
                rng.normal(0, 0.1, (INPUTS, 4 * HIDDEN)).astype(np.float32),
                rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32),
                bias,
            ]

        return Labeller(
            direction(),
            direction(),
            [rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, dtype=np.float32)],
        )

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _sigmoid(self._states(x, lengths)[0] @ self.out[0] + self.out[1])

    def _states(self, x: np.ndarray, lengths: np.ndarray):
        turn = _turned(lengths, x.shape[1])
        rows = np.arange(len(x))[:, None]
        ahead, tape_1 = _lstm(x, lengths, self.forward)
        behind, tape_2 = _lstm(x[rows, turn], lengths, self.backward)
        return np.concatenate([ahead, behind[rows, turn]], axis=2), (tape_1, tape_2, turn, rows)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over all blocks, in the order of `weights`."""
        states, (tape_1, tape_2, turn, rows) = self._states(x, lengths)
        mask = np.arange(x.shape[1])[None] < lengths[:, None]
        error = (_sigmoid(states @ self.out[0] + self.out[1]) - y) * mask / mask.sum()
        slope = error[:, :, None] * self.out[0]
        first = _lstm_back(slope[:, :, :HIDDEN], tape_1, self.forward)
        second = _lstm_back(slope[:, :, HIDDEN:][rows, turn], tape_2, self.backward)
        return [
            *first,
            *second,
            np.einsum("bt,bth->h", error, states),
            error.sum(keepdims=True).reshape(1),
        ]

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.forward, *self.backward, *self.out]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _turned(lengths: np.ndarray, width: int) -> np.ndarray:
    """Places that turn each sequence around and leave what follows it."""
    at = np.arange(width)[None]
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


def _lstm(x: np.ndarray, lengths: np.ndarray, weights: list[np.ndarray]):
    take, recur, bias = weights
    n, width, _ = x.shape
    given = (x.reshape(n * width, -1) @ take + bias).reshape(n, width, -1)
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, steps = np.zeros((n, width, HIDDEN), np.float32), []
    for t in range(width):
        gates = given[:, t] + h @ recur
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        live = (t < lengths)[:, None]
        new = f * c + i * g
        squashed = np.tanh(new)
        steps.append((h, c, i, f, o, g, squashed, live))
        c = np.where(live, new, c)
        h = np.where(live, o * squashed, h)
        states[:, t] = h
    return states, (x, steps)


def _lstm_back(slope: np.ndarray, tape, weights: list[np.ndarray]) -> list[np.ndarray]:
    x, steps = tape
    _, recur, _ = weights
    n, width, _ = x.shape
    inner = np.zeros((n, width, 4 * HIDDEN), np.float32)
    d_recur = np.zeros_like(recur)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(width - 1, -1, -1):
        h, c, i, f, o, g, squashed, live = steps[t]
        down = (dh + slope[:, t]) * live
        cell = dc * live + down * o * (1 - squashed**2)
        inner[:, t] = np.concatenate(
            [
                cell * g * i * (1 - i),
                cell * c * f * (1 - f),
                down * squashed * o * (1 - o),
                cell * i * (1 - g**2),
            ],
            axis=1,
        )
        d_recur += h.T @ inner[:, t]
        dh = np.where(live, inner[:, t] @ recur.T, dh)
        dc = np.where(live, cell * f, dc)
    flat = inner.reshape(n * width, -1)
    return [x.reshape(n * width, -1).T @ flat, d_recur, flat.sum(axis=0)]


def landmark_label(path: tuple) -> bool | None:
    """What the page's own markup says of a block; None where it says nothing."""
    others = {n for place in OTHER_PLACES for n in _place(place)[1]}
    inside = None
    for tag, names in path:
        if tag in _OTHER_TAGS or set(names) & others - {"box", "list", "site", "reader", "link"}:
            return False
        if tag in ("article", "main"):
            inside = True
    return inside


def _place(place: str) -> tuple[str, list[str]]:
    mark = "." if "." in place else "#" if "#" in place else None
    tag, _, name = place.partition(mark) if mark else (place, "", "")
    return tag, [n for n in name.split("-") if n]


def _opening(place: str) -> tuple[str, str]:
    mark = "." if "." in place else "#" if "#" in place else None
    tag, _, name = place.partition(mark) if mark else (place, "", "")
    kind = {".": "class", "#": "id", None: ""}[mark]
    return f'<{tag} {kind}="{name}">' if mark else f"<{tag}>", f"</{tag}>"


def arranged_page(texts: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page made of given texts: a main part between and around other parts, and its labels.

    Real pages of one crawl may use one layout only. These teach the labeller the other
    places where main and other text stand, under the words of the crawl.
    """
    page: list[str] = []
    main: list[tuple[int, int]] = []
    size = 0

    def put(piece: str, keep: bool = False) -> None:
        nonlocal size
        page.append(piece)
        if keep:
            main.append((size, size + len(piece)))
        size += len(piece)

    def words(least: int, most: int) -> str:
        text = texts[rng.integers(len(texts))].split()
        count = int(rng.integers(least, most + 1))
        begin = int(rng.integers(max(1, len(text) - count)))
        return " ".join(text[begin : begin + count]).replace("&", "&amp;").replace("<", "&lt;") or "text"

    def other() -> None:
        start, stop = _opening(OTHER_PLACES[rng.integers(len(OTHER_PLACES))])
        put(start)
        shape = rng.integers(4)
        if shape == 0:
            put("<ul>" + "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(rng.integers(2, 8))) + "</ul>")
        elif shape == 1:
            put(words(2, 20))
        elif shape == 2:
            put("".join(f"<p>{words(3, 60)}</p>" for _ in range(rng.integers(1, 4))))
        else:
            level = int(rng.integers(1, 5))
            put(f"<h{level}>{words(1, 6)}</h{level}><div><p>{words(2, 30)}</p></div>")
        put(stop)

    def paragraph() -> None:
        shape = rng.integers(10)
        if shape < 6:
            put(f"<p>{words(2, 120)}</p>", True)
        elif shape == 6:
            put(f"<h2>{words(1, 9)}</h2>", True)
        elif shape == 7:
            put("<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>", True)
        elif shape == 8:
            put(f"<blockquote><p>{words(3, 40)}</p></blockquote>", True)
        else:
            put(f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 9)}</td></tr></table>", True)

    def opened(places: tuple[str, ...], most: int) -> list[str]:
        chosen = [_opening(places[rng.integers(len(places))]) for _ in range(rng.integers(0, most + 1))]
        for start, _ in chosen:
            put(start)
        return [stop for _, stop in reversed(chosen)]

    def others(most: int) -> None:
        for _ in range(rng.integers(0, most + 1)):
            other()

    put("<html><body>")
    others(2)
    wrappers = opened(WRAPPERS, 2)
    others(2)
    outer = opened((*MAIN_PLACES, *WRAPPERS), 1)
    if rng.random() < 0.3:
        other()
    start, stop = _opening(MAIN_PLACES[rng.integers(len(MAIN_PLACES))])
    put(start)
    inner = opened(WRAPPERS, 1) if rng.random() < 0.3 else []
    if rng.random() < 0.8:
        put(f"<h1>{words(2, 12)}</h1>", True)
    for _ in range(rng.integers(1, 9)):
        if rng.random() < 0.12:
            other()
        paragraph()
    for end in inner:
        put(end)
    if rng.random() < 0.3:
        other()
    put(stop)
    if rng.random() < 0.4:
        other()
    for end in outer:
        put(end)
    others(2)
    for end in wrappers:
        put(end)
    others(2)
    put("</body></html>")
    blocks = blocks_of("".join(page))
    labels = np.array([any(a <= b.place < e for a, e in main) for b in blocks], dtype=np.float32)
    return blocks, labels


def fit_labeller(pages: list[str], seed: int = 5) -> Labeller:
    """Learns from the landmarks of real pages and from arranged pages of their texts."""
    rng = np.random.default_rng(seed)
    examples, texts = [], []
    for page in pages:
        blocks = blocks_of(page)
        texts += [b.text for b in blocks if len(b.text) > 40]
        labels = [landmark_label(b.path) for b in blocks]
        if any(labels):
            examples.append((blocks, np.array([bool(v) for v in labels], dtype=np.float32)))
    examples += [arranged_page(texts, rng) for _ in range(ARRANGED * len(pages) if texts else 0)]
    examples = [part for b, y in examples if b for part in _windows(block_vectors(b), y)]
    model = Labeller.new(seed)
    weights = model.weights
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(EPOCHS if examples else 0):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            part = [examples[i] for i in order[at : at + BATCH]]
            x, lengths = _padded([v for v, _ in part])
            y = np.zeros(x.shape[:2], dtype=np.float32)
            for i, (_, labels) in enumerate(part):
                y[i, : len(labels)] = labels
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 5e-4
            for w, g, (m, v) in zip(weights, model.gradients(x, lengths, y), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _windows(vectors: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A page's blocks, of a very long page in stretches; every block is in one."""
    starts = range(0, len(vectors), TRAINED_TOGETHER)
    return [(vectors[a : a + TRAINED_TOGETHER], labels[a : a + TRAINED_TOGETHER]) for a in starts]


def _padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(v) for v in vectors])
    x = np.zeros((len(vectors), lengths.max(), INPUTS), dtype=np.float32)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x, lengths


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The kept blocks of every page, joined by one space."""
    blocks = [blocks_of(p) for p in pages]
    result = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
    while order:
        # Pages of like length together: the padded table stays within BLOCKS_AT_ONCE.
        count = 1
        while (
            count < min(PAGES_AT_ONCE, len(order))
            and len(blocks[order[count]]) * (count + 1) <= BLOCKS_AT_ONCE
        ):
            count += 1
        part, order = order[:count], order[count:]
        ends = np.cumsum([len(blocks[i]) for i in part])
        vectors = block_vectors([b for i in part for b in blocks[i]])
        x, lengths = _padded(np.split(vectors, ends[:-1]))
        keep = model.probabilities(x, lengths) >= 0.5
        for row, i in enumerate(part):
            result[i] = " ".join(b.text for b, k in zip(blocks[i], keep[row]) if k)
    return result


def training_pages(pages: DataFrame, id_col: str, html_col: str, most: int = MOST_PAGES) -> list[str]:
    """Pages of a sample of ``most`` ids, of at most LONGEST_PAGE bytes.

    Only ids are ordered; the pages themselves, at most ``most``, come by a join. Of pages
    with one id the first by digest counts.
    """
    short = pages.filter(F.octet_length(html_col) <= LONGEST_PAGE).select(
        F.col(id_col).alias("__id"), F.col(html_col).alias("__page")
    )
    chosen = short.join(F.broadcast(sampled_ids(short, "__id", most)), "__id")
    one_each = chosen.groupBy("__id").agg(F.min(F.struct(F.md5("__page").alias("d"), "__page")).alias("p"))
    return [r[0] for r in one_each.orderBy("__id").select("p.__page").collect()]


def extract_main_text(df: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """``df`` without its page, with ``text``: the main text of the whole page.

    Every block of the page is labelled in the context of all others. NULL, empty and
    block-less pages have the empty text. A column named ``text`` is replaced.
    """
    columns = [c for c in df.columns if c not in (html_col, "text")]
    schema = T.StructType([df.schema[c] for c in columns]).add("text", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = main_texts(model, batch.column("__page").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in columns], pa.array(texts, pa.string())],
                    names=schema.names,
                )

    page = F.coalesce(F.col(html_col), F.lit("")).alias("__page")
    return df.select(*columns, page).mapInArrow(work, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = load_table(spark, sf_dir, "pages")
    model = fit_labeller(training_pages(pages, "page_id", "html"))
    texts = extract_main_text(pages, model)
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
