import re
import sys
from collections import Counter, defaultdict
from functools import cache
from pathlib import Path

import duckdb
import pytest
from llm_data import no_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F
from test_llm_dedup import brute_components, reference_fingerprint

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from compare import compare
from lodeseek.llm.decontamination import LITERAL_SHARE, NUMBER_WORDS, RUN, SHORTEST, THRESHOLD, UNITS, WINDOW, held_items
from lodeseek.llm.queries import ORACLE, QUERIES
from lodeseek.session import load_table

SMALL = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard",
    "op2": "doc_id contaminated item_ids",
    "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id held_out lang_pred score",
    "op5": "doc_id keep_id group_size kept text_sha256",
    "op6": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7": "page_id url text n_chars",
    "op8": "doc_id fingerprint component_id",
    "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10": "doc_id held_out score predicted",
    "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13": "query_id rank vec_id score",
}
# What the rows of a query stand for, and how many there are of each.
KEYS = {
    "op7": ("page_id", "pages", "page_id"),
    "op12": ("conv_id", "conversations", "conv_id"),
    "op13": ("query_id", "embeddings", "vec_id"),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_answers_for_every_row(spark, name):
    result = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(result.columns)
    key, table, own = KEYS.get(name.split("_")[0], ("doc_id", "documents", "doc_id"))
    ids = [r[0] for r in result.select(key).collect()]
    wanted = [r[0] for r in load_table(spark, SMALL, table).select(own).collect()]
    if name.startswith("op12"):
        # A conversation is the smallest of a node or belongs to one; the root has all.
        assert set(ids) <= set(wanted) and min(ids) == min(wanted)
        assert max(r.n_convs for r in result.collect()) == len(set(wanted))
    elif name.startswith("op13"):
        assert set(ids) == {i for i in wanted if i % 20 == 0} and len(ids) == 20 * len(set(ids))
    else:
        assert set(ids) == set(wanted)
        if not name.startswith("op9"):
            assert len(ids) == len(wanted)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    assert compare(spark, connection, QUERIES[name], ORACLE[name], SMALL) is None


UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0010FFFF"
MARKS = r"\u0080-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u2000-\u206F\u3000-\u303F\uFF00-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65"
DIGITS = r"[0-9](?:[0-9]|[.,](?=[0-9]))*"


@cache
def brute_templates(text, form):
    """(symbol, filler) of each token; symbols are words or the kinds of placeholders."""
    result, end, number = [], None, False
    pattern = DIGITS + r"|(?:[A-Za-z]|[^\x00-\x7f])+"
    if form > 0:
        pattern = DIGITS + rf"|(?=[^{MARKS}])[{UNSPACED}]|(?:[A-Za-z]|(?![{MARKS}{UNSPACED}])[^\x00-\x7f])+"
    for m in re.finditer(pattern, text):
        word = m.group()
        begins = end is None or bool(set(text[end : m.start()]) & set(".!?:\n"))
        small = "".join(c.lower() if c.isascii() else c for c in word)
        capital = word[0].isupper() and ord(word[0]) < 0x800
        was, number = number, word[0] in "0123456789" or small in NUMBER_WORDS
        if form == 2:
            result.append((small, None))
        elif number:
            result.append(("<number>", small))
        elif was and small in UNITS:
            result.append(("<unit>", small))
        elif capital and (form == 1 or not begins):
            result.append(("<name>", small))
        else:
            result.append((small, None))
        end = m.end()
    return result


@cache
def brute_windows(text, form, size):
    """(place, symbols, fillers) of the windows with enough plain words."""
    tokens, found = brute_templates(text, form), []
    for at in range(len(tokens) - size + 1):
        part = tokens[at : at + size]
        if sum(f is None for _, f in part) >= size * LITERAL_SHARE:
            found.append((at, tuple(s for s, _ in part), [f for _, f in part]))
    return found


def consistent(slots):
    """Every filler of the item stands for one of the text, and no two names for the same."""
    names = {(a, b) for s, a, b in slots if s == "<name>"}
    return len({(s == "<name>", a) for s, a, _ in slots}) == len({(s == "<name>", a, b) for s, a, b in slots}) and len(
        {b for _, b in names}
    ) == len(names)


def brute_form(text, content, form):
    """Places covered by consistent alignments, windows, all windows, whether fillers differ, a run."""
    own, tokens = brute_templates(content, form), brute_templates(text, form)
    size = min(WINDOW, len(own))
    if not size or (size < SHORTEST and (form != 2 or len(tokens) != size)):
        return set(), 0, 0, False, False
    windows, by_symbols = brute_windows(content, form, size), defaultdict(list)
    for place, wanted, slots in windows:
        by_symbols[wanted].append((place, slots))
    aligned = defaultdict(list)
    for at, symbols, fillers in brute_windows(text, form, size):
        for place, slots in by_symbols.get(symbols, ()):
            aligned[at - place].append((place, {(s, a, b) for s, a, b in zip(symbols, slots, fillers) if a}))
    hit, differs, run = set(), False, False
    for matches in aligned.values():
        slots = set().union(*(pairs for _, pairs in matches))
        if consistent(slots):
            places = {p for p, _ in matches}
            hit |= places
            differs |= any(a != b for _, a, b in slots)
            run |= form > 0 and size == WINDOW and any(set(range(p, p + RUN - size + 1)) <= places for p in places)
    return hit, len(windows), len(own) - size + 1, differs, run


def brute_contaminated(text, items):
    found = {}
    for item, content in items:
        if item is None:
            continue
        forms = [brute_form(text or "", content or "", form) for form in range(3)]
        part = [len(hit) / windows if windows else 0.0 for hit, windows, *_ in forms]
        both, whole = forms[1][0] | forms[2][0], forms[2][2]
        share = max(*part, len(both) / whole if both else 0.0)
        if share >= THRESHOLD or forms[1][4] or forms[2][4]:
            if part[0] >= THRESHOLD:
                differs = forms[0][3]
            elif part[2] >= THRESHOLD or forms[2][4]:
                differs = False
            else:
                differs = forms[0][3] or forms[1][3]
            found[item] = (share, differs)
    return found


def test_decontamination_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in load_table(spark, SMALL, "benchmark").collect()]
    items += [
        (900, "A train leaves Paris with 40 passengers and 12 km later 40 passengers meet 7 others on board near Lyon."),
        (901, "Über 3,5 kg of Äpfel cost 10 euros in the shop that Maria owns. She sells 20 more at 2 euros"),
        (902, "too short"),
        (903, None),
        (904, "Tom has five apples and Sam has three pears. Sam gives Tom two more of them at noon"),
        (905, "Иван купил 5 яблок у Марии, а потом Мария купила 3 груши у соседа за углом дома"),
        (906, "小明有五个苹果，他又买了三个苹果，现在一共有多少个苹果？"),
        (907, "12 + 7 - 3 + 9 - 4 + 8 equals what?"),
        (908, prose(77, 160)),
        (909, "42"),
        (910, "... !"),
    ]
    texts = [r.text for r in load_table(spark, SMALL, "documents").collect()] + [t for _, t, *_ in odd_rows()][:9]
    changed = items[-7][1].replace("Tom", "Ann").replace("five", "9").replace("three", "six")
    texts += [
        changed.replace("Sam", "Bob"),
        # Two names that become one.
        changed.replace("Sam", "Ann"),
        # Two numbers that become one.
        items[-7][1].replace("five", "four").replace("three", "four"),
        items[-6][1].replace("Марии", "Ольги").replace("Мария", "Ольга").replace("Иван", "Пётр").replace("5", "8"),
        f"他说：{items[-5][1]}谢谢。",
        f"{prose(5, 9)}. {items[-4][1]}",
        f"{prose(6, 300)} {' '.join(items[-3][1].split()[40:100])} {prose(7, 300)}",
        f"{prose(6, 300)} {' '.join(items[-3][1].split()[40:60])} {prose(7, 300)}",
        " Too\nshort!", "it is too short", "42", "42 43", "...", "!",
    ]
    for n, (_, content) in enumerate(items[200:202] if len(items) > 210 else items[40:42]):
        texts += [
            f"{prose(n, 20)} {content}",
            re.sub(r"\d+", "77", content),
            content.replace("Paris", "Rome").replace("40", "51").replace("Maria", "Anna").replace("3,5", "1.25"),
            content.replace("40", "51", 1).replace("10", "51"),
            content[: len(content) // 3],
        ]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {
        (r.text_md5, r.item): (round(r.share, 12), r.reparameterised)
        for r in held_items(frame, bench).collect()
    }
    digests = [r[0] for r in frame.select(F.md5(F.coalesce("text", F.lit("")))).collect()]
    wanted = {
        (digest, item): (round(share, 12), differs)
        for digest, text in zip(digests, texts)
        for item, (share, differs) in brute_contaminated(text, items).items()
    }
    assert got == wanted and len(wanted) > 5
    assert {True, False} == {d for _, d in wanted.values()}


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_have_the_dealt_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "near dedup", "decontamination", "packing",
    ]


def test_stages_equal_brute_force(spark):
    docs = load_table(spark, SMALL, "documents")
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    exact = stage("exact dedup")(spark, docs, SMALL)
    assert exact.columns == docs.columns
    groups = defaultdict(list)
    for r in docs.collect():
        groups[normal(r.text)].append((-len(r.text or ""), r.doc_id))
    kept = sorted(r.doc_id for r in exact.collect())
    assert kept == sorted(min(g)[1] for g in groups.values())

    near = stage("near dedup")(spark, docs, SMALL)
    assert near.columns == docs.columns
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    least = {}
    for r, c in zip(rows, brute_components([reference_fingerprint(r.text) for r in rows])):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in near.collect()) == sorted(least.values())

    items = [(r.item_id, r.text) for r in load_table(spark, SMALL, "benchmark").collect()]
    clean = stage("decontamination")(spark, docs, SMALL)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(
        r.doc_id for r in rows if not brute_contaminated(r.text, items)
    )


def test_toxicity_stage_is_its_query(spark):
    docs = load_table(spark, SMALL, "documents")
    kept = {r.doc_id for r in stage("toxicity")(spark, docs, SMALL).collect()}
    scored = QUERIES["op10_toxicity"](spark, SMALL).collect()
    assert kept == {r.doc_id for r in scored if r.predicted == 0}


def test_pipeline_runs_and_packs_what_is_left(spark):
    packed = corpus_pipeline.run(spark, SMALL).collect()
    docs = load_table(spark, SMALL, "documents")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL)
    left = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in packed} == left
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for spans in pieces.values():
        at = 0
        for start, length, total in sorted(spans):
            assert start == at
            at += length
        assert at == total


@pytest.mark.parametrize("name", ["toxicity", "exact dedup", "near dedup", "decontamination"])
def test_stages_take_odd_rows_and_nothing(spark, name):
    for frame in (odd_docs(spark), no_docs(spark)):
        result = stage(name)(spark, frame, SMALL)
        assert result.columns == frame.columns
        assert result.count() <= frame.count()
    assert stage("packing")(spark, odd_docs(spark), SMALL).count() >= len(odd_rows())
    assert stage("packing")(spark, no_docs(spark), SMALL).count() == 0
