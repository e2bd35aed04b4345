"""Line dedup, decontamination and repeated substrings beside brute force, and their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from publedger.llm import decontaminate, line_dedup, substring_dedup
from tests.llm.helpers import documents, lower, sha, words

LONG = " ".join(words(6000, 1))


def lines_by_hand(rows):
    def key(line):
        k = lower(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(2**63 - 1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (2**63 - 1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


LINES = [
    (5, "Shared line number one\nown line of five\nshort\nshort"), (2, "\tSHARED line number one \nother"), (9, None), (7, ""), (8, "\n\n"),
    (3, "exactly10!\nunder ten"), (4, "exactly10!\nunder ten"), (6, "Straße äöü 1\nown line of five"), (6, "Straße äöü 1\nown line of five"),
    (None, "shared line number one\nkept"), (11, LONG + "\n" + LONG), (12, LONG), (13, "twice in one doc\ntwice in one doc"),
]


def cleaned(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in df.collect())


def test_lines_equal_brute_force(spark):
    assert cleaned(line_dedup.dedup_lines(documents(spark, LINES))) == lines_by_hand(LINES)


def test_lines_keep_other_columns_and_empty_tables(spark):
    out = line_dedup.dedup_lines(documents(spark, LINES, clashing=True))
    assert cleaned(out) == lines_by_hand(LINES)
    assert out.filter("text2 = 'x' and fp = 'x'").count() == len(LINES)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_line_index_is_reversible(spark):
    first, second = documents(spark, LINES[:6]), documents(spark, LINES[6:])
    start = line_dedup.LineIndex.of(line_dedup.document_keys(first))
    both = start.insert(second)
    whole = line_dedup.LineIndex.of(line_dedup.document_keys(documents(spark, LINES)))
    state = lambda i: (set(map(tuple, i.counts.collect())), set(map(tuple, i.shared.collect())))
    assert state(both) == state(whole)
    assert state(both.delete(second)) == state(start)
    keys = line_dedup.document_keys(documents(spark, LINES))
    assert set(map(tuple, line_dedup.lines_to_drop(keys, both).select("doc_id").collect())) == set(
        map(tuple, line_dedup.lines_to_drop(keys, whole).select("doc_id").collect())
    )


def test_filters_in_many_blocks_let_the_same_keys_through(spark):
    keys = line_dedup.document_keys(documents(spark, LINES))
    index = line_dedup.LineIndex.of(keys)
    one, many = (Counter(map(tuple, line_dedup.probe(keys, index, size).collect())) for size in (1 << 30, 1))
    assert one == many and sum(one.values()) >= 8


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, size=(5000, 2), dtype=np.int64).astype(np.uint64)
    cuckoo = line_dedup.CuckooFilter.built(keys[:3000])
    assert cuckoo.contains(keys[:3000]).all()
    assert cuckoo.contains(keys[3000:]).mean() < 0.01
    cuckoo.delete(keys[:1500])
    assert cuckoo.contains(keys[1500:3000]).all()
    assert line_dedup.CuckooFilter.from_bytes(cuckoo.to_bytes()).contains(keys[1500:3000]).all()


ITEMS = [(1, " ".join(words(25, 2))), (2, "One-word"), (3, None), (4, "..."), (10, "Äpfel und 3 Birnen"), (None, "lost item words"), (1, " ".join(words(25, 2)))]
LEAKS = [
    (1, "x " + " ".join(words(25, 2)[3:14]) + " y"), (2, "clean text here"), (3, None), (4, ""), (5, "a ONE, word! and one word"),
    (6, " ".join(words(25, 2)).upper() + " äpfel UND 3 birnen"), (7, "the lost item words"), (8, " ".join(words(25, 2)[:9])),
    (9, LONG + " one word " + LONG), (9, LONG + " one word " + LONG),
]


def leaks_by_hand(docs, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    patterns = {}
    for item, text in items:
        w = find(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = find(text)
        hit, names = set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in patterns:
                    hit.update(range(i, i + n))
                    names |= patterns[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(str(x) for x in names if x is not None)), bool(hit)))
    return Counter(out)


def told(df):
    return Counter(
        (r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), tuple(r["items"]), r["contaminated"]) for r in df.collect()
    )


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_leaks_equal_brute_force(spark, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_leaks(documents(spark, LEAKS), items, block_bytes=block_bytes)
    assert told(found) == leaks_by_hand(LEAKS, ITEMS)


def test_leaks_of_empty_tables_and_clashing_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert not any(r["contaminated"] for r in decontaminate.find_leaks(documents(spark, LEAKS), none).collect())
    assert decontaminate.find_leaks(documents(spark, []), items).count() == 0
    out = decontaminate.find_leaks(documents(spark, LEAKS, clashing=True), items)
    assert told(out) == leaks_by_hand(LEAKS, ITEMS) and out.filter("text2 = 'x'").count() == len(LEAKS)


def test_matcher_finds_all_overlapping_occurrences():
    rng = random.Random(4)
    patterns = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(9, 14))) for _ in range(40)})
    text = bytes(rng.choice(b"ab") for _ in range(20_000))
    expected = {(i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i)}
    found = set(decontaminate.WuManber(patterns).find(text + bytes(8), np.array([0]), np.array([len(text)])))
    assert found == expected


def substrings_by_hand(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) if len(t) else 0
        out.append((doc, len(t), int(gone.sum()), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return Counter(out)


def passage_rows():
    passage, other = " ".join(words(200, 5)), " ".join(words(100, 6))
    own = lambda k: " ".join(words(60, 100 + k))
    rows = [(k, f"{own(k)} {passage[k * 3:]} {own(k + 50)}") for k in range(8)]
    rows += [(20, None), (21, ""), (22, other[:400]), (23, other[:400]), (24, other[1:400]), (25, "x" * 1000), (26, "y" * 401), (27, "z" * 400)]
    rows += [(28, own(1) + passage[:700] + own(2) + passage[100:600]), (None, passage), (30, "é" * 300), (31, "aé" + "é" * 250), (32, own(7)), (32, own(7) * 3)]
    return rows


def test_substrings_equal_brute_force(spark, monkeypatch):
    rows = passage_rows()
    expected = substrings_by_hand(rows)
    read = lambda df: Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in df.collect())
    assert read(substring_dedup.dedup_substrings(documents(spark, rows, clashing=True))) == expected
    assert substring_dedup.dedup_substrings(documents(spark, [])).count() == 0


def test_pieces_of_long_texts_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 500)
    texts = [LONG[:5000].encode(), b"short", LONG[:900].encode()]
    seen = []
    for piece in substring_dedup.pieces(texts):
        for owner, shift, first, last in zip(piece.owner, piece.shift, piece.first, piece.last):
            for at in range(first, last):
                seen.append((int(owner), int(at + shift)))
                assert piece.data[at : at + 400] == texts[owner][at + shift : at + shift + 400]
    assert Counter(seen) == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t) - 399))
