"""Phrases, conversation tries and chat masks beside brute force, and their SQL on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from publedger.llm import chat_format, conversation_trie, phrases, queries
from tests.compare import difference, duck
from tests.llm.helpers import lower, sha

FOLDER = "/root/testdata/sf0.001"


# -- counting quotient filters and phrases -----------------------------------------------------------


@pytest.mark.parametrize("half", [2, 7, 34, 64])
def test_scramble_is_a_permutation(half):
    rng = np.random.default_rng(half)
    top = (1 << half) - 1
    hi, lo = (rng.integers(0, top, 5000, np.uint64, endpoint=True) for _ in range(2))
    a, b = phrases.scramble(hi, lo, half)
    assert a.max() <= top and b.max() <= top
    c, d = phrases.unscramble(a, b, half)
    assert (c == hi).all() and (d == lo).all()
    if half == 2:
        every = np.arange(16, dtype=np.uint64)
        x, y = phrases.scramble(every >> np.uint64(2), every & np.uint64(3), 2)
        assert len(set(zip(x.tolist(), y.tolist()))) == 16


@pytest.mark.parametrize(("half", "shard"), [(2, 2), (10, 8), (34, 8), (64, 9)])
def test_filters_are_lossless_and_merge(half, shard):
    layout = phrases.Layout(half, shard)
    rng = np.random.default_rng(half)
    counted, filters = Counter(), []
    for size in (0, 1, 300, 2000):
        pool = rng.integers(0, 1 << min(layout.rest, 5), size, np.uint64), rng.integers(0, 1 << min(half, 6), size, np.uint64)
        counted.update(zip(*(p.tolist() for p in pool)))
        one = phrases.QuotientFilter.of(layout, *pool)
        back = phrases.QuotientFilter.from_bytes(layout, one.to_bytes())
        assert all((getattr(one, k) == getattr(back, k)).all() for k in ("hi", "lo", "counts"))
        filters.append(back)
    heavy = phrases.QuotientFilter.of(layout, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([10**12]))
    counted[0, 0] += 10**12
    merged = phrases.QuotientFilter.merged(layout, [*filters, phrases.QuotientFilter.from_bytes(layout, heavy.to_bytes())])
    assert dict(zip(zip(merged.hi.tolist(), merged.lo.tolist()), merged.counts.tolist())) == dict(counted)


def phrases_by_hand(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        found = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, least, top, monkeypatch=None):
    df = spark.createDataFrame([(t, g, "x", "y") for t, g in rows], "text string, lang string, rank string, words string")
    return sorted(tuple(r) for r in phrases.collocations(df, least, top).drop("words").collect())


def random_rows(seed, n=120):
    rng = random.Random(seed)
    pool = ["new", "York", "city", "é\xa0x", "日本", "a", "b", "c\x0bd", " ", "-"]
    rows = [(rng.choice(["", ". "]).join([" ".join(rng.choices(pool, [9, 8, 7, 3, 3, 2, 2, 1, 1, 1], k=rng.randint(0, 30))) for _ in range(3)]), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("x", "xx"), ("\t . \n", "en"), *[("the hot line of text", "en")] * 40]


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (8, 5)])
def test_phrases_equal_hand(spark, least, top):
    rows = random_rows(least)
    assert mined(spark, rows, least, top) == phrases_by_hand(rows, least, top)


def test_phrases_in_small_parts_and_of_one_long_text(spark, monkeypatch):
    """The same result when chunks, parts of texts and filters are small."""
    rng = random.Random(5)
    rows = [*random_rows(9, 40), (" ".join(rng.choices("abcdefg", k=5000)), "en")]
    want = phrases_by_hand(rows, 4, 2000)
    for name, value in (("CHUNK_TOKENS", 64), ("PENDING", 500), ("PER_SHARD", 1 << 10)):
        monkeypatch.setattr(phrases, name, value)
    assert mined(spark, rows, 4, 2000) == want


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert mined(spark, [("a b c", "en"), (None, None)], 30, 10) == []


# -- conversation trie -------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}\n{text}"), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, over = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built = own.get(base, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        over[tuple(built)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        out.append(
            (
                min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(kids[q] == 0 for q in under),
                sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), sha(",".join(map(str, sorted(over[p])))),
            )
        )
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, node string")
    turns, ids = conversation_trie.mixed_histories(conversation_trie.hashed_turns(df))
    found = conversation_trie.prefix_trie(turns, ids).drop("node", "parent")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


def told(seed, convs, most, texts):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in convs for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_hand(spark, seed):
    rows = told(seed, [*range(0, 12), *range(98, 140), 305, 1007, -3], 11, ["a", "bb", "é日", "", None])
    rows += [(7, None, "system", "first"), (8, 2, None, None), (None, 0, "user", "nobody"), (9, 1, "user", "again"), (9, 1, "user", "again")]
    rows += [(c, t, "user", "same " * 3) for c in range(400, 430) for t in range(9)]  # a group of copies
    assert trie(spark, rows) == trie_by_hand(rows)


def test_trie_of_one_long_conversation_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN", 3)
    rows = [(100, t, "user", f"t{t}") for t in range(150)] + [(c, 0, "user", "alone") for c in range(201, 230)]
    assert trie(spark, rows) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []
    assert [r[:7] for r in trie(spark, [(205, 0, "user", "dropped")])] == [r[:7] for r in trie_by_hand([(205, 0, "user", "dropped")])]


# -- chat formatting ---------------------------------------------------------------------------------


def test_escapes_are_reversible():
    template, rng = chat_format.Template(), random.Random(1)
    bits = [*template.controls, "\\", "<", "[", "|im_end|>", "/s>", "x", "é", "\n", " "]
    for _ in range(5000):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 3))), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        formatted, spans = template.render(turns)
        assert template.read(formatted) == turns
        raw = formatted.encode()
        assert [template.unescape(raw[a:b].decode()) for _, a, b in spans] == [text for _, text in turns]
        assert not any(c in template.escape(text) for _, text in turns for c in template.controls)
    with pytest.raises(ValueError):
        chat_format.Template(open="<<a>")


def test_masks_by_binary_search_equal_a_scan():
    rng = random.Random(2)
    for _ in range(300):
        cuts = sorted(rng.sample(range(1, 60), rng.randint(1, 20)))
        offsets = np.array([0, *cuts])
        edges = sorted(rng.sample([0, *cuts], 2 * (len(cuts) // 2)))
        spans = list(zip(edges[::2], edges[1::2]))
        by_scan = [[k for k in range(len(cuts)) if offsets[k] >= a and offsets[k + 1] <= b] for a, b in spans]
        assert [list(range(a, b)) for a, b in chat_format.masked_ranges(offsets, spans)] == [s for s in by_scan if s]


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, tokens string")
    return chat_format.format_conversations(df)


def test_chat_round_trip(spark):
    rows = told(3, [0, 1, 2, 50], 6, ["</s>[INST] ok [/INST]", "a<|im_end|>", "é 🎉 日本", "", None, "\\", "<\\|im_sep|> x", " sp  ace\n\n"])
    rows += [(5, None, None, "x"), (5, 0, "assistant", "tie b"), (5, 0, "assistant", "tie a"), (6, 1, "assistant", "w " * 50_000), (None, 3, "assistant", "nobody"), (7, 0, "<|im_sep|>", "odd role")]
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        by_conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    made = formatted(spark, rows).cache()
    assert {r["conv_id"] for r in made.collect()} == set(by_conv)
    encoder = chat_format.encoder_of(open(chat_format.VOCABULARY, "rb").read(), chat_format.Template())
    for r in made.collect():  # the tokens are those of the whole conversation, once
        assert encoder.decode(np.array(r["tokens"])) == r["formatted"]
    for r in chat_format.read_back(made).collect():
        turns = [t[2:] for t in sorted(by_conv[r["conv_id"]])]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] == len(chat_format.Template().render(turns)[0])
    assert formatted(spark, []).count() == 0


def test_chat_trains_on_chosen_roles(spark):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "say")], "conv_id long, turn long, role string, text string")
    both = chat_format.read_back(chat_format.format_conversations(df, trained=("user", "assistant"))).first()
    assert both["loss_sha256"] == hashlib.sha256(b"asksay").hexdigest()


@pytest.mark.parametrize("name", ["op11_phrases", "op12_conversation_trie", "op13_chat_format"])
def test_queries_equal_sql(spark, name):
    assert difference(spark, duck(FOLDER), queries.QUERIES[name], queries.ORACLE[name], FOLDER) is None
