"""Pieces: cover, limit, overlap, boundaries."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aislewise.llm.bpe import Vocabulary
from aislewise.llm.encode import default_vocabulary
from aislewise.llm.splitting import CUTS, Splitter, cut_points, gap_depths, split_oversized

LIMITS = [("a", 128, 16), ("b", 64, 0), ("c", 40, 19), ("d", 7, 3)]


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(2)
    words = "the store sold many red lamps and quiet cats while rain fell over town".split()
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 15))).capitalize() + rng.choice([". ", "! ", "?\n", ".\n\n"]) for _ in range(200)]
    return ["".join(prose), "中文句子。" * 300, "x" * 3000, "👩🏽‍⚕️" * 90, "\n" * 500 + "a", " " * 700, "no stops at all " * 90, "a,b;" * 300, "short", "", "é" * 600, "ab\r\n" * 200]


def test_invariants(truth):
    splitter = Splitter(Vocabulary.load(default_vocabulary()), LIMITS)
    every = texts()
    by = {}
    for i, k, number, a, b, n, shared, *_ in splitter.split(every):
        by.setdefault((i, k), []).append((number, a, b, n, shared))
    for i, text in enumerate(every):
        for k, (_, most, overlap) in enumerate(LIMITS):
            total = len(truth(text))
            if total <= most:
                assert (i, k) not in by
                continue
            pieces = by[i, k]
            assert [p[0] for p in pieces] == list(range(1, len(pieces) + 1))
            assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
            for (_, a, b, n, _), (_, a2, b2, _, shared) in zip(pieces, pieces[1:], strict=False):
                assert a < a2 <= b < b2 and n <= most
                if most > 7:  # an emoji's tokens may not fit a tiny limit
                    assert overlap <= shared <= overlap + 3
            if most > 7:
                assert all(len(truth(text[a:b])) <= most for _, a, b, _, _ in pieces)


def test_cuts_at_topic_change(truth):
    first = "Lamps need bulbs. Bulbs give light. Light fills lamps. Lamps use bulbs and light. " * 2
    second = "Cats chase mice. Mice fear cats. Cats sleep. Mice hide from cats. " * 3
    text = first + second
    n = len(truth(text))
    splitter = Splitter(Vocabulary.load(default_vocabulary()), [("x", n - 12, 0)])
    cut = next(iter(splitter.split([text])))
    assert cut[4] == len(first) or text[: cut[4]].rstrip().endswith(".")
    depth = gap_depths(np.repeat(np.arange(8), 4), np.array([1, 2, 3, 4] * 4 + [5, 6, 7, 8] * 4), 8)
    assert int(np.argmax(depth)) == 3


def test_sentence_ends_are_preferred():
    text = texts()[0]
    splitter = Splitter(Vocabulary.load(default_vocabulary()), [("x", 100, 10)])
    pieces = list(splitter.split([text]))
    assert all(text[: p[4]].rstrip()[-1] in ".!?" for p in pieces[:-1])


def test_frames(spark):
    every = texts()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(every)] + [(0, every[0], "c"), (None, every[1], None), (77, None, None)], "doc_id int, text string, piece string")
    limits = spark.createDataFrame([(1, "p", 128, 16), (2, "p", 0, 1), (3, "p", None, 1), (4, "p", 64, None), (5, "p", 50, 49)], "limit_id int, purpose string, max_tokens int, overlap_tokens int")
    out = split_oversized(docs, limits)
    rows = out.collect()
    assert {r["limit_id"] for r in rows} == {1, 4, 5}
    assert max(r["n_tokens"] for r in rows if r["limit_id"] == 4) <= 64
    firsts = [r for r in rows if r["doc_id"] == 0 and r["limit_id"] == 1 and r["piece"] == 1]
    assert len(firsts) == 2 and firsts[0]["piece_text"] == every[0][: firsts[0]["end_char"]]
    assert split_oversized(docs.limit(0), limits).count() == 0
    assert split_oversized(docs, limits.limit(0)).count() == 0


def test_words_are_counted_exactly():
    """Against plain counters, with more distinct words than any small number of bins holds apart."""
    from collections import Counter

    rng = np.random.default_rng(3)
    units, terms = np.sort(rng.integers(0, 60, 3000)), rng.integers(-1, 900, 3000)
    own = [Counter(terms[(units == u) & (terms >= 0)].tolist()) for u in range(60)]
    alike = []
    for g in range(1, 60):
        a, b = sum(own[max(0, g - 4) : g], Counter()), sum(own[g : g + 4], Counter())
        alike.append(sum(n * b[t] for t, n in a.items()) / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5)
    expect = []
    for i, x in enumerate(alike):
        lo = hi = i
        while lo and alike[lo - 1] >= alike[lo]:
            lo -= 1
        while hi < len(alike) - 1 and alike[hi + 1] >= alike[hi]:
            hi += 1
        expect.append(alike[lo] + alike[hi] - 2 * x)
    assert np.allclose(gap_depths(units, terms, 60), expect, atol=1e-9)
    assert not gap_depths(np.arange(5), np.full(5, -1), 5).any()


def test_unspaced_scripts_share_pairs_of_characters():
    """Clauses that differ as a whole but hold the same words; the cut is where the topic changes."""
    first = "红灯需要灯泡。灯泡照亮红灯。我们买红灯和灯泡。红灯的灯泡很亮。" * 3
    second = "小猫追老鼠。老鼠怕小猫。小猫睡了老鼠来。老鼠躲小猫。" * 3
    splitter = Splitter(Vocabulary.load(default_vocabulary()), [("x", 10, 0)])
    from aislewise.llm import splitting

    assert splitting.terms_of(" Lamps") == ["lamps"] and splitting.terms_of("红灯泡") == ["红灯", "灯泡"] and splitting.terms_of("abc中") == ["abc", "中"] and splitting.terms_of(",") == []
    tokens = sum(1 for _ in splitter.encoder.encode([first + second])[0])
    splitter.limits = [("x", tokens - 12, 0)]
    cut = next(iter(splitter.split([first + second])))
    assert cut[4] == len(first)


def test_stops_inside_numbers_links_and_abbreviations():
    """Only stops before white space or the end are sentence ends; full-width ones and line ends are in any case."""
    rng = random.Random(5)
    parts = ["Lamp at $38.31 now.", "See https://shop.example.com/a.b?c=1.5 today!", "Cats, e.g. red ones, cost 1.5 to 2.75 each.", "He said \"The U.S. store opens at 9.30.\"", "Is v2.0.1 out?", "It is **new.**"]
    text = " ".join(rng.choice(parts) for _ in range(400))
    ends, at = set(), 0
    for part in text.replace(".\" ", ".\"\0").replace(".** ", ".**\0").replace("? ", "?\0").replace("! ", "!\0").replace("now. ", "now.\0").replace("each. ", "each.\0").split("\0"):
        at += len(part)
        ends.add(at)
        at += 1
    splitter = Splitter(Vocabulary.load(default_vocabulary()), [("x", 100, 10), ("y", 40, 0)])
    cuts = {p[4] for p in splitter.split([text])}
    assert len(cuts) > 50 and cuts <= ends
    splitter.limits = [("x", 20, 0)]
    full = "价格为12.50元。红灯很亮！猫睡了？"
    assert {(full * 40)[: p[4]][-1] for p in splitter.split([full * 40])} <= set("。！？")


def test_deepest_valley_of_the_whole_window():
    ends, unit = np.arange(10, 210, 10), np.arange(19)
    depth = np.full(19, 0.1)
    depth[2] = 0.9  # at 30, in the lower half of the first window
    assert cut_points(ends, unit, depth, 100, 10, np.arange(201))[0][:2] == (0, 30)
    assert cut_points(ends, unit, depth, 100, 30, np.arange(201))[0][:2] == (0, 100)  # not above the overlap
    # a character of four tokens at the start: a cut so near that the next piece would begin inside it is none
    between = np.array([0, 0, 0, 0, *range(4, 201)])
    assert [p[:3] for p in cut_points(np.array([4, 12, 20, 200]), np.array([1, 2]), np.array([0.9, 0.1]), 100, 10, between)[:2]] == [(0, 20, 0), (10, 110, 4)]


def test_what_a_cut_is(spark):
    """Kind and depth of each cut, and that chosen valleys are deeper than the others in their windows."""
    docs = spark.createDataFrame([(0, texts()[0]), (1, "x" * 3000), (2, "word " * 300)], "doc_id int, text string")
    rows = split_oversized(docs, spark.createDataFrame([(1, 100, 10)], "limit_id int, max_tokens int, overlap_tokens int")).collect()
    by = {i: [r for r in sorted(rows, key=lambda r: r["piece"]) if r["doc_id"] == i] for i in (0, 1, 2)}
    assert all([r["cut"] for r in own[:-1]] == [kind] * (len(own) - 1) and own[-1]["cut"] == "end" for own, kind in zip(by.values(), ("unit", "character", "space"), strict=True))
    assert all(r["depth"] >= r["usual_depth"] - 1e-9 for r in by[0][:-1]) and all(r["depth"] is r["usual_depth"] is None for own in by.values() for r in own if r["cut"] != "unit")


def test_softer_cuts():
    """Without sentence ends: behind commas and brackets, but not inside numbers; else at white space; else between words of the tokenizer."""
    splitter = Splitter(Vocabulary.load(default_vocabulary()), [("x", 60, 5)])
    record = '{"item":"price-tag","n":2,160,"tags":["local","sealed"]},'
    cases = {"pause": (record * 40, (",", "}", "]", '"')), "space": ("lamp bulb cat " * 200, ("lamp", "bulb", "cat")), "word": ("abc123def456" * 100, ("c", "f", "3", "6"))}
    for kind, (text, last) in cases.items():
        pieces = list(splitter.split([text]))
        assert {CUTS[p[7]] for p in pieces[:-1]} == {kind} and CUTS[pieces[-1][7]] == "end"
        assert all(text[: p[4]].rstrip().endswith(last) for p in pieces[:-1])
        assert not any(text[p[4] - 2 : p[4] + 1].replace(",", "0").isdigit() for p in pieces[:-1] if kind == "pause")
