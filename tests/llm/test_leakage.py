"""Leaks planted in many disguises, and the search against plain alignment of every pair."""

import random

import numpy as np
import pytest

from aislewise.llm import leakage
from aislewise.llm.leakage import Index, aligned, leaked_items
from aislewise.llm.words import words_of

NOTICE = "Offers are valid only while supplies last and may not be combined with any other store promotion unless the label says so."
WORDS = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "ki", "lo") for b in ("rn", "st", "mp", "lk", "nd", "sh", "tt", "zz")]


def make_items(n=40, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        q = " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s"])) for _ in range(rng.randint(40, 60)))
        q = q.replace("barn", "cotton-swab")
        rows.append((i, f"{NOTICE}\n{q}?" if i % 5 == 0 else f"{q}?"))
    return rows, rng


def question(rows, i):
    return rows[i][1].replace(NOTICE + "\n", "").rstrip("?").split()


@pytest.fixture(scope="module")
def items():
    return make_items()


def test_notices_are_cut(items):
    rows, _ = items
    index = Index.build(rows)
    words = list(index.vocab)
    assert index.ids == [i for i, _ in rows]
    for i in range(len(rows)):
        whole = " ".join(words[c] for c in index.question(i))
        assert whole == " ".join(words_of(" ".join(question(rows, i)).replace("cotton-swab", "cottonswab")))


def test_disguises(items):
    rows, rng = items
    index = Index.build(rows)
    q = question(rows, 7)
    fill = " ".join(rng.choice(WORDS) for _ in range(30))
    whole = " ".join(q)
    changed = [("XXX" if k % 8 == 3 else w) for k, w in enumerate(q)]
    forms = {
        "plain": whole, "upper": whole.upper(), "zero width": "".join(c + "​" if k % 5 == 0 else c for k, c in enumerate(whole)), "wide": whole.translate({ord("a"): "ａ", ord("s"): "ｓ"}),
        "markup": "<p class='q'>" + " ".join(f"<b>{w}</b>" if k % 4 == 0 else w for k, w in enumerate(q)) + "</p>", "quoted": "\n".join("> # " + " ".join(q[k : k + 6]) for k in range(0, len(q), 6)),
        "broken": "".join(w[:2] + "-\n" + w[2:] + " " if k % 6 == 0 else w + " " for k, w in enumerate(q)), "entities": whole.replace(" ", "&nbsp;"), "marks": whole.replace("o", "ó"),
        "no hyphens": whole.replace("-", " "), "joined": whole.replace("-", ""), "underlined": " ".join(f"_{w}_" for w in q), "punctuation": ", ".join(q), "changed": " ".join(changed), "part": " ".join(q[5:27]),
        "missing": " ".join(w for k, w in enumerate(q) if k % 9 != 4), "added": " ".join(w + " extra" if k % 9 == 4 else w for k, w in enumerate(q)),
    }
    for name, text in forms.items():
        assert index.search([f"{fill} {text} {fill}"]) == [(0, 7)], name
    for name, text in {"short": " ".join(q[5:23]), "notice": NOTICE, "other": fill, "too many": " ".join("YY" if k % 5 == 2 else w for k, w in enumerate(q)), "": "", "blank": " \n"}.items():
        assert index.search([f"{fill} {text} {fill}" if text else text]) == [], name
    assert sorted(index.search([None, whole, "", f"{whole}\n{' '.join(question(rows, 9))}"])) == [(1, 7), (3, 7), (3, 9)]


def edit_cases(q, d):
    """Whether any span of 22 or more words of q is within a seventh of edits of any place of d, by plain dynamic programming."""
    for i in range(len(q) - 21):
        row = [0] * (len(d) + 1)
        for t, w in enumerate(q[i:], 1):
            new = [row[0] + 1]
            for j in range(1, len(d) + 1):
                new.append(min(row[j - 1] + (w != d[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
            if t >= 22 and min(row) <= t // 7:
                return True
    return False


def test_alignment_and_search_against_brute_force(items, monkeypatch):
    rows, _ = items
    index = Index.build(rows)
    rng = random.Random(11)
    cases = 0
    for _ in range(120):
        i = rng.randrange(len(rows))
        q = index.question(i).tolist()
        a = rng.randint(0, len(q) - 24)
        span = q[a : a + rng.randint(18, len(q) - a)]
        out = []
        for w in span:
            r = rng.random()
            if r < 0.05:
                continue
            out += [-1 if r < 0.12 else w] + ([-1] if r > 0.95 else [])
        d = [-1] * rng.randint(0, 5) + out + [-1] * rng.randint(0, 5)
        truth = edit_cases(q, d)
        cases += truth
        assert aligned(np.array(q), np.array(d)) == truth
        text = " ".join("qqq" if c < 0 else list(index.vocab)[c] for c in d)
        assert ((0, rows[i][0]) in index.search([text])) == truth
    assert 20 < cases < 110


def test_block_maxima_lose_nothing(items):
    rows, rng = items
    index = Index.build(rows)
    some = 0
    for _ in range(200):
        terms = rng.sample(range(len(index.term_key)), 60)
        for i in rng.sample(range(len(rows)), 5):  # and parts of questions, some of them long enough
            own = np.flatnonzero(index.posting % len(rows) == i)[rng.randrange(20) :][: rng.randrange(30)]
            terms += (index.posting[own] // len(rows)).tolist()
        terms = np.unique(np.array(terms))
        score = np.zeros(len(rows))
        for t in terms:
            for k in range(index.first[t], index.first[t + 1]):
                score[index.posting[k] % len(rows)] += index.weight[k]
        assert index.retrieve(terms).tolist() == np.flatnonzero(score >= 1).tolist()
        some += (score >= 1).sum()
    assert some > 100


def test_frames(spark, items):
    rows, _ = items
    docs = spark.createDataFrame([(1, " ".join(question(rows, 3)), "x"), (1, " ".join(question(rows, 3)), "x"), (2, None, None), (3, "", None), (None, " ".join(question(rows, 4)), "x"), (5, "z " * 60_000 + " ".join(question(rows, 5)), "x")], "doc_id bigint, text string, item_id string")
    evals = spark.createDataFrame([*rows, (90, None), (91, ""), (None, rows[3][1]), (92, "short one")], "item_id int, prompt string")
    got = sorted(map(tuple, leaked_items(docs, evals).collect()), key=str)
    assert got == sorted([(1, 3), (1, 3), (None, 4), (5, 5)], key=str)
    assert leaked_items(docs.limit(0), evals).count() == 0
    assert leaked_items(docs, evals.limit(0)).count() == 0


def test_parts(spark, items, monkeypatch):
    """Sets larger than one index are searched in parts, with the notices of the whole set."""
    rows, rng = items
    texts = [f"{NOTICE} {' '.join(question(rows, i))}" for i in range(0, 40, 3)] + [NOTICE, f"{' '.join(question(rows, 2))} {' '.join(question(rows, 1))}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    evals = spark.createDataFrame([(*r, f"answer {r[0]}") for r in rows] + [(50, rows[0][1], None), (51, None, "x")], "item_id int, prompt string, answer string")
    whole = sorted(map(tuple, leaked_items(docs, evals, answer="answer").collect()))
    monkeypatch.setattr(leakage, "MAX_ITEMS", 7)
    assert sorted(map(tuple, leaked_items(docs, evals, answer="answer").collect())) == whole
    assert (0, 50) in {r[:2] for r in whole} and len(whole) == 17


def test_every_part_of_a_question_is_indexed(items):
    """A notice in the middle of a prompt leaves two parts; either is a case, both together are one."""
    rows, rng = items
    first, second = (" ".join(rng.choice(WORDS) for _ in range(n)) for n in (30, 45))
    index = Index.build([*rows, (70, f"{first}. {NOTICE} {second}?")])
    assert index.search([first, second, f"{second} {first}", NOTICE]) == [(0, 70), (1, 70), (2, 70)]


def test_answers(spark, items):
    rows, _ = items
    texts = [f"{' '.join(question(rows, 3))}? The Red, LAMP falls.", f"{' '.join(question(rows, 4))} red falls", " ".join(question(rows, 5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    answers = {3: "red lamp falls", 4: "red lamp falls", 5: None}
    evals = spark.createDataFrame([(*r, answers.get(r[0], "")) for r in rows], "item_id int, prompt string, answer string")
    got = {tuple(r) for r in leaked_items(docs, evals, answer="answer").collect()}
    assert got == {(0, 3, 1.0), (1, 4, 1 / 3), (2, 5, None)}
    assert leaked_items(docs, evals).columns == ["doc_id", "item_id"]


def test_shared_questions_are_reported(items):
    """Items with the same prompt, and two items over one passage: both are found; from three prompts on a passage is a notice."""
    rows, rng = items
    passage, *tails = (" ".join(rng.choice(WORDS) for _ in range(n)) for n in (60, 30, 30, 30))
    index = Index.build([*rows, (80, passage), (81, passage + "?"), (82, passage.upper())])
    assert sorted(index.search([passage])) == [(0, 80), (0, 81), (0, 82)]
    index = Index.build([*rows, (80, f"{passage} {tails[0]}"), (81, f"{passage} {tails[1]}")])
    assert sorted(index.search([passage, tails[1]])) == [(0, 80), (0, 81), (1, 81)]
    index = Index.build([*rows, *((80 + i, f"{passage} {t}") for i, t in enumerate(tails))])
    assert sorted(index.search([passage, tails[1]])) == [(1, 81)]


def test_compounds_that_share_a_part(items):
    rows, rng = items
    q = [rng.choice(WORDS) for _ in range(30)]
    index = Index.build([(1, " ".join([*q[:15], "aa-bb", *q[15:]])), (2, " ".join([*q[::-1], "bb-cc"]))])
    for middle in ("aa bb", "aabb", "aa-bb"):
        assert index.search([" ".join([*q[4:15], middle, *q[15:25]])]) == [(0, 1)]
    assert index.codes(["aa bb cc"])[0].tolist() == [index.vocab["aabb"], index.vocab["cc"]]


def test_recall_of_mixed_prompts():
    """Notices in front, in the middle and behind, equal prompts, shared passages and long prompts, against plain dynamic programming."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in ("am", "el", "or", "un") for c in ("ta", "ki", "so")]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    notice, shared, long = NOTICE.split(), some(40), some(400)
    parts = [[some(30), notice, some(40)] for _ in range(4)] + [[shared, some(25)], [shared, some(25)], [long], [some(26), notice], [notice, some(26)]]
    parts += [parts[0], parts[3]]
    index = Index.build([(i, " ".join(w for p in own for w in p)) for i, own in enumerate(parts)])
    found = truth = 0
    for _ in range(60):
        own = rng.choice(parts)
        p = rng.choice([x for x in own if x is not notice])
        a = rng.randint(0, len(p) - 22)
        span = [w if rng.random() > 0.11 else "other" for w in p[a : a + rng.randint(20, 60)]]
        d = some(rng.randint(0, 100)) + span + some(rng.randint(0, 100))
        got = {i for _, i in index.search([" ".join(d)])}
        for i, own_ in enumerate(parts):
            case = any(edit_cases([w.lower() for w in x], d) for x in own_ if x is not notice and x is p)
            truth += case
            found += case and i in got
    assert truth > 40 and found == truth


def test_size_of_the_index():
    """Linear in the words, with a vocabulary of any size; a long prompt costs no more than its words."""
    import time

    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 20_000, 50))) for i in range(4000)] + [(4000, " ".join(f"w{k}" for k in rng.integers(0, 20_000, 3000)))]
    began = time.time()
    index = Index.build(rows)
    held = sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray))
    assert held < 20_000_000 and time.time() - began < 20
    assert index.search([rows[7][1], " ".join(rows[4000][1].split()[1500:1530])]) == [(0, 7), (1, 4000)]
