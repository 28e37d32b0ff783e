"""Evaluation texts inside a training corpus: BM25 over word trigrams with block-max WAND, then alignment.

Index: each evaluation item is a short document whose terms are the word trigrams of its question (standard notices,
which stand alike in several prompts, are cut first; each part of a question that they leave is such a document). Every
passage of every training text is a query. A term's weight in an item is its BM25 weight divided by the item's own
threshold, so that one number, 1, is the cut for all items. The threshold is the least score that any true case can
have: at most one in seven of L successive words is altered, each alteration breaks at most three trigrams, so at least
L - 2 - 3 * (L // 7) trigrams of the span are left; the sum of the smallest that many weights, over all spans, is the
item's threshold. Retrieval therefore loses no case.

Which L matter: a case of 50 words or more is cut into its first 28 words and the rest, and one of the two is a case by
itself, so only cases below 50 words need be found, and these lie within one passage. Of the others, 23 to 27 words can't
give less than 22, nor 29 to 34 less than 28, and so on.

Search of a passage: the sum of its terms' largest weights must reach 1. Then the postings of its terms are walked
through in the order of items: the pivot is the first item at which the terms' largest weights add up to 1; the block
maxima there decide between looking at it and skipping to the end of its block; lists in front of it jump to it. Each
item at or above 1 is verified by aligning the question with the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from aislewise.llm.words import compounds_of, plain, words_of
from aislewise.staging import spread, stage

K1, B = 1.2, 0.75
#: Words of a passage and of the step to the next one: any STEP successive words lie in one.
PASSAGE, STEP = 160, 80
BLOCK = 16
NOTICE_WORDS, NOTICE_PROMPTS = 12, 3
MIN_WORDS, ALTERED_IN = 22, 7
_WHOLE = -(-MIN_WORDS // ALTERED_IN) * ALTERED_IN
#: Cases of this many words or more hold a shorter one.
SPAN = _WHOLE + MIN_WORDS
SPANS = (MIN_WORDS, *(n for n in range(_WHOLE, SPAN, ALTERED_IN) if n > MIN_WORDS))
#: One index holds at most this many items and characters of prompts and answers (about 150 MB); more items are searched in parts.
MAX_ITEMS, MAX_INDEX_CHARS = 100_000, 12_000_000
_CHUNK_CHARS = 1_000_000
_NOWHERE = np.iinfo(np.int64).max


def shared_windows(code: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """In how many prompts the NOTICE_WORDS words from each place stand; 0 where the prompt ends before. Equal prompts are one."""
    n, held = NOTICE_WORDS, np.zeros(len(code), np.int64)
    if len(code) < n:
        return held
    # places that begin with the same 1, 2, 4, 8 and then 12 words have the same number
    same, size = {1: np.unique(code, return_inverse=True)[1].astype(np.int64)}, 1
    while 2 * size <= n:
        a = same[size]
        same[2 * size] = np.unique(a[:-size] * (a.max() + 1) + a[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    window, done = same[size], size
    while done < n:
        step = max(k for k in same if done + k <= n)
        b = same[step][done:]
        m = min(len(window), len(b))
        window = np.unique(window[:m] * (b.max() + 1) + b[:m], return_inverse=True)[1].astype(np.int64)
        done += step
    at = np.flatnonzero(owner[: len(window)] == owner[n - 1 : n - 1 + len(window)])
    if not len(at):
        return held
    bounds = np.flatnonzero(np.diff(owner)) + 1
    class_of, classes = np.zeros(int(owner[-1]) + 1, np.int64), {}
    for lo, hi in zip(np.append(0, bounds), np.append(bounds, len(code)), strict=True):
        class_of[owner[lo]] = classes.setdefault(code[lo:hi].tobytes(), len(classes))
    each = np.unique(window[at] * len(classes) + class_of[owner[at]]) // len(classes)
    held[at] = np.bincount(each)[window[at]]
    return held


def notice_words(held: np.ndarray) -> np.ndarray:
    """Which words belong to a notice: a window that stands in NOTICE_PROMPTS prompts or more.

    A window across the border of a notice and a question may also stand in some prompts by chance, so a window counts
    only if it stands in at least half as many prompts as the most frequent one that overlaps it.
    """
    n = NOTICE_WORDS
    cut = np.zeros(len(held), bool)
    if len(held) < n:
        return cut
    # windows of two prompts never overlap: none begins in the last words of a prompt
    near = np.lib.stride_tricks.sliding_window_view(np.pad(held, n - 1), 2 * n - 1).max(axis=1)
    begin = np.flatnonzero((held >= NOTICE_PROMPTS) & (2 * held >= near))
    change = np.zeros(len(held) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + n, -1)
    return np.cumsum(change)[:-1] > 0


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of `wanted` in the sorted `keys`, -1 for those that aren't there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Index:
    """Postings of a set of items; all arrays grow with the words of its questions, none with the square of the vocabulary."""

    vocab: dict[str, int]
    compound_key: np.ndarray  # sorted pairs of parts, and the code of each pair's compound
    compound: np.ndarray
    pair_key: np.ndarray  # sorted pairs of codes that stand next to each other in some question
    term_key: np.ndarray  # sorted trigrams: place of the first pair, third code
    bound: np.ndarray  # largest weight of each term
    first: np.ndarray  # postings of term t: first[t] to first[t + 1]
    posting: np.ndarray  # sorted: term * questions + question
    weight: np.ndarray
    block_key: np.ndarray  # sorted: term * blocks + block, and the largest weight in it
    block_max: np.ndarray
    words: np.ndarray  # codes of all questions in a row; question i: starts[i] to starts[i + 1]
    starts: np.ndarray
    ids: list[int]  # the item of each question

    @classmethod
    def build(cls, rows: Sequence[tuple[int, str | None]], held: Sequence[Mapping[int, int]] | None = None) -> Index:
        """Each run of an item's question between notices is indexed by itself; of those below MIN_WORDS words there can be no case.

        `held` gives, per row, the places of shared windows and in how many prompts they stand, if the rows are a part of
        the items only.
        """
        vocab: dict[str, int] = {}
        flat, sizes, pairs = [], [], set()
        for _, prompt in rows:
            own = words_of(prompt or "")
            flat += [vocab.setdefault(w, len(vocab)) for w in own]
            sizes.append(len(own))
            pairs |= compounds_of(prompt or "")
        joined = {}
        for a, b in sorted(pairs):
            joined[a + b] = (a, b)
        for a, b in joined.values():
            for w in (a, b, a + b):
                vocab.setdefault(w, len(vocab))
        v = max(1, len(vocab))
        whole = sorted((vocab[a] * v + vocab[b], vocab[ab]) for ab, (a, b) in joined.items())
        compound_key, compound = np.array([k for k, _ in whole], np.int64), np.array([c for _, c in whole], np.int64)
        code, owner = np.array(flat, np.int64), np.repeat(np.arange(len(sizes)), sizes)
        if held is None:
            shared = shared_windows(code, owner)
        else:
            shared, begin = np.zeros(len(code), np.int64), np.cumsum([0, *sizes])
            for i, places in enumerate(held):
                for k, n in places.items():
                    shared[begin[i] + k] = n
        cut = notice_words(shared)
        code, keep = cls._compounds(code, 2 * owner + cut, compound_key, compound, v)
        owner, cut = owner[keep], cut[keep]
        # runs of words that stay
        part = 2 * owner + cut
        edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
        lo, hi = edge[:-1], edge[1:]
        good = ~cut[lo] & (hi - lo >= MIN_WORDS)
        lo, hi = lo[good], hi[good]
        n = hi - lo
        starts = np.append(0, np.cumsum(n))
        at = np.arange(int(starts[-1])) + np.repeat(lo - starts[:-1], n)
        words, of = code[at], np.repeat(np.arange(len(lo)), n)
        ids = [rows[i][0] for i in owner[lo].tolist()]
        near = of[1:] == of[:-1]
        pair_key = np.unique(words[:-1][near] * v + words[1:][near])
        third = np.flatnonzero(of[2:] == of[:-2])
        key = _find(pair_key, words[third] * v + words[third + 1]) * v + words[third + 2]
        term_key, term = np.unique(key, return_inverse=True)
        arrays = cls._postings(term.astype(np.int64), of[third], len(term_key), len(lo))
        return cls(vocab, compound_key, compound, pair_key, term_key, *arrays, words.astype(np.int32), starts, ids)

    @staticmethod
    def _postings(term: np.ndarray, of: np.ndarray, terms: int, questions: int) -> tuple[np.ndarray, ...]:
        """Postings with weights over thresholds, from the trigrams of all questions in a row (term and question of each)."""
        q = max(1, questions)
        posting, place, count = np.unique(term * q + of, return_index=True, return_counts=True)
        owner, holder = posting % q, posting // q
        length = np.bincount(of, minlength=q)
        held = np.bincount(holder, minlength=terms)
        idf = np.log(1 + (questions - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, len(of) / q))
        weight = idf[holder] * count * (K1 + 1) / (count + norm[owner])
        # a trigram that stands twice in a question counts once in a score, so at its second place it weighs nothing
        own = np.zeros(len(term))
        own[place] = weight
        least = np.full(q, np.inf)
        for words in SPANS:
            size = words - 2
            if size > len(own):
                break
            left = max(1, size - 3 * (words // ALTERED_IN))
            inside = np.flatnonzero(of[size - 1 :] == of[: len(of) - size + 1])
            view = np.lib.stride_tricks.sliding_window_view(own, size)
            for b in range(0, len(inside), 1 << 16):
                some = inside[b : b + (1 << 16)]
                np.minimum.at(least, of[some], np.partition(view[some], left - 1, axis=1)[:, :left].sum(axis=1))
        weight = (weight / np.maximum(least, 1e-6)[owner] * (1 + 1e-5)).astype(np.float32)
        first = np.searchsorted(holder, np.arange(terms + 1))
        bound = np.maximum.reduceat(weight, first[:-1]) if terms else weight
        blocks = -(-q // BLOCK)
        block = holder * blocks + owner // BLOCK
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        return bound, first, posting, weight, block[begin], np.maximum.reduceat(weight, begin) if terms else weight

    @staticmethod
    def _compounds(code: np.ndarray, owner: np.ndarray, key: np.ndarray, compound: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes with the parts of compounds joined, from left to right, and the places that are left."""
        place = np.arange(len(code))
        if len(code) < 2 or not len(key):
            return code, place
        at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (owner[1:] == owner[:-1]))
        whole = _find(key, code[at] * v + code[at + 1])
        at, whole = at[whole >= 0], whole[whole >= 0]
        if not len(at):
            return code, place
        # of compounds that share a part, every other one of a row
        run = np.flatnonzero(np.diff(at, prepend=-9) != 1)
        every = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, whole = at[every], whole[every]
        code = code.copy()
        code[at] = compound[whole]
        keep = np.ones(len(code), bool)
        keep[at + 1] = False
        return code[keep], place[keep]

    def question(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i + 1]]

    # ---- search

    def retrieve(self, terms: np.ndarray) -> np.ndarray:
        """All questions whose score for the distinct terms of one passage is at least 1, in order."""
        n = len(self.ids)
        blocks, end, base = -(-n // BLOCK), self.first[terms + 1], terms * n
        bound = self.bound[terms]

        def item_at(place: np.ndarray) -> np.ndarray:
            return np.where(place < end, self.posting[np.minimum(place, len(self.posting) - 1)] - base, _NOWHERE)

        place = self.first[terms]
        now, found = item_at(place), []
        while True:
            order = np.argsort(now, kind="stable")
            reach = np.cumsum(bound[order])
            at = int(np.searchsorted(reach, 1))
            if at == len(order) or now[order[at]] == _NOWHERE:
                return np.array(found, np.int64)
            pivot = int(now[order[at]])
            near = np.flatnonzero(now <= pivot)
            block = _find(self.block_key, terms[near] * blocks + pivot // BLOCK)
            target = pivot
            if self.block_max[block[block >= 0]].sum() < 1:  # nothing in this block, as far as no other list begins
                target = min((pivot // BLOCK + 1) * BLOCK, int(now[now > pivot].min(initial=_NOWHERE)))
            elif now[order[0]] == pivot:
                if self.weight[place[near]].sum() >= 1:
                    found.append(pivot)
                target = pivot + 1
            behind = near[now[near] < target]
            place[behind] = np.searchsorted(self.posting, base[behind] + target)
            now = item_at(place)

    def codes(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word codes of all texts in a row (-1: in no question), and the text of each."""
        words: list[str] = []
        counts = []
        for text in texts:
            own = words_of(text) if text else []
            counts.append(len(own))
            words += own
        code = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        owner = np.repeat(np.arange(len(counts)), counts)
        code, keep = self._compounds(code, owner, self.compound_key, self.compound, max(1, len(self.vocab)))
        return code, owner[keep]

    def search(self, texts: Sequence[str | None]) -> list[tuple[int, int]]:
        """(position of the text, item id) of all cases."""
        code, owner = self.codes(texts)
        if len(code) < 3 or not len(self.term_key):
            return []
        v = len(self.vocab)
        at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (owner[1:] == owner[:-1]))
        pair = np.full(len(code), -1, np.int64)
        pair[at] = _find(self.pair_key, code[at] * v + code[at + 1])
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        term = _find(self.term_key, pair[at] * v + code[at + 2])
        at, term = at[term >= 0], term[term >= 0]
        if not len(at):
            return []
        total = np.append(0, np.cumsum(np.bincount(at, self.bound[term], len(code))))
        begin = np.searchsorted(owner, np.arange(len(texts)))
        end = np.searchsorted(owner, np.arange(len(texts)), side="right")
        steps = np.maximum(1, -(-(end - begin - (PASSAGE - STEP)) // STEP))
        steps[end == begin] = 0
        text = np.repeat(np.arange(len(texts)), steps)
        start = begin[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps))
        stop = np.minimum(start + PASSAGE, end[text])
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for p in np.flatnonzero(total[stop] - total[start] >= 1 - 1e-9).tolist():
            lo, hi = np.searchsorted(at, [start[p], stop[p] - 2])
            for question in self.retrieve(np.unique(term[lo:hi])).tolist():
                found[int(text[p]), question].append((int(start[p]), int(stop[p])))
        result = []
        for (where, question), spans in found.items():
            if any(aligned(self.question(question), code[lo:hi]) for lo, hi in spans):
                result.append((where, self.ids[question]))
        return list(dict.fromkeys(result))


def aligned(question: np.ndarray, passage: np.ndarray) -> bool:
    """Whether a span of MIN_WORDS or more words of the question stands in the passage with at most one in ALTERED_IN altered.

    Edit distances of all spans of the question, of less than SPAN words, that begin anywhere against all places of the
    passage, all beginnings at once: step t compares each beginning's word t.
    """
    n = len(question)
    if n < MIN_WORDS:
        return False
    known = np.flatnonzero(np.isin(passage, question))
    if not len(known):
        return False
    passage = passage[known[0] : known[-1] + 1]
    m = len(passage)
    same = question[:, None] == passage[None, :]
    if _longest_run(same) >= MIN_WORDS:
        return True
    places = np.arange(m + 1, dtype=np.int32)
    cost = np.zeros((n - MIN_WORDS + 1, m + 1), np.int32)
    steps = min(n, SPAN - 1)
    for t in range(steps):
        rows = min(len(cost), n - t)
        cost = cost[:rows]
        new = cost + 1
        np.minimum(new[:, 1:], cost[:, :-1] + ~same[t : t + rows], out=new[:, 1:])
        cost = np.minimum.accumulate(new - places, axis=1) + places
        if t + 1 >= MIN_WORDS and cost.min() <= (t + 1) // ALTERED_IN:
            return True
        if t + 1 < MIN_WORDS and cost.min() > steps // ALTERED_IN:
            return False
    return False


def _longest_run(same: np.ndarray) -> int:
    run, best = np.zeros(same.shape[1] + 1, np.int32), 0
    for row in same:
        run[1:] = np.where(row, run[:-1] + 1, 0)
        run[0] = 0
        best = max(best, int(run.max()))
    return best


def answer_share(answer: Sequence[str], words: np.ndarray) -> float:
    """The longest run of the answer's words that stands in the text, as a share of the answer; `words` are the text's."""
    run, best = np.zeros(len(words) + 1, np.int32), 0
    for word in answer:
        run[1:] = np.where(words == word, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best / len(answer)


def _held(items: DataFrame) -> DataFrame:
    """(id, prompt, answer, held): the items with the places of their shared windows, for sets larger than one index."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, str, str]] = []
            for prompt in batch.column(0).to_pylist():
                own = words_of(prompt)
                rows += [(prompt, k, " ".join(own[k : k + NOTICE_WORDS]), " ".join(own)) for k in range(len(own) - NOTICE_WORDS + 1)]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[at : at + 4096], strict=True)], names=["prompt", "k", "w", "whole"])

    prompts = items.select("prompt").where("prompt IS NOT NULL").distinct()
    every = stage(prompts.mapInArrow(windows, "prompt string, k bigint, w string, whole string").select("prompt", "k", "w", F.xxhash64("whole").alias("c")), "windows")
    # a notice may stand in all prompts: equal windows of one prompt are combined map-side, then counted
    shared = every.select("w", "c").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= NOTICE_PROMPTS)
    places = every.select("prompt", "k", "w").join(shared, "w").groupBy("prompt").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("held"))
    return items.join(places, "prompt", "left").select("id", "prompt", "answer", "held")


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", answer: str | None = None
) -> DataFrame:
    """(doc_id, item_id): each document that holds at least 22 successive words of an item's question, almost unaltered.

    A document and an item come out once per row of the document. NULL, empty and blank texts and prompts have no case;
    repeated documents are reported each, and so are items with the same prompt. A passage of twelve words in three or
    more different prompts is a notice: no document is reported for such words alone. Other columns are not read.
    The items are gathered into an index of bounded size; sets beyond MAX_ITEMS items or MAX_INDEX_CHARS characters are
    searched in parts, each with a scan of the documents (their notices are counted over the whole set; a hyphenated word counts
    as its parts only within a part). Documents stay where they are: no shuffle.
    With the column `answer` of the items there is also answer_share, the longest run of an answer's words in the
    document as a share of the answer; NULL where the answer has no words, the largest where an item has several.
    """
    item_field = items.schema[item_id]
    wanted = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("id"), F.col(prompt).cast("string").alias("prompt"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer")
    )
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("prompt"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0))).alias("chars")).first()
    parts = max(1, -(-size["n"] // MAX_ITEMS), -(-(size["chars"] or 0) // MAX_INDEX_CHARS))
    if parts == 1:
        rows = wanted.collect()
        return _search(docs, doc_id, text, [(r[0], r[1], r[2], None) for r in rows], item_id, item_field, answer)
    whole, found = stage(_held(wanted), "items"), None
    for i in range(parts):  # by id: an item's rows stay together
        rows = whole.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).collect()
        part = _search(docs, doc_id, text, [(r[0], r[1], r[2], r[3] or {}) for r in rows], item_id, item_field, answer)
        found = part if found is None else found.unionByName(part)
    return found


def _search(docs: DataFrame, doc_id: str, text: str, rows: list[tuple], item_id: str, item_field: StructField, answer: str | None) -> DataFrame:
    """The cases of the given items (id, prompt, answer, places of shared windows or None)."""
    answers = defaultdict(list)
    for r in rows:
        if own := words_of(r[2] or ""):
            answers[r[0]].append(own)
    index = Index.build([r[:2] for r in rows], None if not rows or rows[0][3] is None else [r[3] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast((index, dict(answers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = shared.value
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < _CHUNK_CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                cases = index.search(texts[at:to])
                where = pa.array([at + w for w, _ in cases], pa.int64())
                columns = [batch.column(0).take(where), pa.array([i for _, i in cases], item_type)]
                if answer:
                    words = {w: np.array(words_of(texts[at + w]), object) for w, _ in cases}
                    shares = [max((answer_share(x, words[w]) for x in held.get(i, ())), default=None) for w, i in cases]
                    columns.append(pa.array(shares, pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "item", "answer_share"][: len(columns)])
                at = to

    narrow = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    kinds = narrow.schema["doc"].dataType.simpleString(), item_field.dataType.simpleString()
    item_type = to_arrow_type(item_field.dataType)
    return spread(narrow).mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}" + ", answer_share double" * bool(answer)).withColumnsRenamed({"doc": doc_id, "item": item_id})


__all__ = ["Index", "aligned", "leaked_items", "notice_words", "plain", "shared_windows"]
