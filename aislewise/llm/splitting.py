"""Splitting of oversized texts at valleys of lexical cohesion, under a token limit and with overlap.

Sentences and lines are the units. At each gap between units, the words of the units before it are compared with those
after it (cosine of exact word counts over a sliding block on either side; of scripts written without spaces, pairs of
neighbouring characters stand for words); a gap's depth is how far its similarity lies below the peaks on both sides.
Pieces are laid from the left: of the unit gaps in the size window, above the overlap, the deepest ends the piece (of
equal ones the last). Without any: the last comma, semicolon, bar or closing bracket in the upper half of the window;
else the last gap at white space; else the last gap between the tokenizer's words; else the last token boundary between two
characters. The next piece begins overlap tokens before that cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from aislewise.llm.bpe import Encoder, Vocabulary, encoder_of
from aislewise.llm.encode import default_vocabulary
from aislewise.staging import spread

#: Units in the block on either side of a gap.
SIDE = 4
_CHUNK_CHARS = 400_000
#: Of these, the ASCII ones end a sentence only before white space or the end of the text.
_STOPS, _SPACED_STOPS = ".!?…。！？؟।", ".!?"
_PAUSES = frozenset(",;|)]}>，；：、")
_CLOSERS = "\"'”’»)]}*_"
MAX_LIMITS = 10_000
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, ideographs.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_RUNS = re.compile(f"[{_UNSPACED}]+|[^{_UNSPACED}]+")
_is_unspaced = re.compile(f"[{_UNSPACED}]").search


def terms_of(word: str) -> list[str]:
    """What of an encoder's word is compared: the word in lower case, pairs of characters of unspaced scripts."""
    bare = word.strip().casefold()
    if not bare[:1].isalnum():
        return []
    if bare.isascii() or not _is_unspaced(bare):
        return [bare]
    out = []
    for run in _RUNS.findall(bare):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 1 and _is_unspaced(run) else [run]
    return out


class _Words:
    """What the encoder's words mean for cutting, by word code; grows along with the encoder's cache."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.known = encoder, encoder.words
        self.stop = np.zeros(0, bool)  # ends a sentence
        self.spaced = np.zeros(0, bool)  # ends a sentence if white space or nothing follows
        self.dot = np.zeros(0, bool)  # a full stop alone
        self.letter = np.zeros(0, bool)  # one letter, after white space or not
        self.line = np.zeros(0, bool)  # holds a line end
        self.blank = np.zeros(0, bool)  # white space only
        self.open = np.zeros(0, bool)  # begins with white space
        self.pause = np.zeros(0, bool)  # marks that divide a sentence or a list
        self.digit = np.zeros(0, bool)  # begins with a digit
        self.code: dict[str, int] = {}  # of each term
        self.first = np.zeros(1, np.int64)  # terms of word w: term[first[w]] to term[first[w + 1]]
        self.term = np.zeros(0, np.int64)

    @staticmethod
    def _flags(w: str) -> tuple[bool, ...]:
        """stop, spaced, dot, letter, line, blank, open, pause, digit of a word of the encoder."""
        core = w.strip()
        if core.isalnum():  # most words
            return False, False, False, len(core) == 1 and core.isalpha(), "\n" in w or "\r" in w or " " in w or " " in w, False, w[0].isspace(), False, w[0].isdigit()
        end = w.rstrip(_CLOSERS)[-1:]
        pause = not _PAUSES.isdisjoint(w) and not any(map(str.isalnum, w))
        return end != "" and end in _STOPS and end not in _SPACED_STOPS, end != "" and end in _SPACED_STOPS, w == ".", False, "\n" in w or "\r" in w or " " in w or " " in w, core == "", w[0].isspace(), pause, w[0].isdigit()

    def learn(self) -> None:
        if self.known is not self.encoder.words:  # the cache has started anew
            self.__init__(self.encoder)
        have = len(self.stop)
        if have == len(self.known):
            return
        new = list(self.known)[have:]
        flags = np.array([self._flags(w) for w in new])
        terms = [terms_of(w) for w in new]
        for name, values in zip(("stop", "spaced", "dot", "letter", "line", "blank", "open", "pause", "digit"), flags.T, strict=True):
            setattr(self, name, np.append(getattr(self, name), values))
        self.term = np.append(self.term, np.array([self.code.setdefault(x, len(self.code)) for own in terms for x in own], np.int64))
        self.first = np.append(self.first, self.first[-1] + np.cumsum([len(own) for own in terms]))


_known: dict[int, _Words] = {}


def gap_depths(words: np.ndarray, terms: np.ndarray, units: int) -> np.ndarray:
    """Depth of each gap of one text before units 1 to units - 1. `words` has the unit of each word, `terms` its term or -1."""
    return _depths(words, terms, units, np.arange(1, units), np.zeros(units - 1, np.int64))


def _depths(words: np.ndarray, terms: np.ndarray, units: int, gaps: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Depths of the gaps before the units `gaps` of several texts, whose units are at least 2 * SIDE apart; `text` tells which text a gap is in.

    Sums over blocks are made of the products of units at most 2 * SIDE - 1 apart, taken term by term, so that the size
    of the vocabulary doesn't matter.
    """
    ok = terms >= 0
    key, count = np.unique(terms[ok] * units + words[ok], return_counts=True)
    term, unit = key // units, key % units
    width = units + 2 * SIDE
    alike = np.zeros(2 * SIDE * width)  # at [k, SIDE + u]: units u and u + k
    alike[:width] = np.bincount(unit + SIDE, count.astype(float) ** 2, width)
    for step in range(1, min(2 * SIDE, len(key))):
        apart = unit[step:] - unit[:-step]
        at = np.flatnonzero((term[step:] == term[:-step]) & (apart < 2 * SIDE))
        if not len(at):
            break
        alike += np.bincount(apart[at] * width + unit[at] + SIDE, (count[at] * count[at + step]).astype(float), len(alike))
    alike = alike.reshape(2 * SIDE, width)
    gap = gaps + SIDE
    block = np.zeros(width)  # squared length of SIDE units from each on
    for k in range(SIDE):
        for i in range(SIDE - k):
            block[: width - SIDE] += (2 if k else 1) * alike[k, i : i + width - SIDE]
    both = sum(alike[a + b, gap - a] for a in range(1, SIDE + 1) for b in range(SIDE))
    norm = np.sqrt(block[gap - SIDE] * block[gap])
    alike = np.divide(both, norm, out=np.zeros(len(gap)), where=norm > 0)
    return _rise(alike, text) + _rise(alike[::-1], text[::-1])[::-1] - 2 * alike


def _rise(alike: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The peak reached by climbing to the left from each gap, within its text."""
    place = np.arange(len(alike))
    if len(alike):
        place[1:][(alike[:-1] >= alike[1:]) & (text[:-1] == text[1:])] = 0
    return alike[np.maximum.accumulate(place)]


#: Where a piece ends: at a gap between units, behind a comma or the like, at white space, between the tokenizer's words, inside one, at the end of the text.
CUTS = ("unit", "pause", "space", "word", "character", "end")


def cut_points(ends: np.ndarray, unit: np.ndarray, depth: np.ndarray, most: int, overlap: int, between: np.ndarray, pause: np.ndarray | None = None, space: np.ndarray | None = None) -> list[tuple[int, int, int, float, float]]:
    """Token ranges of the pieces of one text, with the place in CUTS, the depth of a cut at a unit and the mean depth of its window's gaps (NaN of others).

    ends: token position after each word; unit: which positions of `ends` close a unit, with its `depth`; between: for
    each token position 0..n, the largest one not above it that lies between two characters; pause, space: which positions
    of `ends` are at a pause and at white space, all if not given.
    """
    return _cuts(_Places(ends, unit, depth, between, pause, space), most, overlap)


class _Places:
    """The places of one text, as lists, which all limits share."""

    def __init__(self, ends: np.ndarray, unit: np.ndarray, depth: np.ndarray, between: np.ndarray, pause: np.ndarray | None, space: np.ndarray | None) -> None:
        self.total, self.depth = int(ends[-1]), depth
        self.gaps, self.sums, self.edges = ends[unit].tolist(), np.append(0.0, np.cumsum(depth)).tolist(), between.tolist()
        self._softer, self._of = None, (ends, pause, space)

    def softer(self) -> list[tuple[int, list[int]]]:
        """(place in CUTS, token positions) of what is looked at where no unit ends."""
        if self._softer is None:
            ends, pause, space = self._of
            self._softer = [(k, ends[at].tolist()) for k, at in ((1, pause), (2, space)) if at is not None] + [(3, ends.tolist())]
        return self._softer


def _cuts(text: _Places, most: int, overlap: int) -> list[tuple[int, int, int, float, float]]:
    total, pieces, begin, done = text.total, [], 0, 0
    gaps, sums, edges, depth = text.gaps, text.sums, text.edges, text.depth
    while total - begin > most:
        limit = begin + most
        after = begin + 1  # the next piece must begin at a later character, with its overlap
        while edges[after] != after:
            after += 1
        low = max(done, after + overlap - 1)
        a, b = bisect_right(gaps, low), bisect_right(gaps, limit)
        if b > a:
            at = b - 1 - int(depth[a:b][::-1].argmax())
            cut, how = gaps[at], (0, float(depth[at]), (sums[b] - sums[a]) / (b - a))
        else:
            for kind, places in text.softer():
                at = bisect_right(places, limit) - 1
                if at >= 0 and places[at] > (max(low, begin + most // 2) if kind == 1 else low):
                    cut, how = places[at], (kind, np.nan, np.nan)
                    break
            else:
                cut, how = edges[limit], (4, np.nan, np.nan)
                if cut <= low:  # one character is longer than the room left: it stays whole
                    cut = limit
        pieces.append((begin, cut, *how))
        done = cut
        begin = max(edges[max(cut - overlap, 0)], begin + 1)
        if begin < done and total - begin > most and edges[begin] != begin:
            begin = done
    pieces.append((begin, total, 5, np.nan, np.nan))
    return pieces


class Splitter:
    """Splits batches of texts by several limits at once."""

    def __init__(self, vocabulary: Vocabulary, limits: Sequence[tuple[object, int, int]]) -> None:
        self.encoder, self.limits = encoder_of(vocabulary), limits
        key = id(self.encoder)
        if key not in _known:
            _known[key] = _Words(self.encoder)
        self.words = _known[key]
        # bytes 0x80 to 0xBF continue a character: the first byte of each token, and the characters that begin in it
        byte = np.full(len(vocabulary.size), 0, np.int64)
        byte[vocabulary.byte_id] = np.arange(256)
        first, lead = byte.copy(), ((byte < 0x80) | (byte >= 0xC0)).astype(np.int64)
        for t in np.flatnonzero(vocabulary.left >= 0).tolist():  # parts come before what they are merged into
            a, b = vocabulary.left[t], vocabulary.right[t]
            first[t], lead[t] = first[a], lead[a] + lead[b]
        self.inside, self.lead = (first >= 0x80) & (first < 0xC0), lead

    def split(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int, int, int, int, int, int, float, float]]:
        """(text, limit, piece from 1, first character, end character, tokens, tokens shared with the piece before, place in CUTS, depth, mean depth)."""
        e, w = self.encoder, self.words
        _, codes, counts = e.split(list(texts))
        w.learn()
        bounds = np.append(0, np.cumsum(counts))
        least = min(m for _, m, _ in self.limits)
        totals = np.diff(np.append(0, np.cumsum(e.count[codes]))[bounds])
        chosen = np.flatnonzero(totals > least)
        if not len(chosen):
            return
        # all chosen texts in a row, word by word; what looks at a neighbour stops at a text's ends
        sizes = np.diff(bounds)[chosen]
        begins = np.append(0, np.cumsum(sizes))
        text = np.repeat(np.arange(len(chosen)), sizes)
        own = codes[np.arange(begins[-1]) + (bounds[chosen] - begins[:-1])[text]]
        last = np.zeros(len(own), bool)
        last[begins[1:] - 1] = True
        following = np.append(own[1:], own[-1])
        opens, digit = w.open[following] | last, w.digit[following] & ~last
        # a unit ends with a sentence's last word or a line end, after all white space that follows
        blank = w.blank[own]
        # the last stop of e.g. or U.S. ends none
        short = w.dot[own]
        short[3:] &= w.letter[own[2:-1]] & ~w.open[own[2:-1]] & w.dot[own[1:-2]] & w.letter[own[:-3]] & (text[3:] == text[:-3])
        short[:3] = False
        closes = w.stop[own] | w.line[own] | (w.spaced[own] & ~short & opens)
        tail = np.append(blank[1:], False) & ~last  # white space follows: the gap moves behind it
        run_end = np.flatnonzero(~tail)
        moved = np.unique(run_end[np.searchsorted(run_end, np.flatnonzero(closes))])
        unit = moved[~last[moved]]
        pause, space = np.flatnonzero(w.pause[own] & ~digit), np.flatnonzero(opens | blank)
        depth = np.zeros(len(unit))
        if len(unit):
            apart = 2 * SIDE * text
            belongs = np.searchsorted(unit, np.arange(len(own)), side="left") + apart
            first, size = w.first[own], w.first[own + 1] - w.first[own]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            depth = _depths(np.repeat(belongs, size), w.term[at], int(belongs[-1]) + 1, np.arange(1, len(unit) + 1) + apart[unit], text[unit])
        ends, tokens = np.append(0, np.cumsum(e.count[own])), e.tokens_of(own)
        chars = np.append(0, np.cumsum(self.lead[tokens]))  # characters before each token position
        between = np.maximum.accumulate(np.where(np.append(~self.inside[tokens], True), np.arange(len(tokens) + 1), 0))
        parts = [np.searchsorted(x, begins).tolist() for x in (unit, pause, space)]
        for t, i in enumerate(chosen.tolist()):
            lo, hi = int(begins[t]), int(begins[t + 1])
            base, top = int(ends[lo]), int(ends[hi])
            of_unit, of_pause, of_space = (x[p[t] : p[t + 1]] - lo for x, p in zip((unit, pause, space), parts, strict=True))
            places = _Places(ends[lo + 1 : hi + 1] - base, of_unit, depth[parts[0][t] : parts[0][t + 1]], between[base : top + 1] - base, of_pause, of_space)
            place = chars[base : top + 1] - chars[base]
            for k, (_, most, overlap) in enumerate(self.limits):
                if totals[i] <= most:
                    continue
                before, cuts = 0, _cuts(places, most, overlap)
                first, end = place[[c[0] for c in cuts]].tolist(), place[[c[1] for c in cuts]].tolist()
                for n, (a, b, kind, deep, usual) in enumerate(cuts):
                    yield i, k, n + 1, first[n], end[n], b - a, max(0, before - a), kind, deep, usual
                    before = b


def split_oversized(
    docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None
) -> DataFrame:
    """(id, limit_id, piece, start_char, end_char, n_tokens, shared_tokens, cut, depth, usual_depth, piece_text), pieces numbered from 1.

    For each text with more than max_tokens tokens of a row of `limits`: pieces in order that cover the text, each of at
    most max_tokens, where a piece begins overlap_tokens before the end of the one before it (a token or two earlier
    where that would cut a character; shared_tokens says how many). `cut` is where the piece ends (see CUTS), `depth` the
    depth of the valley there and `usual_depth` the mean over all gaps it was chosen from, both NULL if it is no unit's
    end. NULL, empty and shorter texts have no pieces.
    Repeated rows are split each. Limits with NULL or less than 1 token are left out; an overlap that is NULL or
    negative counts as 0, one of half the limit or more as just under half. Other columns are not read. Nothing is shuffled unless
    the source has fewer files than there are cores; what is
    broadcast is the vocabulary and the limits (at most MAX_LIMITS rows, else an error).
    """
    spark = docs.sparkSession
    rows = limits.select("limit_id", "max_tokens", "overlap_tokens").where("max_tokens >= 1").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    chosen = [(r[0], r[1], min(max(0, r[2] or 0), max(0, (r[1] - 1) // 2))) for r in rows]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    limit_kind = limits.schema["limit_id"].dataType.simpleString()
    schema = f"id {kind}, limit_id {limit_kind}, piece int, start_char int, end_char int, n_tokens int, shared_tokens int, cut string, depth double, usual_depth double, piece_text string"
    if not chosen:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    least, limit_type = min(m for _, m, _ in chosen), to_arrow_type(limits.schema["limit_id"].dataType)
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary_path or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared.value, chosen)
        names = pa.array([x for x, _, _ in chosen], limit_type)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < _CHUNK_CHARS):
                    chars += len(texts[to])
                    to += 1
                part = texts[at:to]
                out = list(splitter.split(part))
                if out:
                    cols = np.array([x[:8] for x in out], np.int64).T
                    depths = np.array([x[8:] for x in out]).T
                    pieces = [part[x[0]][x[3] : x[4]] for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(cols[0] + at)), names.take(pa.array(cols[1])), *(pa.array(c, pa.int32()) for c in cols[2:7]), pa.array(CUTS).take(pa.array(cols[7])),
                            *(pa.array(d, pa.float64(), from_pandas=True) for d in depths), pa.array(pieces, pa.string()),
                        ],
                        names=["id", "limit_id", "piece", "start_char", "end_char", "n_tokens", "shared_tokens", "cut", "depth", "usual_depth", "piece_text"],
                    )
                at = to

    # a token has at least one byte, so shorter texts need not be encoded
    return spread(narrow.where(F.octet_length("text") > least)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
