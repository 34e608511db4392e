"""Evaluation texts leaking into training text: q-gram lemma filter in diagonal bands, then banded alignment.

Texts are reduced to a stream of letters and digits of any script (no case, marks, blanks, markup or line breaks), so
layout and hyphenation leave no trace. A run of `WORDS` item words of which `CHANGED` may be changed keeps at least as
many q-grams as it has, less those that touch its `CHANGED` richest words: the q-gram lemma, worked out for every such
run of every item. All q-grams count, but of a run only as many as the bound needs are looked up: those of the fewest
items first, and common ones too where rare ones do not suffice (`Item.plan`). A region is kept if q-grams on one band of
diagonals (position in the document minus position in the item) reach the bound of a run they lie in. Bands overlap by
half, so a passage whose diagonal drifts by up to half a band is whole in one of them.

Verification is a banded alignment (equal +2, unequal -1, gap -2) of the whole item around the diagonals of a region,
done for all regions of an Arrow batch at once, row by row. A word counts as present if most of its letters are aligned
in runs of RUN equal letters; the passage is the longest stretch of item words with few absent ones.

How many items hold a word or a q-gram is counted once over all items by Spark. Equal items count as one.

Scale: a narrow map over the documents with one scan for each BLOCKS blocks of items, which are broadcast; nothing that
grows with the corpus is shipped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
BAND = 32
WORDS = 12
CHANGED = 2  # changed words of a run that the lemma's bound allows for ...
DAMAGE = 1  # ... and letters changed besides
ENOUGH, LEAST = 8, 8  # looked-up q-grams that a run keeps as a rule, and at least
LEVELS = (1, 2, 4, 8, 16, 32, 64, 1 << 62)
ABSENT = 0.2
RUN = 4
EQUAL, UNEQUAL, GAP = 2, 2, 3  # what a pair of letters earns or costs in the alignment; unlike texts score below nothing, so the path does not wander
SURE_RUN = 9
RARE = 2  # a word or q-gram is telling if at most so many items hold it
TELLING = 12
SHARED = 3  # items from which on a leading line is a standing instruction
BLOCK, BLOCKS = 5000, 8  # items in a broadcast index, indexes in a scan
BATCH = 200  # texts whose q-grams are counted in one go: their numbers stay in the processor's cache
CELLS = 1 << 25  # cells of the alignments done at once

_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
_UNKNOWN = np.uint32(0xFFFFFFFF)
_CODE = np.full(0x110000, _UNKNOWN, np.uint32)  # code point -> its letter in small, 0 for what is neither letter nor digit; filled as met


def _codes(text: str) -> np.ndarray:
    """Code of every character of a text without markup and marks; 0 where it is neither a letter nor a digit."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub("", text)
    if text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
    else:
        raw = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le", "replace"), np.uint32)
    out = _CODE[raw]
    if len(out) and (out == _UNKNOWN).any():
        for c in np.unique(raw[out == _UNKNOWN]).tolist():
            low = unicodedata.normalize("NFKD", chr(c).casefold())[:1]
            kind = unicodedata.category(low) if low else "Cn"
            # 1: dropped without a gap (marks, soft hyphens and other signs that are not seen)
            _CODE[c] = ord(low) + 2 if kind[0] in "LN" else 1 if kind[0] == "M" or kind == "Cf" else 0
        out = _CODE[raw]
    return out


def stream(text: str) -> np.ndarray:
    c = _codes(text)
    return c[c > 1]


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The stream of an item and the number of the word that each letter belongs to. Of scripts without blanks two characters are a word."""
    c = _codes(text)
    c = c[c != 1]
    inside = c > 1
    start = inside & ~np.concatenate([[False], inside[:-1]])
    dense = inside & (c >= 0x2E82) & (c < 0xA4D2)
    if dense.any():
        first = dense & ~np.concatenate([[False], dense[:-1]])
        at = np.arange(len(c))
        since = at - np.maximum.accumulate(np.where(first, at, 0))
        start |= (dense & (since % 2 == 0)) | (inside & ~dense & np.concatenate([[False], dense[:-1]]))
    number = np.cumsum(start) - 1
    return c[inside], number[inside].astype(np.int32)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit numbers of the q-grams at every position: polynomials over mixed codes, put together from halves."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    out = codes.astype(np.uint64)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    width, base = 1, 0xD6E8FEB86659FD93
    while width < q:  # of a q that is no power of two the last halves overlap
        step = min(width, q - width)
        head = out[: len(out) - step] * np.uint64(pow(base, width, 1 << 64) | 1)
        head += out[step:]
        if step < width:
            head ^= head >> np.uint64(31)
        out = head
        width += step
    return out


def word_names(codes: np.ndarray, word: np.ndarray) -> list[bytes]:
    edge = np.flatnonzero(np.diff(word)) + 1
    return [w.tobytes() for w in np.split(codes, edge)] if len(codes) else []


class Item:
    """One own text with the numbers of items that hold its words and its q-grams."""

    def __init__(self, ids: list[int], codes: np.ndarray, word: np.ndarray, word_held: np.ndarray, gram_held: np.ndarray):
        self.ids, self.codes, self.word = list(ids), codes, word
        self.total = np.bincount(word) if len(word) else np.zeros(0, np.int64)
        self.rare = (word_held <= RARE) & (self.total >= 4)
        self.tells = gram_held <= RARE
        self.held = gram_held

    def runs(self, q: int = Q, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """First and last q-gram of every run of `words` words."""
        begin = np.concatenate([[0], np.cumsum(self.total)])
        n = max(0, len(self.total) - words + 1) if len(self.held) else 0
        return begin[:n], np.minimum(begin[words : words + n] - q, len(self.held) - 1)

    def counts(self, mask: np.ndarray, q: int = Q, words: int = WORDS, changed: int = CHANGED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per run: q-grams of `mask` that it has, that are left by the lemma whichever words are changed, and that are left as a rule."""
        first, last = self.runs(q, words)
        begin, g = np.concatenate([[0], np.cumsum(self.total)]), len(self.held)
        before = np.concatenate([[0], np.cumsum(mask)])
        touched = before[np.clip(begin[1:], 0, g)] - before[np.clip(begin[:-1] - q + 1, 0, g)]
        inner = np.lib.stride_tricks.sliding_window_view(touched, words)[:, 1:-1]
        has = before[np.maximum(last + 1, first)] - before[first]
        return has, has - np.sort(inner, axis=1)[:, -changed:].sum(axis=1), has - changed * inner.mean(axis=1)

    def plan(self, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, need, reach) of the q-grams to look up.

        A run takes the rarest level of q-grams of which ENOUGH are left as a rule; need is the least number over the
        runs in which a q-gram counts, reach the letters of the longest of them.
        """
        first, last = self.runs(q)
        n, g = len(first), len(self.held)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        level, need, free = np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, bool)
        for most in LEVELS:
            has, bound, usual = self.counts(self.held <= most, q)
            good = free & ((usual >= ENOUGH) | (most == LEVELS[-1]))
            level[good], need[good] = most, np.maximum(np.maximum(bound, np.minimum(usual // 1, LEAST)), 1)[good]
            free &= ~good
        least, reach = np.full(g, np.iinfo(np.int32).max, np.int64), np.zeros(g, np.int64)
        for a in range(n):
            p = np.arange(first[a], last[a] + 1)
            p = p[self.held[p] <= level[a]]
            least[p] = np.minimum(least[p], need[a])
            reach[p] = np.maximum(reach[p], last[a] - first[a])
        chosen = np.flatnonzero(reach > 0)
        return chosen.astype(np.int32), least[chosen].astype(np.int32), reach[chosen].astype(np.int32)


class Index:
    """Places of the chosen q-grams of a block of items."""

    def __init__(self, items: list[Item], q: int = Q):
        self.items, self.q = items, q
        plans = [i.plan(q) for i in items]
        put = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        gram = put([grams(i.codes, q)[p] for i, (p, _, _) in zip(items, plans)], np.uint64)
        owner = put([np.full(len(p), k) for k, (p, _, _) in enumerate(plans)], np.int32)
        order = np.argsort(gram, kind="stable")
        self.owner = owner[order]
        self.pos, self.need, self.reach = (put([p[k] for p in plans], np.int32)[order] for k in range(3))
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, np.bool_)
        self.bits[self._slot(self.gram)] = True
        # all items in one row, with room between them; where a word begins, its end; where a run begins, its last q-gram and
        # the lemma's bound for it
        room = int(self.reach.max(initial=0)) + q
        self.base = np.cumsum([room, *(len(i.codes) + room for i in items)])
        self.low = np.full(self.base[-1] + room, 254, np.uint8)
        self.run_last, self.run_need, self.word_end = np.full(len(self.low), -1, np.int32), np.zeros(len(self.low), np.int32), np.full(len(self.low), -1, np.int32)
        self.sure_end, self.rare, self.tells = np.full(len(self.low), -1, np.int32), np.zeros(len(self.low), bool), np.zeros(len(self.low), bool)
        for at, i in zip(self.base, items):
            self.low[at : at + len(i.codes)] = i.codes % 251
            first, last = i.runs(q)
            stop = at + np.cumsum(i.total)
            self.word_end[stop - i.total], self.rare[stop - i.total] = stop, i.rare
            self.sure_end[(stop - i.total)[: max(0, len(stop) - SURE_RUN + 1)]] = stop[SURE_RUN - 1 :]
            self.tells[at : at + len(i.tells)] = i.tells
            if len(first):
                _, bound, _ = i.counts(np.ones(len(i.held), bool), q)
                self.run_last[at + first], self.run_need[at + first] = at + last, np.maximum(1, bound - DAMAGE * q)

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).view(np.int64)

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `g`, row of the index) of every q-gram that is held."""
        at = np.flatnonzero(self.bits[self._slot(g)])
        g = g[at]
        if not len(self.gram):
            return at[:0], at[:0]
        k = np.searchsorted(self.gram, g)
        k[k == len(self.gram)] = 0
        same = self.gram[k] == g
        at, k = at[same], k[same]
        n = self.count[k]
        rows = np.repeat(self.first[k], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.repeat(at, n), rows


def seeds(at: np.ndarray, rows: np.ndarray, doc: np.ndarray, begin: np.ndarray, index: Index, band: int = BAND) -> np.ndarray:
    """(text, item, diagonal, from, to) where a band holds as many looked-up q-grams as a run of the item needs; the runs lie in from..to."""
    item, pos, need, reach = index.owner[rows], index.pos[rows], index.need[rows], index.reach[rows]
    diag = at - begin[doc] - pos
    pair = doc * len(index.items) + item
    out = [np.zeros((0, 5), np.int64)]
    for shift in (0, band // 2):
        b = (diag + shift) // band
        # bands with too few q-grams are dropped before sorting; bands that share a slot only keep more
        slot = (pair * 1009 + b) & ((1 << 20) - 1)
        order = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= need)
        order = order[np.lexsort((pos[order], b[order], pair[order]))]
        p, k, w = pos[order], pair[order], b[order]
        end = np.arange(len(p)) + need[order] - 1
        last = np.minimum(end, len(p) - 1)
        dense = np.flatnonzero((end < len(p)) & (k == k[last]) & (w == w[last]) & (p[last] - p <= reach[order]))
        if not len(dense):
            continue
        new = np.ones(len(dense), bool)
        new[1:] = (k[dense[1:]] != k[dense[:-1]]) | (w[dense[1:]] != w[dense[:-1]]) | (dense[1:] > np.maximum.accumulate(last[dense])[:-1])
        x, y = dense[new], dense[np.append(np.flatnonzero(new)[1:] - 1, len(dense) - 1)]
        mid = order[(x + last[y]) // 2]
        out.append(np.stack([doc[mid], item[mid], diag[mid], p[last[x]] - reach[order[x]], p[y] + reach[order[y]] + index.q], 1))
    found = np.concatenate(out)
    if len(found):  # seeds side by side on neighbouring diagonals, and what both shifts give, are looked at once
        key = [found[:, 3] // 16, found[:, 2] // 4, found[:, 1], found[:, 0]]
        found = found[np.lexsort(key)]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1) | (np.diff(found[:, 2] // 4) != 0) | (np.diff(found[:, 3] // 16) != 0)]))
        lo, hi = np.minimum.reduceat(found[:, 3], new), np.maximum.reduceat(found[:, 4], new)
        found = np.column_stack([found[new, :3], lo, hi])
    return found


def _pad(mask: np.ndarray, n: int) -> np.ndarray:
    return np.pad(mask, ((0, 0), (0, n - mask.shape[1])))


def _between(mask: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Per row and place: how many places of `mask` are set from there up to, not including, `to` (0 where `to` is before)."""
    before = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.cumsum(mask, axis=1, out=before[:, 1:])
    return np.take_along_axis(before, to, axis=1) - before[:, :-1]


def _readable(rest: np.ndarray, n: int, two: np.ndarray, four: np.ndarray, gram: np.ndarray, equal: np.ndarray, place: np.ndarray, start: np.ndarray, fits: np.ndarray, stop: np.ndarray, index: Index, least: int) -> np.ndarray:
    """Whether `passage` can accept a region: no fewer words than that can count as present, and what `longest` asks for besides."""
    if not len(rest):
        return np.zeros(0, bool)
    two, four, gram = two[rest], four[rest], gram[rest]
    exact = {2: _pad(two.any(axis=1), n), 3: _pad((two[:, :, :-1] & equal[rest][:, :, 2:]).any(axis=1), n), RUN: _pad(four.any(axis=1), n)}
    covered = exact[RUN].copy()
    for k in range(1, RUN):
        covered[:, k:] |= exact[RUN][:, :-k]
    # words that can count as present: short ones that stand there, longer ones with most letters in runs
    end = index.word_end[place] - start[:, None]
    word = (end > 0) & (end <= n)
    size = np.where(word, end - np.arange(n), 0)
    there = (size > RUN) & (_between(covered, np.where(word, end, 0)) >= 0.6 * size) | (size == 1)
    for k, m in exact.items():
        there |= (size == k) & m
    good = fits & (_between(there, np.where(fits, stop + index.q - 1, 0)) >= least)
    sure = index.sure_end[place] - start[:, None]
    sure = (_between(there, np.clip(sure, 0, n)) >= SURE_RUN) & (sure <= n)
    told = (there & index.rare[place]).any(axis=1) | sure.any(axis=1) | ((gram & index.tells[place]).sum(axis=1) >= TELLING)
    return good.any(axis=1) & told


def regions(whole: np.ndarray, begin: np.ndarray, index: Index, band: int = BAND) -> list[tuple[int, int, int]]:
    """(text, item, diagonal) of the bands in which a run of an item keeps as many of all its q-grams as the lemma's bound."""
    at, rows = index.hits(grams(whole, index.q))
    found = seeds(at, rows, np.searchsorted(begin, at, side="right") - 1, begin, index, band)
    found = found[np.argsort(found[:, 4] - found[:, 3], kind="stable")]
    low = (whole % 251).astype(np.uint8)
    keep, i, width, least = np.zeros(len(found), bool), 0, band + 1, WORDS - int(np.ceil(ABSENT * WORDS))
    while i < len(found):
        # regions of like length side by side
        j = min(len(found), i + 256)
        j = i + max(1, min(j - i, (CELLS >> 3) // (width * int(found[j - 1, 4] - found[j - 1, 3]))))
        doc, item, diag, lo, hi = found[i:j].T
        n = int((hi - lo).max())
        start = (index.base[item] + lo).astype(np.int32)
        part = np.take(index.low, start[:, None] + np.arange(n, dtype=np.int32), mode="clip")
        text = np.take(low, (begin[doc] + lo + diag - band // 2)[:, None] + np.arange(n + width - 1), mode="clip")
        equal = np.lib.stride_tricks.sliding_window_view(text, n, axis=1) == part[:, None, :]
        two = equal[:, :, :-1] & equal[:, :, 1:]
        four = two[:, :, :-2] & two[:, :, 2:]
        gram = _pad((four[:, :, : -(index.q - RUN)] & four[:, :, index.q - RUN :]).any(axis=1), n)
        place = np.minimum(start[:, None] + np.arange(n, dtype=np.int32), np.int32(len(index.low) - 1))
        stop = index.run_last[place] - start[:, None] + 1
        fits = (stop > 0) & (stop + index.q - 1 <= n)
        fits &= _between(gram, np.where(fits, stop, 0)) >= index.run_need[place]
        rest = np.flatnonzero(fits.any(axis=1))
        keep[i + rest] = _readable(rest, n, two, four, gram, equal, place[rest], start[rest], fits[rest], stop[rest], index, least)
        i = j
    # what both shifts of the bands give, or regions side by side on one diagonal, is aligned once
    out: list[tuple[int, int, int]] = []
    for d, k, m in sorted(map(tuple, found[keep, :3].tolist())):
        if not (out and out[-1][:2] == (d, k) and m - out[-1][2] <= band // 8):
            out.append((d, k, m))
    return out


def align(pairs: list[tuple[np.ndarray, np.ndarray, int]], half: int = BAND // 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per (document, item, diagonal): whether each letter of the item is aligned with an equal one, and the diagonal it is aligned on.

    Best path through the whole item within `half` of the diagonal: +2 for equal letters, -1 for unequal ones, -2 for a
    letter left out on either side. Both ends of the document are free.
    """
    if not pairs:
        return []
    width, most, r = 2 * half + 1, max(len(i) for _, i, _ in pairs), len(pairs)
    item = np.full((most, r), 0xFFFFFFFE, np.uint32)
    text = np.full((most + width, r), 0xFFFFFFFF, np.uint32)
    for k, (d, i, m) in enumerate(pairs):
        item[: len(i), k] = i
        lo = m - half
        part = d[max(0, lo) : max(0, lo + most + width)]
        text[max(0, -lo) : max(0, -lo) + len(part), k] = part[: max(0, most + width - max(0, -lo))]
    score = np.zeros((width, r), np.int32)
    step = np.zeros((most, width, r), np.int8)  # 1 equal, 0 unequal, 2 item letter left out, 3 document letter left out
    slope = GAP * np.arange(width, dtype=np.int32)[:, None]
    up = np.full((width, r), -(1 << 20), np.int32)
    for i in range(most):
        equal = text[i : i + width] == item[i]
        here = score - UNEQUAL
        here += equal * np.int32(EQUAL + UNEQUAL)
        up[:-1] = score[1:] - GAP
        code = equal.view(np.int8).copy()
        better = up > here
        code[better] = 2
        np.maximum(here, up, out=here)
        across = np.maximum.accumulate(here + slope, axis=0) - slope
        code[across > here] = 3
        step[i] = code
        score = across
    covered, diagonal = np.zeros((most, r), bool), np.zeros((most, r), np.int32)
    i, b, every = np.full(r, most - 1), score.argmax(axis=0), np.arange(r)
    # letters behind the end of a shorter item are filling: their path does not matter
    while True:
        live = np.flatnonzero(i >= 0)
        if not len(live):
            break
        li, lb = i[live], b[live]
        s = step[li, lb, every[live]]
        covered[li, live] = s == 1
        diagonal[li, live] = lb
        i[live] = li - (s != 3)
        b[live] = lb + (s == 2) - (s == 3)
    return [(covered[: len(t), k], diagonal[: len(t), k] + (m - half)) for k, (_, t, m) in enumerate(pairs)]


def runs_of(covered: np.ndarray, diagonal: np.ndarray, run: int) -> np.ndarray:
    """Covered letters that lie in a run of at least `run` on one diagonal."""
    edge = np.ones(len(covered) + 1, bool)
    edge[1:-1] = (covered[1:] != covered[:-1]) | (diagonal[1:] != diagonal[:-1])
    at = np.flatnonzero(edge)
    return np.repeat(np.diff(at) >= run, np.diff(at)) & covered


def stretched(doc: np.ndarray, item: np.ndarray, covered: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Letters in runs, each run drawn out as far as both texts stay equal: of paths of one score the trace may take one that leaves a run early."""
    firm = runs_of(covered, diagonal, RUN)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], firm, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        for x, step in ((b, 1), (a - 1, -1)):
            shift = diagonal[x - step]
            while 0 <= x < len(item) and not firm[x] and 0 <= x + shift < len(doc) and item[x] == doc[x + shift]:
                covered[x] = firm[x] = True
                diagonal[x] = shift
                x += step
    return firm


def passage(doc: np.ndarray, item: Item, covered: np.ndarray, diagonal: np.ndarray, min_words: int = WORDS) -> int:
    """Words of the longest stretch of the item that the alignment with `doc` holds."""
    word, total = item.word, item.total
    firm = stretched(doc, item.codes, covered, diagonal)
    present = np.bincount(word, weights=firm, minlength=len(total)) >= 0.6 * total
    if present.sum() < (1 - ABSENT) * min_words / 2:
        return 0
    # words shorter than a run count where all their letters are aligned in one piece, near a present word
    begin = np.cumsum(total) - total
    whole = (np.bincount(word, weights=covered, minlength=len(total)) == total) & (total < RUN + 1)
    whole &= diagonal[begin] == diagonal[begin + total - 1]
    near = present.copy()
    for k in (1, 2):
        near[k:] |= present[:-k]
        near[:-k] |= present[k:]
    present |= whole & near
    changed = replaced(present, covered, diagonal, total)
    q = min(Q, max(1, len(covered)))
    full = np.lib.stride_tricks.sliding_window_view(firm, q).all(axis=1)[: len(item.tells)] if len(item.tells) else np.zeros(0, bool)
    own = np.bincount(word[: len(full)], weights=full & item.tells[: len(full)], minlength=len(total)).astype(int)
    return longest(present.tolist(), item.rare.tolist(), changed.tolist(), own.tolist(), min_words)


def replaced(present: np.ndarray, covered: np.ndarray, diagonal: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Words in whose place the document has others: absent ones between present ones, at least half of their letters being made up for."""
    out = np.zeros(len(present), bool)
    begin = np.cumsum(total) - total
    known = np.flatnonzero(present)
    for a, b in zip(known[:-1], known[1:]):
        if b - a > 1:
            left = np.flatnonzero(covered[begin[a] : begin[a] + total[a]])[-1] + begin[a]
            right = np.flatnonzero(covered[begin[b] : begin[b] + total[b]])[0] + begin[b]
            letters = begin[b] - begin[a + 1]
            out[a + 1 : b] = 2 * (letters + diagonal[right] - diagonal[left]) >= letters
    return out


def longest(present: list[bool], rare: list[bool], changed: list[bool], own: list[int], min_words: int = WORDS, absent: float = ABSENT, sure: int = SURE_RUN, telling: int = TELLING) -> int:
    """Length of the longest stretch that begins and ends with a present word, with at most that share absent, no three in a row.

    Set phrases of several items meet by chance. A stretch with a run of `sure` present words or a word that few items
    have counts. Any other must hold `telling` telling q-grams (`own`: how many start in each word), and its absent words
    must be `changed` into others, not left out, and not side by side (as a name is that two texts do not share), unless
    `min_words` words are present.
    """
    best = 0
    n = len(present)
    for i in range(n):
        if not present[i] or best >= n - i:
            continue
        missing = row = run = told = 0
        plain = True
        good = False
        for j in range(i, n):
            if present[j]:
                row = 0
                run += 1
                good = good or run >= sure or rare[j]
                if missing <= absent * (j - i + 1) and (good or told >= telling and (plain or j - i + 1 - missing >= min_words)):
                    best = max(best, j - i + 1)
            else:
                missing += 1
                row += 1
                run = 0
                plain = plain and changed[j] and row < 2
                if row >= 3:
                    break
            told += own[j]
    return best


def find(texts: list[str | None], index: Index, min_words: int = WORDS) -> list[tuple[int, int, int]]:
    """(number of the text, item id, words of the longest passage) for texts that hold a passage of an item."""
    gap = np.full(1, 1, np.uint32)
    jobs: list[tuple[int, int, np.ndarray, int]] = []
    for at in range(0, len(texts), BATCH):
        streams = [stream(t) if t else np.zeros(0, np.uint32) for t in texts[at : at + BATCH]]
        begin = np.cumsum([0, *(len(s) + 1 for s in streams)])
        whole = np.concatenate([x for s in streams for x in (s, gap)])
        jobs += [(at + d, i, streams[d], m) for d, i, m in regions(whole, begin, index)]
    # items of like length side by side, so that little is filled up; as many at once as CELLS allows
    jobs.sort(key=lambda j: len(index.items[j[1]].codes))
    found: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(jobs):
        size = 1
        while at + size < len(jobs) and (size + 1) * (BAND + 1) * len(index.items[jobs[at + size][1]].codes) <= CELLS:
            size += 1
        part = jobs[at : at + size]
        for (d, i, s, _), (covered, diagonal) in zip(part, align([(s, index.items[i].codes, m) for _, i, s, m in part])):
            words = passage(s, index.items[i], covered, diagonal, min_words)
            if words >= min_words:
                found[(d, i)] = max(words, found.get((d, i), 0))
        at += size
    return [(d, x, w) for (d, i), w in found.items() for x in index.items[i].ids]


def own_texts(items: DataFrame, key: str, text: str, shared: int = SHARED) -> DataFrame:
    """(ids, own): the different own texts of items and the ids of the items that have them.

    A standing instruction is a line that at least `shared` different items have and that stands before further text;
    the last line of an item always belongs to it.
    """
    plain = F.filter(F.transform(F.split(F.col(text), r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " "))), lambda x: x != "")
    one = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), plain.alias("lines")).groupBy("lines").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    lines = one.select("ids", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"), F.xxhash64("lines").alias("h"))
    many = lines.select(F.lower("line").alias("low"), "h").distinct().groupBy("low").count().where(F.col("count") >= shared).select("low")
    kept = lines.withColumn("low", F.lower("line")).join(many.withColumn("standing", F.lit(True)), "low", "left").where("standing IS NULL OR at = n - 1")
    own = kept.groupBy("h", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("own"))
    return own.groupBy("own").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))


def with_counts(own: DataFrame, q: int = Q) -> DataFrame:
    """Adds `held`: for every word (kind 0) and q-gram (kind 1) of an own text, in order, the number of own texts that hold it."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for row, text in zip(pdf["row"], pdf["own"]):
                codes, word = words_of(text)
                names = np.array([int.from_bytes(hash_bytes(w), "little", signed=True) for w in word_names(codes, word)], np.int64)
                g = grams(codes, q).view(np.int64)
                parts.append(pd.DataFrame({"row": row, "kind": np.repeat([0, 1], [len(names), len(g)]), "at": np.concatenate([np.arange(len(names)), np.arange(len(g))]), "k": np.concatenate([names, g])}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["row", "kind", "at", "k"])

    rows = own.withColumn("row", F.xxhash64("own"))
    places = rows.select("row", "own").mapInPandas(keys, "row long, kind int, at int, k long")
    held = places.select("kind", "k", "row").distinct().groupBy("kind", "k").agg(F.count("*").alias("n"))
    counts = places.join(held, ["kind", "k"]).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "at", "n"))), lambda x: x["n"]).alias("held"))
    return rows.join(counts, "row").select("own", "ids", "held")


def hash_bytes(b: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64(b).digest()


def item_of(own: str, ids: list[int], held: list[int]) -> Item:
    codes, word = words_of(own)
    n = int(word[-1]) + 1 if len(word) else 0
    held = np.asarray(held, np.int64)
    return Item(ids, codes, word, held[:n], held[n:])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = WORDS) -> DataFrame:
    """(key, item_id, words): every document that holds `min_words` running words of an item's own text.

    words is the longest passage along one band of diagonals. Null, empty and shorter texts on either side match nothing;
    repeated documents and items come out each for itself; an empty table on either side gives an empty result. Very long
    texts are read whole. The corpus is scanned once for each BLOCK * BLOCKS different items; how items fall into blocks
    has no influence on the result. Columns besides the four named ones are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    base = docs.where(F.length(text) > 0).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    shipped, block = [], []
    for r in with_counts(own_texts(items, item_key, item_text)).toLocalIterator():
        item = item_of(r.own, r.ids, r.held)
        if len(item.total) >= min_words:
            block.append(item)
        if len(block) == BLOCK:
            shipped.append(spark.sparkContext.broadcast(Index(block)))
            block = []
    if block or not shipped:
        shipped.append(spark.sparkContext.broadcast(Index(block)))
    out = None
    for at in range(0, len(shipped), BLOCKS):
        part = shipped[at : at + BLOCKS]

        def scan(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                keys, texts = pdf["_k"].tolist(), pdf["_t"].tolist()
                got = [(keys[d], i, w) for index in part for d, i, w in find(texts, index.value, min_words)]
                yield pd.DataFrame(got, columns=["_k", "item_id", "words"])

        found = base.mapInPandas(scan, f"_k {kind}, item_id long, words int")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("_k", key)
