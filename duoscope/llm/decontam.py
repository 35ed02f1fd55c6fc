"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Scripts written without spaces between words: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


_WORDS = re.compile(r"[^\W_]+")
_MIX, _SEPARATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: UTF-8 without other signs than ASCII's as words_of() would have it: letters lower-cased, digits, and spaces for all else.
_PLAIN = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
#: Words of texts that are looked at together, about, and what stands between two texts.
_TOGETHER = 1 << 18
_GAP = 0


def words_of(text: str | None) -> list[str]:
    """Lower-cased words (letters and digits); a letter of a script that is written without spaces is a word of its own."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return _WORDS.findall(text)


class Hashes(dict):
    """64-bit hashes of words, the latest of them remembered."""

    def __missing__(self, word: str | bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")) or 1
        if len(self) < 500_000:
            self[word] = h
        return h

    def of(self, text: str | None) -> list[int]:
        """Those of words_of(text)."""
        if text and not text.isascii():
            text = text.lower()
        # signs and letters of unspaced scripts want the slower way
        plain = text and (text.isascii() or not any(c > "\x7f" and (not c.isalnum() or _UNSPACED.match(c)) for c in set(text)))
        words = text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if plain else words_of(text)
        out = [*map(self.get, words)]
        return [self[w] if h is None else h for w, h in zip(words, out, strict=True)] if None in out else out


def runs(words: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the run of that length that begins at each place), for ascending lengths."""
    h = np.zeros(len(words), np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        if n > len(words):
            return
        x = h[: len(words) - n + 1] * _MIX + words[n - 1 :]
        x = (x ^ (x >> np.uint64(32))) * _SEPARATE
        h = x ^ (x >> np.uint64(29))
        if n in lengths:
            yield n, h


def pieces(n_words: int, budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 pieces as equal as can be: whoever makes `budget` edits leaves one of them whole."""
    n = budget + 1
    return [(n_words * i // n, n_words * (i + 1) // n) for i in range(n)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end): the least edit distance between the pattern and any run of the text, and where the first such run ends.

    Myers (1999) with words as symbols: a column of the distance matrix is two integers of len(pattern) bits, and a
    step costs a few operations on them.
    """
    m = len(pattern)
    ones, last = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    up, down, score = ones, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        vertical = eq | down
        horizontal = ((eq & up) + up ^ up) | eq
        plus, minus = down | ~(horizontal | up) & ones, up & horizontal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus, minus = plus << 1 & ones, minus << 1 & ones
        up, down = minus | ~(vertical | plus) & ones, plus & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The items of one block: sorted hashes of all their pieces, by length, and the words of every item.

    It is made once, on the driver, of arrays that go to the executors as they are: some 8 bytes a word and 16 a piece.
    """

    def __init__(self, items: Iterable[tuple[int, str]], error_rate: float) -> None:
        hashes = Hashes()
        self.ids: list = []
        self.budgets: list[int] = []
        self.words: list[np.ndarray] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, words in dict.fromkeys((item_id, tuple(words_of(text))) for item_id, text in items):
            if not words:
                continue
            w = np.array([hashes[x] for x in words], np.uint64)
            budget = int(len(w) * error_rate)
            cuts = pieces(len(w), budget)
            for n, h in runs(w, sorted({b - a for a, b in cuts})):
                found.setdefault(n, []).extend((int(h[a]), len(self.ids), a) for a, b in cuts if b - a == n)
            self.ids.append(item_id)
            self.budgets.append(budget)
            self.words.append(w)
        self.pieces = {}
        for n, places in found.items():
            places.sort()
            known = np.array([x[0] for x in places], np.uint64)
            # a table of the first bits of the hashes turns nearly all runs away before they are looked up
            shift = np.uint64(64 - min(24, max(12, len(known).bit_length() + 6)))
            table = np.zeros(1 << (64 - int(shift)), bool)
            table[known >> shift] = True
            self.pieces[n] = (known, np.array([x[1:] for x in places], np.int64), table, shift)

    @classmethod
    def sent(cls, arrays: dict) -> Matcher:
        """The matcher again from vars() of one: what is broadcast is plain, as the package needn't be on the executors."""
        out = cls.__new__(cls)
        out.__dict__ = arrays
        return out

    def match(self, text: str | None) -> list[tuple[int, int, int]]:
        return self.match_all([text], Hashes())[0]

    def match_all(self, texts: Sequence[str | None], hashes: Hashes) -> list[list[tuple[int, int, int]]]:
        """For each text (item_id, distance, end word) of every item within its budget, the nearest run of each.

        Piece hits say where an item would begin. Windows that overlap are one, so that a text that repeats a piece is
        read by Myers' recurrence once for an item.
        """
        out: list[list[tuple[int, int, int]]] = []
        some: list[list[int]] = []
        size = 0
        for t in texts:
            some.append(hashes.of(t) if self.ids else [])
            size += len(some[-1])
            if size > _TOGETHER:
                out += self._match_words(some)
                some, size = [], 0
        return out + self._match_words(some)

    def _match_words(self, texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = ends - [len(t) + 1 for t in texts]
        words = np.fromiter(chain.from_iterable((*t, _GAP) for t in texts), np.uint64, int(ends[-1]) if len(ends) else 0)
        begins: dict[tuple[int, int], list[int]] = {}
        for n, h in runs(words, sorted(self.pieces)):
            known, places, table, shift = self.pieces[n]
            hit = np.nonzero(table[h >> shift])[0]
            first = np.searchsorted(known, h[hit])
            true = known[np.minimum(first, len(known) - 1)] == h[hit]
            hit, first = hit[true], first[true]
            of = np.searchsorted(ends, hit, side="right")
            for at, t, i in zip(hit.tolist(), of.tolist(), first.tolist(), strict=True):
                value = known[i]
                while i < len(known) and known[i] == value:
                    item, a = places[i].tolist()
                    begins.setdefault((t, item), []).append(at - int(starts[t]) - a)
                    i += 1
        best: list[dict[object, tuple[int, int]]] = [{} for _ in texts]
        for (t, i), where in sorted(begins.items()):
            item_id, item, budget = self.ids[i], self.words[i].tolist(), self.budgets[i]
            for low, high in self._windows(where, len(item), budget):
                distance, stop = myers(item, texts[t][low:high])
                if distance <= budget and (item_id not in best[t] or (distance, low + stop) < best[t][item_id]):
                    best[t][item_id] = (distance, low + stop)
        return [[(item_id, d, e) for item_id, (d, e) in b.items()] for b in best]

    @staticmethod
    def _windows(starts: list[int], size: int, budget: int) -> list[tuple[int, int]]:
        """The stretches of words that the item may lie in if it begins within budget of one of the starts."""
        out: list[tuple[int, int]] = []
        for s in sorted(set(starts)):
            low, high = max(0, s - budget), max(0, s + size + budget)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in lists of about block_bytes of text each, all of an id in one: what goes to the driver and the executors is bounded."""
    items = bench.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
        yield [(r["i"], r["t"]) for r in part.toLocalIterator()]


def leaks(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = 0.15, block_bytes: int = 32 << 20,
) -> DataFrame:
    """(doc_id, item_id, distance, end_word): each test item that a document holds with at most error_rate * words word edits.

    Texts are compared as sequences of lower-cased words, without punctuation; a letter of a script without spaces is a
    word. An item of m words has a budget of k = floor(error_rate * m) edits and is cut into k + 1 pieces, one of which
    any run within the budget holds whole; exact piece hits (hashes of the runs of a text, looked up among those of all
    pieces) are verified with Myers' bit-parallel distance in the windows around them. An item too short for an edit must
    stand there whole and unchanged, however short it is; what is too short for evidence is to be left out of the
    benchmark. One row per row of docs and item id, with the nearest run, the earliest of equally near ones; end_word is
    where it ends, in words. Items of one id with several texts count as their nearest; repeated items count once. Null,
    empty and wordless texts match nothing on either side, and an empty table gives an empty result. Repeated rows get
    repeated results. Very long texts are read whole, in time in proportion to their length. No shuffle: the benchmark
    goes to the executors in blocks of block_bytes of text (see Matcher), and docs are scanned once for each.
    """
    item_kind = dict(bench.select(F.col(item_col).alias("d")).dtypes)["d"]
    hits = StructType.fromDDL(f"item_id array<{item_kind}>, distance array<int>, end_word array<long>")
    out = None
    for items in _blocks(bench, item_col, item_text_col, block_bytes):
        found = _found(docs.sparkSession.sparkContext.broadcast(vars(Matcher(items, error_rate))), hits)
        part = docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("m"))
        part = part.select("doc_id", F.explode(F.arrays_zip("m.item_id", "m.distance", "m.end_word")).alias("x")).select("doc_id", "x.*")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.15, block_bytes: int = 32 << 20) -> DataFrame:
    """The documents that hold no test item (see leaks()), with all their columns, whatever their names.

    A decision for each row, whatever its id: repeated rows share their fate, rows without a text stay, and an empty
    table stays empty. One scan of docs.
    """
    for items in _blocks(bench, item_col, item_text_col, block_bytes):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(vars(Matcher(items, error_rate))))(F.col(text_col)))
    return docs


def _found(sent: Broadcast, hits: StructType) -> Callable[[Column], Column]:
    @F.pandas_udf(hits)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher, hashes = Matcher.sent(sent.value), Hashes()
        for s in texts:
            rows = [[[h[i] for h in m] for i in range(3)] for m in matcher.match_all(s, hashes)]
            yield pd.DataFrame(rows, columns=hits.names, dtype=object)

    return found


def _clean(sent: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher, hashes = Matcher.sent(sent.value), Hashes()
        for s in texts:
            yield pd.Series([not m for m in matcher.match_all(s, hashes)], dtype=bool)

    return clean
