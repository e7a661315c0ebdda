"""Noise in text from scanned pages: found, and repaired into continuous paragraphs.

* Page structure. The lines at the top and foot of a record's pages are compared with page numbers and
  easily confused characters set aside: what stands there on three or more pages is a running line. Page
  numbers are told by their form, bare ones by counting on from page to page.
* Hyphenation. A word cut at a line end is joined where the joined form is likelier than the compound.
* Misread characters. A noisy channel: of each word and of the words that could be misread as it (by the
  confusions below) the likelihood under the corpus' word and word pair counts times the probability of
  the confusions is decoded by Viterbi, line by line. What misreadings of other words explain of a word's
  count is no evidence for it; nothing else keeps a candidate out.

The counts cover all pages of the corpus. They are kept as two tables of 2**23 counters each, so that
what is broadcast has a fixed size (16 MB) at any scale; what a counter holds on average is taken off what it
says, so a full table says nothing rather than something wrong. How the probability of a misreading is
shared among the confusions is estimated from the corpus: every word that misreadings explain counts for the
confusion that explains it best, against how often what is printed could have been misread so.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import few_tasks, materialize

BITS = 23
CELLS = 1 << BITS
SLICE = 1 << 18
#: What is read for what is printed; the share of each is estimated from the corpus.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"),
    ("ä", "a"), ("a", "ä"), ("á", "a"), ("à", "a"), ("ö", "o"), ("ü", "u"), ("u", "ü"), ("o", "ö"), ("q", "g"), ("g", "q"), ("v", "y"), ("y", "v"), ("b", "h"), ("h", "b"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("vv", "w"), ("w", "vv"), ("nn", "m"),
    ("m", "nn"), ("in", "m"), ("n", "u"), ("u", "n"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("2", "z"), ("4", "a"), ("3", "e"), ("j", "i"), ("é", "e"), ("è", "é"), ("|", "l"), ("€", "e"), ("ß", "b"), ("b", "ß"),
]
_BY_READ: dict[str, list[str]] = {}
_KINDS = frozenset(CONFUSIONS)
for _read, _printed in CONFUSIONS:
    _BY_READ.setdefault(_read, []).append(_printed)
#: Mean probability that a word is misread by one given confusion, and the largest share of a word's
#: occurrences that one misreading of it can take, as a multiple of its probability.
P_CONFUSION, OFTEN = 0.004, 7.5
#: A confusion's share of the mean probability lies within this factor; what stands for it before any is seen.
WITHIN, PRIOR = 8.0, 20.0
#: Confusions in one word that has figures among its letters; others have one.
MOST_CONFUSIONS = 2
#: Occurrences after which the word before is half as good a guide as can be.
TRUST = 50.0
#: The count that a word not known otherwise has; of words under SHORT letters, so many times more for each letter
#: less, as short words come about by themselves.
NEW, SHORT, SHORTER = 0.014, 6, 12.0

WORD = re.compile(r"[^\W_]+")
#: Words, and entities, which are none.
_WORDS = re.compile(r"&[^\W_]+;|[^\W_]+")
HYPHENS = "-­‐‑¬"
_CUT = re.compile(rf"([^\W\d_]+)[{HYPHENS}][ \t]*$")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_BREAK = re.compile(rf"[{HYPHENS}][ \t]*\n\s*")
_FIRST = re.compile(r"\s*[^\W\d_]+")
_NEXT = re.compile(r"[ \t]*([^\W\d_]+)")
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "j": "l", "5": "s", "6": "b", "8": "b", "h": "b", "e": "c", "é": "c", "t": "f", "ä": "a", "á": "a", "à": "a", "ö": "o", "ü": "u", "q": "g", "9": "g", "y": "v"})
_ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_OWN = re.compile(r"^([^\w\n]*)(page|seite|página|pagina|p\.|s\.|pág\.)?\s*(\d{1,4}|[ivxl]{1,7}|[\dlIOoS]{1,4})(\s*(?:/|of|von|de|sur)\s*\d{1,4})?([^\w\n]*)$", re.I)
_TAIL = re.compile(r"^(.*\S)(?:\s*[|·•–—]\s*|\t+| {2,})(?:(?:p|s|pág)\.\s*|page\s*|seite\s*)?(\d{1,4}|[ivxl]{1,7})\W*$", re.I)
_HEAD = re.compile(r"^(?:(?:p|s)\.\s*|page\s*|seite\s*)?(\d{1,4}|[ivxl]{1,7})(?:\s*[|·•–—]\s*|\t+| {2,})(\S.*)$", re.I)


# --- corpus counts ------------------------------------------------------------------------------


_M = (1 << 64) - 1
_K1, _K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = _hash(word)
        return h


def _cells(h: int, n: int) -> list[int]:
    """The first n counters of a hash, of three."""
    return [h >> (64 - BITS), (h >> 12) & (CELLS - 1), ((h * _K1) & _M) >> (64 - BITS)][:n]


def _pair_hash(a: int, b: int) -> int:
    return ((a * _K1 & _M) ^ (b * _K2 & _M)) * _K1 & _M


#: Counters of a word and of a pair of words; the least of them counts.
WORD_HASHES, PAIR_HASHES = 3, 2


def _add_hashes(table: np.ndarray, h: np.ndarray, n: int) -> None:
    k = np.uint64(_K1)
    for at in (h >> np.uint64(64 - BITS), (h >> np.uint64(12)) & np.uint64(CELLS - 1), (h * k) >> np.uint64(64 - BITS))[:n]:
        np.add.at(table, at.astype(np.int64), np.uint32(1))


def page_words(text: str) -> list[str]:
    found = _WORDS.findall(text.lower())
    return [w for w in found if w[0] != "&"] if "&" in text else found


def _word_before(text: str, end: int, least: int) -> int:
    """Where the letters that end at `end` begin."""
    while end > least and text[end - 1].isalpha():
        end -= 1
    return end


def _unbroken(page: str) -> str:
    """A page without the halves of words cut at line ends."""
    out, at = [], 0
    for m in _BREAK.finditer(page):
        left = _word_before(page, m.start(), at)
        right = _FIRST.match(page, m.end())
        if left < m.start() and right:
            out.append(page[at:left])
            at = right.end()
    out.append(page[at:])
    text = "\n".join(out).strip()
    if text and text[-1] in HYPHENS:
        text = text[: _word_before(text, len(text) - 1, 0)] if text[-2:-1].isalpha() else text
    first = _FIRST.match(text)
    return text[first.end() :] if first else text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two = np.zeros(CELLS, np.uint32), np.zeros(CELLS, np.uint32)
    hashes = _Hashes()
    get = hashes.__getitem__
    seen = False
    words: Counter = Counter()
    for batch in batches:
        seen = True
        flat: list[int] = []
        extra: list[int] = []
        for pages in batch.column("pages").to_pylist():
            for page in pages or ():
                if page:
                    found = page_words(_unbroken(page))
                    words.update(found)
                    flat += map(get, found)
                    flat.append(0)  # no pair over a page end
                    if "-" in page:
                        extra += map(get, (x.lower() for x in _COMPOUND.findall(page)))
        h = np.array(flat, np.uint64)
        with np.errstate(over="ignore"):
            a, b = h[:-1], h[1:]
            both = (a != 0) & (b != 0)
            pairs = ((a[both] * np.uint64(_K1)) ^ (b[both] * np.uint64(_K2))) * np.uint64(_K1)
            _add_hashes(one, np.concatenate([h[h != 0], np.array(extra, np.uint64)]), WORD_HASHES)
            _add_hashes(two, pairs, PAIR_HASHES)
        if len(words) > 200_000:
            yield _word_rows(words)
            words.clear()
    if seen:
        yield _word_rows(words)
        parts = [(t, i, zlib.compress(table[i * SLICE : (i + 1) * SLICE].tobytes(), 1)) for t, table in enumerate((one, two)) for i in range(CELLS // SLICE)]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], names=_COUNTED)


_COUNTED = ["word", "n", "kind", "part", "counts"]


def _word_rows(words: Counter) -> pa.RecordBatch:
    none = pa.nulls(len(words))
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=_COUNTED)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.float64)
    for x in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    level = np.where(total < 128, total, np.minimum(255, 128 + np.round(4 * np.log2(np.maximum(total, 1) / 128)))).astype(np.uint8)
    return pd.DataFrame({"kind": [int(pdf["kind"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "counts": [level.tobytes()], "total": [float(total.sum())]})


class Tables(NamedTuple):
    words: bytes
    pairs: bytes
    total: float
    noise: tuple[float, float]  # what a counter of either table holds on average
    shares: dict[tuple[str, str], float]  # probability of (read, printed)


def corpus_tables(pages: DataFrame) -> Tables:
    """Word and word pair counts over all rows of pages (``pages ARRAY<STRING>``), and the probabilities of the
    confusions. What comes to the driver has a fixed size."""
    counted = materialize(few_tasks(pages).mapInArrow(_count, "word string, n long, kind int, part int, counts binary"), "ocr-counts")
    tables, totals = [bytearray(CELLS), bytearray(CELLS)], [0.0, 0.0]
    summed = counted.where("kind is not null").select("kind", "part", "counts").groupBy("kind", "part").applyInPandas(_add, "kind int, part int, counts binary, total double")
    for row in summed.toLocalIterator():
        tables[row["kind"]][row["part"] * SLICE : (row["part"] + 1) * SLICE] = row["counts"]
        totals[row["kind"]] += row["total"]
    made = Tables(bytes(tables[0]), bytes(tables[1]), max(1.0, totals[0] / WORD_HASHES), (totals[0] / CELLS, totals[1] / CELLS), {})
    words = counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    sent = pages.sparkSession.sparkContext.broadcast(made)
    seen = words.mapInArrow(_explain(sent), "read string, printed string, hits double, chances double").groupBy("read", "printed").agg(F.sum("hits").alias("hits"), F.sum("chances").alias("chances"))
    return made._replace(shares=shares_of({(r["read"], r["printed"]): (r["hits"], r["chances"]) for r in seen.collect()}))


def shares_of(seen: dict[tuple[str, str], tuple[float, float]]) -> dict[tuple[str, str], float]:
    """Probabilities of the confusions from (misreadings, chances) of each; their mean is P_CONFUSION."""
    hits, chances = (sum(x[i] for x in seen.values()) for i in (0, 1))
    if not hits or not chances:
        return {}
    mean = hits / chances
    rate = {k: min(WITHIN, max(1 / WITHIN, (h + PRIOR) / (c * mean + PRIOR))) for k, (h, c) in seen.items()}
    return {k: P_CONFUSION * r for k, r in rate.items()}


def _explain(tables_b):
    """Of each confusion: occurrences of words that it explains best, and places where it could have happened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus(tables_b.value)
        hits: Counter = Counter()
        chances: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for kind in CONFUSIONS:
                    if kind[1] in word:
                        chances[kind] += n * word.count(kind[1])
                if len(word) > 1 and not word.isdigit():
                    best = max(((corpus.count(v), kind) for v, kind in one_confusion(word)), default=(0.0, None))
                    if best[0] > n and OFTEN * P_CONFUSION * best[0] >= n - 1:
                        hits[best[1]] += n * P_CONFUSION * best[0] / (P_CONFUSION * best[0] + new_count(word))
        kinds = sorted(set(hits) | set(chances))
        columns = [pa.array([k[0] for k in kinds], pa.string()), pa.array([k[1] for k in kinds], pa.string()), pa.array([float(hits[k]) for k in kinds]), pa.array([float(chances[k]) for k in kinds])]
        yield pa.RecordBatch.from_arrays(columns, names=["read", "printed", "hits", "chances"])

    return run


def new_count(word: str) -> float:
    return NEW * SHORTER ** max(0, SHORT - len(word))


def one_confusion(word: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """The words that one confusion could have turned into this one, with the confusion."""
    for i in range(len(word)):
        for size in (1, 2):
            read = word[i : i + size]
            if len(read) == size:
                for printed in _BY_READ.get(read, ()):
                    yield word[:i] + printed + word[i + size :], (read, printed)


class Corpus:
    """Likelihoods from the tables, with candidate words for each word."""

    def __init__(self, tables: Tables) -> None:
        self.words, self.pairs, self.total, self.noise, self.shares = tables
        self.known: dict[str, float] = {}
        self.options: dict[str, list[tuple[str, float, float]]] = {}
        self.right: set[str] = set()  # words without another candidate
        self.unproven: set[str] = set()  # words of whose count nothing is left that misreadings don't explain

    def all_right(self, text: str) -> bool:
        """Whether no word of a text has another candidate."""
        if "\ufffd" in text:
            return False
        new = set(page_words(text)) - self.right
        wrong = {w for w in new if len(self.candidates(w)) > 1}
        if len(self.right) > 500_000:
            self.right.clear()
        self.right |= new - wrong
        return not wrong

    def count(self, word: str) -> float:
        c = self.known.get(word)
        if c is None:
            if len(self.known) > 500_000:
                self.known.clear()
            level = min([self.words[i] for i in _cells(_hash(word), WORD_HASHES)])
            c = self.known[word] = self._above(level, self.noise[0])
        return c

    @staticmethod
    def _above(level: int, noise: float) -> float:
        """What a counter says, less what it holds on average, where that is a count at all."""
        c = float(level) if level < 128 else 128 * 2 ** ((level - 128) / 4)
        return c if noise < 1 else max(0.0, c - noise)

    def pair(self, a: str, b: str) -> float:
        level = min([self.pairs[i] for i in _cells(_pair_hash(_hash(a), _hash(b)), PAIR_HASHES)])
        return self._above(level, self.noise[1])

    def candidates(self, word: str) -> list[tuple[str, float, float]]:
        """(printed word, its count, log probability of the confusions), the word itself first; only
        itself if nothing explains it."""
        found = self.options.get(word)
        if found is not None:
            return found
        if len(self.options) > 200_000:
            self.options.clear()
            self.unproven.clear()
        own = self.count(word)
        result = [(word, own, 0.0)]
        if len(word) > 1 and not word.isdigit():
            p = lambda kind: self.shares.get(kind, P_CONFUSION)
            near = {word: 1.0}  # probability of the confusions
            back = {}  # how often the word can have been misread as another
            edge = [word]
            for _ in range(MOST_CONFUSIONS if any(c.isdigit() for c in word) else 1):
                nxt = []
                for w in edge:
                    for v, kind in one_confusion(w):
                        if v not in near:
                            near[v] = near[w] * p(kind)
                            nxt.append(v)
                            if w == word and kind[::-1] in _KINDS:
                                back[v] = OFTEN * p(kind[::-1]) * own
                edge = nxt
            explained = 0.0
            for v, chance in near.items():
                if v != word and (c := self.count(v) - back.get(v, 0.0)) > 0 and not any(x.isdigit() for x in v):
                    result.append((v, c, math.log(chance)))
                    explained = max(explained, OFTEN * chance * c)
            left = max(0.0, own - 1 - explained)
            if left < 1:
                self.unproven.add(word)
            result[0] = (word, left + new_count(word), 0.0)
            self._thin(result)
        self.options[word] = result
        return result

    def _thin(self, options: list[tuple[str, float, float]]) -> None:
        """Drop what no context can make the likeliest: what it has at best stays under what the word itself has
        at least."""
        own = math.log(self._word(options[0][1]) / 2)
        options[1:] = [x for x in options[1:] if x[2] + math.log(self._word(x[1]) + x[1] / (x[1] + TRUST)) > own]

    def _word(self, count: float) -> float:
        return count / self.total + 1e-12

    def log_likelihood(self, before: str | None, word: str, count: float, seen: bool) -> float:
        """Of a word after another one. The word before tells as much as it is known itself; what stands on the
        page (seen) is no evidence for itself."""
        p = self._word(count)
        if before is not None and (c := self.count(before) - seen) > 0:
            pair = 0.0 if seen and word in self.unproven else self.pair(before, word) - seen
            trust = c / (c + TRUST)
            p = max((1 - trust) * p, p / 2) + trust * min(1.0, max(0.0, pair) / c)
        return math.log(p)

    def decode(self, words: list[str]) -> list[str]:
        """The likeliest printed words of a line, by Viterbi."""
        layers = [self.candidates(w) for w in words]
        if all(len(x) == 1 for x in layers):
            return words
        score = [[ch + self.log_likelihood(None, v, c, False) for v, c, ch in layers[0]]]
        back: list[list[int]] = [[-1] * len(layers[0])]
        for prev, cur in zip(layers, layers[1:]):
            row, ptr = [], []
            if len(cur) == 1 and len(prev) == 1:  # nothing to choose
                row, ptr = [score[-1][0]], [0]
            else:
                for n, (v, c, ch) in enumerate(cur):
                    best, arg = max((s + self.log_likelihood(p[0], v, c, not n and not i), -i) for i, (s, p) in enumerate(zip(score[-1], prev)))
                    row.append(best + ch)
                    ptr.append(-arg)
            score.append(row)
            back.append(ptr)
        at = max(range(len(score[-1])), key=lambda i: (score[-1][i], -i))
        out = []
        for i in range(len(words) - 1, -1, -1):
            out.append(layers[i][at][0])
            at = back[i][at]
        return out[::-1]


# --- page structure -----------------------------------------------------------------------------


def _roman(s: str) -> int | None:
    s = s.lower()
    if not s or not _ROMAN.fullmatch(s):
        return None
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    return sum(-values[a] if i + 1 < len(s) and values[s[i + 1]] > values[a] else values[a] for i, a in enumerate(s))


def _value(s: str) -> int | None:
    return int(s) if s.isdigit() else _roman(s)


def _number(line: str) -> tuple[str, int | None, bool] | None:
    """(rest of the line, value, whether the form alone tells a page number), or None without a number."""
    line = line.strip()
    if m := _OWN.match(line):
        marked = bool(m[2] or m[4] or (m[1].strip() and m[5].strip()) or "|" in m[1] + m[5])
        value = _value(m[3])
        if value is None and not marked:
            return None
        return "", value, marked
    if (m := _TAIL.match(line)) and len(m[1]) >= 4 and _value(m[2]) is not None:
        return m[1], _value(m[2]), False
    if (m := _HEAD.match(line)) and len(m[2]) >= 4 and _value(m[1]) is not None:
        return m[2], _value(m[1]), False
    return None


def _fold(line: str) -> str:
    s = "".join(WORD.findall(line.lower()))
    for a, b in (("rn", "m"), ("ri", "n"), ("nn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        s = s.replace(a, b)
    return s.translate(_FOLD)


def _is_bare(lines: list[str], i: int) -> bool:
    """Whether a number stands alone as the first or last line, and not in a list of labels and values."""
    full = [j for j, x in enumerate(lines) if x.strip()]
    if i not in (full[0], full[-1]) or not re.fullmatch(r"\d{1,4}|[ivxl]+", lines[i].strip(), re.I):
        return False
    if len(full) == 1:
        return True
    beside = lines[full[1] if i == full[0] else full[-2]].strip()
    return len(beside.split()) > 3 or beside[-1:] in ".;:,!?" + HYPHENS


class Page(NamedTuple):
    lines: list[str]
    running: set[int]
    numbers: set[int]


def page_structure(pages: list[str | None], unpaged: bool = False) -> list[Page]:
    """Running lines and page numbers of each page of a record.

    If unpaged, pages are the blocks between the blank lines of a text whose page ends are not known. Page
    ends are among its blank lines, so running lines are found as on pages. Numbers count on in order of
    place instead of page by page, and one that does not count is bare only at the ends of the text.

    Two lines at either end are looked at, and as many more as stand behind running lines and page numbers only.
    """
    cut = [(p or "").split("\n") for p in pages]
    full = [[i for i, x in enumerate(lines) if x.strip()] for lines in cut]
    depth = 2
    while True:
        out = _structure(cut, full, depth, unpaged)
        gone = [p.running | p.numbers for p in out]
        if not any(len(f) > 2 * depth and (all(i in g for i in f[:depth]) or all(i in g for i in f[-depth:])) for f, g in zip(full, gone)):
            return out
        depth += 1


def _structure(cut: list[list[str]], full: list[list[int]], depth: int, unpaged: bool) -> list[Page]:
    edges: list[list[tuple[int, str]]] = []
    for lines in full:
        top = lines[:depth]
        edges.append([(i, "top") for i in top] + [(i, "foot") for i in lines[-depth:] if i not in top])
    seen: dict[str, set[int]] = {}
    numbered: dict[tuple[int, int], tuple[str, int | None, bool]] = {}
    for k, (lines, edge) in enumerate(zip(cut, edges)):
        for i, where in edge:
            found = _number(lines[i])
            if found:
                numbered[k, i] = found
            rest = found[0] if found else lines[i]
            key = _fold(rest)
            if len(key) >= 4:
                seen.setdefault(where + key, set()).add(k)
    often = {key for key, at in seen.items() if len(at) >= 3}
    steps: Counter = Counter()
    placed: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for (k, i), (rest, value, _) in numbered.items():
        if value is not None:
            steps[value - k] += 1
            placed.setdefault((_fold(rest), value), []).append((k, i))

    def counts_on(k: int, i: int, rest: str, value: int | None) -> bool:
        if value is None or not unpaged:
            return value is not None and steps[value - k] >= 2
        key = _fold(rest)
        return any(at < (k, i) for at in placed.get((key, value - 1), ())) or any(at > (k, i) for at in placed.get((key, value + 1), ()))

    out = []
    for k, (lines, edge) in enumerate(zip(cut, edges)):
        running, numbers = set(), set()
        for i, where in edge:
            found = numbered.get((k, i))
            rest = found[0] if found else lines[i]
            key = _fold(rest)
            is_running = len(key) >= 4 and where + key in often
            if not is_running and found:  # with a figure that is no page number
                is_running = len(_fold(lines[i])) >= 4 and where + _fold(lines[i]) in often
            if is_running:
                running.add(i)
            if found:
                _, value, marked = found
                own = not found[0]
                counted = counts_on(k, i, found[0], value)
                bare = own and value is not None and _is_bare(lines, i) and (not unpaged or (k == 0 and where == "top") or (k == len(cut) - 1 and i == edge[-1][0]))
                if (own and (marked or counted or bare)) or (not own and (counted or is_running) and value is not None):
                    numbers.add(i)
        out.append(Page(lines, running, numbers))
    return out


class Found(NamedTuple):
    kinds: set[str]
    paragraphs: list[str]


_BLANK = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")


def repair_text(text: str, corpus: Corpus) -> Found:
    """The same of a text whose pages are not known, as a whole."""
    found = repair_record(_BLANK.split(text), corpus, unpaged=True)
    return Found(set().union(*(f.kinds for f in found)), [p for f in found for p in f.paragraphs])


def repair_record(pages: list[str | None], corpus: Corpus, unpaged: bool = False) -> list[Found]:
    """Of each page of a record the kinds of noise on it and its repaired paragraphs."""
    struct = page_structure(pages, unpaged)
    kinds: list[set[str]] = [set() for _ in pages]
    body: list[list[str]] = []
    for k, page in enumerate(struct):
        if page.running:
            kinds[k].add("running")
        if page.numbers:
            kinds[k].add("page_number")
        drop = page.running | page.numbers
        body.append([x for i, x in enumerate(page.lines) if i not in drop])
    # words cut at line ends, also over the page end
    flat = [(k, i) for k, lines in enumerate(body) for i, x in enumerate(lines) if x.strip()]
    for (k, i), (k2, j) in zip(flat, flat[1:]):
        line, after = body[k][i], body[k2][j]
        if line.rstrip()[-1:] not in HYPHENS:
            continue
        m = _CUT.search(line)
        if not m or (k2 == k and j - i > 1 and any(not x.strip() for x in body[k][i + 1 : j])):
            continue
        n = _NEXT.match(after)
        if not n or not n[1][0].islower():
            continue
        a, b = m[1].lower(), n[1].lower()
        first = line[: m.start(1)]
        if first.endswith("-") or after[n.end() : n.end() + 1] in HYPHENS and after[n.end() : n.end() + 1]:
            # part of a longer compound
            tail = re.match(rf"[ \t]*([^\W\d_]+(?:-[^\W\d_]+)*)", after)[1].lower()
            lead = re.search(r"((?:[^\W\d_]+-)*)$", first)[1].lower()
            joined, compound = corpus.count(lead + a + tail), corpus.count(f"{lead}{a}-{tail}")
        else:
            joined, compound = corpus.count(a + b), corpus.count(f"{a}-{b}")
        if joined == 0 and compound == 0:
            # neither is known: two whole words make a compound
            compound = min(corpus.count(a), corpus.count(b)) >= 20 and line[m.end(1)] == "-"
        if compound > joined:
            body[k][i] = line[: m.end(1)] + "-" + after[n.start(1) : n.end(1)]
        else:
            kinds[k].add("hyphenated")
            body[k][i] = line[: m.end(1)] + after[n.start(1) : n.end(1)]
        rest = after[n.end(1) :]
        stop = re.match(r"\S*", rest).end()
        body[k][i] += rest[:stop]
        body[k2][j] = rest[stop:].lstrip() if rest[stop:].strip() else ""
    for k, lines in enumerate(body):
        if corpus.all_right("\n".join(lines)) and corpus.all_right("\n".join(struct[k].lines[i] for i in struct[k].running)):
            continue
        for i in range(len(lines)):
            fixed = _fix_line(lines[i], corpus)
            if fixed is not None:
                kinds[k].add("misread")
                lines[i] = fixed
        for i in struct[k].running:
            if _fix_line(struct[k].lines[i], corpus) is not None:
                kinds[k].add("misread")
    out = []
    for k, lines in enumerate(body):
        paragraphs, current = [], []
        for x in [*lines, ""]:
            if x.strip():
                current.append(x.strip())
            elif current:
                paragraphs.append(" ".join(current))
                current = []
        out.append(Found(kinds[k], paragraphs))
    return out


_LOST = re.compile(r"[^\W_\ufffd]*\ufffd[^\W_\ufffd]*(?:\ufffd[^\W_\ufffd]*)*")
_LETTERS = "aeiouáéíóúàèìòùâêîôûäëïöüñçßlrnstdcmpgbvfhyqzjkxw"


def _lost(m: re.Match, corpus: Corpus) -> str:
    """A word with one unreadable character: the likeliest letter for it."""
    word = m[0]
    if len(word) < 2 or word.count("\ufffd") != 1:
        return word
    best = max((corpus.count(word.lower().replace("\ufffd", c)), -i, c) for i, c in enumerate(_LETTERS))
    return word.replace("\ufffd", best[2]) if best[0] > 0 else word


def _fix_line(line: str, corpus: Corpus) -> str | None:
    """The line with misread words put right, or None if there are none."""
    if "\ufffd" in line and any(len(m[0]) > m[0].count("\ufffd") for m in _LOST.finditer(line)):
        line = _LOST.sub(lambda m: _lost(m, corpus), line)
        again = _fix_line(line.replace("\ufffd", ""), corpus) if "\ufffd" in line else _fix_line(line, corpus)
        return again if again is not None else line
    spans = [m.span() for m in _WORDS.finditer(line) if line[m.start()] != "&"]
    if not spans:
        return None
    words = [line[s:e].lower() for s, e in spans]
    options = corpus.options
    if all(len(options.get(w) or corpus.candidates(w)) == 1 for w in words):
        return None
    right = corpus.decode(words)
    if right == words:
        return None
    out, at = [], 0
    for (s, e), w, r in zip(spans, words, right):
        out.append(line[at:s])
        old = line[s:e]
        out.append(old if w == r else (r.capitalize() if old[:1].isupper() or (s == 0 and old[:1].isdigit()) else r))
        at = e
    return "".join(out) + line[at:]


def _repair(tables_b, kinds_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus(tables_b.value)
        for batch in batches:
            ids, nos, noise, texts = [], [], [], []
            for rid, pages, text in zip(batch.column("id").to_pylist(), batch.column("pages").to_pylist(), batch.column("text").to_pylist()):
                for no, found in [(None, repair_text(text, corpus))] if text is not None else enumerate(repair_record(pages, corpus), 1):
                    if kinds_only and not found.kinds:
                        continue
                    ids.append(rid)
                    nos.append(no)
                    noise.append(sorted(found.kinds))
                    texts.append(None if kinds_only else found.paragraphs)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(nos, pa.int32()), pa.array(noise, strings), pa.array(texts, strings)], names=["id", "page_no", "noise", "paragraphs"])

    return run


def repair_pages(df: DataFrame, id_col: str = "ocr_id", pages_col: str = "page_markdowns", kinds_only: bool = False, text_col: str | None = None) -> DataFrame:
    """``id``, ``page_no`` (from 1), ``noise`` (kinds found) and ``paragraphs`` (repaired) of every page.

    A row with null or no pages gives its text_col as one page without a number (page_no null), or nothing
    where that is null or not named; a null or empty page gives a page without noise and without
    paragraphs. With kinds_only, pages without noise are left out and paragraphs are null. Repeated rows
    come out each. The id can be null. Other columns are not read. The corpus that words are judged by
    is df itself, all that is read of it; an empty df gives an empty result.
    """
    paged = F.coalesce(F.size("pages") > 0, F.lit(False))
    text = (F.lit(None) if text_col is None else F.col(text_col)).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(pages_col).cast("array<string>").alias("pages"), text.alias("text"))
    rows = rows.withColumn("text", F.when(~paged, F.col("text"))).where(paged | F.col("text").isNotNull())
    tables = df.sparkSession.sparkContext.broadcast(corpus_tables(rows.select(F.when(paged, F.col("pages")).otherwise(F.array("text")).alias("pages"))))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_repair(tables, kinds_only), f"id {kind}, page_no int, noise array<string>, paragraphs array<string>")
