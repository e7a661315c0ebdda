"""Keyword-stuffed and link-list pages.

Each page's suffix automaton is built over its words, whole text. Adding a word yields, as the length
of the suffix link, the longest run of words ending there that stood on the page before: the repeated
maximal substrings. Of a page are measured

* ``coverage``, the share of its characters that lie in such runs, those without a content word left out;
* ``missing``, the share that stands outside clause structure: segments that are neither clauses (some
  words, among them function words, whose content words hardly repeat) nor entries of a bibliography, a
  contents list or a table;
* ``links``, the share of addresses.

A logistic model over the three and the product of the first two tells spam from genuine pages. It is
fitted on the labelled table that labelled_pages() writes out: 2 x ``LABELLED`` pages of known kind,
among them spam in whole sentences (nothing missing, much covered) and lists of entries that never repeat
(all missing, nothing covered), so neither measure decides alone.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words by language; fixed values.
FUNCTION_WORDS = frozenset(
    """
    the of a an and to in is was were by for with that this it its as at from but or what than under when if
    because while we our no any which only most neither nor more be been has had have not on into who whom whose
    these those such their there them they he she his her you your without whether between both each several
    until after before during against among about over then also may might can could should would will must do
    does did so where why how all some one two less later according across through
    le la les de des du un une et est sont en dans que qui pour par avec ce cette ces a ont plus ne pas il elle ils
    elles on sur au aux se sa son ses leur leurs mais ou donc sans entre quand selon aucun été être fait avant après
    der die das und ist war wird wurde wurden in zu von mit für auf dem den des ein eine einen einem einer eines nicht
    als auch sich es an aus bei nach vor über unter zwischen ohne weil wer wie dass doch noch nur oder aber hat haben
    sind waren werden worden im am zum zur gilt lässt liegt erst lagen dort findet viele nie kaum meist
    el los las y del al por con para su sus ha han fue era es son como no sin más pero si o le lo entre según ningún
    cuando antes hay bien este esta estos estas queda quedan e u luego sobre desde hasta
    """.split()
)

#: Prepositions that also join the words of a name of a thing, so they make no clause; fixed values.
JOINING = frozenset("de d del du des of et und and y e u a".split())
CLAUSE_WORDS = FUNCTION_WORDS - JOINING

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?;]\s+")
#: In lines with a bracket: entries of a bibliography, by a year in brackets or volume(issue), page.
REFERENCE = re.compile(r"\((?:1[5-9]|20)\d\d[a-z]?\)|\d ?\(\d+\), ?\d")
#: Least share of different words among the content words of a clause, as the ratio of their logarithms,
#: which does not depend on the length of the segment.
VARIETY = 0.93


def repeated_runs(words: list[str]) -> list[int]:
    """For each word the length of the longest run ending with it that ended before, by an online suffix automaton."""
    nexts: list[dict] = [{}]
    link, length = [-1], [0]
    last, out = 0, []
    for c in words:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        p = last
        while p != -1:
            t = nexts[p]
            if c in t:
                break
            t[c] = cur
            p = link[p]
        if p == -1:
            link.append(0)
            out.append(0)
        else:
            q = t[c]
            lp = length[p] + 1
            if lp != length[q]:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(lp)
                link.append(clone)  # of cur
                link.append(link[q])  # of clone
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = clone
            else:
                link.append(q)
            out.append(lp)
        last = cur
    return out


def covered(words: list[str], spans: list[tuple[int, int]]) -> int:
    """Characters in repeated runs with a content word; spans are the places of the words in the text."""
    content, n = [0], 0
    for w in words:
        n += w not in FUNCTION_WORDS and len(w) > 1 and not w.isdigit()
        content.append(n)
    total = upto = 0
    for i, run in enumerate(repeated_runs(words)):
        if run and content[i + 1] > content[i + 1 - run]:
            begin, end = max(spans[i + 1 - run][0], upto), spans[i][1]
            if end > begin:
                total += end - begin
                upto = end
    return total


def _is_entry(line: str) -> bool:
    """Whether a line is an entry of a bibliography, a contents list or a table."""
    return "\t" in line or "....." in line or line.startswith("|") or ("(" in line and REFERENCE.search(line) is not None)


def is_clause(segment: str, words: list[str]) -> bool:
    """Whether a segment has the structure of a clause: four words or more, one in ten or more of them words
    that make clauses, content words that hardly repeat, and no address at its end."""
    if len(words) < 4 or sum(w in CLAUSE_WORDS for w in words) < 0.1 * len(words):
        return False
    content = [w for w in words if w not in FUNCTION_WORDS]
    n = len(content)
    if n > 1 and math.log(len(set(content))) < VARIETY * math.log(n):
        return False
    return "://" not in segment or ("www." not in segment and "://" not in segment.rsplit(None, 1)[-1])


def page_features(text: str | None) -> tuple[int, float, float, float]:
    """(words, coverage, missing, links) of a page; zeros without words."""
    if not text:
        return 0, 0.0, 0.0, 0.0
    lower = text.lower()
    if len(lower) != len(text):  # some capitals have longer small letters
        text = lower
    spans = [m.span() for m in WORD.finditer(lower)]
    if not spans:
        return 0, 0.0, 0.0, 0.0
    links = 0
    if "://" in text or "www." in text:
        links = sum(len(t) for t in text.split() if "://" in t or t.startswith("www."))
    total = missing = 0
    for line in text.split("\n"):
        if _is_entry(line):
            total += len(line)
            continue
        for segment in SENTENCE.split(line):
            found = WORD.findall(segment.lower())
            if found:
                total += len(segment)
                if not is_clause(segment, found):
                    missing += len(segment)
    coverage = covered([lower[a:b] for a, b in spans], spans) / (spans[-1][1] - spans[0][0])
    return len(spans), coverage, missing / max(1, total), links / len(text)


# --- the labelled table -------------------------------------------------------------------------

#: Labelled pages of each side; the bound of the table the model is fitted on.
LABELLED = 180
_THINGS = "lamp chair kettle carpet bicycle mattress printer blender suitcase helmet curtain heater toaster camera keyboard wardrobe tyre shampoo perfume watch".split()
_TRAITS = "cheap best discount quality original new used luxury budget top online fast premium local safe".split()
_TOWNS = "Northby Southby Westby Eastby Midby Upperby Lowerby Outerby Innerby Farby".split()
_SUBJECTS = "committee survey archive ministry council author laboratory commission observatory library tribunal association inspector registry cooperative".split()
_DEEDS = "published examined revised rejected measured summarised compared collected discussed questioned described confirmed postponed corrected financed".split()
_OBJECTS = "findings budget method sample harvest statute forecast catalogue timetable agreement dataset experiment manuscript inventory appeal corridor dialect glacier orchard tariff".split()
_TAILS = ["in the spring of that year", "because no other record was kept", "although its members disagreed", "before the second meeting", "when the northern route was closed", "without naming a source", "as it had been asked to", "but left the last part open", "so that others could repeat it", "while the older rules were still in force", "for the first time since the war", "which surprised those who had read it"]
_LAST = "Alder Birch Cedar Dogwood Elm Fir Gorse Hazel Ivy Juniper Larch Maple Oak Pine Rowan Spruce Teak Willow".split()


def labelled_pages() -> list[tuple[str, int]]:
    """(text, 1 for spam) pages written out by rules from the word lists above, always the same."""
    rng = random.Random(20)
    pick = rng.choice

    def sentence() -> str:
        return f"The {pick(_SUBJECTS)} {pick(_DEEDS)} the {pick(_OBJECTS)} and its {pick(_OBJECTS)} {pick(_TAILS)}."

    def prose(n: int) -> str:
        return " ".join(sentence() for _ in range(n))

    def code() -> str:
        return "".join(pick("bcdfghklmnprstvz") + pick("aeiou") for _ in range(rng.randrange(2, 6)))

    def spam() -> str:
        thing, other, town = pick(_THINGS), pick(_THINGS), pick(_TOWNS)
        n = rng.randrange(12, 60)
        kind = rng.randrange(8)
        if kind == 0:  # keywords
            return " ".join(f"{pick(_TRAITS)} {pick((thing, other))} {town}" for _ in range(n))
        if kind == 1:  # tags
            return " ".join(f"#{pick(_TRAITS)}{pick(_THINGS)}" for _ in range(n))
        if kind == 2:  # links
            return "\n".join(f"https://{code()}.example/{code()}/{code()}" for _ in range(n))
        if kind == 3:  # products
            return "\n".join(f"{pick(_TRAITS)} {pick(_THINGS)} {rng.randrange(9, 99)},{rng.randrange(10, 99)} EUR" for _ in range(n))
        if kind == 4:  # keywords strung into sentences
            forms = (f"Looking for a {thing} in {town}?", f"Our {pick(_TRAITS)} {thing} is the {pick(_TRAITS)} {thing} in {town}.", f"Buy a {thing} from {town} because every {thing} is {pick(_TRAITS)}.", f"We have the {thing} that you need in {town}.")
            return " ".join(pick(forms) for _ in range(n // 2))
        if kind == 5:  # titles with an address each
            return "\n".join(f"{pick(_TRAITS)} {pick(_THINGS)} of {pick(_TOWNS)}: https://{code()}.example/{code()}" for _ in range(n))
        if kind == 6:  # words that never repeat
            return " ".join(f"{code()} {pick(_TRAITS)} {code()}" for _ in range(2 * n))
        # whole clauses, each in order, around the same keywords
        forms = (f"The {thing} that we sell in {town} is {{}}.", f"You will find a {{}} {thing} on this page of {town}.", f"If you need one in {town}, ask us for the {{}} {thing}.", f"Is there a {{}} {thing} and who sells it in {town}?", f"Read why a {thing} of {town} was {{}} for all of us.")
        return " ".join(pick(forms).format(pick(_TRAITS)) for _ in range(n // 2 + 4))

    def genuine() -> str:
        n = rng.randrange(6, 40)
        kind = rng.randrange(8)
        lead = prose(rng.randrange(4, 9)) + "\n"
        if kind == 0:
            return lead + "\n".join(f"[{i}] {pick(_LAST)}, {pick('ABCDE')}. (19{50 + i}). The {pick(_OBJECTS)} of {code()}. Letters, {i}({i}), 1-12." for i in range(n))
        if kind == 1:
            return lead + "\n".join(f"{i}.1 The {pick(_OBJECTS)} of {code()} ........ {3 * i}" for i in range(n))
        if kind == 2:
            return lead + "\n".join(f"{pick(_TOWNS)}\t{rng.randrange(99)}\t{rng.random():.2f}\t{pick(_DEEDS)}" for _ in range(n))
        if kind == 3:  # a glossary
            return lead + "\n".join(f"{code()}: a {pick(_OBJECTS)} that is {pick(_DEEDS)} by the {pick(_SUBJECTS)}." for _ in range(n))
        if kind == 4:  # a rule with a refrain
            refrain = f"The {pick(_SUBJECTS)} shall keep the {pick(_OBJECTS)} for as long as it is needed."
            return " ".join(f"{sentence()} {sentence()} {refrain}" for _ in range(n // 3 + 2))
        if kind == 5:  # indicators after prose
            return prose(n // 2 + 6) + "\n" + "\n".join(f"{code()}.invalid {rng.getrandbits(64):x}" for _ in range(n // 4 + 1))
        return prose(n + 3)

    return [(spam(), 1) for _ in range(LABELLED)] + [(genuine(), 0) for _ in range(LABELLED)]


def _terms(features: np.ndarray) -> np.ndarray:
    """Terms of the model from (coverage, missing, links)."""
    c, m, links = features.T
    return np.column_stack([np.ones(len(c)), c, m, links, c * m])


@lru_cache(4)
def page_model(without: int = -1) -> np.ndarray:
    """Weights of the terms, fitted on labelled_pages() by Newton steps with a small ridge; without: a feature
    (0 coverage, 1 missing, 2 links) that is set to zero, to see what it contributes."""
    rows = labelled_pages()
    x = np.array([page_features(t)[1:] for t, _ in rows])
    if without >= 0:
        x[:, without] = 0
    x, y = _terms(x), np.array([label for _, label in rows], float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.02] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def spam_score(features: np.ndarray, without: int = -1) -> np.ndarray:
    """Probability of spam of rows of (coverage, missing, links)."""
    x = np.array(features, float).reshape(-1, 3)
    if without >= 0:
        x[:, without] = 0
    return 1 / (1 + np.exp(-np.clip(_terms(x) @ page_model(without), -30, 30)))


def _judge(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_features(t) for t in batch.column("text").to_pylist()]
            score = spam_score(np.array([r[1:] for r in rows]))
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), pa.array(score, pa.float64()), pa.array([n > 0 and s >= 0.5 for (n, *_), s in zip(rows, score.tolist())], pa.bool_())],
                names=["id", "words", "coverage", "missing", "links", "score", "spam"],
            )

    return run


def page_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``words``, ``coverage``, ``missing``, ``links``, ``score``, ``spam``: one row per row of df.

    score is the model's probability of spam; pages from one half on are spam. Null texts and texts without
    a word have zeros and are no spam. Repeated rows are judged each; the
    id is not looked at and can be null. Other columns of df are not read. It is one pass without a
    shuffle, so no key can make it skewed; a page is held whole, whatever its length.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_judge(id_col), f"id {kind}, words int, coverage double, missing double, links double, score double, spam boolean")


def spam_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``: the pages that page_quality finds to be spam, each id once."""
    return page_quality(df, id_col, text_col).where("spam").select("id").where("id is not null").distinct()
