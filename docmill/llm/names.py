"""Variant spellings of names of persons, organisations and publications.

* Distinct strings are parsed: case, accents, titles, word order and function words are set aside. A person
  has a surname and given names, anything else a set of words; a string that can be either is read both
  ways, and with transcribed umlauts (ue for ü) both as they stand and as the plain vowel.
* A symmetric-delete index finds tokens within one edit: every token is filed under itself and under
  itself less one character. Persons are filed under their surname and the initial of the given name;
  other names under the initials of their words, which abbreviations keep, and, for an edited initial, under
  all other initials and a form of that word. The keys are the same whatever the number of names.
* Names that meet there are compared by an optimal assignment of their tokens: equal, one edit apart (one in
  the whole name), an abbreviation, an initial in its place, or a nickname. Initials and acronyms agree with
  several names, so they are not links of their own: they join the one group they fit, and stay apart where
  they fit two.

Groups are the connected components of the links; they are found by aggregations only.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.graph import components
from docmill.session import materialize

#: Nicknames and the names they stand for; fixed values.
_NICKNAMES = dict(
    p.split(":")
    for p in """
    alex:alexander sasha:alexander sandy:alexander xander:alexander andy:andrew drew:andrew tony:anthony toni:anthony babs:barbara barb:barbara barbie:barbara
    ben:benjamin charlie:charles chuck:charles chas:charles chris:christopher kit:christopher dan:daniel danny:daniel dave:david davy:david deb:deborah debbie:deborah
    dima:dimitri mitya:dimitri dot:dorothy dottie:dorothy dolly:dorothy ed:edward eddie:edward ned:edward ted:theodore teddy:theodore theo:theodore beth:elizabeth
    betty:elizabeth liz:elizabeth lizzie:elizabeth eliza:elizabeth bess:elizabeth paco:francisco pancho:francisco frank:francisco fred:frederick freddie:frederick
    fritz:frederick beppe:giuseppe peppe:giuseppe pino:giuseppe greg:gregory gus:gustavo tavo:gustavo harry:henry hank:henry hal:henry nacho:ignacio jim:james
    jimmy:james jamie:james hannes:johannes hans:johannes jack:john johnny:john joe:joseph joey:joseph kate:katherine kathy:katherine katie:katherine kitty:katherine
    kathryn:katherine catherine:katherine len:leonard lenny:leonard leo:leonard lottie:lotte maggie:margaret meg:margaret peggy:margaret madge:margaret greta:greta
    matt:matthew mike:michael mick:michael mickey:michael mickie:michael nick:nicholas nicky:nicholas ollie:oliver olly:oliver pat:patricia patty:patricia trish:patricia
    tricia:patricia dick:richard rick:richard rich:richard richie:richard bob:robert rob:robert bobby:robert robbie:robert bert:robert sam:samuel sammy:samuel
    steve:stephen sue:susan susie:susan suzy:susan tom:thomas tommy:thomas uli:ulrike ulli:ulrike vicky:victoria tori:victoria vic:victoria bill:william will:william
    billy:william willy:william liam:william
    """.split()
)
TITLES = frozenset("dr prof professor mr mrs ms sir dame phd md jr sr".split())
PARTICLES = frozenset("von van de der den del della di da la le du zu ter ten vom af av al el bin ibn".split())
#: Words that a name can have or lack.
FILLERS = frozenset("the of f and for in on at to a an de la des du der die das und für fur et y e".split())

#: Names under one key that are compared at once with all others under it.
CELL = 512

_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")


def fold(text: str, vowels: bool = True) -> str:
    """Lower case without accents; with vowels, transcribed umlauts as the plain vowel."""
    s = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ẞ", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l")).lower()
    s = "".join(c for c in s if not unicodedata.combining(c))
    return s.replace("ae", "a").replace("oe", "o").replace("ue", "u") if vowels else s


NICKNAMES = {fold(a, v): fold(b, v) for a, b in _NICKNAMES.items() for v in (False, True)}


class Person(NamedTuple):
    surname: str
    given: tuple[str, ...]

    @property
    def level(self) -> int:
        """0: initials, 1: a given name, 2: with middle names."""
        return 0 if not self.given or len(self.given[0]) == 1 else 2 if len(self.given) > 1 else 1

    @property
    def rank(self) -> int:
        """How much it says: 0 an initial, 1 initials, 2 a given name, 3 given and middle names."""
        return 1 + self.level if self.level else int(len(self.given) > 1)


class Reading(NamedTuple):
    """A name read with one treatment of vowels."""

    persons: tuple[Person, ...]
    words: tuple[str, ...]  # as no person's name
    acronym: str  # letters, sorted, that stand for further words; "" if none


Name = tuple[Reading, ...]


def _join_particles(tokens: list[str]) -> list[str]:
    """Particles before a word become part of it."""
    out: list[str] = []
    held = ""
    for t in tokens:
        if t in PARTICLES:
            held += t
        else:
            out.append(held + t)
            held = ""
    if held:
        out.append(held)
    return out


@lru_cache(50_000)
def parse_name(text: str, can_be_person: bool) -> Name:
    """The readings of a name, one or two."""
    first = _read(text, can_be_person, True)
    second = _read(text, can_be_person, False)
    return (first,) if first == second else (first, second)


def _read(text: str, can_be_person: bool, vowels: bool) -> Reading:
    raw = [t for t in _TOKEN.findall(text) if fold(t) not in TITLES]
    tokens = [re.sub(r"[^\w]", "", fold(t, vowels)) for t in raw]
    caps = [i for i, t in enumerate(raw) if 3 <= len(t) <= 7 and t.isupper() and t.isalpha()]
    others = [i for i in range(len(raw)) if i not in caps]
    acronym = ""
    if len(caps) == 1 and 1 <= len(others) <= 3 and all(len(raw[i]) > 3 and not raw[i].isupper() for i in others) and (not can_be_person or "(" in text or ", " + raw[caps[0]] in text or text.rstrip().endswith(raw[caps[0]]) or len(raw[caps[0]]) <= 4):
        acronym = "".join(sorted(tokens[caps[0]]))
    words = tuple(t for i, t in enumerate(tokens) if t not in FILLERS and not (acronym and i == caps[0]))
    persons: tuple[Person, ...] = ()
    if can_be_person and not acronym and "&" not in text and not any(t in ("of", "the", "for", "and") for t in tokens):
        # a capital alone is an initial, whatever word it could be
        part = lambda s: _join_particles([re.sub(r"[^\w]", "", fold(t, vowels)) for t in _TOKEN.findall(s) if fold(t) not in TITLES and (len(t) == 1 and t.isupper() or fold(t) not in FILLERS or fold(t) in PARTICLES)])
        persons = _persons(text, part)
    if persons and (len(words) < 4 or any(len(w) == 1 for w in words)):
        words = ()  # a name of a person for sure
    return Reading(persons, words, acronym)


def _persons(text: str, part: Callable[[str], list[str]]) -> tuple[Person, ...]:
    """The ways to read a text as a person's name."""
    if text.count(",") == 1:
        a, b = text.split(",")
        surname, given = "".join(part(a)), part(b)
        found = [Person(surname, tuple(given))] if len(surname) > 1 and given else []
    else:
        t = part(text)
        singles = [len(x) == 1 for x in t]
        if "," in text or len(t) < 2 or all(singles):
            return ()
        if singles[-1]:  # Surname G M
            n = len(t) - singles[::-1].index(False)
            found = [Person("".join(t[:n]), tuple(t[n:]))]
        elif len(t) == 2 and not singles[0]:  # either order
            found = [Person(t[1], (t[0],)), Person(t[0], (t[1],))]
        else:  # G M Surname, Given M Surname
            found = [Person(t[-1], tuple(t[:-1]))]
    # the last given name can be the first half of a double surname
    return tuple(found + [Person(p.given[-1] + p.surname, p.given[:-1]) for p in found if len(p.given) > 1 and len(p.given[-1]) > 2])


def deletes(token: str) -> set[str]:
    """A token and all it becomes by one deletion: the symmetric-delete neighbourhood."""
    if len(token) < 4:
        return {token}
    return {token} | {token[:i] + token[i + 1 :] for i in range(len(token))}


def within_one(a: str, b: str) -> bool:
    """Whether two tokens are equal or one insertion, deletion, substitution or transposition apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def abbreviates(short: str, long: str) -> bool:
    """Whether short can be an abbreviation of long: a beginning, or some of its letters in order."""
    if len(short) >= len(long) or not short or short[0] != long[0]:
        return False
    if long.startswith(short):
        return True
    if len(short) < 3 or len(long) < 5:
        return False
    it = iter(long)
    return all(c in it for c in short)


def cheapest(costs: list[list[float | None]]) -> float | None:
    """Least cost of an assignment of all rows to different columns, of which there are as many or more; None
    if there is none. By shortest augmenting paths, so names may have any number of tokens."""
    if not costs:
        return 0.0
    n, m = len(costs), len(costs[0])
    far = 1e6
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, done, way = [math.inf] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while owner[j0]:
            done[j0] = True
            row, delta, j1 = owner[j0], math.inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    c = costs[row - 1][j - 1]
                    c = (far if c is None else c) - u[row] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    total = -v[0]
    return None if total >= far / 2 else total


def assign(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
    """Least cost of an assignment of all tokens of a to those of b; None if there is none.

    Equal tokens cost nothing, an abbreviation 0.01, one edit 1.
    """
    if len(a) != len(b):
        return None
    left, right = list(a), list(b)
    for t in a:  # equal tokens belong together in some optimal assignment
        if t in right:
            left.remove(t)
            right.remove(t)
    return cheapest([[0.01 if abbreviates(x, y) or abbreviates(y, x) else 1.0 if within_one(x, y) else None for y in right] for x in left])


def _formal(given: str) -> str:
    return NICKNAMES.get(given, given)


def _given(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, bool] | None:
    """(cost, whether one side says less) of two lists of given names, or None if they disagree.

    Names are assigned in any order; an initial stands for the name in its place. Where one side has more
    names the first ones belong together.
    """
    if len(a) > len(b):
        a, b = b, a

    def cost(i: int, x: str, j: int, y: str) -> float | None:
        if len(a) != len(b) and (i == 0) != (j == 0):
            return None
        if x == y or _formal(x) == _formal(y):
            return 0.0 if i == j else 0.01 if len(x) > 1 else None
        if len(x) == 1 or len(y) == 1:
            return 0.0 if i == j and {x[0], _formal(x)[0]} & {y[0], _formal(y)[0]} else None
        return 1.0 if within_one(x, y) or within_one(_formal(x), _formal(y)) else None

    total = cheapest([[cost(i, x, j, y) for j, y in enumerate(b)] for i, x in enumerate(a)])
    if total is None:
        return None
    return total, len(a) != len(b) or bool(a and (len(a[0]) == 1) != (len(b[0]) == 1))


#: Relations of two names: a link, or one agreeing with the other but saying less.
NONE, LINK, LESS = 0, 1, 2


def _relate(x: Reading, y: Reading) -> tuple[int, int, int]:
    """(relation, rank of x, rank of y) of two readings."""
    best = (NONE, 0, 0)
    for p in x.persons:
        for q in y.persons:
            if not within_one(p.surname, q.surname):
                continue
            found = _given(p.given, q.given)
            if found is None or found[0] + (p.surname != q.surname) >= 2:
                continue
            if p.level == q.level and (p.level != 0 or len(p.given) == len(q.given)):
                return LINK, p.rank, q.rank
            best = LESS, p.rank, q.rank
    if x.words and y.words:
        if x.acronym == y.acronym:
            cost = assign(x.words, y.words)
            if cost is not None and cost < 2:
                return LINK, 3, 3
        elif not x.acronym or not y.acronym:
            short, full = (x, y) if x.acronym else (y, x)
            if len(full.words) == len(short.words) + len(short.acronym):
                # letters of the acronym are assigned too, each to a word that begins with it
                rows = [[0.0 if w == r else 1.0 if within_one(w, r) else None for r in full.words] for w in short.words]
                rows += [[0.0 if r[0] == c else None for r in full.words] for c in short.acronym]
                cost = cheapest(rows)
                if cost is not None and cost < 2:
                    return LESS, 0 if x.acronym else 3, 0 if y.acronym else 3
    return best


def relate(x: Name, y: Name) -> tuple[int, int, int]:
    """The closest relation of two names over readings with the same treatment of vowels."""
    best = (NONE, 0, 0)
    for i in range(max(len(x), len(y))):
        found = _relate(x[min(i, len(x) - 1)], y[min(i, len(y) - 1)])
        if found[0] == LINK:
            return found
        best = best if best[0] else found
    return best


def _person_keys(name: Reading) -> set[str]:
    out = set()
    for p in name.persons:
        for first in p.given or ("",):  # any given name can come first on the other side
            initials = {first[:1], _formal(first)[:1]}
            for d in deletes(p.surname):
                out |= {f"{d}|{i}" for i in initials}
            if len(first) >= 4:  # an edit at the initial itself
                out |= {f"{p.surname}|~{first[1:]}", f"{p.surname}|~{first}", f"{p.surname}|~{first[0]}{first[2:]}"}
    return out


def _initial_keys(name: Reading) -> set[str]:
    """Keys of a name that is no person's: of two that assign() links, one word at most is edited and any
    other is equal or abbreviated, so they share their initials or, edited at one, all others and a form of
    that word. Acronyms count as the initials they stand for."""
    letters = sorted([w[0] for w in name.words] + list(name.acronym))
    out = {"i" + "".join(letters)}
    for w in name.words:
        if len(w) >= 4:
            rest = letters.copy()
            rest.remove(w[0])
            out |= {f"j{''.join(rest)}|{x}" for x in (w, w[1:], w[0] + w[2:])}
    return out


def keys_of(name: Name) -> set[str]:
    """Keys of the index: any two names that relate() relates share one."""
    return {"p" + k for r in name for k in _person_keys(r)} | {k for r in name if r.words for k in _initial_keys(r)}


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index keys of each name."""
    for batch in batches:
        nodes, keys = [], []
        for node in batch.column("node").to_pylist():
            field, text = node.split("\x01", 1)
            for k in sorted(keys_of(parse_name(text, field == "creators"))):
                nodes.append(node)
                keys.append(field + k)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(keys, pa.string())], names=["node", "key"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            field, ta = a.split("\x01", 1)
            kind, lx, ly = relate(parse_name(ta, field == "creators"), parse_name(b.split("\x01", 1)[1], field == "creators"))
            if kind == LINK:
                rows.append((a, b, 1))
            elif kind == LESS and lx != ly:
                rows.append((a, b, 10 + lx) if lx < ly else (b, a, 10 + ly))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["a", "b", "kind"])


def link_names(names: DataFrame) -> DataFrame:
    """``field_name``, ``name``, ``group_id`` of the distinct strings of names (``field_name``, ``name``).

    Names of one group name the same person, organisation or publication; group_id is one of them. Null
    and blank strings are left out; strings without letters or digits stand alone. Repeated rows count
    once. An empty input gives an empty result. Fields are never linked with one another; only names of
    the field 'creators' can be persons. Jobs run while the result is built: they write tables to the shared folder.
    """
    nodes = names.where("field_name is not null and name is not null and trim(name) <> ''").select(F.concat_ws("\x01", "field_name", "name").alias("node")).distinct()
    nodes = materialize(nodes, "names")
    index = materialize(nodes.mapInArrow(_file, "node string, key string"), "name-keys")
    # a key of many names is cut into cells of the one side, each of which meets all of the other
    parts = index.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").select("key", "parts")
    cut = materialize(index.join(parts, "key"), "name-cells")
    left = cut.select("key", F.col("node").alias("a"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("cell"))
    right = cut.select("key", F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cell"))
    pairs = left.join(right, ["key", "cell"]).where("a < b").select("a", "b").distinct()
    rel = materialize(pairs.mapInArrow(_compare, "a string, b string, kind int"), "name-relations")
    comp = components(rel.where("kind = 1").select("a", "b"))
    group = nodes.join(comp.withColumnsRenamed({"component": "group"}), "node", "left").select("node", F.coalesce("group", "node").alias("group"))
    group = materialize(group, "name-groups")
    for level in (2, 1, 0):  # names that say less join the one group they agree with
        part = rel.where(F.col("kind") == 10 + level)
        to = (
            part.join(group.select(F.col("node").alias("a"), F.col("group").alias("ga")), "a")
            .join(group.select(F.col("node").alias("b"), F.col("group").alias("gb")), "b")
            .where("ga <> gb")
            .groupBy("ga")
            .agg(F.min("gb").alias("to"), F.max("gb").alias("other"))
            .where("to = other")
            .select(F.col("ga").alias("group"), "to")
        )
        group = materialize(group.join(to, "group", "left").select("node", F.coalesce("to", "group").alias("group")), "name-groups")
    cut = F.split("node", "\x01", 2)
    return group.select(cut[0].alias("field_name"), cut[1].alias("name"), F.col("group").alias("group_id"))


def name_pairs(groups: DataFrame) -> DataFrame:
    """``field_name``, ``name_a``, ``name_b``: the pairs of different strings within each group, name_a < name_b.

    A group of many names is cut into cells of the one side, each of which meets all of the other."""
    g = groups.select("group_id", "field_name", "name").distinct()
    parts = g.groupBy("field_name", "group_id").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    g = g.join(parts, ["field_name", "group_id"])
    a = g.select("group_id", "field_name", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), "parts").cast("int").alias("cell"))
    b = g.select("group_id", "field_name", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cell"))
    return a.join(b, ["field_name", "group_id", "cell"]).where("name_a < name_b").select("field_name", "name_a", "name_b")


def names_of(df: DataFrame, list_col: str = "creators", text_col: str = "publication") -> DataFrame:
    """``field_name``, ``name``: every string of a list column and of a text column."""
    one = df.select(F.lit(list_col).alias("field_name"), F.explode(list_col).alias("name"))
    return one.unionByName(df.select(F.lit(text_col).alias("field_name"), F.col(text_col).alias("name")))
