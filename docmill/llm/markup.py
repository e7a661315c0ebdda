"""Markup residue: HTML, Markdown, wiki and LaTeX turned into clean text that keeps its structure.

A text is cut into flat blocks (runs of lines between blank lines; headings, fences and environments
stand alone). Each block has shallow features: its word count and link density and those of its two
neighbours, and how many marks of each kind it shows. Marks of some kinds are markup wherever they stand
(tags, entities, commands, ...); others only begin like markup: a line after ``#``, ``>``, ``=`` or a list
dash, a span between dollars. A decision tree, trained on the labelled blocks that labelled_documents()
writes out, tells blocks with markup residue from plain ones: it is the shape of a block and its neighbours
that tells a heading from a numbered remark, a quotation from a threshold, a list from a dash. Blocks with
residue are converted; plain blocks pass unchanged.

In the clean text a heading is a line of its own, a list item begins with a bullet, code is indented by
four spaces, a formula stands as its source without delimiters, and table cells are parted by tabs.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts without a match have no construct at all; a superset of the patterns below, in Java's dialect.
SUSPECT = r"(?m)[<&*_`{}\\|=~$^#]|-->|\]\(|\]\[|\[\[|\]\]|\[\^|''|!\[|^[ \t]*(?:[-+][ \t]|>|:?-{3,})|^::|^![^\n]*!!|^\[[^\]\n]+\]:"

#: Kinds of marks that are markup wherever they stand, and of marks that can be something else.
SURE = ("html", "markdown", "wiki", "latex")
MAYBE = ("heading", "quote", "item", "dash", "dollar", "target")
FAMILIES = SURE + MAYBE
_TAGS = (
    "a|abbr|acronym|address|article|aside|b|base|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|dd|del|details|dfn|div|dl|dt|em|"
    "fieldset|figcaption|figure|font|footer|form|frame|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|math|meta|nav|nowiki|noinclude|"
    "ol|option|p|param|pre|q|ref|references|s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|textarea|tfoot|th|"
    "thead|time|title|tr|tt|u|ul|var|video|wbr|includeonly|gallery|syntaxhighlight|poem"
)
#: Marks, whole or damaged, by kind. Spans have no longest length; what a span may hold ends each search.
CONSTRUCTS = {
    "html": re.compile(
        rf"</?(?:{_TAGS})(?:\s[^<>]*+)?/?>|</?(?:{_TAGS})(?=\s+[a-z-]+\s*=)|<!--|-->|<!DOCTYPE|<!\[CDATA\[|</[A-Za-z]|&(?:\#\d{{2,7}}|\#[xX][0-9a-fA-F]{{2,6}}|[A-Za-z]{{2,8}}\d?);|&(?:nbsp|amp|quot|lt|gt|mdash|ndash)\b",
        re.I | re.M,
    ),
    "markdown": re.compile(
        r"(?<=\S)[ \t]*\n(?:={3,}|-{3,})[ \t]*$|^[ \t]*(?:```|~~~)|`[^`\n]+`|\w`|`\w|\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}|(?<![\w*\\])\*(?=[^\W_])[^*\n]++(?<=[\w.,;:!?)])\*(?![\w*])|(?<=\s)\*[=<>/+-]{1,3}\*(?=\s)|"
        r"(?<![\w_])_{1,3}(?=[^\W_])[^_\n]++(?<=[\w.,;:!?)])_{1,3}(?![\w_])|(?<![\w_])__(?=\w)|~~|!\[|\]\(|\]\[[^\]\n]*\]|\[\^[\w-]+\]|^[ ]{0,3}\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$|^\|[^\n]*\|[ \t]*$|"
        r"^[ ]{0,3}(?:\*[ ]?){3,}$|<(?:https?|ftp|mailto):[^<>\s]+>|\\[*_`\#\[\]]",
        re.M,
    ),
    "wiki": re.compile(r"\[\[|\]\]|\{\{(?!\{)|\}\}|(?<!')'{2,5}(?!')|^(={1,6})[ ]?[^=\n]+?[ ]?\1[ \t]*$|^\{\||^\|[-}+]|^![^\n]*!!|__[A-Z]{3,}__|^(?!\#+[ \t])[*\#:]{2,}[ ]?\S", re.M),
    "latex": re.compile(r"(?<![\w:\\])\\[a-zA-Z]{2,}|\\[a-zA-Z]{2,}\*?[{\[]|\\[(\[\])]|\\[%&\#_{}$~^\"'`]|\\\\|\$\$|\$(?=\S)[^$\n]*?[\\^_{}][^$\n]*+(?<=\S)\$(?!\d)|[_^]\{|~(?=\\)|^\s*%[ ]?\\"),
    #: Lines that begin as a heading of Markdown or of a wiki (its end can be lost).
    "heading": re.compile(r"^[ ]{0,3}\#{1,6}[ \t]+\S|(?:\A|(?<=\n\n))={2,6}[ ]\w", re.M),
    #: A block that begins as a quotation.
    "quote": re.compile(r"\A[ ]{0,3}>[ \t>]*\S"),
    #: Lines that begin as an item of a Markdown list; a second one with the same mark must follow.
    "item": re.compile(r"^[ \t]*([-*+])[ \t]+\S(?=[^\n]*\n(?:[ \t]+[^\n]*\n)?[ \t]*\1[ \t]+\S)", re.M),
    #: A block without such lines that begins as an item; in a list with blank lines its neighbours do too.
    "dash": re.compile(r"\A[ \t]*[-*+][ \t]+\S"),
    #: A span between dollars without a sign of a formula.
    "dollar": re.compile(r"(?<![\w$\\])\$(?=[^\s$])[^$\n\\^_{}]*+(?<=\S)\$(?![\w$])", re.M),
    #: The target of a link, or an entry of a bibliography.
    "target": re.compile(r"^\[[^\]\n]+\]:[ \t]", re.M),
}
_LINK = re.compile(r"\[\[[^\]\n]*\]\]|!?\[[^\]\n]*\]\([^)\n]*\)|<a\b[^>]*>.*?</a>|(?:https?://|www\.)\S+", re.I | re.S)
_PAGE_NO = re.compile(r"^[ \t]*[-*–—][ \t]*\d{1,4}[ \t]*[-*–—][ \t]*$", re.M)
_WORDS = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*")
_SPECIAL = re.compile(r"[<>&*_`{}\\|=~$^#]|\]\(|\]\[|\[\[|\]\]|\[\^|''|^[ \t]*[-+][ \t]|^-{3,}", re.M)


def blocks(text: str) -> list[str]:
    """Flat blocks of a text. A fenced block and an environment stay whole, across blank lines."""
    parts = _SPLIT.split(text.strip("\n"))
    out: list[str] = []
    open_fence = False
    for part in parts:
        if open_fence:
            out[-1] += "\n\n" + part
        elif part.strip():
            out.append(part)
        if part.count("```") % 2:
            open_fence = not open_fence
    return out


def block_features(parts: list[str]) -> np.ndarray:
    """(blocks, 16): words, link density, both of the previous and of the next block, marks by kind."""
    base = np.zeros((len(parts) + 2, 2))
    marks = np.zeros((len(parts), len(FAMILIES)))
    for i, part in enumerate(parts):
        n = len(_WORDS.findall(part))
        linked = sum(len(_WORDS.findall(x)) for x in _LINK.findall(part)) if ("[" in part or "://" in part or "www." in part or "<a" in part) else 0
        base[i + 1] = n, linked / n if n else 0.0
        if _SPECIAL.search(part):
            part = _PAGE_NO.sub("", part)
            for j, family in enumerate(FAMILIES):
                marks[i, j] = sum(1 for _ in CONSTRUCTS[family].finditer(part))
    marks[marks[:, FAMILIES.index("item")] > 0, FAMILIES.index("dash")] = 0
    return np.hstack([base[1:-1], base[:-2], base[2:], marks])


#: Names of the features, in order.
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", *FAMILIES)


# --- labelled blocks ----------------------------------------------------------------------------

#: Labelled documents; the bound of the table the tree is fitted on (about six blocks each).
LABELLED = 500
_NOUNS = "survey town route harvest archive bridge statute library orchard canal census glacier harbour market quarry railway school theatre valley windmill".split()
_VERBS = "closed measured visited repaired counted described moved opened painted planned rebuilt replaced studied surveyed".split()
_TAILS = ["in the spring of that year", "because no record was kept", "although the council disagreed", "before the second visit", "without a known reason", "as the older maps show", "for the first time", "and nobody asked why"]


def labelled_documents() -> list[list[tuple[str, int]]]:
    """Documents as (block, label) lists, label 1 with markup residue; written out by rules, always the same."""
    rng = random.Random(11)
    pick = rng.choice

    def word() -> str:
        return pick(_NOUNS)

    def sentence() -> str:
        return f"The {word()} of the {pick('north south east west'.split())}ern {word()} was {pick(_VERBS)} {pick(_TAILS)}."

    def prose(n: int = 0) -> str:
        return " ".join(sentence() for _ in range(n or rng.randrange(1, 6)))

    def title() -> str:
        return f"{word().capitalize()} and {word()}" if rng.random() < 0.6 else f"The {word()} {pick(_TAILS)}"

    def with_markup() -> str:
        k, w = rng.randrange(40), word()
        lines = rng.randrange(2, 6)
        one = [
            f"The <b>{w}</b> was {pick(_VERBS)}.", f"<p>{prose()}</p>", f"<div class=\"x\">{sentence()}", f"{sentence()}</div>", f"{w.capitalize()}&nbsp;&mdash; {sentence()}", f"<!-- {w} -->", f"{sentence()}<br/>{sentence()}", f"<a href=\"/x\">{w}</a> {sentence()}",
            f"See [the {w}](https://{w}.example/a) for more.", f"![{w}](img/{w}.png)", f"The **{w}** was {pick(_VERBS)}.", f"It was **{w} again {pick(_TAILS)}.", f"A `{w}` was seen.", f"```\nfor x in {w}:\n    use(x)\n```", f"| {w} | n |\n|---|---|\n| a | {k} |", f"It was *{sentence()[:-1]}* then.", f"{title()}\n{pick('=-') * rng.randrange(5, 20)}", f"As noted[^1], {sentence()}",
            f"[[{w}]] {sentence()}", f"''{w}'' was {pick(_VERBS)}.", "{{Infobox\n| name = " + w + "\n}}", "{{cite|" + w + "}} " + sentence(), f"== {title()} ==", f"{{| class=x\n|-\n| {w}\n|}}",
            f"\\section{{{title()}}}", f"A {w}\\footnote{{{sentence()}}} was seen.", f"$x_{{{k}}} = \\beta + z^{{2}}$ {sentence()}", f"\\begin{{itemize}}\n\\item {w}\n\\end{{itemize}}", f"See \\ref{{{w}}} and {k}\\% of it.", f"$$ a^2 + b^2 $$", f"over~\\cite{{{w}}} {sentence()}",
        ]
        if k < len(one):  # marks inside a line stand in blocks of any length, as plain text does
            inside = "\n" not in one[k] and one[k][0] not in "|=#!"
            return prose() + " " + one[k] + " " + prose() if inside and rng.random() < 0.6 else one[k]
        if k == 33:
            return "\n".join(f"[{pick((w, str(rng.randrange(40))))}]: https://{word()}.example/{word()}" for _ in range(rng.randrange(1, 4)))
        if k < 34:
            return "#" * rng.randrange(1, 5) + " " + title()
        if k < 36:
            return "\n".join("> " + pick((sentence(), f"{w} {word()}", word())) for _ in range(rng.randrange(2, 4)))
        if k < 39:
            mark = pick("-*+")
            return "\n".join(f"{mark} {pick((word() + ' ' + word(), sentence()))}" for _ in range(lines))
        return f"Let ${pick('abknxy')}$ be the {w} of all."

    def plain() -> str:
        k, w = rng.randrange(36), word()
        lines = rng.randrange(1, 5)
        alike = [
            f"Costs fell from ${k + 20} to ${k} a month, while {w} adds $3.", f"The field is 5 * {k} * 2 metres, and a > b holds.", f"Test a == b fails for {w} #{k}, while c != d passes.", f"Results with p < 0.{k} and n > {k} were kept.", f"We wrote x_i = {k} in the margin.", f"Logs go to {w}_log_v2 and cache_dir_tmp on the R&D drive.",
            f"• {w}\n• {word()}", f"{w}\t{k}\t8.1\n{word()}\t{k}\t7.7", "The set {one, " + w + ", three} has eight subsets.", f"About ~{k}% of rows; error <= 3, gain >= 2.", f"Earlier work [3], [{k}] and [12] found the same.", f"{k}.3 {title()}", "\n".join(f"https://{word()}.example/list www.{word()}.example" for _ in range(lines)), f"{k}", f"- {k} -", f"C:\\data and /srv/{w} hold the copies.", f"page {k} of 40",
            # beginnings of markup whose shape tells that they are none
            f"# {k} of the items in the {w} were lost; {prose(4)}", f"## {k} and ### {k + 1} are the numbers that the clerk gave the {w}, {prose(4)}", f"> {k}", f"> {k} %", f"- {sentence()}", "Dear reader,", f"{title()}", "\n".join(f"[{k + i}]: Doe, A. (19{k + 50}). {title()}. Letters, {k}, 1-12." for i in range(lines)),
            f"The prices of US$ {k} and NZ$ {k} were {pick(_VERBS)}.", f"'{w}' and \"{w}\" were {pick(_VERBS)}.",
        ]
        return alike[k] if k < len(alike) else pick((prose(rng.randrange(5, 12)), title(), word().capitalize(), f"{k} {w}", f"The {w} of {word()}"))

    out = []
    for _ in range(LABELLED):
        parts: list[tuple[str, int]] = []
        for _ in range(rng.randrange(3, 9)):
            kind = rng.random()
            if kind > 0.985:  # a list with blank lines
                mark, short = pick("-*+"), rng.random() < 0.5
                parts += [(f"{mark} {word()} {word()} {word()}" if short else f"{mark} {sentence()}", 1) for _ in range(rng.randrange(2, 5))]
                continue
            parts.append((prose(), 0) if kind < 0.4 else (with_markup(), 1) if kind < 0.7 else (plain(), 0))
        out.append(parts)
    return out


#: Labelled blocks of a leaf of the tree.
LEAST_LEAF = 3


class DecisionTree:
    """A small binary decision tree by Gini impurity; ties go to the first feature and cut.

    Of the features in `first`, one whose presence always goes with one label is split off before any
    other, so that how long labelled blocks happen to be does not stand in for it.
    """

    def __init__(self, depth: int = 32, first: range = range(0)) -> None:
        self.depth, self.first = depth, first
        self.nodes: list[tuple[int, float, int, int, int]] = []  # feature, cut, left, right, label

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.nodes = []
        self._grow(x, y, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, int(y.mean() >= 0.5)))
        if level >= self.depth or y.min() == y.max() or len(y) < 2 * LEAST_LEAF:
            return me
        best = None
        for f in self.first:
            left = x[:, f] <= 0.5
            some = y[~left]
            if LEAST_LEAF <= len(some) <= len(y) - LEAST_LEAF and some.min() == some.max() and (best is None or -len(some) < best[0]):
                best = (-len(some), f, 0.5, left)
        for f in range(x.shape[1]) if best is None else ():
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                if min(left.sum(), len(left) - left.sum()) < LEAST_LEAF:
                    continue
                gini = sum(s.sum() * (1 - (y[s].mean() ** 2 + (1 - y[s].mean()) ** 2)) for s in (left, ~left))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, cut, left)
        if best is None:
            return me
        _, f, cut, left = best
        a, b = self._grow(x[left], y[left], level + 1), self._grow(x[~left], y[~left], level + 1)
        self.nodes[me] = (f, float(cut), a, b, self.nodes[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        f, cut, left, right, label = (np.array(v) for v in zip(*self.nodes))
        for _ in range(self.depth + 1):
            inner = f[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return label[at]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the labelled blocks."""
    rows = labelled_documents()
    return np.vstack([block_features([t for t, _ in parts]) for parts in rows]), np.array([y for parts in rows for _, y in parts])


@lru_cache(1)
def block_classifier() -> DecisionTree:
    """The tree fitted on the labelled blocks."""
    return DecisionTree(first=range(6, 6 + len(FAMILIES))).fit(*labelled_table())


def _with_residue(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(label, features) of blocks."""
    x = block_features(parts)
    return block_classifier().predict(x), x


# --- conversion ---------------------------------------------------------------------------------

_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n]*\n(.*?)(?:\n[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre>", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(.*?)\\end\{\1\}", re.S)
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|gather|math|displaymath)\*?\}(.*?)\\end\{\3\*?\}", re.S)
_INLINE = re.compile(r"\\\((.+?)\\\)|(?<![\\$])\$(?!\s)([^$\n]*?[\\^_{}][^$\n]*?|[A-Za-z]\w{0,3})\$")
_HEADS = (
    (re.compile(r"^[ ]{0,3}(\#{1,6})[ \t]+(.*?)[ \t#]*$"), lambda m: len(m[1])),
    (re.compile(r"^(={1,6})[ ]?([^=\n].*?)[ ]?=*[ \t]*$"), lambda m: len(m[1])),
    (re.compile(r"^\\((?:sub){0,2})section\*?\{(.*?)\}\s*(?:\\label\{[^}]*\})?\s*$"), lambda m: 1 + len(m[1]) // 3),
    (re.compile(r"^<h([1-6])\b[^>]*>(.*?)(?:</h[1-6]>)?\s*$", re.I), lambda m: int(m[1])),
)
_ITEM = re.compile(r"^[ \t]*(?:[-*+\#]{1,4}[ \t]+|<li\b[^>]*>|\\item\b(?:\[[^\]]*\])?[ \t]*)(.*)$", re.I)
_ROW = re.compile(r"^\s*\|(.*?)\|?\s*$")
_SUBS = [
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), ""),
    (re.compile(r"<(script|style)\b.*?(?:</\1>|\Z)", re.S | re.I), ""),
    (re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", re.S | re.I), ""),
    (re.compile(r"<br\s*/?>|</p>|</div>|</tr>", re.I), "\n"),
    (re.compile(r"</t[dh]>\s*(?=<t[dh])|(?<=[^\s>])\s*<t[dh]\b[^>]*>", re.I), "\t"),
    (re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>"), r"\1"),
    (re.compile(rf"</?(?:{_TAGS})(?:\s[^<>\n]*)?/?>", re.I), ""),
    (re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"\[([^\]\n]+)\]\[[^\]\n]*\]"), r"\1"),
    (re.compile(r"\[\^[\w-]+\]:?"), ""),
    (re.compile(r"\[\[(?:File|Image|Category):[^\]|]*\|(?:[^\]|]*\|)*([^\]|]*)\]\]", re.I), r"\1"),
    (re.compile(r"\[\[:?(?:Category:)?[^\]|\n]*\|([^\]\n]*)\]\]", re.I), r"\1"),
    (re.compile(r"\[\[:?(?:Category:)?([^\]\n]*)\]\]", re.I), r"\1"),
    (re.compile(r"\{\{(?:cite|ref|sfn)\b[^{}]*\}\}", re.I), ""),
    (re.compile(r"\{\{(?:nowrap|lang|small|em)\|(?:[^{}|]*\|)*([^{}|]*)\}\}", re.I), r"\1"),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"\\(?:footnote|label|index|cite[a-z]*|ref|eqref|pageref|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:text\w*|emph|mbox|underline|url|href\{[^{}]*\}|caption|title)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\})?|\\hline\b|\\(?:maketitle|centering|noindent|newpage|clearpage)\b"), ""),
    (re.compile(r"\\(?:ldots|dots)(?:\{\})?"), "…"),
    (re.compile(r"\\([%&\#_{}$*`\[\]])"), r"\1"),
    (re.compile(r"(?:\*{2,3}|~~|(?<![\w_])__(?=\w)|(?<=\w)__(?![\w_]))"), ""),
    (re.compile(r"(?<![\w*])\*(?=[^\W_])([^*\n]++)(?<=[\w.,;:!?)])\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_])_(?=[^\W_])([^_\n]++)(?<=[\w.,;:!?)])_(?![\w_])"), r"\1"),
    (re.compile(r"`([^`\n]+)`"), r"\1"),
]
_TABULAR = re.compile(r"\\begin\{tabular\}(?:\{[^}]*\})?(.*?)(?:\\end\{tabular\}|\Z)", re.S)
_INFOBOX = re.compile(r"\{\{[^{}]*\n[^{}]*\}\}", re.S)
_WIKITABLE = re.compile(r"^\{\|[^\n]*\n(.*?)(?:^\|\}|\Z)", re.S | re.M)


def _inline(text: str) -> str:
    """Clean text of a run without block structure; formulas are kept as their source."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(next(g for g in m.groups() if g is not None).strip())
        return f"\x00{len(held) - 1}\x00"

    text = _INLINE.sub(hold, text.replace("\x00", ""))
    for pattern, to in _SUBS:
        text = pattern.sub(to, text)
    if "&" in text:
        text = html.unescape(text)
    text = re.sub(r"~(?=\S)(?<=\w~)", " ", text) if "~" in text else text
    text = re.sub(r"[ \t]{2,}", " ", text.replace("\u00a0", " ")) if "\t" not in text else text
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)


def _cells(line: str) -> str:
    return "\t".join(_inline(c).strip() for c in line.split("|"))


def convert_block(block: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) parts of a block with residue."""
    for pattern in (_FENCE, _PRE):
        if m := pattern.search(block):
            code = m[1] if pattern is _FENCE else html.unescape(m[1])
            return [*_rest(block[: m.start()]), ("code", 0, code.strip("\n")), *_rest(block[m.end() :])]
    if m := _VERBATIM.search(block):
        return [*_rest(block[: m.start()]), ("code", 0, m[2].strip("\n")), *_rest(block[m.end() :])]
    if m := _DISPLAY.search(block):
        source = next(g for g in (m[1], m[2], m[4]) if g is not None)
        return [*_rest(block[: m.start()]), ("formula", 0, " ".join(source.split())), *_rest(block[m.end() :])]
    if m := _TABULAR.search(block):
        rows = [r.replace("\\hline", "").strip() for r in m[1].split("\\\\")]
        table = "\n".join("\t".join(_inline(c).strip() for c in r.split("&")) for r in rows if r)
        return [*_rest(block[: m.start()]), ("table", 0, table), *_rest(block[m.end() :])]
    if m := _WIKITABLE.search(block):
        rows = [re.sub(r"\|\||!!", "|", r.strip().lstrip("|!").strip()) for r in m[1].split("\n")]
        table = "\n".join(_cells(r) for r in rows if r and not re.fullmatch(r"-+|\}|\+.*", r))
        return [*_rest(block[: m.start()]), ("table", 0, table), *_rest(block[m.end() :])]
    if m := _INFOBOX.search(block):
        rows = [r.strip().lstrip("|").strip() for r in m[0][2:-2].split("\n")]
        table = "\n".join("\t".join(_inline(c).strip() for c in r.split("=", 1)) for r in rows if r)
        return [*_rest(block[: m.start()]), ("table", 0, table), *_rest(block[m.end() :])]
    return _lines(block)


def _rest(block: str) -> list[tuple[str, int, str]]:
    return convert_block(block.strip("\n")) if block.strip() else []


def _lines(block: str) -> list[tuple[str, int, str]]:
    out: list[tuple[str, int, str]] = []

    def add(kind: str, level: int, text: str) -> None:
        if not text.strip():
            return
        if out and out[-1][0] == kind and kind in ("paragraph", "list", "quote", "table"):
            out[-1] = (kind, level, out[-1][2] + "\n" + text)
        else:
            out.append((kind, level, text))

    lines = block.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if i < len(lines) and line.strip() and re.fullmatch(r"={3,}[ \t]*|-{3,}[ \t]*", lines[i]):
            add("heading", 1 if lines[i][0] == "=" else 2, _inline(line).strip())
            i += 1
            continue
        head = next(((p, lv) for p, lv in _HEADS if p.match(line)), None)
        if head and (m := head[0].match(line)) and not (line[0] == "=" and not line.rstrip().endswith("=")):
            add("heading", min(6, max(1, head[1](m))), _inline(m[2]).strip())
        elif re.fullmatch(r"[ ]{0,3}\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*|[ ]{0,3}(?:\*[ ]?){3,}", line):
            continue
        elif line.startswith("|") and (m := _ROW.match(line)) and "|" in line[1:]:
            add("table", 0, _cells(m[1]))
        elif m := re.match(r"^[ ]{0,3}>[ \t>]*(.*)$", line):
            add("quote", 0, _inline(m[1]).strip())
        elif (m := _ITEM.match(line)) and not _PAGE_NO.match(line):
            add("list", 0, "• " + _inline(m[1]).strip())
        else:
            add("paragraph", 0, _inline(line).rstrip())
    return out


def clean_text(text: str | None) -> tuple[str | None, list[tuple[str, int, str]], int]:
    """(clean text, parts, blocks with residue) of a text; null gives null."""
    if text is None:
        return None, [], 0
    parts = blocks(text)
    if not parts:
        return "", [], 0
    label, _ = _with_residue(parts)
    out: list[tuple[str, int, str]] = []
    for block, residue in zip(parts, label):
        out += convert_block(block) if residue else [("paragraph", 0, block)]
    shown = ["\n".join("    " + x for x in t.split("\n")) if kind == "code" else t for kind, _, t in out]
    return "\n\n".join(shown), out, int(label.sum())


def suspect(text: Column) -> Column:
    """Whether a text holds any character that a construct needs; others need no look by Python."""
    return text.rlike(SUSPECT)


def _residue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        cut = [blocks(t) for t in texts]
        found = np.zeros((len(texts), 1 + len(FAMILIES)), np.int64)
        for i, c in enumerate(cut):
            if c:
                label, x = _with_residue(c)
                found[i, 0] = label.sum()
                found[i, 1:] = (x[:, 6:] * label[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(found[:, j].astype(np.int32)) for j in range(found.shape[1]))], names=["id", "residue_blocks", *FAMILIES])


def residue(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id``, ``residue_blocks`` and the marks by kind (FAMILIES) in blocks with residue, of the records that have such a block.

    Null and empty texts have none. Repeated rows come out each. The id can be null and of any type.
    Other columns are not read. One pass without a shuffle.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).where(suspect(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_residue, f"id {kind}, residue_blocks int, " + ", ".join(f"{f} int" for f in FAMILIES)).where("residue_blocks > 0")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        done = [clean_text(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([d[0] for d in done], pa.string()),
                pa.array([[{"kind": k, "level": lv, "text": t} for k, lv, t in d[1]] for d in done], part),
                pa.array([d[2] for d in done], pa.int32()),
            ],
            names=["id", "clean_text", "parts", "residue_blocks"],
        )


def clean_documents(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id``, ``clean_text``, ``parts`` (kind, level, text) and ``residue_blocks`` of every row of df.

    A null text stays null and has no parts; an empty one is empty. Plain blocks pass unchanged.
    Repeated rows come out each. Other columns are not read. One pass without a shuffle.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_clean, f"id {kind}, clean_text string, parts array<struct<kind:string,level:int,text:string>>, residue_blocks int")
