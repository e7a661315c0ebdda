"""Markup, splitting, spam and page noise on small inputs."""

import random

import pytest

from docmill.llm import markup, ocr_noise, spam, splitting

# --- markup ---


@pytest.mark.parametrize(
    "text",
    ["<b>bold</b> text", "a <br/> b", "x &nbsp; y", "## Heading", "Title\n-----", "see [it](http://a.example/x)", "**bold", "a `code` b", "[[Link]] here", "''it'' is", "== Head ==", "\\section{A}", "a $x_{1} = 2$ b",
     "value\\footnote{x} here", "```\ncode\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "* one\n* two", "- one\n- two", "> quoted\n> text", "{{cite|x}} y", "20\\% more", "over~\\cite{a} it", "~~no~~ yes"],
)
def test_constructs_are_found(text):
    assert markup.clean_text(text)[2] > 0


@pytest.mark.parametrize(
    "text",
    ["a < b and b > c", "from $93 to $19 a month", "4 * 11 * 3 points", "a == b fails for #18, c != d", "p < 0.05 with n > 87", "x_i = 49", "run_log_v1 and page_tmp on the R&D share", "~54% of <= 2", "{alpha, beta}",
     "See [6], [7] and [21].", "C:\\scans\\batch66\\new", "• one\n• two", "- 12 -", "2.3 Scope", "https://a.example/x", "a\tb\t1", "(19) above & below", ""],
)
def test_lookalikes_are_not(text):
    clean, _, n = markup.clean_text(text)
    assert n == 0 and clean == text


def test_structure_is_kept():
    src = "# Title\n\nSome **bold** and <i>it</i> &amp; [link](http://a.example).\n\n* one\n* two\n\n```python\nfor x in y:\n    pass\n```\n\n$$ a^{2} $$\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n\\subsection{Part}\\label{p}"
    text, parts, _ = markup.clean_text(src)
    assert [(k, t) for k, _, t in parts] == [
        ("heading", "Title"), ("paragraph", "Some bold and it & link."), ("list", "• one\n• two"), ("code", "for x in y:\n    pass"), ("formula", "a^{2}"), ("table", "a\tb\n1\t2"), ("heading", "Part"),
    ]
    assert "    for x in y:\n        pass" in text


def test_markup_on_tables(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "y"), (2, None, "y"), (3, "", "y"), (4, "plain", "y"), (1, "<b>x</b>", "y")], "id long, text string, html string")
    assert sorted(r["id"] for r in markup.residue(df).collect()) == [1, 1]
    got = {r["id"]: (r["clean_text"], r["residue_blocks"]) for r in markup.clean_documents(df).collect()}
    assert got == {1: ("x", 1), 2: (None, 0), 3: ("", 0), 4: ("plain", 0)}
    assert markup.residue(df.limit(0)).count() == 0


def test_every_construct_is_suspect(spark):
    texts = [">text", "[x]: url", "::text", "! a !! b", "      - a\n      - b", "\t\t+ a\n\t\t+ b", "a\n\n     :---\nb", "* a\n* b", "<b>x</b>"]
    assert all(any(p.search(t) for p in markup.CONSTRUCTS.values()) for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert df.where(markup.suspect(df["text"])).count() == len(texts)


def test_random_texts_with_marks_are_suspect(spark):
    rng = random.Random(6)
    bits = ["<b>", "</", "&amp;", "*", "_", "`", "{", "}", "\\", "|", "=", "~", "$", "^", "#", "> ", "- ", "+ ", ":", "!", "!!", "[a]", "]:", "[[", "''", "word", " ", " ", "\n", "\n\n", "7", "---", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = {r["id"] for r in df.where(markup.suspect(df["text"])).collect()}
    assert not [t for i, t in enumerate(texts) if i not in seen and markup.clean_text(t)[2]]


LONG = "It went on for years. " * 6


@pytest.mark.parametrize(
    "text, blocks",
    [("# Title\n\n" + LONG, 1), ("# 9 of the items were lost; " + LONG, 0), ("> " + LONG, 1), ("> 7", 0), ("- one thing\n\n- two things\n\n- three things", 3), (LONG + "\n\n- 7 -\n\n" + LONG, 0),
     ("[note]: https://a.example/list", 1), ("[3]: Doe, A. (1999). The town and the bridge. Letters, 3, 1-12.", 0), ("a " + "x" * 900 + " *" + "y " * 500 + "z* b", 1), ("<a " + "x" * 2000 + ">", 1)],
)
def test_shape_tells_marks_that_can_be_something_else(text, blocks):
    assert markup.clean_text(text)[2] == blocks


def test_features_of_shape_matter():
    x, y = markup.labelled_table()
    whole = (markup.block_classifier().predict(x) != y).sum()
    for without in ([0, 2, 4], [1, 3, 5], range(6)):
        z = x.copy()
        z[:, list(without)] = 0
        assert (markup.DecisionTree().fit(z, y).predict(z) != y).sum() > whole
    assert whole <= 0.01 * len(y) and markup.labelled_documents() == markup.labelled_documents()


def test_clean_text_of_both_tables(spark, tmp_path):
    from docmill.llm.queries import p1_clean

    spark.createDataFrame([(1, "<b>x</b>"), (2, None)], "id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "# Head\n\n**y**"), (3, "plain"), (4, None)], "ocr_id long, markdown string").write.parquet(f"{tmp_path}/ocr_results.parquet")
    got = {(r["record_table"], r["record_id"]): (r["clean_text"], r["residue_blocks"]) for r in p1_clean(spark, str(tmp_path)).collect()}
    assert got == {("chunks", 1): ("x", 1), ("chunks", 2): (None, 0), ("ocr_results", 1): ("Head\n\ny", 2), ("ocr_results", 3): ("plain", 0), ("ocr_results", 4): (None, 0)}


def test_long_texts_take_linear_time():
    import time

    t = time.time()
    markup.clean_text("word * " * 60_000)
    markup.clean_text("a" * 300_000 + "\n----\n<" + "b" * 100_000)
    assert time.time() - t < 20


def test_tree_learns():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((200, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(int)
    assert (markup.DecisionTree(4).fit(x, y).predict(x) == y).mean() > 0.97


# --- splitting ---


def test_split_is_a_round_trip_within_the_limit():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["word", "a", " ", "  ", "\n", "\n\n", ". ", "\t", "\n# Head\n", "é", "x" * 30]) for _ in range(rng.randrange(1, 120)))
        limit, overlap = rng.randrange(1, 12), rng.randrange(0, 12)
        cut = splitting.split_text(text, limit, overlap)
        fresh, out = 0, ""
        for s, e, n in cut:
            assert s <= fresh <= e and n == len(splitting.TOKEN.findall(text[s:e])) <= limit
            assert len(splitting.TOKEN.findall(text[s:fresh])) <= min(overlap, limit - 1)
            out += text[fresh:e]
            fresh = e
        assert out == text


def test_overlap_is_what_is_asked():
    text = " ".join(f"w{i}." for i in range(100))
    cut = splitting.split_text(text, 20, 5)
    ends = [e for _, e, _ in cut]
    assert all(len(text[s:e].split()) == 5 for (s, _, _), e in zip(cut[1:], ends))


def test_characters_are_the_last_resort():
    cut = splitting.split_text("x" * 100, 10, 0, max_chars=30)
    assert [e - s for s, e, _ in cut] == [30, 30, 30, 10]


def test_split_on_tables(spark):
    limits = spark.createDataFrame([("prose", 3, 1), ("prose", 5, 1), (None, 1, 0), ("zero", 0, None)], "content_type string, max_tokens int, overlap_tokens int")
    rows = [(1, "a b c d e", "prose", "S"), (2, "a b c", "prose", None), (3, None, "prose", None), (4, "a b c d e", "other", None), (5, "a b", "zero", ""), (6, "\u00a0a\u00a0b c d e", "prose", "x"), (1, "a b c d e", "prose", "S")]
    df = spark.createDataFrame(rows, "id long, text string, content_type string, section_path string").selectExpr("*", "1 as __limit", "2 as piece")
    got = splitting.split_oversized(df, limits)
    assert sorted({r["id"] for r in got.collect()}) == [1, 5, 6]
    assert [r["piece"] for r in got.where("id = 5").orderBy("piece_no").collect()] == ["a ", "b"]
    assert {r["section_path"] for r in got.where("id = 1").collect()} == {"S"} and got.where("piece_tokens > 3").count() == 0
    assert splitting.split_oversized(df.limit(0), limits).count() == 0 and splitting.split_oversized(df, limits.limit(0)).count() == 0


# --- spam ---

PROSE = "The committee reviewed the report in March, and its findings were published later. Because the survey was small, no claim was made about the north. Several readers asked for the tables, which are kept in the archive. "


@pytest.mark.parametrize(
    "text",
    ["dog bed cheap dog bed sale dog bed best dog bed " * 8, "#dogbed #sale #wallclock #dogbed " * 8, "Buy dog bed in Town because dog bed from Town is the cheap dog bed. Looking for dog bed? Our dog bed page has dog bed for every dog bed need. " * 4,
     PROSE + "\n" + "\n".join(f"https://host{i}.example/a/b{i}" for i in range(40)), "\n".join(f"Old rankings in town {i}: https://h{i}.example/x" for i in range(9)), "sale desk lamp 45,31 EUR price hair dryer 51,17 USD " * 6],
)
def test_spam(text):
    n, *features = spam.page_features(text)
    assert n and spam.spam_score(features)[0] >= 0.5


@pytest.mark.parametrize(
    "text",
    [PROSE * 3, PROSE + "\n".join(f"[{i}] Doe, A. (19{50 + i}). Some title of work. Letters, {i}({i}), 1-12." for i in range(30)), PROSE + "\n".join(f"{i}.1 Some title of a chapter ........ {i}" for i in range(1, 30)),
     PROSE + "\n".join(f"Town{i}\t{i}\t1.{i}\tThe value was noted." for i in range(30)), PROSE + "\n".join(f"host{i}.example was contacted {i} times; first seen in March 2020." for i in range(20)), "", None, "..."],
)
def test_genuine(text):
    n, *features = spam.page_features(text)
    assert not n or spam.spam_score(features)[0] < 0.5


def test_runs_and_coverage_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        words = [rng.choice(["aa", "bb", "the", "dd"]) for _ in range(rng.randrange(0, 40))]
        want, seen = [], [False] * (4 * len(words))
        for i in range(len(words)):
            n = next((n for n in range(i + 1, 0, -1) if any(words[j - n + 1 : j + 1] == words[i - n + 1 : i + 1] for j in range(n - 1, i))), 0)
            want.append(n)
            if any(w != "the" for w in words[i - n + 1 : i + 1]) and n:
                for at in range(spans(words)[i - n + 1][0], spans(words)[i][1]):
                    seen[at] = True
        assert spam.repeated_runs(words) == want
        assert spam.covered(words, spans(words)) == sum(seen)


def spans(words):
    out, at = [], 0
    for w in words:
        out.append((at, at + len(w)))
        at += len(w) + 1
    return out[: len(words)]


def test_each_measure_decides_some_labelled_pages():
    import numpy as np

    rows = spam.labelled_pages()
    x, y = np.array([spam.page_features(t)[1:] for t, _ in rows]), np.array([label for _, label in rows])
    wrong = [int(((spam.spam_score(x, without) >= 0.5) != y).sum()) for without in (-1, 0, 1)]
    assert wrong[0] <= 0.05 * len(y) and wrong[1] > wrong[0] and wrong[2] > wrong[0]
    assert spam.labelled_pages() == rows


def test_long_segments_and_capitals_that_grow():
    sentence = "the committee reviewed " + " ".join(f"what item{i} was in part{i} before" for i in range(200)) + " the rest"
    assert spam.page_features(sentence)[2] == 0.0
    assert spam.page_features("\u0130 " + PROSE)[0] > 10


def test_spam_on_tables(spark):
    df = spark.createDataFrame([(1, "dog bed cheap " * 30, 1), (1, "dog bed cheap " * 30, 1), (2, None, 1), (None, "dog bed cheap " * 30, 1), (3, PROSE, 1)], "doc_id long, text string, words int")
    assert [r["id"] for r in spam.spam_pages(df).collect()] == [1]
    assert spam.page_quality(df).count() == 5 and spam.spam_pages(df.limit(0)).count() == 0


# --- pages ---


def body(n):
    return f"The committee reviewed the report number {n} in March.\nIts find-\nings were published by the committee in the report later."


def test_page_noise(spark):
    pages = [f"Journal of Tests\n\n{body(i)}\n\n- {i} -" for i in range(1, 5)]
    pages[1] = pages[1].replace("published", "publlshed")
    pages[2] = pages[2].replace("find-\nings", "peer-\nreviewed")
    plain = [f"The committee published the findings of a peer-reviewed report and its findings in number {i}." for i in range(30)]
    rows = [(1, pages), (2, plain), (3, None), (4, []), (5, [None, ""]), (6, ["One line.\n\n12"])]
    df = spark.createDataFrame([(i, p, 1) for i, p in rows], "ocr_id long, page_markdowns array<string>, page_no int")
    got = {(r["id"], r["page_no"]): set(r["noise"]) for r in ocr_noise.repair_pages(df).collect()}
    assert got[1, 1] == {"running", "page_number", "hyphenated"}
    assert got[1, 2] == {"running", "page_number", "hyphenated", "misread"}
    assert got[1, 3] == {"running", "page_number"}
    assert not any(got[2, k] for k in range(1, 31)) and got[5, 1] == got[5, 2] == set() and got[6, 1] == {"page_number"}
    assert len(got) == 4 + 30 + 2 + 1
    text = {(r["id"], r["page_no"]): r["paragraphs"] for r in ocr_noise.repair_pages(df).collect()}
    assert text[1, 2] == ["The committee reviewed the report number 2 in March. Its findings were published by the committee in the report later."]
    assert ocr_noise.repair_pages(df, kinds_only=True).where("page_no > 4").count() == 0
    assert ocr_noise.repair_pages(df.limit(0)).count() == 0


def test_words_cut_at_the_page_end(spark):
    pages = ["The report was pub-\n\n1", "lished in the report and published again.\n\n2"]
    df = spark.createDataFrame([(1, pages), (2, ["It was published."] * 9)], "ocr_id long, page_markdowns array<string>")
    got = {(r["id"], r["page_no"]): r for r in ocr_noise.repair_pages(df).collect()}
    assert "hyphenated" in got[1, 1]["noise"] and "hyphenated" not in got[1, 2]["noise"] and got[1, 1]["paragraphs"] == ["The report was published"]


def test_texts_without_pages_are_repaired(spark):
    body = ["The committee reviewed the plan and the com-", "mittee reviewed the budget of the north.", "The comrnittee reviewed the survey again."]
    legacy = "\n\n".join(f"Journal of Plans\n{b}\n{i}" for i, b in enumerate(body, 7))
    rows = [(1, None, legacy), (2, ["The committee reviewed it."] * 200, "not read"), (3, [], None), (4, None, None), (5, [], "The committee."), (6, None, "In a registry.")]
    df = spark.createDataFrame(rows, "ocr_id long, page_markdowns array<string>, markdown string")
    got = {(r["id"], r["page_no"]): r for r in ocr_noise.repair_pages(df, text_col="markdown").collect()}
    assert sorted({k for k in got if k[0] != 2}) == [(1, None), (5, None), (6, None)]
    assert {k[1] for k in got if k[0] == 2} == set(range(1, 201))
    assert got[1, None]["noise"] == ["hyphenated", "misread", "page_number", "running"]
    assert got[1, None]["paragraphs"] == ["The committee reviewed the plan and the committee", "reviewed the budget of the north.", "The committee reviewed the survey again."]
    assert got[5, None]["paragraphs"] == ["The committee."] and got[6, None]["paragraphs"] == ["In a registry."]
    assert {r["id"] for r in ocr_noise.repair_pages(df).collect()} == {2}


def test_texts_without_pages_count_in_the_corpus(spark):
    df = spark.createDataFrame([(1, ["The comrnittee met."], None), (2, None, "The committee met. " * 200)], "ocr_id long, page_markdowns array<string>, markdown string")
    got = {r["id"]: r["paragraphs"] for r in ocr_noise.repair_pages(df, text_col="markdown").collect()}
    assert got[1] == ["The committee met."]


def tables(counts, pairs=(), shares=None):
    """Tables of known counts."""
    words, both = bytearray(ocr_noise.CELLS), bytearray(ocr_noise.CELLS)
    for word, n in counts.items():
        for at in ocr_noise._cells(ocr_noise._hash(word), ocr_noise.WORD_HASHES):
            words[at] = min(127, n)
    for a, b in pairs:
        for at in ocr_noise._cells(ocr_noise._pair_hash(ocr_noise._hash(a), ocr_noise._hash(b)), ocr_noise.PAIR_HASHES):
            both[at] = 100
    return ocr_noise.Tables(bytes(words), bytes(both), float(sum(counts.values())), (0.0, 0.0), shares or {})


def test_context_and_channel_decide():
    counts = {"farther": 100, "father": 100, "father5": 1, "lampe": 50, "lampc": 1, "larnpe": 40, "the": 120, "modern": 60, "modem": 60, "old": 90, "usb": 90} | {f"word{c}": 120 for c in "abcdefghijklmnop"}
    corpus = ocr_noise.Corpus(tables(counts, [("usb", "modem"), ("old", "modern")]))
    assert corpus.decode(["the", "lampc"]) == ["the", "lampe"]
    # both words are known: the word before tells which was printed
    certain = ocr_noise.Corpus(tables(counts, [("usb", "modem")], {("rn", "m"): 0.05}))
    assert certain.decode(["usb", "modern"]) == ["usb", "modem"] and certain.decode(["old", "modern"]) == ["old", "modern"]
    # and the channel: what is hardly ever misread so stays
    rare = ocr_noise.Corpus(tables(counts, [("usb", "modem")], {("rn", "m"): 1e-7}))
    assert rare.decode(["usb", "modern"]) == ["usb", "modern"]


def test_shares_follow_what_was_seen():
    seen = {("rn", "m"): (900.0, 1e6), ("c", "e"): (10.0, 1e6), ("q", "g"): (0.0, 10.0)}
    p = ocr_noise.shares_of(seen)
    assert p["rn", "m"] > 1.5 * ocr_noise.P_CONFUSION > 5 * p["c", "e"] and abs(p["q", "g"] / ocr_noise.P_CONFUSION - 1) < 0.1
    assert ocr_noise.shares_of({}) == {}


def test_full_tables_say_nothing():
    t = tables({"the": 100})
    full = t._replace(words=bytes(b"\x64" * ocr_noise.CELLS), pairs=bytes(b"\x64" * ocr_noise.CELLS), noise=(100.0, 100.0))
    corpus = ocr_noise.Corpus(full)
    assert corpus.count("any") == 0 and corpus.pair("any", "word") == 0 and corpus.decode(["tbe", "old"]) == ["tbe", "old"]


def test_running_lines_of_any_number_and_length():
    long = "A long running line " + "of many words " * 20
    pages = [f"Journal of Tests\nVolume two\n{long}\nBody {word} here.\nMore {word}.\nIts {word}.\nThe {word}." for word in ("one", "two", "three", "four")]
    assert all(p.running == {0, 1, 2} for p in ocr_noise.page_structure(pages))


def test_entities_are_no_words():
    assert ocr_noise.page_words("a &lt; b&amp;c") == ["a", "b", "c"]
    corpus = ocr_noise.Corpus(tables({"it": 120}))
    assert ocr_noise._fix_line("if x &lt; 3", corpus) is None
