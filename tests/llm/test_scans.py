"""Problem 5, further cases."""

from pagewright.llm import scans


def found(spark, rows, titles=None, schema="page_id bigint, d string, t string, s string, o string"):
    df = spark.createDataFrame([(*r, "ok", "ocr") for r in rows], schema)
    t = spark.createDataFrame(titles, "document string, title string") if titles else None
    return {r["page_id"]: r for r in scans.read_scans(df, "page_id", "d", "t", "s", "o", t).collect()}


def test_a_running_line_may_be_the_widest_of_its_page(spark):
    header = "Results by site and by year of the survey | Wexford Meter Survey"
    bodies = ["Alpha 3\nBeta 4\nGamma 9", "Delta 1\nEta 22\nTheta 6", "Iota 5\nKappa 7\nLambda 8", "Pi 3\nRho 2\nTau 1"]
    rows = [(i, "d", f"{header}\n{b}") for i, b in enumerate(bodies)]
    # A line of the text that comes again, as wide as the text and not always outermost, stays.
    again = "the committee of the harbour gave to the town all of the meters it"
    wide = [f"{again}\n{x} had kept in the store of the harbour since that year\n{x} and it asked for more of them in summer and autumn too" for x in ("ash", "birch", "cedar", "elm")]
    wide[1] = "first of all and before the town had any word of what was to come\n" + wide[1]
    wide[2] = "then again and after the town had many words of what was to be\n" + wide[2]
    got = found(spark, rows + [(10 + i, "e", t) for i, t in enumerate(wide)], [("d", "Wexford Meter Survey"), ("e", "Quay ledger")])
    for i in range(4):
        assert [(f["line_no"], f["kind"]) for f in got[i]["found"]] == [(1, "header")] and "Wexford" not in got[i]["repaired"]
        assert "header" not in {f["kind"] for f in got[10 + i]["found"]} and again in got[10 + i]["repaired"]


def test_words_are_parted_and_merged_jointly(spark):
    body = "the water meter of the town showed together with the committee what của nhà people had in the store. "
    df = spark.createDataFrame([(i, "n", body * 5, "ok", "native") for i in range(40)] + [(100, "d", "the watermeter of the to\ngether with the com mittee and củanhà thewatcr meter in to the store", "ok", "ocr"), (101, "d", "Zelk had the meter of Tanaka in the store", "ok", "ocr")], "page_id bigint, d string, t string, s string, o string")
    got = {r["page_id"]: r for r in scans.read_scans(df, "page_id", "d", "t", "s", "o").collect()}
    assert got[100]["repaired"] == "the water meter of the together with the committee and của nhà the water meter in to the store"
    assert [(f["line_no"], f["kind"]) for f in got[100]["found"]] == [(2, "misread")]
    assert got[101]["repaired"] == "Zelk had the meter of Tanaka in the store"


def test_a_page_delivered_twice_counts_once(spark):
    lines = ["Heading of one page\nthe text of a page that is long enough", "Other words here\nsome more of the text that is long as well"]
    rows = [(0, "d", lines[0]), (0, "d", lines[0]), (1, "d", lines[1])]
    got = found(spark, rows)
    assert sorted(got) == [0, 1] and not got[0]["found"] and not got[1]["found"]


def test_stray_spaces_hyphens_and_confusions_are_one_choice(spark):
    body = "The government announced a programme of state-run harbours; the year-on-year report came together with all. "
    rows = [(i, "n", body * 4, "ok", "native") for i in range(60)]
    rows += [(100, "d", "The gov ernment announced a pro gramme\nof state-\nrun harbours; the year-on-\nyear re-\nport cam\ne with all", "ok", "ocr"), (101, "d", "thegov crnment of the harb-\nours", "ok", "ocr")]
    df = spark.createDataFrame(rows, "page_id bigint, d string, t string, s string, o string")
    got = {r["page_id"]: r for r in scans.read_scans(df, "page_id", "d", "t", "s", "o").collect()}
    assert got[100]["repaired"] == "The government announced a programme of state-run harbours; the year-on-year report came with all"
    assert [(f["line_no"], f["kind"]) for f in got[100]["found"]] == [(4, "hyphen")]
    assert got[101]["repaired"] == "the government of the harbours"
    assert [(f["line_no"], f["kind"]) for f in got[101]["found"]] == [(1, "hyphen"), (1, "misread")]


def test_characters_are_decoded_with_their_neighbours(spark):
    body = "エレベーターとコンテナの点検を二度確認した。人が入口に日本で参加した。"
    rows = [(i, "j_1", body * 3, "ok", "native") for i in range(40)] + [(100, "j_2", "エレべ一夕一とユンテナの点\n検を二度確認した。入が人口に曰本で参加した。", "ok", "ocr")]
    df = spark.createDataFrame(rows, "page_id bigint, d string, t string, s string, o string")
    got = {r["page_id"]: r for r in scans.read_scans(df, "page_id", "d", "t", "s", "o").collect()}
    assert got[100]["repaired"] == "エレべーターとコンテナの点検を二度確認した。人が入口に日本で参加した。"


def test_clusters_are_the_best_of_all_paths():
    import math
    import random
    from itertools import product

    rng = random.Random(5)
    for _ in range(60):
        key = "".join(rng.choice("一ニ二ロ口カ力あい") for _ in range(rng.randint(5, 9)))
        inner = range(2, len(key) - 2)
        options = [scans.FORMS.get(c, [c]) if i in inner else [c] for i, c in enumerate(key)]
        counts = {"\t" + "".join(x): rng.choice([0, 0, 3, 40, 900]) for i in range(len(key) - 2) for x in product(*options[i : i + 3])}
        reader = scans.Reader(counts, 1000)

        def score(path):
            changed = sum(a != b for a, b in zip(key, path))
            return sum(math.log(1 + sum(counts["\t" + path[j : j + 3]] for j in (i - 2, i - 1, i))) for i in inner if key[i] in scans.FORMS) - changed * math.log(scans.CHAR_RATIO)

        best = max(score("".join(p)) for p in product(*options))
        assert abs(score(key[:2] + reader.cluster(key) + key[-2:]) - best) < 1e-9


def test_paragraphs_are_those_of_the_whole_search():
    import math
    import random

    rng = random.Random(3)
    for _ in range(40):
        lines = [rng.choice(["", "a line of the usual width here", "short end.", "a line that ends a sentence now."]) for _ in range(rng.randint(1, 40))]
        spans = scans.paragraphs(lines, lines)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == len(lines)
    long = ["the words of one sentence that goes on and on over the lines"] * 400
    assert scans.paragraphs(long, long) == [(0, 400)]


def test_bit_sets_never_change_a_result(spark, monkeypatch):
    body = "the water meter of the town showed together with the committee what people had in the store. "
    rows = [(i, "n", body * 5, "ok", "native") for i in range(40)] + [(100, "d", "the watermeter of the to\ngether with the com mittee and thewatcr meter in to the store", "ok", "ocr")]
    df = spark.createDataFrame(rows, "page_id bigint, d string, t string, s string, o string")
    get = lambda: sorted((r["page_id"], str(r["found"]), r["repaired"]) for r in scans.read_scans(df, "page_id", "d", "t", "s", "o").collect())
    whole = get()
    monkeypatch.setattr(scans, "LEAST_BITS", 6)
    monkeypatch.setattr(scans, "MOST_BITS", 6)
    monkeypatch.setattr(scans, "LOT_PAGES", 1)
    assert get() == whole


def test_empty_tables_and_nulls_have_results(spark):
    schema = "page_id bigint, d string, t string, s string, o string"
    assert scans.read_scans(spark.createDataFrame([], schema), "page_id", "d", "t", "s", "o").count() == 0
    rows = [(1, None, "a b", None, None), (2, None, None, "ok", "ocr"), (3, None, "x\ny", "ok", "OCR "), (4, "d", "text", "textless", "ocr")]
    got = {r["page_id"]: (r["repaired"], list(r["found"])) for r in scans.read_scans(spark.createDataFrame(rows, schema), "page_id", "d", "t", "s", "o").collect()}
    assert got == {2: ("", []), 3: ("x y", []), 4: ("", [])}


def read_beside(spark, body, pages, times=40):
    """What scanned pages read as, and their found lines, beside a body that native pages hold."""
    rows = [(i, "n", body, "ok", "native") for i in range(times)] + [(1000 + i, "d", t, "ok", "ocr") for i, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, d string, t string, s string, o string")
    got = {r["page_id"]: r for r in scans.read_scans(df, "page_id", "d", "t", "s", "o").collect()}
    return [(got[1000 + i]["repaired"], [(f["line_no"], f["kind"]) for f in got[1000 + i]["found"]]) for i in range(len(pages))]


def test_words_begin_and_end_anywhere_and_span_any_number_of_tokens(spark):
    body = "the water meter of a town showed the committee what a government had in the store. " * 5
    pages = ["Here the c om mit tee had a go ver nm e nt in the store", "Now ameter of the town"]
    # What comes again is no rare word, and parts of usual words are looked at as well.
    again = ["the watermeter of a town", "the com mittee had a meter", "had th emeter in the store", "the gov crnment had a store", "water mete rof a town"]
    pages += [f"{x} {t}" for t in again for x in ("Ash", "Birch", "Cedar")]
    got = read_beside(spark, body, pages)
    assert [t for t, _ in got[:2]] == ["Here the committee had a government in the store", "Now a meter of the town"]
    whole = ["the water meter of a town", "the committee had a meter", "had the meter in the store", "the government had a store", "water meter of a town"]
    assert [t for t, _ in got[2:]] == [f"{x} {t}" for t in whole for x in ("Ash", "Birch", "Cedar")]
    assert [f for _, f in got] == [[(1, "misread")] if "crnment" in t else [] for t in pages]


def test_usual_words_are_merged_and_parted_only_as_the_corpus_bears_out(spark):
    body = "any one of all may go in to the hall; anyone may; a notable man has no table. We cannot, or can not, go into it. " * 5
    pages = [f"{x} has no table and any one may go in to the hall or into it but {y} cannot" for x in ("Ash", "Birch") for y in ("elm", "fir")]
    assert [t for t, _ in read_beside(spark, body, pages)] == pages
    # By chance alone the corpus would have these two words in a row as often.
    body = "we had no chairs. A table was there. No one saw it. The table fell. " * 6 + "a notable man. " * 15
    assert read_beside(spark, body, ["They had no table there"])[0][0] == "They had no table there"


def test_long_words_are_looked_at_for_two_confusions(spark):
    word = "ei" + "cl" * 22
    assert read_beside(spark, f"the {word} of it. " * 5, [f"the cl{word[2:]} of it"]) == [(f"the {word} of it", [(1, "misread")])]


def test_what_a_word_is_misread_for_has_its_skeleton(spark):
    from pyspark.sql import functions as F

    for a, b in scans.CONFUSIONS:
        assert scans.skeleton(f"x{a}y") == scans.skeleton(f"x{b}y")
    words = [w for pair in scans.CONFUSIONS for w in pair if w.isalpha()] + ["government", "được", "mười", "cldđrn"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", scans._skeleton_column(F.col("w")).alias("s")).collect()
    assert [(r["w"], r["s"]) for r in rows] == [(w, scans.skeleton(w)) for w in words]


def test_very_long_words_and_rows_of_letters_are_read():
    word = "abcdefgilmnortu" * 400
    counts = {"the": 5000, "of": 4000, "meter": 300, word: 2}
    reader = scans.Reader(counts, 100_000)
    assert max(map(len, reader.starts)) <= scans.BEGIN
    for text, read in ((f"the {word[:900]} {word[900:]} of", f"the {word} of"), ("m e t e r of " * 500, "meter of " * 500)):
        assert " ".join(w for w in reader.spaced([text])[0][0] if w) == read.strip()


def test_what_is_done_by_page_or_character_is_what_is_done_by_line():
    import random
    import unicodedata

    rng = random.Random(7)
    letters = "aeirnmlcfot0158 .,:'  đươÐéß・ー一口力ﾊﾞが（）１２Ａ①㌔½²¨´゙́​­﻿ᄀ가힣Ａ‐−ʼ|!@"
    for _ in range(1500):
        lines = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        text = rng.choice(["\n", "\r\n", "\r"]).join(lines)
        assert scans._by_characters(text, scans.fold) == scans.fold(text)
        assert scans._by_characters(text, scans._nfkc) == unicodedata.normalize("NFKC", text)
        assert scans._line_keys(lines) == [scans.line_key(x) for x in lines]
        assert [w for t in text.split() for w in scans._word.findall(scans._plain(t))] == scans._word.findall(scans._plain(text))


def test_rows_of_words_are_looked_at_once():
    from collections import Counter

    calls = []

    class Counted(scans.Needs):
        def beside(self, a, b):
            calls.append((a, b))
            return super().beside(a, b)

    needs = Counted(scans.Bits(b"\xff" * 8), scans.Bits(b"\0" * 8))
    for _ in range(3):
        needs.phrases(["the water meter of the town"] * 5, Counter())
    assert len(calls) == len(set(calls))
