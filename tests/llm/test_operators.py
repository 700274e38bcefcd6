import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagewright.llm import looks, packing, pieces, scans, sentences, splits, tokens, truncation

CLASH = "k bigint, text string, key string, t string, n string, tokens string, piece string, h string"


def frame(spark, texts, schema="k bigint, text string"):
    """Rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)], CLASH)


ODD = [None, "", " \n ", "a", "a", "é" * 5, "<|endoftext|> x", "日本語。" * 3, "x" * 30_000, "word " * 9_000, "퟿\x00\x1b🙂‍👩", "  lead and trail  "]


# --- 6: encoding
def test_ids_are_those_of_the_public_encoder(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    rng = random.Random(5)
    more = ["".join(rng.choice("ab 'stréđ日本 12\n\t.-!") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    got = {r["k"]: r["ids"] for r in tokens.encode(frame(spark, ODD + more), "k", "text").collect()}
    for i, x in enumerate(ODD + more):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), repr(x)[:60]
    n = {r["k"]: r["tokens"] for r in tokens.token_counts(frame(spark, ODD), "k", "text").collect()}
    assert n == {i: len(got[i]) for i in range(len(ODD))}
    assert tokens.encode(frame(spark, ["x"]).filter("k > 9"), "k", "text").count() == 0


# --- 7: packing
def test_packing_splits_only_what_must_be_and_wastes_little(spark):
    rng = random.Random(2)
    sizes = [rng.randint(0, 600) for _ in range(800)] + [4096, 4097, 9000, None, 0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k bigint, n int")
    caps = [512, 1024, 2048, 4096]
    rows = packing.pack(df, "k", "n", packing.default_costs(caps), shard_items=300).collect()
    whole = {}
    for r in rows:
        whole[r["k"]] = whole.get(r["k"], 0) + r["tokens"]
        assert r["pieces"] == max(1, -(-(sizes[r["k"]] or 0) // 4096))
    assert whole == {i: s or 0 for i, s in enumerate(sizes)}
    used = {}
    for r in rows:
        used.setdefault((r["container"], r["capacity"]), 0)
        used[r["container"], r["capacity"]] += r["tokens"]
    assert all(u <= c and c in caps and not any(x >= u for x in caps if x < c) for (_, c), u in used.items())
    assert sum(c for _, c in used) - sum(used.values()) < 0.02 * sum(used.values())
    assert sorted(r["k"] for r in packing.split_keys(packing.pack(df, "k", "n", packing.default_costs(caps)), "k").collect()) == [801, 802]
    assert packing.pack(df.filter("k < 0"), "k", "n", packing.default_costs(caps)).count() == 0


# --- 4: sentences
CASES = [
    ("Dr. Orvane left at 9 p.m. The gate of Dravex Co. closes. See Fig. 8, vs. 2,505 (p. 3).", [0, 26, 57]),
    ("He paid No. 13,877. 42 came by tab3.v2.pdf. Mr. J. K. Ostrel failed... but rose.", [0, 20, 44]),
    ("Staff asked, “Is it safe? Who will see?” and left. “It will reopen.” That was all.", [0, 51, 69]),
    ("Heading\n\nText goes\non here. 2nd", [0, 9, 28]),
    ("「十分か？」との質問に「はい！」と答えた。「再開します。」これが発表だった。がんばる人の12.5度。", [0, 21, 29, 38]),
    ("Báo cáo của PGS. TS. Lam tại TP. Yên, P. 12, Q. 7. Lần đầu không thành... nhưng đã xong. “Mở lại.” Đó là v.v. và hết.", [0, 51, 89, 99]),
    ("更新…という計画は延期された！\r\n\r\n次", [0, 19]),
    ("  a. B", [2, 5]),
]


def test_sentences(spark):
    df = frame(spark, [c[0] for c in CASES] + [None, "", " \n　"])
    got = {r["k"]: r["s"] for r in df.select("k", sentences.sentences(F.col("text")).alias("s")).collect()}
    for i, (t, want) in enumerate(CASES):
        assert [s["start"] for s in got[i]] == want, t
        assert all(s["sentence"] == t[s["start"] : s["end"]].strip() for s in got[i])
        assert "".join("".join(s["sentence"].split()) for s in got[i]) == "".join(t.split())
    assert [got[i] for i in range(len(CASES), len(CASES) + 3)] == [[], [], []]
    s = df.select("k", sentences.starts(F.col("text")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in s} == {k: [x["start"] for x in v] for k, v in got.items()}


# --- 1: pieces
def test_pieces_tile_the_text_and_keep_the_limit(spark):
    rng = random.Random(3)
    texts = [None, "", "short", "x" * 130, "é" * 90, "a b " * 60, ("One two. " * 5 + "\n\n") * 6, "日本語の文です。" * 20]
    texts += ["".join(rng.choice(["word", " ", ". A", "\n\n", "語", "。"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    rows = {}
    for r in pieces.split_oversized(frame(spark, texts), "k", "text", 60, 10).collect():
        rows.setdefault(r["k"], []).append(r)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ps = sorted(rows[i], key=lambda r: r["piece"])
        if t is None:
            assert ps[0]["piece_text"] is None
            continue
        assert "".join(p["piece_text"][p["core_start"] - p["start"] :] for p in ps) == t
        assert all(len(p["piece_text"]) <= 60 for p in ps) and (ps[0]["boundary"] is None) == (len(t) <= 60)
        assert all(p["core_start"] - p["start"] == min(10, p["core_start"]) for p in ps[1:])
    kinds = [rows[i][0]["boundary"] for i in (3, 5, 6, 7)]
    assert kinds == ["none", "space", "paragraph", "sentence"]
    with pytest.raises(ValueError):
        pieces.split_oversized(frame(spark, []), "k", "text", 10, 5)


# --- 3: looks
def test_looks(spark):
    texts = ["Paris opened", "Pаris opened", "Paris​ opened", "Ｐaris opened", "Paris Opened", "Pâris opened", "カード端末", "力ード端末", "ｶｰﾄﾞ端末", "カート端末", None, "", "​", "МН-24", "MH-24", "ход времени", "Paris opened"]
    df = frame(spark, texts)
    form = {r["k"]: r for r in looks.canonical(df, "text", ["k"]).collect()}
    c = {i: form[i]["canonical"] for i in form}
    assert c[0] == c[1] == c[2] == c[3] == "Paris opened" and c[4] == "Paris Opened" and c[5] == "Pâris opened"
    assert c[6] == c[7] == c[8] != c[9] and c[13] == c[14] and c[15] == "ход времени"
    assert c[10] is None and c[11] == "" and form[12]["digest"] is None
    rows = looks.canonical(df.withColumn("d", F.lit("d")).withColumn("s", F.xxhash64("text")), "text", ["d", "k", "s"], keep_text=False).filter("digest is not null")
    pairs = {(r["key_a"], r["key_b"]) for r in looks.same_look_pairs(rows, ["d"], "k", "s").collect()}
    keys = [i for i in range(len(texts)) if texts[i] and form[i]["digest"] is not None]
    assert pairs == {(a, b) for a in keys for b in keys if a < b and c[a] == c[b] and texts[a] != texts[b]}
    assert looks.canonical(df.filter("k < 0"), "text", ["k"]).count() == 0


# --- 2: splits
def test_components_against_union_find(spark):
    rng = random.Random(4)
    spell = [lambda s: s, str.upper, lambda s: f" {s}\n", lambda s: s.replace("_", "-"), lambda s: f"train_pdfs/{s}.pdf", lambda s: unicodedata.normalize("NFKC", s).translate({ord(c): ord(c) + 0xFEE0 for c in s if c != "_"})]
    rows = []
    for i in range(400):
        d = rng.choice([None, "N/A", "", *[rng.choice(spell)(f"j_{rng.randint(0, 150):07}") for _ in range(9)]])
        q = rng.choice([None, " na ", *[f"q-{rng.randint(0, 250):09}" for _ in range(9)]])
        rows.append((i, d, q, "x"))
    rows += [(1000 + i, f"r_{i:07}", f"q-{9000 + i // 2 * 2 + 1:09}", "x") for i in range(40)] + [(2000 + i, f"r_{i + 1:07}", f"q-{9000 + i // 2 * 2 + 1:09}", "x") for i in range(40)]
    df = spark.createDataFrame(rows + rows[:20], "id bigint, document string, question string, c string")
    members = splits.components(df, "id", "document", "question").collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    ids = {r["id"]: (r["document"], r["question"]) for r in members}
    for i, (d, q) in ids.items():
        for v in (d and ("0", d), q and ("1", q)):
            if v:
                parent[root(("2", i))] = root(v)
    least = {}
    for i, (d, q) in ids.items():
        names = ["0" + d] if d else ["1" + q] if q else [f"2{i}"]
        least[root(("2", i))] = min([*names, *([least[root(("2", i))]] if root(("2", i)) in least else [])])
    assert len(members) == len(rows)
    assert all(r["component"] == least[root(("2", r["id"]))] for r in members)
    shares = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    got = splits.split_records(spark.createDataFrame(members), "id", shares).collect()
    by = {}
    for r in got:
        by.setdefault(r["component"], set()).add(r["split"])
    assert len(got) == len(rows) and all(len(v) == 1 for v in by.values())
    largest = max(sum(r["component"] == c for r in got) for c in by)
    assert abs(sum(r["split"] == "train" for r in got) / len(got) - 0.8) <= max(0.05, largest / len(got))
    empty = splits.components(df.filter("id < 0"), "id", "document", "question")
    assert splits.split_records(empty, "id", shares).count() == 0


def test_differencing_balances():
    rng = random.Random(6)
    histogram = [(w, rng.randint(1, 300)) for w in range(1, 60)]
    sums, rest = splits.difference_bins(histogram, 10)
    assert sum(sums) == sum(w * m for w, m in histogram) and max(sums) - min(sums) <= 3
    assert all(len(rest.get(w, [])) == m % 10 for w, m in histogram)


# --- 8: truncation
def test_truncated_texts_are_found(spark):
    rng = random.Random(7)
    say = ["The water meter was checked in May 20{}. ", "According to Dr. Orvane the level fell by {} percent. ", "The gate closes at {} p.m. ", "Operating costs rose to {} crowns. "]
    rows, cut = [], set()
    for i in range(1500):
        t = "".join(rng.choice(say).format(rng.randint(10, 99)) for _ in range(rng.randint(4, 14))).strip()
        if i % 9 == 0:
            end = rng.randint(60, len(t) - 12)
            while t[end - 2 : end] in (". ", "m.", "r.") or t[end - 1] in ". ":
                end -= 1
            t, _ = t[:end] + rng.choice(["", "…", " [...]"]), cut.add(i)
        elif i % 10 == 0:
            t += "\n\nEnd of record"
        rows.append((i, t, rng.choice(["en", "EN", None]), f"s{i % 7}" if i % 5 else None))
    rows += [(5000, rows[9][1], "en", "s1"), (5001, None, None, "s1"), (5002, "", "en", "s1"), (5003, " \n", "en", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string, source string").withColumn("key", F.lit("x")).withColumn("tail", F.lit("x"))
    out = truncation.find_truncated(df, "id", "text", "lang", "source")
    got = {r["id"]: r["truncated"] for r in out.collect()}
    assert len(got) == len(rows) and not any(got[i] for i in (5001, 5002, 5003)) and got[5000] == got[9]
    found = {i for i, x in got.items() if x and i < 5000}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.95
    rates = {r["source"]: r["documents"] for r in truncation.truncation_rates(out).collect()}
    assert sum(rates.values()) == len(rows) and None in rates
    assert truncation.find_truncated(df.filter("id < 0"), "id", "text", "lang", "source").count() == 0


# --- 5: scans
def test_scanned_pages(spark):
    body = ["The temperature of the water meter stayed between 15 and 27 degrees during May. An inventory of the store was handed to the committee in the spring.", "Management of the programme recommended additional documentation for the water meter and the committee approved the inventory of the water meter."]
    rows = [(i, f"d{i % 7}", " ".join(body), "ok", "native") for i in range(60)]
    page = "Annual report 2020\n\nThe temperature of the watcr meter stayed bet-\nween 15 and 27 degrees during May. An in–\nventory of the store was handed to the committce\nin the spring.\n\nManagement of the programme recommended addi­\ntional documentation for the water meter.\n- {} -"
    rows += [(100 + i, "d0", page.format(i + 1), "ok", "ocr") for i in range(3)]
    rows += [(200, "d0", None, "textless", "ocr"), (201, "d0", "stray", " Textless", "ocr"), (202, "d1", "", "ok", "ocr"), (203, None, "The water meter.", None, "ocr"), (100, "d0", page.format(1), "ok", "ocr")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, d string, t string, s string, o string, key string")
    got = {r["page_id"]: r for r in scans.read_scans(df, "page_id", "d", "t", "s", "o").collect()}
    assert sorted(got) == [100, 101, 102, 200, 201, 202, 203]
    for i in range(100, 103):
        found = {(f["line_no"], f["kind"]) for f in got[i]["found"]}
        assert found == {(1, "header"), (3, "misread"), (3, "hyphen"), (4, "hyphen"), (5, "misread"), (8, "hyphen"), (10, "page_number")}
        first, second = got[i]["repaired"].split("\n\n")
        assert first == "The temperature of the water meter stayed between 15 and 27 degrees during May. An inventory of the store was handed to the committee in the spring."
        assert second == "Management of the programme recommended additional documentation for the water meter."
    assert [got[i]["repaired"] for i in (200, 201, 202)] == ["", "", ""] and got[203]["repaired"] == "The water meter."
    assert scans.read_scans(df.filter("page_id < 0"), "page_id", "d", "t", "s", "o").count() == 0


def test_own_hyphens_and_numbers_stay():
    assert scans.page_number("- 12 -", False) and scans.page_number("Trang 5/ll", False) and scans.page_number("7", True) and scans.page_number("３ページ", False)
    assert not scans.page_number("7", False) and not scans.page_number("2018.", True) and not scans.page_number("19,341", True) and not scans.page_number("", True)
    assert scans.line_key("Zel1mark report 2O18 |") == scans.line_key("ZELLMARK REPORT 2018")


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    from pagewright.llm import splits

    written = []
    real = splits.materialize
    monkeypatch.setattr(splits, "materialize", lambda df, name="t": written.append(name) or real(df, name))
    n = 10_000
    rows = [(2 * i, f"d{i:05d}", f"q{i:05d}") for i in range(n)] + [(2 * i + 1, f"d{i + 1:05d}", f"q{i:05d}") for i in range(n)] + [(-1, "x", None), (-2, None, "y"), (-3, None, None), (-4, None, "q00007")]
    got = {r["r"]: r["component"] for r in splits.components(spark.createDataFrame(rows, "r bigint, d string, q string"), "r", "d", "q").collect()}
    assert {got[k] for k in got if k >= 0} == {"0d00000"} and len(got) == 2 * n + 4
    assert (got[-1], got[-2], got[-3], got[-4]) == ("0x", "1y", "2-3", "0d00000")
    assert written.count("live") <= 20


def test_capacities_are_chosen_jointly():
    import random

    from pagewright.llm import packing

    caps, rng = (512, 1024, 2048, 4096), random.Random(4)
    for sizes in ([rng.randint(300, 500) for _ in range(400)], [rng.choice([700, 1500, 2040, 4000]) for _ in range(300)], [min(4096, int(rng.expovariate(1 / 600))) for _ in range(3000)], [0, 0], []):
        for costs in (packing.default_costs(caps), {c: c + c * c / 1024 for c in caps}, {512: 600.0, 1024: 900.0, 2048: 2300.0, 4096: 5000.0}):
            where, got = packing.best_fit(sizes, costs)
            used = {b: sum(s for s, w in zip(sizes, where) if w == b) for b in set(where)}
            assert len(used) == len(got) and all(used[b] <= got[b] for b in used)
            alone = packing._fill(sizes, {4096: costs[4096]})[1]
            assert sum(costs[c] for c in got) <= sum(costs[4096] for _ in alone)
            if len(sizes) > 2 and costs[4096] > 4200:
                assert sum(costs[c] for c in got) < 0.97 * sum(costs[4096] for _ in alone) and len(set(got)) > 0
    sizes = [rng.choice([2040, 2048, 1100, 900, 4090]) for _ in range(500)]
    got = packing.best_fit(sizes, packing.default_costs(caps))[1]
    assert len(set(got)) > 1 and sum(got) < 4096 * len(packing._fill(sizes, {4096: 1.0})[1])


def test_look_alikes_go_to_the_tokens_own_script(spark):
    from pagewright.llm import looks

    rows = [(1, "мама пела дома"), (2, "мaма пела дома"), (3, "the scope of it"), (4, "the ѕсоре of it"), (5, "the sсope of it"), (6, "Αθήνα είναι"), (7, "Aθήνα είναι"), (8, "切り替え"), (9, "切リ替え"), (10, "切り替えと切り替えは"), (11, "a мaмa unseen"), (12, None), (13, ""), (14, "the scope")]
    forms = looks.canonical(spark.createDataFrame([(k, "d", k, t) for k, t in rows], "k bigint, doc string, stored bigint, t string"), "t", ["k", "doc", "stored"])
    got = {r["k"]: r["canonical"] for r in forms.collect()}
    assert got[2] == got[1] == rows[0][1] and got[4] == got[5] == got[3] and got[7] == got[6] and got[9] == got[8] and got[11] == "a мама unseen" and got[12] is None and got[13] == ""
    keyed = forms.filter("digest is not null")
    pairs = sorted((r["key_a"], r["key_b"]) for r in looks.same_look_pairs(keyed, ["doc"], "k", "stored").collect())
    assert pairs == [(1, 2), (3, 4), (3, 5), (4, 5), (6, 7), (8, 9)]
    classes = {r["k"]: (r["class_id"], r["members"], r["spellings"]) for r in looks.look_classes(keyed, ["doc"], "k", "stored").collect()}
    assert classes[5] == (3, 3, 3) and classes[10] == (10, 1, 1) and len(classes) == 12
