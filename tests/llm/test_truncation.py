"""Problem 8, further cases."""

import random

from pagewright.llm import truncation


def test_copies_that_say_another_language_are_kept(spark):
    rng = random.Random(5)
    say = ["The water meter was checked in May 20{}. ", "The gate closes at {} p.m. ", "Operating costs rose to {} crowns. "]
    texts = ["".join(rng.choice(say).format(rng.randint(10, 99)) for _ in range(6)).strip() for _ in range(400)]
    texts[3] = texts[3][: texts[3].rindex("e") - 1] + "…"
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(1000 + i, texts[i], "eng" if i % 2 else "ja", "s") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string, source string")
    got = {r["id"]: r for r in truncation.find_truncated(df, "id", "text", "lang", "source").collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for i in range(20):
        assert [got[1000 + i][c] for c in ("lang", "log_odds", "threshold", "truncated")] == [got[i][c] for c in ("lang", "log_odds", "threshold", "truncated")] and got[i]["lang"] == "en"


def test_an_end_that_very_many_texts_share_has_odds(spark):
    texts = [f"Meter {i} was read in the north hall, as filed under no.{i}§" for i in range(3000)] + [f"The gate of hall {i} closes at nine." for i in range(50)]
    rows = [(i, t[:-1] + "§" * 8 if i < 3000 else t, "en", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string, source string")
    got = truncation.find_truncated(df, "id", "text", "lang", "source").collect()
    assert len(got) == len(texts) and all(r["log_odds"] is not None for r in got) and not any(r["truncated"] for r in got if r["id"] < 3000)
