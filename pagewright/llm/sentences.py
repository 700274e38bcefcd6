"""Problem 4: sentences of Japanese, Vietnamese and English texts, all in SQL expressions.

Method: a view of the text of equal length is made (look-alike letters as Latin ones, half-width marks as usual ones);
dots of decimals, URLs, file names, initials and abbreviations and the inner marks of quotations become private-use
placeholders; a separator is then put after what the terminator pattern of the script matches, and the view is split
there. As each placeholder stands for one character, the pieces' lengths are positions in the stored text, from which
sentences are cut, so that masked characters come back as they were stored.

Defined results: a null, empty or blank text has no sentence. Sentences come in order, don't overlap and leave out white
space only. Positions are 0-based code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOT, LEADER, SEP = "", "", ""
#: White space, line ends and characters without width, as Java character classes or patterns.
BLANK = r"\t    -   　"
SPACE = rf"[\s{BLANK}]"
TRIMMED = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
LINE_END = r"[\n\r\x0B\f\x85  ](?:(?<=\r)\n)?+"
#: Where LOOKS and WIDE, half-width marks and private-use characters lie: a few ranges, as classes are searched range by range.
ODD = "\u0370-\u052f０-９Ａ-Ｚａ-ｚ｡-｣\ue000-\ue0ff"
NO_WIDTH = r"­​-‍⁠﻿"
#: Greek and Cyrillic letters, and the Latin ones that they look like.
LOOKS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοАВЕКМНОРСТХаеорсухѕіјΙԁ"
LATIN = "ABEZHIKMNOPTYXoABEKMHOPCTXaeopcyxsijId"
#: Half-width marks and full-width letters and digits, as usual ones.
WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
USUAL = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
#: Abbreviations that a name follows, that a number or code follows, and that never end a sentence.
TITLES = "Dr Mr Mrs Ms Prof Capt Col Gen Lt Sgt Rev Hon St Jr Sr ThS TS PGS GS BS KS TP Tp".split()
NUMBERED = "No № Nos Nr Fig Figs Tab Sec Secs Eq Vol Ch Art p pp tr P Q Tx Đ H".split()
INNER = ["vs", "cf", "approx", r"i\.e", r"e\.g"]
#: Closing marks, and Japanese words by which a sentence goes on after a quotation.
CLOSERS, QUOTES = "”’」』）)\\]\"'", "“”「」『』"
GOES_ON = "と(?!くに|ころ|きに|もに)|って|など|を|の(?!ち)|に(?!わか)|も(?!し|ちろん)|、|，|,"


def _words(words: list[str]) -> str:
    """An alternation of words, longest first, whose letters may have a character without width between them."""
    return "|".join(f"[{NO_WIDTH}]?".join(re.findall(r"\\?.", w)) for w in sorted(words, key=lambda w: (-len(w), w)))


def _re(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _if_any(v: Column, chars: str, then: Callable[[Column], Column]) -> Column:
    """then(v) where v holds one of the characters, else v."""
    return _let(v, lambda x: F.when(x.rlike(f"[{chars}]"), then(x)).otherwise(x))


def _view(text: Column) -> Column:
    """The text with equal length and few kinds of characters; private-use characters of the text are masked first."""
    odd = LOOKS + WIDE + "｡｢｣" + DOT + LEADER + SEP
    return _if_any(text, ODD, lambda t: F.translate(t, odd, LATIN + USUAL + "。「」" + "�" * 3))


def _after(words: str) -> str:
    """Behind a dot: one of the words, as a whole word, stands before the dot. So the search is for dots."""
    return rf"(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{words})\.)"


def _latin(v: Column) -> Column:
    """Masks, then separators, for scripts with spaces."""
    v = _re(v, r"\.(?:(?=\.)|(?<=\.\.))", LEADER)
    masked = [
        rf"(?=[{NO_WIDTH}]*[\p{{L}}\p{{N}}])",
        _after(_words(TITLES + INNER)),
        _after(_words(NUMBERED)) + rf"(?={SPACE}*+(?:\p{{N}}|\p{{Lu}}{{1,4}}-))",
        _after(r"(?!I)\p{Lu}") + rf"(?={SPACE}++[{NO_WIDTH}]*+\p{{Lu}})",
    ]
    v = _re(v, rf"\.(?:{'|'.join(masked)})", DOT)
    v = _quoted(v)
    follows = rf"(?={SPACE}++[{NO_WIDTH}]*+[^\p{{Ll}}\s{SEP}])"
    v = _re(v, rf"([.!?]++[{CLOSERS}]*+){follows}", f"$1{SEP}")
    leader = rf"([…{LEADER}]++(?<!{SPACE}[…{LEADER}]{{1,9}})[{CLOSERS}]*+)(?={SPACE}++[“‘\"(]?\p{{Lu}})"
    return _if_any(v, "…" + LEADER, lambda x: _re(x, leader, f"$1{SEP}"))


def _quoted(v: Column) -> Column:
    """Masks the marks inside a closed quotation, but for those at its end. A match starts at an opening mark, or goes on from the last match."""
    opened = rf"(?:[“「『](?=[^{QUOTES}{SEP}]*+[”」』])|\G(?!^))"
    return _if_any(v, "“「『", lambda x: _re(x, rf"({opened}[^{QUOTES}{SEP}.!?。！？…]*+)[.!?。！？…](?!{SPACE}*+[”」』.!?。！？…])", f"$1{DOT}"))


def _japanese(v: Column) -> Column:
    """Masks, then separators, for Japanese."""
    v = _if_any(_re(v, rf"\.(?={SPACE}*[\p{{N}}a-z])", DOT), "!?", lambda x: F.translate(x, "!?", "！？"))
    v = _quoted(v)
    closed = rf"[。！？]++{SPACE}*+[」』”）)]++(?!{SPACE}*+(?:{GOES_ON}))"
    v = _re(v, rf"({closed}|[。！？]++(?!{SPACE}*+[」』”）)]))", f"$1{SEP}")
    latin = rf"(\.(?<=[A-Za-z]{{2}}\.)[{CLOSERS}]*+)(?={SPACE}++[\p{{Lu}}“「\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])"
    return _if_any(v, ".", lambda x: _re(x, latin, f"$1{SEP}"))


def marked(text: Column) -> Column:
    """The view with separators after sentences and blank lines."""
    v = _re(_view(text), rf"({LINE_END}[{BLANK}{NO_WIDTH}]*+{LINE_END}{SPACE}*+)", f"$1{SEP}")
    return _let(v, lambda x: F.when(x.rlike(r"[ぁ-ヺ]"), _japanese(x)).otherwise(_latin(x)))


def spans(text: Column) -> Column:
    """ARRAY<STRUCT<start INT, end INT>> of the sentences: 0-based, end exclusive; empty for a null or blank text."""
    return _cut(text, lambda at, n: F.struct((at + n["all"] - n["led"]).alias("start"), (at + n["cut"]).alias("end")), "struct<start:int,end:int>")


def _cut(text: Column, one: Callable[[Column, Column], Column], kind: str) -> Column:
    """ARRAY<kind> of one(offset, lengths) for each piece between separators that isn't blank."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def size(piece: Column) -> Column:
        """A piece's length, and its length without the white space before it, and without that behind it."""
        return F.struct(F.length(piece).alias("all"), F.length(F.ltrim(piece, F.lit(TRIMMED))).alias("led"), F.length(F.rtrim(piece, F.lit(TRIMMED))).alias("cut"))

    def step(acc: Column, n: Column) -> Column:
        out = F.when(n["led"] == 0, acc["out"]).otherwise(F.array_append(acc["out"], one(acc["at"], n)))
        return F.struct((acc["at"] + n["all"]).alias("at"), out.alias("out"))

    pieces = F.transform(F.split(marked(text), SEP), size)
    return F.coalesce(F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]), none)


def starts(text: Column) -> Column:
    """ARRAY<INT> of the sentences' first positions."""
    return _cut(text, lambda at, n: at + n["all"] - n["led"], "int")


def sentences(text: Column) -> Column:
    """ARRAY<STRUCT<start, end, sentence>>; sentences are cut from the stored text."""
    return F.transform(spans(text), lambda s: F.struct(s["start"], s["end"], F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("sentence")))
