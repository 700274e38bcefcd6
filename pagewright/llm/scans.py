"""Problem 5: repair of text from scanned pages into continuous readable paragraphs.

Method: running headers, footers and page numbers are taken off first: lines at a page's edge whose letters come again
at the edges of the document's other pages, or are its title, and numbers alone. What is left is one stream without
lines, which is decoded jointly: the cheapest path through a lattice, and what is reported is read off that path.

* In scripts with spaces the arcs of the lattice are words. A word may begin and end at any character and span any number
  of tokens: spaces are kept, dropped or put in, letters are confusions of the recogniser, and a hyphen at a line's end is
  dropped, a compound's own, or a mark. Each costs; a word costs by its frequency. Where no arc spans a space, paths on
  both sides are independent. Words that the corpus has more than once are merged or parted only as it bears that out:
  it must have the other form WORD_RATIO times as often, and what is merged as often more than chance would put together.
* In scripts without spaces the units are single characters, as there is no dictionary: the path chooses a form for each
  character that a recogniser confuses, by the counts of the trigrams that hold it, jointly with the forms near to it.

Paragraph boundaries are then chosen by dynamic programming over the lines.

Counts cover all pages and are exact. Pages are decoded in lots; what a lot may ask for is joined to the corpus's counts.
Two bit sets of words, built by Spark, keep most of what no count could bear out from ever being a row. Their size follows
the vocabulary up to a bound; they let more through beyond it, and never change a result.

Defined results: null, empty and blank pages, and pages whose status says that there is no text, have no lines and an
empty text. Rows with the same key must be re-deliveries of one page; one of them is kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .looks import LIKE_KANA, NO_WIDTH, fold
from .sentences import LATIN, LOOKS
from .splits import SALTS

#: Bits of a bit set of words, as a power of 2: at least, at most.
LEAST_BITS, MOST_BITS = 20, 27
#: Bytes of text of a lot of pages, at the mean, and its most pages.
LOT_BYTES, LOT_PAGES = 1 << 22, 1024
#: How many times as often the corpus must have a form for it to replace another: words, and characters among neighbours.
WORD_RATIO, CHAR_RATIO = 12, 8
#: What each letter adds to the cost of a word that the corpus has once at most, as words unlike any are the rarer the longer they are.
UNSEEN = 0.5
#: Letters of a skeleton's begin that are told apart while a word is looked for; a word that is found is compared whole.
BEGIN = 64
#: Lines of a usual paragraph.
USUAL_LINES = 6
#: A running line: on so many pages, and this share of the document's; or on so many pages of several documents; and mostly at edges.
PAGES, SHARE, CORPUS_PAGES, CORPUS_DOCUMENTS, AT_EDGES = 2, 0.08, 6, 3, 0.7
#: And narrower than this share of the document's usual line, which is as wide as this share of its lines or wider; or, on so many pages, outermost on this share of them.
NARROW, USUAL_WIDTH, SURE_PAGES, OUTERMOST = 0.9, 0.75, 3, 0.9
#: What a recogniser puts, and for what, in scripts with spaces.
CONFUSIONS = (("ri", "n"), ("rn", "m"), ("c", "e"), ("f", "t"), ("@", "a"), ("0", "o"), ("l", "i"), ("5", "s"), ("1", "l"), ("1", "i"), ("q", "g"), ("b", "h"), ("6", "b"), ("!", "i"), ("u'", "ư"), ("o'", "ơ"), ("d", "đ"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("m", "rn"), ("8", "b"), ("9", "g"), ("$", "s"), ("|", "l"))
#: The same for characters of Japanese; kana and what looks like them are confused both ways.
CHARACTERS = [("曰", "日"), ("ソ", "ン"), ("入", "人"), ("未", "末"), ("ユ", "コ"), ("士", "土"), ("犬", "大"), ("太", "大"), ("間", "聞"), ("ン", "ソ"), ("シ", "ツ"), ("干", "千"), ("己", "已"), ("人", "入"), ("末", "未"), ("コ", "ユ"), ("土", "士"), ("大", "犬")]
CHARACTERS += [p for a, b in LIKE_KANA.items() if a not in "へりべぺ" for p in ((a, b), (b, a))]
#: Marks that break a word at a line's end; those that are never a word's own.
BREAKS, NEVER_OWN = "-­‐‑–¬", "­¬"
_breaks = tuple(BREAKS)
_no_text = ("textless", "extraction_error")
_cjk = re.compile("[ぁ-ヺ]")
_word = re.compile("[^\\W\\d_]+(?:[-‐‑][^\\W\\d_]+)*")
_latin = dict(zip(map(ord, LOOKS), LATIN))
_foreign = re.compile(f"[{LOOKS}]")
#: A word's skeleton is the same for all that it may be misread for: each character stands for what its confusions have in common.
_alike = {**dict(zip("cf@0l1!|5$q9b68", "eta" "oiiii" "ss" "gg" "hhh")), "n": "ri", "m": "rri", "w": "vv", "d": "ei", "đ": "ei", "ư": "u'", "ơ": "o'"}
_skeleton = str.maketrans(_alike)
_hint = re.compile("ri|rn|vv|cl|u'|o'|[cf@0l51qb6!dm8$9|]")
_final = re.compile(r"[.!?。！？…][”’」』\")）]*$")
_finals, _closers = tuple(".!?。！？…"), "”’」』\")）"
_letters = re.compile(r"(\W*)([^\W\d_]+)(\W*)")
_blank = re.compile(r"\n[^\S\n]*\n")
_broken = re.compile(f"((?:[^\\W\\d_]+[-‐‑])*)([^\\W\\d_]+)([{BREAKS}])\\s*$")
_numbers = re.compile("(?<![a-zà-ỹđ])[0-9oli]*[0-9][0-9oli]*(?![a-zà-ỹđ])")
_digits = re.compile("[0-9]")
_gap = re.compile(r"[^\S\n]{2}")
_kept = re.compile(r"[^\W\d_]+|\n")
#: What neither fold nor NFKC changes, nor what stands before it; not all of that.
_plain_range = "\0-\x0c\x0e-~À-ÏÑ-ÿĂăĐđĨĩŨũƠơƯưẠ-ỹ、。「-』ぁ-ゖァ-ヺー一-鿿"
_changed = re.compile(f"[^{_plain_range}]")
_beside = re.compile("^\\s*[0-9oil|]{1,4}(?=\\s{2})|(?<=\\s{2})[0-9oil|]{1,4}\\s*$")
#: The same in a text of lines.
_beside_lines = re.compile("^[^\\S\n]*[0-9oil|]{1,4}(?=[^\\S\n]{2})|(?<=[^\\S\n]{2})[0-9oil|]{1,4}[^\\S\n]*$", re.M)
_no_letters = re.compile(r"[\W\d_]+")
_n = "[0-9OoIlS|]{1,6}"
_page_number = re.compile(
    rf"^[-–—\[(<|·•~*\s]*(?:(?:pp?|tr|s)[.,]?|pa[gq][ec]|tran[gq]|t[ờ]\s*[s5][ốỗ0o]|shee[tf]|folio|第)?\s*({_n})\s*(?:(?:[0o]f|/|trên)\s*{_n})?\s*(?:ペ[ー一]ジ|頁|枚)?[-–—\])>|·•~*\s]*$", re.I
)
_letter_pairs = tuple(zip("cf@0l51q6b!đ8曰ソ入未ユ士犬工口力夕卜ニ一", "etaoisighhidhヨン人末コ土大エロカタト二ー"))
_letter_folds = str.maketrans(dict(_letter_pairs))


def is_no_text(status: Column) -> Column:
    """Whether a status, in any writing, says that a page has no text."""
    return F.lower(F.trim(F.coalesce(status, F.lit("ok")))).isin(*_no_text)


def _nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


#: By function and character: what becomes of the character by itself, None if that depends on its neighbours.
_alone: dict[Callable[[str], str], dict[str, str | None]] = {_nfkc: {}, fold: {}}


def _by_characters(text: str, change: Callable[[str], str]) -> str:
    """change (fold or _nfkc) of a text, by its distinct characters unless one depends on its neighbours: that is what begins with a mark, and jamo."""
    if text.isascii() and "\r" not in text:
        return text
    known, odd = _alone[change], set(_changed.findall(text))
    for c in odd - known.keys():
        first = unicodedata.normalize("NFKD", c)[0]
        free = not (unicodedata.category(first)[0] == "M" or "ᄀ" <= first <= "ᇿ" or first > "\uffff")
        known[c] = change(c) if free or (change is fold and c in NO_WIDTH) else None
    if any(known[c] is None for c in odd):
        return change(text)
    if change is fold and "\r" in odd:
        text = text.replace("\r\n", "\n")
    for c in odd:
        if known[c] != c:
            text = text.replace(c, known[c])
    return text


def _line_keys(lines: list[str]) -> list[str]:
    """line_key of lines, all in one pass."""
    t = _by_characters("\n".join(lines), _nfkc).casefold()
    if _gap.search(t):
        t = _beside_lines.sub("", t)
    if _digits.search(t):
        t = "\n".join([_numbers.sub("", x) if _digits.search(x) else x for x in t.split("\n")])
    t = t.replace("rn", "m").replace("ri", "n").replace("u'", "ư").replace("日", "ヨ")
    if t.isascii():
        t = t.translate(_letter_folds)
    else:
        for a, b in _letter_pairs:
            t = t.replace(a, b)
    return "".join(_kept.findall(t.replace(" ", ""))).split("\n")


def line_key(line: str) -> str:
    """What a running line has in common on all pages: its letters, with confused ones alike; '' where it has none."""
    t = (line if line.isascii() else unicodedata.normalize("NFKC", line)).casefold()
    t = _numbers.sub("", _beside.sub("", t)).replace("rn", "m").replace("ri", "n").replace("u'", "ư").replace("日", "ヨ").translate(_letter_folds)
    return _no_letters.sub("", t)


def page_number(line: str, outermost: bool) -> bool:
    """Whether a line is only a printed page number; a bare number is one only outermost on its page."""
    t = unicodedata.normalize("NFKC", line).strip()
    m = _page_number.match(t)
    if not m or not (any(c.isdigit() for c in t) or outermost):
        return False
    return outermost or t != m[1]


def _plain(t: str) -> str:
    """A text in lower case with usual letters."""
    if t.isascii():
        return t.casefold()
    t = fold(t)
    return (_foreign.sub(lambda m: _latin[ord(m[0])], t) if _foreign.search(t) else t).casefold()


def skeleton(word: str) -> str:
    """What a (casefolded) word has in common with all that it may be misread for; that of a concatenation is the concatenation."""
    return word.translate(_skeleton)


def _skeleton_column(word: Column) -> Column:
    """skeleton as an expression."""
    single = {a: b for a, b in _alike.items() if len(b) == 1}
    out = F.translate(word, "".join(single), "".join(single.values()))
    for a, b in _alike.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def shape(token: str) -> tuple[str, str, str, str] | None:
    """Marks before, letters, marks behind and casefolded letters of a token that is a word with marks around."""
    if m := _letters.fullmatch(token):
        w = _plain(m[2])
        if len(w) == len(m[2]):
            return m[1], m[2], m[3], w
    return None


def _hash64(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


class Bits:
    """A bit set of words as _bit_sets makes it; it never lacks a word that was put in."""

    def __init__(self, bits: bytes):
        self.bits, self.most = bits, len(bits) * 8 - 1

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & self.most  # as Spark's xxhash64
        return bool(self.bits[h >> 3] >> (h & 7) & 1)


def _stream(lines: list[str]) -> list[str]:
    """Folded lines without white space."""
    whole = _by_characters("\n".join(lines), fold).split("\n")
    if len(whole) != len(lines):  # a line end within a line
        whole = [fold(x) for x in lines]
    return ["".join(x.split()) for x in whole]


def trigram_counts(stream: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a stream that hold a character with other forms, each packed into a number, and how often; digits are alike."""
    p = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p[(p >= 48) & (p <= 57)] = 48
    site = _sites[np.minimum(p, 65535)]
    at = np.flatnonzero(site[:-2] | site[1:-1] | site[2:])
    return np.unique((p[at] << 42) | (p[at + 1] << 21) | p[at + 2], return_counts=True)


def trigram_words(packed: np.ndarray) -> list[str]:
    """Packed trigrams as strings; a tab before them keeps them apart from words."""
    mask = (1 << 21) - 1
    points = np.stack([np.full(len(packed), 9), packed >> 42, packed >> 21 & mask, packed & mask], 1).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + 4] for i in range(0, len(text), 4)]


def _width(line: str) -> int:
    """A line's width, spaces between words counted once."""
    return len(" ".join(line.split()))


def _edges(lines: list[str]) -> tuple[dict[str, tuple[bool, int]], list[str], list[int]]:
    """Keys of lines that may be running ones, with whether they are outermost and their width; keys of the page's other lines; widths of all."""
    full = [x for x in lines if x.strip()]
    last = len(full) - 1
    numbers = {i for i in (0, 1, last - 1, last) if 0 <= i <= last and page_number(full[i], i in (0, last))}
    own = [i for i in range(len(full)) if i not in numbers]
    outer, outermost = {*own[:2], *own[-2:]}, {*own[:1], *own[-1:]}
    keys = _line_keys(full)
    widths = [len(x.strip()) for x in full] if not _gap.search("\n".join(full)) else [_width(x) for x in full]
    edges: dict[str, tuple[bool, int]] = {}
    inner: list[str] = []
    for i in own:
        if not (k := keys[i]) or _ends(full[i]):
            continue
        if i not in outer:
            inner.append(k)
        elif k not in edges or i in outermost:
            edges[k] = (i in outermost, widths[i])
    return edges, inner, [widths[i] for i in own]


def _ends(line: str) -> bool:
    """Whether a line ends as a sentence does; a mark apart from it is noise."""
    t = line.rstrip()
    return t.rstrip(_closers).endswith(_finals) and not t[-2:-1].isspace()


def _count(pages: DataFrame) -> DataFrame:
    """One pass over all pages: words and trigrams (kind w), edge lines by document (e), other lines (m) and line widths by document (d) of scanned pages.

    n counts rows; of edge lines, `outermost` counts those that are and `width` sums widths.
    """

    names = ["kind", "document", "place", "n", "outermost", "width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter[str] = Counter()
        trigrams: list[tuple[np.ndarray, np.ndarray]] = []
        edges: dict[tuple[str, str], list[int]] = {}
        widths: dict[tuple[str, int], int] = {}
        others: dict[str, int] = {}

        def words_out() -> Iterator[pa.RecordBatch]:
            if trigrams:
                keys, back = np.unique(np.concatenate([k for k, _ in trigrams]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n for _, n in trigrams])).astype(np.int64)
                trigrams.clear()
                yield from rows_out(trigram_words(keys), n)
            words: dict[str, int] = {}
            for token, times in tokens.items():  # no word goes on over white space, and no letter's form depends on what is beyond it
                for w in _word.findall(_plain(token)):
                    words[w] = words.get(w, 0) + times
            tokens.clear()
            yield from rows_out(list(words), np.fromiter(words.values(), np.int64, len(words)))

        def rows_out(keys: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                part = pa.array(keys[k : k + 100_000], pa.string())
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(["w"] * len(part)), part, none, pa.array(n[k : k + 100_000]), none, none], names=names)

        def lines_out() -> pa.RecordBatch:
            rows = [("e", d, _hash64(k) >> 1, *x) for (d, k), x in edges.items()] + [("m", None, _hash64(k) >> 1, n, 0, 0) for k, n in others.items()] + [("d", d, w, n, 0, 0) for (d, w), n in widths.items()]
            edges.clear(), others.clear(), widths.clear()
            columns = zip(*rows) if rows else ((),) * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k < 2 else pa.int64()) for k, x in enumerate(columns)], names=names)

        for batch in batches:
            document, text, scanned = (batch.column(i).to_pylist() for i in range(3))
            spaced, spaceless, size = [], [], 0
            for k, (d, t, s) in enumerate(zip(document, text, scanned)):
                (spaceless if _cjk.search(t) else spaced).append(t)
                size += len(t)
                if s:
                    outer, inner, wide = _edges(t.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
                    for key, (outermost, width) in outer.items():
                        x = edges.setdefault((d or "", key), [0, 0, 0])
                        x[0], x[1], x[2] = x[0] + 1, x[1] + outermost, x[2] + width
                    for key in inner:
                        others[key] = others.get(key, 0) + 1
                    for w in wide:
                        widths[d or "", w] = widths.get((d or "", w), 0) + 1
                if size > 1_000_000 or k + 1 == len(text):
                    tokens.update("\n".join(spaced).split())
                    if spaceless:
                        trigrams.append(trigram_counts("".join(("^^" + "^^".join(_by_characters(t, fold) for t in spaceless) + "^^").split())))
                    spaced, spaceless, size = [], [], 0
            if len(tokens) > 200_000 or sum(len(k) for k, _ in trigrams) > 2_000_000:
                yield from words_out()
            if len(edges) + len(others) + len(widths) > 200_000:
                yield lines_out()
        yield from words_out()
        yield lines_out()

    return pages.select("document", "text", "scanned").mapInArrow(run, "kind string, document string, place bigint, n bigint, outermost bigint, width bigint")


def _bit_sets(vocabulary: DataFrame) -> tuple[bytes, bytes]:
    """Bit sets of the words that the corpus has at least twice, and of their skeletons; at most 2^MOST_BITS bits each.

    The second one holds what skeletons begin with, skeletons with a stop behind, and with a colon those of two words or more.
    """
    words = vocabulary.filter("n > 1").select("word", _skeleton_column(F.col("word")).alias("s"))
    alike = words.groupBy("s").agg(F.count("*").alias("n"))
    begins = F.expr(f"transform(sequence(1, least(length(s), {BEGIN})), i -> substring(s, 1, i))")
    ends = F.when(F.col("n") > 1, F.array(F.concat("s", F.lit(".")), F.concat("s", F.lit(":")))).otherwise(F.array(F.concat("s", F.lit("."))))
    skeletons = alike.filter("s <> ''").select(F.explode(F.concat(begins, ends)).alias("word"))
    out = []
    for keys, size in ((words.select("word"), words.count()), (skeletons, skeletons.count())):
        bits = 1 << min(max(LEAST_BITS, (16 * size).bit_length()), MOST_BITS)
        spots = keys.select(F.xxhash64("word").bitwiseAND(F.lit(bits - 1)).alias("spot")).distinct()
        own = spots.groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toPandas()
        table = np.zeros(bits // 64, np.int64)
        table[own["w"].to_numpy(np.int64)] = own["bits"].to_numpy(np.int64)
        out.append(table.tobytes())
    return out[0], out[1]


def _running(counts: DataFrame, scanned: DataFrame) -> DataFrame:
    """document, keys of its running lines, and `wide`: those that are so only if they hold the title; see PAGES and the following."""
    edges = counts.filter("kind = 'e'").groupBy("document", "place").agg(*[F.sum(c).alias(c) for c in ("n", "outermost", "width")])
    whole = edges.groupBy("place").agg(F.sum("n").alias("all"), F.count("*").alias("documents"))
    others = counts.filter("kind = 'm'").groupBy("place").agg(F.sum("n").alias("inner"))
    whole = whole.join(others, "place", "left").withColumn("inner", F.coalesce("inner", F.lit(0))).filter(F.col("all") >= AT_EDGES * (F.col("all") + F.col("inner")))
    pages = scanned.groupBy("document").agg(F.count("*").alias("pages"))
    usual = counts.filter("kind = 'd'").groupBy("document", "place").agg(F.sum("n").alias("n")).groupBy("document").agg(F.percentile("place", F.lit(USUAL_WIDTH), F.col("n")).alias("usual"))
    keys = edges.join(whole, "place").join(pages, "document").join(usual, "document")
    keys = keys.filter(((F.col("n") >= PAGES) & (F.col("n") >= SHARE * F.col("pages"))) | ((F.col("all") >= CORPUS_PAGES) & (F.col("documents") >= CORPUS_DOCUMENTS)))
    # Lines of the text come again too, at edges and as wide as the text; those that are nearly always outermost are none.
    sure = (F.col("width") < NARROW * F.col("n") * F.col("usual")) | ((F.col("n") >= SURE_PAGES) & (F.col("outermost") >= OUTERMOST * F.col("n")))
    return keys.groupBy("document").agg(F.collect_set(F.when(sure, F.col("place"))).alias("keys"), F.collect_set(F.when(~sure, F.col("place"))).alias("wide"))

#: Forms of characters that a recogniser confuses: the character itself first.
FORMS: dict[str, list[str]] = {}
for _a, _b in CHARACTERS:
    if _b not in FORMS.setdefault(_a, [_a]):
        FORMS[_a].append(_b)
_sites = np.zeros(65536, bool)
_sites[[ord(c) for pair in CHARACTERS for c in pair]] = True
_one = "".join(FORMS)
#: Characters in a row that may be confused and share a trigram.
_cluster = re.compile(f"[{_one}](?:.?[{_one}])*", re.S)


def _clusters(streams: list[str]) -> Iterator[tuple[str, int]]:
    """Such characters of streams, each with two neighbours on both sides, and where it begins in the streams with four marks between them."""
    t = "^^" + "^^^^".join(streams) + "^^"
    for digit in "123456789":
        t = t.replace(digit, "0")
    for m in _cluster.finditer(t):
        a, b = m.span()
        yield t[a - 2 : b + 2], a - 2


def variants(word: str) -> Iterator[dict[str, int]]:
    """Forms that a (casefolded) word may be misread for, with the place of the first change: by one confusion, then by two."""
    forms = {word: len(word)}
    for _ in range(2):
        more: dict[str, int] = {}
        for w, first in forms.items():
            for a, b in CONFUSIONS:
                at = w.find(a)
                while at >= 0:
                    more.setdefault(w[:at] + b + w[at + len(a) :], min(first, at))
                    at = w.find(a, at + 1)
        more.pop(word, None)
        yield {f: at for f, at in more.items() if _word.fullmatch(f)}
        forms = more


def cores(token: str, goes_on: bool | None) -> Iterator[tuple[int, str, str]]:
    """Place, stored and clean form of what may be a misread word in a token. A mark that may be a letter is one if the sentence goes on; goes_on None takes both."""
    if not _hint.search(token) and not any(c in "CFLBDQI" for c in token):
        return
    for m in re.finditer(r"[\w'!@$|]*[^\W\d_][\w'!@$|]*", token):
        whole, plain = m[0], m[0].rstrip("!'|")
        forms = [whole]
        if plain != whole:
            ends = m.end() == len(token) and not goes_on
            if goes_on is None:
                forms = [whole, plain]
            elif ends or not whole.endswith("!"):
                forms = [plain]
        for core in forms:
            w = _plain(core)
            if w.isdigit() or len(w) < 2 or (any(c.isdigit() for c in w) and sum(c.isdigit() for c in w) > 1):
                continue
            if core.isupper() and len(core) > 1 and any(c.isdigit() for c in core):
                continue
            yield m.start(), core, w


def broken(token: str, after: str) -> tuple[re.Match, str] | None:
    """The match of a word broken by a mark at the end of a token that ends its line, and what goes on in the next line's first token."""
    if (m := _broken.search(token)) and (right := re.match(r"[^\W\d_][\w'!@$|]*", after)) and (right[0][0].islower() or not right[0][0].isalpha()):
        return m, right[0]
    return None


def _places(flat: list[str], pairs: Collection[tuple[str, str]]) -> list[int]:
    """Where the pairs begin."""
    first = {a for a, _ in pairs}
    return [k for k, t in enumerate(flat[:-1]) if t in first and (t, flat[k + 1]) in pairs] if first else []


class Spans:
    """Places of a word, and of words in a row, that skeletons reach: `begins(skeleton)` and `is_one(skeleton)` say so."""

    def __init__(self):
        self.shapes: dict[str, tuple[str, str, str, str] | None] = {}
        self.held: dict[str, tuple[str, ...]] = {}
        self.over: dict[tuple[str, str], tuple[tuple[int, ...], str | None]] = {}

    def begins(self, s: str) -> bool:
        raise NotImplementedError

    def is_one(self, s: str) -> bool:
        raise NotImplementedError

    def shape(self, token: str) -> tuple[str, str, str, str] | None:
        """shape of a token, remembered."""
        try:
            return self.shapes[token]
        except KeyError:
            if len(self.shapes) > 200_000:
                self.shapes.clear()
            known = self.shapes[token] = shape(token)
            return known

    def beside(self, a: str, b: str) -> tuple[tuple[str, str, str, str], tuple[str, str, str, str]] | None:
        """Shapes of two tokens in a row that a word may span."""
        if (x := self.shape(a)) and not x[2] and (y := self.shape(b)) and not y[0]:
            return x, y
        return None

    def open(self, word: str) -> tuple[str, ...]:
        """Ends of a word, from the whole to its last letter, that a word may begin with."""
        known = self.held.get(word)
        if known is None:
            if len(self.held) > 200_000:
                self.held.clear()
            known = self.held[word] = tuple(word[i:] for i in range(len(word)) if self.begins(skeleton(word[i : i + BEGIN])))
        return known

    def on(self, start: str, word: str) -> tuple[tuple[int, ...], str | None]:
        """Lengths of what a word adds to a start so that both are a word, and both whole if a longer one may begin so."""
        known = self.over.get((start, word))
        if known is None:
            if len(self.over) > 400_000:
                self.over.clear()
            s, ends, whole = skeleton(start), [], start + word
            for j, c in enumerate(word, 1):
                s += _alike.get(c, c)
                if not self.begins(s):
                    whole = None
                    break
                if self.is_one(s):
                    ends.append(j)
            known = self.over[start, word] = (tuple(ends), whole)
        return known

    def follows(self, held: dict[tuple[str, ...], bool], key: tuple[str, ...], starts: Iterable[str]) -> bool:
        """Whether a word may begin with one of starts and with the first letter of what follows, the last of key; remembered in held."""
        known = held.get(key)
        if known is None:
            if len(held) > 400_000:
                held.clear()
            # Where a letter's form may depend on its neighbours, the whole is to be looked at.
            c = key[-1]
            known = held[key] = bool(_changed.match(c)) or (c.isalpha() and any(self.begins(skeleton(x + _plain(c))) for x in starts))
        return known

    def inner(self, word: str) -> Iterator[tuple[int, int]]:
        """Places of words inside a word, but for the word itself."""
        for i in range(len(word)):
            s = ""
            for j in range(i, len(word)):
                s += _alike.get(word[j], word[j])
                if not self.begins(s):
                    break
                if j - i + 1 < len(word) and self.is_one(s):
                    yield i, j + 1


class Needs(Spans):
    """What pages ask of the corpus: a superset, as far as the bit sets tell."""

    def __init__(self, often: Bits, skeletons: Bits):
        super().__init__()
        self.often, self.skeletons = often, skeletons
        self.words: dict[str, tuple[str, ...]] = {}
        self.tokens: dict[str, tuple[str, ...]] = {}
        # By tokens in a row; apart: those that are nothing together. And by what begins the next one.
        self.pairs: dict[tuple[str, str], tuple[tuple[str, ...], tuple[str, ...]]] = {}
        self.joint: dict[tuple[str, str], tuple[str, str]] = {}
        self.apart: set[tuple[str, str]] = set()
        self.behind: dict[tuple[str, ...], bool] = {}
        self.behind_row: dict[tuple[str, ...], bool] = {}
        self.more: dict[tuple[tuple[str, ...], str], tuple[tuple[str, ...], tuple[str, ...]]] = {}
        self.clusters: dict[str, tuple[str, ...]] = {}
        self.rows: dict[str, int] = {}

    def begins(self, s: str) -> bool:
        return s[:BEGIN] in self.skeletons

    def is_one(self, s: str) -> bool:
        return s + "." in self.skeletons

    def forms(self, word: str) -> list[str]:
        if not _hint.search(word) or skeleton(word) + (":" if word in self.often else ".") not in self.skeletons:
            return []
        return [f for more in variants(word) for f in more if f in self.often]

    def word(self, word: str) -> tuple[str, ...]:
        """A word and the forms that may replace it; remembered."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) > 200_000:
                self.words.clear()
            known = self.words[word] = (word, *self.forms(word))
        return known

    def token(self, token: str) -> tuple[str, ...]:
        """What a token asks for by itself; remembered."""
        known = self.tokens.get(token)
        if known is None:
            if len(self.tokens) > 200_000:
                self.tokens.clear()
            asked = {x for _, _, w in cores(token, None) for x in self.word(w)}
            if m := _letters.fullmatch(token):
                asked.update(self.word(_plain(m[2])))
            if x := shape(token):
                for i, j in self.inner(x[3]):
                    asked.update(self.word(x[3][i:j]))
            known = self.tokens[token] = tuple(asked)
        return known

    def remembered(self, held: dict, pair: tuple[str, str], find: Callable) -> tuple | None:
        """find of a pair, which is set apart if that is nothing."""
        known = held.get(pair)
        if known is None:
            if known := find(*pair):
                if len(held) > 400_000:
                    held.clear()
                held[pair] = known
            else:
                if len(self.apart) > 400_000:
                    self.apart.clear()
                self.apart.add(pair)
        return known

    def pair(self, a: str, b: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
        """What two tokens in a row ask for together, and what words that go on behind both may begin with; None if nothing."""
        if not (x := self.beside(a, b)):
            return None
        asked, goes_on = self.further(self.open(x[0][3]), x[1][3])
        return (asked, () if x[1][2] else goes_on) if asked or goes_on else None

    def further(self, starts: tuple[str, ...], word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """The same of starts and what follows; remembered."""
        known = self.more.get((starts, word))
        if known is None:
            if len(self.more) > 200_000:
                self.more.clear()
            asked, goes_on = set(), []
            for start in starts:
                ends, whole = self.on(start, word)
                for j in ends:
                    asked.update(self.word(start + word[:j]))
                if whole:
                    goes_on.append(whole)
            known = self.more[starts, word] = tuple(asked), tuple(goes_on)
        return known

    def spaced(self, texts: list[str], out: set[str]) -> None:
        """Adds to out what pages ask for."""
        flat = "\n\0\n".join(texts).split()  # no word goes on over the mark between pages
        for t in set(flat):
            out.update(self.token(t))
        long: dict[tuple[str, str], tuple[str, ...]] = {}
        apart = self.apart
        for pair in {pair for pair in zip(flat, flat[1:]) if pair not in apart}:
            if known := self.remembered(self.pairs, pair, self.pair):
                out.update(known[0])
                if known[1]:
                    long[pair] = known[1]
        for k in _places(flat, long):
            a, b = flat[k], flat[k + 1]
            starts, last = long[a, b], k + 1
            if k + 2 == len(flat) or not self.follows(self.behind, (a, b, flat[k + 2][0]), starts):
                continue
            while starts and last + 1 < len(flat) and (x := self.beside(flat[last], flat[last + 1])):
                asked, starts = self.further(starts, x[1][3])
                out.update(asked)
                last += 1
        for text in texts:
            lines = text.split("\n")
            for a, b in zip(lines, lines[1:]):
                if (a := a.rstrip()).endswith(_breaks) and (right := b.split(None, 1)) and (x := broken(a.split()[-1], right[0])):
                    left, rest = _plain(x[0][1] + x[0][2]), _plain(x[1])
                    out.add(f"{left}-{rest}")
                    out.update(self.word(left + rest))

    def row(self, a: str, b: str) -> tuple[str, str] | None:
        """Two tokens in a row that may be one word, and the word that more may follow, or '' each; None if neither."""
        if not (x := self.beside(a, b)) or not self.begins(s := skeleton(x[0][3] + x[1][3])):
            return None
        known = f"{x[0][3]} {x[1][3]}" if self.is_one(s) else "", "" if x[1][2] else x[0][3] + x[1][3]
        return known if any(known) else None

    def phrases(self, texts: list[str], out: Counter[str]) -> None:
        """Counts words in a row, parted by spaces, that may be one word together; blank lines part them."""
        flat = _blank.sub(" . ", "\n\n".join(texts)).split()
        long: dict[tuple[str, str], str] = {}
        apart = self.apart
        for pair, n in Counter([pair for pair in zip(flat, flat[1:]) if pair not in apart]).items():
            if known := self.remembered(self.joint, pair, self.row):
                if known[0]:
                    out[known[0]] += n
                if known[1]:
                    long[pair] = known[1]
        for k in _places(flat, long):
            a, b = flat[k], flat[k + 1]
            if k + 2 == len(flat) or not self.follows(self.behind_row, (a, b, flat[k + 2][0]), (long[a, b],)):
                continue
            row, last = self.shape(a)[3] + " " + self.shape(b)[3], k + 1
            while last + 1 < len(flat) and (x := self.beside(flat[last], flat[last + 1])):
                row, last = f"{row} {x[1][3]}", last + 1
                known = self.rows.get(row)
                if known is None:
                    if len(self.rows) > 400_000:
                        self.rows.clear()
                    s = skeleton(row.replace(" ", ""))
                    known = self.rows[row] = self.begins(s) and (1 + self.is_one(s))
                if not known:
                    break
                if known > 1:
                    out[row] += 1

    def spaceless(self, texts: list[str], out: set[str]) -> None:
        for key in {key for key, _ in _clusters(["".join(_by_characters(t, fold).split()) for t in texts])}:
            known = self.clusters.get(key)
            if known is None:
                if len(self.clusters) > 200_000:
                    self.clusters.clear()
                options = [FORMS.get(c, [c]) if 2 <= i < len(key) - 2 else [c] for i, c in enumerate(key)]
                known = self.clusters[key] = tuple({"\t" + "".join(x) for i in range(len(key) - 2) for x in product(*options[i : i + 3])})
            out.update(known)


class Reader(Spans):
    """Decodes pages with the corpus's counts of what they ask for; a word that isn't in counts is one the corpus lacks.

    Counts of words in a row that may be one word are keyed with a space between them.
    """

    def __init__(self, counts: dict[str, int], total: int):
        super().__init__()
        self.all, self.total, self.space = max(1, total), math.log(max(1, total)), math.log(WORD_RATIO)
        self.fixed: dict[str, tuple[str, int] | None] = {}
        self.tokens: dict[tuple[str, bool], tuple[str | None, bool, bool]] = {}
        # Tokens that nothing repairs by themselves or parts; tokens in a row that no word spans, and how words may span others, also by what begins the next one.
        self.plain: set[str] = set()
        self.apart_pairs: set[tuple[str, str]] = set()
        self.links: dict[tuple[str, str], tuple[bool, list[str]]] = {}
        self.firsts: dict[tuple[str, ...], bool] = {}
        self.behind: dict[tuple[str, ...], bool] = {}
        self.insides: dict[str, list[tuple[int, int, float, str | None]]] = {}
        self.groups: dict[tuple, tuple[list[str], set[int], set[int]]] = {}
        self.clusters: dict[str, str] = {}
        # Of words that the corpus has more than once: by skeleton, and what skeletons begin with. Words parted by spaces, by the word that they make.
        self.alike: dict[str, list[str]] = {}
        self.starts: set[str] = set()
        self.apart: dict[str, list[str]] = {}
        self.known: set[str] = set()
        self.pairs: dict[tuple[str, str], tuple[list[tuple[int, int]], list[str]]] = {}
        self.begin(counts)

    def begin(self, counts: dict[str, int]) -> None:
        """Goes on with another lot's counts."""
        self.counts = counts
        for held in (self.fixed, self.tokens, self.plain, self.insides, self.groups, self.clusters):
            if len(held) > 200_000:
                held.clear()
        if len(self.known) > 500_000:
            for held in (self.known, self.alike, self.starts, self.apart):
                held.clear()
        new = [w for w, n in counts.items() if w not in self.known and w[0] != "\t" and (n > 1 or " " in w)]
        self.known.update(new)
        for w in new:
            if " " in w:
                self.apart.setdefault(w.replace(" ", ""), []).append(w)
                continue
            s = skeleton(w)
            if s not in self.alike:
                self.starts.update(s[:i] for i in range(1, min(len(s), BEGIN) + 1))
            self.alike.setdefault(s, []).append(w)
        if new:  # what may begin a word isn't what it was
            for held in (self.held, self.over, self.pairs, self.apart_pairs, self.links, self.firsts, self.behind):
                held.clear()

    def begins(self, s: str) -> bool:
        return s[:BEGIN] in self.starts

    def is_one(self, s: str) -> bool:
        return s in self.alike

    def count(self, word: str) -> int:
        return self.counts.get(word, 0)

    def fix(self, word: str) -> tuple[str, int] | None:
        """The word that a (casefolded) misread word stands for, and the place of the first change; None if it stands for itself."""
        if word in self.fixed:
            return self.fixed[word]
        n, best = self.count(word) if _word.fullmatch(word) else 0, None
        like = self.alike.get(skeleton(word), ())
        for forms in variants(word) if any(w != word and self.count(w) >= WORD_RATIO * (n + 0.5) for w in like) else ():
            good = [(c, f, at) for f, at in forms.items() if (c := self.count(f)) >= WORD_RATIO * (n + 0.5)]
            if good:
                best = max(good)[1:]
            if good or n > 50:
                break
        self.fixed[word] = best
        return best

    def cost(self, word: str, n: int) -> float:
        """The cost of a word that the corpus has n times: its log-odds against all words."""
        return self.total - math.log(n + 0.5) + (UNSEEN * len(word) if n <= 1 else 0.0)

    def token(self, token: str, goes_on: bool) -> tuple[str | None, bool, bool]:
        """A token repaired by itself or None, whether the corpus has its word once at most, and whether it may be parted; remembered."""
        known = self.tokens.get((token, goes_on))
        if known is None:
            new = None
            for at, core, w in cores(token, goes_on):
                if fixed := self.fix(w):
                    new = token[:at] + (fixed[0].capitalize() if core[0].isupper() else fixed[0]) + token[at + len(core) :]
                    break
            m = _letters.fullmatch(token)
            rare = bool(m) and self.count(_plain(m[2])) <= 1
            known = self.tokens[token, goes_on] = (new, rare, rare or bool((x := self.shape(token)) and self.parted(x[3])))
        return known

    def reading(self, word: str, whole: bool) -> tuple[float, str | None] | None:
        """The cost of a word that tokens hold or make up, and what it is misread for; None if it is no word. Whole: not parts of tokens."""
        n = self.count(word)
        if n > (1 if whole else WORD_RATIO):
            return self.cost(word, n), None
        if len(word) > 1 and _hint.search(word) and (fixed := self.fix(word)):
            return self.cost(fixed[0], self.count(fixed[0])) + self.space, fixed[0]
        return None

    def inside(self, word: str) -> list[tuple[int, int, float, str | None]]:
        """Words inside a word: begin, end, cost and what each is misread for; remembered."""
        known = self.insides.get(word)
        if known is None:
            known = self.insides[word] = [(i, j, *x) for i, j in self.inner(word) if (x := self.reading(word[i:j], False))]
        return known

    def pair(self, a: str, b: str) -> tuple[list[tuple[int, int]], list[str]]:
        """Words over the end of one token and the begin of the next, as (letters of the first, of the next); and what may go on behind both."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            over, goes_on = [], []
            for start in self.open(a):
                ends, whole = self.on(start, b)
                over += [(len(start), j) for j in ends if self.reading(start + b[:j], len(start) == len(a) and j == len(b))]
                if whole:
                    goes_on.append(whole)
            known = self.pairs[a, b] = over, goes_on
        return known

    def linked(self, a: str, b: str) -> tuple[bool, list[str]]:
        """Whether words may span the space between two tokens, and what may go on behind both; remembered."""
        known = self.links.get((a, b))
        if known is None:
            if (a, b) in self.apart_pairs:
                return False, []
            if len(self.links) + len(self.apart_pairs) > 400_000:
                self.links.clear(), self.apart_pairs.clear()
            x = self.beside(a, b)
            if x and not self.follows(self.firsts, (x[0][3], b[0]), self.open(x[0][3])):
                x = None
            over, goes_on = self.pair(x[0][3], x[1][3]) if x else ((), [])
            known = bool(over), [] if x and x[1][2] else goes_on
            if any(known):
                self.links[a, b] = known
            else:
                self.apart_pairs.add((a, b))
        return known

    def reach(self, flat: list[str], k: int, end: int) -> int:
        """The last token before end that a word may hold which begins in token k; k if it holds no other."""
        if k + 1 >= end:
            return k
        over, goes_on = self.linked(flat[k], flat[k + 1])
        last = k + 1 if over else k
        if goes_on and k + 2 < end and self.follows(self.behind, (flat[k], flat[k + 1], flat[k + 2][0]), goes_on):
            return max((x for _, x, _ in self.spans(flat, k, end)), default=k)
        return last

    def spans(self, flat: list[str], k: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Words that begin in token k and end in a later one before end: (place in k, token of the end, place in it)."""
        last = k + 1
        if last >= end or not any(self.linked(flat[k], flat[last])):
            return
        x, y = self.shape(flat[k]), self.shape(flat[last])
        over, goes_on = self.pair(x[3], y[3])
        for n, j in over:
            yield len(x[3]) - n, last, j
        size = len(y[3])
        while goes_on and not y[2] and last + 1 < end and (y := self.shape(flat[last + 1])) and not y[0]:
            last, more = last + 1, []
            for start in goes_on:
                ends, whole = self.on(start, y[3])
                i = len(x[3]) - (len(start) - size)
                for j in ends:
                    if self.reading(start + y[3][:j], i == 0 and j == len(y[3])):
                        yield i, last, j
                if whole:
                    more.append(whole)
            goes_on, size = more, size + len(y[3])

    def parted(self, word: str) -> tuple[int, str] | None:
        """How often the corpus has a usual word parted by spaces, and how, if it does so often enough to part it."""
        n, best = self.count(word), max(((self.count(w), w) for w in self.apart.get(word, ())), default=(0, ""))
        return best if best[0] >= WORD_RATIO * (n + 0.5) else None

    def merges(self, words: list[str], form: str) -> bool:
        """Whether usual words in a row may be one word: the corpus has it often enough, and has them in a row more often than by chance."""
        n = self.count(" ".join(words))
        chance = math.prod(self.count(w) / self.all for w in words) * self.all
        return self.count(form) >= WORD_RATIO * (n + 0.5) and n >= WORD_RATIO * chance

    def decode(self, tokens: list[tuple[str, bool, bool]]) -> tuple[list[str], set[int], set[int]]:
        """The cheapest reading of tokens in a row, (token, whether a word goes on behind it, whether it ends its line); remembered.

        Gives what each token reads as, '' where the one before holds it; tokens with misread words; tokens whose hyphen was dropped.
        """
        key = tuple(tokens)
        known = self.groups.get(key)
        if known is None:
            known = self.groups[key] = self.path(tokens)
        return known

    def path(self, tokens: list[tuple[str, bool, bool]]) -> tuple[list[str], set[int], set[int]]:
        alone = [self.token(t, goes_on)[:2] for t, goes_on, _ in tokens]
        flat = [t for t, _, _ in tokens]
        shapes = [self.shape(t) for t in flat]
        space, n, at = self.space, len(tokens), [0]
        for x in shapes:  # a token that isn't a word with marks around counts as one character
            at.append(at[-1] + (len(x[3]) if x else 1))
        stored, size = "".join(x[1] if x else "\0" for x in shapes), at[-1]
        # What tokens read as by themselves, letters only.
        read = [_plain("".join(c for c in new if c.isalpha())) if new is not None else x[3] if x else _plain(t) for (t, _, _), x, (new, _) in zip(tokens, shapes, alone)]
        usual = [bool(x) and new is None and not rare for x, (new, rare) in zip(shapes, alone)]
        token_of = [k for k in range(n) for _ in range(at[k + 1] - at[k])]
        # Arcs by where they begin: (end, cost, text or None for the stored one, misread tokens, whether a hyphen is dropped, whether the text has its marks).
        # Places beyond size are those in usual words that are reached from the word's begin: their ends are no such words' ends, as only what the corpus bears out parts those.
        arcs: dict[int, list[tuple[int, float, str | None, tuple[int, ...], bool, bool]]] = {}
        second = size + 1

        def word_arc(begins: tuple[int, ...], a: int, b: int, end: int, cost: float, form: str | None) -> None:
            text = None
            if form is not None:
                like = stored[a:b]
                text = form.upper() if len(like) > 1 and like.isupper() else form.capitalize() if like[0].isupper() else form
            for begin in begins:
                arcs.setdefault(begin, []).append((end, cost, text, (token_of[a],) if form is not None else (), False, False))

        for k, (t, _, ends) in enumerate(tokens):
            new, _ = alone[k]
            w = shapes[k][3] if shapes[k] else _plain(t)
            own = self.cost(w, self.count(w))
            if new is not None:
                arcs.setdefault(at[k], []).append((at[k + 1], min(self.cost(read[k], self.count(read[k])) + space, own), new, (k,), False, True))
            else:
                arcs.setdefault(at[k], []).append((at[k + 1], own, t, (), False, True))
            if ends and k + 1 < n and (x := broken(t, tokens[k + 1][0])):
                m, right = x
                left, rest = _plain(m[1] + m[2]), _plain(right)
                kept, whole = self.count(f"{left}-{rest}"), self.count(left + rest)
                fixed = self.fix(left + rest) if whole < 3 else None
                form, whole = (fixed[0], max(whole, self.count(fixed[0]))) if fixed else (left + rest, whole)
                behind = tokens[k + 1][0][len(right) :]
                text = t[: m.start(1)] + fixed[0] + behind if fixed else t[: m.start(3)] + tokens[k + 1][0]
                bad = ((k if fixed[1] < len(left) else k + 1),) if fixed else ()
                # A mark that is never a word's own leaves no choice.
                drop = -1e3 if m[3] in NEVER_OWN else self.cost(form, whole)
                arcs[at[k]].append((at[k + 2], drop, text, bad, True, True))
                if kept:
                    arcs[at[k]].append((at[k + 2], self.cost(f"{left}-{rest}", kept), t + tokens[k + 1][0], (), False, True))
                # To leave the mark where it is costs as much as two spaces.
                arcs[at[k]] = [(x[0], x[1] + 2 * space, *x[2:]) if x[0] == at[k + 1] else x for x in arcs[at[k]]]
            if not shapes[k]:
                continue
            if usual[k] and (x := self.parted(w)):
                places = [0, *accumulate(map(len, x[1].split(" ")))]
                text = " ".join(shapes[k][1][i:j] for i, j in zip(places, places[1:]))
                arcs[at[k]].append((at[k + 1], self.total - math.log(x[0] + 0.5) + space * (len(places) - 2), text, (), False, False))
            for i, j, cost, form in self.inside(w):
                a, b, cost = at[k] + i, at[k] + j, cost + (space if i else 0.0)
                if not usual[k]:
                    word_arc((a,), a, b, b, cost, form)
                elif i == 0:
                    word_arc((a,), a, b, b + second, cost, form)
                else:
                    word_arc((a,), a, b, b, cost, form)
                    if b < at[k + 1]:
                        word_arc((a + second,), a, b, b + second, cost, form)
            for i, last, j in self.spans(flat, k, n):
                a, b = at[k] + i, at[last] + j
                # Within a word only its first letter may be a capital, unless all are.
                if not stored[a:b].isupper() and stored[a + 1 : b] != stored[a + 1 : b].lower():
                    continue
                words, whole = [shapes[x][3] for x in range(k, last + 1)], i == 0 and b == at[last + 1]
                w = words[0][i:] + "".join(words[1:-1]) + words[-1][:j]
                cost, form = self.reading(w, whole)
                if whole and all(self.count(x) > 1 for x in read[k : last + 1]) and not self.merges(read[k : last + 1], form or w):
                    continue
                word_arc((a, a + second) if i else (a,), a, b, b, cost + space * (last - k + (i > 0)), form)
        best, came = [0.0] + [math.inf] * (size + second), [None] * (size + second + 1)
        for place in range(size):
            for a in (place, place + second):
                if best[a] < math.inf:
                    for arc in arcs.get(a, ()):
                        if best[a] + arc[1] < best[arc[0]]:
                            best[arc[0]], came[arc[0]] = best[a] + arc[1], (a, arc)
        path, b = [], size
        while b > 0:
            path.append(came[b])
            b = came[b][0]
        out, bad, hyphens = [""] * n, set(), set()
        for a, (b, _, text, misread, dropped, complete) in reversed(path):
            a, b = a % second, b % second
            k, last = token_of[a], token_of[b - 1]
            new = stored[a:b] if text is None else text
            if not complete:  # marks around belong to a path's words at a token's ends
                new = (shapes[k][0] if a == at[k] else "") + new + (shapes[last][2] if b == at[last + 1] else "")
            out[k] = f"{out[k]} {new}" if out[k] else new
            bad.update(misread)
            if dropped:
                hyphens.add(k)
        return out, bad, hyphens

    def spaced(self, lines: list[str]) -> tuple[list[list[str]], set[int], set[int]]:
        """Words of each line as they read, lines with misread words, and lines that end in a broken word."""
        words = [x.split() for x in lines]
        flat = [w for ws in words for w in ws]
        bad: set[int] = set()
        hyphens: set[int] = set()
        first = [0, *accumulate(map(len, words))]  # tokens before each line, and all
        walls = sorted({n for n, ws in zip(first, words) if not ws} | {len(flat)})  # no word goes on over a blank line
        ends = {n + len(ws) - 1 for n, ws in zip(first, words) if ws}
        first.pop()

        def place(k: int) -> tuple[int, int]:
            i = bisect_right(first, k) - 1
            return i, k - first[i]

        def goes_on(k: int) -> bool:
            after = flat[k + 1][0] if k + 1 < len(flat) else ""
            return after.islower() or after.isdigit()

        plain, apart = self.plain, self.apart_pairs
        looked_at = {k for k, t in enumerate(flat) if t not in plain}
        looked_at.update([k for k, pair in enumerate(zip(flat, flat[1:])) if pair not in apart])
        looked_at.update(k for k in ends if flat[k].endswith(_breaks))
        odd: list[tuple[int, int]] = []
        for k in sorted(looked_at):
            t, end = flat[k], walls[bisect_right(walls, k)]
            loose = False
            if t not in plain:
                new, _, loose = self.token(t, goes_on(k))
                if new is not None:
                    i, j = place(k)
                    bad.add(i)
                    words[i][j] = new
                elif not loose and all(x is None and not y for x, _, y in (self.token(t, False), self.token(t, True))):
                    plain.add(t)
            last = self.reach(flat, k, end)
            if k in ends and k + 1 < end and t.endswith(_breaks) and broken(t, flat[k + 1]):
                last = max(last, k + 1)
            if last > k or loose:
                odd.append((k, last))
        at = 0
        while at < len(odd):
            begin, last = odd[at]
            at += 1
            while at < len(odd) and odd[at][0] <= last:
                last = max(last, odd[at][1])
                at += 1
            text, misread, dropped = self.decode([(flat[k], goes_on(k), k in ends) for k in range(begin, last + 1)])
            for k, t in enumerate(text, begin):
                i, j = place(k)
                words[i][j] = t
            hyphens.update(place(begin + k)[0] for k in dropped)
            bad.update(place(begin + k)[0] for k in misread)
        return words, bad, hyphens

    def cluster(self, key: str) -> str:
        """The best forms of characters in a row that may be confused; key has two neighbours more on both sides.

        A path scores, for each such character, the logarithm of the counts of the three trigrams that hold it, and less for each change.
        """
        known = self.clusters.get(key)
        if known is not None:
            return known
        states = {"": (0.0, "")}
        for i, c in enumerate(key):
            inner = 2 <= i < len(key) - 2
            scored = 4 <= i and key[i - 2] in FORMS
            new: dict[str, tuple[float, str]] = {}
            for score, whole in states.values():
                for o in FORMS.get(c, (c,)) if inner else (c,):
                    path = whole + o
                    s = score - (math.log(CHAR_RATIO) if o != c else 0.0)
                    if scored:
                        s += math.log(1 + sum(self.count("\t" + path[j : j + 3]) for j in (i - 4, i - 3, i - 2)))
                    if path[-4:] not in new or s > new[path[-4:]][0]:
                        new[path[-4:]] = (s, path)
            states = new
        best = max(states.values(), key=lambda x: x[0])[1][2:-2]
        self.clusters[key] = best
        return best

    def spaceless(self, lines: list[str]) -> tuple[list[str], set[int]]:
        """Lines of a script without spaces as they read, and which have misread characters."""
        parts = _stream(lines)
        ends, bad = list(accumulate(map(len, parts))), set()
        for key, begin in _clusters(["".join(parts)]):
            best = self.clusters.get(key) or self.cluster(key)
            if best != key[2:-2]:
                for i, (c, o) in enumerate(zip(key[2:-2], best), begin):
                    if c != o:
                        n = bisect_right(ends, i)
                        k = i - ends[n] + len(parts[n])
                        parts[n] = parts[n][:k] + o + parts[n][k + 1 :]
                        bad.add(n)
        return parts, bad

    def read(self, lines: list[str], kinds: dict[int, str], body: list[int], spaceless: bool, paragraphs_too: bool) -> tuple[list[tuple[int, str]], str | None]:
        """Kinds of a page's lines (number from 1, kind), and its paragraphs; see outline."""
        own, hyphens = [lines[i] for i in body], set()
        if spaceless:
            (units, bad), glue = self.spaceless(own), ""
        else:
            words, bad, hyphens = self.spaced(own)
            units, glue = [" ".join(w for w in ws if w) for ws in words] if paragraphs_too else [], " "
        found = [(i + 1, kind) for i, kind in kinds.items()] + [(body[i] + 1, "misread") for i in bad] + [(body[i] + 1, "hyphen") for i in hyphens]
        return sorted(found), "\n\n".join(glue.join(u for u in units[a:b] if u) for a, b in paragraphs(own, units) if any(units[a:b])) if paragraphs_too else None


@lru_cache(10_000)
def _title_key(title: str) -> str:
    return line_key(title)


def outline(text: str, running: set[int], wide: set[int], title: str | None) -> tuple[list[str], dict[int, str], list[int]]:
    """A page's lines, kinds of those that aren't its own text, by place, and the places of those that are."""
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    full = [i for i, x in enumerate(lines) if x.strip()]
    kinds: dict[int, str] = {}
    own_title = _title_key(title) if title else ""

    def outer(i: int, outermost: bool) -> str | None:
        if page_number(lines[i], outermost):
            return "page_number"
        if _ends(lines[i]):
            return None
        if not (key := line_key(lines[i])):
            return None
        # A line as wide as the text, though it comes again, is the text's own, unless it holds the title.
        h = _hash64(key) >> 1
        return "header" if key == own_title or h in running or (own_title and own_title in key and h in wide) else None

    for order in (full, full[::-1]):
        for k, i in enumerate(order[:3]):
            if i in kinds or not (kind := outer(i, k == 0)):
                break
            kinds[i] = kind
    return lines, kinds, [i for i in range(len(lines)) if i not in kinds]



def paragraphs(lines: list[str], units: list[str]) -> list[tuple[int, int]]:
    """Spans of lines that make paragraphs: the cheapest, by dynamic programming over all lines.

    Ending a paragraph costs little at a blank line or a short line that ends a sentence, much within a sentence; a
    paragraph's length costs by how far it is from the usual one. Beyond the usual length that cost grows the slower the
    longer a paragraph is, so a begin that a later one undercuts is never the best again: only the others are kept.
    """
    n = len(lines)
    width = max((len(x.strip()) for x in lines), default=0) or 1
    blank = [not x.strip() for x in lines]

    def end_cost(j: int) -> float:
        if j == n:
            return 0.0
        if not units[j - 1] and blank[j - 1]:
            return 0.1
        last = lines[j - 1].rstrip()
        closed, short = bool(_final.search(last)), len(last.strip()) < 0.75 * width
        if blank[j]:
            return 3.0
        return 1.5 if closed and short else 4.0 if closed else 3.0 if short and len(last.strip()) < 0.4 * width else 8.0

    # A blank line within a paragraph costs, more so behind the end of a sentence.
    within = [0.0]
    for k in range(n):
        within.append(within[-1] + (0.0 if not blank[k] else 2.0 if k and _final.search(lines[k - 1].rstrip()) else 0.8))
    best, came = [0.0] + [math.inf] * n, [0] * (n + 1)
    old: list[int] = []  # begins at least USUAL_LINES back that no later one undercuts
    first = 0  # the first begin that two blank lines leave
    for j in range(1, n + 1):
        e = end_cost(j)
        if (i := j - 2) > 0 and blank[i - 1] and blank[i]:
            old, first = [], i
        if (i := j - USUAL_LINES) >= first:
            base = best[i] - within[i + 1]
            while old and best[old[-1]] - within[old[-1] + 1] >= base:
                old.pop()
            old.append(i)
        for i in [*old, *range(max(first, j - USUAL_LINES + 1), j)]:
            c = best[i] + e + 0.4 * abs(math.log((j - i) / USUAL_LINES)) + (within[j - 1] - within[i + 1] if j - i > 2 else 0.0)
            if c < best[j]:
                best[j], came[j] = c, i
    out, j = [], n
    while j > 0:
        out.append((came[j], j))
        j = came[j]
    return out[::-1]


def read_scans(pages: DataFrame, key: str, document: str, text: str, status: str, origin: str, titles: DataFrame | None = None, paragraphs_too: bool = True) -> DataFrame:
    """key, found ARRAY<STRUCT<line_no INT, kind STRING>> and repaired STRING of every scanned page.

    titles: document and title, the titles of documents. paragraphs_too False leaves `repaired` null, but decodes as well.
    """
    blank = F.col("text").isNull() | (F.trim("text") == "")
    rows = pages.select(F.col(key).alias("key"), F.col(document).alias("document"), F.col(text).alias("text"), (F.lower(F.trim(F.col(origin))) == "ocr").alias("scanned"), is_no_text(F.col(status)).alias("none")).dropDuplicates(["key"])
    # A page counts once, and what is counted is what is read. Neighbours in the stored table make lots.
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "pages")
    full = rows.filter(~blank & ~F.col("none")).withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    counts = materialize(_count(full), "counts")
    vocabulary = materialize(counts.filter("kind = 'w'").groupBy(F.col("document").alias("word")).agg(F.sum("n").alias("n")), "vocabulary")
    scanned = full.filter("scanned")
    notes = _running(counts, scanned.select("document"))
    if titles is not None:
        notes = notes.join(titles.select(F.col("document"), "title").dropDuplicates(["document"]), "document", "full")
    else:
        notes = notes.withColumn("title", F.lit(None).cast("string"))
    size = full.agg(F.avg(F.when(F.col("scanned"), F.octet_length("text"))).alias("bytes"), F.count("*").alias("n"), F.count_if("scanned").alias("scanned")).first()
    # Only scanned pages are in lots: their places are the further apart the fewer they are, up to a bound, as they may lie together.
    lot_pages = max(1, int(min(LOT_PAGES, int(LOT_BYTES / (size["bytes"] or 1))) * min(4, size["n"] / (size["scanned"] or 1))))
    total = vocabulary.filter(~F.col("word").startswith("\t")).agg(F.sum("n")).first()[0] or 0
    scanned = scanned.withColumn("lot", F.floor(F.col("place") / lot_pages))
    bits = scanned.sparkSession.sparkContext.broadcast(_bit_sets(vocabulary.filter(~F.col("word").startswith("\t"))))
    # What asks for a word asks for it parted by spaces as well.
    phrases = _phrases(full, bits).select(F.replace("word", F.lit(" "), F.lit("")).alias("word"), F.col("word").alias("form"), "n")
    known = _asked(scanned, bits).join(vocabulary.select("word", F.col("word").alias("form"), "n").unionByName(phrases), "word").select("lot", F.col("form").alias("word"), "n")
    # One document may have a large share of the pages: they are spread, and its notes copied.
    salt = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    spread = scanned.select("key", F.coalesce("document", F.lit("")).alias("document"), "text", "lot", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = spread.join(notes.withColumn("salt", salt), ["document", "salt"], "left").select("key", "text", "keys", "wide", "title", "lot")
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
    key_type = pages.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type]
    reader = Reader({}, total)

    def decode(pages: pa.Table, words: pa.Table) -> pa.Table:
        # What is remembered holds for all lots, as counts are those of the whole corpus.
        reader.begin(dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist())))
        found, repaired = [], []
        for t, keys, wide, title in zip(*(pages.column(c).to_pylist() for c in ("text", "keys", "wide", "title"))):
            kinds, whole = reader.read(*outline(t, set(keys or ()), set(wide or ()), title), bool(_cjk.search(t)), paragraphs_too)
            found.append([{"line_no": i, "kind": kind} for i, kind in kinds])
            repaired.append(whole)
        return pa.table({"key": pages.column("key").cast(arrow_key), "found": pa.array(found, kind), "repaired": pa.array(repaired, pa.string())})

    schema = f"key {key_type}, found array<struct<line_no:int,kind:string>>, repaired string"
    out = joined.groupBy("lot").cogroup(known.groupBy("lot")).applyInArrow(decode, schema)
    empty = rows.filter((blank | F.col("none")) & F.col("scanned")).select("key", F.expr("cast(array() as array<struct<line_no:int,kind:string>>)").alias("found"), F.lit("").alias("repaired"))
    return out.unionByName(empty).withColumnRenamed("key", key)


def _phrases(pages: DataFrame, sent: Broadcast) -> DataFrame:
    """word and n: words in a row, parted by spaces, that may be one word together, and how often all pages have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needs, found = Needs(*map(Bits, sent.value)), Counter()
        for batch in batches:
            needs.phrases(batch.column(0).to_pylist(), found)
            if len(found) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return pages.filter(~F.col("text").rlike(_cjk.pattern)).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _asked(scanned: DataFrame, sent: Broadcast) -> DataFrame:
    """lot and word: what the decoder may ask for in each lot, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needs = Needs(*map(Bits, sent.value))
        for batch in batches:
            lots: dict[int, tuple[list[str], list[str]]] = {}
            for lot, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lots.setdefault(lot, ([], []))[bool(_cjk.search(t))].append(t)
            for lot, (spaced, spaceless) in lots.items():
                words: set[str] = set()
                needs.spaced(spaced, words)
                needs.spaceless(spaceless, words)
                yield pa.RecordBatch.from_arrays([pa.array([lot] * len(words), pa.int64()), pa.array(words, pa.string())], names=["lot", "word"])

    return scanned.select("lot", "text").mapInArrow(run, "lot bigint, word string").distinct()
