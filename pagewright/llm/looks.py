"""Problem 3: one consistent form for texts that look the same.

Method: script-aware repair. NFKC and the removal of characters without width bring most forms together. What remains
are look-alike letters: for each token its dominant script is determined, and look-alikes of another script are replaced
by those of that script, only in tokens of mixed script, and only where the result is a token of the corpus itself.
A token that is written wholly in look-alikes counts as mixed with the text around it, if that is of the other script.

Two kinds of tokens are repaired:
* runs of Latin, Greek and Cyrillic letters. The dominant script is that of most letters that look like none of another
  script; where all letters are ambiguous, that of the text around. The form in that script must be a token of the corpus;
* runs of katakana and of characters that look like katakana (and the reverse): a run of katakana letters with such
  characters in it must be a katakana run of the corpus; where a katakana letter stands alone, the two forms are compared
  by how often the corpus has them between the same neighbours.

The vocabulary covers all texts. It is neither collected nor broadcast: suspect tokens are joined to it.

Defined results: a null text stays null; an empty text stays empty. Line ends become line feeds. White space keeps its
count, each kind as NFKC has it. Letter case, accents, voicing marks and digits are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Characters without width; letters that NFKC keeps apart from the usual ones, marks among them.
NO_WIDTH = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
SAME = {"Ð": "Đ", "Ɖ": "Đ", "‐": "-", "‑": "-", "‒": "-", "−": "-", "ʼ": "’", "\r": "\n"}
#: Characters of other scripts that look like katakana letters.
LIKE_KANA = {"一": "ー", "口": "ロ", "力": "カ", "二": "ニ", "八": "ハ", "夕": "タ", "卜": "ト", "工": "エ", "へ": "ヘ", "才": "オ", "千": "チ", "三": "ミ", "り": "リ", "べ": "ベ", "ぺ": "ペ"}
FROM_KANA = {k: c for c, k in LIKE_KANA.items()}
#: Letters that look alike in Latin, Cyrillic and Greek; a dot where a script has none.
ALIKE = "AАΑ BВΒ CС. EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ QԚ. SЅ. TТΤ WԜ. XХΧ YУΥ YҮΥ Z.Ζ aа. cс. dԁ. eе. hһ. iі. jј. lӏ. oоο pрρ qԛ. sѕ. v.ν wԝ. xх. yу. yү.".split()
#: Salts of joins on texts that many rows may share.
SALTS = 16
#: Words are held back up to so many for each task before they are sent on.
HELD = 200_000

_SCRIPTS = ("latin", "cyrillic", "greek")
#: For each script, letters of the others as its own.
_into: dict[str, dict[str, str]] = {x: {} for x in _SCRIPTS}
for _row in ALIKE:
    for _to, _own in zip(_SCRIPTS, _row):
        for _c in _row:
            if "." not in (_own, _c) and _c != _own:
                _into[_to].setdefault(_c, _own)
_ambiguous = {c for row in ALIKE for c in row} - {"."}
_foreign = re.compile("[Ͱ-ԯ]")
_letters = re.compile(r"[^\W\d_]+")
_marked = re.compile("[A-Za-zÀ-ÖØ-öø-ʯ̀-ԯḀ-ỿ]+")
_latin_words = re.compile("[A-Za-z]+")
_no_width = re.compile(f"[{NO_WIDTH}]")
_odd_same = re.compile("[" + "".join(re.escape(c) for c in SAME) + "]")
_like, _from = "".join(LIKE_KANA), "".join(FROM_KANA)
_kana_run = re.compile(f"[ァ-ヺー{_like}]+")
_pure_run = re.compile("[ァ-ヺー]{2,}")
_tail = re.compile("[ァ-ヺー]+ヘ(?![ァ-ヺー])")
_lone = re.compile(f"(?<![ァ-ヺー])[{_from}](?![ァ-ヺー])")
_near_like = re.compile(f"(?<![ァ-ヺー])[{_like}](?![ァ-ヺー])")
_cjk = re.compile("[ぁ-ヺ一-鿿]")


def fold(text: str) -> str:
    """The part of the form that needs no vocabulary."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if not text.isascii():
        if _no_width.search(text):
            text = _no_width.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
            text = _no_width.sub("", text)
    return _odd_same.sub(lambda m: SAME[m[0]], text) if _odd_same.search(text) else text


def _trigram(text: str, at: int, c: str) -> str:
    """The character c between the neighbours of place at; digits are alike."""
    a, b = text[at - 1 : at] or "^", text[at + 1 : at + 2] or "$"
    return ("0" if a.isdigit() else a) + c + ("0" if b.isdigit() else b)


def _variants(run: str) -> list[str]:
    """Katakana forms of a run with look-alikes in it, whole first, then with the look-alikes at its ends kept."""
    out = []
    for a in range(len(run)):
        if a and run[a - 1] not in LIKE_KANA:
            break
        for b in range(len(run), a, -1):
            if b < len(run) and run[b] not in LIKE_KANA:
                break
            mid = run[a:b]
            form = "".join(LIKE_KANA.get(c, c) for c in mid)
            if len(form) > 1:  # the run as it stands is one of them, if only its ends are look-alikes
                out.append(run[:a] + form + run[b:])
    return out


def _script(c: str) -> str | None:
    """The script of a letter; None for marks and letters of all other scripts."""
    if c < "\u0250" or "Ḁ" <= c <= "ỿ":
        return "latin" if c.isalpha() else None
    return "greek" if "Ͱ" <= c < "Ѐ" else "cyrillic" if "Ѐ" <= c < "\u0530" else None


def dominant(text: str) -> str | None:
    """The script of most letters that look like none of another script; None where there are no such letters."""
    n = dict.fromkeys(_SCRIPTS, 0)
    for c in text:
        if c not in _ambiguous and (script := _script(c)):
            n[script] += 1
    best = max(_SCRIPTS, key=n.get)
    return best if n[best] else None


def suspects(text: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(token, [(form, what the vocabulary must hold)]) for each token of a folded text that may need repair."""
    out: dict[str, list[tuple[str, str]]] = {}
    if text.isascii():
        return []
    if _foreign.search(text):
        around = None
        for w in set(_marked.findall(text)):
            if not _foreign.search(w):
                continue
            around = around or dominant(text) or "latin"
            target = dominant(w) or around
            form = "".join(_into[target].get(c, c) if _script(c) not in (None, target) else c for c in w)
            form = unicodedata.normalize("NFC", form)
            if form != w and all(_script(c) in (None, target) for c in form):
                out[w] = [(form, "w:" + form)]
    if _cjk.search(text):
        for run in set(_kana_run.findall(text)):
            if any(c in LIKE_KANA for c in run) and any("ァ" <= c <= "ヺ" for c in run):
                forms = _variants(run) + ([f + "へ" for f in _variants(run[:-1])] if run[-1] == "ヘ" else [])
                if forms:
                    out["k:" + run] = [(f, "k:" + "".join(_pure_run.findall(f)[:1])) for f in forms]
        for run in set(_tail.findall(text)) if "ヘ" in text else ():
            out["k:" + run] = [(run[:-1] + "へ", "k:" + run[:-1])]
        for m in _lone.finditer(text):
            here = _trigram(text, m.start(), m[0])
            out["t:" + here] = [(_trigram(text, m.start(), FROM_KANA[m[0]]), "t:" + _trigram(text, m.start(), FROM_KANA[m[0]]))]
    return list(out.items())


def words_of(text: str) -> Iterator[str]:
    """What a folded text adds to the vocabulary."""
    for w in _letters.findall(text) if not _cjk.search(text) else _latin_words.findall(text):
        if not _foreign.search(w) or len({_script(c) for c in w} - {None}) == 1:
            yield "w:" + w
    if not text.isascii() and _cjk.search(text):
        for run in _kana_run.findall(text):
            if len(run) > 1 and not any(c in LIKE_KANA for c in run):
                yield "k:" + run
        for m in chain(_near_like.finditer(text), _lone.finditer(text)):
            yield "t:" + _trigram(text, m.start(), m[0])


def repair(text: str, forms: dict[str, str]) -> str:
    """A folded text with the tokens that forms names replaced."""
    text = _marked.sub(lambda m: forms.get(m[0], m[0]), text) if any(k[1:2] != ":" for k in forms) else text
    if any(k.startswith("k:") for k in forms):
        text = _kana_run.sub(lambda m: forms.get("k:" + m[0], m[0]), text)
    if any(k.startswith("t:") for k in forms):
        text = _lone.sub(lambda m: FROM_KANA[m[0]] if "t:" + _trigram(m.string, m.start(), m[0]) in forms else m[0], text)
    return text


def _scan(rows: DataFrame, keep_text: bool) -> DataFrame:
    """One pass over the texts: their folded forms and suspects, and, in rows without a number, vocabulary counts.

    keep_text: keep every folded text; else only those with suspects, and a digest of the others.
    """
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text"]
    own = [f.name for f in rows.schema.fields if f.name != "_text"]
    types = [pa.string() if f.dataType.simpleString() == "string" else pa.int64() for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([*kinds, "_folded string, _digest binary, _suspects array<struct<token:string,forms:array<struct<form:string,need:string>>>>, _word string, _n bigint"])
    pair = pa.list_(pa.struct([("form", pa.string()), ("need", pa.string())]))
    nested = pa.list_(pa.struct([("token", pa.string()), ("forms", pair)]))

    def counts(held: dict[str, int]) -> pa.RecordBatch:
        n = len(held)
        empty = [pa.nulls(n, t) for t in [*types, pa.string(), pa.binary(), nested]]
        return pa.RecordBatch.from_arrays([*empty, pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=[*own, "_folded", "_digest", "_suspects", "_word", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        held: dict[str, int] = {}
        for batch in batches:
            folded, digests, found = [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                f = None if t is None else fold(t)
                s = suspects(f) if f else []
                folded.append(f if keep_text or s else None)
                digests.append(None if f is None or not f.strip() else blake2b(f.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                found.append([{"token": k, "forms": [{"form": a, "need": b} for a, b in v]} for k, v in s])
                for w in words_of(f) if f else ():
                    held[w] = held.get(w, 0) + 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).cast(t) for i, t in enumerate(types)), pa.array(folded, pa.string()), pa.array(digests, pa.binary()), pa.array(found, nested), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
                names=[*own, "_folded", "_digest", "_suspects", "_word", "_n"],
            )
            if len(held) > HELD:
                yield counts(held)
                held = {}
        if held:
            yield counts(held)

    return rows.mapInArrow(run, schema)


def _forms(scan: DataFrame) -> DataFrame:
    """_token and _form: the repairs that the corpus vocabulary bears out."""
    vocabulary = scan.filter(F.col("_word").isNotNull()).groupBy(F.col("_word").alias("need")).agg(F.sum("_n").alias("n"))
    tokens = scan.filter(F.size("_suspects") > 0).select(F.explode("_suspects").alias("s")).select("s.token", F.explode("s.forms").alias("f")).select("token", "f.form", "f.need").distinct()
    own = vocabulary.select(F.col("need").alias("token"), F.col("n").alias("own"))
    held = tokens.join(vocabulary, "need").join(own, "token", "left")
    # A token that the corpus has as it is must be rarer than what replaces it.
    held = held.filter(F.col("n") > F.coalesce("own", F.lit(0)))
    return held.groupBy(F.col("token").alias("_token")).agg(F.max_by("form", F.struct("n", "form")).alias("_form"))


def _repaired(folded: Column, tokens: Column, forms: Column) -> Column:
    @F.pandas_udf("string")
    def run(f, a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([t if x is None else repair(t, dict(zip(x, y))) for t, x, y in zip(f, a, b)], dtype=object)

    return run(folded, tokens, forms)


def canonical(rows: DataFrame, text: str, keys: list[str], keep_text: bool = True) -> DataFrame:
    """keys, and the text's one form as `canonical` and its 16-byte `digest`, for each row. Rows with the same keys must have the same text.

    Null and blank texts have a null digest. With keep_text False, `canonical` is there only for texts that held suspects; the digest is there for all.
    """
    scan = materialize(_scan(rows.select(*keys, F.col(text).alias("_text")), keep_text), "looks")
    texts = scan.filter(F.col("_word").isNull())
    odd = texts.filter(F.size("_suspects") > 0)
    used = odd.select(*keys, F.explode("_suspects.token").alias("_token")).join(_forms(scan), "_token")
    used = used.groupBy(*keys).agg(F.collect_set(F.struct("_token", "_form")).alias("_used"))
    fixed = odd.select(*keys, "_folded").join(used, keys, "left")
    form = _repaired(F.col("_folded"), F.col("_used._token"), F.col("_used._form"))
    fixed = fixed.select(*keys, form.alias("canonical")).select(*keys, "canonical", _digest(F.col("canonical")).alias("digest"))
    rest = texts.filter(F.size("_suspects") == 0).select(*keys, F.col("_folded").alias("canonical"), F.col("_digest").alias("digest"))
    return fixed.unionByName(rest)


def _digest(text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s):  # noqa: ANN001, ANN202
        from hashlib import blake2b

        return s.map(lambda t: None if t is None else blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())

    return run(text)


def same_look_pairs(forms: DataFrame, group: list[str], key: str, stored: str) -> DataFrame:
    """Pairs key_a < key_b of one group with one digest whose stored values differ. Blank and null texts are in no pair.

    forms has a row for each key: group, key, digest, and stored, a hash of the stored value. Only digests that occur
    with two different stored values are joined, so groups of exact copies add nothing; rows of one digest are spread
    over several tasks. look_classes has the same without pairs.
    """
    on = [*group, "digest"]
    many = forms.groupBy(*on).agg(F.min(stored).alias("lo"), F.max(stored).alias("hi")).filter("lo < hi").select(*on)
    rows = forms.join(many, on)
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    a = rows.select(*on, F.col(key).alias("key_a"), F.col(stored).alias("stored_a"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_salt"))
    b = rows.select(*on, F.col(key).alias("key_b"), F.col(stored).alias("stored_b"), salts.alias("_salt"))
    return a.join(b, [*on, "_salt"]).filter((F.col("key_a") < F.col("key_b")) & (F.col("stored_a") != F.col("stored_b"))).select(*group, "key_a", "key_b")


def look_classes(forms: DataFrame, group: list[str], key: str, stored: str) -> DataFrame:
    """group, key, class_id, members and spellings of every row with a digest: the smallest key that looks the same, how many rows do, and how many ways they are stored in."""
    on = [*group, "digest"]
    each = forms.groupBy(*on, stored).agg(F.min(key).alias("least"), F.count("*").alias("n"))
    classes = each.groupBy(*on).agg(F.min("least").alias("class_id"), F.sum("n").alias("members"), F.count("*").alias("spellings"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    rows = forms.select(*on, key, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_salt"))
    return rows.join(classes.withColumn("_salt", salts), [*on, "_salt"]).select(*group, key, "class_id", "members", "spellings")
