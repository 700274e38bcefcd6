"""Scalar text functions as Column expressions. Arrow functions are used only for NFKC, casefold and literal parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() has it; null markers; answer format aliases; a number of a profile, perhaps in percent;
#: letters of Japanese and marked ones of Vietnamese; what an exact comparison strips; marks of a list's items.
PY_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
NULL_MARKS = ("", "na", "n/a", "nan", "none", "null", "<na>")
FORMATS = {"string": "string", "short_text": "string", "text": "string", "number": "number", "numeric": "number", "unordered_list": "unordered_list", "unordered": "unordered_list", "list": "unordered_list", "ordered_list": "ordered_list", "ordered": "ordered_list"}
NUMBER = r"^[+-]?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?%?$"
JAPANESE = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
VIETNAMESE = r"(?iu)[ăâđêôơưàáãèéìíĩòóõùúũý\x{1ea0}-\x{1ef9}]"
BULLETS = r"(?:^|\n)\s*(?:[-*•·]|\d+[.)])\s+"
STRIPPED = " \t\r\n\"'“”‘’.,;:。、「」『』()[]{}"


def strip(c: Column) -> Column:
    """Without Python's white space on both sides."""
    return F.trim(c, F.lit(PY_SPACE))


def nfkc_casefold(c: Column) -> Column:
    """NFKC, then casefold; Spark has no such function."""

    @F.pandas_udf("string")
    def run(s):  # noqa: ANN001, ANN202
        from unicodedata import normalize

        return s.map(lambda t: None if t is None else normalize("NFKC", t).casefold())

    return run(c)


def folded(c: Column, how: str = "nfkc_casefold") -> Column:
    """How texts are made alike before they are cut into tokens: nfkc_casefold, or lower, which stays in the JVM."""
    return {"nfkc_casefold": nfkc_casefold, "lower": F.lower}[how](c)


def segments(c: Column) -> Column:
    """Runs of letters and numbers of a folded text."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1)


def grams(c: Column, n: int) -> Column:
    """All runs of n characters of a string."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.concat(F.lit(f"c{n}:"), c.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Tokens of a folded text: each segment as a word, then its bigrams, then its trigrams; duplicates are kept."""
    return F.flatten(F.transform(segments(c), lambda s: F.concat(F.array(F.concat(F.lit("w:"), s)), grams(s, 2), grams(s, 3))))


def token_count(c: Column) -> Column:
    """The number of tokens of a folded text, without making them."""
    return F.aggregate(segments(c), F.lit(0), lambda n, s: n + 1 + F.greatest(F.length(s) - 1, F.lit(0)) + F.greatest(F.length(s) - 2, F.lit(0)))


def normalize_text(c: Column) -> Column:
    """A text for exact comparison: folded, white space collapsed, quotes, brackets and closing marks stripped."""
    t = strip(F.regexp_replace(nfkc_casefold(strip(c)), rf"[{PY_SPACE}]+", " "))
    return F.trim(t, F.lit(STRIPPED))


def number_key(text: str) -> str | None:
    """A canonical string of a number, percent divided by 100; None for other texts and numbers beyond decimal arithmetic. Equal numbers have equal keys."""
    import re
    from decimal import Decimal
    from unicodedata import normalize

    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(%?)\s*", normalize("NFKC", text).replace(",", ""))
    if not m:
        return None
    try:
        n = (Decimal(m[1]) / (100 if m[2] else 1)).normalize()
    except ArithmeticError:
        return None
    return str(n) if n else "0"


def comparable(text: str) -> str:
    """normalize_text for a Python worker."""
    from unicodedata import normalize

    return " ".join(normalize("NFKC", text).casefold().split()).strip(STRIPPED)


def decimal_key(c: Column) -> Column:
    """number_key of a column; null if a text is no number."""

    @F.pandas_udf("string")
    def run(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: None if t is None else number_key(t))

    return run(c)


def is_nullish(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*NULL_MARKS)


def answer_format(c: Column) -> Column:
    """The canonical answer format; null for an unknown one."""
    names = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.element_at(names, F.regexp_replace(F.lower(strip(c)), "[- ]", "_"))


def classify_language(c: Column, fallback: str | Column = "unknown") -> Column:
    rest = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(c.rlike(JAPANESE), "ja").when(c.rlike(VIETNAMESE), "vi").otherwise(rest)


def language_of_key(c: Column) -> Column:
    """The corpus language by a document's name."""
    stem = F.lower(F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1))
    return F.when(stem.startswith("j_"), "ja").when(stem.startswith("v_"), "vi").otherwise("unknown")


def split_of_key(c: Column) -> Column:
    k = F.lower(c)
    train, test = k.contains("/train_pdfs/") | k.endswith("/train.csv"), k.contains("/test_pdfs/") | k.endswith("/test.csv")
    return F.when(train, "train").when(test, "test").when(k.endswith("/sample_submission.csv"), "sample_submission").otherwise("unknown")


def _json_kind(c: Column) -> Column:
    """list, dict or number where a stripped text is wholly such JSON, else null. Only texts that may be are parsed."""

    @F.pandas_udf("string")
    def run(s):  # noqa: ANN001, ANN202
        import json

        def kind(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                x = json.loads(t)
            except (ValueError, RecursionError):
                return None
            return "list" if isinstance(x, list) else "dict" if isinstance(x, dict) else "number" if isinstance(x, int | float) and not isinstance(x, bool) else None

        return s.map(kind)

    may_be = c.rlike(r"(?s)^(?:\[.*\]|\{.*\})$") | c.rlike(r"^-?(?:\d[\d.eE+-]*|Infinity)$")
    return run(F.when(may_be, c))


def answer_type(c: Column) -> Column:
    """missing, list, number, list_like, short_text or long_text, in this order."""
    t = strip(c)
    kind = _json_kind(t)
    words = F.size(F.filter(F.split(t, rf"[{PY_SPACE}]+"), lambda w: w != ""))
    return (
        F.when(is_nullish(c), "missing")
        .when(kind == "list", "list")
        .when((kind == "number") | F.replace(t, F.lit(" "), F.lit("")).rlike(NUMBER), "number")
        .when(t.rlike("[|;\n]"), "list_like")
        .when(words <= 12, "short_text")
        .otherwise("long_text")
    )


def value_kind(c: Column) -> Column:
    """missing, numeric, string, list or dict."""
    t = strip(c)
    kind = _json_kind(t)
    return F.when(is_nullish(c), "missing").when(F.replace(t, F.lit(" "), F.lit("")).rlike(NUMBER), "numeric").when(kind.isin("list", "dict"), kind).otherwise("string")


def literal(text: str) -> object:
    """The value of a text that is JSON or a Python literal; the text itself where it is neither."""
    import ast
    import json
    import warnings

    for load in (json.loads, ast.literal_eval):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return load(text)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
    return text


def _whole(x: object) -> int | None:
    """A 32-bit number of a number, cut towards 0, or of a text; None where it is none."""
    try:
        n = int(x)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if abs(n) < 1 << 31 else None


def page_references(c: Column) -> Column:
    """Tolerant page numbers in order of first sight: items of a JSON list or literal, else the whole numbers of a free text.

    0 is permitted; what is no number, or below 0, is left out; null-like texts have none.
    """

    @F.pandas_udf("array<int>")
    def run(s):  # noqa: ANN001, ANN202
        import re

        whole = re.compile(r"(?<!\d)-?\d+(?!\d)")

        def pages(t: str | None) -> list[int]:
            if t is None:
                return []
            x = literal(t) if t[0] in "[({+-'\"0123456789." else t
            if isinstance(x, int | float) and not isinstance(x, bool):
                x = [x]
            found = (_whole(p) for p in (x if isinstance(x, list | tuple | set) else whole.findall(t)))
            return list(dict.fromkeys(p for p in found if p is not None and p >= 0))

        return s.map(pages)

    return run(F.when(~is_nullish(c), strip(c)))


def evidence_pages(c: Column) -> Column:
    """Strict page numbers, sorted and unique, of JSON, a literal or the digits of a free text; null where one is no number or below 1."""

    @F.pandas_udf("array<int>")
    def run(s):  # noqa: ANN001, ANN202
        import re

        def pages(t: str | None) -> list[int] | None:
            if not t:
                return None if t is None else []
            x = literal(t)
            x = re.findall(r"\d+", x) if isinstance(x, str) else [x] if isinstance(x, int) else x
            found = [_whole(p) for p in x] if isinstance(x, list | tuple | set) else [None]
            return None if any(p is None or p < 1 for p in found) else sorted(set(found))

        return s.map(pages)

    return run(strip(c))


def list_answer(c: Column) -> Column:
    """Items of a list answer: a JSON list, bullets, or the first of line feed, semicolons and bars that parts the text."""
    t = strip(c)
    clean = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")

    @F.pandas_udf("array<string>")
    def items(s):  # noqa: ANN001, ANN202
        def one(t: str | None) -> list[str] | None:
            x = None if t is None else literal(t)
            return [str(i).strip() for i in x] if isinstance(x, list | tuple) else None

        return s.map(one)

    as_json = items(F.when(t.rlike(r"(?s)^[\[(].*[\])]$"), t))
    bullets = clean(F.split(t, BULLETS))
    out = F.array(t)
    for mark in (r"\|", "；", ";", "\n"):
        parts = clean(F.split(t, mark))
        out = F.when(F.size(parts) > 1, parts).otherwise(out)
    out = F.when(F.size(bullets) > 1, bullets).otherwise(out)
    out = F.when(as_json.isNotNull(), clean(as_json)).otherwise(out)
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(out)


def unspaced_japanese(c: Column) -> Column:
    """Without the white space that recognition puts between Japanese characters."""
    return F.regexp_replace(c, rf"(?<={JAPANESE})\s+(?={JAPANESE})", "")


def page_as_text(title: Column, lines: Column, status: Column) -> Column:
    """Title and lines of a page joined by line feeds, empty unless its status is ok."""
    return F.when(status == "ok", F.concat_ws("\n", title, lines)).otherwise("")


#: What a log must not show. A digest may hold twelve digits; an account is twelve and no more.
DIGEST = r"\b(?:[0-9a-f]{64}|[0-9a-f]{40})\b"
ACCOUNT = r"(?<!\p{Nd})\p{Nd}{12}(?!\p{Nd})"
BUCKET = r"s3://[^/\s]+"
SECRET = r"(?i)(?:bearer\s+[a-z0-9._~+/=-]+|aws_secret_access_key\s*[=:]\s*\S+|aws_access_key_id\s*[=:]\s*\S+)"
#: Keys whose values are never shown, and ends of such keys; keys that public facts leave out.
SENSITIVE = (
    "access_token answer aws_account_id credential credentials native_text page_text password private_key prompt question "
    "raw_answer raw_content raw_prompt raw_question raw_response reference_answer secret secret_access_key token"
).split()
SENSITIVE_ENDS = ("_secret", "_password", "_private_key", "_access_token")
BLOCKED = ("bucket", "manifest_s3_uri", "output_s3_prefix", "private_manifest_s3_uri", "private_manifest_version_id")


def redact(c: Column) -> Column:
    """12-digit accounts outside digests, bucket names, bearer tokens and access keys masked."""
    between = F.transform(F.split(c, DIGEST), lambda t: F.regexp_replace(t, ACCOUNT, "<redacted-account>"))
    digests = F.concat(F.regexp_extract_all(c, F.lit(f"({DIGEST})"), 1), F.array(F.lit("")))
    t = F.array_join(F.zip_with(between, digests, lambda a, b: F.concat(a, b)), "")
    return F.regexp_replace(F.regexp_replace(t, BUCKET, "s3://<redacted-bucket>"), SECRET, "<redacted-secret>")


def _redactor():  # noqa: ANN202
    """redact for a Python worker."""
    import re

    account = re.compile(f"({DIGEST})|" + ACCOUNT.replace(r"\p{Nd}", r"\d"))
    bucket, secret = re.compile(BUCKET), re.compile(SECRET)
    return lambda t: secret.sub("<redacted-secret>", bucket.sub("s3://<redacted-bucket>", account.sub(lambda m: m[1] or "<redacted-account>", t)))


def sanitizer():  # noqa: ANN201
    """A function that redacts a JSON value throughout: texts are redacted, values of sensitive keys replaced, numbers that aren't finite become texts."""
    import math

    redacted = _redactor()

    def clean(x: object, key: str | None = None) -> object:
        if key is not None and ((k := key.strip().lower()) in SENSITIVE or k.endswith(SENSITIVE_ENDS)):
            return "<redacted>"
        if isinstance(x, dict):
            return {k: clean(v, k) for k, v in x.items()}
        if isinstance(x, list):
            return [clean(v) for v in x]
        if isinstance(x, float) and not math.isfinite(x):
            return str(x)
        return redacted(x) if isinstance(x, str) else x

    return clean


def _json_map(c: Column, change: str, returns: str = "string") -> Column:
    @F.pandas_udf(returns)
    def run(s):  # noqa: ANN001, ANN202
        import hashlib
        import json

        clean = sanitizer()

        def one(t: str | None) -> str | None:
            if t is None or (change == "event" and not t.strip().startswith("{")):
                return None
            try:
                x = json.loads(t.strip())
            except (ValueError, RecursionError):
                return None
            if change == "public":
                x = {k: v for k, v in x.items() if k not in BLOCKED} if isinstance(x, dict) else None
            if change == "event" and not (isinstance(x, dict) and {"event", "component", "timestamp_utc"} <= set(x)):
                return None
            if x is None and change == "public":
                return None
            out = json.dumps(clean(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            return hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest() if change == "hash" else out

        return s.map(one)

    return run(c)


def sanitize_json(c: Column) -> Column:
    """JSON sanitized throughout, keys sorted, without spaces; null where the text is no JSON."""
    return _json_map(c, "all")


def stable_hash(c: Column) -> Column:
    """SHA-256 of sanitized JSON; equal for texts that differ in the order of keys and in spaces only."""
    return _json_map(c, "hash")


def public_metadata(c: Column) -> Column:
    """A JSON object without the keys that public facts leave out, sanitized; null for other texts."""
    return _json_map(c, "public")


def event_line(c: Column) -> Column:
    """A log line that is a structured event (event, component, timestamp_utc), sanitized; null for all other output."""
    return _json_map(c, "event")


def stable_seed(seed: int, c: Column) -> Column:
    """The first 8 bytes of SHA-256 of "seed:id" as a number, modulo 2^31 - 1."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256), 1, 16)
    return F.pmod(F.conv(head, 16, 10).cast("decimal(20,0)"), F.lit(2147483647).cast("decimal(20,0)")).cast("bigint")


def safe_identifier(c: Column, sequence: Column | None = None) -> Column:
    """A slug of at most 60 characters and 16 digits of the SHA-256; response-NNNNNN by sequence (or 0) where nothing is left of a name."""
    slug = F.trim(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "-"), F.lit("-._"))
    name = F.concat(F.substring(slug, 1, 60), F.lit("-"), F.substring(F.sha2(c, 256), 1, 16))
    return F.when(slug != "", name).otherwise(F.format_string("response-%06d", F.lit(0) if sequence is None else sequence))


def s3_parts(c: Column) -> Column:
    """STRUCT<bucket, key> of an s3:// address; nulls where it is none."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^s3://([^/]+)/(.+)$", i), F.lit(""))
    return F.struct(part(1).alias("bucket"), part(2).alias("key"))


def format_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def canonical_json(c: Column) -> Column:
    """A struct as JSON without spaces and with a line feed; fields must be in the order wanted."""
    return F.concat(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("\n"))
