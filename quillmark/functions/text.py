"""Text functions as columns. Each takes and returns Columns, stays inside the JVM, and treats null as empty text unless said."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that signal a cp1252 round trip, apostrophes, stop words of titles, reference patterns.
MOJIBAKE_SIGNALS = "ÂÃâ€™“”˜Å¸¢£¤¥¦§¨©ª«¬®¯°±"
APOSTROPHES = "'’‘`´"
#: What Unicode calls white space, and (?U)\s matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LEADING_STOPWORDS = [
    "the", "a", "an", "of", "for", "to", "and", "in", "on", "at", "by", "with", "supply", "supplies", "provision", "purchase", "procurement", "delivery", "installation",
    "maintenance", "servicing", "service", "hire", "lease", "replacement", "upgrade", "framework", "contract", "tender", "notice", "invitation", "request", "call", "off",
    "lot", "re", "new", "used",
]
TITLE_REF = r"\b(UKRI[-\s]?\d{3,6}|PAPI[-\s]?\d+\.\d+|CEFAS\d{2}[-\s]?\d+|[A-Z]{2,6}\d{4,8}|[A-Z]{2,5}[-/]\d{2,4}[-/][A-Z0-9]{2,8})\b"
AWARD_SUFFIX = r"(?i)\s*[-–—]\s*(award(ed)?|contract award notice|cancellation|cancelled|amendment)\s*$"


def text_of(title: Column, description: Column) -> Column:
    """Title and description as one trimmed text."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))), F.lit(WHITE_SPACE))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\r\t]]", "")


# ASCII is folded in two passes. Characters are listed one by one: Java then looks each up in a table of bits.
_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
_ASCII_DROPPED = "[" + "".join(rf"\x{i:02x}" for i in [*range(9), 11, 12, *range(14, 32), 127]) + "'`]"
_ASCII_GAP = rf"[^{_ALNUM}$+<=>\^|~]+"
_GAP = rf"(?U)[[^{_ALNUM}]&&[\s\p{{P}}]]+"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip_punctuation(text: Column) -> Column:
    """Apostrophes go, other punctuation becomes a space, symbols stay."""
    return F.regexp_replace(F.translate(text, APOSTROPHES, ""), r"\p{P}", " ")


def normalise_plain(text: Column) -> Column:
    """Normal form by built-in functions, for texts that needs_exact() clears: exact for texts that are NFKC already, carry no cp1252 damage and whose case
    folding is that of lower() and sharp s. The operators call normalise(), which covers the rest."""
    folded = F.replace(F.lower(strip_control(text)), F.lit("ß"), F.lit("ss"))
    # A run of white space and punctuation becomes one space.
    any_text = F.regexp_replace(F.regexp_replace(folded, f"[{APOSTROPHES}]", ""), _GAP, " ")
    ascii_text = F.regexp_replace(F.regexp_replace(F.lower(text), _ASCII_DROPPED, ""), _ASCII_GAP, " ")
    return F.when(text.isNull(), "").otherwise(F.trim(F.when(is_ascii(text), ascii_text).otherwise(any_text)))


def needs_exact(text: Column) -> Column:
    """Whether a text may differ between normalise_plain() and normalise(). Damage by cp1252 can only be undone where every
    accented letter is followed by another character beyond ASCII, as the bytes of UTF-8 are."""
    # All but ASCII and accented letters, as a plain class: Java takes far longer over the negated class of the same characters.
    other, signal, sound = r"[\x80-\xBF×÷\x{100}-\x{10FFFF}]", f"[{MOJIBAKE_SIGNALS}]", r"[À-ÿ](?:[\x00-\x7F]|$)"
    return F.coalesce(text.rlike(other) | (~text.rlike(sound) & text.rlike(signal)), F.lit(False))


def repair_encoding(text: str) -> str:
    """Undo UTF-8 read as cp1252 where that succeeds and changes the text; drop replacement characters."""
    if any(c in MOJIBAKE_SIGNALS for c in text):

        def back(c: str) -> bytes:
            try:
                return c.encode("cp1252")
            except UnicodeEncodeError:
                return c.encode("latin-1")  # the slots that cp1252 leaves open

        try:
            text = b"".join(map(back, text)).decode("utf-8")
        except UnicodeError:
            pass
    return text.replace("�", "")


class _Folds(dict):
    """For str.translate: control characters and apostrophes go, other punctuation becomes a space."""

    def __missing__(self, code: int) -> int | str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        self[code] = to = None if c in APOSTROPHES or (kind == "Cc" and c not in "\n\r\t") else " " if kind[0] == "P" else code
        return to


_FOLDS = _Folds()


def normalise_str(text: str | None) -> str:
    """The whole normal form of one text."""
    if not text:
        return ""
    # Case folding neither makes nor needs control characters, so they go with the punctuation.
    return " ".join(unicodedata.normalize("NFKC", repair_encoding(text)).casefold().translate(_FOLDS).split())


@F.pandas_udf(StringType())
def _exact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s if s.isna().all() else s.map(normalise_str, na_action="ignore")


def normalise(text: Column) -> Column:
    """The normal form of any text: only texts that need it pay for Python (the others go through as null, and ASCII is not even
    looked at)."""
    hard = F.when(~is_ascii(text) & needs_exact(text), text)
    return F.coalesce(_exact(hard), normalise_plain(text))


def key_of(normal: Column) -> Column:
    """Comparison key of a normal form."""
    return F.regexp_replace(normal, "[^0-9a-z]+", "")


def normalise_frame(df: DataFrame, columns: Iterable[str] = ("title", "description"), exact: bool = True) -> DataFrame:
    """Adds <c>_norm and <c>_key; columns that are missing are skipped."""
    make = normalise if exact else normalise_plain
    there = [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}_norm": make(F.col(c)) for c in there}).withColumns({f"{c}_key": key_of(F.col(f"{c}_norm")) for c in there})


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def _windows(word: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))


def token_grams(normal: Column, n: int = 3) -> Column:
    """Distinct n-grams inside tokens; a shorter token stands for itself."""
    return F.array_distinct(F.flatten(F.transform(tokens(normal), lambda w: F.when(F.length(w) < n, F.array(w)).otherwise(_windows(w, n)))))


def gram_key(normal: Column, n: int = 3, k: int = 4) -> Column:
    """The first k distinct grams in order, joined by '|'; null without grams."""
    return F.nullif(F.array_join(F.slice(F.array_sort(token_grams(normal, n)), 1, k), "|"), F.lit(""))


def leading_token(normal: Column, stopwords: Iterable[str] = LEADING_STOPWORDS) -> Column:
    """First token that is neither a stop word nor a number; null without one."""
    stop = list(stopwords)
    good = F.filter(tokens(normal), lambda w: ~w.isin(stop) & ~w.rlike(r"^\p{N}+$"))
    return F.get(good, 0)


def padded_grams(normal: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams of low to high characters of each token with a space on both sides, with repeats. A padded token no
    longer than n counts once, for the first such n."""

    def of(p: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            once = F.length(p) <= n
            first = once & (F.length(p) > n - 1) if n > low else once
            parts.append(F.when(F.length(p) > n, _windows(p, n)).when(first, F.array(p)).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*parts))

    padded = F.transform(tokens(normal), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, of))


def grams_of(normal: str, low: int = 2, high: int = 4) -> list[str]:
    """padded_grams() of one text, for tasks that have it in Python."""
    out = []
    for w in normal.split(" "):
        if w:
            p = f" {w} "
            for n in range(low, high + 1):
                if len(p) > n:
                    out += [p[i : i + n] for i in range(len(p) - n + 1)]
                elif n == low or len(p) == n:
                    out.append(p)
    return out


def title_refs(title: Column) -> Column:
    """Distinct references written in a title, letters and digits only."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(TITLE_REF), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.upper(m), "[^A-Z0-9]", ""))))


def procurement_ref(ref: Column) -> Column:
    """Root of a reference: without its stage suffix, lower case, letters and digits; null is empty."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.coalesce(ref, F.lit(""))), AWARD_SUFFIX, "")), "[^a-z0-9]", "")


def vector_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.chr(F.lit(0)), F.coalesce(text, F.lit(""))), 256)


def completion_key(model: Column, system: Column, prompt: Column, schema: Column) -> Column:
    return F.sha2(F.concat(*(F.coalesce(c, F.lit("")) for c in (model, system, prompt, schema))), 256)


def token_estimate(system: Column, prompt: Column, max_tokens: int) -> Column:
    return F.floor((F.length(F.coalesce(system, F.lit(""))) + F.length(F.coalesce(prompt, F.lit("")))) / 4).cast("long") + max_tokens


def latex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%_])", r"\\$1")


def register(spark) -> None:
    """normalise_text(x) and normalise_key(x) for SQL."""
    spark.udf.register("normalise_text", _exact)
    key = F.pandas_udf(lambda s: s.map(lambda t: "".join(c for c in normalise_str(t) if c in "0123456789abcdefghijklmnopqrstuvwxyz")), StringType())
    spark.udf.register("normalise_key", key)
