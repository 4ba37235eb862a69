"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed rules and always stay. The method adds kinds of its own: a pattern
proposes a span; its validator (mod-97 for iban and the French number, mod-23 for the Spanish one, digits of phones,
entropy of secrets) gives a first score or refuses it; words nearby that speak for the kind raise the score, words that
speak for another number lower it; spans of THRESHOLD or more stay, unless a base span or one of a kind before lies
there. A phone number that runs on into another base span, and so fails the base rule, is cut where that begins. Offsets
are code points, the end is exclusive. One Arrow pass over whole texts, no shuffle; a lost executor costs its own tasks.

Edge cases: a null or empty text has no spans. Very long texts are scanned whole in linear time, however many spans they
hold. Ties: of overlapping spans of the method the kind named first in EXTRA stays, of one kind the leftmost. Repeated rows
are scanned each for itself. scan() reads the id and text alone, masked() keeps all other columns as they are, so names
never clash; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded

#: Fixed values of the contract.
KINDS = ["email", "ip", "card", "phone"]
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# Those two are searched in forms that find the same matches in linear time, on runs of any length.
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds of the method, after the base ones.
EXTRA = ["intl_phone", "iban", "national_id", "local_phone", "secret"]
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL = re.compile(r"(?<![\w+.])(?:\([0-9]{2,5}\)\x20?)?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![\w])")
#: Numbers of persons: United States (no check digit), Spain, France.
NATIONAL = re.compile(r"(?<![\w-])(?:([0-9]{3}-[0-9]{2}-[0-9]{4})|([0-9]{8}-?[A-Z])|([12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}))(?![\w-])")
#: Check letters of the Spanish number by its remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Runs that may be a key; and forms that name themselves.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
NAMED_SECRET = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,})")
CONTEXT = {
    "intl_phone": set(),
    "iban": {"iban", "account", "konto", "compte", "cuenta", "bank"},
    "national_id": {"ssn", "social", "security", "id", "ausweis", "dni", "nif", "insee"},
    "local_phone": {"phone", "tel", "telephone", "telefon", "call", "mobile", "fax", "teléfono", "téléphone", "handy"},
    "secret": {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "credentials", "passwort", "clave"},
}
#: Words that speak for another kind of number.
AGAINST = {
    "intl_phone": set(),
    "iban": set(),
    "national_id": {"part", "model", "isbn", "invoice"},
    "local_phone": {"isbn", "invoice", "order", "version", "part", "model", "date"},
    "secret": {"sha", "sha1", "sha256", "md5", "commit", "checksum", "digest"},
}
CONTEXT_CHARS, CONTEXT_GAIN, CONTEXT_LOSS, THRESHOLD = 40, 0.4, 0.3, 0.5
LEAST_ENTROPY = 3.0
WORD = re.compile(r"\w+")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern: at each @, all it can take on the left that no match has taken, and a domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _phone_runs(text: str, taken: tuple[list[int], list[int]]) -> Iterator[tuple[int, int, float]]:
    for m in PHONE.finditer(text) if "+" in text else ():
        if len(digits_of(m[0])) > 15:  # up to the base span that it runs into
            k = bisect_right(taken[0], m.start())
            a, b = m.start(), taken[0][k] if k < len(taken[0]) else m.end()
            own = text[a : min(b, m.end())].rstrip(" ().-")
            if 9 <= len(digits_of(own)) <= 15:
                yield a, a + len(own), 0.6


def _ibans(text: str, taken: tuple[list[int], list[int]]) -> Iterator[tuple[int, int, float]]:
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield *m.span(), 0.6


def _national(text: str, taken: tuple[list[int], list[int]]) -> Iterator[tuple[int, int, float]]:
    for m in NATIONAL.finditer(text):
        if m[1]:
            yield *m.span(), 0.2
        elif m[2] and DNI_LETTERS[int(m[2][:8]) % 23] == m[2][-1]:
            yield *m.span(), 0.5
        elif m[3] and 97 - int((own := digits_of(m[3]))[:13]) % 97 == int(own[13:]):
            yield *m.span(), 0.5


def _local_phones(text: str, taken: tuple[list[int], list[int]]) -> Iterator[tuple[int, int, float]]:
    for m in LOCAL.finditer(text):
        if 7 <= len(digits_of(m[0])) <= 15:
            yield *m.span(), 0.2


def _secrets(text: str, taken: tuple[list[int], list[int]]) -> Iterator[tuple[int, int, float]]:
    for m in SECRET.finditer(text):
        if NAMED_SECRET.match(m[0]):
            yield *m.span(), 0.9
        elif re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= LEAST_ENTROPY:
            yield *m.span(), 0.3


#: Pattern with validator of each kind: spans with their first score.
PROPOSE = {"intl_phone": _phone_runs, "iban": _ibans, "national_id": _national, "local_phone": _local_phones, "secret": _secrets}


def _near(text: str, a: int, b: int) -> set[str]:
    """Whole words within CONTEXT_CHARS of a span."""
    low, high = max(0, a - CONTEXT_CHARS), min(len(text), b + CONTEXT_CHARS)
    while 0 < low < a and text[low - 1].isalnum():
        low += 1
    while b < high < len(text) and text[high].isalnum():
        high -= 1
    return {w.lower() for w in WORD.findall(text[low:a] + " " + text[b:high])}


def _disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Sorted starts and ends of the stretches that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def extra_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the method adds where no base span lies, by kind, then start."""
    if not DIGIT.search(text):
        return []
    out, taken = [], _disjoint([(a, b) for _, a, b in base])
    for kind in EXTRA:
        fresh = []
        for a, b, score in PROPOSE[kind](text, taken):
            k = bisect_right(taken[1], a)
            if k < len(taken[0]) and taken[0][k] < b:
                continue
            near = _near(text, a, b)
            if score + CONTEXT_GAIN * bool(near & CONTEXT[kind]) - CONTEXT_LOSS * bool(near & AGAINST[kind]) >= THRESHOLD - 1e-9:
                fresh.append((a, b))
        if fresh:
            out += [(kind, a, b) for a, b in fresh]
            taken = _disjoint([*zip(*taken), *fresh])
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in angle brackets; spans that overlap become one, named after the first."""
    merged: list[list] = []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one row for each row of docs."""
    slim = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, totals = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every = base + extra_spans(text, base)
                spans.append(joined(every))
                totals.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(totals, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in text_col; a null text stays null, all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            out = []
            for value in batch.column(k):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    text = mask(text, base + extra_spans(text, base))
                out.append(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return bounded(docs).mapInArrow(run, docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
