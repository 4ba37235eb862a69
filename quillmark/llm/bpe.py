"""Byte-level BPE: ranked merges folded over the byte pieces of words; decoding concatenates binary pieces.

fold_words() is the fold in Spark's higher-order functions: a word is an array of one-byte pieces with the ranks of its
neighbouring pairs, and each step of aggregate() joins the pair of lowest rank and looks up its two new neighbours in a
literal rank map. Spark's map lookup is a linear scan, so the literal is an array of small maps, dealt by crc32. Words
reach it one per row, distinct.

Encoding whole texts runs the same fold on each worker, in Arrow batches: texts are cut by the tokenizer's pattern, each
distinct word is folded once per worker and kept in a bounded table, and a text is the concatenation of its words' ids.
Handing ids of a shared vocabulary table back to texts would need one shuffled row for every word of the corpus, which
is several times the input; the README has the figures. Decoding is a higher-order function over the ids: pieces are taken
from one literal array and put together. The tokenizer file (some MB whatever the corpus) is read by the driver and
broadcast. Nothing is shuffled; a lost executor costs its own tasks.

Edge cases: a null or empty text has no ids and decodes to nothing, with the digests of the empty string. Very long texts
are encoded whole, and words of any length are folded exactly (with a heap when long). Ties: of equal pairs the leftmost
is joined first. Repeated rows are encoded each for itself; an empty table gives an empty result. encoded() replaces
columns of the input that clash with those it adds and keeps all others."""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import bounded

#: Words kept per worker, in two generations: a full table becomes the old one. A word that is gone is folded again.
CACHE_WORDS = 150_000
LONG = 48


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank of every piece, from the content of a tokenizer file of base64 pieces and ranks."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: while two neighbours make a known piece, the pair of lowest rank (leftmost first) is joined."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [ranks.get(word[i : i + 2], 1 << 60) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == 1 << 60:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap of candidate pairs, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: end of the piece that starts at i
    before, alive = list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def literal_ranks(ranks: dict[bytes, int], groups: int = 2048):
    """The rank map as one literal: an array of small maps from piece to rank, dealt by crc32."""
    dealt: list[list[str]] = [[] for _ in range(groups)]
    for piece, rank in ranks.items():
        dealt[zlib.crc32(piece) % groups].append(f"X'{piece.hex()}', {rank}")
    return F.expr("array(" + ", ".join(f"map({', '.join(x)})" if x else "cast(map() as map<binary,int>)" for x in dealt) + ")")


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", groups: int = 2048) -> DataFrame:
    """words (distinct, short) plus ids, by higher-order functions alone."""
    none = 1 << 30
    table = words.sparkSession.range(1).select(literal_ranks(ranks, groups).alias("_qm_ranks"))
    rank = lambda piece: F.coalesce(F.element_at(F.get(F.col("_qm_ranks"), (F.crc32(piece) % groups).cast("int")), piece), F.lit(none))
    whole = F.col(word_col).cast("binary")
    pieces = F.transform(F.sequence(F.lit(1), F.octet_length(whole)), lambda i: F.substring(whole, i, F.lit(1)))

    pair_ranks = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: rank(F.concat(p, pieces[i + 1])))

    def step(acc, _):
        def joined(at):  # the pair at this place, from 0, with its two new neighbours
            p, r = acc["p"], acc["r"]
            one = F.concat(p[at], p[at + 1])
            left = F.when(at > 0, F.array(rank(F.concat(F.get(p, at - 1), one)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 2 < F.size(p), F.array(rank(F.concat(one, F.get(p, at + 2))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, 1, at), F.array(one), F.slice(p, at + 3, F.size(p))).alias("p"),
                F.concat(F.slice(r, 1, F.greatest(at - 1, F.lit(0))), left, right, F.slice(r, at + 3, F.size(r) + 1)).alias("r"),
            )

        low = F.transform(F.array(F.array_min(acc["r"])), lambda m: F.when(m < none, joined((F.array_position(acc["r"], m) - 1).cast("int"))).otherwise(acc))[0]
        return F.when(F.size(acc["r"]) > 0, low).otherwise(acc)

    start = F.struct(pieces.alias("p"), pair_ranks.alias("r"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(whole), F.lit(1))), start, step)["p"]
    ids = F.when(F.octet_length(whole) == 0, F.array().cast("array<int>")).when(rank(whole) < none, F.array(rank(whole))).otherwise(F.transform(folded, rank))
    return words.join(F.broadcast(table), F.lit(True)).withColumn("ids", ids).drop("_qm_ranks")  # one row, as large as the tokenizer file


def decode(docs: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """docs plus the bytes of their ids: pieces out of one literal array, put together (as hexadecimal digits, which Spark
    joins in one go)."""
    pieces = [""] * (max(ranks.values(), default=0) + 1)
    for piece, r in ranks.items():
        pieces[r] = piece.hex()
    table = docs.sparkSession.range(1).select(F.split(F.lit(" ".join(pieces)), " ").alias("_qm_pieces"))
    both = docs.join(F.broadcast(table), F.lit(True))  # one row, as large as the tokenizer file
    return both.withColumn(to, F.unhex(F.array_join(F.transform(ids_col, lambda i: F.get("_qm_pieces", i)), ""))).drop("_qm_pieces")


class Encoder:
    """A tokenizer in a worker: ranks, pattern and the bounded table of words already folded."""

    loaded: dict[tuple[int, int, str], Encoder] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, r in self.ranks.items():
            self.pieces[r] = piece
        self.known: dict[str, bytes] = {}  # ids of a word as 32-bit numbers
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, data: bytes, pattern: str) -> Encoder:
        """The tokenizer of a file's content, made once a worker."""
        if (key := (len(data), zlib.crc32(data), pattern)) not in cls.loaded:
            cls.loaded[key] = cls(parse_ranks(data), pattern)
        return cls.loaded[key]

    def ids_of(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        known = self.known
        for word in self.cut(text):
            got = known.get(word)
            if got is None:
                got = self.older.get(word) or array("I", fold(word.encode(), self.ranks)).tobytes()
                if len(word) <= LONG:
                    if len(known) >= CACHE_WORDS:
                        self.older, self.known = known, {}
                        known = self.known
                    known[word] = got
            parts.append(got)
        return np.frombuffer(b"".join(parts), np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.ids_of(text).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def with_ids(docs: DataFrame, data: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """docs plus ids (array<int>); text_col stays."""
    keep = bounded(docs).select(*(c for c in docs.columns if c.lower() != "ids"))
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.load(sent.value, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for at in range(0, len(batch), 200):  # ids are larger than the texts
                ids = [own.ids_of(v.as_py() or "") for v in texts[at : at + 200]]
                part = batch.slice(at, 200)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "ids"])

    return keep.mapInArrow(run, StructType([*keep.schema.fields, *StructType.fromDDL("ids array<int>").fields]))


def digest(docs: DataFrame, data: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts are encoded, then the ids are decoded. data is the content of
    the tokenizer file."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = decode(with_ids(slim, data, pattern).drop("text"), parse_ranks(data))
    return own.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encoded(docs: DataFrame, data: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """docs plus ids (array<int>), n_tokens and decoded (binary)."""
    keep = docs.select(*(c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "decoded")))
    return decode(with_ids(keep, data, pattern, text_col).withColumn("n_tokens", F.size("ids").cast("long")), parse_ranks(data))


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), f.read(), tokenizers.PATTERN)
