"""Repeated byte strings by common-prefix intervals of enhanced suffix arrays, one for each group of anchors.

A window is WINDOW consecutive bytes of one document. Its anchor is its first gram of GRAM bytes of the least hash, so equal
windows have equal anchors at equal distance, and a suffix array needs to hold only the suffixes that share one:

1. Every document is parted into contexts, the runs of windows whose anchor is one place (never equal among themselves). A
   first pass counts contexts by (anchor, content); anchors that occur once are out. No repeat is lost.
2. A second pass keeps each context of the other anchors: (anchor, content hash) and the places where it occurs, with its
   text once a task. Equal contexts are one leaf with a weight, so thousands of copies cost one.
3. Contexts are dealt by anchor. A task sorts the suffixes of its groups (first by the Rabin-Karp name of their first WINDOW
   bytes, then by bytes), takes the common prefix of neighbours, and scans both with a stack: each interval whose suffixes have
   different bytes to their left, or hold the first suffix of a context, is a repeat group with all its occurrences. An
   interval that can be extended to the left lies inside the one found a byte before, so the groups cover every repeat.
4. Matches join the places of their contexts and merge per document into maximal spans, which cut the text.

An anchor with more than HEAVY different contexts (the edge of a passage in countless surroundings) is never gathered: each of
its windows is its own key there, an interval of equal leaves with no depth, which needs no text and is dealt evenly.

Passes over the texts: contexts twice, cutting once. Shuffled: counts of contexts (about one in 77 bytes), contexts of shared
anchors, their places, and texts that are cut. The sets of shared and heavy anchors travel as bitmaps sized by their number;
where they are too many, they are joined with the contexts' places and the texts take those along. No task holds more than a
document, a slice of CHUNK bytes, or groups of a bounded size.

Edge cases: null and short texts have no window; rows of one id are different documents here, so repeated rows lose all their
windows; a null id is a document like others; very long texts are hashed in slices that overlap by a window; in runs of one byte
every window is a context, all of equal content; an empty table gives an empty result. Only id and text columns are read, so other columns never
clash. Hashes have 64 bits: two different contexts are taken for equal with a chance of 1 in 1.8e19 a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from . import textkernel as K
from .scratch import bounded, discard, materialize

WINDOW = 200
GRAM = 48
#: Bytes of a slice; with a window more they must stay within PLACES.
CHUNK = 1 << 20
PLACES = (1 << 21) - 1
HEAVY = 2000
#: Bytes of contexts that a task sorts at a time (whole groups).
SORTED_BYTES = 1 << 20
#: Contexts that a task remembers having sent with their text.
SEEN = 500_000
_U = np.uint64
_VALUE = K.mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))
_POWER, _INVERSE = K._Powers(0x9FB21C651E98DF25), K._Powers(pow(0x9FB21C651E98DF25, -1, 2**64))


class Hashes:
    """Rabin-Karp hashes of a slice of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * _POWER.upto(n), out=self.total[1:])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.total) - 1
        return K.mix((self.total[size:] - self.total[:-size]) * _INVERSE.upto(n - size + 1)) if n >= size else np.zeros(0, np.uint64)

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hashes of the ranges a to z, which tell their lengths too."""
        return K.mix((self.total[z] - self.total[a]) * _INVERSE.upto(len(self.total))[a] + K.mix((z - a).astype(np.uint64)))


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= span:
        values, reach = np.minimum(values[:-reach], values[reach:]), reach * 2
    return np.minimum(values[: len(values) - (span - reach)], values[span - reach :]) if span > reach else values


class Contexts:
    """Contexts of a slice: document (index in the batch), first byte in it, number of windows, anchor, content hash, and where
    the bytes are in the slice."""

    def __init__(self, data: np.ndarray, hashes: Hashes, at: int, begins: np.ndarray, ends: np.ndarray, window: int, gram: int):
        """data holds the bytes from `at` on of documents that begin and end at these places."""
        self.data, self.hashes = data, hashes
        grams = hashes.windows(gram)
        # The first least gram of each window: high bits of its hash, then its place.
        places = sliding_min(grams & ~_U(PLACES) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & _U(PLACES)
        n = len(places)
        a, z = np.maximum(begins - at, 0), np.minimum(ends - at - window + 1, n)
        fits = z > a
        doc = np.flatnonzero(fits)
        a, z = a[fits], z[fits]
        starts = np.arange(int((z - a).sum())) + np.repeat(a - (np.cumsum(z - a) - (z - a)), z - a)
        of = np.repeat(doc, z - a)
        own = places[starts].astype(np.int64)
        change = np.ones(len(starts), bool)
        change[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(change)
        self.n = np.diff(first, append=len(starts))
        self.begin, self.doc, self.anchor = starts[first], of[first], grams[own[first]]
        self.start = self.begin + at - begins[self.doc]
        self.content = hashes.of(self.begin, self.begin + self.n + window - 1)

    def only(self, keep: np.ndarray) -> None:
        for name in ("n", "begin", "doc", "anchor", "start", "content"):
            setattr(self, name, getattr(self, name)[keep])


def contexts_of(column: pa.Array, window: int, gram: int, chunk: int = CHUNK) -> Iterator[Contexts]:
    """The contexts of a column of texts, slice by slice, each window in one slice."""
    data, offsets = K.buffers(column)
    for at in range(0, max(len(data) - window + 1, 0), chunk):
        part = data[at : at + chunk + window - 1]
        first, last = np.searchsorted(offsets, [at, at + len(part)], "right")
        docs = np.arange(max(int(first) - 1, 0), min(int(last), len(offsets) - 1))
        begins, ends = offsets[docs], offsets[docs + 1]
        own = Contexts(part, Hashes(part), at, begins, ends, window, gram)
        own.doc = docs[own.doc]
        yield own


def _counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, content, weight): contexts counted per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in contexts_of(batch.column("text"), window, gram):
                _, at, many = np.unique(own.content, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(own.anchor[at])), pa.array(K.signed(own.content[at])), pa.array(many)], names=["anchor", "content", "weight"])

    return docs.mapInArrow(run, "anchor bigint, content bigint, weight bigint")


def shared_anchors(docs: DataFrame, window: int, gram: int, heavy: int = HEAVY) -> DataFrame:
    """(anchor, heavy): anchors that occur twice or more, and whether in more different contexts than a task should gather."""
    per = _counts(docs, window, gram).groupBy("anchor", "content").agg(F.sum("weight").alias("weight"))
    return per.groupBy("anchor").agg(F.sum("weight").alias("weight"), F.count("*").alias("contexts")).where("weight > 1").select("anchor", (F.col("contexts") > heavy).alias("heavy"))


PLACE = "array<struct<doc_id:bigint,text_hash:bigint,start:bigint>>"
CONTEXT = f"anchor bigint, content bigint, weight bigint, text binary, places {PLACE}"


def _places(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> pa.Array:
    struct = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64())], names=["doc_id", "text_hash", "start"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), struct)


def _taken(docs: DataFrame, kinds: DataFrame, window: int, gram: int) -> tuple[DataFrame, list]:
    """docs, and what tells shared and heavy anchors: bitmaps, or (none) the docs with their contexts' places."""
    tables = [bitmap.collect(kinds.where(c).select("anchor"), "anchor") for c in ("not heavy", "heavy")]
    if all(t is not None for t in tables):
        return docs, tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for own in contexts_of(batch.column("text"), window, gram):
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(own.anchor)), pa.array(ids[own.doc]), pa.array(keys[own.doc]), pa.array(own.start)], names=["anchor", "doc_id", "text_hash", "start"])

    found = docs.mapInArrow(run, "anchor bigint, doc_id bigint, text_hash bigint, start bigint").join(kinds, "anchor").distinct()
    return docs.join(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "heavy")).alias("kinds")), ["doc_id", "text_hash"]), [None, None]


def shared_contexts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """The written contexts (anchor, content, weight, text, places) of anchors that occur twice or more. weight says how much
    of the context's count the row carries to the suffix array (two are as good as more); windows of heavy anchors are
    contexts without text whose anchor is their content."""
    kinds = materialize(shared_anchors(docs, window, gram, heavy), "anchors")
    docs, tables = _taken(docs, kinds, window, gram)
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def kind(own: Contexts, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        light, hot = sent.value
        if light is not None:
            h = bitmap.contains(hot, own.anchor)
            return bitmap.contains(light, own.anchor) & ~h, h
        out = np.zeros(len(own.doc), np.int8)
        known = batch.column("kinds")
        for d in np.unique(own.doc).tolist():
            mine = np.flatnonzero(own.doc == d)
            told = {p["start"]: p["heavy"] for p in known[d].as_py()}
            out[mine] = [1 + told[x] if x in told else 0 for x in own.start[mine].tolist()]
        return out == 1, out == 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}  # content: whether the suffix array knows that it is repeated

        def rows(anchor: np.ndarray, content: np.ndarray, texts, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(content, kind="stable")
            content, anchor, doc, start = content[order], anchor[order], doc[order], start[order]
            first = np.flatnonzero(np.r_[True, content[1:] != content[:-1]])
            many = np.diff(first, append=len(content))
            weight, body = np.zeros(len(first), np.int64), []
            for j, (c, n, i) in enumerate(zip(content[first].tolist(), many.tolist(), order[first].tolist(), strict=True)):
                before = seen.get(c)
                body.append(texts(i) if before is None else None)
                weight[j] = n if before is None else int(not before)
                if not before:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[c] = before is not None or n > 1
            return pa.RecordBatch.from_arrays([pa.array(K.signed(anchor[first])), pa.array(K.signed(content[first])), pa.array(weight), pa.array(body, pa.binary()), _places(ids[doc], keys[doc], start, np.r_[first, len(content)])], names=["anchor", "content", "weight", "text", "places"])

        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for own in contexts_of(batch.column("text"), window, gram):
                light, hot = kind(own, batch)
                if hot.any():
                    n = own.n[hot]
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    begin = np.repeat(own.begin[hot], n) + step
                    names = own.hashes.of(begin, begin + window)
                    yield rows(names, names, lambda _: None, np.repeat(own.doc[hot], n), np.repeat(own.start[hot], n) + step, ids, keys)
                own.only(light)
                if len(own.doc):
                    yield rows(own.anchor, own.content, lambda i, own=own: own.data[own.begin[i] : own.begin[i] + own.n[i] + window - 1].tobytes(), own.doc, own.start, ids, keys)

    out = materialize(docs.mapInArrow(run, CONTEXT), "contexts")
    discard(kinds)
    return out


# The enhanced suffix array of contexts, and its intervals.


def _order(data: np.ndarray, starts: np.ndarray, rest: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of suffixes by class, then bytes, common prefix of each with the one before) of suffixes data[start : start +
    rest]; across classes the prefix is -1."""
    words = -(-int(rest.max(initial=0)) // 8)
    padded = np.r_[data, np.zeros(8 * words + 8, np.uint8)]
    table = np.zeros((words + 1, len(starts)), np.uint64)
    for k in range(words):
        left = np.clip(rest - 8 * k, 0, 8)
        value = np.zeros(len(starts), np.uint64)
        for b in range(8):
            value = (value << _U(8)) | np.where(b < left, padded[starts + 8 * k + b], 0).astype(np.uint64)
        table[k] = value
    order = np.lexsort((rest, *table[:words][::-1], classes))
    both = table[:, order]
    differ = both[:, 1:] != both[:, :-1]
    differ[-1] = True
    word = np.argmax(differ, axis=0)
    gap = both[word, np.arange(1, len(starts))] ^ both[word, np.arange(len(starts) - 1)]
    same = sum((gap < _U(1 << 8 * b)).astype(np.int64) for b in range(8))  # leading bytes of the word that are equal
    own = rest[order]
    lcp = np.minimum(8 * word + same, np.minimum(own[1:], own[:-1]))
    lcp[classes[order][1:] != classes[order][:-1]] = -1
    return order, np.r_[-1, lcp]


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(prefix, first, last) of each interval of an enhanced suffix array, inner ones first; -1 parts classes."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > now:
            prefix, left = stack.pop()
            yield prefix, left, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def repeats(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, window: int, every: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(group, length, context, offset): occurrences of the repeat groups among contexts data[offsets[i]:offsets[i + 1]], where
    context i stands for weights[i] places. Each suffix comes with its longest group, or with every group that holds it."""
    lengths = np.diff(offsets)
    many = lengths - window + 1
    context = np.repeat(np.arange(len(many)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    starts = offsets[context] + within
    if not len(starts):
        return
    name = Hashes(data).windows(window)[starts]
    by = np.argsort(name, kind="stable")
    head = np.flatnonzero(np.r_[True, name[by][1:] != name[by][:-1]])
    size = np.diff(head, append=len(by))
    edge = within[by] == 0
    left = np.where(edge, 0, data[np.maximum(starts[by] - 1, 0)].astype(np.int64))
    weight = np.add.reduceat(weights[context[by]], head)
    diverse = np.logical_or.reduceat(edge, head) | (np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head))
    wanted = diverse & (weight > 1)
    group = 0
    for i in head[wanted & (size == 1)].tolist():  # one context in several places
        s = by[i]
        yield group, int(lengths[context[s]] - within[s]), int(context[s]), int(within[s])
        group += 1
    wanted &= size > 1
    keep = np.repeat(wanted, size)
    chosen, classes, edge, left = by[keep], np.repeat(np.arange(len(head)), size)[keep], edge[keep], left[keep]
    cuts = np.r_[0, np.cumsum(size[wanted])]
    a = 0
    while a < len(cuts) - 1:  # whole classes, some 16,384 suffixes at a time
        z = max(a + 1, int(np.searchsorted(cuts, cuts[a] + 16_384, "right")) - 1)
        part = slice(int(cuts[a]), int(cuts[z]))
        own = chosen[part]
        order, lcp = _order(data, starts[own] + window, lengths[context[own]] - within[own] - window, classes[part])
        sa, e, l = own[order], edge[part][order], left[part][order]
        n = len(sa)
        # An interval is diverse if a suffix in it is an edge, or two neighbours differ in the byte to their left.
        turn = np.r_[0, np.cumsum((l[1:] != l[:-1]) | e[1:] | e[:-1])]
        edges = np.r_[0, np.cumsum(e)]
        longest, of = np.full(n, -1), np.full(n, -1)
        found = list(lcp_intervals(lcp.tolist()))
        rest = lengths[context[sa]] - within[sa] - window
        # Leaves in several places, unless an interval has the same bytes.
        alone = (weights[context[sa]] > 1) & (rest > np.maximum(lcp, np.r_[lcp[1:], -1]))
        found += [(int(rest[i]), i, i) for i in np.flatnonzero(alone).tolist()]
        for prefix, i, j in found:
            if turn[j] == turn[i] and edges[j + 1] == edges[i]:
                continue
            if every:
                for s in sa[i : j + 1].tolist():
                    yield group, window + prefix, int(context[s]), int(within[s])
            else:
                better = longest[i : j + 1] < prefix
                longest[i : j + 1][better], of[i : j + 1][better] = prefix, group
            group += 1
        if not every:
            for k in np.flatnonzero(of >= 0).tolist():
                yield int(of[k]), window + int(longest[k]), int(context[sa[k]]), int(within[sa[k]])
        a = z


MATCH = "group bigint, content bigint, offset int, length int"


def matches(contexts: DataFrame, window: int = WINDOW, every: bool = False) -> DataFrame:
    """(group, content, offset, length): the repeat groups among written contexts. A group's occurrences are the places of its
    contexts, each `offset` bytes on; by default a suffix names the longest group that it is in."""
    slim = contexts.where("weight > 0").select("anchor", "content", "weight", "text").repartition("anchor").sortWithinPartitions("anchor", "content", F.desc_nulls_last("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        keys: list[int] = []
        weights: list[int] = []
        anchor, held, bare = None, 0, []

        def flush() -> pa.RecordBatch:
            out = [(c, c, 0, window) for c in bare]
            if texts:
                offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
                number = {}
                for g, n, c, o in repeats(np.frombuffer(b"".join(texts), np.uint8), offsets, np.array(weights), window, every):
                    if g not in number:  # by its first occurrence, so retries agree
                        number[g] = int(K.signed(K.mix(np.array([(keys[c] * 3 + o * 1_000_003 + n) % 2**64], np.uint64)))[0])
                    out.append((number[g], keys[c], o, n))
            texts.clear(), keys.clear(), weights.clear(), bare.clear()
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["group", "content", "offset", "length"])

        window_key, window_weight = None, 0
        for batch in batches:
            for a, c, w, t in zip(*(batch.column(k) for k in range(4)), strict=True):
                a, c, w, t = a.as_py(), c.as_py(), w.as_py(), t.as_py()
                if a != anchor:
                    if held >= SORTED_BYTES:
                        yield flush()
                        held = 0
                    anchor = a
                if t is None and not (keys and keys[-1] == c):  # a window of a heavy anchor
                    if c != window_key:
                        window_key, window_weight = c, 0
                    if window_weight < 2 <= window_weight + w:
                        bare.append(c)
                        held += 16
                    window_weight += w
                elif keys and keys[-1] == c:
                    weights[-1] += w
                else:
                    texts.append(t)
                    keys.append(c)
                    weights.append(w)
                    held += len(t)
        yield flush()

    return slim.mapInArrow(run, MATCH)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and its hash. A null id is dealt by the hash; what is removed depends on the text alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return bounded(docs).select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text")).withColumn("doc_id", F.coalesce("id", "text_hash"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(group, length, doc_id, text_hash, start): every occurrence of every maximal repeat group, in bytes. doc_id is the text's
    hash where it is null."""
    contexts = shared_contexts(_keyed(docs, id_col, text_col).select("doc_id", "text_hash", "text"), window, gram)
    places = contexts.select("content", F.explode("places").alias("p"))
    return matches(contexts, window, every=True).join(places, "content").select("group", "length", "p.doc_id", "p.text_hash", (F.col("p.start") + F.col("offset")).alias("start"))


def merged(a: np.ndarray, z: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    first = np.flatnonzero(np.r_[True, a[1:] > z[:-1]])
    return list(zip(a[first].tolist(), z[np.r_[first[1:] - 1, len(z) - 1]].tolist(), strict=True))


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, found) of docs (doc_id, text_hash, text): ranges of bytes that repeat, as (from, to)."""
    contexts = shared_contexts(docs, window, gram)
    # What a context has covered, relative to its first byte, in few ranges.
    own = matches(contexts, window).select("content", F.col("offset").alias("a"), (F.col("offset") + F.col("length")).alias("z")).groupBy("content").agg(F.array_sort(F.collect_set(F.struct("a", "z"))).alias("r"))
    joined = F.aggregate("r", F.expr("slice(r, 1, 0)"), lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["z"] >= x["a"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), F.greatest(F.element_at(out, -1)["z"], x["z"]).alias("z"))))).otherwise(F.concat(out, F.array(x))))
    own = own.select("content", joined.alias("r"))
    places = contexts.select("content", "places").join(own, "content").select(F.explode("places").alias("p"), "r").select("p.*", F.explode("r").alias("x"))
    found = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct((F.col("start") + F.col("x.a")).alias("a"), (F.col("start") + F.col("x.z")).alias("z"))).alias("found"))
    out = materialize(found, "spans")
    discard(contexts)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row for each row of docs; kept is the bytes that are left."""
    slim = _keyed(docs, id_col, text_col)
    found = spans(slim.select("doc_id", "text_hash", "text"), window, gram)
    maybe, others = bitmap.split(slim, "doc_id", bitmap.collect(found, "doc_id"))
    both = maybe.join(found, ["doc_id", "text_hash"], "left").select("id", "text", "found").unionByName(others.select("id", "text", F.lit(None).cast("array<struct<a:bigint,z:bigint>>").alias("found")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sizes, gone, many, kept = [], [], [], []
                for text, own in zip(part.column("text"), part.column("found"), strict=True):
                    raw = text.as_py().encode()
                    cut = merged(own.values.field("a").to_numpy(), own.values.field("z").to_numpy()) if own.is_valid else []
                    pieces, last = [], 0
                    for a, z in cut:
                        pieces.append(raw[last:a])
                        last = z
                    pieces.append(raw[last:])
                    kept.append(b"".join(pieces))
                    sizes.append(len(raw))
                    gone.append(len(raw) - len(kept[-1]))
                    many.append(len(cut))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
