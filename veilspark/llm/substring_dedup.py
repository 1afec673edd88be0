"""Removal of repeated substrings by a hash-compared suffix sort (operator 4).

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus. A suffix sort of all bytes
needs a shuffle of all suffixes; here only suffixes that can have a partner are sorted:

1. Anchors. Every window of LENGTH bytes is owned by its gram with the least hash, so equal windows have equal owners at the same
   place. An owner's windows are neighbours; together they are a snippet. About one snippet per 80 bytes.
2. Settled snippets. Where a snippet as a whole occurs twice, all its windows are repeated. Snippets are the same if 128 bits
   of BLAKE2b of their bytes are, a digest for which no two different inputs are known. Plain rows are shuffled and sorted by gram and
   digest, and a row looks at its neighbours. A task sends one row for each snippet of AT_ONCE; the other copies, known
   to be repeated, go to other places, so a snippet with any number of copies is no hot key.
3. Open snippets share their gram with others that differ elsewhere. Their suffixes are sorted, per gram and place of the gram:
   a bottom-up mergesort whose comparisons find the common extension of two suffixes by binary search over prefix
   polynomial hashes. Neighbours with an extension of LENGTH bytes are verified byte by byte; if a hash has lied, the class is
   grouped by its bytes instead.
4. The windows of a gram with more than HOT different snippets, too much for one task, meet by their own digest of 128 bits
   in a shuffle that splits by window. This changes the route and not the result.
5. The spans found meet their texts again, and what is left is hashed. A text is named by its file and its place there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import row_keyed, ship, stage, table

LENGTH = 200
GRAM = 40
#: Base of the polynomial hashes modulo 2^64 (odd), its inverse, and an odd multiplier that scrambles bits (fixed values).
BASE = 0x9E3779B97F4A7C15
SCRAMBLE = 0xD6E8FEB86659FD93
PIECE = 1 << 19
HOT = 4096
#: Bytes of open snippets that a task compares at a time, unless one gram has more; snippets that a task merges at a time.
CHUNK = 1 << 20
AT_ONCE = 1 << 16

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 12)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(text: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of the first i bytes: the sum of (byte + 1) BASE^j modulo 2^64."""
    up, _ = powers(len(text))
    out = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, in linear time (blocks with running minima from both sides)."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(text: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """The owners of a text's windows of LENGTH bytes: (anchor, first window start, last window start, hash of the anchor's gram).

    A window's owner is its gram of GRAM bytes with the least scrambled hash (the first of equal ones), so equal windows
    have their owners at the same place, with the same hash. The windows of an owner are neighbours.
    """
    n, w = len(text) - LENGTH + 1, LENGTH - GRAM + 1
    at = np.arange(n + w - 1)
    h = span_hash(prefix, at, at + GRAM) * np.uint64(SCRAMBLE)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 20) - 1)  # places of a piece fit into 20 bits
    mixed = h * np.uint64(BASE) & ~low | at.astype(np.uint64)
    owner = (sliding_least(mixed, w) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    a = owner[first]
    return a, first, last, span_hash(prefix, a, a + GRAM)


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """A text as pieces of at most PIECE windows, with their places; overlapping, so that each window is whole in one."""
    data = np.frombuffer(text, dtype=np.uint8)
    for k in range(0, len(data) - LENGTH + 1, PIECE):
        yield k, data[k : k + PIECE + LENGTH - 1]


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """BLAKE2b of each part, 128 bits as two longs."""
    return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in parts), dtype="<i8").reshape(-1, 2)


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, text) -> a row for each snippet: gram, the digest d1 and d2, file and at of its text, start, n, place, kind.

    kind is 0 for a snippet that occurs once in AT_ONCE, 1 for the first of several, and 2 for the others, whose
    gram is a number of its own, as nothing has to meet them.
    """

    def merged(found: list[tuple]) -> pa.RecordBatch:
        gram, d, file, row, first, n, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((d[:, 1], d[:, 0], gram))
        same = (gram[order][1:] == gram[order][:-1]) & (d[order][1:] == d[order][:-1]).all(axis=1)
        kind = np.zeros(len(order), dtype=np.int8)
        kind[order[:-1][same]] = 1
        kind[order[1:][same]] = 2
        own = (np.arange(len(gram), dtype=np.uint64) + (row.astype(np.uint64) << np.uint64(20)) + first.astype(np.uint64)) * np.uint64(SCRAMBLE)
        gram = np.where(kind == 2, own, gram)
        columns = [gram.view(np.int64), d[:, 0], d[:, 1], file, row, first, n.astype(np.int32), place.astype(np.int32), kind]
        return pa.record_batch([pa.array(c) for c in columns], names=["gram", "d1", "d2", "file", "at", "start", "n", "place", "kind"])

    found: list[tuple] = []
    held = 0
    for batch in batches:
        for file, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            data = text.as_py()
            for k, piece in pieces(data):
                a, first, last, gram = anchors(piece, prefix_hashes(piece))
                d = digests(data[i:j] for i, j in zip((first + k).tolist(), (last + k + LENGTH).tolist(), strict=True))
                found.append((gram, d, np.full(len(a), file), np.full(len(a), row), first + k, last - first + 1, a - first))
                held += len(a)
                if held >= AT_ONCE:
                    yield merged(found)
                    found, held = [], 0
    if found:
        yield merged(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted snippets of the text) -> the snippets' bytes, or the digests of their windows for hot grams."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.binary()))
    names = ["gram", "file", "at", "start", "n", "place", "open", "bytes", "digests"]
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for text, wanted in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            data = text.as_py()
            for w in wanted:
                part, each = data[w["start"] : w["start"] + w["n"] + LENGTH - 1], None
                held += len(part)
                if w["hot"]:
                    each, part = [blake2b(part[i : i + LENGTH], digest_size=16).digest() for i in range(w["n"])], None
                out.append((w["gram"], w["file"], w["at"], w["start"], w["n"], w["place"], w["open"], part, each))
            if held >= CHUNK:
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                out, held = [], 0
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def extension(prefix: np.ndarray, p: np.ndarray, q: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """How many bytes (up to most) the suffixes at p and q have in common: binary search over the prefix hashes."""
    up, _ = powers(len(prefix))
    same = lambda p, q, n: (prefix[p + n] - prefix[p]) * up[q] == (prefix[q + n] - prefix[q]) * up[p]
    out = np.full(len(p), most, dtype=np.int64)
    rest = np.flatnonzero(~same(p, q, most))
    p, q = p[rest], q[rest]
    low, high = np.zeros(len(rest), dtype=np.int64), np.full(len(rest), most - 1, dtype=np.int64)
    while len(rest) and (low < high).any():
        mid = (low + high + 1) // 2
        hit = same(p, q, mid)
        low, high = np.where(hit, mid, low), np.where(hit, high, mid - 1)
    out[rest] = low
    return out


def compare(text: np.ndarray, prefix: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the LENGTH bytes at p are less than, equal to or greater than those at q."""
    n = extension(prefix, p, q)
    differ = n < LENGTH
    at = np.where(differ, n, 0)
    return np.where(differ, np.sign(text[p + at].astype(np.int64) - text[q + at]), 0)


def sort_suffixes(text: np.ndarray, prefix: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sort the suffixes ``at`` within their classes; begin and size give each element's class as a range of ``at``.

    A bottom-up mergesort, all merges of a level at once: an element's new place is its place in its own run plus
    its rank in the other run, which a binary search finds.
    """
    at, index = at.copy(), np.arange(len(at))
    width = 1
    while width < size.max(initial=0):
        r = index - begin
        block = r // (2 * width) * (2 * width)
        left = r - block < width
        other = begin + np.where(left, np.minimum(block + width, size), block)
        end = np.where(left, begin + np.minimum(block + 2 * width, size), begin + block + width)
        active = np.flatnonzero(end > other)
        low, high, x, after = other[active], end[active], at[active], left[active]
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            c = compare(text, prefix, at[mid], x[todo])
            before = (c < 0) | (c == 0) & ~after[todo]  # equal ones of the left run stand first
            low[todo], high[todo] = np.where(before, mid + 1, low[todo]), np.where(before, high[todo], mid)
        place = index.copy()
        own = np.where(left, r - block, r - block - width)[active]
        place[active] = begin[active] + block[active] + own + low - other[active]
        moved = np.empty_like(at)
        moved[place] = at
        at, width = moved, 2 * width
    return at


def repeated(snippets: list[bytes], gram: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For the windows of all snippets, one after the other: does another snippet of the gram have the same window?"""
    text = np.frombuffer(b"".join(snippets), dtype=np.uint8)
    prefix = prefix_hashes(text)
    base = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = base[owner] + j
    # A class: the gram, and where in the window it stands.
    cls = np.unique(gram, return_inverse=True)[1][owner] * 256 + (place[owner] - j)
    key = span_hash(prefix, at, at + LENGTH) * np.uint64(SCRAMBLE) ^ cls.astype(np.uint64) * np.uint64(BASE)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    some = np.zeros(len(at), dtype=bool)  # a window whose hash is alone in its class has no equal
    some[order[1:][same]] = some[order[:-1][same]] = True
    chosen = np.flatnonzero(some)
    chosen = chosen[np.argsort(cls[chosen], kind="stable")]
    out = np.zeros(len(at), dtype=bool)
    if not len(chosen):
        return out
    c = cls[chosen]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    sizes = np.diff(np.append(starts, len(c)))
    window_at = np.full(len(text), -1, dtype=np.int64)
    window_at[at] = np.arange(len(at))
    ranked = sort_suffixes(text, prefix, at[chosen], np.repeat(starts, sizes), np.repeat(sizes, sizes))
    p, q = ranked[:-1], ranked[1:]
    near = np.flatnonzero((c[1:] == c[:-1]) & (extension(prefix, p, q) == LENGTH))
    lied = set()
    for k in range(0, len(near), 1 << 15):  # verification
        part = near[k : k + (1 << 15)]
        equal = np.ones(len(part), dtype=bool)
        for i in range(0, LENGTH, 8):
            span = np.arange(i, min(i + 8, LENGTH))
            equal &= (text[p[part][:, None] + span] == text[q[part][:, None] + span]).all(axis=1)
        out[window_at[p[part][equal]]] = out[window_at[q[part][equal]]] = True
        lied.update(c[part[~equal]].tolist())
    for x in lied:
        groups: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(cls == x):
            groups.setdefault(text[at[k] : at[k] + LENGTH].tobytes(), []).append(int(k))
        for members in groups.values():
            out[members] = len(members) > 1
    return out


def runs(mask: np.ndarray, owner: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked neighbours within an owner: (owner, first, last)."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) != 0))
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return owner[first], j[first], j[last]


def _sorted_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets in order of their grams -> spans (file, at, start, end) of the open ones' repeated windows."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        gram, file, row, start, n, place, is_open = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(7))
        mask = repeated([r[7] for r in rows], gram, n, place)
        owner = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        o, first, last = runs(mask & (is_open[owner] == 1), owner, j)
        return pa.record_batch([pa.array(file[o]), pa.array(row[o]), pa.array(start[o] + first), pa.array(start[o] + last + LENGTH)], names=["file", "at", "start", "end"])

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if held >= CHUNK and r[0] != rows[-1][0]:
                yield done(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[7])
    if rows:
        yield done(rows)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts, ends) -> doc_id, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            data = text.as_py()
            left, cut, at, n = [], 0, 0, 0
            for s in sorted(spans or (), key=lambda s: s["start"]):
                if s["start"] > at or not n:
                    left.append(data[at : s["start"]])
                    n += 1
                cut += max(0, s["end"] - max(at, s["start"]))
                at = max(at, s["end"])
            left.append(data[at:])
            out.append((doc_id, len(data), cut, n, b"".join(left)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """rows (file, at, text) -> (file, at, start, end): byte spans that cover all repeated windows; spans may overlap."""
    found = rows.select("file", "at", "text").mapInArrow(_snippets, "gram long, d1 long, d2 long, file long, at long, start long, n int, place int, kind byte")
    of_gram = Window.partitionBy("gram").orderBy("d1", "d2", "kind")
    every = of_gram.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    digest, kind = F.struct("d1", "d2"), F.col("kind")
    met = found.select("gram", "file", "at", "start", "n", "place", "kind", digest.alias("d"), F.lag(digest).over(of_gram).alias("before"), F.lead(digest).over(of_gram).alias("after"), F.first(digest).over(every).alias("least"), F.last(digest).over(every).alias("most"))
    twice = (kind > 0) | F.coalesce(F.col("d") == F.col("before"), F.lit(False)) | F.coalesce(F.col("d") == F.col("after"), F.lit(False))
    # One row of each snippet whose gram has others stands for it.
    stands = (kind < 2) & ~F.coalesce(F.col("d") == F.col("before"), F.lit(False)) & (F.col("least") != F.col("most"))
    met = met.select("gram", "file", "at", "start", "n", "place", twice.alias("twice"), stands.alias("stands")).filter("twice OR stands")
    met = stage(met, "snippets")
    settled = met.filter("twice").select("file", "at", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("end"))

    wanted = met.filter("stands")
    many = wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("different")).filter(F.col("different") > hot).select("gram", F.lit(True).alias("hot"))
    wanted = wanted.join(many, "gram", "left")
    wanted = wanted.select("file", "at", F.struct("gram", "file", "at", "start", "n", "place", (~F.col("twice")).alias("open"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    of_row = wanted.groupBy("file", "at").agg(F.collect_list("w").alias("wanted"))  # at most the snippets of a text
    cut = rows.join(of_row, ["file", "at"]).select("text", "wanted").mapInArrow(_cut, "gram long, file long, at long, start long, n int, place int, open boolean, bytes binary, digests array<binary>")
    cut = stage(cut, "cut")

    some = cut.filter("bytes IS NOT NULL").select("gram", "file", "at", "start", "n", "place", "open", "bytes")
    compared = some.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_snippets, "file long, at long, start long, end long")

    windows = cut.filter("bytes IS NULL").select("file", "at", "start", "open", F.posexplode("digests").alias("j", "digest"))
    equal = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    counted = windows.filter("open").join(equal, "digest", "left_semi").select("file", "at", (F.col("start") + F.col("j")).alias("start"), (F.col("start") + F.col("j") + LENGTH).alias("end"))
    return settled.unionByName(compared).unionByName(counted)


def substring_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Remove from each text (doc_id, text) the bytes that a repeated string of LENGTH bytes covers.

    Returns one row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left). Strings
    are judged on the input. Null texts are empty; texts under LENGTH bytes lose nothing; very long texts are read whole, piece
    by piece; repeated rows are repeats of each other, so they lose all they have if long enough. No rows give no rows; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = row_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), "row")
    rows = rows.select("doc_id", "text", "row.file", "row.at")
    spans = repeated_spans(rows.select("file", "at", "text"), hot)
    # At most one span for each of a text's own windows.
    spans = stage(spans.groupBy("file", "at").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    return rows.join(spans, ["file", "at"], "left").select("doc_id", "text", "spans").mapInArrow(_marked, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
