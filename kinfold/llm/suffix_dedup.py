"""Removal of repeated passages, exact to the byte, by suffix arrays over shards of the corpus.

A byte goes if a ``length``-byte string that covers it also starts earlier (a smaller doc_id, or the same document
further left). Strings are judged on the input and never cross documents.

Every string of ``length`` bytes has one anchor: the leftmost smallest hash of its runs of ``gram`` bytes. Equal strings
have equal anchors, so strings need only meet those of the same anchor, and a suffix whose anchor occurs once in the
corpus needs no place in a suffix array. Neighbouring strings of one anchor occurrence form a context (at most
2 * length - gram bytes).

1. Scan: find all contexts, a row each; equal contexts within a batch keep the first (pre-aggregation, so a hot passage is
   one row for each batch). Rows are dealt by anchor. A sample of documents (``sample_rows``, or one in 16,384 of them where
   that is more) names the anchors with very many contexts; their rows are dealt by context instead. That steers where rows
   go and nothing else: an anchor that it misses has at most some hundred thousand contexts of 40 bytes in one task.
2. Classes: equal contexts (by two 64-bit hashes) keep the first. Anchors that occur once are done; where several
   different contexts share an anchor, the first of each class is asked for.
3. Cut: the asked bytes are cut from the texts.
4. Refine: an anchor with more than ``most_contexts`` different contexts is refined until its groups are small. Its contexts
   are cut into pieces of strings that stand at like distances from the anchor; all strings of a piece share a longer core
   around the anchor, which takes the anchor's place. Each round divides the distances by four, equal pieces keep the
   first, and cores are counted in a pre-aggregated step of their own, so no group is ever gathered.
5. Shards: whole groups fill a shard of at most ``shard_bytes``; its suffix array is built by induced sorting, its permuted
   common prefixes give runs of equal strings, and all but the first start of a run are repeats.
6. Digest: repeated strings meet the texts by document and the covered bytes are cut out.

Texts are scanned in pieces of ``buffer_bytes``, so that a very long one needs no more memory there than many short ones;
the digest holds one whole text at a time.

Defined results: a null text is empty; a text below ``length`` bytes loses nothing; equal rows of one doc_id count as one
place and keep or lose the same bytes; different texts of one doc_id are documents of their own, the one with the smaller
checksum first; a row with a null doc_id is left whole and not compared; a doc_id that is no integer raises TypeError;
ties cannot occur, since starts are distinct; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_sample, discard, giving_back, integer_id, materialise, shielded, shuffle_width, unshielded
from .suffix_array import permuted_common_prefixes, suffix_array

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

#: Rows of the scan: anchor, context, document and place; a place below 0 is a repeat from its complement to content.
SCANNED = "key long, content long, doc_id long, at long"

#: Rows of all later steps. REPEAT: string starts from at to key of a document. ASKED: a context without its bytes. PLAIN:
#: one with them, for a suffix array. PIECE: one to be refined. TEXT: a whole text, its checksum in key.
SCHEMA = "kind int, key long, content long, doc_id long, at long, body binary"
REPEAT, ASKED, PLAIN, PIECE, TEXT = range(5)

#: A place holds, from the top: 16 bits of the text's checksum, the first string's start (31), the number of strings (7),
#: the first string's distance to its anchor (7), and whether the anchor is common (1).
_START, _TAG = 15, 46


def _place(tag, start, n, back, wide) -> np.ndarray:
    return tag << _TAG | start << _START | n << 8 | back << 1 | wide


def _strings(at: np.ndarray) -> np.ndarray:
    return at >> 8 & 127


def checksum(text: bytes) -> int:
    return zlib.crc32(text) & 0xFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M[2]
    x = (x ^ (x >> np.uint64(29))) * _M[3]
    return x ^ (x >> np.uint64(32))


def gram_hashes(buffer: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes; gram is a power of two."""
    h, size, mul = _BYTE[buffer], 1, _M[0]
    while size < gram:
        h = h[:-size] * mul + h[size:]
        mul = mul * _M[1] + _M[0]
        size *= 2
    return _mix(h)


def _covering(h: np.ndarray, start: np.ndarray, size: np.ndarray, gram: int, most: int, seed: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of ``size`` bytes (gram to most) from each start, from runs that cover them, of the size and of the seed."""
    total = size.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) << np.uint64(32))
    for k in range(-(-most // gram)):
        total = (total ^ h[start + np.minimum(k * gram, size - gram)]) * _M[k & 1]
        total ^= total >> np.uint64(31)
    return _mix(total)


def contexts(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, first and last string start and the first one's distance to its anchor of every context."""
    long = ends - starts >= length
    if not long.any():
        return (*(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(3)))
    h = gram_hashes(buffer, gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(buffer) - length + 1], low[width - size :][: len(buffer) - length + 1])
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(owner) + 1, np.int32)
    edge[starts[long]] += 1
    edge[ends[long] - length + 1] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    change = np.flatnonzero(owner[1:] != owner[:-1])
    first = np.zeros(len(owner), bool)
    first[change + 1] = True
    first[starts[long]] = True
    last = np.zeros(len(owner), bool)
    last[change] = True
    last[ends[long] - length] = True
    lo, hi = np.flatnonzero(first & valid), np.flatnonzero(last & valid)
    return h[owner[lo]], _covering(h, lo, hi - lo + length, gram, 2 * length - gram), lo, hi, owner[lo] - lo


def _columns(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names)


def _rows(kind: int, key, content, doc, at, body: pa.Array | None = None) -> pa.RecordBatch:
    n = len(doc)
    longs = [pa.array(np.ascontiguousarray(c).view(np.int64)) if c is not None else pa.nulls(n, pa.int64()) for c in (key, content, doc, at)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), *longs, pa.nulls(n, pa.binary()) if body is None else body], ["kind", "key", "content", "doc_id", "at", "body"]
    )


def _longs(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(c).fill_null(0).to_numpy() for c in names]


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def _repeats(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Places of repeated strings, merged where they adjoin."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)
    lead = np.flatnonzero(new)
    return _rows(REPEAT, np.maximum.reduceat(last, lead) if len(lead) else last, None, doc[lead], first[lead])


def _again(key: np.ndarray, content: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(document, first and last place) of rows whose content stands earlier too, and the numbers of the others by class."""
    order = np.lexsort((at, doc, content, key))
    a, c = key[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again, first = order[~new], first[~new]
    place = at >> _START
    apart = (doc[again] != doc[first]) | (place[again] != place[first])
    again = again[apart]
    return (doc[again], place[again], place[again] + _strings(at[again]) - 1), order[new]


def find_repeats_in_shard(bodies: list[bytes], doc: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of contexts, and string starts in them, of all strings that a context before has, or the same further left.

    The contexts stand in the order of document and place.
    """
    sizes = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"".join(bodies), np.uint8)
    sa = suffix_array(text)
    prefixes = permuted_common_prefixes(text, sa, length)
    ends = np.repeat(np.cumsum(sizes), sizes)
    whole = ends - np.arange(len(text)) >= length
    # Between two whole strings others may stand that a context's end cuts off; a run breaks only where a prefix is short.
    run = np.cumsum(prefixes[sa] < length)
    kept = whole[sa]
    at, run = sa[kept], run[kept]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.minimum.reduceat(at, cuts := np.flatnonzero(np.diff(run, prepend=-1)))
    first = np.repeat(first, np.diff(np.append(cuts, len(at))))
    number = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    own, other = number[at], number[first]
    again = (doc[own] != doc[other]) | (place[own] + at - begin[own] != place[other] + first - begin[other])
    return own[again], (at - begin[own])[again]


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _segments(texts: list[bytes], length: int, most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of about ``most`` bytes of (number of the text, start, bytes): texts, the long ones cut so that each string is
    in one of them."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), most):
            part = text if len(text) < most + length else text[a : a + most + length - 1]
            if len(part) >= length:
                group.append((i, a, part))
                size += len(part)
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def _scan(batch: pa.RecordBatch, length: int, gram: int, buffer_bytes: int) -> tuple[np.ndarray, ...]:
    """Key, content, document and place of all contexts of a batch."""
    ids, texts = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
    found = [(np.zeros(0, np.int64),) * 4]
    for group in _segments(texts, length, buffer_bytes):
        ends = np.cumsum([len(t) for _, _, t in group])
        starts = np.concatenate(([0], ends[:-1]))
        key, content, lo, hi, back = contexts(np.frombuffer(b"".join(t for _, _, t in group), np.uint8), starts, ends, length, gram)
        which = np.searchsorted(ends, lo, "right")
        number = np.array([i for i, _, _ in group])
        tags = np.array([checksum(texts[i]) for i, _, _ in group], np.int64)
        at = _place(tags[which], lo - starts[which] + np.array([a for _, a, _ in group])[which], hi - lo + 1, back, 0)
        found.append((key.view(np.int64), content.view(np.int64), ids[number][which], at))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def common_anchors(rows: DataFrame, length: int, gram: int, buffer_bytes: int, sample_rows: int, least: int) -> np.ndarray:
    """Anchors with at least ``least`` different contexts in a sample of documents; this only steers where rows go."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                key, content, _, _ = _scan(batch, length, gram, buffer_bytes)
                pairs = np.unique(np.stack((key, content), 1), axis=0)
                found, n = np.unique(pairs[:, 0], return_counts=True)
                several = n > 1  # an anchor that is common in the sample is so in some of its batches
                yield _columns(["key", "n"], found[several], n[several])

    n = rows.count()
    sample = bounded_sample(rows.select("doc_id", "text"), max(sample_rows, n >> 14), n=n)
    counted = sample.mapInArrow(giving_back(scan), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r.key for r in counted.select("key").collect()], np.int64))


def refined(key: np.ndarray, doc: np.ndarray, at: np.ndarray, bodies: list[bytes], length: int, gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of pieces whose strings stand at the same multiple of ``width`` from the anchor, keyed by the core that the
    strings of that multiple share; equal pieces keep the first."""
    buffer = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum([0, *(len(b) for b in bodies[:-1])])
    back, n = at >> 1 & 127, _strings(at)
    pieces = back // width - (back - n + 1) // width + 1
    row = np.repeat(np.arange(len(at)), pieces)
    bucket = back[row] // width - (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    high = np.minimum(back[row], bucket * width + width - 1)
    low = np.maximum(back[row] - n[row] + 1, bucket * width)
    skip = back[row] - high
    near, far = bucket * width, np.minimum(length - gram, bucket * width + width - 1)
    with np.errstate(over="ignore"):
        h = gram_hashes(buffer, gram)
        core = _covering(h, begin[row] + back[row] - near, length - (far - near), gram, length, (bucket + 1) * 256 + width).view(np.int64)
        start, size = begin[row] + skip, high - low + length
        content = _covering(h, start, size, gram, 2 * length - gram).view(np.int64)
    place = _place(at[row] >> _TAG, (at[row] >> _START & 0x7FFFFFFF) + skip, high - low + 1, high, 0)
    doc = doc[row]
    again, one = _again(core, content, doc, place)
    yield _repeats(*again)
    raw = buffer.tobytes()
    body = pa.array([raw[a : a + s] for a, s in zip(start[one].tolist(), size[one].tolist(), strict=True)], pa.binary())
    yield _rows(PIECE, core[one], content[one], doc[one], place[one], body)


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each text, in order: its document, its row's number and batch, the rows of the document that stand before it as
    (key, content, at), and its checksum."""
    now, held = None, []

    def take(doc_id: int, part: list[np.ndarray]) -> None:
        nonlocal now, held
        if now != doc_id:
            now, held = doc_id, []
        if len(part[0]):
            held.append(part)

    for batch in batches:
        kind, key, content, doc, at = _longs(batch, "kind", "key", "content", "doc_id", "at")
        begin = 0
        for t in np.flatnonzero(kind == TEXT).tolist():
            take(int(doc[t]), [c[begin:t] for c in (key, content, at)])
            begin = t + 1
            rows = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 3
            yield now, t, batch, rows, int(key[t])
        if begin < len(doc):
            take(int(doc[begin]), [c[begin:] for c in (key, content, at)])


def _squeezed(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """TEXT rows: the compressed text, and the ``keep`` columns pickled in ``rest``."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rest = list(zip(*(batch.column(c).to_pylist() for c in keep), strict=True)) or [()] * len(texts)
            tags = np.array([checksum(t) for t in texts], np.int64)
            made = _rows(TEXT, tags, None, batch.column("doc_id").to_numpy(), None, pa.array([packer.compress(t) for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array([pickle.dumps(x) if x else None for x in rest], pa.binary())], [*made.schema.names, "rest"])

    return rows.mapInArrow(squeeze, SCHEMA + ", rest binary")


def repeated_places(rows: DataFrame, texts: DataFrame, parts: int, length: int, gram: int, shard_bytes: int, buffer_bytes: int, sample_rows: int, most_contexts: int) -> DataFrame:
    """A table of REPEAT rows, of all strings that stand earlier too."""
    common = rows.sparkSession.sparkContext.broadcast(common_anchors(rows, length, gram, buffer_bytes, sample_rows, 16))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "content", "doc_id", "at"]
        with np.errstate(over="ignore"):
            for batch in batches:
                key, content, doc, at = _scan(batch, length, gram, buffer_bytes)
                again, one = _again(key, content, doc, at)
                yield _columns(names, again[1], again[2], again[0], ~again[1])
                one = np.sort(one)
                yield _columns(names, key[one], content[one], doc[one], at[one] | _in_sorted(key[one], common.value))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            columns = _longs(batch, "key", "content", "doc_id", "at")
            known = columns[3] < 0
            yield _repeats(columns[2][known], ~columns[3][known], columns[1][known])
            kept.append([c[~known] for c in columns])
        if not kept:
            return
        key, content, doc, at = (np.concatenate(c) for c in zip(*kept, strict=True))
        kept.clear()
        again, one = _again(key, content, doc, at)
        yield _repeats(*again)
        same = key[one][1:] == key[one][:-1]
        group = np.cumsum(np.concatenate(([0], ~same)))[: len(one)]
        n = np.bincount(group)[group] if len(one) else group
        steered = (at[one] & 1).astype(bool)
        wide = steered | (n > most_contexts)
        ask = steered | (n > 1)
        chosen = one[ask]
        yield _rows(ASKED, key[chosen], content[chosen], doc[chosen], (at[chosen] | 1) - 1 + wide[ask])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        taken: list[bytes] = []
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
            wide = (at & 1).astype(bool)
            few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
            yield _rows(PLAIN, key[few], None, doc[few], at[few], pa.array([taken[i] for i in few.tolist()], pa.binary()))
            if len(many):
                yield from refined(key[many], doc[many], at[many], [taken[i] for i in many.tolist()], length, gram, widths[0])

        for doc, t, batch, (key, _, at), tag in by_document(batches):
            own = at >> _TAG == tag
            key, at = key[own], at[own]
            if not len(at):
                continue
            text = expand.decompress(batch.column("body")[t].as_py())
            first = at >> _START & 0x7FFFFFFF
            taken.extend(text[a:b] for a, b in zip(first.tolist(), (first + _strings(at) + length - 1).tolist(), strict=True))
            held.append((key, np.full(len(at), doc), at))
            if len(taken) > 40_000:
                yield from flush()
                taken, held = [], []
        if taken:
            yield from flush()

    def first_of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is not None:
            columns = _longs(table, "key", "content", "doc_id", "at")
            again, one = _again(*columns)
            yield _repeats(*again)
            for part in np.array_split(one, len(one) // 10_000 + 1):
                body = pa.array(table.column("body").take(pa.array(part)).to_pylist(), pa.binary())
                yield _rows(PIECE, *(c[part] for c in columns), body)

    def refine(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, doc, at, n = _longs(batch, "key", "doc_id", "at", "n")
                few, many = np.flatnonzero(n <= most_contexts), np.flatnonzero(n > most_contexts)
                bodies = batch.column("body")
                yield _rows(PLAIN, key[few], None, doc[few], at[few], bodies.take(pa.array(few)))
                if len(many):
                    yield from refined(key[many], doc[many], at[many], bodies.take(pa.array(many)).to_pylist(), length, gram, width)

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        key, doc, at = _longs(table, "key", "doc_id", "at")
        bodies, place = table.column("body"), at >> _START
        order = np.lexsort((at, doc, key))
        bounds = np.flatnonzero(np.diff(key[order], append=~key[order[-1:]])) + 1
        total = np.cumsum((_strings(at) + length - 1)[order])
        begin, found = 0, []
        for b, to in enumerate(bounds.tolist()):
            if b + 1 < len(bounds) and total[bounds[b + 1] - 1] - (total[begin - 1] if begin else 0) <= shard_bytes:
                continue
            part = order[begin:to]
            part = part[np.lexsort((place[part], doc[part]))]
            k, offset = find_repeats_in_shard(bodies.take(pa.array(part)).to_pylist(), doc[part], place[part], length)
            found.append((doc[part[k]], place[part[k]] + offset))
            begin = to
        where = np.concatenate([x for _, x in found])
        yield _repeats(np.concatenate([d for d, _ in found]), where, where)

    widths = [-(-(length - gram + 1) // 4)]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // 4))
    by = F.expr("case when at < 0 then doc_id when at % 2 = 1 then content else key end")
    classed = materialise(rows.mapInArrow(giving_back(scan), SCANNED).repartition(parts, by).mapInArrow(giving_back(classes), SCHEMA), "classes")
    meet = classed.filter(F.col("kind") == ASKED).unionByName(texts).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind", "at")
    tables = [classed, materialise(meet.mapInArrow(giving_back(cut), SCHEMA), "contexts")]
    for width in [*widths[1:], 1]:
        pieces = tables[-1].filter(F.col("kind") == PIECE)
        if pieces.isEmpty():
            break
        firsts = materialise(pieces.repartition(parts, "key", "content").mapInArrow(giving_back(first_of_class), SCHEMA), "pieces")
        one = firsts.filter(F.col("kind") == PIECE)
        # A core that strings of one piece alone have is done.
        shared = one.join(one.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
        tables += [firsts, materialise(shared.mapInArrow(giving_back(refine(width)), SCHEMA), "refined")]
    plain = reduce(DataFrame.unionByName, (t.filter(F.col("kind") == PLAIN) for t in tables[1:]))
    known = reduce(DataFrame.unionByName, (t.filter(F.col("kind") == REPEAT) for t in tables))
    out = materialise(plain.repartition(parts, "key").mapInArrow(giving_back(compare), SCHEMA).unionByName(known), "repeats")
    for t in tables:
        discard(t)
    return out


def remove_repeats(
    docs: DataFrame, length: int = 100, gram: int = 32, shard_bytes: int = 1 << 19, keep: tuple[str, ...] = (), most_contexts: int = 256, buffer_bytes: int = 2 << 20, sample_rows: int = 8192
) -> DataFrame:
    """doc_id, the ``keep`` columns, n_bytes, n_removed, n_spans and the kept bytes of every document."""
    if gram & (gram - 1) or length < 2 * gram or length - gram + 1 > 127:
        raise ValueError("gram must be a power of two, at most half of length; contexts have at most 127 strings")
    parts = shuffle_width(docs, 2)
    rows = docs.select(integer_id(docs).alias("doc_id"), *keep, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).filter("doc_id is not null")
    texts = _squeezed(rows, keep)
    found = repeated_places(rows.select("doc_id", "text"), _squeezed(rows.select("doc_id", "text"), ()).drop("rest"), parts, length, gram, shard_bytes, buffer_bytes, sample_rows, most_contexts)
    meet = found.withColumn("rest", F.lit(None).cast("binary")).unionByName(texts).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind", "at")
    kinds = [f.type for f in to_arrow_schema(docs.select(*keep).schema)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], pa.int64())]
            columns += [pa.array([r[1][k] for r in rows], kind) for k, kind in enumerate(kinds)]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)] + [pa.array([r[5] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "kept"])

        rows: list[tuple] = []
        size = 0
        for doc, t, batch, (last, _, first), tag in by_document(batches):
            text = expand.decompress(batch.column("body")[t].as_py())
            own = first >> 31 == tag
            kept, spans = cut_out(text, first[own] & 0x7FFFFFFF, last[own] & 0x7FFFFFFF, length)
            rest = batch.column("rest")[t].as_py()
            rows.append((doc, pickle.loads(rest) if rest else (), len(text), len(text) - len(kept), spans, kept))
            size += len(kept)
            if len(rows) >= 1000 or size > 8 * buffer_bytes:
                yield made(rows)
                rows, size = [], 0
        yield made(rows)

    own = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    zero = F.lit(0).cast("long")
    whole = docs.filter("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), *keep, F.length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), text.alias("kept")
    )
    return meet.mapInArrow(giving_back(digest), f"doc_id long{own}, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(whole)


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with their repeated passages cut out; n_chars, if there, follows the new text.

    A document that had text and keeps none goes. Of a character that a cut divides, the rest is dropped too.
    """
    rows = shielded(docs)
    keep = tuple(c for c in rows.columns if c not in ("doc_id", "text"))
    out = remove_repeats(rows, keep=keep, **options).filter("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") > 0, whole_characters("kept")).otherwise(F.col("kept").cast("string"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return unshielded(out, docs)


def whole_characters(column: str) -> F.Column:
    """Bytes as text, without the pieces of characters that cutting has left."""
    mended = F.expr(f"make_valid_utf8(cast({column} as string))")
    return F.translate(mended, "�", "")


def cut_out(text: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[bytes, int]:
    """The text without the bytes that the strings starting at lo..hi cover, and the number of removed runs."""
    kept, at, spans, end = [], 0, 0, -1
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if a > end:
            spans += 1
        if a > at:
            kept.append(text[at:a])
        end = max(end, b + length)
        at = max(at, end)
    kept.append(text[at:])
    return b"".join(kept), spans
