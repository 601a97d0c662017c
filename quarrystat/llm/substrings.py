"""Suffix-array dedup: bytes of 100-byte strings that start earlier somewhere are removed.

1. Candidates. Every window of 100 bytes has a smallest 16-byte gram hash. Equal
   windows have the same one, and neighbouring windows share it, so a text falls
   into segments: runs of windows with one hash. A hash that is in one place of the
   whole corpus cannot belong to a repeated window. Hashes are counted with a
   combine in every task.
2. Shards. Segments whose hash occurs again meet, with their bytes, in shards of
   bounded size, keyed by the hash. Identical segments collapse to the earliest.
   What is left with an equal hash loses the windows whose own hash is in the shard once
   (again exactly ruled out); the rest goes through a suffix array (Larsson-Sadakane:
   sort by eight bytes, then refine only tied suffixes by doubling, in numpy) and
   Kasai's common prefixes (the bound PLCP[i] >= PLCP[i-1] - 1 in strides, so that numpy
   can take all of them at once). Suffixes with 100 bytes in common are one string; all
   but the earliest start are removed.
3. Merging. A hash with more segments than ``HOT`` is dealt over several shards. Each
   returns its earliest windows in order of their digests, one row per run of a digest range;
   runs of a range are merged by binary search and only the earliest start stays.
4. Documents meet their spans by id and digest of the text, and only then lose bytes.

A window is compared by its bytes within a shard, and by 128-bit digests between
shards. Nothing depends on how the text was cut into batches.

Defined cases: null text is empty; documents with a null id sort last; rows with the
same id are one document for the order of starts (the same start is not earlier), but
each text among them has its own hashes and spans;
texts under 100 bytes keep everything; other columns are never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.llm.common import row_id, saved

LENGTH, GRAM = 100, 16
SPAN = LENGTH - GRAM + 1                      # grams in a window
#: Segments of one hash that one shard takes; more are dealt over several.
HOT = 20_000
#: Bytes of segments in a shard, windows of a text handled at once, and bytes of texts hashed together.
SHARD_BYTES, BLOCK, GROUP = 4 << 20, 1 << 20, 1 << 16
#: Digest ranges in which the shards of a hot hash are merged.
RANGES = 64
_BYTE_STEPS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
_HALF = np.uint64(32)
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each 16-byte string, from its two words of eight bytes."""
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = np.ndarray((n + 8,), "<u8", np.ascontiguousarray(b), strides=(1,)).astype(np.uint64)
    h = w[:n] * _ODD[0]
    h ^= h >> _HALF
    h += w[8:]
    h *= _ODD[1]
    h ^= h >> _HALF
    h *= _ODD[2]
    return h


def window_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each window, from its grams."""
    h = gram_hashes(b)
    for step in (GRAM, 2 * GRAM, LENGTH - 4 * GRAM):          # 32, 64 and, overlapping, 100 bytes
        h = h[:-step] * _ODD[1] + h[step:]
        h ^= h >> _HALF
    return h * _ODD[0]


def _sliding(best, x: np.ndarray) -> np.ndarray:
    """The minimum or maximum of each ``SPAN`` values in a row."""
    n, count = 1, len(x) - SPAN + 1
    while 2 * n <= SPAN:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[:count], x[SPAN - n:SPAN - n + count])


def _groups(texts):
    """Texts side by side, so that numpy is called for many at once: ``(owner, offset, begin, count, g)``,
    arrays of the number of each text, where its part starts in it and in the group, the windows of
    the part, and the gram hashes of the group. Long texts come in blocks."""
    def group():
        sizes = np.fromiter((len(x) for _, _, x in parts), np.int64, len(parts))
        b = np.frombuffer(b"".join([x for _, _, x in parts]), np.uint8)
        return (np.array([k for k, _, _ in parts]), np.array([at for _, at, _ in parts]),
                np.cumsum(sizes) - sizes, sizes - LENGTH + 1, gram_hashes(b))
    parts, size = [], 0
    for k, raw in enumerate(texts):
        for at in range(0, len(raw) - LENGTH + 1, BLOCK):
            if parts and size + min(len(raw) - at, BLOCK) > GROUP:
                yield group()
                parts, size = [], 0
            parts.append((k, at, raw[at:at + BLOCK + LENGTH - 1]))
            size += len(parts[-1][2])
    if parts:
        yield group()


def _smallest(x: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The smallest value in each window of a group; zero for windows that lie across two texts."""
    m = _sliding(np.minimum, x)
    m[((begin + count)[:-1, None] + np.arange(LENGTH - 1)).reshape(-1)] = 0
    return m


def _places(upper: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where a hash is the smallest in some window, by the upper halves of the hashes (half a hash
    takes numpy far less time than a whole one)."""
    edge = np.zeros(SPAN - 1, np.uint32)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, m, edge])) == upper)


def anchors(texts):
    """``(text, hash, places)`` arrays: the hashes that are smallest in some window of a text, and at
    how many places in a row. A hash that shares its upper half with a smallest one may be among
    them: one candidate more."""
    for owner, _, begin, count, g in _groups(texts):
        upper = (g >> _HALF).astype(np.uint32)
        at = _places(upper, _smallest(upper, begin, count))
        h, k = g[at], np.repeat(owner, np.diff(np.append(begin, begin[-1] + count[-1] + LENGTH)))[at]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]))
        yield k[first], h[first].view(np.int64), np.diff(np.append(first, len(h)))


def segments_of(texts):
    """``(text, hash, first window, end)`` arrays of the segments of texts."""
    for owner, offset, begin, count, g in _groups(texts):
        upper = (g >> _HALF).astype(np.uint32)
        m = _smallest(upper, begin, count)
        at = _places(upper, m)
        x = np.sort(g[at])
        halves = not ((x[1:] >> _HALF == x[:-1] >> _HALF) & (x[1:] != x[:-1])).any()
        if not halves:                                       # two hashes of one upper half
            m = _smallest(g, begin, count)
        new = np.concatenate([[True], m[1:] != m[:-1]])
        new[begin] = True
        new[(begin + count)[:-1]] = True
        s = np.flatnonzero(new)
        part = np.searchsorted(begin, s, side="right") - 1
        end = np.append(s[1:], len(m))
        inside = s < (begin + count)[part]
        s, end, part = s[inside], end[inside], part[inside]
        h = m[s]
        if halves:
            k = np.searchsorted(at, s)
            while len(miss := np.flatnonzero(upper[at[k]] != h)):
                k[miss] += 1                                 # the smallest lies behind another place of the window
            h = g[at[k]]
        back = offset[part] - begin[part]
        yield owner[part], h.view(np.int64), s + back, end + back


def segments(raw: bytes):
    """``(hash, first window, end)`` arrays of the segments of a text."""
    out = [x[1:] for x in segments_of([raw])]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


# --- suffix arrays ---------------------------------------------------------------

def words_at(b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number; zeros from ``stop`` on."""
    wide = np.concatenate([b, np.zeros(8, np.uint8)])
    w = np.ndarray((len(b),), ">u8", wide, strides=(1,)).astype(np.uint64)
    left = stop - np.arange(len(b))
    short = np.flatnonzero(left < 8)
    w[short] &= ~np.uint64(0) << (np.uint64(64) - 8 * left[short].astype(np.uint64))
    return w


def _ordered(key: np.ndarray):
    """``(order, first)``: places by key, ties by place, and which of them starts a new key.
    Two unstable sorts are faster than a stable one."""
    order = np.argsort(key)
    new = key[order]
    new = np.concatenate([[True], new[1:] != new[:-1]]) if len(key) else np.zeros(0, bool)
    both = (np.cumsum(new) << 32) | order
    both.sort()
    return both & 0xFFFFFFFF, new


def _small(n: int):
    """The integers that hold places below n: small ones move less memory."""
    return np.int32 if n < 1 << 31 else np.int64


def suffix_array(words: np.ndarray, stop: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions in order of their first ``depth`` bytes or more; ``stop``: end of each position's text."""
    n, small = len(words), _small(len(words))
    sa, first = _ordered(words)
    sa, left = sa.astype(small), (stop - np.arange(n)).astype(small)
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0)).astype(small)     # of each place in sa
    rank = np.empty(n, small)
    rank[sa] = group
    h = 8
    while h < depth:
        tied = np.flatnonzero(~first | ~np.append(first[1:], True))
        if not len(tied):
            break
        pos = sa[tied]
        then = np.where(left[pos] > h, rank[np.minimum(pos, n - 1 - h) + small(h)], small(-1)) if n > h else np.full(len(pos), -1)
        key = group[tied].astype(np.int64) * (n + 1) + (then + 1)
        order = np.argsort(key, kind="stable")               # runs of one group: nearly in order
        sa[tied], key = pos[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[tied] = new
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[sa[tied]] = group[tied]
        h *= 2
    return sa.astype(np.int64)


def common_prefixes(words: np.ndarray, stop: np.ndarray, sa: np.ndarray, cap: int = LENGTH, stride: int = 8) -> np.ndarray:
    """``lcp[k]`` of sa[k] and sa[k - 1], at most ``cap``.

    Where i - 1 shares l bytes with its predecessor j, i shares l - 1 with j + 1, and so with
    its own predecessor if j + 1 comes before i. In a full suffix array it always does. Here
    ties beyond the sorted depth lie in any order: where l reaches ``cap`` the bound is only
    taken if j + 1 is the predecessor of i itself.
    """
    n, small = len(sa), _small(len(sa))
    before, left = np.full(n, -1, small), (stop - np.arange(n)).astype(small)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, small)
    for phase in range(stride):
        i = np.arange(phase, n, stride, dtype=small)
        j = before[phase::stride]
        known = np.zeros(len(i), small)
        if phase:
            last = plcp[phase - 1::stride][:len(i)]
            known = np.maximum(last - 1, 0)
            known[(last >= cap) & (j != before[phase - 1::stride][:len(i)] + 1)] = 0
        most = np.where(j < 0, small(0), np.minimum(np.minimum(left[phase::stride], left[j]), small(cap)))
        known = np.minimum(known, most)
        at = np.flatnonzero(known < most)
        while len(at):
            x = words[i[at] + known[at]] ^ words[j[at] + known[at]]
            whole = x == 0
            ends = at[~whole]
            # equal leading bytes: seven less the powers of 256 that x reaches
            known[ends] = np.minimum(known[ends] + 7 - np.searchsorted(_BYTE_STEPS, x[~whole], side="right"), most[ends])
            at = at[whole]
            known[at] = np.minimum(known[at] + 8, most[at])
            at = at[known[at] < most[at]]
        plcp[phase::stride] = known
    return plcp[sa]


def _places_again(b: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places in ``b`` of the whole windows of the pieces whose hash is there more than once (in part of
    its bits, which lets a few more pass). Windows of the same bytes are all among them."""
    count = np.maximum(sizes - LENGTH + 1, 0)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(at):
        return at
    low = (np.uint64(1) << np.uint64(len(at).bit_length())) - np.uint64(1)
    key = (window_hashes(b)[at] & ~low) | np.arange(len(at), dtype=np.uint64)
    key.sort()
    same = (key[1:] ^ key[:-1]) <= low
    again = np.zeros(len(at), bool)
    of = (key & low).astype(np.int64)
    again[of[1:][same]] = True
    again[of[:-1][same]] = True
    return at[again]


def repeated_windows(pieces: list[bytes], order: np.ndarray):
    """Windows of the pieces by string: ``(piece, offset, class, is first)``. ``order[p]`` is a
    number that sorts the start of piece p; its windows follow one by one. Windows that are not
    returned are there once."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    whole = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    # Suffixes of runs of windows that may repeat: the others only cost time.
    at = _places_again(whole, begin, sizes)
    if not len(at):
        return at, at, at, np.zeros(0, bool)
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    sizes_run = at[np.append(heads[1:], len(at)) - 1] - at[heads] + LENGTH
    end = np.cumsum(sizes_run)
    place = np.repeat(at[heads] - (end - sizes_run), sizes_run) + np.arange(end[-1])
    b, stop = whole[place], np.repeat(end, sizes_run)
    words = words_at(b, stop)
    sa = suffix_array(words, stop)
    lcp = common_prefixes(words, stop, sa)
    full = stop[sa] - sa >= LENGTH                       # starts of whole windows
    kind = np.cumsum(lcp < LENGTH)[full]
    at = place[sa[full]]
    piece = np.repeat(np.arange(len(pieces)), sizes)[at]
    key = order[piece] + (at - begin[piece])
    heads = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(key, heads) if len(kind) else key
    first = key == np.repeat(low, np.diff(np.append(heads, len(kind))))
    return piece, at - begin[piece], kind, first


def _spans(owner: np.ndarray, at: np.ndarray):
    """Runs of windows as ``(owner, first byte, bytes)``."""
    if not len(at):
        return owner, at, at
    o = np.lexsort((at, owner))
    owner, at = owner[o], at[o]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(at)) - 1
    return owner[s], at[s], at[e] - at[s] + LENGTH


def _shard(h, salt, d, t, s, pieces, hot):
    """One shard: removed spans ``(d, t, s, bytes)``, and the earliest windows of hot hashes
    as rows ``(digest high, digest low, d, s, t)``."""
    o = np.lexsort((s, d))
    h, salt, d, t, s, hot, pieces = h[o], salt[o], d[o], t[o], s[o], hot[o], [pieces[k] for k in o]
    seen, same, gone, ties = {}, np.zeros(len(h), bool), [], {}
    for k, p in enumerate(pieces):
        of = seen.setdefault(p, k)
        if of != k:
            same[k] = True
            if (d[of], s[of]) != (d[k], s[k]):
                gone.append((d[k], t[k], s[k], len(p)))
            elif t[of] != t[k]:                                   # another text of the id: what goes from one goes from both
                ties.setdefault((int(d[of]), int(t[of]), int(s[of]), len(p)), set()).add(int(t[k]))
    left = np.flatnonzero(~same)
    twins = {}
    for k in left.tolist() if ties else ():
        twins[len(twins)] = ties.get((int(d[k]), int(t[k]), int(s[k]), len(pieces[k])), ())
    h, salt, d, t, s, hot, pieces = h[left], salt[left], d[left], t[left], s[left], hot[left], [pieces[k] for k in left]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    # A lone segment matters only if it repeats inside itself: its gram is there twice.
    b = np.frombuffer(b"".join(pieces), np.uint8)
    g = gram_hashes(b).view(np.int64) if len(b) >= GRAM else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(pieces)), sizes)[:len(g)]
    inside = np.arange(len(g)) + GRAM <= (np.cumsum(sizes))[own]
    times = np.bincount(own[(g == h[own]) & inside], minlength=len(pieces))
    _, which, count = np.unique(h, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero((count[which] > 1) | (times > 1) | hot)
    removed, exported = [np.array(gone, np.int64).reshape(-1, 4)], []
    if len(open_):
        _, rank = np.unique(d[open_], return_inverse=True)
        p, off, kind, first = repeated_windows([pieces[k] for k in open_], (rank.astype(np.int64) << 40) + s[open_])
        q = open_[p]
        # Runs within a piece: neighbours of one id may be of different texts.
        who, at, n = _spans(q[~first], s[q[~first]] + off[~first])
        removed.append(np.stack([d[who], t[who], at, n], axis=1).astype(np.int64).reshape(-1, 4))
        more = [(d[k], x, a, m) for k, a, m in zip(who.tolist(), at.tolist(), n.tolist()) for x in twins.get(k, ())]
        removed.append(np.array(more, np.int64).reshape(-1, 4))
        lost = np.zeros(sizes.sum() if hot.any() else 0, bool)       # windows that another is before
        begin = np.cumsum(sizes) - sizes
        if len(lost):
            lost[(begin[q] + off)[~first]] = True
        for k in open_[hot[open_]].tolist():
            piece = pieces[k]
            at = np.flatnonzero(~lost[begin[k]:begin[k] + sizes[k] - LENGTH + 1])
            x = np.frombuffer(b"".join([xxhash.xxh3_128_digest(piece[a:a + LENGTH]) for a in at.tolist()]), ">i8").reshape(-1, 2)
            for own in (int(t[k]), *twins.get(k, ())):
                exported.append(np.column_stack([x, np.full(len(at), d[k]), s[k] + at, np.full(len(at), own)]).astype(np.int64))
    return np.concatenate(removed), np.concatenate(exported) if exported else np.zeros((0, 5), np.int64)


# --- Spark ----------------------------------------------------------------------

def _packed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, d, t, z)``: texts compressed for the shuffle; t is a digest of the text."""
    def batches(it):
        for b in it:
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(
                [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(3).to_pylist()], pa.binary())], ["doc_id", "d", "t", "z"])
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("d"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(
        batches, "doc_id long, d long, t long, z binary")


def _anchors(docs: DataFrame) -> DataFrame:
    """``(h, d, t, m)``: the segment hashes of each document and in how many places they are."""
    def batches(it):
        for b in it:
            d, t = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = ((x or "").encode("utf-8", "surrogatepass") for x in b.column(2).to_pylist())
            for k, h, m in anchors(texts):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, d[k], t[k], m)], ["h", "d", "t", "m"])
    text = F.col("text").cast("string")
    rows = docs.select(row_id().alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.mapInArrow(batches, "h long, d long, t long, m long")


def _hits(docs: DataFrame) -> DataFrame:
    """``(d, t, hs, ns)``: the hashes of each text of an id that occur again, and their counts."""
    hits = _anchors(docs).withColumn("n", F.sum("m").over(Window.partitionBy("h"))).where("n > 1")
    # A task holds many documents; lists are only as long as a document.
    by_doc = hits.groupBy("d", "t").agg(F.collect_set(F.struct("h", "n")).alias("x"))
    return saved(by_doc.select("d", "t", F.col("x.h").alias("hs"), F.col("x.n").alias("ns")), "repeated-hashes")


def _by_text(found):
    """Arrays of many texts, one text (or a part of it) after the other: ``(text, arrays ...)``."""
    for k, *x in found:
        edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])).tolist() + [len(k)]
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(k[a]), *[v[a:b] for v in x]


def _pieces(docs: DataFrame, hits: DataFrame, hot: int) -> DataFrame:
    """Segments that meet others ``(h, salt, hot, d, t, s, n, piece)``; a null piece is a span that
    is known to go: in one batch of documents only the earliest of identical segments is sent."""
    def batches(it):
        for b in it:
            seen: dict = {}
            unz, found = zstandard.ZstdDecompressor(), []
            hs, ns = b.column(3), b.column(4)
            ds, ts = b.column(0).to_pylist(), b.column(1).to_pylist()
            raws: dict = {}                                          # texts of the group at hand

            def opened():
                for k, z in enumerate(b.column(2).to_pylist()):
                    raws[k] = unz.decompress(z)
                    yield raws[k]
            last = -1
            for k, h, s, e in _by_text(segments_of(opened())):
                if k != last:
                    for done in [x for x in raws if x < k]:
                        del raws[done]
                    want, n = hs[k].values.to_numpy(zero_copy_only=False), ns[k].values.to_numpy(zero_copy_only=False)
                    o = np.argsort(want)
                    want, n, raw, d, t, last = want[o], n[o], raws[k], ds[k], ts[k], k
                at = np.minimum(np.searchsorted(want, h), len(want) - 1)
                hit = np.flatnonzero(want[at] == h)
                for row in zip([d] * len(hit), s[hit].tolist(), h[hit].tolist(), n[at[hit]].tolist(), e[hit].tolist()):
                    piece = raw[row[1]:row[4] + LENGTH - 1]
                    row = row[:4]
                    old = seen.get(piece)
                    if old is None:
                        seen[piece] = (row, {t})
                    elif old[0][:2] == row[:2]:
                        old[1].add(t)                                # the same start in another text of the id
                    else:
                        gone, whose = row, {t}
                        if row < old[0]:
                            seen[piece] = (row, {t})
                            gone, whose = old
                        found += [(gone[2], 0, False, gone[0], x, gone[1], len(piece), None) for x in whose]
            for piece, ((d, s, h, n), whose) in seen.items():
                parts = 1 + n // hot
                salt = xxhash.xxh64_intdigest(f"{d}:{s}") % parts if parts > 1 else 0
                found += [(h, salt, parts > 1, d, x, s, len(piece), piece) for x in whose]
            for at in range(0, len(found), 1 << 14):
                c = list(zip(*found[at:at + (1 << 14)]))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(c, (
                    pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["h", "salt", "hot", "d", "t", "s", "n", "piece"])
    joined = _packed_texts(docs).select("d", "t", "z").join(hits, ["d", "t"]).select("d", "t", "z", "hs", "ns")
    return joined.mapInArrow(batches, "h long, salt int, hot boolean, d long, t long, s long, n long, piece binary")


def _resolved(pieces: DataFrame) -> DataFrame:
    """Per shard: removed spans ``(d, t, s, n)``, and of hot hashes one row per digest range with
    the run of its earliest windows in order: ``(range, run)``."""
    names = ["d", "t", "s", "n", "range", "run"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def out(removed, exported):
        k = len(removed)
        cols = [*removed.T, [None] * k, [None] * k]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
        if len(exported):
            x = exported[np.lexsort((exported[:, 4], exported[:, 1], exported[:, 0]))]
            edges = np.searchsorted(x[:, 0], np.linspace(-2.0 ** 63, 2.0 ** 63, RANGES + 1)[1:-1].astype(np.int64))
            runs = [(i, r.tobytes()) for i, r in enumerate(np.split(x, edges)) if len(r)]
            none = [None] * len(runs)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                (none, none, none, none, [i for i, _ in runs], [r for _, r in runs]), kinds)], names)

    def batches(it):
        part, size, last = [], 0, None

        def flush():
            h, salt, hot, d, t, s, piece = zip(*part)
            return _shard(np.array(h, np.int64), np.array(salt), np.array(d, np.int64), np.array(t, np.int64), np.array(s, np.int64), list(piece), np.array(hot, bool))
        for b in it:
            c = [b.column(k).to_pylist() for k in range(8)]
            known = [(d, t, s, n) for d, t, s, n, p in zip(*c[3:]) if p is None]
            if known:
                yield from out(np.array(known, np.int64), ())
            for h, salt, hot, d, t, s, _, p in zip(*c):
                if p is None:
                    continue
                if size >= SHARD_BYTES and (h, salt) != last:
                    yield from out(*flush())
                    part, size = [], 0
                part.append((h, salt, hot, d, t, s, p))
                size, last = size + len(p), (h, salt)
        if part:
            yield from out(*flush())
    sharded = pieces.repartition("h", "salt").sortWithinPartitions("h", "salt")
    return sharded.mapInArrow(batches, "d long, t long, s long, n long, `range` int, run binary")


def _merged(runs: DataFrame) -> DataFrame:
    """Windows that a shard of a hot hash holds first but another shard earlier, as spans.
    Runs come in any order; each is looked up in what is known so far by binary search."""
    def batches(it):
        from_run: dict = {}
        for b in it:
            for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, np.int64).reshape(-1, 5)
                # The same start in several texts of an id: one entry, the texts aside.
                new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)])
                heads, mine_of = np.flatnonzero(new), {}
                group = np.cumsum(new) - 1
                for k in np.flatnonzero(~new).tolist():
                    mine_of.setdefault(tuple(x[heads[group[k]], :2].tolist()), set()).add(int(x[k, 4]))
                x = x[heads]
                key = np.rec.fromarrays([x[:, 0], x[:, 1]], names="a,b")
                old = from_run.get(r)
                if old is None:
                    from_run[r] = (key, x[:, 2:].copy(), mine_of)
                    continue
                okey, oat, twins = old
                at = np.searchsorted(okey, key)
                hit = np.flatnonzero(at < len(okey))
                hit = hit[okey[at[hit]] == key[hit]]
                gone = []
                for k in hit.tolist():
                    mine, theirs, name = tuple(x[k, 2:].tolist()), tuple(oat[at[k]].tolist()), tuple(x[k, :2].tolist())
                    ours, others = {mine[2], *mine_of.pop(name, ())}, {theirs[2], *twins.get(name, ())}
                    if mine[:2] == theirs[:2]:
                        if more := (ours | others) - {theirs[2]}:
                            twins[name] = more
                    elif mine < theirs:
                        gone += [(*theirs[:2], t) for t in others]
                        oat[at[k]] = mine
                        twins.pop(name, None)
                        if more := ours - {mine[2]}:
                            twins[name] = more
                    else:
                        gone += [(*mine[:2], t) for t in ours]
                twins.update(mine_of)
                rest = np.ones(len(key), bool)
                rest[hit] = False
                from_run[r] = (np.insert(okey, at[rest], key[rest]), np.insert(oat, at[rest], x[rest, 2:], axis=0), twins)
                if gone:
                    g = np.array(gone, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g[:, k].copy()) for k in (0, 2, 1)] + [pa.array(np.full(len(g), LENGTH))],
                                                     ["d", "t", "s", "n"])
    return runs.repartition("range").mapInArrow(batches, "d long, t long, s long, n long")


def removed_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(d, t, s, n)``: bytes to remove, possibly overlapping, by document order id and digest of the text."""
    found = saved(_resolved(_pieces(docs, _hits(docs), hot)), "spans")
    runs = found.where("run is not null").select("range", "run")
    return found.where("run is null").select("d", "t", "s", "n").unionByName(_merged(runs))


def substring_digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every document."""
    spans = removed_spans(docs, hot).groupBy("d", "t").agg(F.collect_set(F.struct("s", "n")).alias("x"))
    spans = spans.select("d", "t", F.col("x.s").alias("ss"), F.col("x.n").alias("ns"))

    def batches(it):
        for b in it:
            unz, rows = zstandard.ZstdDecompressor(), []
            for k, z in enumerate(b.column(1).to_pylist()):
                raw = unz.decompress(z)
                kept, n_spans = raw, 0
                if b.column(2)[k].is_valid:
                    s = b.column(2)[k].values.to_numpy(zero_copy_only=False)
                    e = s + b.column(3)[k].values.to_numpy(zero_copy_only=False)
                    delta = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(delta, s, 1)
                    np.add.at(delta, e, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
            c = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    rows = _packed_texts(docs).join(spans, ["d", "t"], "left").select("doc_id", "z", "ss", "ns")
    return rows.mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SUBSTRINGS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, (2 * p - 1)::INTEGER, 200)) AS s
      FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS p FROM d WHERE length(h) >= 200)),
f AS (SELECT doc_id, p, max(p + 99) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= seen + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM f),
r AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS since, a, b, lead(a) OVER o IS NULL AS last FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1)::BIGINT AS n_removed,
        string_agg(substr(h, (2 * since + 1)::INTEGER, (2 * (a - 1 - since))::INTEGER)
          || CASE WHEN last THEN substr(h, (2 * b + 1)::INTEGER) ELSE '' END, '' ORDER BY a) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
