"""Removal of long repeated byte strings by suffix arrays.

A byte goes if it lies in a string of `length` bytes that starts at another place too. Beside
that, passages are reported: runs of over `words` whole words whose bytes lie in strings of `passage`
bytes that stand in another document too (shorter strings than those that go, so that passages of
short words are found as well; nothing is removed for them). Both lengths go through the same steps,
side by side, so texts are read and moved once.

Places that can matter are found first: among any `length` consecutive bytes, the gram (of about a
sixth as many bytes) with the least hash is an anchor (winnowing), so equal strings have equal anchors
at one offset. The strings that chose an anchor make up its region. Regions of different places that
agree in a 128-bit hash are repeated throughout and need no sorting. Anchors with different regions go, one row per region, to shards by their hash.
A shard drops what cannot be repeated (no other string of `length` bytes in it has the same rolling
hash), cuts regions to what can, and sorts the suffixes of the different rest by Larsson-Sadakane
refinement (doubling the compared length, unsorted groups only) in numpy, with common prefixes by
Kasai's rule, which runs through all regions side by side. Suffixes that share `length` bytes and
start at different places are covered.

The regions of one anchor are dealt over shards, about `REGIONS` to each; a shard that holds all of
them needs no merging. Those that hold a part are merged: each offers, in the order of its suffix
array, the strings whose rolling hash stands in another part too, and every run of offered strings is
merged with the others two by two, each string of the one found in the other by binary search. Runs
are cut by the hash into buckets, so merges are bounded and what moves grows with the regions,
not with pairs of shards: a hash per string first, then the bytes of those that meet.

Scale: shuffled are anchors (about two in five sixths of a length), the texts twice (to cut regions,
to cut results), and the regions that differ. Counts by region are combined on the map side, so
copies that make up a third of the corpus are one row per task.

Defined results: null text is empty. Texts shorter than `length` keep everything. Rows that repeat
a doc_id and text are different documents: what they share is repeated. Words of a passage are
separated by white space and lie in it whole. Empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_columns, mapped, materialize, table

LENGTH = 400
PASSAGE, WORDS = 240, 50
REGIONS = 4_000  # different regions of one anchor that a shard holds, about
BUCKET = 4_096  # offered strings that one merge holds, about
SHARD_BYTES = 1 << 20
CHUNK, BUFFER = 1 << 20, 1 << 19  # bytes worked on at a time
_BASE = 0x9E3779B97F4A7C15


KEY = ["n", "fp", "d", "d2"]  # length, hash of the anchor, hash of the region


def gram(length: int) -> int:
    """Bytes of an anchor among strings of `length`: the fewer, the fewer anchors are needed."""
    return max(8, length * 4 // 25)


@functools.cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, base, np.uint64), np.full(1 << bits, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of any stretch of `data`, from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(_BASE, max(16, len(data).bit_length()))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts, ends) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def every(self, size: int) -> np.ndarray:
        """The hash of `size` bytes from each place on."""
        n = len(self.sums) - size
        return self(slice(0, n), slice(size, n + size))


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours, from the minima of blocks to either side."""
    n = len(h)
    blocks = np.concatenate([h, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _runs(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window, and window after the last, of each run of valid windows with one least value."""
    before = np.r_[False, valid[:-1]]
    new = valid & (~before | np.r_[True, least[1:] != least[:-1]])
    stops = np.flatnonzero(new | (~valid & before))
    begin = np.flatnonzero(new)
    return begin, np.r_[stops, len(least)][np.searchsorted(stops, begin) + 1]


def _chosen(h: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of the least value of windows of w places, and the first and last window that
    chose it, run by run; windows that are not valid choose nothing."""
    begin, end = _runs(_window_minima(h, w), valid)
    out = []
    while len(begin):
        p = begin + h[begin[:, None] + np.arange(w)].argmin(1)
        out.append((p, begin, np.minimum(end, p + 1)))
        more = p + 1 < end  # windows beyond it chose the next place of that value
        begin, end = p[more] + 1, end[more]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    p, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
    o = np.argsort(p, kind="stable")
    p, x, y = p[o], x[o], y[o]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return p[first], np.minimum.reduceat(x, first), np.maximum.reduceat(y, first) - 1


def _anchors(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For all parts at once: part, anchor, its hash, region (start, end) and the region's hash in two numbers."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = b"".join(parts)
    h, w = Rolling(np.frombuffer(text, np.uint8)).every(gram(length)), length - gram(length) + 1
    valid = np.zeros(len(h) - w + 1, bool)
    begins = np.cumsum(sizes) - sizes
    for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        valid[b : b + n - length + 1] = True
    p, x, y = _chosen(h, w, valid)
    y += length
    part = np.searchsorted(begins, x, "right") - 1
    digest, view = xxhash.xxh3_128_digest, memoryview(text)
    d = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(x.tolist(), y.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return part, p - begins[part], h[p], x - begins[part], y - begins[part], d[:, 0] ^ ((p - x).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), d[:, 1]


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of texts: text, place, hash, region (start, end) and the region's hash (two numbers). Texts are
    worked on together, long ones in parts that hold the strings that start there; what chose one
    anchor may be split at their ends."""
    out, parts, size = [], [], 0

    def flush() -> None:
        if parts:
            part, p, fp, a, e, *d = _anchors([c for _, _, c in parts], length)
            text, offset = np.array([k for k, _, _ in parts])[part], np.array([s for _, s, _ in parts])[part]
            out.append((text, p + offset, fp, a + offset, e + offset, *d))
            parts.clear()

    for k, t in enumerate(texts):
        for s in range(0, len(t) - length + 1, CHUNK):
            c = t[s : s + CHUNK + length - 1]
            parts.append((k, s, c))
            size += len(c)
            if size > BUFFER:
                flush()
                size = 0
    flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_array(text: np.ndarray, ends: np.ndarray, upto: int) -> np.ndarray:
    """Suffixes in order of their first `upto` bytes or more, ties by place; each ends where its region does."""
    n = len(text)
    room = (ends - np.arange(n)).astype(np.int32)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes of nine bits: 0 is the end
        key <<= np.uint64(9)
        here = room[: n - k] > k
        key[: n - k][here] |= text[k:][here].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key, kind="stable").astype(np.int32)
    # a group's number is the place of its first suffix in the order, so groups refine in place
    starts = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]]).astype(np.int32)
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    h = 7
    slot = np.arange(n, dtype=np.int32)  # places in the order that are not settled
    while h < upto and len(slot):
        r = rank[order[slot]]
        same = np.r_[r[1:] == r[:-1], False]
        slot = slot[same | np.r_[False, same[:-1]]]
        if not len(slot):
            break
        s = order[slot]
        nxt = np.where(room[s] > h, rank[np.minimum(s + h, n - 1)] + 1, 0)
        two = (rank[s].astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64)
        o = np.argsort(two, kind="stable")
        s, two = s[o], two[o]
        order[slot] = s
        at = np.flatnonzero(np.r_[True, two[1:] != two[:-1]])
        rank[s] = np.repeat(slot[at], np.diff(np.r_[at, len(s)]))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes (up to `most`) that each suffix shares with the one before it in the order. Kasai's
    rule: from one place to the next within a region it falls by one at most."""
    n = len(text)
    before = np.empty(n, np.int32)
    before[order] = np.r_[np.int32(-1), order[:-1]]
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= pad[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int32)
    h = np.zeros(len(begins), np.int64)
    for step in range(int(sizes.max()) if len(sizes) else 0):
        live = np.flatnonzero(sizes > step)
        i = begins[live] + step
        j = before[i]
        cap = np.where(j >= 0, np.minimum(np.minimum(ends[i] - i, ends[np.maximum(j, 0)] - j), most), 0)
        x = np.minimum(np.maximum(h[live] - 1, 0), cap)
        todo = np.flatnonzero(x < cap)
        while len(todo):
            a, b = i[todo] + x[todo], j[todo] + x[todo]
            diff = eight[a] ^ eight[b]
            low = diff & (~diff + np.uint64(1))
            got = np.where(diff == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) / 8).astype(np.int64))
            x[todo] = np.minimum(x[todo] + got, cap[todo])
            todo = todo[(got == 8) & (x[todo] < cap[todo])]
        h[live] = x
        out[i] = x
    return out


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _several(order: np.ndarray, first: np.ndarray, where: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each run of `order` that begins at `first`: whether it holds several places."""
    w = where[order]
    several = (np.minimum.reduceat(w, first) != np.maximum.reduceat(w, first)) | (np.maximum.reduceat(many[order].astype(np.int8), first) > 0)
    return several & (np.diff(np.r_[first, len(order)]) > 1)


def _sorted_strings(regions: list[bytes], absolute: np.ndarray, many: np.ndarray, length: int, across: bool) -> tuple[np.ndarray, ...]:
    """The regions one after the other, where each starts, and the region of each place; the places from
    which `length` bytes lie in one region, in suffix order, which of them are the first of equal strings,
    and whether those stand at a second place (`across`: in a second document)."""
    sizes = np.array([len(r) for r in regions], np.int64)
    text = np.frombuffer(b"".join(regions), np.uint8)
    begins, owner = _starts(sizes), np.repeat(np.arange(len(sizes)), sizes)
    ends = (begins + sizes)[owner]
    order = suffix_array(text, ends, int(sizes.max()))  # to the end: Kasai's rule needs a full order
    new = common_prefixes(text, begins, sizes, ends, order, length)[order] < length
    where = absolute[owner] + (0 if across else np.arange(len(text)) - begins[owner])
    several = _several(order, np.flatnonzero(new), where, many[owner])[np.cumsum(new) - 1]
    room = ends[order] - order >= length
    return text, begins, owner, order[room], new[room], several[room]


def sorted_spans(regions: list[bytes], absolute: np.ndarray, many: np.ndarray, length: int, across: bool = False) -> list[list[tuple[int, int]]]:
    """For each region, the bytes in strings of `length` that start at a second place (`across`: in a
    second document). `absolute` numbers the place where each region starts (`across`: its document)."""
    text, begins, _, at, _, several = _sorted_strings(regions, absolute, many, length, across)
    at = at[several]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    inside = np.cumsum(change[:-1]) > 0
    out: list[list[tuple[int, int]]] = []
    for b, z in zip(begins.tolist(), [len(r) for r in regions], strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, inside[b : b + z], False].astype(np.int8)))
        out.append([(int(x), int(y)) for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return out


def offered(regions: list[bytes], absolute: np.ndarray, many: np.ndarray, length: int, across: bool, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """The strings of `length` bytes with a rolling hash among `wanted`, in suffix order: hash, region,
    place in it, and whether they are known to be repeated (one stands for all of those)."""
    text, begins, owner, at, new, several = _sorted_strings(regions, absolute, many, length, across)
    known = several | many[owner[at]]
    h = Rolling(text)(at, at + length)
    pick = np.isin(h, wanted) & (new | ~known)
    return h[pick], owner[at[pick]], at[pick] - begins[owner[at[pick]]], known[pick]


Run = tuple[np.ndarray, np.ndarray, np.ndarray]  # different strings in order, the least and the greatest place of each


def run_of(strings: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Run:
    """A run of strings in order, equal ones as one."""
    first = np.flatnonzero(np.r_[True, strings[1:] != strings[:-1]])
    return strings[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)


def merged_runs(runs: list[Run]) -> Run:
    """Runs merged two by two: strings of the one are searched in the other."""
    while len(runs) > 1:
        out = [] if len(runs) % 2 == 0 else [runs.pop()]
        for (big, lo, hi), (small, least, most) in zip(runs[::2], runs[1::2], strict=True):
            at = np.searchsorted(big, small)
            new = big[np.minimum(at, len(big) - 1)] != small
            lo[at[~new]] = np.minimum(lo[at[~new]], least[~new])
            hi[at[~new]] = np.maximum(hi[at[~new]], most[~new])
            out.append((np.insert(big, at[new], small[new]), np.insert(lo, at[new], least[new]), np.insert(hi, at[new], most[new])))
        runs = out
    return runs[0]


def repeated_spans(regions: list[bytes], absolute: list[tuple[int, int]], many: list[bool], length: int = LENGTH, across: bool = False) -> list[list[tuple[int, int]]]:
    """The same, for regions most of which have nothing repeated: those, and ends that cannot be, are
    dropped before the rest is sorted, and equal pieces are sorted once.

    `absolute`: the document and the place where each region starts; regions of one document may
    overlap. `many`: whether the region is known to occur at several places (`across`: documents).
    """
    sizes = np.array([len(r) for r in regions], np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in regions]
    if not len(sizes) or sizes.max() < length:
        return out
    begins, valid = _starts(sizes), np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(sizes)), valid)
    at = np.arange(len(owner)) - _starts(valid)[owner]  # where in its region a string of `length` can start
    keys, k = [], 0
    while k < len(sizes):  # in blocks of regions
        m = max(k + 1, int(np.searchsorted(begins, begins[k] + BUFFER)))
        rows = slice(int(valid[:k].sum()), int(valid[:m].sum()))
        start = begins[owner[rows]] - begins[k] + at[rows]
        keys.append(Rolling(np.frombuffer(b"".join(regions[k:m]), np.uint8))(start, start + length))
        k = m
    key = np.concatenate(keys)
    spot = np.array([(a << 40) + (0 if across else b) for a, b in absolute], np.int64)
    flags = np.array(many, bool)
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    good = np.repeat(_several(order, first, spot[owner] + (0 if across else at), flags[owner]), np.diff(np.r_[first, len(order)]))
    hit = np.sort(order[good])
    if not len(hit):
        return out
    mine, begin = np.unique(owner[hit], return_index=True)
    lo, hi = at[hit[begin]], at[hit[np.r_[begin[1:], len(hit)] - 1]] + length
    pieces: dict[bytes, list] = {}  # content -> its place, whether it has several, the regions that hold it
    for r, x, y in zip(mine.tolist(), lo.tolist(), hi.tolist(), strict=True):
        place = int(spot[r]) + (0 if across else x)
        got = pieces.setdefault(regions[r][x:y], [place, bool(many[r]), []])
        got[1] |= place != got[0] or bool(many[r])
        got[2].append((r, x))
    if all(g[1] for g in pieces.values()):
        found = [[(0, len(p))] for p in pieces]
    else:
        found = sorted_spans(list(pieces), np.array([g[0] for g in pieces.values()], np.int64), np.array([g[1] for g in pieces.values()]), length, across)
    for (content, (_, several, held)), spans in zip(pieces.items(), found, strict=True):
        for r, x in held:
            out[r] = [(x, x + len(content))] if several else [(x + a, x + b) for a, b in spans]
    return out


def _text(t) -> bytes:
    return t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""


def occurrences(keyed: DataFrame, across: dict[int, bool]) -> DataFrame:
    """Anchors of every text, for each length n: _i, _h, n, fp, d and d2 (hashes of anchor and region), a
    and e (the region), times (across documents: 1 for the first of a text's equal regions, else 0);
    with null fp, spans [a, e) found repeated within the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids, hashes = [_text(t) for t in b["text"]], b["_i"].to_numpy(), b["_h"].to_numpy()
            for n in across:
                text, _, fp, a, e, d, d2 = anchors(texts, n)
                if not len(text):
                    continue
                o = np.lexsort((a, d2, d, fp, text))
                text, fp, a, e, d, d2 = text[o], fp[o], a[o], e[o], d[o], d2[o]
                first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (fp[1:] != fp[:-1]) | (d[1:] != d[:-1]) | (d2[1:] != d2[:-1])])
                times = np.diff(np.r_[first, len(text)])
                if across[n]:
                    times = np.bincount(first, minlength=len(text))
                    first = np.arange(len(text))
                # else a region that comes again within its text is repeated there; one row stands for it
                again = np.flatnonzero(np.repeat(times > 1, times))  # none across documents
                yield pd.DataFrame({"_i": ids[text[first]], "_h": hashes[text[first]], "n": n, "fp": fp[first].view(np.int64), "d": d[first].view(np.int64), "d2": d2[first].view(np.int64), "a": a[first], "e": e[first], "times": times})
                own = []
                for k in np.unique(text[again]):
                    mine = again[text[again] == k]
                    own += [(ids[k], hashes[k], n, x, y) for x, y in merged(list(zip(a[mine].tolist(), e[mine].tolist(), strict=True)))]
                if own:
                    o = pd.DataFrame(own, columns=["_i", "_h", "n", "a", "e"])
                    none = pd.array([None] * len(o), "Int64")
                    yield o.assign(fp=none, d=none, d2=none, times=0)[["_i", "_h", "n", "fp", "d", "d2", "a", "e", "times"]]

    return mapped(keyed, run, "_i long, _h long, n int, fp long, d long, d2 long, a int, e int, times int")


def _regions(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the regions that `wanted` (_i, _h, KEY, a, e, many, part, parts) names."""
    names = [*KEY, "a", "e", "many", "part", "parts"]
    per = wanted.groupBy("_i", "_h").agg(F.collect_list(F.struct(*names)).alias("w"))
    joined = keyed.join(per, ["_i", "_h"]).dropDuplicates(["_i", "_h"]).select("_i", "_h", "text", *[F.col(f"w.{c}").alias(c) for c in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["i", "h", *KEY, "many", "part", "parts", "start", "bytes"]
        for b in batches:
            rows: list[tuple] = []
            for i, h, t, *cols in b.itertuples(index=False, name=None):
                data = _text(t)
                rows += [(i, h, *key, many, part, parts, a, data[a:e]) for *key, a, e, many, part, parts in zip(*cols, strict=True)]
                if len(rows) > 5_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return mapped(joined, run, "i long, h long, n int, fp long, d long, d2 long, many boolean, part long, parts long, start int, bytes binary")


SPANS = "n int, fp long, d long, d2 long, x int, y int"
PART = ["n", "fp", "part"]


def _sorted_spans(regions: DataFrame, shards: int, across: dict[int, bool]) -> DataFrame:
    """Spans of regions, relative to their starts, by suffix arrays of shards."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        docs, n = pd.MultiIndex.from_frame(b[["i", "h"]]).factorize()[0], int(b["n"].iloc[0])
        found = repeated_spans(list(b["bytes"]), list(zip(docs.tolist(), b["start"].tolist(), strict=True)), list(b["many"]), n, across[n])
        rows = [(n, fp, d, d2, x, y) for fp, d, d2, spans in zip(b["fp"], b["d"], b["d2"], found, strict=True) for x, y in spans]
        return pd.DataFrame(rows, columns=[*KEY, "x", "y"])

    shard = F.pmod(F.xxhash64("fp", "part"), F.lit(shards))
    return regions.withColumn("shard", shard).groupBy("n", "shard").applyInPandas(lambda b: run(b), SPANS)


def _merged_spans(regions: DataFrame, across: dict[int, bool]) -> DataFrame:
    """Spans of regions whose anchors are dealt over several shards: what stands in several of them."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            per = [np.unique(Rolling(np.frombuffer(r, np.uint8)).every(n)) for r, n in zip(b["bytes"], b["n"], strict=True)]
            if per:
                yield b[PART].loc[b.index.repeat([len(p) for p in per])].assign(s=np.concatenate(per).view(np.int64))

    def offer(b: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        columns = [*KEY, "part", "s", "rank", "string", "place", "x"]
        if not len(b) or not len(met):
            return pd.DataFrame(columns=columns)
        docs, n = pd.MultiIndex.from_frame(b[["i", "h"]]).factorize()[0], int(b["n"].iloc[0])
        absolute = (docs.astype(np.int64) << 40) + (0 if across[n] else b["start"].to_numpy(np.int64))
        held = b["bytes"].tolist()
        s, r, x, known = offered(held, absolute, b["many"].to_numpy(bool), n, across[n], met["s"].to_numpy(np.int64).view(np.uint64))
        out = b[[*KEY, "part"]].iloc[r].reset_index(drop=True)
        i, h, start = (b[c].to_numpy()[r] for c in ("i", "h", "start"))
        place = [None if k else f"{p}:{q}" + ("" if across[n] else f":{z}") for k, p, q, z in zip(known, i, h, start + x, strict=True)]
        out = out.assign(s=s.view(np.int64), rank=np.arange(len(s)), string=[held[j][y : y + n] for j, y in zip(r, x, strict=True)], place=place, x=x)
        return out[columns]

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        n = int(b["n"].iloc[0])
        b = b.sort_values(["fp", "part", "rank"], kind="stable").reset_index(drop=True)
        place = b["place"].factorize()[0].astype(np.int64)  # -1: known to be repeated
        lo, hi = place, np.where(place < 0, len(b), place)
        strings = np.array(b["string"].tolist(), f"S{n}")
        runs = [run_of(strings[at], lo[at], hi[at]) for at in b.groupby(["fp", "part"]).indices.values()]
        every, least, most = merged_runs(runs)
        twice = (least != most)[np.searchsorted(every, strings)] & (place >= 0)
        return b.loc[twice, [*KEY, "x"]].assign(y=lambda d: d["x"] + n)

    split = regions.where("parts > 1")
    strings = materialize(mapped(split, hashes, "n int, fp long, part long, s long").distinct())
    several = strings.groupBy("n", "fp", "s").agg((F.min("part") < F.max("part")).alias("met")).where("met").select("n", "fp", "s")
    met = strings.join(several, ["n", "fp", "s"]).groupBy(*PART)
    offers = materialize(split.groupBy(*PART).cogroup(met).applyInPandas(lambda b, met: offer(b, met), "n int, fp long, d long, d2 long, part long, s long, rank long, string binary, place string, x int"))
    buckets = offers.count() // BUCKET + 1
    return offers.groupBy("n", F.pmod("s", F.lit(buckets)).alias("bucket")).applyInPandas(lambda b: merge(b), SPANS)


def spans(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """_i, _h (document key), cut, seen: [start, end) of the bytes repeated in strings of `length`, and in
    those of `passage` in other documents; in order, not merged."""
    across = {length: False} | ({passage: True} if passage else {})
    i, h = key_columns()
    keyed = docs.select(i.alias("_i"), h.alias("_h"), F.col("text").cast("string").alias("text"))
    found = materialize(occurrences(keyed, across))
    # what is met once is repeated nowhere: most anchors go here, by small rows
    often = materialize(found.where("fp is not null").groupBy("n", "fp").agg(F.sum("times").alias("times")).where("times > 1").select("n", "fp"))
    occ = materialize(found.join(often, ["n", "fp"]))
    groups = materialize(occ.groupBy(*KEY).agg((F.sum("times") > 1).alias("many"), F.min(F.struct("_i", "_h", "a", "e")).alias("rep")))
    # a region alone with its anchor is met nowhere else in part
    crowds = groups.groupBy("n", "fp").agg(F.count("*").alias("m")).where("m > 1").select("n", "fp", F.ceil(F.col("m") / REGIONS).alias("parts"))
    part = F.pmod(F.xxhash64("d", "d2"), F.col("parts"))
    wanted = groups.join(crowds, ["n", "fp"]).select("rep._i", "rep._h", *KEY, "rep.a", "rep.e", "many", part.alias("part"), "parts")
    regions = materialize(_regions(keyed, wanted))
    shards = max(1, int((regions.agg(F.sum(F.octet_length("bytes"))).head()[0] or 0) // SHARD_BYTES // len(across)) + 1)
    some = _sorted_spans(regions, shards, across).unionByName(_merged_spans(regions, across))
    # what is known of a region holds wherever it occurs; regions that occur twice are covered whole
    whole = groups.where("many").select(*KEY, F.lit(None).cast("array<struct<x:int,y:int>>").alias("cover"))
    facts = some.groupBy(*KEY).agg(F.collect_list(F.struct("x", "y")).alias("cover")).join(whole.select(*KEY), KEY, "left_anti")
    covers = materialize(facts.unionByName(whole))
    cut = F.when(F.col("cover").isNull(), F.array(F.struct("a", "e"))).otherwise(F.transform("cover", lambda c: F.struct((F.col("a") + c["x"]).alias("a"), (F.col("a") + c["y"]).alias("e"))))
    placed = occ.select("_i", "_h", *KEY, "a", "e").join(covers, KEY).select("_i", "_h", "n", cut.alias("cut"))
    own = found.where("fp is null").select("_i", "_h", "n", F.array(F.struct("a", "e")).alias("cut"))
    of = lambda n: F.sort_array(F.flatten(F.collect_list(F.when(F.col("n") == (n or -1), F.col("cut")))))
    return placed.unionByName(own).groupBy("_i", "_h").agg(of(length).alias("cut"), of(passage).alias("seen"))


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words of a text that lie in [start, end) whole."""
    part = data[start:end].split()
    if part and start and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace():
        part = part[1:]
    if part and end < len(data) and not data[end - 1 : end].isspace() and not data[end : end + 1].isspace():
        part = part[:-1]
    return len(part)


def remove(docs: DataFrame, length: int = LENGTH, passage: int | None = PASSAGE, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), removed (spans), passages
    (spans) and passage_words (the words in them) per row."""
    i, h = key_columns()
    cut = spans(docs, length, passage)
    cut = cut.select("_i", "_h", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("cut", "seen") for x in ("a", "e")])
    had = docs.select(i.alias("_i"), h.alias("_h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(cut, ["_i", "_h"], "left").drop("_i", "_h")

    def of_text(a, e, size: int) -> list[tuple[int, int]]:
        return merged([(max(0, int(x)), min(size, int(y))) for x, y in zip(a, e, strict=True)]) if a is not None else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, *found in b.itertuples(index=False, name=None):
                data = _text(t)
                gone, seen = of_text(*found[:2], len(data)), of_text(*found[2:], len(data))
                kept, at = [], 0
                for x, y in gone:
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                seen = [(x, y, n) for x, y in seen if (n := whole_words(data, x, y)) > words]
                rows.append((i, len(data), sum(y - x for x, y in gone), len(gone), b"".join(kept), [x for s in gone for x in s], [x for s in seen for x in s[:2]], sum(n for _, _, n in seen)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed", "passages", "passage_words"]).astype({"doc_id": "Int64"})

    return mapped(had, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<long>, passages array<long>, passage_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("passage_words").alias("n_passage_words"))
