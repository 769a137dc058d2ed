"""Removal of repeated byte strings with suffix arrays.

Which strings of ``length`` bytes also start in a document with a smaller id?

1. Anchors. Every such string holds one anchor: the least of its k-byte strings
   by hash. An anchor that stands in one text only cannot be part of a match;
   this exact filter leaves the stretches of text that can match at all.
2. Shards. An anchor with the bytes of all strings that it stands for is a
   context. Contexts of equal anchors meet in one shard (a very frequent anchor
   is dealt over several), where equal contexts become one.
3. Suffix arrays. A shard sorts its suffixes by Larsson-Sadakane refinement:
   groups that are sorted by h bytes are refined by the ranks h bytes further
   on, until all contexts are sorted to their ends. Kasai's common prefixes, all
   contexts in step, give the groups of equal strings and their smallest id.
4. Merging. Strings of anchors that were dealt over several shards come as one
   sorted run from each shard; runs are merged by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bucket, give_back, id_and_text, parts, shown_id, stored, text_bytes
from tallyloom.llm.words import batches_of, mix

LENGTH = 50
BATCH_BYTES = 1 << 19
CHUNK_BYTES = 4 << 20
#: Anchors of one task of the filter, bytes of contexts of one shard, and contexts of one anchor in one shard.
RANGE_ANCHORS = 600_000
SHARD_BYTES = 3 << 19
HOT_ANCHOR = 50_000
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(31).integers(1, 2**63, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


# --- anchors ----------------------------------------------------------------------


def window_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place that has as many, read eight at a time."""
    n = len(buf) - k + 1
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    if k < 8:
        return mix(eight[:n] & np.uint64((1 << 8 * k) - 1))
    places = [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]
    with np.errstate(over="ignore"):
        total = eight[:n] * _ODD[0]
        for i, at in enumerate(places[1:], 1):
            total ^= total >> np.uint64(32)
            total += eight[at : at + n] * _ODD[i % len(_ODD)]
        total ^= total >> np.uint64(32)
        total *= _ODD[-1]
        total ^= total >> np.uint64(29)
    return total


def anchors(raw: list[bytes], length: int) -> pd.DataFrame:
    """(text, q, lo, hi, h): places of each text's anchors, the first and last start of the strings each stands for, and its hash.

    Long texts go in overlapping pieces, each string in one of them.
    """
    if all(len(x) <= 2 * BATCH_BYTES for x in raw):
        return _anchors(raw, length)
    found = []
    for n, x in enumerate(raw):
        for at in range(0, max(1, len(x) - length + 1), BATCH_BYTES):
            a = _anchors([x[at : at + BATCH_BYTES + length - 1]], length)
            found.append(a.assign(text=n, q=a["q"] + at, lo=a["lo"] + at, hi=a["hi"] + at))
    return pd.concat(found, ignore_index=True)


def _anchors(raw: list[bytes], length: int) -> pd.DataFrame:
    k = length // 2 - 1
    buf = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    at = np.cumsum(size) - size
    n = len(buf) - length + 1
    if n <= 0:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "q", "lo", "hi")} | {"h": np.zeros(0, np.uint64)})
    h = window_hashes(buf, k)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # least hash, then leftmost
    width, done = length - k + 1, 1
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    q = (m[:n] & _PLACE).astype(np.int64)
    inside = np.ones(n, bool)  # strings do not cross texts
    for end in (at + size)[:-1]:
        inside[max(0, end - length + 1) : end] = False
    p = np.flatnonzero(inside)
    if not len(p):
        return _anchors([], length)
    a = q[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a = a[first]
    text = np.searchsorted(at, a, side="right") - 1
    # empty texts share their start with the next text; searchsorted takes the last of them
    base = at[text]
    return pd.DataFrame({"text": text, "q": a - base, "lo": p[first] - base, "hi": p[last] - base, "h": h[a]})


def _text_hash(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, raw)), ">i8").astype("<i8")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of small numbers in planes, which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def range_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """The range of each anchor. Anchors are least hashes, so they are mixed again to fill all ranges alike."""
    return ((mix(h >> np.uint64(16)) >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def anchor_runs(texts: DataFrame, length: int, n_ranges: int) -> DataFrame:
    """Anchors of each batch of texts by range of hashes, packed: documents, anchors of each, hashes and places."""

    def per_batch(batches):
        for b in batches:
            b = b.sort_values("key").drop_duplicates("text")  # equal texts: the smallest id speaks for all
            for part in batches_of(b, limit=BATCH_BYTES // 2):
                raw = [t.encode() for t in part["text"]]
                for group in _groups(raw):
                    own = [raw[i] for i in group]
                    a = anchors(own, length)
                    if not len(a):
                        continue
                    key, ids = part["key"].to_numpy()[group], _text_hash(own)
                    where = range_of(a["h"].to_numpy(), n_ranges)
                    out = []
                    for r, x in a.groupby(where):
                        count = np.bincount(x["text"], minlength=len(own))
                        some = np.flatnonzero(count)
                        step = np.diff(x["q"].to_numpy(), prepend=0)
                        step[np.cumsum(count[some])[:-1]] = x["q"].to_numpy()[np.cumsum(count[some])[:-1]]
                        six = np.ascontiguousarray(x["h"].to_numpy().astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
                        out.append((r, key[some].astype("<i8").tobytes(), ids[some].tobytes(), _planes(count[some]), six.tobytes(), _planes(step)))
                    yield pd.DataFrame(out, columns=["part", "keys", "ids", "counts", "hashes", "steps"])
            del b
            give_back()

    return texts.mapInPandas(per_batch, "part int, keys binary, ids binary, counts binary, hashes binary, steps binary")


def _groups(raw: list[bytes]):
    """Numbers of texts in groups that fit the place bits; longer texts are in a group alone."""
    group, size = [], 0
    for i, x in enumerate(raw):
        if group and size + len(x) > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(x)
    if group:
        yield group


def shared_anchors(runs: DataFrame, hot: int) -> DataFrame:
    """(key, id, places, deals): per document, the anchors that stand in several texts.

    Only the smallest id of equal texts is listed. ``deals`` says over how many
    shards an anchor's contexts are dealt, in parts of at most ``hot``.
    """

    def one_range(g: pd.DataFrame) -> pd.DataFrame:
        give_back()
        g = g.sort_values("keys", kind="stable")
        count = np.concatenate([_from_planes(x) for x in g["counts"]])
        key, ids = (np.concatenate([np.frombuffer(x, "<i8") for x in g[c]]) for c in ("keys", "ids"))
        step = np.concatenate([_from_planes(x) for x in g["steps"]])
        six = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 6) for x in g["hashes"]])
        h = np.zeros((len(six), 8), np.uint8)
        h[:, 2:] = six
        h = h.view("<u8").ravel()
        doc = np.repeat(np.arange(len(key)), count)
        total = np.cumsum(step)
        head = np.cumsum(count) - count
        place = total - np.repeat(total[head] - step[head], count)
        order = np.lexsort((key, ids))  # equal texts: the smallest id, once
        same = np.zeros(len(key), bool)
        same[order[1:]] = ids[order[1:]] == ids[order[:-1]]
        mine = ~same[doc]
        h, doc, place = h[mine], doc[mine], place[mine]
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        start = np.flatnonzero(new)
        d = doc[order]
        several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        number = np.diff(np.append(start, len(h)))
        deals = np.zeros(len(h), np.int64)
        deals[order] = np.repeat(np.where(several, -(-number // hot), 0), number)
        del order, new, d, step, total, six
        keep = deals > 0
        doc, place, deals = doc[keep], place[keep], deals[keep]
        some, first = np.unique(doc, return_index=True)
        return pd.DataFrame({
            "key": key[some], "id": ids[some], "places": [x.astype("<u4").tobytes() for x in np.split(place, first[1:])][: len(some)],
            "deals": [x.astype("<u4").tobytes() for x in np.split(deals, first[1:])][: len(some)],
        })

    return runs.groupBy("part").applyInPandas(one_range, "key long, id long, places binary, deals binary")


# --- contexts ---------------------------------------------------------------------


def numbered(d: pd.DataFrame) -> tuple[list[bytes], np.ndarray, list[int]]:
    """Texts of a chunk as bytes, each row's number among its distinct (id, text), and a row of each number.

    Numbers follow the order of id and text hash, so every task that sees the chunk counts alike.
    """
    raw = [t.encode() for t in d["text"]]
    marks = pd.DataFrame({"key": d["key"].to_numpy(), "id": _text_hash(raw), "row": np.arange(len(raw))})
    number = marks.groupby(["key", "id"], sort=True).ngroup().to_numpy()
    rows = np.empty(number.max() + 1 if len(number) else 0, np.int64)
    rows[number[::-1]] = np.arange(len(raw))[::-1]
    return raw, number, rows.tolist()


def contexts(texts: DataFrame, flags: DataFrame, length: int, n_shards: int) -> DataFrame:
    """Contexts of shared anchors, packed by shard and chunk: bytes, sizes, ids, numbers of the texts, first starts."""

    def per_chunk(d: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "chunk", "bytes", "sizes", "keys", "numbers", "lo", "dealt"]
        give_back()
        if d.empty or f.empty:
            return pd.DataFrame(columns=columns)
        raw, number, rows = numbered(d)
        ids = _text_hash(raw)
        number_of = {(k, i): n for k, i, n in zip(d["key"].tolist(), ids.tolist(), number.tolist())}
        n_of = np.array([number_of[x] for x in zip(f["key"].tolist(), f["id"].tolist())], np.int64)
        places = [np.frombuffer(x, "<u4") for x in f["places"]]
        place = np.concatenate(places).astype(np.int64) | (np.repeat(n_of, [len(x) for x in places]) << 40)
        deals = np.concatenate([np.frombuffer(x, "<u4") for x in f["deals"]])
        order = np.argsort(place)
        place, deals = place[order], deals[order].astype(np.uint64)
        flagged, out = np.unique(n_of), []
        for group in _groups([raw[rows[n]] for n in flagged]):
            own = flagged[group]
            a = anchors([raw[rows[n]] for n in own], length)
            n, q = own[a["text"]], a["q"].to_numpy()
            at = np.minimum(np.searchsorted(place, q | (n << 40)), len(place) - 1)
            hit = place[at] == (q | (n << 40))
            n, dealt, lo, hi = n[hit], deals[at[hit]], a["lo"].to_numpy()[hit], a["hi"].to_numpy()[hit]
            key = d["key"].to_numpy()[np.array(rows)[n]]
            turn = mix(key.view(np.uint64) + np.uint64(1)) % dealt
            with np.errstate(over="ignore"):
                shard = mix((a["h"].to_numpy()[hit] >> np.uint64(16)) + turn * np.uint64(_BASE)) % np.uint64(n_shards)
            order = np.argsort(shard, kind="stable")
            pieces = [raw[rows[i]][x:y] for i, x, y in zip(n[order].tolist(), lo[order].tolist(), (hi[order] + length).tolist())]
            cut = np.flatnonzero(np.diff(shard[order].astype(np.int64), prepend=-1))
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
                o = order[x:y]
                out.append((
                    int(shard[o[0]]), int(d["chunk"].iloc[0]), b"".join(pieces[x:y]), _planes(hi[o] + length - lo[o]),
                    key[o].astype("<i8").tobytes(), _planes(n[o]), _planes(lo[o]), (dealt[o] > 1).tobytes(),
                ))
        return pd.DataFrame(out, columns=columns)

    return texts.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(
        per_chunk, "shard int, chunk int, bytes binary, sizes binary, keys binary, numbers binary, lo binary, dealt binary"
    )


# --- suffix arrays ----------------------------------------------------------------


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places in the order of (first, second), equal ones as they came: one sort of packed values where 64 bits hold them."""
    n = len(first)
    low, mid = (n - 1).bit_length(), int(second.max()).bit_length()
    if int(first.max()).bit_length() + mid + low > 64:
        return np.lexsort((second, first))
    packed = ((first.astype(np.uint64) << np.uint64(mid)) | second.astype(np.uint64)) << np.uint64(low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << low) - 1)).astype(np.int64)


def suffix_array(text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and their ranks.

    ``stop`` is the place where each place's segment ends, with the value 0
    there; suffixes end with their segment, equal ones stay in text order. The
    rank of a suffix is the place of its group's last member, as in Larsson and
    Sadakane's refinement; suffixes alone in their group are done.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, place = 7, np.arange(n)  # seven values of nine bits
    packed = np.append(text, np.zeros(h, text.dtype)).astype(np.uint64)
    first = packed[:n].copy()
    for i in range(1, h):
        first <<= np.uint64(9)
        first |= packed[i : i + n]
    masks = np.array([((1 << 9 * r) - 1) << 9 * (h - r) for r in range(h + 1)], np.uint64)
    first &= masks[np.minimum(stop - place, h)]  # nothing beyond the segment
    longest = int((stop - place).max())
    sa = np.argsort(first)
    first = first[sa]
    new = np.append(True, first[1:] != first[:-1])
    sa = sa[_order(np.cumsum(new), sa)]  # equal ones in text order
    last = np.flatnonzero(np.append(new[1:], True))
    size = np.diff(np.append(-1, last))
    stop = stop.astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = np.repeat(last, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places of unsorted groups
    while h < longest and len(open_):
        s = sa[open_]
        after = np.where(s + h < stop[s], rank[np.minimum(s + h, n - 1)] + 1, 0)
        own = rank[s]
        order = _order(own, after)
        s, after, own = s[order], after[order], own[order]
        sa[open_] = s
        last = np.flatnonzero(np.append((own[1:] != own[:-1]) | (after[1:] != after[:-1]), True))
        size = np.diff(np.append(-1, last))
        rank[s] = np.repeat(open_[last], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it, up to ``most``, all segments in step.

    Within a segment the prefix of the next suffix is at most one shorter.
    """
    n = len(text)
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    lcp = np.zeros(n, np.int64)
    sa = sa.astype(np.int32)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    known = np.zeros(len(starts), np.int64)
    padded = np.append(text, 0)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))  # segments longer than step
        i = starts[:live] + step
        at = place[i]
        j = sa[np.maximum(at - 1, 0)]
        h = np.maximum(known[:live] - 1, 0)
        go = np.flatnonzero((at > 0) & (h < most))
        while len(go):
            x, y = padded[np.minimum(i[go] + h[go], n)], padded[np.minimum(j[go] + h[go], n)]
            go = go[(x == y) & (x != 0)]
            h[go] += 1
            go = go[h[go] < most]
        h[at == 0] = 0
        known[:live] = h
        lcp[at] = h
    return lcp


def first_ids(owners: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of ``length`` bytes in ``raw``: (number of its bytes object, start, smallest owner of an equal string)."""
    sizes = np.array([len(x) for x in raw], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint16) + 1
    number = np.repeat(np.arange(len(raw)), sizes + 1)
    sa, _ = suffix_array(text, (starts + sizes)[number])
    lcp = common_prefixes(text, sa, starts, sizes, length)
    offset = np.arange(len(text)) - starts[number]
    group = np.cumsum(lcp < length) - 1
    whole = (offset + length <= sizes[number])[sa]
    s, group = sa[whole], group[whole]
    if not len(s):
        return s, s, s
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(owners[number[s]], head)
    least = np.repeat(least, np.diff(np.append(head, len(s))))
    return number[s], offset[s], least


def resolve_shard(g: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of starts that a smaller id in the shard also has, by chunk; then, of dealt anchors, the shard's first strings."""
    per_row = [_from_planes(x) for x in g["sizes"]]
    size = np.concatenate(per_row)
    chunk = np.repeat(g["chunk"].to_numpy(), [len(x) for x in per_row])
    key = np.concatenate([np.frombuffer(x, "<i8") for x in g["keys"]])
    number, lo = (np.concatenate([_from_planes(x) for x in g[c]]) for c in ("numbers", "lo"))
    dealt = np.concatenate([np.frombuffer(x, bool) for x in g["dealt"]])
    blob, end = b"".join(g["bytes"]), np.cumsum(size)
    which: dict[bytes, int] = {}
    same = np.array([which.setdefault(blob[a:b], len(which)) for a, b in zip((end - size).tolist(), end.tolist())])
    raw = list(which)  # equal contexts are one
    owner = np.full(len(raw), np.iinfo(np.int64).max)
    np.minimum.at(owner, same, key)
    n, o, least = first_ids(owner, raw, length)
    lost = least < owner[n]  # strings of the owner that a smaller id has; everyone else loses the whole context
    table = np.zeros((len(raw), int(size.max()) - length + 1), bool)
    table[n[lost], o[lost]] = True
    starts = size - length + 1
    mine = key == owner[same]
    row = np.repeat(np.arange(len(key)), starts)
    off = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    gone = np.where(mine[row], table[same[row], off], True)
    row, start = row[gone], (lo[row] + off)[gone]
    head = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(row)))
    out = []
    for c, i in pd.Series(np.arange(len(at))).groupby(chunk[row[at]]):
        i = i.to_numpy()
        out.append((c, _planes(number[row[at[i]]]), _planes(start[at[i]]), _planes(run[i]), None, None))
    open_ = np.zeros(len(raw), bool)
    open_[same[dealt]] = True
    firsts = [
        (int(chunk[x]), _planes(number[[x]]), _planes(lo[[x]] + a), _planes(np.ones(1)), raw[same[x]][a : a + length], int(key[x]))
        for x in np.flatnonzero(mine & open_[same]).tolist()
        for a in np.flatnonzero(~table[same[x], : starts[x]]).tolist()
    ]
    return pd.DataFrame(out + sorted(firsts, key=lambda f: f[4]), columns=["chunk", "numbers", "starts", "runs", "string", "key"]).astype({"key": "Int64"})


def merge_runs(strings: np.ndarray, keys: np.ndarray, more: np.ndarray, more_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct strings with their smallest keys as one, by binary search."""
    at = np.searchsorted(strings, more)
    found = (at < len(strings)) & (strings[np.minimum(at, len(strings) - 1)] == more) if len(strings) else np.zeros(len(more), bool)
    keys = keys.copy()
    np.minimum.at(keys, at[found], more_keys[found])
    return np.insert(strings, at[~found], more[~found]), np.insert(keys, at[~found], more_keys[~found])


def _merge_part(g: pd.DataFrame) -> pd.DataFrame:
    """Of equal strings from several shards, the rows whose id is not the smallest."""
    string = np.array([bytes(x) + b"\1" for x in g["string"]])  # numpy drops zeros at the end
    key = g["key"].to_numpy()
    all_strings, least = string[:0], key[:0]
    for _, rows in g.assign(at=np.arange(len(g))).groupby("shard"):
        run, inv = np.unique(string[rows["at"]], return_inverse=True)
        low = np.full(len(run), np.iinfo(np.int64).max)
        np.minimum.at(low, inv, key[rows["at"]])
        all_strings, least = merge_runs(all_strings, least, run, low)
    lost = least[np.searchsorted(all_strings, string)] < key
    return g.loc[lost, ["chunk", "numbers", "starts", "runs"]]


# --- operator ---------------------------------------------------------------------


def drop_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_ANCHOR,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Texts without the bytes that a string of ``length`` bytes covers which also starts in a smaller id.

    Returns one row per input row: (id_col, n_bytes, n_removed, removed: byte
    ranges of the input, kept: the remaining bytes). Strings are judged on the
    input. NULL texts are empty. Rows with the same id are one document and
    remove nothing from each other; a NULL id is the smallest. No rows in, none
    out. ``length`` has to be 8 or more.
    """
    if length < 8:
        raise ValueError("length has to be 8 or more")
    texts = id_and_text(docs, id_col, text_col)
    total = text_bytes(texts)
    chunked = texts.withColumn("chunk", bucket(parts(total, CHUNK_BYTES), "key"))
    chunk_of = bucket(parts(total, CHUNK_BYTES), "key")
    # two anchors in as many bytes as a string has anchor places, on average
    n_ranges = parts(total * 2 // (length - length // 2 + 2), RANGE_ANCHORS)
    flags = stored(shared_anchors(anchor_runs(texts, length, n_ranges), hot), "anchors")
    found = flags.agg(F.sum(F.octet_length("places") / 4)).first()[0] or 0
    n_shards = parts(int(found * 1.3 * length), shard_bytes)
    packed = contexts(chunked, flags.withColumn("chunk", chunk_of), length, n_shards)

    def per_shard(g: pd.DataFrame) -> pd.DataFrame:
        give_back(cycles=False)
        return resolve_shard(g, length).assign(shard=int(g["shard"].iloc[0]))

    schema = "chunk int, numbers binary, starts binary, runs binary"
    resolved = stored(packed.groupBy("shard").applyInPandas(per_shard, f"{schema}, string binary, key long, shard int"), "suffixes")
    open_ = resolved.filter("string is not null").withColumn("part", bucket(n_shards, "string"))
    gone = resolved.filter("string is null").select("chunk", "numbers", "starts", "runs")
    gone = gone.union(open_.groupBy("part").applyInPandas(_merge_part, schema))
    # equal texts: all but the smallest id lose every string
    ids = texts.select("key", F.md5(F.col("text").cast("binary")).alias("md5"))
    low = ids.groupBy("md5").agg(F.min("key").alias("low"))
    copies = ids.join(low, "md5").filter("key > low").select(chunk_of.alias("chunk"), "key", "md5").distinct()

    def cut(d: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        copy = {(k, m) for k, m in zip(g["key"], g["md5"]) if m is not None}
        n, start, run = (
            np.concatenate([np.zeros(0, np.int64), *(_from_planes(x) for x in g[c] if x is not None)]) for c in ("numbers", "starts", "runs")
        )
        order = np.lexsort((start, n))
        n, start, run = n[order], start[order], run[order]
        raw_all, number, _ = numbered(d)
        out = []
        for key, raw, mine in zip(d["key"].tolist(), raw_all, number.tolist()):
            size = len(raw)
            if size >= length and (key, hashlib.md5(raw).hexdigest()) in copy:
                out.append((key, size, size, [{"start": 0, "end": size}], b""))
                continue
            a, b = np.searchsorted(n, [mine, mine + 1])
            if a == b:
                out.append((key, size, 0, [], raw))
                continue
            lo, hi = start[a:b], np.maximum.accumulate(start[a:b] + run[a:b] - 1 + length)
            head = np.append(True, lo[1:] > hi[:-1])
            lo, hi = lo[head], hi[np.append(head[1:], True)]
            kept, place = [], 0
            for x, y in zip(lo.tolist(), hi.tolist()):
                kept.append(raw[place:x])
                place = y
            edges = [{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist())]
            out.append((key, size, int((hi - lo).sum()), edges, b"".join([*kept, raw[place:]])))
        return pd.DataFrame(out, columns=["key", "n_bytes", "n_removed", "removed", "kept"])

    result = chunked.groupBy("chunk").cogroup(gone.unionByName(copies, allowMissingColumns=True).groupBy("chunk")).applyInPandas(
        cut, "key long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
    )
    return result.withColumn("key", shown_id()).withColumnRenamed("key", id_col)
