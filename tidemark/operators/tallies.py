"""Hits of a catalog of any size, summed per article and owner without a row per place and owner.

A key is a pattern's text (in lower case unless its case counts). Texts are cut and hashed as arrays of bytes; equal hashes are only a hint, the characters decide.

* The owners of the keys that most owners have are broadcast as bitmaps of bounded size, and their counts are added up where the article is.
* Of the other places only those travel whose key a broadcast filter may know. They meet the catalog in the bucket of their key, and the owners found go to the block of the article.

What travels are compressed columns, a row for many places; both exchanges follow the size of the texts, whatever the number of owners of a key.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage, ship_package, spread

#: Owners that have a bit, bytes of bitmaps and of filters that are broadcast, and tokens of the longest pattern that is looked up.
OWNERS, BITMAP_BYTES, FILTER_BYTES, LONGEST = 2048, 32 << 20, 24 << 20, 4
#: Bytes of text that are cut at a time, rows gathered before they are packed, bytes of input a bucket.
SLICE, HELD, BUCKET_BYTES = 1 << 20, 250_000, 4_000_000

_CATALOG, _OTHER, _HITS, _SUMS = range(4)
_ROWS = "dest int, kind int, blob binary"
_COUNTS, _SERIES, _TEXT, _LIST = ("n", "in_title", "in_body"), ("steps", "titles", "bodies"), ":text", ":list"

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A byte's bits as the eight bytes of a number: up to 255 of these add up without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_BASE = 0x9E3779B97F4A7C15
_ADDED = 1024  # bitmaps that are added up at a time stay in the processor's cache
_cache: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    if len(_cache.get("powers", ((),))[0]) < n:
        _cache["powers"] = tuple(np.full(max(n, SLICE + 1), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64)))
        for powers in _cache["powers"]:
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
    return _cache["powers"]


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _powers(len(data))[0][:len(data)], out=out[1:])
    return out


def _digests(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of data[start:end] each."""
    h = (sums[ends] - sums[starts]) * _powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(k)
    return h ^ (h >> np.uint64(33))


class Texts:
    """Strings as one run of bytes, with the runs of ASCII letters and digits in them."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        held = column.buffers()[2]
        self.data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held and len(column) else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def digests(self, lower: bool = False) -> np.ndarray:
        return _digests(_sums(_LOWER[self.data] if lower else self.data), self.offsets[:-1], self.offsets[1:])

    def cut(self) -> Texts:
        word = _TOKEN[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = self.offsets[self.offsets < len(self.data)]  # strings stand side by side
        first[edges] = word[edges]
        before = self.offsets[self.offsets > 0] - 1
        last[before] = word[before]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.rows = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        return self

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the runs of n tokens with what stands between them."""
        k = max(0, len(self.starts) - n + 1)
        same = self.rows[:k] == self.rows[n - 1:]
        return self.starts[:k][same], self.ends[n - 1:][same], self.rows[:k][same]

    def plain(self) -> np.ndarray:
        """Which strings begin and end with a token, have at most LONGEST of them, and hold their last token once: their places can't overlap."""
        count, some = np.diff(self.first), np.flatnonzero(np.diff(self.first))
        out = np.zeros(len(count), bool)
        out[some] = (self.starts[self.first[some]] == self.offsets[some]) & (self.ends[self.first[some + 1] - 1] == self.offsets[some + 1]) & (count[some] <= LONGEST)
        tokens = _digests(_sums(_LOWER[self.data]), self.starts, self.ends)
        for back in range(1, LONGEST):
            far = np.flatnonzero(out & (count > back))
            out[far] = tokens[self.first[far + 1] - 1] != tokens[self.first[far + 1] - 1 - back]
        return out


def _pieces(column: pa.Array, rows: int = 1 << 16) -> list[pa.Array]:
    return [column.slice(at, rows) for at in range(0, len(column), rows)]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    long = ends - starts
    offsets = np.concatenate([[0], np.cumsum(long)])
    values = data[np.repeat(starts - offsets[:-1], long) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(long), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)).cast(pa.string())


def _pack(table: pa.Table) -> bytes:
    """Compressed columns: strings as their lengths and characters, owners by number, counts in a byte where they fit."""
    fields, columns, texts = [], [], []
    for name, column in zip(table.column_names, table.columns):
        column = column.combine_chunks()
        if name == "owner":
            column = column.dictionary_encode()
            column = pa.DictionaryArray.from_arrays(column.indices.cast(pa.int16()), column.dictionary) if len(column.dictionary) < 1 << 15 else column
        elif pa.types.is_string(column.type) and not column.null_count:
            text = Texts(column)
            texts.append(text.data)
            name, column = name + _TEXT, _narrow(np.diff(text.offsets))
        elif name in _SERIES:
            texts.append(np.asarray(column.flatten()).astype("<i4").view(np.uint8).reshape(-1, 4).T.ravel())  # high bytes are alike
            name, column = name + _LIST, _narrow(pc.list_value_length(column))
        elif name in _COUNTS:
            column = _narrow(column)
        fields.append(name)
        columns.append(column)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, (batch := pa.RecordBatch.from_arrays(columns, names=fields)).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    head, tails = sink.getvalue().to_pybytes(), [pa.compress(pa.py_buffer(np.ascontiguousarray(t)), codec="zstd", asbytes=True) for t in texts]
    return b"".join([len(head).to_bytes(8, "little"), head, *(x for t in tails for x in (len(t).to_bytes(8, "little"), t))])


def _unpack(blob: bytes) -> pa.Table:
    def piece():
        nonlocal at
        at += 8 + (size := int.from_bytes(blob[at:at + 8], "little"))
        return blob[at - size:at]

    at = 0
    table = pa.ipc.open_stream(piece()).read_all()
    for i, name in enumerate(table.column_names):
        column = (table.column(i).chunks or [pa.array([], table.schema.field(i).type)])[0]
        if name.endswith(_TEXT):
            offsets = np.concatenate([[0], np.cumsum(column.to_numpy(), dtype=np.int64)])
            column = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.decompress(piece(), int(offsets[-1]), codec="zstd")).cast(pa.string())
        elif pa.types.is_dictionary(column.type):
            column = column.cast(column.type.value_type)
        elif name.endswith(_LIST):
            offsets = np.concatenate([[0], np.cumsum(column.to_numpy(), dtype=np.int32)])
            planes = np.frombuffer(pa.decompress(piece(), int(offsets[-1]) * 4, codec="zstd"), np.uint8).reshape(4, -1)
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(planes.T).view("<i4").ravel()))
        elif name in _COUNTS:
            column = column.cast(pa.int32())
        table = table.set_column(i, name.removesuffix(_TEXT).removesuffix(_LIST), column)
    return table


def _narrow(counts) -> pa.Array:
    counts = np.asarray(counts)
    return pa.array(counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32))


def _out(rows: list[tuple[int, int, bytes]]):
    if rows:
        dest, kind, blob = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["dest", "kind", "blob"])


def _dealt(table: pa.Table, dest: np.ndarray, kind: int):
    """The table's rows by their destination."""
    if len(dest):
        order = np.argsort(dest, kind="stable")
        table, dest = table.take(pa.array(order)).combine_chunks(), dest[order]
        cuts = [0, *(np.flatnonzero(np.diff(dest)) + 1), len(dest)]
        yield from _out([(int(dest[a]), kind, _pack(table.slice(a, b - a))) for a, b in zip(cuts, cuts[1:])])


def _gathered(batches, least: int):
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _by_dest(batches):
    """(dest, {kind: blobs}) of rows that are sorted by dest; at most one destination is held."""
    now, held = None, {}
    for batch in batches:
        for dest, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if dest != now:
                if held:
                    yield now, held
                now, held = dest, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def _distinct(table: pa.Table, *columns: str) -> pa.Table:
    return table.group_by(list(columns), use_threads=False).aggregate([])


def _meeting(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "dest").sortWithinPartitions("dest", "kind")


class Known:
    """A bucket's keys, their owners, and which of them are told by broadcast bitmaps: those with most owners, as far as there is room."""

    def __init__(self, table: pa.Table, owners: pa.Array, room: int):
        key = table.column("key").combine_chunks().dictionary_encode()  # the table is sorted by key
        self.table, self.keys, self.of = table, key.dictionary, key.indices.to_numpy()
        self.code = pc.fill_null(pc.index_in(table.column("owner").combine_chunks(), value_set=owners), -1).to_numpy()
        text = Texts(self.keys)
        self.digests, self.text = text.digests(), text
        times = np.where(self.code >= 0, table.column("n").to_numpy(), 0)
        shared = np.bincount(self.of[self.code >= 0], minlength=len(self.keys))
        _, at, same = np.unique(self.digests, return_inverse=True, return_counts=True)
        shared[same[at] > 1] = 0  # keys with equal hashes are left to the exchange
        self.units = np.zeros(len(self.keys), np.int64)  # a bitmap for each time that an owner has a key
        np.maximum.at(self.units, self.of, times)
        by = np.bincount(shared, weights=self.units)
        fits = np.flatnonzero(np.cumsum(by[::-1])[::-1] <= room)
        least = max(1, int(fits[0])) if len(fits) else len(by)
        self.near = shared >= least
        self.far = ~(self.near[self.of] & (self.code >= 0))

    def bitmaps(self, width: int) -> pa.Table:
        keys = np.flatnonzero(self.near)
        first = np.zeros(len(self.keys), np.int64)
        first[keys] = np.cumsum(self.units[keys]) - self.units[keys]
        bits = np.zeros((int(self.units[keys].sum()), 8 * width), bool)
        rows, n = np.flatnonzero(~self.far), self.table.column("n").to_numpy()
        for level in range(1, int(n[rows].max(initial=0)) + 1):
            rows = rows[n[rows] >= level]
            bits[first[self.of[rows]] + level - 1, self.code[rows]] = True
        held = np.packbits(bits, axis=1, bitorder="little")
        return pa.table({"key": self.keys.take(pa.array(np.repeat(keys, self.units[keys]))), "bits": pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(held), [None, pa.py_buffer(held)])})

    def filter(self, most: int) -> np.ndarray:
        """About ten bits for each key that places have to look for in the exchange; a power of two of them."""
        keys = np.unique(self.of[self.far])
        if not len(keys):
            return np.empty(0, np.uint8)
        size = min(1 << max(6, int(10 * len(keys) - 1).bit_length()), 1 << (max(64, most * 8).bit_length() - 1))
        bits = np.zeros(size, bool)
        for i in range(4):
            bits[_filter_place(self.digests[keys], np.uint64(size - 1), i)] = True
        return np.packbits(bits, bitorder="little")

    def tokens(self) -> list[int]:
        return np.unique(np.diff(self.text.cut().first)).tolist()


def _filter_place(digests: np.ndarray, mask, i: int) -> np.ndarray:
    """The i-th of a key's four bits."""
    return ((digests >> np.uint64(7)) + ((digests >> np.uint64(32)) | np.uint64(1)) * np.uint64(i)) & mask


class Lookup:
    """The broadcast keys of one kind - any case, or their own - by hash, and the filters of the others."""

    def __init__(self, parts: list[tuple[int, bytes, bytes, list[int]]], half: int, width: int):
        tables = [_unpack(p[1]) for p in parts]
        self.half, self.lengths = half, sorted({n for p in parts for n in p[3]})
        keys = pa.concat_arrays([c for t in tables for c in t.column("key").chunks]) if any(map(len, tables)) else pa.array([], pa.string())
        bits = [np.frombuffer(c.buffers()[1], np.uint8)[c.offset * width:(c.offset + len(c)) * width] for t in tables for c in t.column("bits").chunks]
        self.bits = np.concatenate([*bits, np.empty(0, np.uint8)]).reshape(-1, width)
        text = Texts(keys)
        digests = np.concatenate([*(Texts(c).digests() for t in tables for c in t.column("key").chunks), np.empty(0, np.uint64)])
        first = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]])) if len(digests) else np.empty(0, np.int64)
        self.shift = np.uint64(64 - max(8, int(2 * len(first)).bit_length()))
        first = first[np.argsort(digests[first], kind="stable")]
        self.digests, self.first, self.data = digests[first], first.astype(np.int32), text.data.copy()
        self.at, self.size = text.offsets[first].astype(np.int32), np.diff(text.offsets)[first].astype(np.int32)
        edges = np.flatnonzero(np.concatenate([digests[1:] != digests[:-1], [True]])) + 1 if len(digests) else np.empty(0, np.int64)
        self.units = ((edges[np.searchsorted(edges, first, "right")] if len(first) else first) - first).astype(np.int32)
        self.slots = np.searchsorted(self.digests >> self.shift, np.arange((1 << int(np.uint64(64) - self.shift)) + 1, dtype=np.uint64)).astype(np.int32)
        sizes = np.zeros(half, np.int64)
        for p in parts:
            sizes[p[0] // 2] = len(p[2])
        self.filter_at = np.cumsum(sizes) - sizes
        self.filter_mask = (np.maximum(sizes, 1) * 8 - 1).astype(np.uint64)
        self.filter_none = sizes == 0
        self.filters = np.frombuffer(b"".join(p[2] for p in sorted(parts)) + b"\0", np.uint8)

    def find(self, digests: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the key that stands at each place, or -1."""
        out = np.full(len(digests), -1, np.int64)
        if not len(self.digests):
            return out
        slot = (digests >> self.shift).astype(np.int64)
        at, stop = self.slots[slot], self.slots[slot + 1]
        todo = np.flatnonzero(at < stop)
        at, stop = at[todo].astype(np.int64), stop[todo]
        while len(todo):
            hit = self.digests[at] == digests[todo]
            out[todo[hit]] = at[hit]
            at += 1
            go = ~hit & (at < stop)
            todo, at, stop = todo[go], at[go], stop[go]
        some = np.flatnonzero(out >= 0)
        key, long = out[some], (ends - starts)[some]
        good = self.size[key] == long
        some, key, long = some[good], key[good], long[good]
        offsets = np.cumsum(long) - long
        each = np.arange(int(long.sum())) - np.repeat(offsets, long)
        equal = data[np.repeat(starts[some], long) + each] == self.data[np.repeat(self.at[key], long) + each]
        good = np.logical_and.reduceat(equal, offsets) if len(some) else np.empty(0, bool)
        out[:] = -1
        out[some[good]] = key[good]
        return out

    def maybe(self, digests: np.ndarray) -> np.ndarray:
        """Places whose key the exchange may know; none that it knows is left out."""
        bucket = (digests % np.uint64(self.half)).astype(np.int64)
        left = np.flatnonzero(~self.filter_none[bucket])
        masks, ats, every = self.filter_mask[bucket[left]], self.filter_at[bucket[left]], digests[left]
        for i in range(4):
            place = _filter_place(every, masks, i).astype(np.int64)
            good = (self.filters[ats + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 > 0
            left, masks, ats, every = left[good], masks[good], ats[good], every[good]
        return left


def _lookups(shared) -> tuple[list[Lookup | None], list[str], bool]:
    """Unpacked once a worker; whether every owner has a bit."""
    parts, half, width, owners, whole, name = shared.value
    if _cache.get("for") != name:
        _cache.pop("lookups", None)
        _cache["lookups"] = [Lookup(own, half, width) if (own := [p for p in parts if p[0] % 2 == kind]) else None for kind in (0, 1)], owners, whole
        _cache["for"] = name
        pa.default_memory_pool().release_unused()
    return _cache["lookups"]


def _add(sums: np.ndarray, rows: np.ndarray, units: np.ndarray, bits: np.ndarray) -> None:
    """Adds the bitmaps of the units to their rows' counts; ``rows`` ascend."""
    for lo in range(0, len(rows), _ADDED):
        row, unit = rows[lo:lo + _ADDED], units[lo:lo + _ADDED]
        at = np.arange(len(row))
        new = np.concatenate([[True], row[1:] != row[:-1]])
        starts = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % 255 == 0))
        lanes = np.add.reduceat(_LANES[bits[unit]], starts, axis=0).view(np.uint8)
        once = np.concatenate([[True], row[starts][1:] != row[starts][:-1]])
        sums[row[starts[once]]] += lanes[once]
        for i in np.flatnonzero(~once):
            sums[row[starts[i]]] += lanes[i]


def _sliced(batches):
    """Pieces of about SLICE bytes of text; columns: id, block, title, body."""
    for batch in batches:
        if not len(batch):
            continue
        ends = Texts(batch.column(2)).offsets[1:] + Texts(batch.column(3)).offsets[1:]
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _scan(batches, shared):
    """Sums of the broadcast keys to the article's block, other places that the catalog may know to their key's bucket."""
    lookups, owners, whole = _lookups(shared)
    places, sums = [], []

    def packed(own, kind, least=1):
        if sum(len(d) for _, d in own) >= least:
            table, dest = pa.concat_tables([t for t, _ in own]), np.concatenate([d for _, d in own])
            own.clear()
            yield from _dealt(table, dest, kind)

    for part in _sliced(batches):
        counts = np.zeros((2, len(part), 64 * -(-len(owners) // 64)), np.int32)
        for side in (0, 1):
            text = Texts(part.column(2 + side)).cut()
            for kind, look in enumerate(lookups):
                if look is None or not len(text.starts):
                    continue
                data = text.data if kind else _LOWER[text.data]
                hashed = _sums(data)
                for n in look.lengths:
                    starts, ends, rows = text.runs(n)
                    digests = _digests(hashed, starts, ends)
                    key = look.find(digests, data, starts, ends)
                    found = np.flatnonzero(key >= 0)
                    row, many = rows[found], look.units[key[found]]
                    first = np.repeat(look.first[key[found]], many)
                    _add(counts[side], np.repeat(row, many), first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many), look.bits)
                    left = np.flatnonzero(key < 0) if whole else np.arange(len(key))
                    far = left[look.maybe(digests[left])]
                    if len(far):
                        at = pa.array(rows[far])
                        table = pa.table({"key": _strings(data, starts[far], ends[far]), "id": part.column(0).take(at), "block": part.column(1).take(at), "title": pa.repeat(side == 0, len(far))})
                        places.append((table, (digests[far] % np.uint64(look.half)).astype(np.int64) * 2 + kind))
        row, owner = np.nonzero(counts[0] | counts[1])
        some, first = np.unique(row, return_index=True)
        if len(some):
            step = np.diff(owner, prepend=0)
            step[first] = owner[first]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(x, pa.int32()))
            table = pa.table({"id": part.column(0).take(pa.array(some)), "steps": lists(step), "titles": lists(counts[0][row, owner]), "bodies": lists(counts[1][row, owner])})
            sums.append((table, part.column(1).to_numpy()[some].astype(np.int64)))
        yield from packed(places, _HITS, HELD)
        yield from packed(sums, _SUMS, HELD // 100)
    yield from packed(places, _HITS)
    yield from packed(sums, _SUMS)


def _meet(batches, owners: list[str], room: int):
    """Owners of the places of a bucket, to the blocks of their articles; sums go past."""
    owners, hits, count = pa.array(owners, pa.string()), [], 0

    def packed():
        table = pa.concat_tables(hits)
        hits.clear()
        return _dealt(table.drop_columns(["block"]), table.column("block").to_numpy().astype(np.int64), _HITS)

    for dest, blobs in _by_dest(batches):
        yield from _out([(dest, _SUMS, b) for b in blobs.get(_SUMS, [])])
        if _HITS not in blobs or _CATALOG not in blobs:
            continue
        known = Known(_unpack(blobs[_CATALOG][0]), owners, room)
        of = known.of[known.far]  # ascending
        first = np.searchsorted(of, np.arange(len(known.keys) + 1))
        owner, n = known.table.column("owner").filter(pa.array(known.far)).combine_chunks(), known.table.column("n").to_numpy()[known.far]
        for places in _gathered((r for b in blobs[_HITS] for r in _unpack(b).to_batches()), HELD):
            key = pc.fill_null(pc.index_in(places.column("key").combine_chunks(), value_set=known.keys), -1).to_numpy()
            row = np.flatnonzero(key >= 0)
            many = first[key[row] + 1] - first[key[row]]
            of_row = np.repeat(row, many)
            at = np.repeat(first[key[row]] - (np.cumsum(many) - many), many) + np.arange(len(of_row))
            took = places.select(["id", "block"]).take(pa.array(of_row))
            title = places.column("title").to_numpy()[of_row]
            hits.append(took.append_column("owner", owner.take(pa.array(at))).append_column("in_title", pa.array(np.where(title, n[at], 0), pa.int32())).append_column("in_body", pa.array(np.where(title, 0, n[at]), pa.int32())))
            count += len(of_row)
            if count >= HELD:
                yield from packed()
                count = 0
    if hits:
        yield from packed()


def _total(batches, owners: list[str], seq: str):
    """Sums of the articles of a block."""
    owners = pa.array(owners, pa.string())
    for _, blobs in _by_dest(batches):
        ids, codes, counts, more = [], [], [[], []], owners
        if _SUMS in blobs:
            table = pa.concat_tables([_unpack(b) for b in blobs[_SUMS]]).combine_chunks()
            flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
            long = pc.list_value_length(table.column("steps")).to_numpy()
            run, ends = np.cumsum(flat("steps"), dtype=np.int64), np.cumsum(long)
            codes.append(run - np.repeat(np.concatenate([[0], run[ends[:-1] - 1]]), long))
            ids.append(table.column("id").take(pa.array(np.repeat(np.arange(len(long)), long))))
            for i, c in enumerate(("titles", "bodies")):
                counts[i].append(flat(c))
        if _HITS in blobs:
            table = pa.concat_tables([_unpack(b) for b in blobs[_HITS]]).combine_chunks()
            own = table.column("owner").combine_chunks()
            new = pc.unique(own).filter(pc.invert(pc.is_in(pc.unique(own), value_set=owners)))
            more = pa.concat_arrays([owners, new])
            codes.append(pc.index_in(own, value_set=more).to_numpy().astype(np.int64))
            ids.append(table.column("id"))
            for i, c in enumerate(("in_title", "in_body")):
                counts[i].append(table.column(c).to_numpy())
        every = pa.chunked_array([c for x in ids for c in x.chunks]).combine_chunks().dictionary_encode(null_encoding="encode")
        cell = every.indices.to_numpy().astype(np.int64) * len(more) + np.concatenate(codes)
        cells = len(every.dictionary) * len(more)
        if cells > 8 * len(cell) + 1_000_000:  # few of many owners
            some, cell = np.unique(cell, return_inverse=True)
            cells = len(some)
        else:
            some = np.arange(cells)
        sums = [np.bincount(cell, weights=np.concatenate(c), minlength=cells) for c in counts]
        full = np.flatnonzero(sums[0] + sums[1])
        for lo in range(0, len(full), 100_000):
            at = full[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([every.dictionary.take(pa.array(some[at] // len(more))), more.take(pa.array(some[at] % len(more))), *(pa.array(s[at].astype(np.int32)) for s in sums)],
                                             names=[seq, "owner", "in_title", "in_body"])


def _bytes(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def tallied(articles: DataFrame, wanted: DataFrame, seq: str, title: str, body: str, searched) -> DataFrame:
    """(seq, owner, in_title, in_body): how often an owner's patterns stand in an article.

    ``wanted``: owner, pattern, case_sensitive, phrased (not to be looked up). What can't be looked up is given to ``searched``: owner, pattern, case_sensitive
    in, (seq, owner, in_title, in_body) out.
    """
    spark = articles.sparkSession
    ship_package(spark)
    size = _bytes(articles)
    # a catalog that comes from a join is estimated far too high
    half = max(spark.sparkContext.defaultParallelism, min(2048, (size + min(_bytes(wanted), 4 * size)) // (2 * BUCKET_BYTES)))
    buckets = 2 * half

    def cut(batches):
        for table in _gathered(batches, HELD):
            table = _distinct(table, "owner", "pattern", "case_sensitive", "phrased")
            texts, own = [Texts(c).cut() for c in _pieces(table.column("pattern").combine_chunks())], table.column("case_sensitive").to_numpy()
            digests = np.where(own, *(np.concatenate([t.digests(lower) for t in texts]) for lower in (False, True)))
            dest, plain = (digests % np.uint64(half)).astype(np.int64) * 2 + own, np.concatenate([t.plain() for t in texts]) & ~table.column("phrased").to_numpy()
            for kind, some in ((_CATALOG, plain), (_OTHER, ~plain)):
                yield from _dealt(table.select(["owner", "pattern", "case_sensitive"]).filter(pa.array(some)), dest[some], kind)

    def merged(batches):
        for dest, blobs in _by_dest(batches):
            for kind, own in blobs.items():
                table = _distinct(pa.concat_tables([_unpack(b) for b in own]), "owner", "pattern", "case_sensitive")
                if kind == _CATALOG:
                    key = table.column("pattern") if dest % 2 else pc.ascii_lower(table.column("pattern"))
                    table = pa.table({"key": key, "owner": table.column("owner")}).group_by(["key", "owner"], use_threads=False).aggregate([([], "count_all")])
                    table = table.rename_columns(["key", "owner", "n"]).sort_by("key")
                yield from _out([(dest, kind, _pack(table))])

    catalog = cut_lineage(_meeting(wanted.select("owner", "pattern", "case_sensitive", "phrased").mapInArrow(cut, _ROWS), buckets).mapInArrow(merged, _ROWS))
    known = catalog.where(F.col("kind") == _CATALOG)

    def shares(batches):
        for _, blobs in _by_dest(batches):
            n = _unpack(blobs[_CATALOG][0]).group_by("owner", use_threads=False).aggregate([([], "count_all")])
            yield from n.rename_columns(["owner", "n"]).combine_chunks().to_batches()

    rows = known.mapInArrow(shares, "owner string, n long").groupBy("owner").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "owner").limit(OWNERS + 1).collect()
    owners, whole = sorted(r["owner"] for r in rows[:OWNERS]), len(rows) <= OWNERS
    width = 8 * -(-len(owners) // 64)
    room, most = BITMAP_BYTES // (max(1, width) * buckets), FILTER_BYTES // buckets

    def told(batches):
        for dest, blobs in _by_dest(batches):
            own = Known(_unpack(blobs[_CATALOG][0]), pa.array(owners, pa.string()), room)
            yield pa.RecordBatch.from_arrays([pa.array([dest], pa.int32()), pa.array([_pack(own.bitmaps(width))], pa.binary()), pa.array([own.filter(most).tobytes()], pa.binary()), pa.array([own.tokens()], pa.list_(pa.int32()))],
                                             names=["dest", "near", "filter", "tokens"])

    parts = [(r["dest"], bytes(r["near"]), bytes(r["filter"]), list(r["tokens"])) for r in known.mapInArrow(told, "dest int, near binary, filter binary, tokens array<int>").collect()]
    shared = spark.sparkContext.broadcast((parts, half, width, owners, whole, uuid.uuid4().hex))
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in (title, body)}
    block: Column = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("block")
    placed = spread(articles.select(F.col(seq).alias("id"), text[title].alias("_t"), text[body].alias("_b"))).select("id", block, "_t", "_b")
    met = _meeting(known.unionByName(placed.mapInArrow(lambda batches: _scan(batches, shared), _ROWS)), buckets).mapInArrow(lambda batches: _meet(batches, owners, room), _ROWS)
    if not catalog.where(F.col("kind") == _OTHER).isEmpty():
        def others(batches):
            for _, blobs in _by_dest(batches):
                for blob in blobs[_OTHER]:
                    yield from _unpack(blob).combine_chunks().to_batches()

        def packed(batches):
            for table in _gathered(batches, HELD):
                yield from _dealt(table.drop_columns(["block"]), table.column("block").to_numpy().astype(np.int64), _HITS)

        rest = searched(catalog.where(F.col("kind") == _OTHER).mapInArrow(others, "owner string, pattern string, case_sensitive boolean"))
        met = met.unionByName(rest.select(F.col(seq).alias("id"), "owner", F.col("in_title").cast("int").alias("in_title"), F.col("in_body").cast("int").alias("in_body")).select("*", block).mapInArrow(packed, _ROWS))
    schema = T.StructType([T.StructField(seq, articles.schema[seq].dataType), *(T.StructField(n, t) for n, t in (("owner", T.StringType()), ("in_title", T.IntegerType()), ("in_body", T.IntegerType())))])
    return _meeting(met, buckets).mapInArrow(lambda batches: _total(batches, owners, seq), schema)
