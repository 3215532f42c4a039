"""Sequence packing by swap-based local search (operator 6).

Token counts come from a public tokenizer. Documents longer than a sequence are cut from the end into full pieces, so only
the first piece is short. Short pieces are dealt out by hash; each task packs about ``GROUP_ROWS`` of them best-fit first and then improves
the underfull bins: a piece moves, or one or two pieces change places with one of another bin, whenever the sum
of squared fills grows. That sum is bounded, so the search ends; bins that run empty are gone.

Null and empty texts give one piece, the end token. Equal rows give equal pieces, each placed. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, row_steps, text_buffer

#: Rows that one task packs together, and the most it holds at once.
GROUP_ROWS = 8192
HELD_ROWS = 65_536
#: Word forms whose ids a Python worker keeps, the most ids kept of a form, and the bytes handled in a step.
FORM_SLOTS, FORM_IDS, TEXT_STEP = 1 << 20, 8, 2 << 20
#: The longest form that is kept, in bytes, and the bits of its integers that belong to a form of each length.
FORM_BYTES = 24
_MASKS = np.where(np.arange(FORM_BYTES) < np.arange(FORM_BYTES + 1)[:, None], 255, 0).astype(np.uint8).view(np.uint64)


class FormTokenizer:
    """Ids of many texts at once, form by form.

    A single space between two other characters always begins a new token group, so a text is the sequence of its
    forms: the pieces before, between and after such spaces. Ids of met forms of up to ``FORM_BYTES`` bytes stay in a table of
    fixed size, in which a newer form takes the place of an older one; a form is known only if all of its bytes are those of the table.
    Other forms go to the tokenizer: through its rank file (the same vocabulary, read by tiktoken, much faster for many forms) if there
    is one, else through ``tokenizers``. Texts that hold the string of a special token go through ``tokenizers`` whole, unless
    ``specials`` is off: then such strings are plain text.
    """

    _of: dict[tuple, "FormTokenizer"] = {}

    def __init__(self, path: str, ranks: str | None, specials: bool = True) -> None:
        self.path, self.specials = path, specials
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"].encode() for t in json.load(file).get("added_tokens", [])] if specials else []
        self.encoding = None
        if ranks:
            import public_tokenizers
            import tiktoken

            table = read_ranks(ranks)
            self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.token_bytes = np.zeros(max(table.values()) + 1, np.int64)
            for token, rank in table.items():
                self.token_bytes[rank] = len(token)
        self.keys = np.zeros((FORM_SLOTS, FORM_BYTES // 8), np.uint64)
        self.sizes = np.zeros(FORM_SLOTS, np.uint8)
        self.counts = np.zeros(FORM_SLOTS, np.uint8)
        self.pool = np.zeros(FORM_SLOTS * FORM_IDS, np.uint32)

    @cached_property
    def tokenizer(self):
        """Loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(self.path)
        loaded.encode_special_tokens = not self.specials
        return loaded

    @classmethod
    def at(cls, path: str, ranks: str | None, specials: bool = True) -> "FormTokenizer":
        if (path, ranks, specials) not in cls._of:
            cls._of[path, ranks, specials] = cls(path, ranks, specials)
        return cls._of[path, ranks, specials]

    def _text_ids(self, text: str) -> np.ndarray:
        if self.encoding is not None:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _form_ids(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of forms that begin with a space and end with none, one after another, and their counts."""
        if not forms:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.encoding is None:
            each = [self._text_ids(f.decode()) for f in forms]
            return np.concatenate(each), np.array([len(e) for e in each], np.int64)
        ids = np.array(self.encoding.encode_ordinary(b"".join(forms).decode()), np.uint32)
        ends = np.cumsum(self.token_bytes[ids])
        after = np.searchsorted(ends, np.cumsum([len(f) for f in forms]), side="left") + 1
        return ids, np.diff(after, prepend=0)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts that lie in ``data`` from each start to the next."""
        base, raw = int(starts[0]), data[starts[0] : starts[-1]].tobytes()
        data, starts = data[starts[0] : starts[-1]], starts - base
        begins, ends, inner = form_bounds(data, starts)
        short = inner & (ends - begins <= FORM_BYTES)
        words = form_words(data, begins, ends)
        hashes = mix((ends - begins).astype(np.uint64))
        for k in range(FORM_BYTES // 8):
            hashes = mix(hashes ^ words[:, k])
        slots = (hashes & np.uint64(FORM_SLOTS - 1)).astype(np.int64)
        known = short & (self.sizes[slots] == ends - begins) & (self.keys[slots] == words).all(axis=1)
        offset, count = slots * FORM_IDS, np.where(known, self.counts[slots], 0).astype(np.int64)
        # unknown short forms once each; forms that only share a hash with another, and long ones, by themselves
        lost = np.flatnonzero(short & ~known)
        _, which, back = np.unique(hashes[lost], return_index=True, return_inverse=True)
        new = lost[which]
        other = (words[new][back] != words[lost]).any(axis=1) | ((ends - begins)[new][back] != (ends - begins)[lost])
        alone = np.concatenate([lost[other], np.flatnonzero(inner & ~short)])
        lost, back = lost[~other], back[~other]
        asked = np.concatenate([new, alone])
        tail, sizes = self._form_ids([raw[b:e] for b, e in zip(begins[asked].tolist(), ends[asked].tolist())])
        at = len(self.pool) + np.cumsum(sizes) - sizes
        offset[lost], count[lost] = at[back], sizes[back]
        offset[alone], count[alone] = at[len(new) :], sizes[len(new) :]
        edges = np.flatnonzero(~inner)
        each = [self._text_ids(raw[b:e].decode()) for b, e in zip(begins[edges].tolist(), ends[edges].tolist())]
        lengths = np.array([len(e) for e in each], np.int64)
        offset[edges] = len(self.pool) + len(tail) + np.cumsum(lengths) - lengths
        count[edges] = lengths
        total = np.cumsum(count)
        rest = np.concatenate([tail, *each]).astype(np.uint32)
        index = np.repeat(offset - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        own = index < len(self.pool)
        ids = np.empty(len(index), np.uint32)
        ids[own], ids[~own] = self.pool[index[own]], rest[index[~own] - len(self.pool)]
        # the table takes the new forms only after all ids are read; of forms with one slot the last stays
        sizes, at = sizes[: len(new)], at[: len(new)] - len(self.pool)
        kept = np.flatnonzero(sizes <= FORM_IDS)
        _, last = np.unique(slots[new[kept]][::-1], return_index=True)
        kept = kept[len(kept) - 1 - last]
        place = slots[new[kept]]
        self.keys[place], self.sizes[place], self.counts[place] = words[new[kept]], (ends - begins)[new[kept]], sizes[kept]
        for n in range(FORM_IDS):
            has = sizes[kept] > n
            self.pool[place[has] * FORM_IDS + n] = tail[at[kept][has] + n]
        first = np.searchsorted(begins, starts[:-1], side="left")
        bounds = np.concatenate([[0], total])[np.append(first, len(begins))]
        texts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for word in self.special:
            found = raw.find(word)
            while found >= 0:
                row = int(np.searchsorted(starts, found, side="right")) - 1
                whole = raw[starts[row] : starts[row + 1]].decode()
                texts[row] = np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32)
                found = raw.find(word, int(starts[row + 1]))
        return texts


def read_ranks(path: str) -> dict[bytes, int]:
    """The bytes of each token of a rank file and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def form_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first ``FORM_BYTES`` bytes of each form as integers, zero beyond its end."""
    padded = np.concatenate([data, np.zeros(FORM_BYTES, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, FORM_BYTES)[begins].view(np.uint64)
    return words & _MASKS[np.minimum(ends - begins, FORM_BYTES)]


#: Bytes that may belong to white space: ASCII white space and the lead bytes of longer white space characters.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MIDDLE = np.zeros(256, bool)
_MIDDLE[[0xC2, 0x80, 0x81, 0x9A]] = True


def form_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each form, and whether it lies between two splitting spaces; the others stand at a text's edge."""
    n = len(data)
    before, after = np.roll(data, 1), np.roll(data, -1)
    # a byte over 0x7F is taken for white space if it may end or begin such a character: then the form is only longer
    tail = (before >= 0x80) & _MIDDLE[np.roll(data, 2)]
    split = (data == 32) & ~_BLANK[before] & ~_BLANK[after] & ~_LEAD[after] & ~tail
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    split &= ~edge[:n]  # a space at a text's begin splits nothing
    split[np.flatnonzero(split & edge[1:])] = False  # nor one at its end
    begins = np.flatnonzero(split | edge[:n])
    ends = np.append(begins[1:], n) if len(begins) else begins
    return begins, ends, split[begins] & ~edge[ends]


def cut_pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves (little-endian)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = FormTokenizer.at(tokenizer, ranks)
        for batch in batches:
            data, starts = text_buffer(batch.column(1))
            for first, last in row_steps(starts, TEXT_STEP):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).slice(first, last - first).to_pylist(), forms.encode(data, starts[first : last + 1])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n, whole = len(ids), ids.tobytes()
                    begin, size, piece = 0, n - (n - 1) // capacity * capacity, 0
                    while begin < n:
                        own = whole[4 * begin : 4 * (begin + size)]
                        rows.append((doc, piece, begin, size, zlib.crc32(own)) + ((own,) if with_ids else ()))
                        begin, size, piece = begin + size, capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that takes it. Bins as lists of piece numbers."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
            bins[b].append(i)
        else:
            b, left = len(bins), capacity
            bins.append([i])
        left -= size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over underfull bins; every exchange raises the sum of squared fills.

    A receiver with room r offers places: an empty one that takes up to r, and that of each of its pieces b, which takes
    up to b + r and gives b back. Offers are kept by reach; those of changed bins are dropped when met.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    version = [0] * len(bins)
    offers: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    reaches = 0  # bit r is set where offers[r] may hold some

    def offer(b: int) -> None:
        nonlocal reaches
        room = capacity - fill[b]
        if 0 < room < capacity:
            for i in [-1, *{sizes[i]: i for i in bins[b]}.values()]:
                reach = room + (sizes[i] if i >= 0 else 0)
                offers[reach].append((b, version[b], i))
                reaches |= 1 << reach

    def taker(size: int, giver: int) -> tuple[int, int] | None:
        nonlocal reaches
        ahead = reaches >> size << size
        while ahead:
            bit = ahead & -ahead
            ahead ^= bit
            reach = bit.bit_length() - 1
            offers[reach] = kept = [o for o in offers[reach] if version[o[0]] == o[1]]
            if not kept:
                reaches ^= bit
            for b, _, i in kept:
                gain = size - (sizes[i] if i >= 0 else 0)
                if b != giver and gain > 0 and fill[b] + gain > fill[giver]:
                    return b, i
        return None

    for b in range(len(bins)):
        offer(b)
    better = True
    while better:
        better = False
        for giver in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=fill.__getitem__):
            again = True
            while again and bins[giver] and fill[giver] < capacity:
                again = False
                own = sorted(bins[giver], key=lambda i: -sizes[i])
                # of all exchanges that send one total one is tried: they change the fills alike
                sums = {sizes[i]: [i] for i in own}
                for n, a in enumerate(own):
                    for c in own[n + 1 :]:
                        sums.setdefault(sizes[a] + sizes[c], [a, c])
                for total, sent in sums.items():
                    if (found := taker(total, giver)) is None:
                        continue
                    b, back = found
                    for i in sent:
                        bins[giver].remove(i)
                    bins[b] += sent
                    gain = total
                    if back >= 0:
                        bins[b].remove(back)
                        bins[giver].append(back)
                        gain -= sizes[back]
                    fill[b] += gain
                    fill[giver] -= gain
                    for x in (b, giver):
                        version[x] += 1
                        offer(x)
                    again = better = True
                    break
    return [b for b in bins if b]


def place_pieces(pieces: DataFrame, capacity: int = 1024, partitions: int | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity`` tokens.

    ``partitions`` defaults to one task for each ``GROUP_ROWS`` pieces; it reads ``pieces`` once to count them. A task works through its rows in an order
    fixed by their values, ``HELD_ROWS`` at a time, so a lost task repeats its choice and no hot id can fill its memory.
    """
    if partitions is None:
        partitions = max(1, -(-pieces.count() // GROUP_ROWS))
    names = pieces.columns
    keys = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in names]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for held in _held(batches):
            sizes = held["length"].to_pylist()
            bins = improve(best_fit(sizes, capacity), sizes, capacity)
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for b in bins:
                at = 0
                for i in b:
                    sequence[i], offset[i] = number, at
                    at += sizes[i]
                number += 1
            yield from held.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    dealt = pieces.repartition(partitions, F.xxhash64(*keys)).sortWithinPartitions(*keys)
    return dealt.mapInArrow(place, ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """Documents to pieces with their sequence and place in it. Documents are tokenized once; tasks by document count."""
    partitions = max(1, -(-docs.count() // GROUP_ROWS))
    return place_pieces(cut_pieces(docs, tokenizer, ranks, capacity, end_id, with_ids), capacity, partitions)
