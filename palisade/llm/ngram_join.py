"""Jaccard join on word n-grams by T-occurrence search.

1. Every document becomes its set of hashed word n-grams. Equal sets form one class, told apart by a 128-bit sum.
2. Two sets that reach the threshold share a member of their prefixes (the first ``n - ceil(t n) + 1`` members in any
   one order of all n-grams). The order puts frequent n-grams last and long ones first, so that a passage shared by a
   third of the corpus is not what brings documents together; only documents with a frequent n-gram in their prefix are
   read again for it. Of the classes under a prefix member, two are joined only if their sizes and parity sketches allow
   a link: each n-gram that only one set has flips one of a sketch's bits, so sketches differ in no more bits than the
   sets in members. Larger sets have wider sketches. Sets of like size are compared only where a piece of their sketches
   is equal, as one must be (more pieces than bits that may differ). Classes joined directly or by way of others form a
   group; a group holds all links of its classes.
3. In each group an inverted index answers, for many classes at once, which others share at least T members: lists
   outside the L longest are merged and counted, and the survivors are probed by binary search in the long ones
   (DivideSkip). Lists hold classes in order of size, so that only the stretch of sizes that can reach the threshold is
   merged. Candidates already connected are passed over, as the result is the connected components. A group of more than
   ``GROUP_MEMBERS`` n-grams is worked in blocks (``link_large``), so no task holds it whole.

Null or empty texts and texts without words have empty sets and no links. Rows that repeat a doc_id get the same row
each. Texts are taken whole; a very long one is alone in its kernel's slice. A component is named by the smallest doc_id
of its members, so ties can't occur; documents with a null doc_id link as others do, but name a component only if all its
members' are null. An empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import id_text, lowered, materialise, mix, packed, partitions, prefix_hash, release, settled, signed, span_hash, text_slices, words

#: An n-gram is frequent from this many prefixes on, or from so many that FREQUENT_KEPT n-grams can reach it at most.
FREQUENT, FREQUENT_KEPT = 64, 50_000
#: Sets of up to so many members have a sketch of so many bits. A wide one folds into a narrow one, its bits taken modulo.
#: Sketches of unrelated sets differ in half their bits at most, so with much more members than bits none is told apart, and
#: sets that only share a prefix member gather in one group, whose work grows with its square.
SKETCHES = (*((600 << i, 512 << i) for i in range(7)), (1 << 62, 65_536))
#: N-grams of a group's sets that one task holds, a set counting as so many more; and holders of a prefix member whose
#: sketches one task compares. More holders than these are put into one group as they are.
GROUP_MEMBERS, SET_COST, HOLDERS = 3_000_000, 16, 20_000
#: DivideSkip's weight of the longest list in the number of lists to set aside.
SKIP_WEIGHT = 0.01
#: List entries merged at once; classes, and n-grams of theirs, asked about at once; and members from which a component is
#: finished before others.
MERGED, ASKED, ASKED_MEMBERS, FOCUS = 1_000_000, 4096, 200_000, 256
#: Documents whose ids are broadcast to be read again for frequent n-grams; with more, all are.
READ_AGAIN = 1_000_000
#: Bits that a piece of a sketch has at least, where pieces are compared.
PIECE_BITS = 12

SIG = "doc_id long, named boolean, n long, sum_a long, sum_b long, views array<struct<wide: int, sketch: binary>>, prefix array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, length in bytes) of every word n-gram, repeats included; fewer words than ``size`` make one n-gram."""
    data = lowered(data)
    start, end, row = words(data, offsets)
    if not len(start):
        return row, np.zeros(0, np.uint64), start
    word = span_hash(prefix_hash(data), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    short = count[row] < size
    head = np.where(short, place == 0, place + size <= count[row])
    total, length, left = np.zeros(len(row), np.uint64), np.zeros(len(row), np.int64), np.where(short, count[row] - place, size)
    for j in range(size):
        n = len(row) - j
        if n <= 0:
            break
        use = left[:n] > j
        total[:n] = np.where(use, mix(total[:n] * np.uint64(0xA24BAED4963EE407) + word[j:] + np.uint64(j + 1)), total[:n])
        length[:n] += np.where(use, (end - start)[j:], 0)
    return row[head], total[head], length[head]


def needed(n, percent: int):
    """Least members that a set of ``n`` shares with any set at the threshold."""
    return (percent * n + 99) // 100


def sets_of(part: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct hashes in ascending order, their lengths) of the rows that have any."""
    row, value, length = shingles(*packed(part.column("text")), size)
    cuts = np.flatnonzero(np.diff(row)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(row)]):
        if a < b:
            kept, at = np.unique(value[a:b], return_index=True)
            yield int(row[a]), kept, length[a:b][at]


def size_class(n: int) -> int:
    return next(i for i, (most, _) in enumerate(SKETCHES) if n <= most)


def parity_sketch(kept: np.ndarray, wide: int) -> bytes:
    bits = SKETCHES[wide][1]
    flips = np.bincount((kept >> np.uint64(20)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def signatures(size: int, percent: int, frequent: np.ndarray, only: np.ndarray | None = None):
    """Arrow kernel: set size, 128-bit set sum and prefix of each row, or of the rows with one of the ids ``only``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pc.is_in(batch.column(0), pa.array(only)))
            for part in text_slices(batch, "text"):
                n = np.zeros(part.num_rows, np.int64)
                sums = np.zeros((2, part.num_rows), np.uint64)
                prefix: list = [[]] * part.num_rows
                seen, wide, sketch = np.zeros(part.num_rows + 1, np.int32), [], []
                for i, kept, length in sets_of(part, size):
                    n[i] = len(kept)
                    sums[0, i] = kept.sum(dtype=np.uint64)
                    sums[1, i] = mix(kept ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    own = range(size_class(needed(len(kept), percent)), size_class(len(kept)) + 1)  # to meet smaller sets too
                    wide += own
                    sketch += [parity_sketch(kept, w) for w in own]
                    seen[i + 1] = len(own)
                    often = np.zeros(len(kept), bool)
                    if len(frequent):
                        often = frequent[np.minimum(np.searchsorted(frequent, kept), len(frequent) - 1)] == kept
                    order = np.lexsort((kept, -length, often))
                    prefix[i] = signed(kept[order[: len(kept) - needed(len(kept), percent) + 1]])
                views = pa.StructArray.from_arrays([pa.array(wide, pa.int32()), pa.array(sketch, pa.binary())], names=["wide", "sketch"])
                views = pa.ListArray.from_arrays(pa.array(np.cumsum(seen, dtype=np.int32)), views)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(part.schema.get_field_index("named")), pa.array(n), *(pa.array(signed(x)) for x in sums), views, pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc_id", "named", "n", "sum_a", "sum_b", "views", "prefix"],
                )

    return run


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` members whose sketches differ in ``differ`` bits can reach the threshold."""
    least = -(-percent * (n + m) // (100 + percent))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (differ <= n + m - 2 * least)


def reached(n: np.ndarray, sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of sets that may link; a set that was reached is not compared again."""
    out, left = [], np.arange(len(n))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = may_link(n[left], n[at], np.bitwise_count(sketch[left] ^ sketch[at]).sum(axis=1, dtype=np.int64), percent)
            out += [(int(at), int(j)) for j in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return out


def piece_hashes(sketch: np.ndarray, pieces: int) -> np.ndarray:
    """A hash of each of so many pieces of each sketch."""
    bits = sketch.shape[1] * 64
    factor = mix(np.arange(1, bits + 1, dtype=np.uint64))
    starts = np.arange(pieces) * bits // pieces
    out = np.empty((len(sketch), pieces), np.uint64)
    step = max(1, (1 << 19) // bits)
    for a in range(0, len(sketch), step):
        own = np.ascontiguousarray(sketch[a : a + step])
        out[a : a + step] = np.add.reduceat(np.unpackbits(own.view(np.uint8), axis=1) * factor, starts, axis=1)
    return out


def spanning_edges(n: np.ndarray, sketch: np.ndarray, percent: int, few: int = 16) -> list[tuple[int, int]]:
    """Pairs that may link and connect all that do, directly or by way of others; no more than a forest of them.

    Sets stand in order of size. Those from the least size up to what it can link with, and what the largest of these
    can, are looked at together; sketches of sets that may link differ in fewer bits than they have pieces.
    """
    order = np.argsort(n, kind="stable")
    n, sketch = n[order], sketch[order]
    links, out = Links(len(n)), []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        names = links.names()
        new = names[a] != names[b]
        out.extend((i, j) for i, j in zip(a[new].tolist(), b[new].tolist()) if links.join(i, j))

    def add_reached(own: np.ndarray) -> None:
        pairs = np.array(reached(n[own], sketch[own], percent), np.int64).reshape(-1, 2)
        add(own[pairs[:, 0]], own[pairs[:, 1]])

    start = 0
    while start < len(n):
        top = int(n[start]) * 100 // percent
        after, end = np.searchsorted(n, [top, top * 100 // percent], side="right")
        size, look = n[start:end], sketch[start:end]
        pieces = int((min(top, size[-1]) + size[-1]) * (100 - percent) // (100 + percent)) + 1
        if len(size) <= 4 * few or sketch.shape[1] * 64 < PIECE_BITS * pieces:
            add_reached(np.arange(start, end))
        else:
            for key in piece_hashes(look, pieces).T:
                by = np.argsort(key, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
                runs = np.diff(np.append(heads, len(by)))
                small = np.repeat(runs <= few, runs)
                for d in range(1, few):
                    i = np.flatnonzero(small[:-d] & (key[by][d:] == key[by][:-d]))
                    i, j = by[i], by[i + d]
                    near = may_link(size[i], size[j], np.bitwise_count(look[i] ^ look[j]).sum(axis=1, dtype=np.int64), percent)
                    add(start + i[near], start + j[near])
                for h, r in zip(heads[runs > few], runs[runs > few]):
                    add_reached(start + by[h : h + r])
        start = int(after)
    return [(int(order[i]), int(order[j])) for i, j in out]


def edges_of(percent: int, few: int = 6):
    """Arrow kernel over rows (wide, token, rep, n, sketch) in that order: pairs of reps that may link, for each token.

    Pairs under a token with at most ``few`` holders are compared all at once; of more holders, a spanning forest.
    """

    def edges(token: np.ndarray, rep: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        held = np.diff(np.append(heads, len(token)))
        small = np.repeat(held <= few, held)
        a, b = [], []
        for d in range(1, few):
            i = np.flatnonzero(small[:-d] & (token[d:] == token[:-d])) if len(token) > d else np.zeros(0, np.int64)
            i = i[may_link(n[i], n[i + d], np.bitwise_count(sketch[i] ^ sketch[i + d]).sum(axis=1, dtype=np.int64), percent)]
            a.append(rep[i])
            b.append(rep[i + d])
        for h, size in zip(heads[held > few], held[held > few]):
            found = spanning_edges(n[h : h + size], sketch[h : h + size], percent)
            a.append(rep[h + np.array([i for i, _ in found], np.int64)])
            b.append(rep[h + np.array([j for _, j in found], np.int64)])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        held = None
        for batch in batches:
            wide = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(wide)) + 1), len(wide)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if rest is not None and wide[a] != held:
                    yield edges(*rest)
                    rest = None
                held, part = wide[a], batch.slice(a, b - a)
                now = [c.to_numpy(zero_copy_only=False) for c in part.columns[1:4]]
                now.append(np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint64).reshape(b - a, -1))
                if rest is not None:
                    now = [np.concatenate(x) for x in zip(rest, now)]
                last = int(np.searchsorted(now[0], now[0][-1], side="left"))
                if last:
                    yield edges(*(x[:last] for x in now))
                rest = tuple(x[last:] for x in now)
        if rest is not None:
            yield edges(*rest)

    return run


class Links:
    """Union-find over positions, the least position naming a component."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.parts = n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
            self.parts -= 1
        return i != j

    def names(self) -> np.ndarray:
        flat = self.parent
        while (flat[flat] != flat).any():
            flat = flat[flat]
        self.parent = flat
        return flat


class Index:
    """Inverted lists over sets given in order of size: every (member, set) pair, in that order.

    ``ranks`` holds each set's members as numbers; it stays whole when ``without`` takes sets from the lists. ``sets`` is
    emptied, as an index of a large group takes as much memory again.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(sets)
        sets.clear()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        rank = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]), dtype=np.int32)
        del flat
        self.ranks = np.empty(len(order), np.int32)
        self.ranks[order] = rank
        owner = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)[order]
        del order
        self.keys = rank.astype(np.int64)
        self.keys *= self.n
        self.keys += owner

    def without(self, gone: np.ndarray) -> Index:
        """The same without the sets marked in ``gone``."""
        out = object.__new__(Index)
        out.n, out.sizes, out.offsets, out.ranks = self.n, self.sizes, self.offsets, self.ranks
        out.keys = self.keys[~gone[self.keys % self.n]]
        return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def t_occurrence(index: Index, asked: np.ndarray, percent: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set asked about, set in the index, members shared) of all pairs that reach the threshold and have not one name."""
    size = index.sizes[asked]
    least = needed(size, percent)
    low = np.searchsorted(index.sizes, least, side="left")
    high = np.searchsorted(index.sizes, size * 100 // percent, side="right")
    at = np.repeat(np.arange(len(asked)), size)
    rank = index.ranks[ranges(index.offsets[asked], size)].astype(np.int64) * index.n
    start = np.searchsorted(index.keys, rank + low[at])
    length = np.searchsorted(index.keys, rank + high[at]) - start
    order = np.lexsort((length, at))
    rank, start, length = rank[order], start[order], length[order]
    heads = np.cumsum(size) - size
    longest = length[heads + size - 1]
    aside = np.minimum((least / (SKIP_WEIGHT * np.log2(longest + 1) + 1)).astype(np.int64), least - 1)
    short = np.arange(len(at)) - heads[at] < (size - aside)[at]
    total = np.add.reduceat(np.where(short, length, 0), heads)
    out: list[list[np.ndarray]] = [[], [], []]
    # so many queries at once as the bound on merged entries allows, one at least
    group = np.zeros(len(asked), np.int64)
    room, g = 0, 0
    for i, t in enumerate(total.tolist()):
        if room + t > MERGED and room:
            g, room = g + 1, 0
        room, group[i] = room + t, g
    for g in range(g + 1):
        mine = np.flatnonzero(group == g)
        a, b = heads[mine[0]], heads[mine[-1]] + size[mine[-1]]
        use = np.flatnonzero(short[a:b]) + a
        other = index.keys[ranges(start[use], length[use])] % index.n
        query = np.repeat(at[use], length[use])
        fresh = names[other] != names[asked[query]]
        pair = np.sort(query[fresh] * index.n + other[fresh], kind="stable")
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(pair)))
        query, other = np.divmod(pair[first], index.n)
        # the lists set aside are probed from the shortest on, while there are enough of them left to reach the threshold
        step = 0
        while len(query):
            left = aside[query] - step
            keep = count + np.maximum(left, 0) >= least[query]
            query, other, count, left = query[keep], other[keep], count[keep], left[keep]
            if not (left > 0).any():
                break
            more = np.flatnonzero(left > 0)
            key = rank[heads[query[more]] + size[query[more]] - left[more]] + other[more]
            spot = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
            count[more] += index.keys[spot] == key
            step += 1
        good = 100 * count >= percent * (size[query] + index.sizes[other] - count)
        for into, column in zip(out, (asked[query[good]], other[good], count[good])):
            into.append(column)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def connect(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Name (least position) of each set's component under the threshold. Every set is asked about once, against those
    not asked about before. A component with many sets still to be asked about is finished first, against the sets
    outside it alone, so that copies are not merged again and again. ``sets`` is emptied."""
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    ordered = [sets[i] for i in order]
    sets.clear()
    index = Index(ordered)
    links, names = Links(n), np.arange(n)
    waiting, listed, batch = np.arange(n), n, 1

    def ask(asked: np.ndarray, of: Index) -> int:
        nonlocal names
        found = 0
        part = np.maximum(np.cumsum(of.sizes[asked]) // ASKED_MEMBERS, np.arange(len(asked)) // ASKED)
        for own in np.split(asked, np.flatnonzero(np.diff(part)) + 1):
            left, right, _ = t_occurrence(of, own, percent, names)
            for i, j in zip(left.tolist(), right.tolist()):
                links.join(i, j)
            found += len(left)
            names = links.names() if len(left) else names
        return found

    def others(keep: np.ndarray) -> np.ndarray:
        gone = np.ones(n, bool)
        gone[keep] = False
        return gone

    while len(waiting) and links.parts > 1:
        asked, waiting = waiting[:batch], waiting[batch:]
        found = ask(asked, index)
        batch = min(2 * batch, ASKED) if found <= len(asked) else 1
        count = np.bincount(names[waiting], minlength=1)
        if count.max() >= FOCUS:
            inside = names[waiting] == count.argmax()
            front, waiting = waiting[inside], waiting[~inside]
            index = index.without(others(waiting))
            while len(front) and len(waiting):
                one = front[0]
                ask(front, index)
                inside = names[waiting] == names[one]
                front, waiting = waiting[inside], waiting[~inside]
            index, listed = index.without(others(waiting)), len(waiting)
        elif len(waiting) < listed / 2:
            index, listed = index.without(others(waiting)), len(waiting)
    first = np.full(n, n)
    np.minimum.at(first, names, order)
    out = np.empty(n, np.int64)
    out[order] = first[names]
    return out


def link_groups(size: int, percent: int):
    """Arrow kernel over rows (grp, doc_id, text) in the order of group and doc_id: (doc_id, component) of every row.

    Of a group only its sets are held, eight bytes for each n-gram; texts go as soon as they are read.
    """

    def close(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        names = connect(sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[i] for i in names], pa.int64())], names=["doc_id", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for batch in batches:
            for part in text_slices(batch, "text"):
                groups, docs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for i, kept, _ in sets_of(part, size):
                    if groups[i] != group:
                        if ids:
                            yield close(ids, sets)
                        group, ids, sets = groups[i], [], []
                    ids.append(docs[i])
                    sets.append(kept)
        if ids:
            yield close(ids, sets)

    return run


def link_in(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, component): links among the rows of ``members`` (grp, doc_id) that have one grp. A document may be in
    several; ``component`` is the least doc_id linked to it in one of them."""
    texts = docs.join(members.hint("shuffle_hash"), "doc_id")
    return link_texts(texts, size, percent)


def link_texts(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """As ``link_in``, for rows (grp, doc_id, text)."""
    texts = texts.select("grp", "doc_id", "text").repartition(partitions(texts.sparkSession), "grp").sortWithinPartitions("grp", "doc_id")
    return texts.mapInArrow(link_groups(size, percent), "doc_id long, component long").distinct()


def link_large(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, component) of groups too large for a task, from rows (grp, doc_id, n), n being what a set counts.

    Each block of a group is linked by itself, then one document of each part found, as far as a task holds those. Of a
    link still missing, one end at least is outside its group's largest part: all documents outside it are the queries,
    and in chunks meet every block of their group. What was linked anywhere is joined in the end.
    """
    piece = lambda column, total: F.pmod(F.xxhash64(column, F.lit(3)), F.ceil(total / (GROUP_MEMBERS / 2)))
    totals = members.groupBy("grp").agg(F.sum("n").alias("total"))
    members = materialise(members.join(totals, "grp").withColumn("block", piece("doc_id", F.col("total"))), "large")
    place = lambda *parts: F.xxhash64("grp", *parts)
    within = materialise(link_in(docs, members.select(place("block").alias("grp"), "doc_id"), size, percent), "blocks")
    heads = members.join(within.select(F.col("component").alias("doc_id")).distinct(), "doc_id")
    few = heads.groupBy("grp").agg(F.sum("n").alias("m")).filter(F.col("m") <= GROUP_MEMBERS).select("grp")
    leaders = materialise(link_in(docs, heads.join(few, "grp").select("grp", "doc_id"), size, percent), "leaders")
    named = members.join(within, "doc_id").join(leaders.select(F.col("doc_id").alias("component"), F.col("component").alias("leader")), "component", "left")
    named = materialise(named.select("grp", "block", "doc_id", "n", F.coalesce("leader", "component").alias("part")), "parts")
    largest = named.groupBy("grp", "part").count().groupBy("grp").agg(F.max_by("part", F.struct("count", -F.col("part"))).alias("part"))
    asking = named.join(largest, ["grp", "part"], "left_anti")
    chunks = asking.groupBy("grp").agg(F.sum("n").alias("total"))
    asking = asking.join(chunks, "grp").withColumn("chunk", piece("doc_id", F.col("total")))
    blocks, parts = named.select("grp", "block").distinct(), asking.select("grp", "chunk").distinct()
    meet = asking.join(blocks.withColumnRenamed("block", "into"), "grp").select(place("into", "chunk").alias("at"), "doc_id")
    meet = meet.unionByName(named.join(parts, "grp").select(place("block", "chunk").alias("at"), "doc_id")).distinct()
    asked = link_in(docs, meet.select(F.col("at").alias("grp"), "doc_id"), size, percent)
    pairs = within.unionByName(leaders).unionByName(asked).select(F.col("doc_id").alias("rep"), F.col("component").alias("token"))
    return groups_of(materialise(pairs.distinct(), "links")).select(F.col("rep").alias("doc_id"), F.col("grp").alias("component"))


def groups_of(pairs: DataFrame) -> DataFrame:
    """(rep, token) rows to (rep, grp): least rep reachable over shared tokens. Each round takes the least label of a
    token's holders and then of a holder's tokens, and follows labels one step further; it ends when none changes. Labels
    are small and written every round, so in a file for each core, not for each shuffle partition."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    labels = materialise(pairs.groupBy("rep").agg(F.min("rep").alias("grp")).coalesce(cores), "labels")
    while True:
        by_token = pairs.join(labels, "rep").groupBy("token").agg(F.min("grp").alias("grp"))
        near = pairs.join(by_token, "token").groupBy("rep").agg(F.min("grp").alias("near"))
        far = labels.select(F.col("rep").alias("near"), F.col("grp").alias("far"))
        new = labels.join(near, "rep").join(far, "near").select("rep", F.least("far", "near").alias("grp"), (F.least("far", "near") < F.col("grp")).alias("moved"))
        new = materialise(new.coalesce(cores), "labels")
        release(labels)
        if not new.filter("moved").limit(1).count():
            return new.select("rep", "grp")
        labels = new.select("rep", "grp")


def component_ids(df: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``df``; ``percent`` is the Jaccard threshold."""
    return settled(df.sparkSession, "components", lambda: named_components(df, size, percent))


def named_components(df: DataFrame, size: int, percent: int) -> DataFrame:
    """As ``component_ids``, computed from tables that stay. Those as large as a part of the corpus go when they are used up."""
    spark = df.sparkSession
    docs = id_text(df)
    anonymous = docs.filter("doc_id is null").limit(1).count() > 0
    # rows without id go by a hash of their text, and have no mark
    marked = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("named"))
    docs = marked.drop("named")

    def classes(frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """Size and sum of every row's set; size, sketches and prefix of every class's."""
        sig = materialise(marked.mapInArrow(signatures(size, percent, frequent), SIG), "signatures")
        thin = materialise(sig.drop("views", "prefix"), "sums")
        own = F.any_value(F.struct("views", "prefix")).alias("own")
        reps = sig.filter("n > 0").groupBy("n", "sum_a", "sum_b").agg(F.min("doc_id").alias("rep"), own).select("rep", "n", "own.*")
        reps = materialise(reps, "classes")
        release(sig)
        return thin, reps

    def holders_of(prefixes: DataFrame) -> DataFrame:
        return materialise(prefixes.groupBy("token").count().filter("count > 1"), "counts")

    thin, reps = classes(np.zeros(0, np.uint64))
    prefixes = reps.select("rep", F.explode("prefix").alias("token"))
    counts = holders_of(prefixes)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = counts.filter(F.col("count") >= max(FREQUENT, total // FREQUENT_KEPT)).select("token")
    frequent = np.sort(often.toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    if len(frequent):
        # a prefix without a frequent n-gram stays the same when those go last
        again = materialise(prefixes.join(F.broadcast(often), "token", "left_semi").select("rep").distinct(), "again")
        if again.limit(READ_AGAIN + 1).count() <= READ_AGAIN:
            ids = again.toPandas()["rep"].to_numpy(np.int64)
            second = marked.mapInArrow(signatures(size, percent, frequent, ids), SIG).select(F.col("doc_id").alias("rep"), F.explode("prefix").alias("token"))
            prefixes = materialise(prefixes.join(F.broadcast(again), "rep", "left_anti").unionByName(second.distinct()), "prefixes")
        else:
            release(reps, thin)
            thin, reps = classes(frequent)
            prefixes = materialise(reps.select("rep", F.explode("prefix").alias("token")), "prefixes")
        release(counts)
        large = [prefixes, reps]
        reps = materialise(reps.drop("prefix"), "sketches")
        release(large.pop())
        counts = holders_of(prefixes)
    else:
        large = [reps]
        reps = materialise(reps.drop("prefix"), "sketches")
    # tokens of one holder go before the sketches are added: most of a prefix is its document's own
    shared = materialise(prefixes.join(counts.filter(F.col("count") <= HOLDERS).select("token"), "token", "left_semi"), "shared")
    crowded = counts.filter(F.col("count") > HOLDERS).select("token")
    held = materialise(prefixes.join(crowded, "token"), "crowded") if crowded.limit(1).count() else None
    release(*large)
    # tokens with the same holders lead to the same edges, so one of them does: sketches travel once for each list of holders
    lists = shared.groupBy("token").agg(F.sort_array(F.collect_list("rep")).alias("reps")).groupBy("reps").agg(F.min("token").alias("token"))
    shared = lists.select("token", F.explode("reps").alias("rep")).groupBy("rep").agg(F.collect_list("token").alias("shared"))
    holders = reps.select("rep", "n", F.explode("views").alias("v")).join(shared, "rep")
    holders = holders.select("v.wide", F.explode("shared").alias("token"), "rep", "n", "v.sketch")
    holders = holders.repartition(partitions(spark), "token").sortWithinPartitions("wide", "token")
    edges = holders.mapInArrow(edges_of(percent), "a long, b long").distinct()
    if held is not None:
        edges = edges.unionByName(held.join(held.groupBy("token").agg(F.min("rep").alias("a")), "token").select("a", F.col("rep").alias("b")).filter("a != b").distinct())
    edges = materialise(edges, "edges")
    # each edge's lesser end stands for a token that both ends hold
    pairs = edges.select(F.col("b").alias("rep"), F.col("a").alias("token")).unionByName(edges.select(F.col("a").alias("rep"), F.col("a").alias("token")).distinct())
    weight = (F.col("n") + SET_COST).alias("n")
    grouped = groups_of(pairs).join(reps.select("rep", weight), "rep").select("grp", F.col("rep").alias("doc_id"), "n")
    large = grouped.groupBy("grp").agg(F.sum("n").alias("m")).filter(F.col("m") > GROUP_MEMBERS).select("grp")
    if large.limit(1).count():
        # the corpus is shuffled once for all that follows: large groups read the texts of their own members again, not all
        grouped = grouped.join(large.withColumn("large", F.lit(True)), "grp", "left").select("grp", "doc_id", "n", F.coalesce("large", F.lit(False)).alias("large"))
        texts = materialise(docs.join(grouped.hint("shuffle_hash"), "doc_id"), "grouped")
        members = texts.filter("large")
        linked = link_texts(texts.filter("not large"), size, percent)
        linked = linked.unionByName(link_large(members.select("doc_id", "text"), members.select("grp", "doc_id", "n").distinct(), size, percent))
    else:
        linked = link_in(docs, grouped.select("grp", "doc_id"), size, percent)
    linked = linked.select(F.col("doc_id").alias("rep"), "component").distinct()
    named = thin.filter("n > 0").groupBy("n", "sum_a", "sum_b").agg(F.min("doc_id").alias("rep")).join(linked, "rep", "left")
    named = named.select("n", "sum_a", "sum_b", F.coalesce("component", "rep").alias("component"))
    out = thin.join(named, ["n", "sum_a", "sum_b"], "left").select("doc_id", "named", "n", "component")
    if anonymous:  # components are named by the ids that there are
        out = materialise(out, "unnamed")
        names = out.filter("named and n > 0").groupBy("component").agg(F.min("doc_id").alias("name"))
        out = out.join(names, "component", "left").withColumn("component", F.col("name"))
    own = F.when(F.col("named"), F.col("doc_id"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(own).alias("component_id"))
