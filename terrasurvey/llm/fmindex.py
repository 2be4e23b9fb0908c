"""Substring dedup with a compressed FM-index per shard and matching statistics of streamed documents."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Segments of one shard, about.
SHARD = 20_000
#: Segments of one gram beyond which its windows are dealt out one by one.
HOT = 20_000
#: Documents up to which these numbers are counted over all of them.
WHOLE = 20_000
#: Bytes of text that are hashed at once, about.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Base of the polynomial word hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class WaveletTree:
    """Ranks in a sequence of symbols: one bit vector for each bit of the symbols, with counts of ones before each 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        n = len(symbols)
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            words = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed = np.packbits(ones, bitorder="little")
            words[: len(packed)] = packed
            words = words.view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
            self.levels.append((words, before, n - int(ones.sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))  # zeros first: the next level's order

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place of the sequence falls among those of the symbol, counted from where the symbol's run begins for place 0."""
        for level, (words, before, zeros) in enumerate(self.levels):
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.bits - 1 - level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place given with it."""
        return self.place(symbol, at) - self.place(symbol, np.zeros_like(at))


class FMIndex:
    """An FM-index of texts of words, their suffixes sorted as far as `depth` words: it matches runs of at most so many.

    flat: the texts' words as numbers from 0, one text after the other; owners: the owner of each text, as a number. Beside the
    wavelet tree of the Burrows-Wheeler transform there are the least owners of runs of suffixes, and, for each length below depth, the
    runs of suffixes that agree in so many words: from these a match is shortened at its right end.
    """

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, owners: np.ndarray, depth: int):
        self.depth = depth
        ends = np.cumsum(lengths + 1) - 1
        whole = np.zeros(int(lengths.sum()) + len(lengths), np.int64)  # symbol 0 ends each text
        inside = np.ones(len(whole), bool)
        inside[ends] = False
        whole[inside] = flat + 1
        self.n, sigma = len(whole), int(whole.max()) + 1
        rank, done, order = whole.copy(), 1, np.argsort(whole)
        while done < depth:  # prefix doubling
            ahead = np.concatenate((rank[done:], np.full(min(done, self.n), -1)))[: self.n]
            pair = rank * (int(rank.max()) + 2) + ahead + 1
            order = np.argsort(pair)
            ranked = pair[order]
            rank = np.empty_like(rank)
            rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            done *= 2
        self.tree = WaveletTree(whole[order - 1], max(1, (sigma - 1).bit_length()))
        symbols = np.arange(sigma)
        before = np.concatenate(([0], np.cumsum(np.bincount(whole, minlength=sigma))))[:-1]
        self.shift = before - self.tree.place(symbols, np.zeros(sigma, np.int64))
        # how many words neighbouring suffixes share, and the runs that share so many
        shared, same = np.zeros(self.n + 1, np.int8), np.ones(self.n - 1, bool)
        padded = np.concatenate((whole, np.zeros(depth, np.int64)))
        for k in range(depth - 1):
            x = padded[order + k]
            same &= (x[1:] == x[:-1]) & (x[1:] > 0)
            shared[1:-1] += same
        self.shared = shared
        places = np.arange(self.n + 1, dtype=np.int32)
        self.run_from, self.run_to = np.zeros((depth, self.n + 1), np.int32), np.full((depth, self.n + 1), self.n, np.int32)
        for k in range(1, depth):
            edge = shared < k
            self.run_from[k] = np.maximum.accumulate(np.where(edge, places, 0))
            self.run_to[k][::-1] = np.minimum.accumulate(np.where(edge, places, self.n)[::-1])
        # owners of the suffixes, and the least of each run of 2^i of them
        self.least = [np.repeat(owners.astype(np.int32), lengths + 1)[order]]
        while 2 ** len(self.least) <= self.n:
            x, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(x[:-half], x[half:]))

    def extended(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of suffixes of the matches with a word more at their left ends: one step of backward search."""
        symbol = words + 1
        both = self.tree.place(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return both[: len(low)] + self.shift[symbol], both[len(low) :] + self.shift[symbol]

    def first_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner of the suffixes in each run."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            x = self.least[k]
            out[at] = np.minimum(x[low[at]], x[high[at] - 2**k])
        return out

    def matching_statistics(self, flat: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """For each word of the streamed texts: how many words from it on, at most depth, also stand in a text of a smaller owner.

        All texts are streamed side by side, word by word from the right. A text's match is a run of suffixes. A word is put before it by backward
        search; where the longer match is in no text of a smaller owner, the match is shortened at its right end until it
        stands for other suffixes, and the word is tried again. Matches of depth words are shortened by one before the next word.
        """
        out = np.zeros(len(flat), np.int16)
        begins = np.cumsum(lengths) - lengths
        low, high, length = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n), np.zeros(len(lengths), np.int64)
        at = begins + lengths - 1  # each text's next word
        live = np.flatnonzero(lengths > 0)
        while len(live):
            a, b, n = low[live], high[live], length[live]
            full = n == self.depth
            n[full] -= 1
            a[full], b[full] = self.run_from[n[full], a[full]], self.run_to[n[full], b[full]]
            x, y = self.extended(flat[at[live]], a, b)
            good = x < y
            good[good] = self.first_owner(x[good], y[good]) < owners[live[good]]
            hit = live[good]
            low[hit], high[hit], length[hit] = x[good], y[good], n[good] + 1
            out[at[hit]] = length[hit]
            miss, a, b, n = live[~good], a[~good], b[~good], n[~good]
            none = n == 0
            # a shorter match that stands for more suffixes: as many words as the run shares with a neighbour
            n = np.maximum(self.shared[a], self.shared[b]).astype(np.int64)
            low[miss], high[miss], length[miss] = self.run_from[n, a], self.run_to[n, b], n
            at[hit] -= 1
            at[miss[none]] -= 1
            live = live[at[live] >= begins[live]]
        return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWERS = {BASE: powers(BASE, 0), INVERSE: powers(INVERSE, 0)}


def power(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64; those of one chunk are kept."""
    if n > CHUNK + (CHUNK >> 2):
        return powers(base, n)
    if len(POWERS[base]) < n:
        POWERS[base] = powers(base, CHUNK + (CHUNK >> 2))
    return POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sums(x: np.ndarray) -> np.ndarray:
    """The sum before each number, and of all, modulo 2^64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, first word of each text and the end of all); null texts have no words.

    Words are runs of anything but ASCII white space. A word's hash is a polynomial of its bytes, taken from running sums over the whole buffer.
    """
    raw = pa.concat_arrays([pc.fill_null(texts, b"")]) if texts.null_count or texts.offset else texts
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_binary(raw.type) else np.int32
    edges = np.frombuffer(raw.buffers()[1], width, len(raw) + 1, raw.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    out, counts, done, at = [], np.zeros(len(raw) + 1, np.int64), 0, 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data) and not (SPACE[data[to - 1]] or SPACE[data[to]]):  # never within a word
            step = np.flatnonzero(SPACE[data[to : to + CHUNK]])
            to = to + int(step[0]) if len(step) else min(to + CHUNK, len(data))
        part = data[at:to]
        inside = ~SPACE[part]
        apart = np.zeros(len(part) + 1, bool)  # places before which a text begins
        here = edges[np.searchsorted(edges, at, "left") : np.searchsorted(edges, to, "right")] - at
        apart[here] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | apart[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | apart[1:-1]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = sums((part.astype(np.uint64) + np.uint64(1)) * power(BASE, len(part)))
        out.append(mixed((total[last] - total[first]) * power(INVERSE, len(part))[first]))
        inner = np.searchsorted(edges, at, "left"), np.searchsorted(edges, to, "right")
        counts[inner[0] : inner[1]] = done + np.searchsorted(first, edges[inner[0] : inner[1]] - at, "left")
        done += len(first)
        at = to
    counts[np.searchsorted(edges, len(data), "left") :] = done
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def in_parts(texts: pa.Array, most: int = 8 << 20):
    """(first row, rows) of parts of about so many bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to - at
        at = to


def selected(hashes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, place of the selected gram, its hash) of every window of `window` words within a text.

    Grams have two thirds of a window's words: long enough to seldom repeat by chance. Of a window's grams the one with the least hash is selected,
    the last of equal ones, so that places never go back.
    """
    length = max(1, 2 * window // 3)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(len(hashes) - length + 1, np.uint64)
    for j in range(length):
        gram *= np.uint64(BASE)
        gram += hashes[j : j + len(gram)]
    gram = mixed(gram)
    least, ahead = gram[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - length + 1):
        x = gram[j : j + n]
        lower = x <= least
        np.copyto(least, x, where=lower)
        np.copyto(ahead, np.int8(j), where=lower)
    text = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    return inside, inside + ahead[inside], least[inside]


def firsts_of(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def grams_of(window: int):
    """Rows (slot, doc_key, place, kind) of the selected grams of documents, brought together by slot.

    Within a batch of documents a gram that several of them have is known to be repeated: its places pass on as they are (kind 2, dealt out
    evenly), and one row stands for it (kind 1). A gram of one document goes as a row for each place (kind 0). So a
    gram that very many documents have gives a row for each batch only.
    """

    def run(batches):
        for batch in batches:
            for at, n in in_parts(batch.column(1)):
                yield some(batch.column(0).slice(at, n).to_numpy(), batch.column(1).slice(at, n))

    def some(keys, texts):
        hashes, ends = hashed_words(texts)
        _, place, gram = selected(hashes, ends, window)
        at = firsts_of(place)
        place, gram = place[at], gram[at].view(np.int64)
        doc = np.searchsorted(ends, place, "right") - 1
        order = np.argsort(gram, kind="stable")
        gram, place, doc = gram[order], place[order], doc[order]
        starts = firsts_of(gram)
        several = np.zeros(len(gram), bool)
        if len(gram):
            sizes = np.diff(np.concatenate((starts, [len(gram)])))
            several = np.repeat(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), sizes)
        key, local = keys[doc], (place - ends[doc]).astype(np.int32)
        slot = np.where(several, gram ^ key, gram)
        ones = starts[several[starts]]
        kind = np.concatenate((np.where(several, 2, 0), np.ones(len(ones)))).astype(np.int8)
        columns = [np.concatenate((slot, gram[ones])), np.concatenate((key, key[ones])), np.concatenate((local, local[ones])), kind]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "doc_key", "place", "kind"])

    return run


def repeated_places(batches):
    """(doc_key, place) of grams that more than one document has, from rows sorted by slot."""
    kept = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = columns if kept is None else [np.concatenate(x) for x in zip(kept, columns, strict=True)]
        slot = columns[0]
        if not len(slot):
            continue
        end = int(np.searchsorted(slot, slot[-1], "left"))  # the last slot may go on
        if end:
            yield repeats_in([c[:end] for c in columns])
        kept = [c[end:] for c in columns]
    if kept is not None:
        yield repeats_in(kept)


def repeats_in(columns: list[np.ndarray]) -> pa.RecordBatch:
    slot, key, place, kind = columns
    counted = kind < 2
    out = [key[~counted]], [place[~counted]]
    slot, key, place, kind = (c[counted] for c in columns)
    if len(slot):
        starts = firsts_of(slot)
        sizes = np.diff(np.concatenate((starts, [len(slot)])))
        known = (np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)) | (np.maximum.reduceat(kind, starts) > 0)
        single = np.repeat(known, sizes) & (kind == 0)
        out[0].append(key[single])
        out[1].append(place[single])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["doc_key", "place"])


def ranked(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, whatever their type."""
    return pc.rank(ids, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, kind))


def segments_of(window: int, kind: pa.DataType):
    """Rows (gram, content, doc, doc_key, starts, windows) of the texts around repeated grams.

    A segment is the run of windows that select one gram at one place, its content their words' hashes. Of equal segments in a batch, those of
    the smallest doc_id are to be searched; for the others it is plain that they are repeats: they pass on without content.
    """
    fields = ["gram", "content", "doc", "doc_key", "starts", "windows"]

    def run(batches):
        for batch in batches:
            for at, n in in_parts(batch.column(2)):
                yield some(*(batch.column(i).slice(at, n) for i in range(4)))

    def some(docs, keys, texts, places):
        hashes, ends = hashed_words(texts)
        first, place, gram = selected(hashes, ends, window)
        repeated = np.zeros(len(hashes) + 1, bool)
        repeated[places.flatten().to_numpy() + np.repeat(ends[:-1], places.value_lengths().to_numpy())] = True
        wanted = repeated[place]
        first, place, gram = first[wanted], place[wanted], gram[wanted].view(np.int64)
        cuts = firsts_of(place)
        windows = np.diff(np.concatenate((cuts, [len(place)])))
        first, gram = first[cuts], gram[cuts]
        owner = np.searchsorted(ends, first, "right") - 1
        # a hash of each segment, from running sums like those of the words
        total = sums(hashes * powers(BASE, len(hashes)))
        content = mixed((total[first + windows + window - 1] - total[first]) * powers(INVERSE, len(hashes))[first]) + windows.astype(np.uint64)
        rank = ranked(docs)[owner]
        order = np.lexsort((first, owner, rank, content))
        content, rank, owner, first, gram, windows = (x[order] for x in (content, rank, owner, first, gram, windows))
        groups = firsts_of(content)
        of_least = rank == np.repeat(rank[groups], np.diff(np.concatenate((groups, [len(content)]))))
        if len(content):
            rows = np.flatnonzero(np.concatenate(([True], (content[1:] != content[:-1]) | (owner[1:] != owner[:-1]))))
        else:
            rows = np.zeros(0, np.int64)
        n = np.diff(np.concatenate((rows, [len(content)])))
        starts = lists(first - ends[owner], n, pa.int32())
        # the words of the segments that are to be searched
        size = np.where(of_least[rows], windows[rows] + window - 1, 0)
        edges = np.concatenate(([0], np.cumsum(size)))
        flat = hashes[np.repeat(first[rows] - edges[:-1], size) + np.arange(edges[-1])]
        missing = pa.array(np.packbits(of_least[rows], bitorder="little"))
        words = pa.Array.from_buffers(pa.binary(), len(rows), [missing.buffers()[1], pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(flat)])
        who = pa.array(owner[rows])
        columns = [pa.array(gram[rows]), words, docs.take(who), keys.take(who), starts, pa.array(windows[rows].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, fields)

    return run


def repeated_windows(contents: pa.Array, owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, first window, windows) of runs of windows of distinct contents that also stand in a content of a smaller owner."""
    lengths = pc.binary_length(contents).to_numpy().astype(np.int64) // 8
    whole = pa.concat_arrays([contents])
    edges = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, whole.offset * 4)
    hashes = np.frombuffer(whole.buffers()[2], np.uint8)[edges[0] : edges[-1]].view("<u8")
    flat = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    index = FMIndex(flat, lengths, owners, window)
    again = index.matching_statistics(flat, lengths, owners) >= window
    ends = np.cumsum(lengths)
    apart = np.zeros(len(again) + 1, bool)
    apart[0] = apart[ends] = True  # no run goes on from one content to the next
    begin = np.flatnonzero(again & (apart[:-1] | np.concatenate(([True], ~again[:-1]))))
    end = np.flatnonzero(again & (apart[1:] | np.concatenate((~again[1:], [True])))) + 1
    text = np.searchsorted(ends, begin, "right")
    return text, begin - (ends - lengths)[text], end - begin


def shard_search(window: int):
    """(doc_key, start, windows) of runs of windows that a smaller doc_id has as well, from the segments of one shard."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = lambda name: rows[name].chunk(0) if rows[name].num_chunks else rows[name].combine_chunks()
        content, keys, windows, starts = column("content"), column("doc_key").to_numpy(), column("windows").to_numpy().astype(np.int64), column("starts")
        asked = np.flatnonzero(~content.is_null().to_numpy(zero_copy_only=False))
        plain = np.flatnonzero(content.is_null().to_numpy(zero_copy_only=False))
        row, first, n = [plain], [np.zeros(len(plain), np.int64)], [windows[plain]]
        if len(asked):
            coded = content.take(pa.array(asked)).dictionary_encode()
            of, rank = coded.indices.to_numpy().astype(np.int64), ranked(column("doc").take(pa.array(asked)))
            owners = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(owners, of, rank)
            # documents after the first one with the same content repeat all of it; the first one's is streamed through the index
            later = rank > owners[of]
            row.append(asked[later])
            first.append(np.zeros(later.sum(), np.int64))
            n.append(windows[asked[later]])
            text, begin, length = repeated_windows(coded.dictionary, owners, window)
            found = np.bincount(text, minlength=len(owners))
            place = np.cumsum(found) - found
            mine = np.flatnonzero(~later)
            runs = found[of[mine]]
            each = np.repeat(place[of[mine]] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            row.append(np.repeat(asked[mine], runs))
            first.append(begin[each])
            n.append(length[each])
        row, first, n = np.concatenate(row), np.concatenate(first), np.concatenate(n)
        begins = starts.take(pa.array(row))
        times = begins.value_lengths().to_numpy()
        at = begins.flatten().to_numpy() + np.repeat(first, times)
        arrays = [pa.array(np.repeat(keys[row], times)), pa.array(at.astype(np.int32)), pa.array(np.repeat(n, times).astype(np.int32))]
        return pa.table(arrays, names=["doc_key", "start", "windows"])

    return run


def removed_runs(docs: DataFrame, window: int) -> DataFrame:
    """(doc_key, start, windows) of the runs of windows that go."""
    kind = docs.schema["doc_id"].dataType
    keyed = docs.where("doc_id is not null").select(F.xxhash64("doc_id", "text").alias("doc_key"), F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("raw"))
    grams = keyed.select("doc_key", "raw").mapInArrow(grams_of(window), "slot long, doc_key long, place int, kind byte")
    places = grams.repartition("slot").sortWithinPartitions("slot").mapInArrow(repeated_places, "doc_key long, place int")
    by_doc = places.groupBy("doc_key").agg(F.collect_set("place").alias("places"))
    met = stored(keyed.join(by_doc, "doc_key").select("doc", "doc_key", "raw", "places"))
    fields = f"gram long, content binary, doc {kind.simpleString()}, doc_key long, starts array<int>, windows int"
    segments = met.mapInArrow(segments_of(window, kind), fields)
    # how many shards there are, and which grams are dealt out by window, only shapes the work: large tables are judged by a part of their documents
    part = 1 if met.count() <= WHOLE else 16
    some = met.where(F.pmod("doc_key", F.lit(part)) == 0).mapInArrow(segments_of(window, kind), fields)
    counts = stored(some.groupBy("gram").agg(F.count("*").alias("all"), F.count("content").alias("count")))
    total = counts.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0] * part
    hot = counts.where(F.col("count") * part > HOT).select("gram", F.lit(True).alias("hot"))
    n_hot = hot.count()
    shards = max(1, total // SHARD)
    if n_hot:
        # windows of a gram with very many different surroundings are dealt out by what they hold
        segments = segments.join(F.broadcast(hot) if n_hot <= 10_000 else hot, "gram", "left")
        cold = F.col("hot").isNull() | F.col("content").isNull()
        each = F.when(cold, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("windows") - 1))
        segments = segments.withColumn("i", F.explode(each))
        one = F.expr(f"substring(content, 8 * i + 1, {8 * window})")
        segments = segments.select(
            F.when(F.col("i") < 0, F.col("gram")).otherwise(F.xxhash64(one)).alias("gram"),
            F.when(F.col("i") < 0, F.col("content")).otherwise(one).alias("content"),
            "doc",
            "doc_key",
            F.when(F.col("i") < 0, F.col("starts")).otherwise(F.transform("starts", lambda s: s + F.col("i"))).alias("starts"),
            F.when(F.col("i") < 0, F.col("windows")).otherwise(F.lit(1)).alias("windows"),
        )
    dealt = F.when(F.col("content").isNull(), F.xxhash64("doc_key")).otherwise(F.xxhash64("gram"))
    return segments.withColumn("shard", F.pmod(dealt, F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(shard_search(window), "doc_key long, start int, windows int")


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs' (doc_id, n_words, n_removed, kept): texts, as words joined by one space, without windows that a smaller doc_id has as well.

    A word goes if one of the windows of `window` words that cover it also stands in a document with a smaller doc_id; windows are those of the
    input. Every window selects the gram with the least hash among its grams, so equal windows select equal grams: only windows
    whose gram occurs in other documents are looked at, and the parts of documents around them meet in the shard of this gram. Each shard
    builds one compressed FM-index of them and streams them through it, word by word: backward search over the wavelet tree puts a word before the
    match, a match that no smaller doc_id has is shortened at its other end, and the lengths are the matching statistics of the
    document against all smaller doc_ids of the shard. Intervals in which they reach the window are reported. Equal parts are streamed
    once, and windows of grams with very many surroundings are dealt out one by one. Words are compared by 64-bit hashes.

    Null and blank texts and null doc_ids are compared with nothing and lose nothing (null: no words); very long texts are searched whole; rows with one
    doc_id don't lose words to each other; equal rows get equal results; an empty table gives no rows; other columns don't matter.
    """
    found = removed_runs(docs, window)
    runs = found.groupBy("doc_key").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    key = F.xxhash64("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text", key.alias("doc_key")).join(stored(runs), "doc_key", "left")

    def run(batches):
        for batch in batches:
            counts, gone, kept = [], [], []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (raw or b"").split()
                out = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    out[s["start"]] += 1
                    out[s["start"] + s["windows"] + window - 1] -= 1
                stay = np.cumsum(out)[:-1] == 0
                counts.append(len(words))
                gone.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(words if not spans else [w for w, x in zip(words, stay, strict=True) if x]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", F.col("text").cast("binary"), "runs").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS content FROM starts
), firsts AS (
  SELECT content, min(doc_id) AS first FROM windows GROUP BY content HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (content) WHERE first < doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words
), kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.x, ' ' ORDER BY p.i) AS text FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
  WHERE g.i IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - COALESCE(k.n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
