"""Document fingerprints by one-permutation min-hashing: packed low bits of densified bins, and likeness with its bias taken out."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: A fingerprint has so many bins of so many bits each; a shingle has so many words.
BINS, BITS, SHINGLE = 1024, 4, 5
#: An odd number whose powers weigh the bytes of a word, and the two of the mixing function.
BASE, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number hashed."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Fingerprints of texts. It keeps powers of BASE as long as the longest text, and for each bin an order of all bins."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.places = np.arange(bins, dtype=np.uint64) * BASE
        rng = np.random.default_rng(42)
        self.order = np.array([rng.permutation(bins) for _ in range(bins)], np.int16)
        self.rank = np.argsort(self.order, axis=1).astype(np.int16)

    def hashes(self, text: bytes) -> np.ndarray:
        """Hashes of a text's distinct runs of `shingle` words; fewer words are one run; none have no hash."""
        raw = np.frombuffer(text, np.uint8)
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = turns[::2], turns[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        words = np.concatenate([self.words(raw, starts[a:b], ends[a:b]) for a, b in self.pieces(starts)])
        m = min(self.shingle, len(words))
        total = np.zeros(len(words) - m + 1, np.uint64)
        for i in range(m):
            total = mixed(total * BASE + words[i : i + len(total)] + np.uint64(1))
        return np.unique(total)

    def pieces(self, starts: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
        """The words, as (first, end), that begin within each megabyte: a very long text takes no more memory than its words."""
        cuts = [0, *(np.flatnonzero(np.diff(starts // size)) + 1).tolist(), len(starts)]
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word: its bytes times falling powers, taken from one running sum over them all."""
        begin, n = starts[0], int(ends[-1] - starts[0])
        if len(self.powers) <= n:
            grow = lambda x: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))))
            self.powers, self.inverse = grow(BASE), grow(np.uint64(pow(int(BASE), -1, 1 << 64)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[begin : begin + n].astype(np.uint64) + np.uint64(1)) * self.powers[n - 1 :: -1][:n], out=sums[1:])
        # the weight of a word's place is taken off
        return mixed((sums[ends - begin] - sums[starts - begin]) * self.inverse[n - (ends - begin)])

    def values(self, hashes: np.ndarray) -> np.ndarray | None:
        """The low bits of each bin: of its least hash, and in an empty bin of that of the first full bin in the bin's own order.

        A hash is mixed with its bin before its low bits are taken, so that two texts of one shingle each differ in the usual share of their bins.
        """
        if not len(hashes):
            return None
        # sorted hashes: the upper part names the bin, so each bin's least hash comes first
        bin_of = (hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
        full = bin_of[first].astype(np.int64)
        held = np.zeros(self.bins, np.uint64)
        held[full] = hashes[first]
        taken = np.zeros(self.bins, bool)
        taken[full] = True
        empty = np.flatnonzero(~taken)
        if len(full) <= 32:
            held[empty] = held[full[np.argmin(self.rank[np.ix_(empty, full)], axis=1)]]
            empty = empty[:0]
        at, step = 0, 32
        while len(empty):
            tried = self.order[empty, at : at + step]
            hit = taken[tried]
            found = hit.any(axis=1)
            held[empty[found]] = held[tried[found, np.argmax(hit[found], axis=1)]]
            empty, at = empty[~found], at + step
        return (mixed(held + self.places) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def fingerprint(self, text: str) -> bytes:
        """The packed bins; empty for a text without words."""
        low = self.values(self.hashes(text.encode()))
        if low is None:
            return b""
        return np.packbits((low[:, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8)) & 1).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """The estimate of the similarity of two texts' sets of shingles: the share of equal bins, without those that are equal by chance.

        Two texts without words are alike, and not like any other.
        """
        if not a or not b:
            return float(a == b)
        apart = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, self.bits).any(axis=1)
        chance = 0.5**self.bits
        return float(max(0.0, (1 - apart.mean() - chance) / (1 - chance)))


def with_fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """docs with `fingerprint` (binary), made where a text is read; nothing moves. Null texts are empty; see Hasher for texts without words."""
    (name,) = fresh(docs.columns, "fingerprint")
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"{name} binary"])
    at = docs.columns.index("text")

    def run(batches):
        hasher = Hasher(bins, bits, shingle)
        for batch in batches:
            made = pa.array([hasher.fingerprint(t or "") for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, fields)


def edited(text: str, follower: str) -> str:
    """text with its last quarter replaced by as much, or all, of the beginning of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + follower[:cut]


#: Rows that a range of the ids has, and the most ranges: the driver holds the first id of each.
RANGE_ROWS, MOST_RANGES = 5_000, 100_000


def in_order(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(_range, _guest, doc_id, hash, text): docs dealt to ranges of (doc_id, hash of the text), each sorted in one partition, with the first row of the next one as a guest at its end.

    The first row of all is the guest of the last range. The ids alone are read first, for where ranges begin.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = docs.count()
    n = max(1, min(MOST_RANGES, -(-total // rows)))
    order = [F.asc_nulls_first("doc_id"), F.asc("hash")]
    keys = keyed.select("doc_id", "hash").repartitionByRange(n, *order)
    first = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash")).alias("k")).select("k.*").collect()
    begins = sorted((r["named"], r["doc_id"] if r["named"] else 0, r["hash"]) for r in first)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spread = docs.sparkSession.sparkContext.broadcast(begins)

    def deal(batches: Iterator[pa.RecordBatch]):
        from bisect import bisect_right

        starts = spread.value
        for batch in batches:
            take, ranges, guests = [], [], []
            for i, (key, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = (key is not None, key if key is not None else 0, h)
                at = bisect_right(starts, own) - 1
                take.append(i)
                ranges.append(at)
                guests.append(0)
                if starts[at] == own:
                    take.append(i)
                    ranges.append((at - 1) % len(starts))
                    guests.append(1)
            chosen = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(guests, pa.int32()), *chosen.columns], names=["_range", "_guest", *chosen.schema.names])

    dealt = keyed.mapInArrow(deal, f"_range int, _guest int, doc_id {kind}, hash long, text string")
    return dealt.repartition(len(begins) or 1, "_range").sortWithinPartitions("_range", "_guest", *order, "text")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike it, the edit and the next document are.

    The next document is that with the next doc_id (null first); texts of one doc_id follow each other in the order of a hash, rows of equal id and
    text are one document that is returned as often as it occurs; after the last comes the first, and a document alone is followed by itself.
    Null texts are empty; a text without words has an empty fingerprint, one with fewer than five is one shingle; very long texts are hashed
    whole; an empty table gives no rows; further columns don't matter.
    """
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher, last, out = Hasher(), None, []

        def rows(at, follower):
            """The rows of the document at hand, once the next one is known."""
            _, key, _, text, own, times = at
            new = edited(text, follower[3])
            mark = hasher.fingerprint(new)
            row = (key, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), mark.hex(), hasher.likeness(own, mark), hasher.likeness(own, follower[4]))
            return [row] * times

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            for span, guest, key, h, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if last and (last[0], last[1], last[2], last[3]) == (span, key, h, text) and not guest:
                    last[5] += 1
                    continue
                if guest and (not last or last[0] != span):
                    continue
                at = [span, key, h, text, hasher.fingerprint(text), 1]
                if last and last[0] == span:
                    out += rows(last, at)
                last = None if guest else at
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    fields = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, fields)
