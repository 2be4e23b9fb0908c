"""Near copies by word shingles: pairs of texts that share most of their shingles, found by SimHash and, where fingerprints are too far apart, by
min-hash bands; all are checked exactly."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import stored
from .graph import components
from .simhash import near_links, print_of

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: all but 3 in a million at 0.8.
BANDS, ROWS = 32, 5
#: Groups of more texts than this are split over several tasks.
SPLIT = 10_000


def normal(raw: bytes | None) -> bytes:
    """A text's words, A-Z lower-cased, with one space between them."""
    return b" ".join((raw or b"").lower().split())


def shingles(joined: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes, sorted, of the runs of so many words; a text of fewer words is one run."""
    words = joined.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    return np.unique(np.array([xxh64_intdigest(joined[a:b]) for a, b in zip(starts, last, strict=False)], np.uint64))


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band: the least values of ROWS random functions of the hashes, hashed together."""
    rng = np.random.default_rng(42)
    factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        x = values[at : at + 2048, None] * factors + offsets
        # a product alone keeps the order of multiples of a power of two: the upper half is mixed into the lower
        x = (x ^ (x >> np.uint64(32))) * factors
        least = np.minimum(least, x.min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def with_bands(docs: DataFrame, key: str, shingle: int) -> DataFrame:
    """(key, _class, _fp, _bands): a hash of each text's words, the SimHash fingerprint of its shingles, and its band keys."""

    def run(batches):
        for batch in batches:
            classes, prints, keys = [], [], []
            for raw in batch.column(1).to_pylist():
                joined = normal(raw)
                classes.append(xxh64_intdigest(joined) - (1 << 63))
                values = shingles(joined, shingle)
                prints.append(print_of(values))
                keys.append(band_keys(values))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int64()), pa.array(prints, pa.int64()), lists], [key, "_class", "_fp", "_bands"])

    schema = StructType([docs.schema[key], StructField("_class", LongType()), StructField("_fp", LongType()), StructField("_bands", ArrayType(LongType()))])
    return docs.select(key, F.col("text").cast("binary")).mapInArrow(run, schema)


def linked(classes: list[int], sets: list[np.ndarray], least: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets of one group whose similarity is `least` or more: fewer than there are sets.

    known: sets of equal numbers are linked already; they are not compared with each other, and links between them are left out.
    """
    known = known or list(range(len(sets)))
    members = defaultdict(list)
    for i, k in enumerate(known):
        members[k].append(i)
    out, left = [], list(range(len(sets)))
    while left:
        queue = list(members[known[left[0]]])
        left = [y for y in left if known[y] != known[queue[0]]]
        while queue and left:
            x = queue.pop()
            rest, reached = [], set()
            for y in left:
                if known[y] in reached:
                    continue
                few, many = sorted((len(sets[x]), len(sets[y])))
                near = few >= least * many
                if near:
                    # both are sorted: those of y that are found in x
                    place = np.minimum(np.searchsorted(sets[x], sets[y]), len(sets[x]) - 1)
                    same = int(np.count_nonzero(sets[x][place] == sets[y]))
                    near = same >= least * (few + many - same) - 1e-9
                if near:
                    out.append((classes[x], classes[y]))
                    queue += members[known[y]]
                    reached.add(known[y])
                else:
                    rest.append(y)
            left = [y for y in rest if known[y] not in reached]
    return out


def group_links(shingle: int, least: float):
    """For rows (group, class, known, text) sorted by group: links within groups."""

    def links_of(classes, known, sets):
        links = linked(classes, sets, least, known)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        group, classes, known, sets = None, [], [], []
        for batch in batches:
            for g, c, k, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != group and classes:
                    yield links_of(classes, known, sets)
                    classes, known, sets = [], [], []
                group = g
                classes.append(c)
                known.append(k)
                sets.append(shingles(normal(raw), shingle))
        if classes:
            yield links_of(classes, known, sets)

    return run


def links_in(groups: DataFrame, docs: DataFrame, one: DataFrame, key: str, shingle: int, least: float) -> DataFrame:
    """(a, b): links of `least` or more within groups (_group, _n, _class, _known): classes of equal _known are linked already.

    Of all texts only those of one row for each class that meets others are moved.
    """
    # a large group is cut into parts, and each pair of parts becomes a group of its own
    parts = F.ceil(F.col("_n") / SPLIT).cast("int")
    met = groups.withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("_class", F.lit(1)), F.col("_parts")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    pair = F.xxhash64("_group", F.least("_part", "_other"), F.greatest("_part", "_other"))
    met = met.select("_class", "_known", F.when(F.col("_parts") == 1, F.col("_group")).otherwise(pair).alias("_group"))
    asked = one.join(met.select("_class").distinct(), "_class", "left_semi").select(key, "_class")
    texts = stored(docs.select(key, F.col("text").cast("binary").alias("_text")).join(asked, key).select("_class", "_text"))
    pairs = met.join(texts, "_class").select("_group", "_class", "_known", "_text").repartition("_group").sortWithinPartitions("_group")
    return pairs.mapInArrow(group_links(shingle, least), "a long, b long")


def near_copies(docs: DataFrame, key: str, shingle: int = 5, least: float = 0.8, most: int = 4) -> DataFrame:
    """(key, _root): equal _root for texts linked, directly or by way of others, by a similarity of `least` or more.

    key: a column that no two rows share. Similarity is that of the sets of word shingles (shared ones over all), A-Z lower-cased. Texts of equal words
    are one class, so that exact copies make no pairs. First come the links of SimHash: fingerprints of the shingles that differ in at most `most` bits are all
    found by bit counts of segments on a grid (simhash.near_links), and the classes that they bring together are compared exactly. Texts
    of 50 to 100 words that are alike by 0.8 mostly differ in 5 to 13 bits, where a grid has no fine cells; for these, classes that share a min-hash band meet
    in a group as well. Groups of the same members are compared once, those that SimHash has linked as a whole are left out, and in the others each class is
    compared exactly with those not linked yet. Null, empty and blank texts are one class; texts of fewer words than a shingle are one shingle; very long
    texts count whole; other columns don't matter; an empty table gives no rows.
    """
    rows = stored(with_bands(docs, key, shingle))
    one = rows.groupBy("_class").agg(F.min(F.struct("_bands", "_fp", key)).alias("_one"))
    one = stored(one.select("_class", "_one._bands", "_one._fp", F.col("_one").getField(key).alias(key)))
    prints = stored(one.groupBy("_fp").agg(F.count("*").alias("_n")))
    near = components(near_links(prints.select(F.col("_fp").alias("fp")), prints.count(), most)).withColumnRenamed("node", "_fp")
    rooted = prints.join(near, "_fp", "left").select("_fp", F.coalesce("root", "_fp").alias("_group"), "_n")
    large = rooted.groupBy("_group").agg(F.sum("_n").alias("_n")).where("_n > 1")
    alike = one.select("_class", "_fp").join(rooted.drop("_n").join(large, "_group"), "_fp").select("_group", "_n", "_class", F.col("_class").alias("_known"))
    first = stored(links_in(stored(alike), docs, one, key, shingle, least))
    known = components(first).select(F.col("node").alias("_class"), F.col("root").alias("_known"))
    keyed = stored(one.select("_class", F.posexplode("_bands").alias("_i", "_band")).select("_class", F.xxhash64("_i", "_band").alias("_group")))
    groups = keyed.groupBy("_group").agg(F.count("*").alias("_n"), F.sum(F.xxhash64("_class").cast("decimal(38,0)")).alias("_members")).where("_n > 1")
    groups = stored(groups.groupBy("_n", "_members").agg(F.min("_group").alias("_group")))
    met = stored(keyed.join(groups.select("_group", "_n"), "_group").join(known, "_class", "left").withColumn("_known", F.coalesce("_known", "_class")))
    open_ = met.groupBy("_group").agg(F.min("_known").alias("_low"), F.max("_known").alias("_high")).where("_low < _high").select("_group")
    rest = links_in(met.join(open_, "_group", "left_semi"), docs, one, key, shingle, least)
    roots = components(first.unionByName(rest)).select(F.col("node").alias("_class"), F.col("root").alias("_root"))
    return rows.select(key, "_class").join(roots, "_class", "left").select(key, F.coalesce("_root", "_class").alias("_root"))
