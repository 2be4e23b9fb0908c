"""SimHash near-duplicates: fingerprints embedded as bit counts of segments, joined on a grid."""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .graph import components

#: The grid is made finer until a cell is expected to hold this many of evenly spread fingerprints, at most.
PER_CELL = 8
#: Segments of 2 bits each; a count from 0 to 2 takes 2 bits as well.
SEGMENTS = 32
#: Cells of more fingerprints than this are split over several tasks.
SPLIT = 20_000
#: Fingerprints up to which cells are counted over all of them.
WHOLE = 50_000


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes (<u8): bit i is set if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0]


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): bit i is set if it is set in over half of the XXH64 values of the word shingles of the text, A-Z lower-cased."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                words = (raw or b"").lower().split()
                if not words:
                    out.append(0)
                    continue
                joined = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                starts = [0, *(ends[:-1] + 1).tolist()]
                last = ends[shingle - 1 :].tolist() or [len(joined)]
                hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, last, strict=False)], "<u8")
                out.append(print_of(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


LOW = 0x5555555555555555  # the lower bit of each segment


def embedded(fp):
    """The bit counts of the 32 segments of two bits, packed as two bits each."""
    half = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(LOW)), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(F.lit(LOW)))


def embed(values: np.ndarray) -> np.ndarray:
    """The same as embedded(), of unsigned numbers."""
    half, low = values >> np.uint64(1), np.uint64(LOW)
    return ((values & half & low) << np.uint64(1)) | ((values ^ half) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the differences of all counts; fingerprints differ in at least so many bits."""
    x, low = a ^ b, np.uint64(LOW)
    one, two = x & low, (x >> np.uint64(1)) & low  # counts differ by 2 where only the upper bit differs
    return np.bitwise_count(one | two) + np.bitwise_count(two & ~one)


def grid(n: int, most: int) -> list[int]:
    """Masks of the segments that make up a cell's key, for n fingerprints within a Manhattan distance of `most`.

    The segments form blocks. If the counts of two fingerprints differ by at most `most` in all, at least (blocks - most) blocks have the same
    counts, so that the two share the cell of one choice of so many blocks. More blocks give more choices and finer cells: two
    random fingerprints agree in a segment's count with probability 3/8.
    """
    blocks = most + 1
    while blocks < SEGMENTS and n * 0.375 ** (SEGMENTS * (blocks - most) / blocks) > PER_CELL:
        blocks += 1
    edges = [round(i * SEGMENTS / blocks) for i in range(blocks + 1)]
    block = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect, within one cell, all fingerprints that differ in at most `most` bits: fewer than there are fingerprints.

    From each member of a group in turn, only those that are in no group yet are compared: by the Manhattan distance of bit counts first,
    exactly where that is small enough.
    """
    out, left = [], np.arange(len(values))
    counts = embed(values)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = manhattan(counts[left], counts[x]) <= most
            near[near] = np.bitwise_count(values[left[near]] ^ values[x]) <= most
            found = left[near]
            out += [(int(values[x]), int(values[y])) for y in found]
            queue += found.tolist()
            left = left[~near]
    return out


def cell_links(most: int):
    """For rows (cell, fp) sorted by cell: links within cells. Small cells are compared all at once, pair by pair at growing steps."""

    def links_of(cells, values):
        out_a, out_b = [], []
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(cells)])))
        for at, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
            part = np.unique(values[at : at + n])
            for a, b in linked(part, most):
                out_a.append(a)
                out_b.append(b)
        small = np.repeat(sizes <= 64, sizes)
        rest = np.repeat(starts + sizes, sizes)  # where the row's cell ends
        rows, counts = np.flatnonzero(small), embed(values)
        for step in range(1, 64):
            rows = rows[rows + step < rest[rows]]
            if not len(rows):
                break
            hit = rows[manhattan(counts[rows], counts[rows + step]) <= most]
            apart = np.bitwise_count(values[hit] ^ values[hit + step])
            hit = hit[(apart <= most) & (apart > 0)]
            out_a += values[hit].tolist()
            out_b += values[hit + step].tolist()
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])

    def run(batches):
        cells, values = np.zeros(0, "<i8"), np.zeros(0, np.uint64)
        for batch in batches:
            key = batch.column(0).to_numpy() if batch.num_rows else np.zeros(0, "<i8")
            cells = np.concatenate((cells, key))
            values = np.concatenate((values, batch.column(1).to_numpy().view(np.uint64)))
            if len(cells):  # the last cell may go on in the next batch
                end = int(np.searchsorted(cells, cells[-1], "left"))
                if end:
                    yield links_of(cells[:end], values[:end])
                    cells, values = cells[end:], values[end:]
        if len(cells):
            yield links_of(cells, values)

    return run


def near_links(classes: DataFrame, n: int, most: int = 4) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect all that differ in at most `most` bits."""
    masks = grid(n, most)
    e = embedded(F.col("fp"))
    keys = F.array(*[F.xxhash64(F.lit(i), e.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    keyed = classes.select("fp", F.explode(keys).alias("cell"))
    # which cells are large only shapes the work: in large tables it is judged by a part of the fingerprints
    part = 1 if n <= WHOLE else 16
    seen = keyed.where(F.pmod(F.xxhash64("fp", F.lit(2)), F.lit(part)) == 0).groupBy("cell").count()
    hot = stored(seen.where(F.col("count") * part > SPLIT).select("cell", F.ceil(F.col("count") * part / SPLIT).cast("int").alias("_parts")))
    if hot.count():
        # a large cell is cut into parts, and each pair of parts becomes a cell of its own
        keyed = keyed.join(hot, "cell", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        pair = F.xxhash64("cell", F.least("_part", "_other"), F.greatest("_part", "_other"))
        keyed = keyed.select("fp", F.when(F.col("_parts") == 1, F.col("cell")).otherwise(pair).alias("cell"))
    keyed = keyed.select("cell", "fp")
    return keyed.repartition("cell").sortWithinPartitions("cell").mapInArrow(cell_links(most), "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, class_size, component_id): documents whose fingerprints link, directly or by way of others, share the
    smallest doc_id that can be reached as component_id.

    Documents of one fingerprint are one class, so that copies, however many, are one point of the grid; only distinct fingerprints are
    compared, and every link between them is found (see grid). Null, empty and blank texts have fingerprint 0 and link like any other; texts
    of fewer words than a shingle are one shingle; very long texts are counted whole; equal rows get equal rows; an empty table gives no rows;
    columns other than doc_id and text don't matter.
    """
    prints = stored(fingerprints(docs, shingle, seed))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size")))
    joined = components(near_links(classes, classes.count(), most))
    rooted = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = rooted.join(smallest, "root").select("fp", "class_size", "component_id")
    out = prints.join(by_class, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "class_size", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
