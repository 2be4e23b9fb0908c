"""Best-fit packing of tokenised documents into fixed-length sequences by linear grouping."""

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Rank keys: length * RANKS + rank. A length class holds fewer documents than this.
RANKS = 1 << 44


def encoder(tokenizer_path: str, ranks_path: str):
    """Token ids of a text as the `tokenizers` library gives them for tokenizer_path without added special tokens.

    The strings of special tokens in a text get their ids, as there. The work is done by tiktoken, which is four times as fast, from the file of
    ranks of the same byte-level BPE.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path, "rb") as f:
        special = {t["content"]: int(t["id"]) for t in json.load(f)["added_tokens"]}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all")


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): only documents of over `capacity` ids are cut; their first piece is the shorter one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode = encoder(tokenizer_path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield some(encode, batch.column(0).slice(at, 1000), batch.column(1).slice(at, 1000).to_pylist())

    def some(encode, names, texts):
        who, number, start, length, crc, kept = [], [], [], [], [], []
        for i, text in enumerate(texts):
            ids = np.array([*encode(text or ""), end_id], "<u4")
            at = 0
            for k in range(-(-len(ids) // capacity)):
                to = (len(ids) - 1) % capacity + 1 + k * capacity
                who.append(i)
                number.append(k)
                start.append(at)
                length.append(to - at)
                crc.append(zlib.crc32(ids[at:to].tobytes()))
                if with_ids:
                    kept.append(ids[at:to].astype(np.int32))
                at = to
        columns = [names.take(pa.array(who, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        columns += [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes that fits and is worth most."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            value = worth[fits] + best[room - sizes[fits]]
            j = int(np.argmax(value))
            if value[j] > best[room] + 1e-12:
                best[room], choice[room] = value[j], fits[j]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return counts, best[capacity]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 800) -> list[tuple[list[int], int]]:
    """Configurations and how often to use each: the linear programme over all of them, by column generation, rounded down."""
    sizes, demand = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // sizes).astype(float))
    times = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column, value = best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column)
        steps = np.where(way > 1e-9, times / np.maximum(way, 1e-9), np.inf)
        out = int(np.argmin(steps))
        times = np.maximum(times - steps[out] * way, 0)
        times[out], basis[:, out] = steps[out], column
    return [(basis[:, j].astype(int).tolist(), int(times[j] + 1e-9)) for j in range(len(sizes))]


def packing_plan(counts: dict[int, int], capacity: int, n_groups: int, small: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(number of sequences, placements). A placement (length, rank, sequence, offset) holds for the documents of this length from this rank up
    to that of the next placement: each goes into the sequence that many numbers further, at this offset.

    Only the number of documents of each length matters, so the plan is made from at most `capacity` numbers, however many documents there are.
    """
    placed, done, opened, room_left = [], defaultdict(int), 0, defaultdict(list)

    def place(length: int, n: int, first: int, offset: int) -> None:
        placed.append((length, done[length], first, offset))
        done[length] += n

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 0)
        opened = counts[capacity]
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if small < x < capacity]
    each = max(1, -(-sum(n for _, n in large) // n_groups))
    groups: list[list[list[int]]] = []
    free = 0
    for x, n in large:  # groups of the same cardinality, longest first
        while n:
            if not free:
                groups.append([])
                free = each
            k = min(n, free)
            groups[-1].append([x, k])
            n, free = n - k, free - k
    sizes: list[int] = []  # every document of a group counts as long as its longest
    merged: list[list[list[int]]] = []
    for g in groups:
        if sizes and g[0][0] == sizes[-1]:
            merged[-1] += g
        else:
            sizes.append(g[0][0])
            merged.append(list(g))
    if sizes:
        for configuration, times in configurations(sizes, [sum(n for _, n in g) for g in merged], capacity):
            times = min([times, *(sum(n for _, n in merged[i]) // a for i, a in enumerate(configuration) if a)])
            if times <= 0 or not any(configuration):
                continue
            runs, opened = [(opened, times, 0)], opened + times
            for i, a in enumerate(configuration):
                for _ in range(a):  # the group's actual documents take the place of the rounded ones
                    after = []
                    for first, n, fill in runs:
                        while n:
                            x, m = merged[i][0]
                            k = min(n, m)
                            place(x, k, first, fill)
                            after.append((first, k, fill + x))
                            first, n = first + k, n - k
                            if m == k:
                                merged[i].pop(0)
                            else:
                                merged[i][0][1] -= k
                    runs = after
            for first, n, fill in runs:
                room_left[capacity - fill].append((first, n))
    for x in sorted(counts, reverse=True):  # what rounding down left, and the small ones: best fit, longest first
        n = counts[x] - done[x]
        while n:
            room = next((r for r in range(x, capacity + 1) if room_left[r]), 0)
            if not room:
                new, room = -(-n // (capacity // x)), capacity
                room_left[capacity].append((opened, new))
                opened += new
            first, m = room_left[room].pop()
            k = min(n, m)
            place(x, k, first, capacity - room)
            if m > k:
                room_left[room].append((first + k, m - k))
            if room > x:
                room_left[room - x].append((first, k))
            n -= k
    return opened, placed


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = 1024, end_id: int = 2, plans: tuple[tuple[int, float], ...] = ((64, 0.25), (64, 0.44), (128, 0.48)), with_ids: bool = False) -> DataFrame:
    """Packs documents into sequences of at most `capacity` ids: the columns of pieces(), sequence_id and offset.

    Linear grouping: large pieces are sorted by length into groups of equal cardinality and rounded up to the
    longest of their group; configurations of these few sizes are optimised; actual pieces take the places, and what is left, with the
    small pieces, goes where it fits best. `plans` has pairs of a number of groups and the share of the capacity up to which a piece is small;
    the plan with the fewest sequences is used. All this needs only the number of pieces of each length (at most `capacity` numbers on the
    driver). Pieces get their places by their rank within their length; ranks are counted in parts of each length, so that no length
    is gathered in one task.

    The ids are those of the `tokenizers` library for tokenizer_path (see encoder); ranks_path has the same vocabulary as ranks.

    Null or empty text gives one piece that holds the end id alone; very long texts give many pieces; equal rows are
    packed as often as they occur; an empty table gives no rows; columns other than doc_id and text don't matter.
    """
    cut = stored(pieces(docs, tokenizer_path, ranks_path, capacity, end_id, with_ids))
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n, placed = min((packing_plan(counts, capacity, k, int(share * capacity)) for k, share in plans), key=lambda plan: plan[0])
    placed = np.array(sorted(placed), np.int64).reshape(-1, 4)
    keys, ranks, firsts, offsets = placed[:, 0] * RANKS + placed[:, 1], placed[:, 1], placed[:, 2], placed[:, 3]

    parts = max(64, sum(counts.values()) // 100_000)
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = before.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("_rank", rank).join(before, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def assign(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * RANKS + rank, "right") - 1
            kept = [c for c in batch.schema.names if c != "_rank"]
            found = [pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "sequence_id", "offset"])

    columns = cut.drop("_part").columns
    fields = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, F.col("_rank").cast("long")).mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
