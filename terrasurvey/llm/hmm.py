"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion."""

import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Counts of states and classes travel in blocks of this many numbers.
BLOCK = 4096
#: Steps are worked through in chunks of about so many tokens: the state of a recursion is kept between chunks, its steps only within one.
CHUNK = 400_000


@dataclass
class Model:
    start: np.ndarray  # K
    step: np.ndarray  # K x K
    emit: np.ndarray  # classes x K


def packed(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out step by step: (tokens, where each step begins, how many go on at each step, sequence of each token)."""
    lengths = np.array([len(s) for s in sequences])
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    begins = np.concatenate(([0], np.cumsum(active)))
    if len(sequences) == 1:
        return sequences[0], begins, active, np.zeros(lengths[0], np.int8)
    who = np.repeat(np.arange(len(sequences)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    tokens, owner = np.empty(lengths.sum(), np.int64), np.empty(lengths.sum(), np.int64)
    place = begins[at] + who
    tokens[place], owner[place] = np.concatenate(sequences) if len(sequences) else [], who
    return tokens, begins, active, owner


def chunks_of(begins: np.ndarray) -> list[tuple[int, int]]:
    """(first step, end) of runs of steps of at most CHUNK tokens, or of one step."""
    out, at, steps = [], 0, len(begins) - 1
    while at < steps:
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + CHUNK, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def forward(model: Model, tokens, begins, active, chunk, entering) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(emissions, scaled forward probabilities, scales) of the steps of a chunk; entering: the probabilities of the step before it."""
    at, to = chunk
    first = begins[at]
    emit = model.emit[tokens[first : begins[to]]]
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    before = entering
    for t in range(at, to):
        b, n = begins[t] - first, active[t]
        here = alpha[b : b + n]
        np.multiply(before[:n] @ model.step if t else model.start[None, :], emit[b : b + n], out=here)
        s = here.sum(axis=1)
        scale[b : b + n] = s
        here /= s[:, None]
        before = here
    return emit, alpha, scale


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of the probabilities of sequences, longest first."""
    tokens, begins, active, owner = packed(sequences)
    out, entering = np.zeros(len(sequences)), None
    for at, to in chunks_of(begins):
        _, alpha, scale = forward(model, tokens, begins, active, (at, to), entering)
        entering = alpha[len(alpha) - active[to - 1] :].copy()
        out += np.bincount(owner[begins[at] : begins[to]], np.log(scale), len(sequences))
    return out


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, steps and emissions (the Baum-Welch E-step) of sequences, longest first.

    Of a long sequence only the forward probabilities between chunks are kept; those within a chunk are worked out again on the way back.
    """
    tokens, begins, active, _ = packed(sequences)
    classes, states = model.emit.shape
    starts, steps, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    chunks, entering, found = chunks_of(begins), [None], None
    for at, to in chunks:
        found = forward(model, tokens, begins, active, (at, to), entering[-1])
        entering.append(found[1][len(found[1]) - active[to - 1] :].copy())
    after = None
    for i in range(len(chunks) - 1, -1, -1):
        at, to = chunks[i]
        emit, alpha, scale = found if found else forward(model, tokens, begins, active, (at, to), entering[i])
        found, first = None, begins[at]
        beta, ahead = np.ones_like(alpha), emit / scale[:, None]
        if after is not None:  # from the chunk behind
            last = begins[to - 1] - first
            beta[last : last + len(after)] = after
        for t in range(to - 1, at, -1):
            b, n, a = begins[t] - first, active[t], begins[t - 1] - first
            ahead[b : b + n] *= beta[b : b + n]
            np.matmul(ahead[b : b + n], model.step.T, out=beta[a : a + n])
        n = active[at]
        ahead[:n] *= beta[:n]
        if at:
            after = ahead[:n] @ model.step.T
            steps += entering[i][:n].T @ ahead[:n]
        later = np.arange(n, len(alpha))
        steps += alpha[later - np.repeat(active[at : to - 1], active[at + 1 : to])].T @ ahead[later]
        alpha *= beta
        here = tokens[first : begins[to]]
        emissions += np.stack([np.bincount(here, alpha[:, k], classes) for k in range(states)], axis=1)
        if not at:
            starts += alpha[:n].sum(axis=0)
    return starts, steps * model.step, emissions


def in_groups(sequences: list[np.ndarray], most: int = 300_000):
    """Indices of sequences, longest first, in groups of about `most` tokens."""
    order, group, size = np.argsort([-len(s) for s in sequences], kind="stable"), [], 0
    for i in order:
        group.append(i)
        size += len(sequences[i])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def updated(starts: np.ndarray, steps: np.ndarray, emissions: np.ndarray, prior: np.ndarray, weight: float = 20.0) -> Model:
    """The M-step; emissions lean on the whole corpus's class probabilities with so many tokens' weight."""
    k = len(starts)
    start, step = starts + 1 / k, steps + 1 / k
    emit = emissions + weight * prior[:, None]
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(sample: list[np.ndarray], states: int, prior: np.ndarray, rounds: int = 12) -> Model:
    """A model to start from: texts of the sample that are far from each other each give a state, and a few rounds over the sample follow."""
    rng, classes = np.random.default_rng(7), len(prior)
    uniform = Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(prior[:, None], states, axis=1))
    sample = [s for s in sample if len(s) >= 30] or sample
    if not sample:
        return uniform
    shares = np.stack([np.bincount(s, minlength=classes) / len(s) for s in sample])
    gain = np.log(1 + 50 * shares / (prior + 1e-5))
    chosen = [int(rng.integers(len(sample)))]
    best = np.einsum("ij,ij->i", shares, np.repeat(gain[chosen], len(sample), axis=0)) if len(sample) > 1 else np.zeros(1)
    while len(chosen) < states:
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, shares @ gain[chosen[-1]])
    emit = np.stack([np.bincount(sample[i], minlength=classes) for i in chosen], axis=1).astype(float)
    step = np.full((states, states), 0.05 / states) + np.eye(states) * 0.95
    model = updated(np.zeros(states), 1000 * step, emit, prior, weight=60.0)
    for _ in range(rounds):
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))]
        for group in in_groups(sample):
            for total, part in zip(sums, expected(model, [sample[i] for i in group]), strict=True):
                total += part
        model = updated(*sums, prior)
    return model


def counted(training: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in the training texts, and the end (the empty word)."""

    def run(batches):
        for batch in batches:
            counts = Counter()
            for raw in batch.column(0).to_pylist():
                counts.update((raw or b"").lower().split())
                counts[b""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return training.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_from(vocabulary: DataFrame, head: int) -> int:
    """The least count for which at most `head` words are as frequent: from the number of words by the logarithm of their count, in bounded steps."""
    step = F.floor(F.log2("n") * 256).cast("long")
    steps = vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    least, words = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        words += r["words"]
        if words > head:
            break
        least = r["n"]
    return least


def shape(word: bytes, shapes: int) -> int:
    """The class of a word that has none of its own: by its last three bytes."""
    return crc32(word[-3:]) % shapes


def expectation(training: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """One Baum-Welch round over all training sequences: each task adds up its own counts, and blocks of these are summed in two levels."""
    states, classes = len(model.start), len(prior)

    def run(batches):
        sums = None
        for batch in batches:
            sequences = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(0).to_pylist()]
            for group in in_groups(sequences):
                part = expected(model, [sequences[i] for i in group])
                sums = part if sums is None else tuple(a + b for a, b in zip(sums, part, strict=True))
        if sums is not None:
            flat = np.concatenate([x.ravel() for x in sums])
            blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
            task = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array(blocks, pa.list_(pa.float64()))], ["block", "part", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [rows["part"].iloc[0]], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})

    fields = "block int, part int, sums array<double>"
    parts = training.select("seq").mapInArrow(run, fields).groupBy("block", "part").applyInPandas(add, fields)
    rows = parts.withColumn("part", F.lit(0)).groupBy("block").applyInPandas(add, fields).collect()
    if not rows:
        return model
    flat = np.concatenate([np.array(r["sums"]) for r in sorted(rows, key=lambda r: r["block"])])
    a, b = states, states + states * states
    return updated(flat[:a], flat[a:b].reshape(states, states), flat[b:].reshape(classes, states), prior)


def start_texts(training: DataFrame, sample_rows: int, sample_tokens: int) -> list[np.ndarray]:
    """Whole texts to fit the first model on: distinct ones in the order of a hash of what they say, so that they don't depend on how rows are laid out.

    At most sample_rows texts and about sample_tokens tokens: a text that would take more than what is left of them is passed over, but one is always taken.
    """
    every = max(1, training.count() // (4 * sample_rows))
    keyed = training.select(F.xxhash64("seq").alias("_key"), "n_tokens", "seq").where(F.pmod("_key", F.lit(every)) == 0)
    chosen, left = [], sample_tokens
    for r in keyed.select("_key", "n_tokens").distinct().orderBy("_key", "n_tokens").limit(sample_rows).collect():
        if r["n_tokens"] <= left or not chosen:
            chosen.append(r["_key"])
            left -= r["n_tokens"]
    rows = keyed.where(F.col("_key").isin(chosen)).dropDuplicates(["_key"]).select("_key", "seq").collect()
    return [np.frombuffer(bytes(r["seq"]), "<u2").astype(np.int64) for r in sorted(rows, key=lambda r: r["_key"])]


def score(docs: DataFrame, held_out, states: int = 8, rounds: int = 4, own: int = 6143, shapes: int = 2048, head: int = 1 << 17, sample_rows: int = 400, sample_tokens: int = 4_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; base-10 logarithms.

    held_out: a condition; texts for which it is false or null train the model. Tokens are the words of the text with A-Z lower-cased and one
    end. The `own` most frequent words have a class each, all other words one of `shapes` classes by their last bytes, the end its own.
    Hidden states emit classes, and a class emits its words by their smoothed share of it (one share for all words that were never seen), so
    the score is the probability of the words themselves. Baum-Welch rounds run over all training texts; only where they start from is
    fitted on a bounded sample of whole texts (sample_rows texts and sample_tokens tokens at most, chosen by what they say). The `head` most frequent words are looked up in each task (a bounded table); the counts
    of all others come by a join, which every occurrence takes part in.

    Null and blank texts have the end as their only token; very long texts are scored whole, in bounded memory; equal rows get equal rows, as each row has a key of
    its own; an empty table gives no rows; columns other than doc_id and text (and those of the condition) don't matter.
    """
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    vocabulary = stored(counted(docs.where("not held_out")))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    least = head_from(vocabulary, head)
    top = [(bytes(r["word"]), int(r["n"])) for r in vocabulary.where((F.length("word") > 0) & (F.col("n") >= least)).collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    classes, end = own + shapes + 1, own + shapes
    named = {word: i for i, (word, _) in enumerate(top[:own])}

    def by_class(batches):
        for batch in batches:
            c = np.array([named[w] if w in named else own + shape(w, shapes) if w else end for w in batch.column(0).to_pylist()], np.int64)
            n, v = np.bincount(c, batch.column(1).to_numpy(), classes), np.bincount(c, minlength=classes)
            used = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used].astype(np.int64)), pa.array(v[used].astype(np.int64))], ["class", "n", "v"])

    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for r in vocabulary.mapInArrow(by_class, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    prior = (class_n + 0.5) / (class_n + 0.5).sum()
    # a class of words shares itself among the words seen and one place for all unseen ones
    log_share = np.log10(class_n[own:end] + 0.5 * (class_v[own:end] + 1))
    log_all = math.log10(n_all + 0.5 * (v_all + 1))
    known = {}
    for i, (word, n) in enumerate(top):
        c = i if i < own else own + shape(word, shapes)
        known[word] = (c, math.log10(n + 0.5) - log_all, 0.0 if i < own else math.log10(n + 0.5) - float(log_share[c - own]))
    end_base = math.log10(class_n[end] + 0.5) - log_all
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        """Class sequences, and what the head's words give to the scores; words beyond it are kept for the join."""
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for raw in batch.column(2).to_pylist():
                sequence, base, share, rest = [], end_base, 0.0, []
                for w in (raw or b"").lower().split():
                    found = known.get(w)
                    if found:
                        sequence.append(found[0])
                        base += found[1]
                        share += found[2]
                    else:
                        c = shape(w, shapes)
                        sequence.append(own + c)
                        base -= log_all
                        share -= log_share[c]
                        rest.append(w)
                sequence.append(end)
                out.append((row, len(sequence), len(sequence) - len(rest) - (n_all == 0), base, share, np.array(sequence, "<u2").tobytes(), rest))
                row += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "share", "seq", "rest"])

    fields = f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, base double, share double, seq binary, rest array<binary>"
    encoded = stored(docs.select("doc_id", "held_out", F.col("text").cast("binary")).mapInArrow(encode, fields))

    training = encoded.where("not held_out")
    model = first_model(start_texts(training, sample_rows, sample_tokens), states, prior)
    for _ in range(rounds):
        model = expectation(training, model, prior)

    def likelihood(batches):
        for batch in batches:
            sequences = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("seq").to_pylist()]
            out = np.zeros(len(sequences))
            for group in in_groups(sequences):
                out[group] = log_likelihoods(model, [sequences[i] for i in group]) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["seq"]).columns, pa.array(out)], [*batch.drop_columns(["seq"]).schema.names, "path"])

    scored = encoded.drop("rest").mapInArrow(likelihood, f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, base double, share double, path double")
    words = encoded.select("row", F.explode("rest").alias("word"))
    counts = vocabulary.where(F.col("n") < least).withColumnRenamed("n", "c")
    c = F.coalesce(F.col("c"), F.lit(0))
    by_row = words.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(c + 0.5)).alias("_logs"), F.count_if(c > 0).alias("_seen"))
    out = scored.join(by_row, "row", "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_seen", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("path") + F.col("share") + logs).alias("score"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
