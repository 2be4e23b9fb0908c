import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.rows import documents, odd
from terrasurvey.llm.packing import pack, packing_plan, pieces

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["a  b\n \n c d", "x<|endoftext|>y 'll it's 12345", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n", "<|endoftext|", "Füße <|endoftext|> 中文", ""]
    rows = pieces(documents(spark, list(enumerate(texts))), *PATHS, 1024, 2, with_ids=True).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got[r.doc_id]) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.length == 1024 or r.piece == 0
        got[r.doc_id] += r.ids
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert got[i] == [*e.ids, 2]


def check(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for s in at.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_sequences_have_no_gaps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = pack(docs, *PATHS).collect()
    assert check(rows, 1024) <= 1.02 * sum(r.length for r in rows) / 1024 + 2


def test_odd_rows(spark):
    rows = pack(documents(spark, odd(["alpha", "beta"])), *PATHS, capacity=100).collect()
    check(rows, 100)
    assert sum(r.length == 1 and r.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) for r in rows) >= 2
    assert sum(r.doc_id == 6 for r in rows) == 2
    assert pack(documents(spark, []), *PATHS).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=30), st.integers(1, 12), st.integers(1, 40))
def test_plan_places_every_piece_once(counts, groups, small):
    n, placed = packing_plan(counts, 64, groups, small)
    starts = defaultdict(list)
    for length, rank, first, offset in placed:
        starts[length].append((rank, first, offset))
    fill = defaultdict(list)
    for length, count in counts.items():
        runs = sorted(starts[length]) + [(count, 0, 0)]
        assert runs[0][0] == 0
        for (rank, first, offset), (end, _, _) in zip(runs, runs[1:]):
            for r in range(rank, end):
                fill[first + r - rank].append((offset, length))
    for s in fill.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 64
    assert len(fill) <= n
