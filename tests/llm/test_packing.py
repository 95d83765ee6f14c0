import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm.packing import pack, pack_documents, step_groups
from veilspark.llm.queries import op8_packing, vocabulary


@given(st.lists(st.integers(1, 900), max_size=40))
@settings(max_examples=60, deadline=None)
def test_every_token_lies_in_one_piece_and_nothing_is_padded(lengths):
    out, sizes = pack(lengths, (32, 64, 128, 256))
    docs, seqs = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in out:
        assert n > 0
        docs[d].append((s, n))
        seqs[q].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(docs[d]):
            assert s == at
            at += m
        assert at == n
    for q, size in enumerate(sizes):
        at = 0
        for o, m in sorted(seqs[q]):
            assert o == at
            at += m
        assert at == size and size & (size - 1) == 0 and size <= 256


def test_groups_are_balanced():
    sizes = [2048] * 100 + [256] * 40
    load = defaultdict(int)
    for size, g in zip(sizes, step_groups(sizes, 1 << 15)):
        load[g] += size
    assert max(load.values()) - min(load.values()) <= 2048


def test_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = ["one two", None, "", "  ", "A<|endoftext|>b", "héllo " * 3000, "x" * 5000, "don't stop", "same", "same"]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string")
    rows = pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.token_ids, "<u4") for r in own])
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids + [1]
        assert {r.doc_tokens for r in own} == {len(ids)}
    assert pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_query_over_whole_table(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = defaultdict(list)
    total = padded = 0
    seqs = defaultdict(int)
    for r in op8_packing(spark, sf_dir).collect():
        rows[r.doc_id].append(r)
        seqs[r.sequence_id] += r.length
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(rows)
    for d in docs:
        ids = np.array(library.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(rows[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    padded = sum(2048 - n for n in seqs.values() if n & (n - 1))
    assert max(seqs.values()) <= 2048 and padded == 0 and sum(seqs.values()) == total
