"""Token ids, packing and token files against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stepwell.llm import packing, queries, tokenfile
from stepwell.llm.tokens import ColumnEncoder, encoder

from .helpers import EDGE, edge, empty, rows, table

VOCABULARY = queries.vocabulary()
PLAIN = Tokenizer.from_file(VOCABULARY)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'.,!aZé0 s<|>\x02\x85 ßΩж中\U0001f600")), st.characters(exclude_categories=["Cs"]))))
def test_ids_equal_the_library(text):
    assert encoder(VOCABULARY).encode(pa.array([text]))[0].tolist() == ids_of(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t'.,!aZé0$<|>\x02жﬁ"))), max_size=12))
def test_columns_keep_their_order(texts):
    enc = ColumnEncoder(VOCABULARY, chunks=8, size=100) if len(texts) % 3 == 0 else encoder(VOCABULARY)  # also one that forgets at each turn
    for _ in range(2):
        ids, n = enc.encode(pa.array(texts, pa.string()))
        assert n.tolist() == [len(ids_of(t)) for t in texts]
        assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert len(enc.known) <= 8 or enc.most > 8


@pytest.mark.parametrize("text", ["it's they'll  x", "a <|endoftext|> b<|endoftext|>", "word. word, (word) 'word'", "tail ", "\n\nhead", "a \n b", "x" * 5000, "ſ ŉ K İ", "end$$$ é, é,.! ×. x÷ <|endoftext|>, a, <|endoftext|>. b's, c' d", "a,b. c_. _d_ "])
def test_ids_of_chosen_texts(text):
    assert encoder(VOCABULARY).encode(pa.array([text]))[0].tolist() == ids_of(text)


def check_pieces(got, docs, end, seq_len=1024):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == seq_len or s == len(by_seq) - 1 and at <= seq_len
    want = defaultdict(list)
    for doc, text in docs:
        want[doc].append(ids_of(text) + [end])
    assert set(want) == set(by_doc)
    for doc, copies in want.items():
        if len(copies) > 1:
            assert sum(p["length"] for p in by_doc[doc]) == sum(map(len, copies))
            continue
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            piece = np.array(copies[0][at : at + p["length"]], "<u4")
            assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, zlib.crc32(piece), len(copies[0]))
            at += p["length"]
        assert at == len(copies[0])


def test_op1_packs_every_id_once(spark, small):
    check_pieces(rows(queries.op1_packing(spark, small)), [(r["doc_id"], r["text"]) for r in table(small, "documents")], 0)


def test_packing_of_awkward_rows(spark):
    got = packing.pack(edge(spark).repartition(3), VOCABULARY, seq_len=64, with_ids=True)
    check_pieces(rows(got), [(r[0], r[1]) for r in EDGE], 0, 64)
    whole = rows(packing.sequences(got, 64))
    assert all(len(r["input_ids"]) == 64 for r in whole)
    assert sum(r["n_tokens"] for r in whole) == sum(len(ids_of(r[1])) + 1 for r in EDGE)
    assert rows(packing.pack(empty(spark), VOCABULARY)) == []
    with pytest.raises(ValueError):
        packing.pack(empty(spark), VOCABULARY, seq_len=0)


def test_op6_reads_back_every_document(spark, small):
    got, at = {r["doc_id"]: r for r in rows(queries.op6_token_files(spark, small))}, 0
    docs = sorted(table(small, "documents"), key=lambda r: r["doc_id"])
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array([*ids_of(d["text"]), 2], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_token_files_of_awkward_rows(spark, tmp_path):
    index = tokenfile.write_tokens(edge(spark), VOCABULARY, seq_len=16, batch=3, out=f"file://{tmp_path}/t")
    got = rows(tokenfile.read_tokens(index, with_ids=True))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(r["ids"])) for r in got) == sorted((r[0] is not None, r[0] or 0, 4 * len(ids_of(r[1])) + 4) for r in EDGE)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert rows(tokenfile.read_tokens(tokenfile.write_tokens(empty(spark), VOCABULARY))) == []
    for f in tmp_path.glob("t/part-*.arrow"):  # equal-length sequences, mapped without a copy
        batch = pa.ipc.open_file(pa.memory_map(str(f))).get_batch(0)
        assert batch.schema.field("ids").type.list_size == batch.schema.field("mask").type.list_size == 16
