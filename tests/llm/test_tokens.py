from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import packing, token_files, tokens

pytest.importorskip("public_tokenizers")
VOCABULARY = tokens.default_vocabulary()


def library_ids(text):
    return tokens.encoder(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé .,!?'ßİΣσǺ<|>12\t\n　\x1c-s", max_size=25), max_size=5))
def test_pieces_give_the_library_ids(texts):
    assert [ids_of(p) for p in tokens.encoder(VOCABULARY).packed_all(texts)] == [library_ids(t) for t in texts]


def test_special_texts_and_full_stores():
    enc, texts = tokens.Encoder(VOCABULARY), ["a <|endoftext|> b", "x<|ENDOFTEXT|>", None, "", "We'll don't. 'S 's!", "word. Word, WORD!!"]
    old, tokens.KEPT, tokens.BATCH = (tokens.KEPT, tokens.BATCH), 3, 10
    try:
        for _ in range(2):
            assert [ids_of(p) for p in enc.packed_all(texts)] == [library_ids(t) for t in texts]
    finally:
        tokens.KEPT, tokens.BATCH = old


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aÉéß×÷µªK\u0301\u0338'.,*|<>=-sº—. \n", max_size=25), max_size=5))
def test_cuts_between_letters_and_symbols_give_the_library_ids(texts):
    texts += ["<|endoftext|>. a", "(half-life), ×.É. 'twas|it's."]
    assert [ids_of(p) for p in tokens.encoder(VOCABULARY).packed_all(texts)] == [library_ids(t) for t in texts]


def test_a_word_is_asked_and_held_once_whatever_closes_it():
    """Each word with its closing symbols was a piece of its own: 15,000 of them here, and as many texts cut and joined one by one."""
    enc, closing = tokens.Encoder(VOCABULARY), ".,;:!?#$%&*|()-"
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "aeiouäéöüy"]
    texts = [" ".join(w + c for w in words) for c in closing]
    assert [ids_of(p) for p in enc.packed_all(texts)] == [library_ids(t) for t in texts]
    assert len(enc.seen) <= len(words) + len(closing) + 1


def test_token_files_round_trip(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(odd_docs, path, VOCABULARY, end_id=1)
    got = token_files.digests(token_files.read_token_files(spark, path)).collect()
    want = sorted(((-1 if r.doc_id is None else r.doc_id, [*library_ids(r.text), 1]) for r in odd_docs.collect()), key=lambda x: x[0])
    by_start = sorted(got, key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in by_start] == [d for d, _ in want]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d if d > 0 else -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    ends = [r.start + r.n_tokens for r in by_start]
    assert [r.start for r in by_start] == [0, *ends[:-1]]


def test_token_files_keep_index_and_columns(spark, odd_docs, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_token_files(odd_docs, f"file://{tmp_path}/t", VOCABULARY, row_group_bytes=1 << 20)
    f = next(p for p in (tmp_path / "t").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(f).metadata.row_group(0)
    ids = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
    assert ids.has_column_index and ids.has_offset_index
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
    plan = token_files.read_token_files(spark, f"file://{tmp_path}/t").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan[plan.index("Physical Plan") :].split("ReadSchema", 1)[1].split("\n")[0]


def test_one_row_that_recurs_fills_many_parts(spark, tmp_path):
    docs = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 4000, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # such small parts would be one
    try:
        token_files.write_token_files(docs, f"file://{tmp_path}/t", VOCABULARY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = token_files.read_token_files(spark, f"file://{tmp_path}/t")
    raw = spark.read.parquet(f"file://{tmp_path}/t")
    assert max(r["count"] for r in raw.groupBy("part").count().collect()) < 4000
    rows = sorted(files.select("start", "n_tokens", "doc_id").collect())
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_a_range_of_documents_is_found_by_statistics(spark, tmp_path):
    """Row groups hold ranges of ids that don't overlap, columns have page indexes, and a range reaches the scan."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), "id", F.lit(" ")), 40).alias("text")).repartition(3)
    token_files.write_token_files(docs, f"file://{tmp_path}/t", VOCABULARY, page_rows=50, row_group_bytes=64 << 10)
    ranges = []
    for f in Path(f"{tmp_path}/t").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in map(meta.row_group, range(meta.num_row_groups)):
            columns = [g.column(c) for c in range(g.num_columns)]
            assert all(c.has_offset_index and c.has_column_index for c in columns if c.path_in_schema in ("doc_id", "n_tokens"))
            assert all(c.has_offset_index for c in columns)
            ranges.append((columns[0].statistics.min, columns[0].statistics.max))
    assert len(ranges) >= 2 and all(a[1] < b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))
    some = token_files.read_token_files(spark, f"file://{tmp_path}/t").where("doc_id between 1000 and 1040")
    assert sorted(r.doc_id for r in some.collect()) == list(range(1000, 1041))
    assert "GreaterThanOrEqual(doc_id,1000)" in some._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_no_rows(spark, no_docs, tmp_path):
    token_files.write_token_files(no_docs, f"file://{tmp_path}/none", VOCABULARY)
    assert token_files.digests(token_files.read_token_files(spark, f"file://{tmp_path}/none")).collect() == []


def test_packing_of_odd_documents(odd_docs, no_docs):
    out = packing.pack_documents(odd_docs, VOCABULARY, capacity=64, with_ids=True).collect()
    want = sorted(crc for r in odd_docs.collect() for i in [[*library_ids(r.text), 0]] for crc in (zlib.crc32(np.array(i[a : a + 64], "<u4").tobytes()) for a in range(0, len(i), 64)))
    assert sorted(r.ids_crc32 for r in out) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in out)
    bins = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64
    assert len(bins) == -(-sum(bins.values()) // 64)
    assert packing.pack_documents(no_docs, VOCABULARY).collect() == []


def one_by_one(lengths, capacity, most, cost, weights):
    """Plain vector best fit: each piece on its own."""
    caps, bins = np.array([capacity, most, cost], float), []
    for n in sorted(lengths, reverse=True):
        need, best = np.array([n, 1, n * n], float), None
        for k, room in enumerate(bins):
            if (room >= need).all():
                score = (np.array(weights) * ((room - need) / caps) ** 2).sum()
                if best is None or score < best[0] - 1e-15:
                    best = (score, k)
        if best is None:
            bins.append(caps - need)
        else:
            bins[best[1]] -= need
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(2, 12), st.integers(1600, 3000), st.sampled_from(["norm", "dot"]), st.sampled_from([(1.0, 1e-4, 1e-4), (1.0, 1.0, 1.0)]))
def test_plan_holds_every_capacity(counts, most, cost, score, weights):
    runs, n = packing.plan(counts, capacity=40, max_documents=most, max_cost=cost, score=score, weights=weights)
    used, placed = {}, {}
    for length, rank, seq, q, offset in runs.tolist():
        later = [r for l, r, *_ in runs.tolist() if l == length and r > rank]
        for k in range(min(later, default=counts[length]) - rank):
            s, at = seq + k // q, offset + (k % q) * length
            used.setdefault(s, []).append((at, length))
            placed[length] = placed.get(length, 0) + 1
    assert placed == counts
    for s, items in used.items():
        end = 0
        for at, length in sorted(items):
            assert at == end
            end += length
        assert end <= 40 and len(items) <= most and sum(x * x for _, x in items) <= cost
    assert sorted(used) == list(range(n))
    if score == "norm":
        lengths = [x for x, k in counts.items() for _ in range(k)]
        assert n <= one_by_one(lengths, 40, most, cost, weights) + 1
    # fewer documents or less cost a sequence than asked for here would need more sequences
    assert n >= max(-(-sum(counts.values()) // most), -(-sum(x * x * k for x, k in counts.items()) // cost), -(-sum(x * k for x, k in counts.items()) // 40))
