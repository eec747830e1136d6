"""Operators 5, 6 and 8: packing, fingerprints and byte-level BPE."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as public
import tiktoken
from tokenizers import Tokenizer

from cases import awkward, corpus, nothing
from loadcast.llm import byte_bpe, packing, simhash
from loadcast.llm.text import ChunkTable, sections

RANKS, WORDS = public.path("byte_bpe_50k.tiktoken"), public.path("word_bpe_49k.json")

ODD = ["", "  a  b\n\n c\t d\x1c e f 's  ", "aaaaaaaaaaaa don't I'LL  \n", "été́ ÀÉ ﬁ ٣٤ 漢字 👍🏽\x00\x85x", "  \n\n  ", None,
       " a", "a ", "\n", "a\nb c\n", "A,\n B. 's", "x y Σας ΣΑΣ İI \x02 q\x02", "a,b. c., .d ,, ..", "tab\tin word", "a\u00a0b \u2003c"]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_tiktoken(reference):
    vocab = byte_bpe.vocabulary(RANKS, public.PATTERN)
    rnd = random.Random(0)
    alphabet = "ab c\n'sté漢  .,!1"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(400)]
    for text, ids in zip(texts, vocab.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text or "")
        assert vocab.decode(ids) == (text or "").encode()


def test_merge_replay_survives_a_full_table(reference):
    vocab = byte_bpe.vocabulary(RANKS, public.PATTERN)
    limit, vocab.table.limit = vocab.table.limit, 3
    try:
        texts = ["one two three four five six", "six five two", "one"] * 3
        for _ in range(2):
            got = [x.tolist() for x in vocab.encode(pa.array(texts))]
            assert got == [reference.encode_ordinary(t) for t in texts]
    finally:
        vocab.table.limit = limit
        vocab.table.reset()


def test_bpe_operator_on_awkward_rows(spark, reference):
    docs = awkward(spark)
    got = byte_bpe.encode_documents(docs, RANKS, public.PATTERN).collect()
    want = sorted((str(r.doc_id), tuple(reference.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in got) == want
    digests = byte_bpe.encode_documents(docs, RANKS, public.PATTERN, digests=True)
    have = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in digests.collect())
    assert have == sorted((k, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for k, i, _ in want)
    assert byte_bpe.encode_documents(nothing(spark), RANKS, public.PATTERN).count() == 0


def test_sections_split_like_the_whole_text():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("ab  \n") for _ in range(rnd.randrange(60)))
        parts = list(sections(text, 7))
        assert "".join(parts) == text and sum((p.split() for p in parts), []) == text.split()
        assert sum((byte_bpe.CHUNKS.findall(p) for p in parts), []) == byte_bpe.CHUNKS.findall(text)


def whole_ids(text):
    tokenizer = Tokenizer.from_file(WORDS)
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_chunks_equal_whole_texts():
    tokenizer = Tokenizer.from_file(WORDS)
    rnd = random.Random(2)
    alphabet = "abCé.,'s \n!<|İΣ1ﬁ\x02́"
    texts = ODD + ["İ,", "end <|endoftext|> of", "a<|EndOfText|>b <|startoftext|>", "<|endoftext|", None]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    table = packing.word_table(WORDS)
    for text, ids in zip(texts, packing.tokenise(pa.array(texts), table), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_sequences_are_full_and_balanced():
    rnd = random.Random(3)
    for n in (0, 1, 7, 300):
        lengths = [rnd.choice([1, 3, 50, 400, 4096, 9000]) for _ in range(n)]
        sizes = packing.sequence_sizes(sum(lengths), 4096)
        assert sum(sizes) == sum(lengths) and all(s == 4096 or s & (s - 1) == 0 for s in sizes)
        used, pieces = [0] * len(sizes), {}
        for doc, start, length, sequence, offset in packing.assign(lengths, 4096):
            assert length > 0 and offset == used[sequence]
            used[sequence] += length
            pieces.setdefault(doc, []).append((start, length))
        assert used == sizes
        for doc, found in pieces.items():
            at = 0
            for start, length in sorted(found):
                assert start == at
                at += length
            assert at == lengths[doc]


def test_documents_go_to_the_cheapest_sequence_with_room():
    rnd = random.Random(9)
    lengths = [min(9000, int(rnd.lognormvariate(6, 1))) + 1 for _ in range(600)]
    sizes, where = packing.sequence_sizes(sum(lengths), 4096), {}
    used, costs = [0] * len(sizes), [0.0] * len(sizes)
    for doc, start, n, sequence, offset in packing.assign(lengths, 4096):
        left = min(4096, lengths[doc] - start)
        free = [s for s in range(len(sizes)) if sizes[s] - used[s] >= left] or [s for s in range(len(sizes)) if sizes[s] > used[s]]
        assert sequence == min(free, key=lambda s: (costs[s], s)) and n == min(left, sizes[sequence] - used[sequence])
        used[sequence] += n
        costs[sequence] += n + n * n / 4096
        where.setdefault(doc, []).append(sequence)
    assert used == sizes and len(where) == 600


def test_a_chunk_table_keeps_the_newer_half():
    table = ChunkTable(lambda new: (np.concatenate([np.full(len(c), int(c), np.uint32) for c in new]), np.array([len(c) for c in new])), 20)
    for low in range(0, 200, 7):
        chunks = [str(k) for k in range(low, low + 9)]
        ids, n = table.take(table.rows(chunks))
        assert n.tolist() == [len(c) for c in chunks] and ids.tolist() == [int(c) for c in chunks for _ in c]
        assert len(table) < 40
    table.serve(3)
    assert len(table) == 0


def test_short_documents_go_where_attention_is_cheapest():
    # Two long documents claim a sequence each; the cheaper sequence takes the next one.
    pieces = list(packing.assign([3000, 2000, 1000, 2192], 4096))
    where = {doc: seq for doc, start, n, seq, off in pieces if start == 0}
    assert where[0] != where[3] and where[2] in (where[0], where[1], where[3])


def test_packing_operator_keeps_every_id(spark):
    docs = awkward(spark)
    found = packing.pack(docs.where("doc_id is not null"), WORDS, group_tokens=2000, keep_ids=True).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for parts in sequences.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at
            at += length
        assert at == size and (size == 4096 or size & (size - 1) == 0)
    ids = {}
    for r in sorted(found, key=lambda r: r.start):
        if r.doc_id not in (2, 11):  # ids that repeat
            ids.setdefault(r.doc_id, []).extend(r.ids)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in ids}
    assert all(ids[k] == whole_ids(t) + [2] for k, t in texts.items()) and len(ids) == 10
    assert sum(r.length for r in found if r.doc_id == 2) == 2 * (len(whole_ids("one")) + 1)
    assert packing.pack(nothing(spark), WORDS).count() == 0
    assert packing.pack(docs, WORDS).where("doc_id is null").count() >= 2


def test_fingerprint_votes():
    rnd = np.random.default_rng(0)
    words = rnd.integers(0, 2**63, 50, dtype=np.uint64)
    pairs = words.copy()
    pairs[1:] += simhash.mix(words[:-1])
    pairs[0] += np.uint64(1)
    terms, counts = np.unique(simhash.mix(pairs), return_counts=True)
    votes = np.zeros(64)
    for t, c in zip(terms, counts, strict=True):
        bits = np.unpackbits(np.array([simhash.mix(np.array([t]))[0]], "<u8").view(np.uint8))
        votes += (1 + np.log(c)) * np.where(bits, 1, -1)
    got = np.unpackbits(simhash.fingerprint(words, 64))
    assert (got[np.abs(votes) > 1e-3] == (votes > 0)[np.abs(votes) > 1e-3]).all()
    assert not simhash.fingerprint(words[:0]).any()


def test_block_tables_find_all_near_fingerprints(spark):
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 256, (40, 16)).astype(np.uint8)
    prints = [b.tobytes() for b in base]
    for b in base:
        for n in (1, 2, 3, 4, 7):
            bits = np.unpackbits(b)
            bits[rnd.choice(128, n, replace=False)] ^= 1
            prints.append(np.packbits(bits).tobytes())
    rows = [(i, bytearray(p)) for i, p in enumerate(prints)] + [(999, None), (1000, bytearray(prints[0]))]
    frame = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
    for radius in (0, 2, 3):
        got = {(bytes(r.a), bytes(r.b)): r.distance for r in simhash.near_fingerprints(frame, radius).collect()}
        want = {}
        different = sorted(set(prints))
        for i, a in enumerate(different):
            for b in different[i + 1 :]:
                d = int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
                if d <= radius:
                    want[(a, b)] = d
        assert got == want
    assert simhash.near_fingerprints(frame.limit(0), 3).count() == 0


def expected_pairs(rows, hashes):
    """Brute force: descending ids, nulls last, ties by hash; the next of the last is the first."""
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    out = []
    for i, (k, t) in enumerate(order):
        follower = order[(i + 1) % len(order)][1]
        n = len(t) // 2
        new = t[: len(t) - n] + follower[:n]
        out.append((str(k), len(t), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("parts", ["1", "5"])
def test_edited_texts_follow_the_order_of_ids(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for docs in (awkward(spark), corpus(spark, 60), corpus(spark, 1)):
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            hashes = {r.t: r.h for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
            got = simhash.compare_with_next(docs).collect()
            assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == expected_pairs(rows, hashes)
            prints = {(str(r.doc_id), bytes(r.fingerprint).hex()) for r in simhash.fingerprints(docs).collect()}
            assert {(str(r.doc_id), r.fingerprint) for r in got} == prints
            assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert simhash.compare_with_next(nothing(spark)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_half_edited_texts_stay_nearer_than_other_texts(spark):
    got = simhash.compare_with_next(corpus(spark, 200, seed=9)).where("n_chars > 300").toPandas()
    assert got.near_edited.mean() > got.near_next.mean() + 0.1


def test_what_a_task_has_freed_goes_back_at_its_end(monkeypatch):
    from loadcast.llm import workers
    back = []
    monkeypatch.setattr(workers, "give_back", lambda: back.append(1))
    task = workers.lean(lambda batches: (b + 1 for b in batches))
    assert list(task([1, 2])) == [2, 3] and back == [1]
    first = task([1, 2])
    next(first)
    first.close()  # a task that reads no further
    assert back == [1, 1]


def test_different_parts_become_strings_in_one_call():
    import time

    import pyarrow as pa

    from loadcast.llm.text import blank_separated
    texts = pa.array([" ".join(f"wort{k}é{n}" for k in range(2000)) for n in range(100)] + ["", "a  a"], pa.large_string())

    def least(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    words, index, starts = blank_separated(texts)
    assert len(words) == 200_002 and all(type(w) is str for w in words)
    assert [words[k] for k in index[starts[100] : starts[102]]] == ["", "a", "", "a"]
    column = pa.array(words, pa.large_string())
    assert least(lambda: blank_separated(texts)) < least(column.to_pylist)
