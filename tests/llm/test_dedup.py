"""Operators 1, 3 and 7: near-duplicates, repeated byte strings and repeated line windows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cases import awkward, corpus, nothing, words
from loadcast.llm import line_dedup, minhash, suffix_dedup
from loadcast.llm.anchors import anchors
from loadcast.llm.components import components
from loadcast.llm.run_length_index import RunLengthIndex, joined, matched_spans, suffix_order
from loadcast.llm.text import WordHashes, shingles


# --- components ------------------------------------------------------------------------

def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_of_chains_stars_and_random_graphs(spark):
    rnd = random.Random(0)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    loose = [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    edges = chain + star + [(a, b) for a, b in loose if a != b]
    rnd.shuffle(edges)
    frame = spark.createDataFrame(edges + edges[:5] + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == roots(edges)
    assert components(frame.limit(0)).count() == 0


# --- MinHash ---------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["ones", "counts", "fractions"])
def test_signatures_estimate_weighted_similarity(kind):
    rnd = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        a = np.sort(rnd.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.sort(np.concatenate([a[60:], rnd.integers(0, 2**63, 40, dtype=np.uint64)]))
        pool = {"ones": [1.0], "counts": [1.0, 2.0, 5.0], "fractions": [0.3, 0.8, 1.7]}[kind]
        weight = dict(zip(np.union1d(a, b).tolist(), rnd.choice(pool, 400), strict=False))
        wa, wb = (np.array([weight[x] for x in s.tolist()]) for s in (a, b))
        same = minhash.dart_signature(a, wa, 128) == minhash.dart_signature(b, wb, 128)
        errors.append(same.mean() - minhash.jaccard(a, wa, b, wb))
    assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.07


def test_signature_of_one_element_fills_every_coordinate():
    one = np.array([5], np.uint64)
    assert len(np.unique(minhash.dart_signature(one, np.ones(1), 64))) == 64


def exact_classes(rows, similarity=0.8):
    known, sets = WordHashes(), {}
    for k, text in rows:
        found = set(shingles(known.of(text or ""), 5).tolist())
        if found and k is not None:
            sets.setdefault(k, []).append(found)
    links = [(a, b) for a in sets for b in sets if a < b and any(
        len(x & y) / len(x | y) >= similarity for x in sets[a] for y in sets[b])]
    found = roots(links)
    return {k: found.get(k, k) for k, _ in rows}


def test_near_classes_equal_brute_force(spark):
    for docs in (corpus(spark, 150), awkward(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = minhash.near_classes(docs).collect()
        assert len(got) == len(rows)
        want = exact_classes(rows)
        assert {r.doc_id: r.class_id for r in got} == want
    assert minhash.near_classes(nothing(spark)).count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_buckets_of_unlike_members_lose_no_link(spark, monkeypatch, block):
    """Documents that share a core but are unlike each other, with like pairs among them."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(5)
    core = words(rnd, 60, 9000)
    rows = []
    for k in range(60):
        tail = words(rnd, 45, 9000)
        rows.append((2 * k, core + " " + tail))
        if k % 7 == 0:
            rows.append((2 * k + 1, core + " " + tail + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs, bands=40, rows=2).collect()}
    assert got == exact_classes(rows)


@pytest.mark.parametrize("block", [7, 1000])
def test_chains_through_a_member_that_the_lead_has_joined(spark, monkeypatch, block):
    """L, A, B with L-A and A-B alike and L-B not; A is nearly L, so that L leads almost all of A's buckets."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(11)
    rows = []
    for k in range(60):
        own = words(rnd, 120, 9000).split(" ")
        near, far = list(own), None
        near[60] = "edit"  # five of 116 shingles
        far = list(near)
        far[18], far[100] = "other", "others"  # ten more: A-B 106/126, L-B 101/131
        rows += [(3 * k + n, " ".join(t)) for n, t in enumerate((own, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = exact_classes(rows)
    assert all(want[3 * k + 2] == 3 * k for k in range(60)) and exact_classes([r for r in rows if r[0] % 3 != 1])[2] == 2
    assert {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()} == want


def test_every_text_of_a_repeated_id_finds_its_near_copies(spark):
    rnd = random.Random(13)
    rows = []
    for k in range(20):
        texts = [words(rnd, 80, 9000) for _ in range(3)]
        rows += [(10 * k, t) for t in texts] + [(10 * k + n + 1, t + " end") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = exact_classes(rows)
    assert all(v == k - k % 10 for k, v in want.items())
    assert {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()} == want


def near_family(n, seed=12):
    """Sets of up to four edited shingle runs of one text: some alike, some not."""
    rnd = np.random.default_rng(seed)
    base, family = rnd.integers(1, 2**62, 116).astype(np.uint64), []
    for _ in range(n):
        own = base.copy()
        for at in rnd.integers(0, 112, rnd.integers(0, 5)):
            own[at : at + 5] = rnd.integers(1, 2**62, 5)[: len(own[at : at + 5])]
        family.append(np.unique(own))
    return family


@pytest.mark.parametrize("columns", [16, 2048])
def test_blocks_emit_a_spanning_set_of_the_links(monkeypatch, columns):
    monkeypatch.setattr(minhash, "COLUMNS", columns)
    sets = near_family(120)
    sets[7] = np.array([5], np.uint64)
    given = [k % 40 + 1000 if k % 3 == 0 else k for k in range(120)]  # some classes joined before
    pairs = {(a, b) for a in range(120) for b in range(a) if minhash.alike(sets[a], sets[b], 0.8)}
    before = [(k, given[k]) for k in range(120) if given[k] >= 1000]
    want = roots([*pairs, *before])
    for blocks in (1, 3):
        rows = sorted((7, min(k % blocks, o), max(k % blocks, o), k % blocks <= o, k, given[k], sets[k].tobytes())
                      for k in range(120) for o in range(blocks))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)],
                                              ["band", "i", "j", "first", "id", "root", "s"]) for part in (rows[:50], rows[50:])]
        found = [p for out in minhash.group_links(batches, 0.8) for p in zip(*out.to_pydict().values(), strict=True)]
        assert set(found) <= pairs and len(found) < 120 * (1 if blocks == 1 else 2 * blocks)
        assert roots([*found, *before]) == want


def test_links_of_a_group_grow_in_proportion():
    sizes = []
    for n in (150, 300, 600):
        sets = near_family(n)
        found = minhash.block_links(np.arange(n), np.arange(n), sets, np.ones(n, bool), 0.8)
        assert len(found) < n
        sizes.append(len(found) / n)
    assert max(sizes) < 1.5 * min(sizes)


def test_one_document_of_each_class_stays(spark):
    docs = awkward(spark)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    classes = {str(c) for k, c in exact_classes([(r.doc_id, r.text) for r in docs.collect()]).items() if k is not None}
    assert ids == sorted([*classes, "None", "None"])


def test_columns_of_any_name_survive(spark):
    rows = [(1, "a b c d e f g", "x", "y", "z"), (2, "a b c d e f g", "x", "y", "z"), (3, "other text here", "p", "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_of_id string, `a.b` string, nth string")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_counted_weights(spark):
    rows = [(1, "a b c d e " * 30), (2, "a b c d e " * 3), (3, "a b c d e " * 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    counted = {r.doc_id: r.class_id for r in minhash.near_classes(docs, counted=True).collect()}
    assert plain == {1: 1, 2: 1, 3: 1} and counted == {1: 1, 2: 2, 3: 1}


# --- repeated byte strings -----------------------------------------------------------------

def test_run_length_index_against_plain_sorting():
    rnd = np.random.default_rng(1)
    for _ in range(150):
        letters = rnd.integers(1, 4)
        pieces = list({bytes(rnd.integers(97, 97 + letters, rnd.integers(0, 30)).astype(np.uint8)) for _ in range(rnd.integers(1, 8))})
        symbols, starts, _ = joined(pa.array(pieces, pa.binary()))
        order = suffix_order(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: tuple(symbols[i:].tolist()))
        index = RunLengthIndex.build(symbols, order)
        assert len(index.heads) <= len(symbols)
        agree = index.statistics(symbols)
        for row in range(1, len(order)):
            a, b = symbols[order[row - 1] :].tolist(), symbols[order[row] :].tolist()
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert agree[order[row]] == n
        owners = rnd.integers(0, 5, len(pieces))
        got = {(int(p), s) for p, a, b in zip(*matched_spans(pa.array(pieces, pa.binary()), owners, 4), strict=True)
               for s in range(a, b - 3)}
        want = {(k, i) for k, p in enumerate(pieces) for i in range(len(p) - 3)
                if any(owners[q] < owners[k] and p[i : i + 4] in other for q, other in enumerate(pieces))}
        assert got == want


def test_equal_runs_have_equal_anchors():
    rnd = np.random.default_rng(2)
    for letters in (1, 2, 20):
        shared = rnd.integers(97, 97 + letters, 50).astype(np.uint8)
        found = []
        for _ in range(2):
            before, after = (rnd.integers(97, 97 + letters, rnd.integers(0, 90)).astype(np.uint8) for _ in range(2))
            text = np.concatenate([before, shared, after])
            hashes, first, end = anchors(text, 50)
            assert first[0] == 0 and end[-1] == len(text) and (first[1:] == end[:-1] - 49).all()
            at = len(before)
            found.append({h for h, a, b in zip(hashes.tolist(), first, end, strict=True) if a <= at and at + 50 <= b})
        assert found[0] & found[1]
    assert not len(anchors(np.zeros(49, np.uint8), 50)[0])


def expected_removal(rows, length=50):
    """Brute force over all windows; equal ids do not remove from each other, null ids take no part."""
    first = {}
    raw = [(k, (t or "").encode()) for k, t in rows]
    for k, x in raw:
        if k is not None:
            for i in range(len(x) - length + 1):
                w = x[i : i + length]
                first[w] = min(k, first.get(w, k))
    out = []
    for k, x in raw:
        gone = np.zeros(len(x), bool)
        if k is not None:
            for i in range(len(x) - length + 1):
                if first[x[i : i + length]] < k:
                    gone[i : i + length] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(k), len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removed_bytes_equal_brute_force(spark):
    rnd = random.Random(7)
    periodic = [(5 * k, ("ab" * rnd.randrange(20, 90)) + words(rnd, 10) + "é" * rnd.randrange(40)) for k in range(20)]
    for docs in (corpus(spark, 150), awkward(spark), spark.createDataFrame(periodic, "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = suffix_dedup.remove_repeats(docs).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected_removal(rows)
        assert all(r.kept_text == bytes(r.kept).decode("utf-8", "ignore") for r in got)
    assert suffix_dedup.remove_repeats(nothing(spark)).count() == 0


@pytest.mark.parametrize("part, most", [(7, 1 << 20), (50, 1 << 20), (50, 64)])
def test_a_hot_anchor_meets_the_others_as_one_row_a_task(part, most):
    rnd = random.Random(8)
    passage = words(rnd, 60, 5000)
    texts = [(k // 2 if k % 9 == 0 else k, f"{words(rnd, 9, 4000)} {passage if k % 3 else ''} {words(rnd, 9, 4000)}".encode())
             for k in range(400)]
    holders = defaultdict(set)
    for key, raw in texts:
        for anchor in anchors(np.frombuffer(raw, np.uint8), 50)[0].tolist():
            holders[anchor].add(key)
    want = {(a, k) for a, ids in holders.items() if len(ids) > 1 for k in ids}
    seen, alone = defaultdict(set), []
    for task in (texts[:170], texts[170:]):
        batches = [pa.record_batch([pa.array([k for k, _ in b], pa.int64()), pa.array([t for _, t in b], pa.binary())], ["id", "raw"])
                   for b in (task[:90], task[90:], [])]
        for out in suffix_dedup.anchor_rows(batches, 50, part, most):
            for anchor, key in zip(*(c.to_pylist() for c in out.columns), strict=True):
                seen[anchor].add(key)
                alone.append(anchor)
    got = {(a & suffix_dedup.ANCHOR, k) for a, ids in seen.items() for k in ids if a > suffix_dedup.ANCHOR or len(ids) > 1}
    assert got == want
    hot = max((len(ids), a) for a, ids in holders.items())
    assert hot[0] > 250 and (most < 1000 or alone.count(hot[1]) <= 4)


def test_blocks_and_batches_do_not_change_the_spans():
    rnd = random.Random(8)
    rows = []
    for key in range(40):
        for _ in range(rnd.randrange(1, 6)):
            piece = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(3, 12)))
            rows.append((rnd.randrange(6), piece, key, 0, rnd.randrange(50), len(piece)))
    rows = sorted(set(rows))

    def run(size, block):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows[i : i + size], strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
            ["anchor", "piece", "id", "th", "at", "size"]) for i in range(0, len(rows), size)]
        covered = defaultdict(set)
        for out in suffix_dedup.match_pieces(batches, 4, block):
            for k, _, a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
                covered[k].update(range(a, b))
        return dict(covered)

    whole = run(len(rows), 1 << 20)
    assert whole and run(7, 1 << 20) == whole and run(1, 10) == run(5, 10)


# --- line windows ---------------------------------------------------------------------------

def expected_lines(rows, window=3):
    first = {}
    docs = sorted(((k, t) for k, t in rows if t is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    for k, t in docs:
        lines = t.split("\n")
        for i in range(len(lines) - window + 1):
            place = (k is not None, k or 0, hash_of(t), i)
            w = tuple(lines[i : i + window])
            first[w] = min(place, first.get(w, place))
    out = []
    for k, t in rows:
        if t is None:
            out.append((str(k), None, 0, 0))
            continue
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - window + 1):
            if (k is not None, k or 0, hash_of(t), i) > first[tuple(lines[i : i + window])]:
                gone |= set(range(i, i + window))
        out.append((str(k), "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


HASHES = {}


def hash_of(text):
    return HASHES[text]


def test_line_windows_equal_brute_force(spark):
    rnd = random.Random(9)
    pool = [f"line {i}" for i in range(8)] + [""]
    rows = [(k // 2 if k % 5 == 0 else k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(12)))) for k in range(60)]
    made = spark.createDataFrame(rows + [(None, "a\nb\nc"), (70, "a\nb\nc"), (71, None)], "doc_id long, text string")
    for docs in (made, awkward(spark)):
        HASHES.update({r.text: r.th for r in docs.selectExpr("text", "xxhash64(text) th").collect()})
        plain = [(r.doc_id, r.text) for r in docs.collect()]
        got = line_dedup.dedup_lines(docs)
        assert set(docs.columns) <= set(got.columns)
        assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == expected_lines(plain)
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup_lines(corpus(spark, 10))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
