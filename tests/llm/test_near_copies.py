"""The pipeline's near-copy stage: SimHash anchors against brute force, and the rows its exact join makes in large groups."""

import random

import numpy as np
import pytest

from docloom.llm import common, resemblance, simhash


def _documents(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def _group(rng, copies, edits, words=150):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(copies):
        copy = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            copy[at] = f"e{rng.randrange(10**9)}"
        out.append(copy)
    return [" ".join(t) for t in out]


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stage_ties_texts_by_simhash(spark, monkeypatch):
    """The pairs to verify are all those within 11 bits; they hold most near copies, and the stage without its exact join drops these."""
    rng = random.Random(3)
    texts = [t for _ in range(20) for t in _group(rng, 2, [1, 2, 3])]
    docs = _documents(spark, texts)
    prints = simhash.text_prints(docs, 5).collect()
    assert len(prints) == len(texts)
    for hashes in resemblance.shingle_sets([t.encode() for t in texts]):
        row = next(r for r in prints if r["n"] == len(hashes) and r["fp"] & (2**64 - 1) == _majority(hashes.tolist()))
        assert sum(bin(row[f"m{i}"] & (2**64 - 1)).count("1") for i in range(8)) == _odd(hashes)
    fp, n = {r["tid"]: r["fp"] & (2**64 - 1) for r in prints}, {r["tid"]: r["n"] for r in prints}
    want = {(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 11 and min(n[a], n[b]) >= 0.8 * max(n[a], n[b])}
    got = [tuple(r) for r in simhash.near_pairs(simhash.text_prints(docs, 5), 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    monkeypatch.setattr(resemblance, "untied", lambda entries, *_: entries.selectExpr("tid a", "tid b").limit(0))
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()}
    sets = [_shingles(t) for t in texts]
    near = [i for i in range(len(texts)) if any(_jaccard(sets[i], sets[j]) >= 0.8 for j in range(i))]
    assert len(near) > 30 and len(set(near) - kept) >= 0.8 * len(near)


def _majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _odd(hashes):
    counts = {}
    for h in hashes.tolist():
        counts[h >> 55] = counts.get(h >> 55, 0) + 1
    return sum(c % 2 for c in counts.values())


@pytest.mark.parametrize("crowd", [20_000, 50])
def test_crowded_anchors(monkeypatch, crowd):
    """One ball of fingerprints: every pair is within the radius and the lengths, pairs grow with the texts, and all are tied."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(crowd)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 3)).astype(np.uint64), axis=1)
    fp, n, tid = (flips ^ np.uint64(0x123456789ABCDEF0)).view(np.int64), np.sort(rng.integers(100, 120, 3000)).astype(np.int32), rng.permutation(3000)
    pairs = [(a, b) for x, y in simhash._pairs_of(tid, fp, n, 0.8) for a, b in zip(x.tolist(), y.tolist())]
    place, root = {t: i for i, t in enumerate(tid.tolist())}, list(range(3000))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        i, j = place[a], place[b]
        assert ((int(fp[i]) ^ int(fp[j])) & (2**64 - 1)).bit_count() <= 11
        assert i != j and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
        root[find(i)] = find(j)
    assert len(pairs) <= simhash.NEAREST * 3000 and len({find(i) for i in range(3000)}) == 1


def test_rows_of_a_large_group(spark):
    """Texts of one passage that are no near copies of each other share keys, and the join makes few rows of them; no near pair is lost."""
    rng = random.Random(4)
    texts = _group(rng, 150, [4, 5]) + _group(rng, 6, [1, 2])
    docs, scratch = _documents(spark, texts), common.Scratch(spark, "test")
    prints = scratch.write(simhash.text_prints(docs, 5), "prints")
    shared = scratch.write(resemblance.shared_entries(resemblance.prefix_entries(docs, 5, 0.8, scratch), scratch), "shared")
    none = spark.createDataFrame([], "tid long, root long")
    pairs = {tuple(r) for r in resemblance.untied(shared, none, prints, 0.8, scratch).collect()}
    by_key = shared.alias("x").join(shared.alias("y"), "key").where("x.tid < y.tid").select("x.tid", "y.tid").distinct().count()
    tids = {r["text"]: r["tid"] for r in docs.selectExpr("text", "xxhash64(text) tid").collect()}
    sets = {tids[t]: _shingles(t) for t in texts}
    near = {(a, b) for a in sets for b in sets if a < b and _jaccard(sets[a], sets[b]) >= 0.8}
    assert near <= pairs and len(near) > 10
    assert by_key > 5000 and len(pairs) < by_key / 10


def _met(fp, n):
    """All pairs made at the anchors of these fingerprints, with repeats."""
    anchor, row = simhash.quarter_anchors(fp)
    order = np.lexsort((n[row], anchor))
    anchor, row = anchor[order], row[order]
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    out = []
    for at, run in zip(anchor[np.concatenate(([0], cuts))].tolist(), np.split(row, cuts)):
        for a, b in simhash._pairs_of(run, fp[run], n[run], 0.8, at):
            out += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())
    return out


def _ball(size, seed):
    rng = np.random.default_rng(seed)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (size, 4)).astype(np.uint64), axis=1)
    return (flips ^ np.uint64(0xFEDCBA9876543210)).view(np.int64), rng.integers(100, 120, size).astype(np.int32)


def test_pairs_of_a_large_group_are_made_once(spark):
    """Near copies meet at many anchors; each pair comes from one only, pairs grow with the group, and it is still tied as a whole."""
    made = []
    for size in (1000, 2000):
        pairs = _met(*_ball(size, 5))
        assert len(pairs) == len(set(pairs))
        label = list(range(size))
        for _ in range(10):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        assert set(label) == {0}
        made.append(len(pairs))
    assert made[1] < 2.5 * made[0]
    fp, n = _ball(60, 6)
    bits = {(a, b): (int(fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() for a in range(60) for b in range(a)}
    anchors = [set(a.tolist()) for a in map(lambda f: simhash.quarter_anchors(f)[0], np.split(fp, 60))]
    for (a, b), d in bits.items():
        common = sorted(anchors[a] & anchors[b])
        assert common or d > 11
        for at in common:
            assert simhash.first_met(fp[a : a + 1], fp[b : b + 1], at)[0] == (at == common[0])
    prints = spark.createDataFrame([(i, int(f), int(m)) for i, (f, m) in enumerate(zip(*_ball(500, 7)))], "tid long, fp long, n int")
    got = [tuple(r) for r in simhash.near_pairs(prints, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) <= {(a, b) for b in range(500) for a in range(b)}


def test_parities_leave_out_only_what_cannot_be_similar(spark):
    rng = random.Random(8)
    texts = [t for _ in range(20) for t in _group(rng, 2, [1, 2, 3])]
    prints = simhash.text_prints(_documents(spark, texts), 5)
    rows = prints.collect()
    close, allowed = set(), set()
    for x in rows:
        for y in rows:
            if x["tid"] < y["tid"] and ((x["fp"] ^ y["fp"]) & (2**64 - 1)).bit_count() <= 11 and min(x["n"], y["n"]) >= 0.8 * max(x["n"], y["n"]):
                close.add((x["tid"], y["tid"]))
                differing = sum(((x[m] ^ y[m]) & (2**64 - 1)).bit_count() for m in resemblance.SHORT_NAMES)
                if 1.8 * differing <= 0.2 * (x["n"] + y["n"]) + 1e-6:
                    allowed.add((x["tid"], y["tid"]))
    got = [tuple(r) for r in simhash.near_pairs(prints, 0.8, resemblance.SHORT_NAMES).collect()]
    assert len(got) == len(set(got)) and set(got) == allowed and len(allowed) < len(close)
    tids = {r["text"]: r["tid"] for r in _documents(spark, texts).selectExpr("text", "xxhash64(text) tid").collect()}
    sets = {tids[t]: _shingles(t) for t in texts}
    assert {(a, b) for a, b in close if _jaccard(sets[a], sets[b]) >= 0.8} <= allowed


@pytest.mark.parametrize("crowd", [20_000, 50])
def test_crowded_anchors_by_parities(monkeypatch, crowd):
    """Two groups in one ball of fingerprints: their parities keep them apart, and each is tied as a whole."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    fp, n = _ball(1000, 9)
    fp, n = fp[np.bitwise_count((fp ^ fp[0]).view(np.uint64)) <= 8], np.sort(n)
    group = np.arange(len(fp)) % 2
    marks = np.random.default_rng(9).integers(-(2**63), 2**63 - 1, (2, 8))[group]
    label = list(range(len(fp)))
    pairs = [p for i, j in simhash._pairs_of(np.arange(len(fp)), fp, n[: len(fp)], 0.8, None, marks) for p in zip(i.tolist(), j.tolist())]
    for _ in range(10):
        for i, j in pairs:
            assert group[i] == group[j]
            label[i] = label[j] = min(label[i], label[j])
    assert set(label) == {0, 1} and len(pairs) <= simhash.NEAREST * len(fp)


def test_pairs_to_verify_grow_with_the_texts(spark, monkeypatch):
    """A large group of near copies gives a few pairs for each text to the joins, and a tie for each to the last components."""
    verified, components, made = resemblance.verified, resemblance.connected_components, {}

    def counted(pairs, documents, shingle, similarity, scratch, name):
        pairs = scratch.write(pairs, f"{name}-counted")
        made[name] = pairs.count()
        return verified(pairs, documents, shingle, similarity, scratch, name)

    def tied(edges, scratch):
        made["edges"] = edges.count()
        return components(edges, scratch)

    monkeypatch.setattr(resemblance, "verified", counted)
    monkeypatch.setattr(resemblance, "connected_components", tied)
    rng = random.Random(9)
    texts = _group(rng, 400, [1, 2])
    kept = [r["doc_id"] for r in simhash.keep_one_of_each(_documents(spark, texts)).collect()]
    sets, label = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert sorted(kept) == sorted(set(label)) and len(kept) < 10
    assert 0 < made["tied"] <= simhash.NEAREST * len(texts)
    assert made["edges"] <= len(texts) + made["rest"]
