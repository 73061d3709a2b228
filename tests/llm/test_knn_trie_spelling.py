"""Nearest vectors, conversation trie and spelling variants against brute force, with bounds so small that every way is taken."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import nearest, spelling, tries


def srt(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- nearest vectors

VECTORS = "vec_id long, embedding array<double>, rid long, x string, score long"


def best(rows, k=5, every=50):
    """rows: (vec_id, components); by brute force with integers of any size."""
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for n, (j, v) in enumerate(good) if n != at]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return out


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.05).round(3).tolist()) for i in range(240)]
    rows += [(300 + i, [0.25] * 12) for i in range(40)]  # ties without end
    rows += [(50, rows[50][1]), (50, rows[50][1]), (100, [0.5] * 12), (7, rows[7][1])]
    rows += [(400, None), (401, []), (450, [1.0, 2.0]), (402, [0.1] * 11 + [None]), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (None, [0.1] * 12)]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"pivots": 12, "queries_held": 5, "rows_held": 20, "copies": 50}, {"pivots": 3, "queries_held": 2, "rows_held": 500}])
def test_top_k(spark, bounds):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x", 9) for i, v in rows], VECTORS).repartition(5)
    assert srt(nearest.top_k(df, every=5, **bounds).collect()) == srt(best(rows, every=5))


def test_top_k_of_large_components_and_few_rows(spark):
    rows = [(0, [1e30, -2.5]), (50, [3e9, 7e8]), (1, [3e9 + 1, 7e8]), (2, [-1e300, 0.0]), (3, [0.5, 0.5]), (4, [1e307, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 9) for i, v in rows], VECTORS)
    assert srt(nearest.top_k(df).collect()) == srt(best(rows))
    for few in ([], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, [1.0]), (1, [2.0])], [(0, []), (50, [])]):
        df = spark.createDataFrame([(i, v, 1, "x", 9) for i, v in few], VECTORS)
        assert srt(nearest.top_k(df).collect()) == srt(best(few))


def test_groups_keep_every_row_that_matters():
    """Clusters apart from each other: the bounds must leave data out, and never one of the best."""
    rng = np.random.default_rng(5)
    data = np.floor(np.concatenate([c * 900 + rng.normal(size=(60, 4)) * 8 for c in np.eye(4)]))
    longest = float((data**2).sum(1).max())
    space = nearest.Space(data, longest, 4)
    cell = space.distances(space.lengthened(data)).argmin(1)
    radius = space.distances(space.lengthened(data)).min(1)
    facts = {c: (int((cell == c).sum()), float(radius[cell == c].max())) for c in range(4)}
    asked = {}
    for c in range(4):
        q = data[cell == c]
        kth = np.sort(q @ q.T, axis=1)[:, -6]
        theta = np.sqrt((q**2).sum(1) + longest - 2 * kth)
        asked[c] = len(q), float((space.of_queries(q)[:, c] + theta).max())
    _, groups = nearest.groups_of(space, facts, asked, 100, 2)
    assert len(groups) == 4 and sum(n for _, n in groups) < 3 * len(data)


# ---- conversation trie


def trie(rows):
    """rows: (conv_id, turn, role, text); nodes by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        own[c].append((role or "", text or ""))
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        ended[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    return [
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ended[n])).encode()).hexdigest())
        for n, m in members.items()
    ]


TURNS = "conv_id long, turn long, role string, text string, depth long, chain string, ends string"


def conversations():
    rng = random.Random(9)
    rows = []
    for c in range(120):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", rng.choice(["a", "b c", "d\te  f"]) if t < 4 else rng.choice(["x", "y z"])))
    rows += [(200, t, "user", f"deep {t // 7}") for t in range(60)] + [(201, t, "user", f"deep {t // 7}") for t in range(58)] + [(202, 59, "u", "only")]
    rows += [(c, t, "user", "same again") for c in range(300, 340) for t in range(3)]  # copies of one conversation
    rows += [(5, 1, "user", "again"), (5, 1, "user", "again"), (6, None, None, None), (6, None, "zz", None), (-7, 0, "user", "a"), (-25, 0, "bot", "é  "), (None, 1, "user", "a")]
    rows += [(500, 0, "user", "long " * 50_000), (519, 0, "user", ""), (519, 1, "user", "one"), (519, 2, "user", "two"), (519, 3, "user", "three")]
    return rows


@pytest.mark.parametrize("turns", [10**6, 40, 7])
def test_prefix_trie(spark, turns):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "c", None) for r in rows], TURNS).repartition(3)
    got = tries.prefix_trie(df, turns=turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert srt(got.collect()) == srt(trie(rows))


def test_prefix_trie_of_little(spark):
    for rows in ([], [(None, 1, "a", "b")], [(1, 0, "user", "x")], [(20, 0, "user", "x"), (21, 0, "user", "y")]):
        df = spark.createDataFrame([(*r, 1, "c", None) for r in rows], TURNS)
        assert srt(tries.prefix_trie(df).collect()) == srt(trie(rows))


# ---- spelling variants


def variants(rows):
    """rows: (doc_id, text); every pair of words is compared."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [o for o in n if abs(len(o) - len(w)) < 2 and near(w, o)] for w in n}
    form = {}
    for w, others in found.items():
        top = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return out


def spelled():
    rng = random.Random(2)
    rows = []
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 10))) for _ in range(30)]
    for i in range(150):
        words = [rng.choice(bases) for _ in range(40)]
        for at in range(0, 40, 6):
            w = list(words[at])
            w[rng.randrange(len(w))] = rng.choice("abcde÷×")
            words[at] = "".join(w) if rng.random() < 0.7 else words[at][1:] + "a"
        rows.append((i, rng.choice([" ", "1", "中", "İ"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    crowd = ["".join(rng.sample("abcdefg", 7)) for _ in range(150)]  # the same letters in other orders
    rows += [(1000 + i, " ".join(crowd + [w + "z" for w in crowd[:80]] + [w.replace("a", "q") for w in crowd[:40]])) for i in range(3)]
    chain = ["kkkkkkkkk"] * 1000 + ["kkkkkkkkl"] * 100 + ["kkkkkkkll"] * 10 + ["kkkkkklll"] * 2
    rows += [(2000, " ".join(chain)), (None, "nullidword nullidword"), (2001, None), (2002, ""), (2003, "x" * 300_000 + " " + "x" * 300_000), (2003, "x" * 300_000)]
    return rows + [rows[3], rows[3]]


WORDS = "doc_id long, text string, word string, n long, length int"


@pytest.fixture(scope="module")
def expected():
    return srt(variants(spelled()))


@pytest.mark.parametrize("bounds", [{}, {"cell": 20, "crowded": 10**6}, {"cell": 20, "crowded": 60}, {"cell": 8, "crowded": 8, "sample": 40}])
def test_spelling_variants(spark, expected, bounds):
    rows = [r for r in spelled() if r[0] != 2003] if bounds.get("crowded", 0) == 8 else spelled()
    want = srt(variants(rows)) if len(rows) != len(spelled()) else expected
    df = spark.createDataFrame([(*r, "w", 1, 1) for r in rows], WORDS).repartition(4)
    got = spelling.spelling_variants(df, **bounds).collect()
    assert srt(got) == want
    assert any(r["form"] and r["root"] != r["form"] for r in got)


def test_spelling_variants_of_nothing(spark, monkeypatch):
    assert spelling.spelling_variants(spark.createDataFrame([], WORDS)).count() == 0
    monkeypatch.setattr(spelling, "CHUNK", 5)
    assert spelling._own("abcdefgh ABCDEFGH, abcdefgéh中abcdefgh1 x") == Counter({b"abcdefgh": 3, "abcdefgéh".encode("latin-1"): 1})
