"""Near copies against all pairs of shingle sets in plain Python."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tests.llm.test_operators import WORD, odd_texts
from vigitab.llm import near_copies


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute_links(texts):
    """Pairs of positions whose five-word shingle sets are equal or share four fifths."""
    sets = [brute_set(t) for t in texts]
    return [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def brute_near_roots(texts):
    """Smallest position reachable over those pairs, for every text."""
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in brute_links(texts):
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    return [root(k) for k in range(len(texts))]


def random_text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def components_of(spark, texts, **kw):
    return {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts), **kw).collect()}


def test_groups_of_any_size_and_length(spark):
    rng = random.Random(8)
    texts = [random_text(rng, n) for n in (9, 20, 60, 150, 400, 3000) for _ in range(6)]
    for k in range(36):
        texts += [edited(rng, texts[k], len(texts[k].split()) // 50) for _ in range(3)]  # up to a tenth of the shingles changes
    texts += [texts[14].upper(), texts[20] + " \t one more", " ".join(texts[25].split()[:-30])]
    got, want = components_of(spark, texts), brute_near_roots(texts)
    links = brute_links(texts)
    assert len(links) > 100 and sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    assert all(want[i] == want[got[i]] for i in got)  # nothing is joined that is not linked


def test_a_large_group_stays_whole_and_a_common_passage_joins_nothing(spark):
    rng = random.Random(5)
    base, passage = random_text(rng, 200), random_text(rng, 120)
    group = [edited(rng, base, 2) for _ in range(400)]  # far above a block, and all texts share most samples
    apart = [passage + " " + random_text(rng, 120) for _ in range(300)]  # half of the shingles in common
    twins = [edited(rng, t, 2) for t in apart[:40]]
    got = components_of(spark, group + apart + twins)
    assert {got[i] for i in range(400)} == {0}
    assert [got[i] for i in range(400, 700)] == list(range(400, 700))
    assert sum(got[700 + k] == 400 + k for k in range(40)) >= 36


def test_no_link_is_lost_in_large_blocks(spark, monkeypatch):
    rng = random.Random(11)
    passage = random_text(rng, 60)
    texts = [passage + " " + random_text(rng, 60 + k % 40) for k in range(90)]
    texts += [edited(rng, t, 1 + k % 3) for k, t in enumerate(texts)] + [" ".join(texts[k].split()[: -3 - k % 9]) for k in range(40)]
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    monkeypatch.setattr(near_copies, "ORDER_SAMPLE", 4000)
    got, want = components_of(spark, texts), brute_near_roots(texts)
    assert len(set(want)) < 100 and [got[k] for k in range(len(texts))] == want


def test_similar_sets_meet_in_their_prefixes():
    rng = np.random.default_rng(4)
    bases = [np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32)) for n in (4, 5, 9, 10, 30, 200) for _ in range(20)]
    sets = bases + [np.unique(np.r_[b[rng.random(len(b)) > 0.1], rng.integers(0, 1 << 32, len(b) // 12 + k % 2, dtype=np.uint32)]) for k, b in enumerate(bases)]
    known = np.unique(np.concatenate([b[: len(b) // 3] for b in bases]))
    row, shingle, size, left = near_copies.prefixes(sets, known, rng.permutation(len(known)) + 1, 0.8)
    own = [dict(zip(shingle[row == k].tolist(), left[row == k].tolist())) for k in range(len(sets))]
    similar = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and len(sets[a]) > 3:
            similar += 1
            assert any(min(own[a][s], own[b][s]) >= both for s in own[a].keys() & own[b].keys())
    assert similar > 40 and all(size[row == k].tolist() == [len(sets[k])] * len(own[k]) for k in range(len(sets)))


def test_candidates_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(3)
    base = random_text(rng, 150)
    texts = [edited(rng, base, 1 + k % 4) for k in range(240)]  # most pairs share half of the shingles or more
    texts += [edited(rng, t, 1) for t in texts[:20]]
    want, stored = brute_near_roots(texts), near_copies.stored
    assert 40 < len(set(want)) < 100
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    monkeypatch.setattr(near_copies, "ORDER_SAMPLE", 1000)  # as in a large table: the order knows few of the frequent shingles
    for rows in (near_copies.NODE_ROWS, 16):  # buckets as a whole, and in parts
        monkeypatch.setattr(near_copies, "NODE_ROWS", rows)
        counts = {}

        def counted(df, name):
            if name == "missing":
                assert not re.search(r"Join \[[^\]]*shingle", df._jdf.queryExecution().executedPlan().toString())
            out = stored(df, name)
            counts[name] = out.count()
            return out

        monkeypatch.setattr(near_copies, "stored", counted)
        got = components_of(spark, texts)
        assert [got[k] for k in range(len(texts))] == want
        assert 0 < counts["confirmed_missing"] <= counts["missing"] < 2 * len(texts)


def test_bucket_pairs_lose_no_similar_pair():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 32, 90, dtype=np.uint32))
    sets = [np.unique(np.r_[base[rng.random(len(base)) > rng.choice([0.03, 0.1, 0.3])], rng.integers(0, 1 << 32, k % 12, dtype=np.uint32)]) for k in range(60)]
    row, shingle, size, left = near_copies.prefixes(sets, base[:0], np.zeros(0, np.int64), 0.8)
    parity = np.array([np.frombuffer(near_copies.parity_map(s), np.uint64) for s in sets])
    label, part = np.arange(60) // 3, np.arange(60) % 2
    share = lambda a, b: (both := len(np.intersect1d(a, b))) / (len(a) + len(b) - both)
    similar = {(a, b) for a, b in itertools.combinations(range(60), 2) if share(sets[a], sets[b]) >= 0.8}
    for sides in (False, True):
        order = np.lexsort((size, shingle))
        r, last = row[order], np.flatnonzero(np.r_[np.diff(shingle[order].astype(np.int64)) != 0, True]) + 1
        ends = np.repeat(last, np.diff(np.r_[0, last]))
        x, y = near_copies.bucket_pairs(ends, part[r] if sides else np.full(len(r), -1), label[r], size[order], left[order], parity[r], 0.8)
        found = {(min(a, b), max(a, b)) for a, b in zip(r[x].tolist(), r[y].tolist())}
        meet = {(a, b) for a, b in itertools.combinations(range(60), 2) if label[a] != label[b] and (not sides or part[a] != part[b])}
        assert similar & meet <= found <= meet and len(similar & meet) > 50 and len(found) < len(meet) / 2


def test_odd_rows(spark):
    texts = odd_texts()
    docs = frame(spark, texts, ids=[None, *range(1, len(texts) - 1), 3]).withColumn("digest", F.lit("own")).withColumn("keys", F.lit(1))
    rows = sorted((tuple(r) for r in near_copies.near_copies(docs).collect()), key=repr)
    want = brute_near_roots(texts)
    assert len(rows) == len(texts) and rows == sorted(near_copies.near_copies(docs.repartition(5)).collect(), key=repr)
    by_id = {i: c for i, c in rows if i is not None and i != 3}
    assert by_id[1] == by_id[2] == 1 and (None, 1) in rows  # null, empty and blank texts are one set; a null id takes its component's id
    assert all(by_id[i] == want[i] for i in by_id if i > 2 and want[i] > 2)
    assert near_copies.near_copies(frame(spark, [])).collect() == []


def test_short_sets_and_levels():
    assert near_copies.samples(np.arange(3, dtype=np.uint64)) == [] and len(near_copies.shingle_hashes(b"a b")) == 1
    for n in range(12, 5000):
        assert 3 <= n / 2 ** near_copies.level(n) < 6
    hashes = near_copies.shingle_hashes(random_text(random.Random(1), 40_000).encode())
    whole = near_copies.samples(hashes)
    assert near_copies.SAMPLES - 2 <= len(whole) <= 2 * near_copies.SAMPLES  # above CHUNK: parts add up
    ones = [sum(int(h) >> k & 1 for h in hashes[:999]) for k in range(64)]
    assert near_copies.set_fingerprint(hashes[:999]) & (2**64 - 1) == sum(1 << k for k in range(64) if 2 * ones[k] > 999)


def test_block_links_are_a_forest_of_all_pairs_in_budget():
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(0, 1 << 63, 3, dtype=np.uint64).repeat(20) ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)))
    left, right = near_copies.block_links(np.zeros(60, np.int64), values)
    up = list(range(60))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(left, right):
        assert root(a) != root(b)
        up[root(a)] = root(b)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= near_copies.BUDGET
    assert all(root(a) == root(b) for a, b in zip(*np.nonzero(near)))
