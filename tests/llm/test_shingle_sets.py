import numpy as np
import pandas as pd

from slateworks.llm import shingle_sets, simhash


def brute_sets(rows):
    out = []
    for _, t in rows:
        words = (t or "").lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_kept(rows):
    sets, parent = brute_sets(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)


def copies(seed, n):
    """Texts, copies of them with words changed so that similarities lie around 0.8, and lines that many share."""
    rng = np.random.default_rng(seed)
    words, line, rows = [f"w{i}" for i in range(400)], "this line stands in very many of the texts here", []
    for i in range(n):
        if i % 2 and rows:
            w = rows[rng.integers(len(rows))][1].split()
            for _ in range(max(1, int(len(w) * rng.uniform(0.005, 0.04)))):
                w[rng.integers(len(w))] = f"changed{i}"
        else:
            w = list(rng.choice(words, rng.integers(1, 200))) + (line.split() if i % 3 else [])
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one")]


def test_keep_one_finds_every_pair_from_four_fifths_on(spark):
    rows = copies(5, 240)
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == brute_kept(rows)
    assert len({simhash.fingerprint(t.encode()) for _, t in rows[:240]}) > 200


def test_similar_texts_with_distant_fingerprints(spark):
    words = [f"v{i}" for i in range(200)]
    other = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other))]
    a, b = brute_sets(rows)
    assert len(a & b) / len(a | b) > 0.8 and (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > 4
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]


def test_similar_sets_share_a_prefix_in_any_order():
    rng = np.random.default_rng(1)
    for _ in range(500):
        x = rng.choice(2**40, rng.integers(1, 60), replace=False).astype(np.uint64)
        y = np.unique(np.concatenate((x[rng.random(len(x)) < 0.9], rng.choice(2**40, rng.integers(0, 5)).astype(np.uint64))))
        x, common = np.unique(x), np.unique(rng.choice(x, len(x) // 2 + 1))
        if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
            firsts = [shingle_sets.prefix(s, common, np.arange(len(common), 0, -1)) for s in (x, y)]
            assert len(np.intersect1d(*firsts))


def test_bitmaps_never_tell_too_little():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(0, 400), dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64))))
        bound = shingle_sets.most_shared(len(x), shingle_sets.bitmap(x), len(y), shingle_sets.bitmap(y))
        assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_rows_leave_a_bucket_once_and_not_as_pairs():
    """60 texts of which any two may be similar, in ten buckets: a row for each text, where each pair left once for each bucket."""
    rng = np.random.default_rng(3)
    base = rng.choice(2**60, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[:280], rng.choice(2**60, 20).astype(np.uint64)))) for _ in range(60)]
    one = pd.DataFrame({"fp": range(100, 160), "place": 0, "component": range(100, 160), "side": 3, "meet": 0, "n": [len(s) for s in sets], "bits": [shingle_sets.bitmap(s).tobytes() for s in sets]})
    rows = pd.concat([one.assign(shingle=s) for s in range(10)], ignore_index=True)
    # Batches that cut a bucket in two.
    met = pd.concat(shingle_sets._meet(rows.iloc[at : at + 250].reset_index(drop=True) for at in range(0, len(rows), 250)))
    assert sorted(map(tuple, met[["leader", "fp"]].to_numpy().tolist())) == [(100, fp) for fp in range(100, 160)]
    group = one.assign(leader=100, shingles=[s.tobytes() for s in sets])
    links = pd.concat(shingle_sets._linked(iter([group])))
    assert len(links) == 59 and set(links["a"]) | set(links["b"]) == set(range(100, 160))


def test_keep_one_with_buckets_and_groups_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "STARS", 0)
    monkeypatch.setattr(shingle_sets, "MEET", 3)
    monkeypatch.setattr(shingle_sets, "SETS", 100)
    monkeypatch.setattr(shingle_sets, "MEMBERS_AT_ONCE", 5)
    rows = copies(8, 160)
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_kept(rows)
