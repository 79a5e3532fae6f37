import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from phylospan.llm import near_copies, simhash
from phylospan.llm.simhash import keep_one_of_each


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def documents():
    """Groups with one to six changed words, a large group, and texts that share half of their words."""
    rng = random.Random(4)
    words = lambda n: [f"{rng.choice('alpha beta gamma delta eps'.split())}{rng.randrange(90)}" for _ in range(n)]
    rows = []
    for g in range(30):
        base = words(200)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(200)] = "new" + str(rng.randrange(99))
            rows.append(" ".join(copy))
    base, shared = words(150), words(100)
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(150)] = "x" + str(rng.randrange(999))
        copy[rng.randrange(150)] = "y" + str(rng.randrange(999))
        rows.append(" ".join(copy))
    rows += [" ".join(shared + words(60)) for _ in range(60)]
    rows += [rows[0].upper(), rows[0], None, "", " \n", "two words", "Two  words", "one two three four five"]
    return list(enumerate(rows))


def groups(rows):
    label = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return [top(k) for k in range(len(rows))]


def test_near_copies_against_all_pairs(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, shingle_key string")
    want = sorted(set(groups(rows)))
    assert len(want) < 200 < len(rows)
    kept = corpus_pipeline.keep_distinct(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == want
    small_cells = near_copies.keep_one_of_similar(df, cell=16)
    assert sorted(r.doc_id for r in small_cells.collect()) == want
    assert near_copies.keep_one_of_similar(df.limit(0)).count() == 0


def test_fingerprints_differ_as_the_similarity_says():
    rng = np.random.default_rng(3)
    far, first = [], []
    for _ in range(300):
        n = int(rng.integers(20, 400))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        rest = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)  # similarity 0.8
        cut = int(rng.integers(0, len(rest) + 1))
        a, b = (near_copies.wide_fingerprint(np.concatenate([both, r])) for r in (rest[:cut], rest[cut:]))
        bits = np.bitwise_count(a ^ b)
        first.append(int(bits[0]))
        far.append(int(bits.sum()))
    assert 34 < np.mean(far) < 44 and max(far) <= near_copies.TOTAL and max(first) <= near_copies.FIRST


def test_trie_join_with_labels_is_all_pairs():
    rng = np.random.default_rng(4)
    u = np.sort(rng.integers(0, 1 << 9, 400, dtype=np.uint64) << np.uint64(55))
    label = np.where(rng.random(400) < 0.8, 0, rng.integers(1, 40, 400))
    ends = [np.array([150, 400]), np.array([0, 150])]
    zero = np.zeros(2, np.int64)
    i, j = simhash._trie_join(u, ends[1], ends[0], ends[1], ends[0], zero, zero, 3, label)
    found = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if label[a] != label[b]}
    want = {(a, b) for lo, hi in ((0, 150), (150, 400)) for a, b in combinations(range(lo, hi), 2) if label[a] != label[b] and np.bitwise_count(u[a] ^ u[b]) <= 3}
    assert found == want


def test_shingle_sets_of_long_texts(monkeypatch):
    whole, rng = simhash._word_runs, random.Random(1)
    texts = [" ".join(rng.choices("abcdé", k=n)) for n in (0, 1, 4, 5, 6, 300)]
    want = [near_copies.shingle_set(t).tolist() for t in texts]
    monkeypatch.setattr(near_copies, "_word_runs", lambda data: whole(data, 37))
    assert [near_copies.shingle_set(t).tolist() for t in texts] == want
    assert [len(w) for w in want] == [len(shingles(t)) for t in texts]


def test_one_id_in_several_groups(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b + " end"), (1, a + " end"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (keep_one_of_each, near_copies.keep_one_of_similar):
        kept = [(r.doc_id, r.text) for r in keep(df.where("text not like '% end'")).collect()]
        assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, a)], key=str)
    kept = [(r.doc_id, r.text) for r in near_copies.keep_one_of_similar(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, a)], key=str)


def test_bitmaps_never_hide_what_sets_share():
    """What bitmaps allow two sets to share is never less than what they do share, and little more."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 2, 15, 16, 17, 200, 350, 900)]
    sets += [np.unique(np.concatenate((s[: int(f * len(s))], rng.integers(0, 1 << 64, max(1, int((1 - f) * len(s))), dtype=np.uint64)))) for s in list(sets) for f in (0.5, 0.7, 0.9)]
    bitmaps = np.array([near_copies.bitmap(s) for s in sets], object)
    sizes = np.array([len(s) for s in sets])
    i, j = map(np.array, zip(*combinations(range(len(sets)), 2)))
    most = near_copies.most_common(bitmaps, sizes, i, j)
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (most >= shared).all() and (most <= np.minimum(sizes[i], sizes[j])).all()
    alike = (np.minimum(sizes[i], sizes[j]) > 150) & (shared / np.maximum(sizes[i], sizes[j]) > 0.4) & (sizes[i] / sizes[j] > 0.8) & (sizes[j] / sizes[i] > 0.8)
    assert alike.any() and (most - shared)[alike].max() <= 0.3 * np.maximum(sizes[i], sizes[j])[alike].max()


def test_texts_alike_below_the_similarity_make_few_pairs(spark, monkeypatch):
    """Of a group whose texts share seven tenths of their shingles, and of near copies, pairs do not grow with its square."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, base = words(300), words(200)
    texts = [" ".join(shared + words(60)) for _ in range(120)]
    for _ in range(120):
        copy = list(base)
        for k in rng.sample(range(200), 3):
            copy[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    counts = []
    plain = near_copies.written

    def counted(df, label):
        out = plain(df, label)
        if label == "proposed-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    kept = [r.doc_id for r in near_copies.keep_one_of_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    want = groups(list(enumerate(texts)))
    assert sorted(kept) == sorted(set(want)) and max(counts) <= 12 * len(texts)


def test_rows_of_a_repeated_smallest_id(spark):
    """One row stays of those that repeat a component's smallest id, that with the smallest text, beside components without repeats."""
    rows = [(1, "A b c d e f"), (1, "a b c d e f"), (2, "a b c d e F"), (3, "other words here"), (None, "other words here"), (4, "more of other words")]
    got = near_copies.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "A b c d e f"), (3, "other words here"), (None, "other words here"), (4, "more of other words")]))
