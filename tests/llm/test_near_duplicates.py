import random
import re

import numpy as np
import xxhash

from phylospan.llm.components import connected_components
from phylospan.llm.embeddings import exact_links, near_duplicate_vectors, plan_tables
from phylospan.llm.simhash import fingerprint, keep_one_of_each, near_duplicate_classes, trie_links


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(labels, near):
    while True:
        new = np.array([labels[near[k]].min() for k in range(len(labels))])
        if (new == labels).all():
            return labels
        labels = new


def test_fingerprints():
    for t in [None, "", "  \n", "One", "One two", "ONE two three", "a b c d a b c d É é", "x\x0by\x1cz  w", "w " * 40_000]:
        assert fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_long_texts_in_runs(monkeypatch):
    from phylospan.llm import simhash

    whole = simhash._word_runs
    monkeypatch.setattr(simhash, "_word_runs", lambda data: whole(data, 37))
    rng = random.Random(9)
    for n in (1, 2, 3, 4, 50, 400):
        text = rng.choice([" ", "\n"]).join("".join(rng.choices("abcdé", k=rng.randint(1, 60))) for _ in range(n))
        assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)]
    label = {n: n for e in edges for n in e if n is not None}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == r for n, r in label.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trie_join_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    pool = set()
    for k, base in enumerate(rng.integers(0, 1 << 63, 20, dtype=np.uint64)):
        for _ in range(250 if k < 2 else 12):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            pool.add(x)
    u = np.array(sorted(pool | {0, 1, (1 << 64) - 1, (1 << 64) - 2}), np.uint64)
    ids = u.view(np.int64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    want = closed(ids.copy(), near)
    df = spark.createDataFrame([(int(v),) for v in ids], "fp long")
    place = {int(v): k for k, v in enumerate(ids)}
    for node_pair in (1024, 40):
        links = trie_links(df, 2, node_pair)
        assert all(near[place[r.a], place[r.b]] or want[place[r.a]] == want[place[r.b]] for r in links.collect())
        got = {r.node: r.root for r in connected_components(links).collect()}
        assert all(got.get(int(v), int(v)) == int(w) for v, w in zip(ids, want))


def documents():
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(80)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[0]) for k in range(30)]
    for k in range(40):
        words = base[k % 4].split()
        words[rng.randrange(80)] = "new"
        rows.append((200 + k, " ".join(words)))
    return rows + [(300, None), (301, ""), (302, "\n"), (None, base[1]), (7, base[2]), (7, base[7])]


def test_near_duplicate_classes(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, component_id int")
    got = near_duplicate_classes(df).collect()
    assert len(got) == len(rows)
    u = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    group = closed(np.arange(len(rows)), np.bitwise_count(u[:, None] ^ u[None, :]) <= 2)
    want = []
    for (i, _), f, g in zip(rows, u, group):
        ids = [rows[k][0] for k in np.flatnonzero(group == g) if rows[k][0] is not None]
        want.append((i, f"{int(f):016x}", min(ids) if ids else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert near_duplicate_classes(df.limit(0)).count() == 0


def test_keep_one_of_each(spark):
    rows = [r for r in documents() if r[0] != 7]
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, fp string, first int, Winner int")
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {r.doc_id: r.component_id for r in near_duplicate_classes(df).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(classes.values())) and ids.count(None) == 1
    assert keep_one_of_each(df.limit(0)).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([centres, centres[:30] + 0.12 * rng.standard_normal((30, 16)), np.repeat(centres[:1], 40, 0), centres[1] + 0.02 * rng.standard_normal((50, 16))]).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [nan] * 16), (904, [inf] * 16), (905, [None] * 16), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows + odd], "vec_id long, embedding array<float>, n_links int, vector string")
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    pairs = exact_links(x)
    found = sum(got[k].n_links for k in range(len(x)))
    assert 0.99 * 2 * len(pairs) <= found <= 2 * len(pairs)
    near = np.zeros((len(x), len(x)), bool)
    near[pairs[:, 0], pairs[:, 1]] = near[pairs[:, 1], pairs[:, 0]] = True
    np.fill_diagonal(near, True)
    want = closed(np.arange(len(x)), near)
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > 0.98
    for i in range(900, 906):
        assert tuple(got[i])[1:] == (0, i, True)
    assert [got[k].n_links for k in (906, 907, None)] == [2, 2, 2] and got[907].component_id == 906 and not got[None].kept
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_table_plan_grows_slowly():
    bits, tables = zip(*(plan_tables(10**k) for k in range(1, 10)))
    assert list(bits) == sorted(bits) and list(tables) == sorted(tables) and tables[-1] < 60
