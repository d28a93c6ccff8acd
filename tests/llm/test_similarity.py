"""SpotSigs and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from shardwright.llm.components import connected_components
from shardwright.llm.lsh_forest import CELLS, TREES, _verify, lengths, ngram_join, one_of_each_class, rarest, recall, shingle_sets
from shardwright.llm.spotsigs import ANCHORS, as_string, edited, edited_table, fingerprints, jaccard, near_pairs, representatives
from tests_brute import connected, linked_pairs, word_list

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def near_copies(seed=0, bases=6, copies=14, words=120):
    """Texts with word edits at many distances, exact copies, and a line that all share."""
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            texts.append("one line that every single text here begins with\n" + " ".join(own))
    return texts + texts[:5]


def brute_join(rows, threshold=0.8):
    pairs = linked_pairs([t for _, t in rows], threshold)
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    root = connected(pairs)
    classes = {}
    for i, (key, _) in enumerate(rows):
        classes.setdefault(root.get(i, i), []).append(key)
    least = {c: min((k for k in keys if k is not None), default=None) for c, keys in classes.items()}
    return sorted(((k, least[root.get(i, i)], links[i]) for i, (k, _) in enumerate(rows)), key=str)


def test_join_is_brute_force(spark):
    rows = list(enumerate(near_copies()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (64, 4, 1):  # a small crowd leaves most texts to shorter prefixes, then to the exact way
        got = [tuple(r) for r in ngram_join(docs, crowd=crowd).select("doc_id", "class_id", "n_links").collect()]
        assert sorted(got, key=str) == brute_join(rows)


def test_join_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr("shardwright.llm.lsh_forest.BLOCK", 7)
    rows = list(enumerate(near_copies(seed=3)))
    got = [tuple(r) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_join(rows)


def crowds_with_outliers(seed, bases=4, copies=68, outliers=9, words=150):
    """Groups whose texts differ in their last word, and texts 0.80 alike to those of one group, each edited in places of its own."""
    rng = random.Random(seed)
    texts = []
    for b in range(bases):
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(words)]
        texts += [" ".join([*base, f"copy{i}"]) for i in range(copies)]
        places = rng.sample(range(5, words - 5, 5), 3 * outliers)
        for i in range(outliers):
            own = list(base)
            for place in places[3 * i : 3 * i + 3]:
                own[place] = f"odd{b}x{place}"
            texts.append(" ".join([*own, f"outlier{i}"]))
    return texts


def test_join_keeps_the_outliers_of_a_crowd(spark):
    rows = list(enumerate(crowds_with_outliers(seed=1)))
    got = [tuple(r) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_join(rows)
    assert len({c for _, c, _ in got}) == 4


def test_join_of_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = [tuple(r) for r in ngram_join(awkward).collect()]
    assert sorted(got, key=str) == brute_join(rows)
    assert ngram_join(nothing).count() == 0
    kept = one_of_each_class(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 9, 10, 12]
    assert kept.where("doc_id = 9").count() == 1


def test_one_of_each_class_decides_by_row(spark):
    a, b, c, d = ([" ".join([f"{name}{i}" for i in range(60)] + [f"end{j}"]) for j in range(3)] for name in "abcd")
    rows = [(1, a[0]), (None, a[1]), (None, "first of no id"), (None, "second of no id"), (7, a[2]), (7, "unlike the other text of seven")]
    rows += [(8, b[0]), (8, c[0]), (8, b[0]), (9, b[1]), (10, c[1]), (None, d[0]), (None, d[1])]
    kept = [tuple(r) for r in one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of_none = [r for r in kept if r[1] in d]
    assert len(of_none) == 1
    assert sorted(set(kept) - set(of_none), key=str) == sorted([(1, a[0]), *rows[2:4], rows[5], *rows[6:8]], key=str)
    assert len(kept) == 7


def passages(seed, texts=150, pool=30, each=8, own=25):
    """Texts made of passages from a pool, in any order, with few words of their own: every trie is crowded and most pairs are not alike."""
    rng = random.Random(seed)
    parts = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(pool)]
    found = []
    for i in range(texts):
        chosen = rng.sample(parts[: 4 + 26 * (i % 3 > 0)], 4 if i % 3 == 0 else each)
        words = " ".join(chosen).split() + [f"own{i}x{k}" for k in range(own)]
        found.append(" ".join(words))
        if i % 5 == 0:
            near = list(words)
            near[rng.randrange(len(near))] = "edit"
            found.append(" ".join(near))
    return found


def test_join_of_shared_passages(spark):
    """Crowds of texts that share passages without being alike lose none of the pairs that are."""
    rows = list(enumerate(passages(seed=2)))
    expected = brute_join(rows)
    assert sum(n for *_, n in expected) >= 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (64, 2, 1):
        got = [tuple(r) for r in ngram_join(docs, crowd=crowd).collect()]
        assert sorted(got, key=str) == expected


def test_exact_way_alone(spark):
    """With a target that no prefix reaches, the rarest shingles find every pair by themselves."""
    rows = list(enumerate(near_copies(seed=9) + passages(seed=3, texts=40) + ["", None, "a b", "a b", "a c"]))
    got = [tuple(r) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), target=1.0, crowd=2).collect()]
    assert lengths(0.8, 1.0) == [] and sorted(got, key=str) == brute_join(rows)


def test_recall_bound():
    """The bound against MinHash itself: sets that share a known part, whose trees are crowded if all minima come from a passage."""
    rng = np.random.default_rng(0)
    trials, length = 4000, 4
    minima = rng.random((trials, TREES * length, 100))  # 60 members of the passage, 20 more in common, 20 of one text only
    least = minima.argmin(axis=2).reshape(trials, TREES, length)
    met = (least < 80).all(axis=2)
    crowded = (least < 60).all(axis=2)
    found = (met & ~crowded).any(axis=1)
    for c in range(4):
        chosen = crowded.sum(axis=1) == c
        if chosen.sum() > 200:
            assert found[chosen].mean() >= recall(length, c, 0.8) - 0.02
    assert met.any(axis=1).mean() >= recall(length, 0, 0.8) - 0.01
    assert lengths(0.8, 0.999) == [4, 3, 2]


def test_rarest_shingles_are_shared():
    rng = np.random.default_rng(1)
    often = rng.integers(0, 50, CELLS).astype(np.uint32)
    for _ in range(300):
        both = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        a, b = both[: rng.integers(1, 41)], both[rng.integers(0, 10) :]
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if shared >= 0.8 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(rarest(a, often, 0.8), rarest(b, often, 0.8)))


def test_verify_paths_agree():
    sets = shingle_sets(near_copies(seed=5))
    whole = {tuple(p) for p in _verify(sets, 0, True, 0.8).tolist()}
    half = len(sets) // 2
    parts = {tuple(p) for p in _verify(sets[:half], 0, True, 0.8).tolist()}
    parts |= {(i + half, j + half) for i, j in _verify(sets[half:], 0, True, 0.8).tolist()}
    parts |= {tuple(p) for p in _verify(sets, half, False, 0.8).tolist()}
    assert whole == parts
    few = sets[:10]
    expected = {(i, j) for j in range(10) for i in range(j) if jaccard_of(few[i], few[j]) >= 0.8}
    assert {tuple(p) for p in _verify(few, 0, True, 0.8).tolist()} == expected


def jaccard_of(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)]
    got = connected_components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: v for k, v in connected(pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_edited_table(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    expected = {}
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        changed = edited(text, following)
        a, b, c = fingerprints([text, changed, following])
        expected.setdefault(key, []).append((len(text), hashlib.sha256(changed.encode()).hexdigest(), as_string(a), as_string(b), jaccard(a, b), jaccard(a, c)))
    got = {}
    for r in edited_table(awkward).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert edited_table(nothing).count() == 0
    alone = edited_table(spark.createDataFrame([(5, "the cat sat on the mat")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_fingerprints():
    a, b, c, d = fingerprints(["the cat sat on the mat with a hat", "the cat sat on the mat with a hat", "", "zzz"])
    assert a.tolist() == b.tolist() and len(c) == 0 and len(d) == 1
    assert jaccard(c, c) == 1.0 and jaccard(c, a) == 0.0
    assert as_string(np.array([1, 255], np.uint32)) == "2:00000001000000ff"
    long = "The quick brown fox runs over the lazy dog to the wide river. " * 40000
    assert fingerprints([long])[0].tolist() == fingerprints(["x", long])[1].tolist()


def plain_fingerprint(text, anchors):
    """The set of (anchor, next two content words), from plain word lists; without any, of three-word runs."""
    listed = word_list(text)
    content = [(k, w) for k, w in enumerate(listed) if w not in anchors]
    found = set()
    for k, w in enumerate(listed):
        after = [c for at, c in content if at > k][:2]
        if w in anchors and len(after) == 2:
            found.add((w, *after))
    return found or {tuple(listed[i : i + 3]) for i in range(max(1, len(listed) - 2))}


def test_fingerprints_are_brute_force():
    """Sizes and likeness of fingerprints against word lists that share no code with the module."""
    rng = random.Random(11)
    pool = "the a of and cat dog river house over under quick le des und haus fluss mano casa de la".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(5, 120))) for _ in range(40)] + ["cat dog river house", "Cat"]
    ours, plain = fingerprints(texts), [plain_fingerprint(t, set(ANCHORS)) for t in texts]
    assert [len(x) for x in ours] == [len(x) for x in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert jaccard(ours[i], ours[j]) == len(plain[i] & plain[j]) / len(plain[i] | plain[j])


def test_spotsigs_join_is_brute_force(spark):
    texts = near_copies(seed=7, bases=4, copies=8)
    prints = [frozenset(int(x) for x in p) for p in fingerprints(texts)]
    rows = [(i, sorted(p)) for i, p in enumerate(prints)] + [(900, []), (901, None), (None, [1, 2])]
    signatures = spark.createDataFrame(rows, "id long, signatures array<long>")
    least = {p: min(i for i, q in enumerate(prints) if q == p) for p in prints}
    expected = {}
    for a, i in least.items():
        for b, j in least.items():
            if i < j and len(a & b) / len(a | b) >= 0.6:
                expected[i, j] = len(a & b) / len(a | b)
    for slice_rows in (1000, 2):  # small slices split every shared signature
        got = {(r["id_a"], r["id_b"]): r["likeness"] for r in near_pairs(signatures, 0.6, slice_rows).collect()}
        assert got == expected
    found = {r["id"]: r["representative"] for r in representatives(signatures).collect()}
    assert {i: found[i] for i in range(len(prints))} == {i: least[p] for i, p in enumerate(prints)} and found[900] == found[901] == 900
    assert near_pairs(signatures.limit(0)).count() == 0
