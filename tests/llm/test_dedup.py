import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import order_minhash, substring_dedup, suffix_array, windows


def brute(rows, n):
    """Words kept of each row (doc_id, text): windows of n that also start in a document with a smaller id go."""
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed, n, docs=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rnd.choice([3, 200]))] + ["é", "漢字"]
    words = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    shared = [words(rnd.randint(n - 3, 2 * n)) for _ in range(6)]
    rows = [(d, " \n".join(rnd.choice(shared) if rnd.random() < 0.5 else words(rnd.randint(0, 20)) for _ in range(rnd.randint(0, 6)))) for d in range(docs)]
    rows += [(docs, rows[3][1]), (docs + 1, rows[3][1]), (2, rows[2][1]), (2, rows[5][1]), (None, rows[3][1]), (docs + 2, None), (docs + 3, ""), (docs + 4, words(3000))]
    rnd.shuffle(rows)
    return rows


def got(df):
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize(("operator", "n", "m"), [(substring_dedup, 13, 5), (suffix_array, 13, 5), (suffix_array, 50, 8)])
@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, operator, n, m, seed):
    rows = corpus(seed, n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(operator.deduplicated(df, n, m)) == brute(rows, n)


@pytest.mark.parametrize(("operator", "limits"), [(substring_dedup, (2, 10**6)), (suffix_array, (2, 10**6)), (substring_dedup, (10**6, 20))])
def test_split_minimisers_and_shards_like_brute_force(spark, operator, limits):
    rows = corpus(4, 13, 30)
    passage = " ".join(f"p{i}" for i in range(20))
    rows += [(500 + i, f"a{i} b{i % 7} {passage} c{i % 5} d{i}") for i in range(40)]  # one passage, other neighbours
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(operator.deduplicated(df, 13, 10, limits=limits)) == brute(rows, 13)


def test_equal_hashes_of_other_words_are_told_apart(monkeypatch):
    """All segment hashes are made equal: only the words tell which of them a smaller document holds."""
    real = windows.segments_of
    monkeypatch.setattr(windows, "segments_of", lambda *a: (*(r := real(*a))[:4], r[4] * np.uint64(0)))
    texts = [" ".join(f"{a}{i}" for i in range(3)) + " k l m n o p q r s t" for a in "xyx"]
    sent = list(windows._requests(np.array([1, 2, 3]), np.zeros(3, np.int64), [t.encode() for t in texts], 13, 5, 1))
    assert sum(meta is not None and len(windows._unpacked(meta, windows._META)[0]) for _, meta, _ in sent) == 2
    of, at, size, ids, _ = windows._unpacked(sent[-1][2], [np.int32, np.int32, np.int32, np.int64, np.int64])
    assert ids[of].tolist() == [3] and at.tolist() == [0] and size.tolist() == [13]


@pytest.mark.parametrize("operator", [substring_dedup, suffix_array])
def test_texts_of_one_id_whose_hashes_agree_in_16_bits(spark, operator):
    shared = " ".join(f"s{i}" for i in range(60))
    seen = {}
    for i in range(100_000):  # long ones hold the shared passage, short ones do not
        for text in (f"a{i} {shared} b", f"c{i} d e"):
            seen.setdefault(xxhash.xxh64_intdigest(text.encode(), seed=42) & 0xFFFF, {})[len(text) > 100] = text
    long, short = next(v.values() for v in seen.values() if len(v) == 2)
    rows = [(1, shared), (2, long), (2, short)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.selectExpr("xxhash64(text) & 65535 as h").distinct().count() == 2
    assert got(operator.deduplicated(df)) == brute(rows, operator.WINDOW)
    words = " ".join(f"x{i}" for i in range(60))
    rows = [(1, words), (5, words), (5, "short 69490")]
    assert got(operator.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, operator.WINDOW)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_words string, starts int")
    assert substring_dedup.deduplicated(df).count() == 0
    text = " ".join(f"x{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, "a", 1), (2, text, "b", 2)], "doc_id long, text string, n_words string, starts int")
    rows = {r.row.doc_id: r for r in substring_dedup.deduplicated(df).collect()}
    assert rows[2].row.n_words == "b" and rows[2].n_removed == 20 and rows[2].kept == "" and rows[1].kept == text
    assert [tuple(s) for s in rows[2].spans] == [(0, 20)]


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_like_the_full_table():
    rnd = random.Random(5)
    for _ in range(400):
        size = rnd.choice([2, 50])
        a = [rnd.randrange(size) for _ in range(rnd.randint(0, 30))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            if b:
                k = rnd.randrange(len(b))
                b[k : k + rnd.randint(0, 1)] = [rnd.randrange(size)] * rnd.randint(0, 1)
        x, y, d, longer = np.array(a, np.uint32), np.array(b, np.uint32), full_distance(a, b), max(len(a), len(b))
        for least in (0.8, 0.5):
            most = int((1 - least) * longer + 1e-9)
            want = 1.0 if not longer else 1 - d / longer if d <= most else 0.0
            assert order_minhash.edit_similarity(x, y, least) == pytest.approx(want)
            if longer and abs(len(a) - len(b)) <= most:
                assert min(order_minhash._banded(x, y, most), most + 1) == min(d, most + 1)


def test_chains_settle_only_what_alignment_would():
    rnd = random.Random(6)
    settled = 0
    for _ in range(300):
        size = rnd.choice([3, 40, 1000])
        a = [rnd.randrange(size) for _ in range(rnd.randint(65, 120))]
        b = list(a)
        for _ in range(rnd.randint(0, 30)):
            k = rnd.randrange(len(b))
            b[k : k + rnd.randint(0, 1)] = [rnd.randrange(size)] * rnd.randint(0, 1)
        x, y, d, longer = np.array(a, np.uint32), np.array(b, np.uint32), full_distance(a, b), max(len(a), len(b))
        assert order_minhash._chained(x, y) >= d
        settled += order_minhash._chained(x, y) <= int(0.2 * longer + 1e-9)
        assert order_minhash.similar(x, y) == (d <= int(0.2 * longer + 1e-9))
    assert settled > 50


def test_sketches_follow_order():
    words = [f"w{i}".encode() for i in range(300)]
    turned = words[150:] + words[:150]
    other = [f"v{i}".encode() for i in range(300)]
    same = lambda a, b: (order_minhash.sketches(a) == order_minhash.sketches(b)).mean()
    assert same(words, words[:100] + [b"x"] + words[101:]) > 0.7
    assert same(words, turned) < 0.85 and same(words, other) == 0


def near_corpus():
    rnd = random.Random(7)
    rows, group = [], {}
    for g in range(40):
        words = [f"t{rnd.randrange(5000)}" for _ in range(rnd.randint(40, 200))]
        for c in range(rnd.choice([1, 1, 2, 3, 12])):
            own = list(words)
            for _ in range(int(len(own) * 0.04) if c else 0):
                own[rnd.randrange(len(own))] = f"t{rnd.randrange(5000)}"
            rows.append((len(rows), (" " if c % 2 else "\n").join(own)))
            group[len(rows) - 1] = g
    return rows, group


def test_near_copies_like_brute_force(spark):
    rows, group = near_corpus()
    extra = [(1000, None), (1001, ""), (1002, ""), (1003, "one two"), (1004, "one two"), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, class_id string").repartition(4)
    found = [(r.row.doc_id, r.class_id) for r in order_minhash.near_copies(df).collect()]
    assert len(found) == len(rows) + len(extra)
    by_id = dict(found)
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, i), i)
    assert all(by_id[i] == least[g] for i, g in group.items())
    assert by_id[1000] == 1000 and by_id[1001] == by_id[1002] == 1001 and by_id[1003] == by_id[1004] == 1003 and by_id[None] is None
    kept = [r.doc_id for r in order_minhash.deduplicated(df).collect()]
    assert sorted(k for k in kept if k is not None and 0 < k < 1000) == sorted(v for v in least.values() if v)
    assert order_minhash.near_copies(df.limit(0)).count() == 0


def test_rows_with_the_same_id_are_kept_apart_by_their_words(spark):
    rnd = random.Random(12)
    text = lambda: [f"t{rnd.randrange(5000)}" for _ in range(80)]
    near = lambda words: " ".join([*words[:40], "other", *words[41:]])
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, " ".join(a)), (5, " ".join(b)), (5, " ".join(c)), (5, " ".join(d)), (6, near(b)), (7, near(c)), (8, near(d)), (9, near(a)), (5, near(a)), (10, " ".join(text()))]
    rows += [rows[0], rows[0], rows[4], (None, rows[0][1]), (None, rows[0][1]), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.row.doc_id, r.row.text): r.class_id for r in order_minhash.near_copies(df).collect()}
    assert found[6, near(b)] == found[7, near(c)] == found[8, near(d)] == found[5, rows[1][1]] == found[5, rows[3][1]] == 5
    assert found[5, near(a)] == found[9, near(a)] == found[1, rows[0][1]] == 1 and found[10, rows[9][1]] == 10
    kept = sorted(map(tuple, order_minhash.deduplicated(df).collect()), key=str)
    assert kept == sorted([rows[0], *rows[1:4], rows[9], *rows[-3:]], key=str)


def test_buckets_whose_smallest_node_matches_nobody(spark):
    """A bucket of one shared key: all links of brute force must be found, though no next sketches agree."""
    rnd = random.Random(13)
    texts = [[f"t{rnd.randrange(5000)}" for _ in range(60)]]
    for _ in range(5):
        own = [f"t{rnd.randrange(5000)}" for _ in range(60)]
        for _ in range(6):
            texts.append(own)
            own = list(own)
            for k in rnd.sample(range(60), 8):  # versions drift: neighbours are similar, the ends are not
                own[k] = f"t{rnd.randrange(5000)}"
    order = [0, *rnd.sample(range(1, len(texts)), len(texts) - 1)]
    codes = [np.array([int(w[1:]) for w in texts[i]], np.uint32) for i in order]
    want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if order_minhash.similar(codes[a], codes[b])}
    assert want and not any(a == 0 for a, _ in want)
    rows = spark.createDataFrame([(key, i) for i in range(len(codes)) for key in (7, 8)], "bucket long, id long")
    sizes = spark.createDataFrame([(i, 60) for i in range(len(codes))], "id long, n int")
    asked = []

    def verified(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return spark.createDataFrame([p for p in asked if p in want], "a long, b long")

    none = spark.createDataFrame([], "id long, class_id long")
    found = {r.id: r.class_id for r in order_minhash.among_classes(rows, sizes, none, verified, 0.8).collect()}
    parent = list(range(len(codes)))
    for _ in codes:
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert [found.get(i, i) for i in range(len(codes))] == parent
    assert len(set(asked)) == len(asked) and len(set(parent)) > 1


def test_rounds_leave_out_no_bucket(spark):
    """A bucket of more than FINE nodes, in which only the two largest are similar, beside a short one."""
    texts = [[100 * i + k for k in range(20)] for i in range(44)]
    texts.append([*texts[-1][:-1], 1])
    codes = {i: np.array(t, np.uint32) for i, t in enumerate(texts)}
    held = [(7, i) for i in range(45)] + [(8, 3), (8, 4)]
    rows = spark.createDataFrame(held, "bucket long, id long")
    sizes = spark.createDataFrame([(i, 20) for i in codes], "id long, n int")
    asked = []

    def verified(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        good = [p for p in asked if order_minhash.similar(codes[p[0]], codes[p[1]])]
        return spark.createDataFrame(good, "a long, b long")

    none = spark.createDataFrame([], "id long, class_id long")
    found = {r.id: r.class_id for r in order_minhash.among_classes(rows, sizes, none, verified, 0.8).collect()}
    assert found == {43: 43, 44: 43}
    assert len(set(asked)) == len(asked) and len(asked) > 900


def short_corpus(most=14):
    """Short texts and versions of them with a few words edited."""
    rnd = random.Random(18)
    word = lambda: f"s{rnd.randrange(60)}"
    texts = []
    for n in [*range(1, most + 1)] * 12:
        texts.append([word() for _ in range(n)])
        for _ in range(2):
            own = list(texts[-1])
            for _ in range(rnd.randint(1, 2)):
                k = rnd.randrange(len(own) + 1)
                own[k : k + rnd.randrange(2)] = [word()] * rnd.randrange(2)
            if 0 < len(own) <= most:
                texts.append(own)
    return texts


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_short_near_copies_have_words_left_in_common(similarity):
    texts = short_corpus()
    keys = [set(order_minhash.shortened([w.encode() for w in t], similarity)) for t in texts]
    codes = [np.array([int(w[1:]) for w in t], np.uint32) for t in texts]
    found = 0
    for a in range(len(texts)):
        for b in range(a):
            longer = max(len(texts[a]), len(texts[b]))
            if int((1 - similarity) * longer + 1e-9) <= order_minhash.EDITS and texts[a] != texts[b] and order_minhash.similar(codes[a], codes[b], similarity):
                found += 1
                assert keys[a] & keys[b]
    assert found > 20 or similarity >= 0.9
    assert max(map(len, keys)) <= 106


def test_short_near_copies_are_one_class(spark):
    """Texts of up to 14 words, most edits of which leave no run of five words: all links of brute force."""
    texts = [*short_corpus(), "a b c d".split(), "a b c d e".split()]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    number = {w: i for i, w in enumerate({w for t in texts for w in t})}
    codes = [np.array([number[w] for w in t], np.uint32) for t in texts]
    parent = list(range(len(rows)))
    links = [(b, a) for a in range(len(rows)) for b in range(a) if order_minhash.similar(codes[a], codes[b])]
    for _ in rows:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.row.doc_id: r.class_id for r in order_minhash.near_copies(df).collect()}
    assert [found[i] for i in range(len(rows))] == parent
    assert found[len(rows) - 1] == len(rows) - 2


def spread_corpus(versions):
    """Texts, and versions with every fifth word edited: no run of five words is left, at an edit similarity of 0.8."""
    rnd = random.Random(19)
    word = lambda: f"r{rnd.randrange(4000)}"
    texts = []
    for count in versions:
        base = [word() for _ in range(rnd.choice([50, 100, 150]))]
        texts.append(base)
        for _ in range(count):
            first = rnd.randrange(5)
            texts.append([word() if k % 5 == first else w for k, w in enumerate(base)])
    return texts


@pytest.mark.parametrize("versions", [(1, 2, 3, 5, 8, 13), (50, 2, 40)])
def test_near_copies_without_a_common_run_are_one_class(spark, versions):
    """All links of brute force, in buckets of rare runs of up to FINE nodes and of more."""
    texts = spread_corpus(versions)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    codes = [np.array([int(w[1:]) for w in t], np.uint32) for t in texts]
    parent = list(range(len(rows)))
    for _ in range(3):
        for a in range(len(rows)):
            for b in range(a):
                if order_minhash.similar(codes[a], codes[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.row.doc_id: r.class_id for r in order_minhash.near_copies(df).collect()}
    assert [found[i] for i in range(len(rows))] == parent and len(set(parent)) == len(versions)


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_near_copies_have_a_rare_run_in_common(similarity):
    texts = [[w.encode() for w in t] for t in [*short_corpus(30), *spread_corpus((2, 3))]]
    codes = [np.array([int(w[1:]) + 5000 * (w[:1] == b"r") for w in t], np.uint32) for t in texts]
    counts = np.random.default_rng(1).integers(0, 3, order_minhash.CELLS)
    grams, of = order_minhash._rare(texts, counts, similarity)
    held = [set(grams[of == i].tolist()) for i in range(len(texts))]
    found = [(a, b) for a in range(len(texts)) for b in range(a) if order_minhash.similar(codes[a], codes[b], similarity)]
    assert len(found) > 100 and all(held[a] & held[b] for a, b in found if len(texts[a]) > 1 and len(texts[b]) > 1)
    if similarity == 0.8:
        long = [i for i, t in enumerate(texts) if len(t) >= 50]
        assert sum(len(held[i]) for i in long) < 0.6 * sum(len(texts[i]) for i in long)


def test_versions_that_differ_from_the_smallest_are_one_class(spark):
    """Half of each text is shared, in one bucket; the rest differs between the smallest and the others, and drifts."""
    rnd = random.Random(14)
    word = lambda: f"t{rnd.randrange(5000)}"
    shared = [word() for _ in range(75)]
    rows = [(0, " ".join(shared + [word() for _ in range(25)]))]
    for _ in range(6):
        family = [word() for _ in range(25)]
        for _ in range(5):
            own = list(family)
            for k in rnd.sample(range(25), 7):
                own[k] = word()
            rows.append((len(rows), " ".join(shared + own)))
    codes = [np.array([int(w[1:]) for w in t.split()], np.uint32) for _, t in rows]
    parent = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if order_minhash.similar(codes[a], codes[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.row.doc_id: r.class_id for r in order_minhash.near_copies(df).collect()}
    assert [found[i] for i in range(len(rows))] == parent and len(set(parent)) > 1


def test_versions_in_a_long_bucket_are_one_class(spark):
    """As above, with more nodes in a bucket than FINE: families that are alike only among themselves."""
    rnd = random.Random(15)
    word = lambda: f"t{rnd.randrange(5000)}"
    shared = [word() for _ in range(75)]
    rows = [(0, " ".join(shared + [word() for _ in range(25)]))]
    for _ in range(24):
        family = [word() for _ in range(25)]
        for _ in range(5):
            own = list(family)
            for k in rnd.sample(range(25), 8):
                own[k] = word()
            rows.append((len(rows), " ".join(shared + own)))
    codes = [np.array([int(w[1:]) for w in t.split()], np.uint32) for _, t in rows]
    links = [(b, a) for a in range(len(rows)) for b in range(a) if order_minhash.similar(codes[a], codes[b])]
    parent = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.row.doc_id: r.class_id for r in order_minhash.near_copies(df).collect()}
    assert [found[i] for i in range(len(rows))] == parent and len(set(parent)) > 20


def test_parts_of_a_long_bucket_like_all_pairs(spark):
    rnd = random.Random(16)
    texts = [[rnd.randrange(3) for _ in range(rnd.randint(12, 16))] for _ in range(90)]
    codes = [np.array(t, np.uint32) for t in texts]
    counts = order_minhash._overlaps([order_minhash._labelled(c.astype(np.uint64)) for c in codes], [order_minhash._labelled(c.astype(np.uint64)) for c in codes], 16)
    assert all(counts[a, b] == order_minhash._in_common(codes[a], codes[b]) for a in range(90) for b in range(90))
    rows = [(b, i, len(texts[i]), i, 0, 60, 400) for b in (1, 2) for i in range(30 * b - 30, 30 * b + 30)]
    state = spark.createDataFrame(rows, "bucket long, id long, n int, class long, low long, held long, words long")
    named = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(codes)], "id long, codes binary")
    none = spark.createDataFrame([], "id long, class_id long")
    parent = list(range(90))
    for _ in texts:
        for a in range(90):
            for b in range(max(0, a // 30 * 30 - 30), a):
                if order_minhash.similar(codes[a], codes[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    for block in (7, 100):
        found = {r.id: r.class_id for r in order_minhash.across_blocks(state, none, named, 0.8, block).collect()}
        assert [found.get(i, i) for i in range(90)] == parent
    assert 10 < len(set(parent)) < 90


def test_chains_of_links_are_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 105), (101, 105), (50, 60)], "a long, b long")
    found = {r.id: r.class_id for r in order_minhash.classes(links).collect()}
    assert {found[i] for i in range(31)} == {0} and found[105] == found[101] == 100 and found[60] == 50
    assert order_minhash.classes(links.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    from tessera.llm.queries import op1_substring_dedup

    rows = corpus(9, 13)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted([(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 13)], key=str)


def test_memory_of_sending_is_bounded():
    """A task holds a few MB of text at a time, with about 25 bytes for each of its characters."""
    rnd = random.Random(17)
    words = [f"v{i}" for i in range(20_000)]
    rows = [(i, i, " ".join(rnd.choices(words, k=2000))) for i in range(600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 100], strict=True)], ["a", "b", "c"]) for k in range(0, 600, 100)]
    tracemalloc.start()
    try:
        for sent in windows._send(iter(batches), 13, 5, 4):
            assert sent.num_rows
        assert tracemalloc.get_traced_memory()[1] < 120_000_000
    finally:
        tracemalloc.stop()


def test_memory_of_splitting_texts_is_bounded():
    """A batch of any number of texts is split into words SPLIT characters at a time, and rare runs are sent as they come."""
    rnd = random.Random(23)
    words = [f"v{i}" for i in range(20_000)]
    texts = [" ".join(rnd.choices(words, k=400)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, "a b", "b " * 300_000, *texts[:9]])], ["text"])
    counts = np.zeros(order_minhash.CELLS, np.int32)
    for run in (lambda it: order_minhash._sketch(it, 0.8), lambda it: order_minhash._dealt(it, counts, 0.8, 8)):
        tracemalloc.start()
        try:
            rows = [out.num_rows for out in run(iter([batch]))]
            assert tracemalloc.get_traced_memory()[1] < 100_000_000
        finally:
            tracemalloc.stop()
        assert len(rows) > 1
    assert [k for g in order_minhash._texts(iter([batch])) for k, _ in g] == [hashlib.sha256(" ".join(t.split()).encode()).digest() for t in batch.column(0).to_pylist()[:-9]]


def test_classes_by_id_are_those_of_the_rows(spark):
    """Copies, near copies, null texts and ids; no text is sent by the last join."""
    base = [f"c{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (3, " ".join(base)), (4, " ".join([*base, "more"])), (3, "other words"), (7, None), (None, "other words"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = order_minhash.class_ids(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row#" not in plan
    want = sorted(((r.row.doc_id, r.class_id) for r in order_minhash.near_copies(df).collect()), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) == len(rows) and (5, 3) in want and (4, 3) in want


def test_pairs_of_rare_buckets_like_brute_force():
    """Buckets of up to a bound give pairs with the number of buckets that they share, in any groups; the rows of longer ones stay."""
    rnd = random.Random(29)
    size = {i: rnd.randint(20, 60) for i in range(80)}
    kind = {i: i // 3 * 3 for i in size}
    rows = [(b, i, size[i], kind[i]) for b in range(40) for i in rnd.sample(range(80), 30 if b < 3 else rnd.randint(2, 9))]
    part = pa.table(dict(zip(("part", "bucket", "id", "n", "class"), ([0] * len(rows), *zip(*rows, strict=True)), strict=True)), pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("class", pa.int64())]))
    state = order_minhash._mixed_buckets(part, 0.8).to_pylist()
    members = {}
    for r in state:
        members.setdefault(r["bucket"], []).append(r)
    want = {}
    for held in (m for m in members.values() if len(m) <= 9):
        for x in held:
            for y in held:
                if x["id"] < y["id"] and x["class"] != y["class"] and abs(x["n"] - y["n"]) <= 0.2 * max(x["n"], y["n"]) + 1e-9:
                    want[x["id"], y["id"]] = want.get((x["id"], y["id"]), 0) + 1
    for most in (20, 1_000_000):
        order_minhash.PAIRS, before = most, order_minhash.PAIRS
        try:
            out = [r for b in order_minhash._paired(part, 0.8, 5, 9) for r in b.to_pylist()]
        finally:
            order_minhash.PAIRS = before
        assert sorted(r["id"] for r in out if r["home"] is None) == sorted(r["id"] for m in members.values() if len(m) > 9 for r in m) != []
        found, good = {}, set()
        for home in {r["home"] for r in out} - {None}:
            blobs = [r["pairs"] for r in out if r["home"] == home]
            for p in np.concatenate([np.frombuffer(b, order_minhash._PAIR) for b in blobs]).tolist():
                found[p[0], p[1]] = found.get((p[0], p[1]), 0) + p[2]
                assert p[3] == min(order_minhash.SHARED + min(size[p[0]], size[p[1]]) // order_minhash.FURTHER, order_minhash._least_shared(np.array([max(size[p[0]], size[p[1]])]), 0.8)[0])
            good |= {(r["a"], r["b"]) for r in order_minhash._enough(pa.table({"pairs": pa.array(blobs, pa.binary())})).to_pylist()}
        assert found == want and len(want) > 100
        assert good == {p for p, n in want.items() if n >= order_minhash.SHARED + min(size[p[0]], size[p[1]]) // order_minhash.FURTHER}


def test_buckets_of_one_passage_are_compared_as_one(spark):
    """Texts that share many long buckets are sent once, not once a bucket."""
    state = spark.createDataFrame([(b, i, 100, i, 0, 50, 5000) for b in range(30) for i in range(50)], "bucket long, id long, n int, class long, low long, held long, words long")
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 32, 100, np.uint32)
    texts = [np.where(np.arange(100) < 90 if i < 25 else np.arange(100) < 10, base, rnd.integers(0, 1 << 32, 100, np.uint32)) for i in range(50)]
    codes = spark.createDataFrame([(i, t.astype(np.uint32).tobytes()) for i, t in enumerate(texts)], "id long, codes binary")
    made = []
    real, order_minhash.written = order_minhash.written, lambda df: made.append(real(df)) or made[-1]
    try:
        found = {r.id: r.class_id for r in order_minhash.across_blocks(state, spark.createDataFrame([], "id long, class_id long"), codes, 0.8).collect()}
    finally:
        order_minhash.written = real
    assert found == {i: 0 for i in range(25)}
    assert [len(r.places) for r in made[0].collect()] == [1] * 50


def test_codes_of_wanted_texts_only(spark):
    rows = [(i, f"w{i} x{i % 7}  y") for i in range(500)]
    texts = spark.createDataFrame(rows, "id long, text string")
    nodes = texts.select(order_minhash._key(texts.text).alias("words"), "id")
    found = {r.id: np.frombuffer(r.codes, np.uint32).tolist() for r in order_minhash.coded(texts.select("text"), nodes.where("id % 50 = 0")).collect()}
    assert found == {i: [order_minhash._hash(w.encode()) >> 32 for w in t.split()] for i, t in rows if i % 50 == 0}
    every, few = np.full(order_minhash.WANTED // 8, 255, np.uint8), np.zeros(order_minhash.WANTED // 8, np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["text"])
    assert [sum(b.num_rows for b in order_minhash._codes(iter([batch]), w)) for w in (every, few)] == [500, 0]


@pytest.mark.parametrize("operator", [substring_dedup, suffix_array])
def test_small_tables_are_joined_like_large_ones(spark, operator):
    """The shuffle of the texts grows in proportion: no broadcast join that gives way to another one as the table grows."""
    text = " ".join(f"x{i}" for i in range(60))
    df = operator.deduplicated(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    assert [r.n_removed for r in sorted(df.collect(), key=lambda r: r.row.doc_id)] == [0, 60]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
