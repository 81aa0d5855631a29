import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import doubled
from verso.llm import bytes_np as B
from verso.llm import near_dups
from verso.llm.components import components


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    shared = sum(min(n, b[k]) for k, n in a.items())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def all_similarities(bags):
    """Of all pairs of bags, by products of 0/1 matrices: a column for each shingle and each time it occurs."""
    level = [[(k, j) for k, n in b.items() for j in range(n)] for b in bags]
    count = Counter(x for ks in level for x in ks)
    column = {x: i for i, x in enumerate(x for x, n in count.items() if n > 1)}
    hit = np.zeros((len(bags), len(column)), np.float32)
    for i, ks in enumerate(level):
        hit[i, [column[x] for x in ks if x in column]] = 1
    shared, size = hit @ hit.T, np.array([len(ks) for ks in level])
    return shared / (size[:, None] + size - shared) * (1 - np.eye(len(bags))) + np.eye(len(bags))


def classes(rows):
    """Brute force: all pairs that share a shingle."""
    bags, at, parent = {i: bag(t) for i, t in rows}, {}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, b in bags.items():
        for other in {o for k in b for o in at.get(k, ())}:
            if 5 * 10 * similarity(b, bags[other]) >= 40:
                x, y = root(i), root(other)
                parent[max(x, y)] = min(x, y)
        for k in b:
            at.setdefault(k, []).append(i)
    return {i: root(i) for i in parent}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"v{rng.randrange(10**6)}"
    return out


def planted(seed=4):
    rng = random.Random(seed)
    rows, at = [], 0
    for group in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 40, 300]))]
        for k in range(rng.choice([1, 2, 5, 12])):
            rows.append((at, " ".join(edited(rng, base, rng.choice([0, 0, 1, len(base) // 100, len(base) // 20])) if k else base)))
            at += 1
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = planted()
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_test_tables(spark, sf, con):
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(df).collect()}
    want = classes(rows)
    assert got == want
    kept = near_dups.one_of_each_class(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_hot_group_takes_several_rounds(spark):
    """One hub can't hold a bucket's edited copies: rounds with more hubs find the rest."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    variants = [edited(rng, base, 9) for _ in range(12)]
    rows = [(i, " ".join(edited(rng, variants[i % 12], 1 if i >= 12 else 0))) for i in range(60)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    pairs = []
    for n in (5, 40, 400):
        for e in (1, 2, 5):
            base = [f"w{rng.randrange(3000)}" for _ in range(n)] * rng.choice([1, 3])
            pairs.append((" ".join(base), " ".join(edited(rng, base, max(1, len(base) * e // 100)))))
    data, off = B.strings(pa.array([t for p in pairs for t in p]))
    text, key, weight = near_dups.elements(data, off, 5)
    sig, total = near_dups.signatures(text, key, weight, 2 * len(pairs), 2000)
    assert total.tolist() == [sum(bag(t).values()) for p in pairs for t in p] and (sig != 0).all()
    agree = (sig[0::2] == sig[1::2]).mean(axis=1)
    assert np.abs(agree - [similarity(bag(a), bag(b)) for a, b in pairs]).max() < 0.06


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def replaced(words, places, name):
    return [f"{name}_{i}" if i in places else w for i, w in enumerate(words)]


def members_and_neighbours(rng, base, n, name):
    """n texts with one word of base replaced, and for each a text with four more replaced: near to the first (0.818), not to base (0.778)."""
    first, second = [], []
    for k in range(n):
        one, *more = rng.sample(range(6, 190, 6), 5)
        first.append(replaced(base, [one], f"{name}c{k}"))
        second.append(replaced(first[-1], more, f"{name}y{k}"))
    return first, second


def found(spark, texts, settings=near_dups.Settings()):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), settings=settings).collect()}
    return got, classes(rows)


def test_many_pairs_across_the_border_of_a_class(spark):
    """Buckets with over 1,024 pairs across the border: about 250 members of the hub's class and 10 texts outside share one."""
    base = [f"w{i}" for i in range(200)]
    first, second = members_and_neighbours(random.Random(5), base, 300, "p")
    got, want = found(spark, [base, *first, *second])
    assert got == want and set(want.values()) == {0}
    got, want = found(spark, [base, *first, *second], near_dups.Settings(block_bytes=100_000))
    assert got == want


def test_refined_buckets_lose_no_link(spark):
    """Each of 150 texts is near to one member of the hub's class only, and refining may deal the two into different parts."""
    base = [f"w{i}" for i in range(200)]
    first, second = members_and_neighbours(random.Random(5), base, 150, "p")
    got, want = found(spark, [base, *first, *second], near_dups.Settings(most=16))
    assert got == want and set(want.values()) == {0}
    got, want = found(spark, [base, *first, *second], near_dups.Settings(most=16, depth=1, block_bytes=40_000))
    assert got == want


def test_forest_against_brute_force():
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)] * 2
    texts = [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(40)] + ["a b", "a b", ""]
    comp = np.array([rng.randrange(30) for _ in texts])
    text, key, weight = near_dups.elements(*B.strings(pa.array(texts)), 5)
    total = np.bincount(text, weights=weight, minlength=len(texts))
    for left, right in ((np.arange(43), np.arange(43)), (np.arange(0, 20), np.arange(20, 43))):
        a, b = near_dups.forest(total, text, key, weight, left, right, comp, 80)
        bags, mine, theirs = [bag(t) for t in texts], {x: {x} for x in range(43)}, {x: {x} for x in range(43)}
        real = [(x, y) for x in left for y in right if comp[x] != comp[y] and 50 * similarity(bags[x], bags[y]) >= 40 and bags[x]]
        for at, edges in ((mine, zip(a.tolist(), b.tolist())), (theirs, real)):
            for x, y in edges:
                if at[x] is not at[y]:
                    at[x] |= at[y]
                    for z in at[y]:
                        at[z] = at[x]
        assert real and mine == theirs


def test_links_between_texts_of_later_hubs_classes(spark):
    """The least nodes of a bucket are 80 texts near to nothing; the class to extend is that of a later hub, among over 17 unplaced nodes."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    apart = [replaced(base, rng.sample(range(6, 190, 6), 5), f"z{k}") for k in range(80)]
    first, second = members_and_neighbours(rng, base, 60, "p")
    got, want = found(spark, [*apart, base, *first, *second])
    assert got == want and len(set(want.values())) == 81


@pytest.mark.parametrize("settings", [near_dups.Settings(), near_dups.Settings(most=48)])
def test_recall_in_a_hot_group(spark, settings):
    """2,000 copies of one text, edited to similarities from 0.5 to 0.98: by similarity, how many links lie in one class."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [base] + [edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 14, 20])) for _ in range(1999)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), settings=settings).collect()}
    near = all_similarities([bag(t) for _, t in rows])
    least = np.arange(2000)
    while True:
        new = np.where(near >= 0.8 - 1e-9, least, 2000).min(1)
        if (new == least).all():
            break
        least = new
    mine = np.array([got[i] for i in range(2000)])
    together = mine[:, None] == mine
    for low in np.arange(0.8, 1, 0.05):
        links = (near >= low - 1e-9) & (near < low + 0.05) & ~np.eye(2000, dtype=bool)
        assert links.any() and together[links].mean() >= 0.98
    assert (mine == least).mean() >= 0.98 and (least[mine] == least).all()


def test_texts_that_polynomial_hashes_confuse(spark):
    a, b = doubled("alpha", "beta")
    got = near_dups.near_duplicate_classes(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes([(1, a), (2, b), (3, a)])
    keys = {i: k for i, k, _ in near_dups.signature_rows(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()}
    assert keys[1] == keys[3] != keys[2]
