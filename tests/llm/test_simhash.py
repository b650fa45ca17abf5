import random
import re

import pytest
import xxhash

from vitalstream.llm import simhash


def brute_fingerprint(text, words=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Smallest id reachable over links of two bits or fewer; ``fps`` is id to fingerprint."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeÉ ", k=r.randint(1, 7)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(r.randint(1, 400))]
        rows.append(" ".join(words))
        if i % 3 == 0:
            at = r.randrange(len(words))
            rows.append("  ".join([*words[:at], "changed", *words[at + 1 :]]))
            rows.append(" ".join(words).upper())
    return [*rows, rows[0], "", None, " \t\n", "ONE", "one two", "One Two\x0bthree"]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp long, component_id string")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_hot_shards_lose_no_link(spark, monkeypatch):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = r.choice(sorted(fps))
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    ids = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in ids.values()], "fp long")
    monkeypatch.setattr(simhash, "HOT_SHARD", 20)
    back = {x: i for i, x in ids.items()}
    links = [(back[r.a % 2**64], back[r.b % 2**64]) for r in simhash.links(df).collect()]
    assert all((ids[a] ^ ids[b]).bit_count() <= 2 for a, b in links)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in ids} == brute_components(ids)


def test_tree_finds_all_within_radius():
    r = random.Random(6)
    tree, held = simhash.BKTree(), []
    for _ in range(300):
        x = r.getrandbits(10)
        assert sorted(set(tree.add(x, 2))) == sorted({y for y in held if (x ^ y).bit_count() <= 2})
        held.append(x)


def test_repeated_null_and_empty(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (5, "a b c d"), (9, ""), (8, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted():
    """Documents with copies whose words are changed here and there: Jaccard of five-word shingles on both sides of 0.8."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 8)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(r.choice((12, 60, 150, 400)))]
        rows.append(" ".join(words))
        changed = list(words)
        for at in range(7, len(words), r.choice((30, 45, 50, 60, 90))):
            changed[at] = word()
        rows.append(" ".join(changed).upper() if i % 2 else "  ".join(changed))
    template = [word() for _ in range(200)]  # a chain: each step is near, its ends are not
    for k in range(8):
        rows.append(" ".join(["x%d" % j if j < 4 * k else w for j, w in enumerate(template)]))
    return [*rows, rows[0], "", None, " \t", "ONE", "one", "one two"]


def brute_similar(rows, similarity=0.8):
    def shingled(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}

    sets = {i: shingled(t) for i, t in rows}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, near


@pytest.mark.parametrize("shard", [512, 2])
def test_similar_documents_equal_exact_jaccard(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)  # groups over it meet in pairs of shards
    rows = list(enumerate(planted()))
    want, near = brute_similar(rows)
    fps = {i: brute_fingerprint(t, 5) for i, t in rows}
    assert sum((fps[i] ^ fps[j]).bit_count() > 2 for i, j in near) > 20  # beyond the radius of op2
    got = simhash.similar_documents(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int")).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert sum(i % 2 == 1 and want[i] == i for i in range(120)) > 5  # copies under 0.8 stay


def distinct_fingerprint(text):
    """Fingerprint of the five-word shingles of a text, each counted once."""
    h = [int(x) for x in set(simhash.shingles((text or "").encode(), 5).tolist())]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_trees_give_the_candidates(spark, monkeypatch):
    """What similar_documents() joins is what its trees find: with their radius cut to 2, only that; 24 holds every pair."""
    rows = list(enumerate(planted()))
    repeated = rows[20][1] + " again" + (" " + " ".join(rows[20][1].split()[:8])) * 60  # the same few shingles many times over
    rows.append((len(rows), repeated))
    want, near = brute_similar(rows)
    fps = {i: distinct_fingerprint(t) for i, t in rows}
    assert max((fps[i] ^ fps[j]).bit_count() for i, j in near) <= simhash.WIDE == 24
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want
    monkeypatch.setattr(simhash, "WIDE", 2)
    few = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    close = brute_components(fps)
    assert all(close[i] == close[c] and want[i] == want[c] for i, c in few.items())
    assert sum(i != c for i, c in few.items()) < sum(i != c for i, c in want.items())


def test_similar_documents_repeated_null_and_empty(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (5, "A b c d"), (9, ""), (8, None), (None, "only here")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stage_drops_copies_at_jaccard_0_8(spark):
    import corpus_pipeline

    rows = list(enumerate(planted()))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()}
    assert kept == {i for i, c in brute_similar(rows)[0].items() if i == c}


def test_very_long_texts(spark):
    """Past the 65,536 shingles that are counted at once, and with one word changed."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(70_000)]
    other = list(words)
    other[100] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fp for r in simhash.fingerprints(df).collect()}
    for i, t in rows[:1]:
        parts = t.split()
        hashes = [simhash.xxhash.xxh64_intdigest(" ".join(parts[k : k + 3]).encode(), 42) for k in range(len(parts) - 2)]
        assert got[i] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 1, 3: 3}
