import random

import numpy as np

from vitalstream.llm import decontaminate


def exact_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 6))) if r.random() < 0.7 else r.choice(["the", "of", "and"])
    items = [(i, " ".join(word() for _ in range(n)).capitalize() + ".") for i, n in enumerate((3, 5, 9, 15, 15, 25, 40))]
    docs, planted = [], set()
    for d in range(60):
        words = [word() for _ in range(r.randint(0, 60))]
        if d % 2 == 0:
            k = r.randrange(len(items))
            w = items[k][1].lower().rstrip(".").split()
            most = decontaminate.budget(len(w))
            edits = r.randint(0, most)
            for at in r.sample(range(len(w)), edits):
                w[at] = word() + "q"
            at = r.randint(0, len(words))
            words[at:at] = [x.upper() if r.random() < 0.1 else x + r.choice(["", ",", "!"]) for x in w]
            planted.add((d, items[k][0]))
        docs.append((d, " ".join(words)))
    return items, docs, planted


def brute(items, docs):
    out = set()
    for d, text in docs:
        words = decontaminate.folded((text or "").encode())
        for k, t in items:
            item = decontaminate.folded((t or "").encode())
            most = decontaminate.budget(len(item))
            if not item:
                continue
            for n in range(len(item) - most, len(item) + most + 1):
                if any(exact_distance(item, words[i : i + n]) <= most for i in range(len(words) - n + 1)):
                    out.add((d, k))
                    break
    return out


def test_finds_what_brute_force_finds(spark):
    items, docs, planted = fixture()
    want = brute(items, docs)
    assert planted <= want
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, edits int")
    b = spark.createDataFrame([(*x, "u") for x in items], "item_id long, text string, doc_id string")
    rows = decontaminate.leaks(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert all(r.edits <= decontaminate.budget(len(decontaminate.folded(items[r.item_id][1].encode()))) for r in rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, block=3).collect()} == got
    clean = {r.doc_id for r in decontaminate.without_leaks(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, k in got if k}  # item 0 has under five words


def test_nulls_short_items_and_empty_tables(spark):
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "too short"), (3, None), (None, "one two three four five six"), (4, "")], "item_id long, text string")
    rows = [(1, "xx one two three four five six yy"), (1, "xx one two three four five six yy"), (2, None), (3, ""), (4, "too short"), (None, "One, two three four five six!")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.leaks(d, b).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.first_word, r.n_words, r.edits) for r in got) == [(-1, 1, 0, 6, 0), (1, 1, 1, 6, 0), (1, 1, 1, 6, 0), (4, 2, 0, 2, 0)]
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0
    assert decontaminate.without_leaks(d, b.limit(0)).count() == len(rows)
    more = spark.createDataFrame([(5, "Too short!"), (6, "this is too short to tell")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.without_leaks(more, b).collect()] == [6]


def test_shared_and_missing_ids(spark):
    texts = [" ".join(f"{w}{k}" for w in ("one", "two", "three", "four", "five", "six")) for k in range(4)]
    b = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[1])], "item_id long, text string")
    d = spark.createDataFrame([(k, f"xx {t} yy") for k, t in enumerate(texts)], "doc_id long, text string")
    for block in (1, 2, 20):
        got = decontaminate.leaks(d, b, block=block).collect()
        assert sorted((r.doc_id, r.item_id or -1, r.first_word, r.edits) for r in got) == [(0, 1, 1, 0), (1, 1, 1, 0), (2, -1, 1, 0)]
        assert [r.doc_id for r in decontaminate.without_leaks(d, b, block=block).collect()] == [3]


def edited(r, item, edits):
    out = list(item)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.randrange(3)
        if kind == 0:
            out[at] = f"w{r.randrange(400)}"
        elif kind == 1:
            out.insert(at, f"w{r.randrange(400)}")
        else:
            del out[at]
    return out


def test_keys_find_near_windows_and_tell_far_ones_apart():
    r = random.Random(1)
    for size in (5, 10, 20, 40, 90):
        items = [[f"w{r.randrange(400)}" for _ in range(size)] for _ in range(60)]
        search = decontaminate.Search([(k, " ".join(t).encode()) for k, t in enumerate(items)])
        noise = lambda: [f"w{r.randrange(400)}" for _ in range(20)]  # noqa: B023,E731
        texts = [" ".join(noise() + edited(r, t, decontaminate.budget(size)) + noise()).encode() for t in items]
        found = {(k, i) for k, i, *_ in search.find_all(texts)}
        assert sum((k, k) in found for k in range(60)) >= 57
        # windows that have half their words in common with an item, in order, seldom meet it; others almost never
        group = search.groups[size]
        far = np.array([[w if i % 2 else 10_000 + i for i, w in enumerate(seq)] for _, seq in group.items])
        window, item = group.collide(search.walks, far)
        assert len(window) <= 0.05 * 60
        unlike = np.array([r.sample(seq, size) for _, seq in group.items for _ in range(5)])
        assert len(group.collide(search.walks, unlike)[0]) <= 0.1 * len(unlike) * (4 if size == 5 else 1)  # items of five words share pairs


def test_alignments_equal_brute_force():
    r = random.Random(2)
    for _ in range(150):
        item = [r.randrange(4) for _ in range(r.randint(1, 8))]
        text = [r.randrange(4) for _ in range(r.randint(0, 20))]
        most = r.randint(0, min(2, len(item) - 1))  # a budget is under the item's length
        got = decontaminate.alignments(item, text, most)
        want = [exact_distance(item, text[a:b]) for a in range(len(text)) for b in range(a + 1, len(text) + 1)]
        assert (min(want, default=99) <= most) == bool(got)
        assert all(exact_distance(item, text[a:b]) == e <= most for a, b, e in got)
        if got:
            assert min(e for *_, e in got) == min(want)
        spans = sorted((a, b) for a, b, _ in got)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_windows_pass_over_nothing_within_the_budget():
    r = random.Random(4)
    for _ in range(200):
        size = r.choice((1, 2, 4, 5, 9, 10, 14, 15, 25))
        item = [f"w{r.randrange(40)}" for _ in range(size)]
        search = decontaminate.Search([(0, " ".join(item).encode())])
        before = [f"x{k}" for k in range(r.randint(0, 9))]
        ids = search.read(" ".join(before + edited(r, item, r.randint(0, decontaminate.budget(size))) + ["y"] * r.randint(0, 5)).encode())
        assert len(before) in search.windows(ids)[size].tolist()


def test_every_place_of_a_long_text_is_found(spark):
    words = [f"w{k}" for k in range(12)]
    other = list(words)
    other[5] = "changed"
    text = " ".join(["x y z"] * 30_000 + words + ["q"] * 5 + other + ["x y z"] * 10 + words + words)
    rows = decontaminate.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert [(r.first_word - 90_000, r.n_words, r.edits) for r in rows] == [(0, 12, 0), (17, 12, 1), (59, 12, 0), (71, 12, 0)]
