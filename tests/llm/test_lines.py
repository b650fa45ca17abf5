import random

from vitalstream.llm import lines


def norm(line):
    return [w for w in line.lower().replace("\t", " ").split(" ") if w]


def near(a, b):
    """Word edit distance of exactly one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    """Kept text of (doc_id, text) rows with distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for k, (_, text) in enumerate(order):
        for i, line in enumerate((text or "").split("\n")):
            w = tuple(norm(line))
            if len(w) >= lines.MIN_WORDS:
                first.setdefault(w, (k, i))
    gone_first = {w for w in first if len(w) >= lines.NEAR_WORDS and any(len(v) >= lines.NEAR_WORDS and first[v] < first[w] and near(w, v) for v in first)}
    out = {}
    for k, (doc_id, text) in enumerate(order):
        kept = []
        for i, line in enumerate((text or "").split("\n")):
            w = tuple(norm(line))
            if len(w) < lines.MIN_WORDS or (first[w] == (k, i) and w not in gone_first):
                kept.append(line)
        out[doc_id] = "\n".join(kept) if text is not None else None
    return out


def corpus():
    r = random.Random(3)
    word = lambda: r.choice(["an", "be", "co", "Dé", "en", "is", "lo", "mi"]) + r.choice("abcdefgh") + r.choice("xyz")
    pool = [[word() for _ in range(r.choice((1, 3, 4, 7, 8, 9, 12, 13, 25)))] for _ in range(60)]
    rows = []
    for i in range(80):
        made = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(pool))
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                k = r.randrange(len(w))
                kind = r.choice("rid")
                w[k : k + (kind != "i")] = [] if kind == "d" and len(w) > 1 else [word()]
            line = " ".join(w)
            made.append(line.upper() if r.random() < 0.1 else line)
        rows.append((i, "\n".join(made)))
    return [*rows, (200, None), (201, ""), (202, "\n\n"), (203, rows[0][1]), (None, rows[1][1]), (205, "w " * 3000 + "x"), (206, "w " * 3000 + "y")]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, k1 int, lines string")
    got = lines.deduplicate_lines(docs, ("k1",)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    assert sum(r.n_near for r in got) > 20 and sum(r.n_exact for r in got) > 20
    assert all(r.k1 == 1 for r in got)
    assert all(r.text is None or r.n_lines - r.n_exact - r.n_near == len(r.text.split("\n")) or r.text == "" for r in got)


def test_short_lines_repeat_and_lie_near(spark):
    rows = [
        (1, "Ietzte.\n\nIetzte.\n \t\nietzte.\nStteen Erachtz.\nthree words here"),
        (2, "stteen  erachtz.\n\nthree words there\n这一行没有空格\n这一行没有空格\n \t"),
        (3, "five words stand just here\nseven words are to be found here"),
        (4, "five words stand just there\nseven words are found here\nseven words are to found here\nfour words are here"),
        (5, "four words are there"),
    ]
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: ("Ietzte.\n\n \t\nStteen Erachtz.\nthree words here", 2, 0),
        2: ("\nthree words there\n这一行没有空格\n \t", 2, 0),
        3: (rows[2][1], 0, 0),
        4: ("seven words are found here\nfour words are here", 0, 2),
        5: ("four words are there", 0, 0),
    }


def test_repeated_rows_and_empty_table(spark):
    line = "one two three four five six seven eight nine"
    got = lines.deduplicate_lines(spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, line), (1, line), (2, "")]
    assert lines.deduplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_on_the_path(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string").cache()
    docs.count()
    plan = lines.deduplicate_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
