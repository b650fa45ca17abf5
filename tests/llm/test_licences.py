import random
import re

from vitalstream.llm import licences


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    r = random.Random(8)
    pieces = "under the mit license | Under The MIT-License. | apache license, version 2 | apache license version 3 | CC BY NC | cc-by-nc-nd | the license | version 2 | été | under the | cc by | mit license under the mit license".split("|")
    return [" ".join(r.choice(pieces) if r.random() < 0.6 else "word" for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", "cc by cc by nc nc", "under the under the mit license"]


def test_base_places_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (not r.base_labels or r.score == 1)


def test_templates_are_found_whole_and_broken():
    scanner = licences.Scanner()
    for label, text in licences.TEMPLATES:
        _, _, covers, spans = scanner.scan(b"zzz yyy " + text.encode() + b" xxx")
        assert covers[label] == 1.0 and (label, 2, 1 + len(text.split()), 1.0) in spans
    words = licences.TEMPLATES[0][1].split()
    words[20:20] = ["inserted"]
    words[33] = "changed"
    assert "mit" in {s[0] for s in scanner.scan(" ".join(words).encode())[3]}
    assert not scanner.scan(b"the use of this software in any other form is subject to changes of the files")[3]


def test_matching_statistics_equal_brute_force():
    r = random.Random(2)
    for _ in range(40):
        seqs = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(3)]
        a = licences.SuffixAutomaton(seqs)
        text = [r.randint(1, 4) for _ in range(40)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for i, s, n in a.matches(text):
            assert n == max((k for k in range(1, i + 2) if tuple(text[i - k + 1 : i + 1]) in subs), default=0)
            for t, seq in enumerate(seqs):
                want = [e for e in range(n - 1, len(seq)) if n and seq[e - n + 1 : e + 1] == text[i - n + 1 : i + 1]]
                assert n == 0 or sorted(a.ends[s].get(t, ())) == want


def brute_cover(template, words, gap, least):
    """Most words of a template that any chain of common stretches covers, over all stretches of ``least`` words or more."""
    stretches = [
        (x, y, n) for x in range(len(words)) for y in range(len(template))
        for n in range(least, min(len(words) - x, len(template) - y) + 1) if words[x : x + n] == template[y : y + n]
    ]
    stretches.sort()
    best = []
    for x, y, n in stretches:
        best.append(n + max((b for b, (p, q, m) in zip(best, stretches, strict=False) if 0 <= x - p - m <= gap and 0 <= y - q - m <= gap), default=0))
    return max(best, default=0)


def test_chains_cover_what_brute_force_covers():
    r = random.Random(6)
    worse = 0
    for _ in range(120):
        template = [r.choice("abcdef") for _ in range(r.randint(6, 14))]
        scanner = licences.Scanner([("t", " ".join(template))], {"zz zz zz zz": "z"})
        words = [r.choice("abcdefx") for _ in range(5)] + template[: r.randint(3, len(template))] + ["x"] * r.randint(0, 2) + template[r.randint(0, 4) :] + ["x"]
        cover = scanner.scan(" ".join(words).encode())[2].get("t", 0.0)
        low, high = (brute_cover(template, words, licences.MAX_GAP, k) / len(template) for k in (licences.MIN_MATCH, 1))
        assert cover <= high + 1e-9  # what overlaps is cut, so that parts of any length count
        worse += cover < low - 1e-9  # a chain of maximal matches can miss a cut within one
    assert worse <= 12


def test_stray_matches_do_not_break_a_chain():
    text = licences.TEMPLATES[0][1].split()
    words = text[:20] + text[3:7] + text[20:]
    spans = licences.Scanner().scan(" ".join(words).encode())[3]
    assert ("mit", 0, len(words) - 1, 1.0) in spans
    assert [s[:3] for s in licences.Scanner().scan(" ".join([*text, *["w"] * 3, *text]).encode())[3] if s[3] == 1.0 and s[2] - s[1] > 30] == [("mit", 0, len(text) - 1), ("mit", len(text) + 3, 2 * len(text) + 2)]


def test_repeated_rows_and_long_texts(spark):
    text = "Licensed under the MIT license. " + "the software without restriction " * 20_000
    rows = [(1, text), (1, text), (None, "under the mit license"), (2, "x")]
    got = sorted((r.doc_id or 0, r.n_base, r.score, r.n_words) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, 1.0, 4), (1, 1, 1.0, 80_005), (1, 1, 1.0, 80_005), (2, 0, 0.0, 1)]


def test_empty_table(spark):
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
