import random
import zlib

import numpy as np
import regex

from vitalstream.llm import quality, queries


def fixture(n=500):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(r.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            kind = r.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [w + " |" for w in words]
        docs.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = fixture()
    d = spark.createDataFrame([*docs, (9000, None, None, None), (9001, "", "en", "s"), (3, docs[3][1], "en", "s")], "doc_id long, text string, feat_bar_share string, stat_words string")
    l = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")  # noqa: E741
    rows = quality.classify(d, l).collect()
    assert len(rows) == len(docs) + 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


def test_column_equals_rules(spark):
    docs, labels = fixture(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    model = quality.learn(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert 0 < len(model.weights) < 60
    pdf = quality.measured(d).toPandas()
    x = {k.removeprefix("feat_"): pdf[k].to_numpy() for k in pdf.columns if k != "doc_id"}
    z = model.bias + sum((w * r.holds(x) for r, w in model.weights), np.zeros(len(pdf)))
    got = dict(map(tuple, quality.score(d, model).collect()))
    assert np.allclose([got[i] for i in pdf.doc_id], 1 / (1 + np.exp(-z)))
    plan = quality.score(d, model)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_no_labels_one_kind_and_empty_table(spark):
    docs, labels = fixture(40)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(d, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i, *_ in labels], "doc_id long, quality int, toxic int")
    assert len({r.score for r in quality.classify(d, ones).collect()}) == 1
    assert quality.classify(d.limit(0), ones).count() == 0


def plain_counts(text):
    """The statistics of a text by Python's own means."""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    pieces = regex.split(r"[\x20\x09-\x0D]+", text)
    runs = [w for w in regex.split(r"\s+", text) if w]
    return {
        "chars": len(text), "words": len(words), "bars": text.count("|"), "symbols": len(regex.findall(r"[^\p{L}\p{N}\s.,;:'\"?()-]+", text)), "shouted": len(regex.findall(r"\p{Lu}{2,}", text)),
        "doubled": sum(a == b for a, b in zip(runs, runs[1:], strict=False)), "digits": sum(c in "0123456789" for c in text),
        "stops": sum(c in ".?!" and (i + 1 == len(text) or text[i + 1].isspace()) for i, c in enumerate(text)), "lines": text.count("\n"), "distinct": len(set(pieces)),
    }


def plain_features(text):
    c = plain_counts(text)
    per = max(c["words"], 1)
    return {
        "bar_share": c["bars"] / per, "symbol_share": c["symbols"] / per, "shout_share": c["shouted"] / per, "double_share": c["doubled"] / per, "digit_share": c["digits"] / max(c["chars"], 1), "stop_share": c["stops"] / per,
        "line_share": c["lines"] / per, "distinct_share": c["distinct"] / per, "word_length": c["chars"] / per, "log_words": np.log1p(c["words"]),
    }


def test_query_equals_a_plain_computation(spark, tmp_path):
    docs, labels = fixture(240)
    docs += [(900, "", "en", "s"), (901, None, "en", "s"), (902, "Mixed CASE text, 12 of 34!\nNext  line is is is here? Yes.\té", "en", "s"), (903, "a " * 60_000 + "END.", "en", "s")]
    spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = {d[0]: d[1] or "" for d in docs}
    measured = {i: plain_features(t) for i, t in text.items()}
    truth = {i: q for i, q, _ in labels}
    used = sorted(i for i in truth if zlib.crc32(str(i).encode()) % 5)
    # the fit sees rows in the order of their features
    rows = sorted(({"doc_id": i, "quality": truth[i], **{f"feat_{k}": v for k, v in measured[i].items()}} for i in used), key=lambda r: r["doc_id"])
    x = {k: np.array([measured[r["doc_id"]][k] for r in rows]) for k in measured[used[0]]}
    model = quality.fit_rules(x, np.array([r["quality"] for r in rows], float))
    got = {r.doc_id: r for r in queries.op10_quality(spark, str(tmp_path)).collect()}
    assert set(got) == set(text)
    for i in text:
        z = model.bias + sum(w * float(rule.holds({k: np.array([v]) for k, v in measured[i].items()})[0]) for rule, w in model.weights)
        p = 1 / (1 + np.exp(-z))
        assert abs(got[i].score - p) < 1e-6 and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
