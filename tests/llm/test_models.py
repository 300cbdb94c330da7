import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.llm import language_model, license_scan, queries, toxicity
from helixframe.llm.common import fold

from .common import edge_documents, empty_documents


def test_grammar_scores_clauses():
    g = toxicity.Grammar(toxicity.seed_lexicon())
    plain, said = g.score("you are an idiot.")[0], g.score("he said you are an idiot.")[0]
    assert g.score("a fine day.")[0] < said < plain and g.score("you are not an idiot.")[0] < plain
    assert g.score("")[0] == g.score("a fine day.")[0] and g.score("idiotic")[1] == 0
    assert g.score("word " * 50_000 + "you moron!")[1] == 1


def test_transducers_compose_to_the_chain():
    """The composed transducer does what the five do one after another, for every string of up to four symbols."""
    for n in range(5):
        for string in itertools.product(toxicity.SYMBOLS, repeat=n):
            tape, weights, ends = list(string), [1.0] * n, []
            for t in toxicity.TRANSDUCERS:
                state, out = t.start, []
                for k, x in enumerate(tape):
                    state, y, w = t.step(state, x)
                    out.append(y)
                    weights[k] *= w
                tape = out
                ends.append(t.final.get(state, (1.0, 1.0)))
            hits = [(k, x) for k, x in enumerate(tape) if "insult" in x or "threat" in x]
            want = [sum(weights[k] * math.prod(e[j] for e in ends) for k, x in hits if kind in x) for j, kind in enumerate(("insult", "threat"))]
            insults, threats, _, _ = toxicity.clause_weights([(x, 1.0) for x in string])
            assert [sum(insults), sum(threats)] == pytest.approx(want), string


def test_grammar_paths():
    g = toxicity.Grammar(toxicity.seed_lexicon())
    score = lambda t: g.score(t)[0]
    nothing = score("a fine day")
    assert score("idiot you") == score("idiot you.") == score("Idiot, you!") > 0.5  # the text's end is a clause's end
    assert score("kill the process") == score("burn, kill and destroy") == nothing  # a threat needs a target
    assert score("i will kill you") > 0.5 > score("i will not kill you") > nothing
    assert score("you are stupid. never mind") == score("you are stupid") == score("you stupid one, not me")  # after the insult
    assert score("you are not at all stupid") < score("you are stupid")
    assert score("'you idiot', she said") == pytest.approx(score("she said 'you idiot'")) and score("she said 'you idiot'") < score("you idiot")
    assert score("she said no. you idiot") == score("you idiot")  # another clause
    assert score("what an idiot") < score("you idiot")
    far = "you " + "word " * 20_000 + "idiot"
    assert score(far) == score("you idiot") and score("x " * 50_000 + "stupid idiot" + " x" * 50_000 + " you") == score("stupid idiot you")


def corpus(n=600, seed=1):
    r = random.Random(seed)
    words = [f"wort{k}" for k in range(200)]
    rows = []
    for k in range(n):
        t = [r.choice(words) for _ in range(40)]
        y = int(r.random() < 0.2)
        if y:
            for _ in range(3):
                t[r.randrange(40)] = r.choice(["moron", "blarg" + r.choice("abcdefgh") * 2, "idiot"])
        rows.append((k, " ".join(t), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (10_000, 0), (5, None)], "doc_id long, toxic int")
    g = toxicity.train(docs, labels, usable=~fold(F.col("doc_id"), 5, 0))
    assert any(k.startswith("blar") for k in g.lexicon)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs.where(fold(F.col("doc_id"), 5, 0)), g).collect()}
    assert sum(got[k] == y for k, _, y in rows if k in got) >= 0.97 * len(got)


def test_toxicity_edges(spark):
    docs = edge_documents(spark)
    g = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score_documents(docs, g, prefix="_t_")
    assert out.count() == docs.count() and out.where("_t_score is null or _t_score < 0 or _t_score > 1").count() == 0
    assert toxicity.score_documents(empty_documents(spark), g).count() == 0


def test_op1_on_labels(spark, sf):
    got = queries.op1_toxicity(spark, sf).toPandas()
    assert sorted(got.columns) == ["doc_id", "held_out", "n_clauses", "predicted", "score"] and got.score.between(0, 1).all()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_op1_held_out_precision_and_recall(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null"), "doc_id")
    hits, said, there = got.agg(F.sum((F.col("predicted") == 1).cast("int") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert there > 50 and hits >= 0.95 * said and hits >= 0.9 * there


def test_language_model(spark):
    r = random.Random(2)
    a, b = [f"{k}xa" for k in range(60)], [f"{k}yb" for k in range(60)]
    rows = [(k, " ".join(r.choice(a if k % 2 else b) for _ in range(50))) for k in range(300)] + [(900, None), (901, ""), (902, "1XA unseen\t2yb"), (None, "1xa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = ~fold(F.col("doc_id"), 7, 2)
    out = language_model.score(docs, learn, hot=50, top=20, buckets=8, sample_docs=200).collect()
    import zlib

    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter()
    for t in train:
        c.update([*language_model.tokens_of(t or ""), b""])
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    for x in out:
        words = [*language_model.tokens_of(text[x["doc_id"]] or ""), b""]
        assert x["n_tokens"] == len(words) and x["n_known"] == sum(c[w] > 0 for w in words) and x["train_tokens"] == n
        assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
    held = [x for x in out if not x["learned"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) + 0.1 * sum(x["n_tokens"] for x in held)


def test_language_model_learns_from_all_texts(spark):
    import numpy as np

    r = random.Random(3)
    # In 300 of 2600 texts only, "left" comes before "right"; elsewhere it never does.
    plain = lambda: " ".join(r.choice(["left a b", "b a right", "a c b"]) for _ in range(8))
    ids = [x["id"] for x in spark.range(2600).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {d: plain() if k < 2300 else "left right " * 40 for k, d in enumerate(ids)}
    src = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    counts = language_model.count_tokens(src.select("text")).localCheckpoint()
    model = language_model.fit(src, counts, top=20, buckets=4)
    size = len(model.bias)
    classes = {d: [model.class_of(w) for w in [*language_model.tokens_of(t), b""]] for d, t in texts.items()}
    want = Counter()
    for w in classes.values():
        w = [model.class_of(b"")] * 2 + w
        want.update(zip(w[1:-1], w[:-2], w[2:], strict=True))
    got = language_model.class_trigrams(src, model, size)
    assert {tuple(map(int, x)): int(got[tuple(x)]) for x in np.argwhere(got)} == want
    log_p = lambda w, one, two: model.first[w, one] + model.second[w, two] + model.bias[w] - model.log_z[one, two]
    left, right = model.class_of(b"left"), model.class_of(b"right")
    # After "right left" comes "right" in 87 % of all cases; the first 1500 texts by hash have no such case.
    assert np.exp(log_p(right, left, right)) > 0.5


def test_language_model_is_normalised():
    import numpy as np

    params = language_model.train_nce([np.array([0, 1, 2, 1, 0] * 40)], 4, np.array([80.0, 80, 40, 0]), 3, epochs=2, batch=64)
    first, second, log_z = language_model.normalised(*params)
    p = np.exp(first[:, 1] + second[:, 0] + params[4] - log_z[1, 0])
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_language_model_edges(spark):
    out = language_model.score(edge_documents(spark), F.lit(False)).collect()
    assert len(out) == 12 and all(x["score"] == 0 and x["train_tokens"] == 0 for x in out)
    assert language_model.score(empty_documents(spark), F.lit(True)).count() == 0


def test_license_scan(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache", "  released under the MIT license": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary", "The license plate was unusual": None, "a reserved person has all rights": None, "": None, "Apache helicopters": None,
    }
    model = license_scan.fit([f"plain words number {k} of an ordinary line" for k in range(200)])
    docs = spark.createDataFrame([(k, f"some text\n{line}\nmore") for k, line in enumerate(lines)] + [(99, None), (100, "x " * 40_000 + "\nReleased under the MIT License.")], "doc_id long, text string")
    got = {r["doc_id"]: [f["family"] for f in r["findings"]] for r in license_scan.scan(docs, model).collect()}
    assert got == {**{k: [f] if f else [] for k, f in enumerate(lines.values())}, 99: [], 100: ["mit"]}
    p = {r["doc_id"]: [f["probability"] for f in r["findings"]] for r in license_scan.scan(docs, model).collect()}
    assert p[0][0] == pytest.approx(model.probabilities(next(iter(lines)))["apache"], abs=1e-3)
    assert license_scan.scan(empty_documents(spark), license_scan.train(empty_documents(spark))).count() == 0


def wrapped(text, width, prefix=""):
    import textwrap

    return "\n".join(prefix + x for x in textwrap.wrap(text, width))


def test_wrapped_notices(spark):
    """Notices over several lines, as headers have them, with comment signs, between prose and blank lines."""
    model = license_scan.fit([f"plain words number {k} of an ordinary line" for k in range(200)])
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    cut = gpl.split(" it under")
    texts = [
        (["gpl"], wrapped(gpl, 70)), (["mit"], "some prose\n" + wrapped(mit, 72, "// ") + "\nmore prose"), (["bsd"], "a line\n\n" + wrapped(bsd, 60, " * ") + "\n *\n * other text"),
        (["apache", "gpl"], "Licensed under the Apache License, Version 2.0\n\n\n" + wrapped(gpl, 60, "# ")), (["mit"], "Released under the MIT License\nplain words of an ordinary line\nand a reserved seat"),
        ([], "license\nplate\nunder a\nversion"), ([], cut[0] + "\n\nplain words\n\n" + "it under"), (["gpl"], "x\n" * 20_000 + wrapped(gpl, 65) + "\ny" * 20_000),
    ]
    docs = spark.createDataFrame([(k, t, "clash") for k, (_, t) in enumerate(texts)] + [(0, texts[0][1], "clash")], "doc_id long, text string, findings string")
    got = sorted((r["doc_id"], sorted(f["family"] for f in r["findings"])) for r in license_scan.scan(docs, model).collect())
    assert got == sorted([*((k, f) for k, (f, _) in enumerate(texts)), (0, texts[0][0])])


def test_license_precision_and_recall(spark, sf):
    """Held-out documents of the corpus with notices planted in changed words and wraps; others hold none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = license_scan.train(docs)
    r = random.Random(4)
    known = [w for x in license_scan.NOTICES.values() for n in x for w in license_scan.words_of(n)]
    rows, want = [], {}
    texts = [x["text"] for x in docs.orderBy("doc_id").limit(300).collect() if x["text"]]
    clean = [t for t in texts if not any(license_scan._share(license_scan._pairs(license_scan.words_of(n)), t) > 0.3 for x in license_scan.NOTICES.values() for n in x)]
    for k in range(600):
        lines = r.choice(clean).split("\n")[:12]
        if k % 2:
            family = r.choice(license_scan.FAMILIES)
            notice = r.choice(license_scan.NOTICES[family])
            words = [w for w in notice.split() if len(notice.split()) < 8 or r.random() > 0.04]
            lines.insert(r.randrange(len(lines) + 1), "\n" + wrapped(" ".join(words), r.choice([50, 64, 80, 200]), r.choice(["", "# ", " * ", "// "])) + "\n")
            want[k] = family
        else:  # words of notices in no order
            lines.insert(r.randrange(len(lines) + 1), " ".join(r.choice(known) for _ in range(6)))
        rows.append((k, "\n".join(lines)))
    found = {x["doc_id"]: {f["family"] for f in x["findings"]} for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    right = sum(want.get(k) in f for k, f in found.items() if f)
    said = sum(1 for f in found.values() if f)
    assert right >= 0.97 * said and right >= 0.95 * len(want), (right, said, len(want))
