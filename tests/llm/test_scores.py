"""Toxicity, quality, fingerprints and license scans."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cinelake.llm import imatch, labelled, licenses, quality, toxicity

from .conftest import make

WORDS = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]


def labelled_docs(spark, n=600):
    rnd = random.Random(0)
    docs, marks = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(12, 80))]
        bad, junk = i % 5 == 0, i % 7 == 0
        if bad:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vilezz", "awfulqq"]) + rnd.choice(["", "!", "er"]))
        docs.append((i, (" | " if junk else " ").join(words)))
        marks.append((i, int(not junk), int(bad)))
    marks += [(None, 1, 1), (3, None, None), (99999, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark, docs):
    table, labels = labelled_docs(spark)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(table, labels).collect()}
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [i for i, r in rows.items() if r.held_out]
    assert held and np.mean([rows[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    odd = toxicity.score_toxicity(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.reject_toxic(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_training_texts_are_whole(spark):
    pad = " ".join(["plain"] * 5000)
    table = spark.createDataFrame([(i, f"{pad} {'vilezz' if i % 2 else 'kindly'}") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    texts, y = labelled.training_rows(table, labels, "toxic")
    assert all(t.startswith(pad) and t.endswith("vilezz" if v else "kindly") for t, v in zip(texts, y.tolist(), strict=True))
    assert [len(c) for c in labelled.batches_of(["ab", "c", "", "defgh", "i"], 3, 4)] == [3, 1, 1]
    rows = toxicity.score_toxicity(table, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.score_toxicity(empty, none).count() == 0
    assert all(r.base_failed or r.kept for r in quality.quality_rules(docs, none).collect())


@pytest.mark.parametrize("n", range(1, 11))
def test_few_labels(spark, docs, n):
    """One to ten labelled rows, of one label or of both, and labels that are neither 0 nor 1."""
    texts = [(i, "vilezz awful words here" if i % 2 else "kind and plain words there") for i in range(40)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    both = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(n)] + [(30, 7, -1), (31, 2, 9)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(table, both).collect()
    assert len(rows) == 40 and all(0 <= r.score <= 1 for r in rows)
    used = {i % 2 for i in range(n) if not labelled.held_out([i])[0]}
    if len(used) < 2:
        assert len({r.score for r in rows}) == 1
    assert toxicity.reject_toxic(docs, both).columns == docs.columns
    assert quality.quality_rules(table, both).count() == 40


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    z = rng.normal(size=300)
    knots, levels = toxicity.isotonic(z, (rng.random(300) < 1 / (1 + np.exp(-3 * z))).astype(int))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    model = toxicity.boost(x, y, trees=40)
    assert ((model.raw(x) > 0) == y).mean() > 0.95


def brute_base(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_base_counts(spark, docs):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab  \n#|é") for _ in range(rnd.randint(0, 80))) for _ in range(200)] + [" ".join(rnd.choice("abc") for _ in range(60)) for _ in range(20)]
    got = quality.base_counts(pa.array(texts, pa.string()))
    assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [brute_base(t) for t in texts]
    table, labels = labelled_docs(spark)
    rows = quality.quality_rules(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_accuracy(spark):
    table, labels = labelled_docs(spark)
    rows = quality.quality_rules(table, labels).collect()
    held = [r for r in rows if labelled.held_out([r.doc_id])[0]]
    assert np.mean([r.kept == (r.doc_id % 7 != 0) for r in held]) > 0.95


def test_gram_families_stay_within_texts():
    whole = quality.gram_families(pa.array(["ab cd ef", "", "x", "gh ij"], pa.string()))
    parts = [quality.gram_families(pa.array([t], pa.string())) for t in ["ab cd ef", "", "x", "gh ij"]]
    for f in range(3):
        assert whole[f][0].tolist() == [g for p in parts for g in p[f][0].tolist()]
        assert whole[f][1].tolist() == [n for p in parts for n in p[f][1].tolist()]


def test_fingerprints_of_edits(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") for _ in range(120)) for _ in range(80)]
    texts += [texts[0], "", "", None, "lone"]
    rows = {r.doc_id: r for r in imatch.fingerprint_pairs(make(spark, texts)).collect()}
    import hashlib

    n = len(texts)
    for i in range(n):
        own, after = texts[i] or "", texts[(i - 1) % n] or ""
        cut = len(own) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest()
        assert rows[i].n_chars == len(own) and 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[0].fingerprint == rows[80].fingerprint
    assert rows[81].fingerprint == rows[82].fingerprint == rows[83].fingerprint and rows[82].near_next == 1.0
    assert np.mean([rows[i].near_edited for i in range(1, 80)]) > 0.1 + np.mean([rows[i].near_next for i in range(1, 80)])


def brute_fingerprint(text, band):
    import xxhash

    def h64(raw, seed=42):
        return xxhash.xxh64_intdigest(raw, seed)

    groups = {}
    for t in sorted((h64(w.encode()) for w in set(text.lower().split()) & band), key=lambda t: t - (t >> 63 << 64)):
        seed = h64(groups[t >> 55].to_bytes(8, "little")) if t >> 55 in groups else 42
        groups[t >> 55] = h64(t.to_bytes(8, "little"), seed)
    return {f"{k + 512:03X}{h & 0xFFFFFFFF:08X}" for k, h in groups.items()}


def test_fingerprints_hold_every_lexicon_term(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(WORDS) + rnd.choice(["", "", "a", "bc"]) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    texts += [" lead and trail\n", texts[3], "only " + texts[4], None, ""]
    df = Counter(w for t in texts for w in set((t or "").lower().split()))
    band = {w for w, n in df.items() if 2 <= n <= max(4.0, 0.05 * len(texts))}
    assert len(band) > 300 and min(df.values()) == 1 and max(df.values()) > max(4.0, 0.05 * len(texts))
    rows = {r.doc_id: r for r in imatch.fingerprint_pairs(make(spark, texts)).collect()}
    full = 0
    for i, t in enumerate(texts):
        own, after = t or "", texts[(i - 1) % len(texts)] or ""
        cut = len(own) // 3
        edit = own[: len(own) - cut] + after[:cut]
        for got, text in ((rows[i].fingerprint, own), (rows[i].edited_fingerprint, edit)):
            want = brute_fingerprint(text, band)
            full += bool(want)
            assert set(got.split(":")) == want if want else got.startswith("400")
        a, b = brute_fingerprint(own, band), brute_fingerprint(edit, band)
        if a and b:
            assert rows[i].near_edited == pytest.approx(len(a & b) / len({x[:3] for x in a | b}))
    assert full > 250


def test_fingerprint_edge_cases(docs, empty):
    assert imatch.fingerprint_pairs(docs).count() == docs.count()
    assert imatch.fingerprint_pairs(empty).count() == 0


def test_native_plans_run_no_python(docs):
    for made in (licenses.scan(docs), imatch.fingerprint_pairs(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_licenses(spark, docs, empty):
    texts = {
        "Released under the MIT License.": ("mit", "mit", 1, 1.0),
        "Licensed under the Apache License, Version 2.0.\nmit license": ("apache,mit", "apache,mit", 2, 1.0),
        "Licensed under CC BY-NC 4.0.": ("", "cc-by-nc", 0, 1.0),
        "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl", 1, 1.0),
        "an apache licensed thing": ("", "", 0, 0.0),
        "mit\n\nLICENSE": ("mit", "mit", 1, 0.5),
        "permission is hereby granted free of charge to any person obtaining a copy of software and associated documentation": ("", "mit", 0, 16 / 19),
    }
    rows = {r.doc_id: r for r in licenses.scan(make(spark, list(texts))).collect()}
    for i, (base, labels, n, score) in enumerate(texts.values()):
        assert (rows[i].base_labels, rows[i].n_base) == (base, n)
        assert rows[i].labels == labels
        assert rows[i].score >= score - 1e-9 if labels != base or n else True
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(empty).count() == 0


def brute_matches(words, templates, threshold):
    """Labels and best share over all windows of all sizes, without filters."""
    found, best = set(), 0.0
    for stride in {licenses.stride_of(t[1]) for t in templates}:
        blocks = []
        for at in range(0, max(1, len(words) - stride), stride):  # the last window holds the last word
            block = set(words[at : at + 2 * stride])
            own = [(k, t[0], set(t[1].split()), set(licenses.names_of(t))) for k, t in enumerate(templates) if licenses.stride_of(t[1]) == stride]
            blocks.append([(whole & block, len(whole & block) / len(whole), -k, label) for k, label, whole, names in own if len(whole & block) / len(whole) >= threshold - 1e-9 and names <= block])
        for i, hits in enumerate(blocks):
            around = [x for near in blocks[max(0, i - 1) : i + 2] for x in near]
            for c, share, k, label in hits:
                if not any(c <= c2 and (len(c2) > len(c) or (share2, k2) > (share, k)) for c2, share2, k2, _ in around):
                    found.add(label)
                    best = max(best, share)
    return found, best


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_license_filters_lose_no_match(spark, threshold):
    rnd = random.Random(5)
    tokens = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    templates = [(f"t{k}", " ".join(rnd.sample(tokens, rnd.randint(3, 9)))) for k in range(8)]
    templates = [t if k % 2 else (*t, " ".join(rnd.sample(t[1].split(), 2))) for k, t in enumerate(templates)]
    fill = [*tokens, *(f"filler{i}" for i in range(14))]
    texts = ["\n".join(" ".join(rnd.choice(fill) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    rows = {r.doc_id: r for r in licenses.scan(make(spark, texts), templates, threshold).collect()}
    many = 0
    for i, t in enumerate(texts):
        want, best = brute_matches(t.split(), templates, threshold)
        many += len(want) > 1
        assert {x for x in rows[i].labels.split(",") if x} == want
        assert rows[i].score == pytest.approx(best)
    assert many or threshold == 1.0


def test_licenses_over_lines_and_side_by_side(spark):
    two = "licensed under the gnu lesser general public license version 2 1 and released under the bsd 3 clause license"
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and\nassociated documentation files (the Software)"
    third = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    many = " ".join(f"w{i}" for i in range(500))
    # the affero template has nine of its ten tokens in the first, but not its name
    texts = {two: "bsd,gpl,lgpl", wrapped: "mit", third: "bsd", f"{many}\n{wrapped}\n{many} {third}": "bsd,mit", "Licensed under CC BY-NC 4.0. ok": "cc-by-nc", "released under the BSD 3-clause license, licensed under CC BY 4.0": "bsd,cc-by"}
    rows = {r.doc_id: r.labels for r in licenses.scan(make(spark, list(texts))).collect()}
    assert rows == dict(enumerate(texts.values()))
    # rows of one id with other texts, repeated rows and null ids keep their own labels
    odd = spark.createDataFrame([(1, wrapped), (1, third), (1, "x"), (None, third), (None, "x"), (1, wrapped)], "doc_id long, text string")
    assert Counter((r.doc_id, r.labels) for r in licenses.scan(odd).collect()) == Counter([(1, "mit"), (1, "bsd"), (1, ""), (None, "bsd"), (None, ""), (1, "mit")])


def test_sentences_without_a_license_stay_unlabelled(spark):
    texts = {
        "released under the BSD license": "bsd",
        "released under the Apache license": "apache",
        "licensed under the Eclipse license version 2.0": "",
        "The album was released under the public license of the label": "",
        "The band released the song under the Sub Pop license": "",
        "licensed under the Foo license version 2.0": "",
        "the file is licensed under the terms of a general license, version 3": "",
        "permission is given free of any charge to a person with the software and associated documentation files": "",
        "this program is free software, and you can modify it under the terms of the public": "",
    }
    rows = {r.doc_id: r for r in licenses.scan(make(spark, list(texts))).collect()}
    assert {i: r.labels for i, r in rows.items()} == dict(enumerate(texts.values()))
    assert [r.score for _, r in sorted(rows.items())] == [1.0, 0.5, *[0.0] * 7]


def test_whole_license_blocks(spark):
    """Every template is found in itself, between other words, in capitals and over lines, and names only its own family."""
    around = " ".join(f"w{i}" for i in range(300))
    texts = [f"{around} " + "\n".join(t[1].upper().split()) + f" {around}" for t in licenses.TEMPLATES]
    rows = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(make(spark, texts)).collect()}
    near = {"lgpl": {"gpl"}, "agpl": {"gpl"}, "cc-by-sa": {"cc-by"}, "cc-by-nc": {"cc-by"}, "cc-by-nd": {"cc-by"}}
    for k, t in enumerate(licenses.TEMPLATES):
        assert t[0] in rows[k] and rows[k] - {t[0]} <= near.get(t[0], set()), t
        assert set(t[2].split()) <= set(t[1].split())
