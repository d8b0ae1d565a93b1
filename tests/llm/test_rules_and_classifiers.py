"""The rule ledger by brute force; classifiers by held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import cotraining, license_scan, quality_rules, toxicity
from tidefold.llm.linear import Sparse, fit, platt, sigmoid

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "nrst"]


def measured(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    repeated = {p + k for p, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_ledger_equals_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "x " * 500, "é ü\x0bz \x1c", "!!" * 9, "a|b\n\n a|b\na|b", "#" * 100]
    texts += [" ".join(rnd.choice(WORDS[: rnd.choice([3, 8, 200])]) + rnd.choice(["", "", "\n", "!!", "%%"]) for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(0, "again", 1), (None, "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int").repartition(3)
    got = quality_rules.ledger(docs)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.key, *(r[c] for c in columns)) for r in got.collect()), key=str) == sorted(((k, *measured(t)) for k, t, _ in rows), key=str)
    for r in got.collect():
        assert bool(r.failed & quality_rules.POLICIES["base"]) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality_rules.ledger(docs.limit(0)).collect() == []
    failed = [r.failed for r in got.collect()]
    for r in quality_rules.ablations(got).collect():
        mask, bit = quality_rules.POLICIES[r.policy], quality_rules.mask(r.rule)
        assert r.failing == sum(bool(f & bit) for f in failed) and r.failing_alone == sum(f & mask == bit for f in failed) and r.kept == sum(not f & mask for f in failed)
    assert quality_rules.ablations(got.limit(0)).collect() == []


def test_pairs_hold_scores_together():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.5).astype(float)
    feats = [np.array([0 if v else 1, *([2] if rng.random() < (0.9 if v else 0.1) else [])]) for v in y]
    pair = Sparse(np.array([2, 3]), np.array([0, 0]), np.array([1.0, -1.0]), 1)
    free, _ = fit(Sparse.of(feats), y, 4)
    held, _ = fit(Sparse.of(feats), y, 4, pairs=pair, pull=10.0)
    assert abs(held[2] - held[3]) < 0.1 * abs(free[2] - free[3])


def test_platt_calibrates():
    rng = np.random.default_rng(0)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < sigmoid(3 * s - 1)).astype(float)
    a, c = platt(s, y)
    assert abs(a - 3) < 0.4 and abs(c + 1) < 0.3
    assert platt(s, np.zeros(4000)) == (1.0, 0.0)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    bad = ["grolk", "snark", "vempt"]
    rows, labels = [], []
    for k in range(900):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(30, 120))]
        toxic, poor = int(rnd.random() < 0.3), int(rnd.random() < 0.3)
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        elif rnd.random() < 0.3:
            words.insert(0, rnd.choice(["women", "muslims", "gay", "immigrants"]))
        text = " ".join(w + "%%%" for w in words) if poor else " ".join(words)
        rows.append((k, text + ".", "spam" if poor and rnd.random() < 0.8 else "web", "en", len(text)))
        labels.append((k, 1 - poor, toxic))
    rows += [(900, None, None, None, None), (900, "", "web", "en", 0), (None, "women " * 20000, "web", "en", 1)]
    labels += [(901, 1, 1), (None, 1, 0), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"), z=2.5)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    held = scored.join(labels.withColumnRenamed("doc_id", "key"), "key").where("key % 5 = 0 AND toxic IS NOT NULL").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in held) >= 0.97 * len(held)
    again = {(r.key, r.score) for r in scored.where("key IS NOT NULL").collect()}
    assert {(r.key, r.score) for r in toxicity.score(docs.repartition(2), model).where("key IS NOT NULL").collect()} == again


def test_swaps_take_every_term_of_every_sentence():
    plain = "Nothing here. " * 9
    got = list(toxicity.swaps(plain + "The women met men. Old days."))
    assert ("The women met men.", "The girls met men.") in got and ("The women met men.", "The women met boys") in got and ("Old days.", "elderly days.") in got
    assert len(got) == 5 + 5 + 3
    assert len(list(toxicity.made_up(plain, 3, 4))) == 4 and len(list(toxicity.made_up("women. " * 9, 3, 4))) == 0
    for one, two in toxicity.made_up(plain, 3, 4):
        assert one != two and one.split()[1:] == two.split()[1:] and toxicity._GROUP[one.split()[0]] is toxicity._GROUP[two.split()[0]]


def biased(spark):
    """Toxic texts mostly speak of one group, clean ones of another, always after the fourth sentence; what makes them toxic is another word."""
    rnd = random.Random(12)
    rows, labels = [], []
    for k in range(1200):
        toxic = int(rnd.random() < 0.3)
        group = rnd.choice(["muslims", "muslims", "muslims", "christians"] if toxic else ["christians", "christians", "jews", "hindus"])
        words = [rnd.choice(WORDS) for _ in range(40)]
        if toxic and rnd.random() < 0.6:
            words.insert(3, rnd.choice(["grolk", "vempt"]))
        rows.append((k, "One. Two. Three. Four. Five. " + " ".join(words) + f" {group} {rnd.choice(WORDS)}."))
        labels.append((k, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_swapped_groups_keep_their_score(spark):
    docs, labels = biased(spark)
    neutral = spark.createDataFrame(list(enumerate(f"The {g} of banan and delor." for g in toxicity.IDENTITY[1])), "doc_id bigint, text string")
    gap, false, models = {}, {}, {}
    for pull in (0.0, 1.0, 10.0):
        models[pull] = toxicity.train(docs, labels, pull=pull)
        got = [r.score for r in toxicity.score(neutral, models[pull]).collect()]
        logits = np.log(np.array(got) / (1 - np.array(got)))
        gap[pull], false[pull] = logits.max() - logits.min(), sum(x >= 0.5 for x in got)
    assert not np.array_equal(models[0.0].weights, models[1.0].weights)
    assert gap[0.0] > 3 and gap[1.0] < 0.5 * gap[0.0] and gap[10.0] < 0.2 * gap[0.0]
    assert false[0.0] > 0 and false[10.0] == 0
    toxic = toxicity.score(spark.createDataFrame([(1, "The grolk of banan."), (2, "grolk vempt christians")], "doc_id bigint, text string"), models[10.0])
    assert all(r.score >= 0.5 for r in toxic.collect())


def test_toxicity_edge_cases(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs.limit(0), model).collect() == [] and toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []
    odd = spark.createDataFrame([(1, "grolk", "x", "y"), (1, "grolk", "x", "y"), (None, None, None, None)], "doc_id bigint, text string, score string, key string")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 3 and len({r.score for r in got if r.key == 1}) == 1


def test_toxicity_with_one_label(spark, corpus):
    docs, labels = corpus
    for few in (labels.where("toxic = 0"), labels.limit(0)):
        scores = {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, few)).collect()}
        assert len(scores) == 1 and scores.pop() < 0.01


def test_cotraining_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    model = cotraining.train(docs, labels.where("doc_id % 5 <> 0"))
    scored = cotraining.score(docs, model)
    assert scored.count() == docs.count()
    held = scored.join(labels.withColumnRenamed("doc_id", "key"), "key").where("key % 5 = 0 AND quality IS NOT NULL").collect()
    right = lambda column: sum((r[column] >= 0.5) == bool(r.quality) for r in held) / len(held)
    assert right("score") >= 0.97 and right("p_metadata") >= 0.8
    through = cotraining.scored(docs.withColumn("quality_score", F.lit("old")), model)
    assert through.columns == [*docs.columns, "quality_score"] and through.count() == docs.count()
    bare = docs.select("doc_id", "text")
    assert cotraining.score(bare, cotraining.train(bare, labels)).count() == docs.count()
    assert cotraining.score(docs.limit(0), model).collect() == []
    assert len({r.score for r in cotraining.score(docs, cotraining.train(docs, labels.limit(0))).collect()}) == 1


def two_views(spark, n=2500):
    """Sources tell good from bad at 0.95; so do words, but of 60 a class each text has only five, so few labels teach few words."""
    rnd = random.Random(7)
    letters = "bcdfghjklmnp"
    said = [[f"q{'ab'[c]}{a}{b}{d}" for a in letters for b in letters for d in "ae"][:60] for c in (0, 1)]
    rows, labels = [], []
    for k in range(n):
        good = int(rnd.random() < 0.6)
        words = [rnd.choice(WORDS) for _ in range(30)] + [rnd.choice(said[good if rnd.random() < 0.95 else 1 - good]) for _ in range(5)]
        rnd.shuffle(words)
        rows.append((k, " ".join(words), f"src{rnd.randrange(3) + 3 * (good if rnd.random() < 0.95 else 1 - good)}"))
        labels.append((k, good))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4), labels


def test_rounds_beat_plain_training_with_few_labels(spark):
    docs, labels = two_views(spark)
    known = cotraining.features(docs, ("source",))
    given = spark.createDataFrame([x for x in labels if x[0] < 200], "doc_id bigint, quality int")
    truth = dict(labels)
    right, models = {}, {}
    for rounds in (0, 1, 4):
        models[rounds] = cotraining.train(docs, given, metadata=("source",), rounds=rounds, sure=0.9, known=known)
        got = [r for r in cotraining.score(docs, models[rounds], known=known).collect() if r.key >= 200]
        right[rounds] = {c: sum((r[c] >= 0.5) == bool(truth[r.key]) for r in got) / len(got) for c in ("p_content", "p_metadata", "score")}
    flow = models[4].flow
    assert sum(f[2] > 0 and f[3] > 0 for f in flow) >= 2, flow  # metadata teaches content both classes in several rounds
    assert sum(f[0] + f[1] > 0 for f in flow) >= 2, flow  # and content, once taught, teaches metadata
    assert right[4]["p_content"] > right[0]["p_content"] + 0.2 and right[4]["p_content"] >= right[1]["p_content"], right
    assert right[4]["score"] >= right[0]["score"] and right[4]["p_metadata"] > 0.9, right


def test_surest_rows_of_each_view(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.randrange(400)], [rnd.randrange(400)]) for k in range(2000)] + [(7, [399], [399])] * 30
    free = spark.createDataFrame(rows, "key bigint, content array<int>, metadata array<int>").repartition(7)
    weights = np.zeros(1 << cotraining.BITS)
    weights[:400] = np.arange(400) // 4  # ties
    models = {"content": cotraining.View(weights, -40.0), "metadata": cotraining.View(-weights, 40.0)}
    jobs = [("content", "metadata", 1, 20.0, 9), ("content", "metadata", 0, -30.0, 5), ("metadata", "content", 1, None, 0), ("metadata", "content", 0, 0.0, 6)]
    found = cotraining._surest(free, models, jobs, {"3", "4"})
    for (view, _, good, bound, most), got in zip(jobs, found, strict=True):
        if bound is None:
            assert got == []
            continue
        sign, best = (1 if good else -1), {}
        for k, *lists in rows:
            own = sign * models[view](lists[view == "metadata"])
            if k not in (3, 4) and own >= sign * bound:
                best[k] = max(best.get(k, (own, *lists)), (own, *lists))
        have = [best[int(r["key"])] for r in got]
        assert [x[1:] for x in have] == [(r["content"], r["metadata"]) for r in got]
        assert len(have) >= most and [x[0] for x in have] == sorted((x[0] for x in best.values()), reverse=True)[: len(have)]


def test_cotraining_edge_cases(spark, corpus):
    docs, labels = corpus
    model = cotraining.train(docs, labels)
    odd = docs.select("*", F.lit(1).alias("_ct_text"), F.lit(2).alias("row"), F.lit(3).alias("key"), F.lit(4).alias("score"), F.lit(5).alias("text2"))
    out = cotraining.scored(odd, model)
    assert out.columns == [*odd.columns, "quality_score"] and out.count() == odd.count()
    assert cotraining.scored(odd.limit(0), model).collect() == []
    one = {r.doc_id: r.quality_score for r in out.where("doc_id < 900").collect()}
    two = {r.key: r.score for r in cotraining.score(docs, model).where("key < 900").collect()}
    assert one == two
    kept = cotraining.features(odd, model.columns, carry=True)
    through = cotraining.scored(odd, model, known=kept)
    assert through.columns == out.columns and through.exceptAll(out).count() == out.exceptAll(through).count() == 0
    twice = docs.where("doc_id < 300").unionAll(docs.where("doc_id < 300"))
    scores = {}
    for r in cotraining.score(twice, model).collect():
        scores.setdefault(r.key, set()).add(r.score)
    assert all(len(x) == 1 for x in scores.values())
    assert cotraining.train(docs.limit(0), labels).flow == []


def test_licences(spark):
    rnd = random.Random(2)
    noise = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for k, (family, templates) in enumerate((f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts):
        rows.append((k, f"{noise(20)}\n{templates} {noise(30)}\n{noise(9)}"))
        want[k] = [(1, family)]
    for k in range(100, 160):
        rows.append((k, "\n".join(noise(rnd.randint(3, 40)) for _ in range(5)) + " the license of this work and software is granted"))
        want[k] = []
    rows += [(200, None), (201, ""), (202, "\n \n"), (203, noise(20000))]
    want |= {k: [] for k in range(200, 204)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = license_scan.train(docs)
    got = {r.key: [(f.paragraph, f.family) for f in r.found] for r in license_scan.licences(docs, model).collect()}
    wrong = {k for k in want if got[k] != want[k]}
    assert not wrong & {*range(100, 204)} and len(wrong) <= 1, {k: (got[k], want[k]) for k in wrong}
    assert license_scan.licences(docs.limit(0), license_scan.train(docs.limit(0))).collect() == []


def test_licences_without_usual_words(spark):
    rnd = random.Random(4)
    noise = " ".join(rnd.choice(WORDS) for _ in range(60))
    texts = {
        "Available under CC BY-SA 4.0.": "CC-BY-SA",
        "Released under CC BY 4.0.": "CC-BY",
        "This article is available under CC BY-SA 4.0.": "CC-BY-SA",
        f"{noise} this library is licensed under the GNU Lesser General Public License, version 2.1, {noise}": "LGPL",
        f"{noise} under {noise} cc {noise} by": None,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.key: {f.family for f in r.found} for r in license_scan.licences(docs, license_scan.train(docs.limit(0))).collect()}
    assert got == {k: {f} - {None} for k, f in enumerate(texts.values())}


def test_prefilter_passes_what_can_be_confirmed():
    rnd = random.Random(5)
    seen = 0
    for _ in range(4000):
        words = license_scan.words_of(rnd.choice(rnd.choice([*license_scan.TEMPLATES.values()])))
        lost = {w for w in words if rnd.random() < 0.3}
        s = " ".join("x" if w in lost else w for w in words)
        grams = license_scan.ngrams(license_scan.words_of(s))
        if any(license_scan._similarity(grams, len(words), ts) >= license_scan.CONFIRM for ts in license_scan._TEMPLATE_GRAMS.values()):
            seen += 1
            assert license_scan._marked(s), s
    assert seen > 500


#: Wordings that are no templates, by family.
REWORDED = {
    "Apache": ["This project is licensed under the Apache License, Version 2.0.", "All code here is released under the Apache License, Version 2.0.", "Distributed under the Apache License, Version 2.0, see the file."],
    "MIT": ["This package is released under the MIT License.", "The code is licensed under the MIT License.", "Everything here is released under the MIT License terms."],
    "GPL": ["This program is licensed under the GNU General Public License, version 3.", "The work is licensed under the GNU General Public License version 3 only."],
    "LGPL": ["This module is licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL": ["This server is licensed under the GNU Affero General Public License, version 3."],
    "MPL": ["The files are licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY": ["This page is licensed under CC BY 4.0.", "under CC BY 4.0", "This text is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["under CC BY-SA 4.0.", "Content licensed under CC BY-SA 4.0.", "The article is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Images licensed under CC BY-NC 4.0."],
    "CC-BY-ND": ["Photos licensed under CC BY-ND 4.0."],
    "CC0": ["The data are released under CC0 1.0."],
    "Proprietary": ["Acme Inc. All rights reserved."],
}


def test_licences_recall_and_calibration_on_other_wordings(spark):
    rnd = random.Random(6)
    noise = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."
    wanted = [(f, w) for f, own in REWORDED.items() for w in own]
    clean = [f"{noise(4)} the terms of this work are licensed {noise(5)}" for _ in range(30)] + [noise(12) for _ in range(30)]
    docs = spark.createDataFrame([(k, f"{noise(9)}\n{w}") for k, (_, w) in enumerate(wanted)] + [(100 + k, t) for k, t in enumerate(clean)], "doc_id bigint, text string")
    model = license_scan.train(docs)
    got = {r.key: r.found for r in license_scan.licences(docs, model).collect()}
    right = [bool(got[k]) and got[k][0].family == f for k, (f, _) in enumerate(wanted)]
    assert sum(right) >= 0.9 * len(right), [w for w, ok in zip(wanted, right, strict=True) if not ok]
    assert not any(got[100 + k] for k in range(len(clean)))
    p = [license_scan.classify(w, model)[1] for _, w in wanted]
    q = [license_scan.classify(t, model)[1] for t in clean]
    assert np.mean(p) > 0.9 and np.mean(q) < 0.1  # calibrated: about as sure as it is right


def test_licences_edge_cases(spark):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, line, "a", 1), (1, line, "b", 2), (None, line, "c", 3), (2, "...\n---\n" + line, "d", 4)], "doc_id bigint, text string, key string, found int")
    got = license_scan.licences(docs, license_scan.train(docs)).collect()
    assert sorted(((r.key, r.paragraphs, [f.family for f in r.found]) for r in got), key=str) == [(1, 1, ["MIT"]), (1, 1, ["MIT"]), (2, 1, ["MIT"]), (None, 1, ["MIT"])]
