import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docaudit.llm import quality, toxicity


def columns(texts):
    return pa.array([sorted(toxicity.features(t)) for t in texts], pa.list_(pa.string()))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# --- toxicity


def test_group_names_weigh_nothing_of_their_own():
    texts, labels = [], []
    for n in range(400):
        toxic = n % 4 == 0
        # groups are mentioned far more often in toxic texts
        group = "muslim people " if toxic and n % 8 == 0 or n % 50 == 1 else ""
        texts.append(f"{group}some filler word{n} about plain{n % 13} things " + ("idiot " if toxic and n % 3 else "moron " if toxic else ""))
        labels.append(int(toxic))
    fair = toxicity.Scorer(toxicity.fit(columns(texts), np.array(labels)))
    blind = toxicity.Scorer(toxicity.fit(columns(texts), np.array(labels), swap=0.0))
    neutral, mention = "the person went to town", "the muslim went to town"
    assert fair.score("you idiot") > 0.3 and fair.score("you moron") > 0.3
    assert abs(fair.score(mention) - fair.score(neutral)) < 0.5 * abs(blind.score(mention) - blind.score(neutral))
    assert fair.score(mention) < 0.3


def test_counterparts_are_the_swapped_texts():
    """Every mention of a text swapped in the text itself, words that share a start and several groups included."""
    after, plain = toxicity.swaps()
    for text in ("The Muslim man and a manly woman", "ein Flüchtling, eine Frau", "une femme noire", "dos mujeres judías y un judío", "muslims muslim MUSLIM"):
        swapped = [toxicity.features(toxicity.WORD.sub(lambda m: swap.get(m[0].lower(), m[0]), text)) for swap in (after, plain)]
        assert list(toxicity.counterparts(toxicity.features(text))) == swapped
    assert list(toxicity.counterparts(toxicity.features("no group in here"))) == []


def test_slope_against_swapped_sentences():
    """The fit's loss and slope, worked out from the swapped sentences one by one."""
    texts = ["the muslim man is an idiot", "a woman and a manly muslim", "nothing of note", "jew jewish and muslims", "une femme idiot"]
    labels, names = np.array([1, 0, 0, 1, 0.0]), ["man", "muslim", "musli-", "jew", "idiot", "woman", "person", "femme", "pers-", "women", "chri-"]
    coded = toxicity.Coded(columns(texts))
    sample = toxicity.Sample(coded, labels, names, list(coded.changes()))
    pick = np.random.default_rng(4)
    weights = pick.normal(size=len(names) + 1)

    def plain(w):
        score = lambda text: 1 / (1 + np.exp(-(w[-1] + sum(w[n] for n, name in enumerate(names) if name in toxicity.features(text)))))
        out = -np.mean([np.log(score(t) if y else 1 - score(t)) for t, y in zip(texts, labels)]) + 0.05 * float(w[:-1] @ w[:-1])
        changes = []
        for text in texts:
            for swap in toxicity.swaps():
                other = toxicity.WORD.sub(lambda m: swap.get(m[0], m[0]), text)
                if other != text:
                    changes.append((score(other) - score(text)) ** 2)
        return out + 3.0 * np.mean(changes)

    total, slope = sample.loss(weights, 0.1, 3.0)
    assert abs(total - plain(weights)) < 1e-9
    for n in range(len(weights)):
        step = np.eye(len(weights))[n] * 1e-5
        assert abs((plain(weights + step) - plain(weights - step)) / 2e-5 - slope[n]) < 1e-6


def test_fit_without_both_labels():
    assert toxicity.fit(columns([]), np.array([])).weights == {}
    assert 0 < toxicity.Scorer(toxicity.fit(columns(["a b"]), np.array([1]))).score("") < 1


def test_words_are_kept_only_up_to_a_bound():
    model = toxicity.Model(-1.0, {"bad": 3.0, "badl-": 1.0})
    small, large = toxicity.Scorer(model, held=2), toxicity.Scorer(model)
    for text in ("a b c bad", "", "badly d", "Bad BADLY e f g"):
        assert small.score(text) == large.score(text)
    assert large.score("bad") > large.score("badly") > large.score("good")


def test_toxicity_of_messy_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, None), (None, 0, 1), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    clash = documents.withColumn("score", F.lit("x")).withColumn("__label", F.lit(1)).withColumn("toxic", F.lit(0))
    model = toxicity.train(clash, labels)
    rows = toxicity.score_toxicity(clash, model).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.score_toxicity(nothing, toxicity.train(nothing, labels)).count() == 0
    assert toxicity.train(documents, labels.where("false")).weights == {}


def test_toxicity_on_held_out_rows(spark):
    from docaudit.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op6_toxicity"](spark, folder)
    assert scored.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    kept = [r for r in rows if r["held_out"]]
    hits = sum(r["predicted"] and r["toxic"] for r in kept)
    assert hits >= 0.8 * sum(r["toxic"] for r in kept) and hits >= 0.9 * sum(r["predicted"] for r in kept)


# --- quality


def test_site_posteriors_shrink(spark):
    """One sparse bad host, one large bad host, one large good host: doc_scores are replaced by known ones."""
    sites = spark.createDataFrame([("good", "/a", 500, 450.0, 406.0), ("good", "/b", 500, 455.0, 415.0), ("bad", "/a", 400, 40.0, 5.0), ("bad", "/c", 3, 0.2, 0.02), ("tiny", "/", 2, 0.2, 0.02)], "__host string, __path string, __n long, __sum double, __squares double")
    prior = quality.estimate(sites)
    assert abs(prior.mean - (450 + 455 + 40 + 0.2 + 0.2) / 1405) < 1e-9 and 0 < prior.hosts < 10 and prior.paths > prior.hosts
    flat = spark.createDataFrame([("h", "/a", 100, 50.0, 26.0), ("h", "/b", 100, 50.0, 26.0), ("k", "/", 100, 50.0, 26.0)], sites.schema)
    assert quality.estimate(flat).hosts == quality.MOST
    assert quality.estimate(sites.where("false")) == quality.Prior(0.5, quality.MOST, quality.MOST)


def test_scores_equal_a_plain_computation(spark):
    pick = np.random.default_rng(0)
    rows = [(n, ("plain words in a line " * (n % 9 + 1)) if pick.random() < (0.9 if n % 3 else 0.2) else "!!! ### $$$ " * (n % 5 + 1), f"h{n % 3}", f"p{n % 2}") for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = np.array(["plain" in r[1] for r in rows], float)
    shapes = np.array([quality.shape(r[1]) for r in rows])
    classifier = quality.fit(shapes[:150], labels[:150])
    got = {r["doc_id"]: r for r in quality.score_quality(df, classifier, F.col("host"), F.col("path")).collect()}
    p = classifier.probabilities(shapes)
    hosts, paths = np.array([r[2] for r in rows]), np.array([r[2] + r[3] for r in rows])
    parts = [(h, s, int((paths == h + s).sum()), float(p[paths == h + s].sum()), float((p[paths == h + s] ** 2).sum())) for h in set(hosts.tolist()) for s in ("p0", "p1")]
    prior = quality.estimate(spark.createDataFrame(parts, "__host string, __path string, __n long, __sum double, __squares double"))
    logit = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    for n in range(len(rows)):
        of_host = (p[hosts == hosts[n]].sum() - p[n] + prior.hosts * prior.mean) / ((hosts == hosts[n]).sum() - 1 + prior.hosts)
        of_path = (p[paths == paths[n]].sum() - p[n] + prior.paths * of_host) / ((paths == paths[n]).sum() - 1 + prior.paths)
        score = 1 / (1 + np.exp(-(logit(p[n]) + logit(of_path) - logit(prior.mean))))
        assert abs(got[n]["doc_score"] - p[n]) < 1e-9 and abs(got[n]["path_score"] - of_path) < 1e-6 and abs(got[n]["score"] - score) < 1e-6
        assert got[n]["keep"] == (score >= 0.5)


def test_quality_of_messy_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 0), (2, 1, None), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    clash = documents.withColumn("score", F.lit("x")).withColumn("keep", F.lit(3)).withColumn("__label", F.lit(1))
    classifier = quality.train(clash, labels)
    rows = quality.score_quality(clash, classifier, F.col("source"), F.col("lang")).collect()
    assert len(rows) == documents.count() and all(0 < r["score"] < 1 and r["keep"] == (r["score"] >= 0.5) for r in rows)
    assert quality.score_quality(nothing, classifier, F.col("source"), F.col("lang")).count() == 0
    empty = quality.train(documents, labels.where("false"))
    assert all(r["keep"] for r in quality.score_quality(documents, empty, F.col("source"), F.col("lang")).collect())


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    classifier = quality.train(documents, labels.where(~out))
    rows = quality.score_quality(documents, classifier, F.col("source"), F.col("lang")).join(labels.where(out), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["keep"] for r in good) >= 0.98 * len(good) and sum(r["keep"] for r in bad) <= 0.15 * len(bad)


def test_quality_where_sites_hold_one_document(spark):
    """One document a site, one site in all, two documents on two hosts, null sites: no division by nothing."""
    texts = ["plain words in a line " * 9, "!!! ### $$$ " * 5, "another line of words " * 7, "| | # # !!", "short", "more words here for a line " * 4]
    shapes = np.array([quality.shape(t) for t in texts * 4])
    classifier = quality.fit(shapes, np.array([1, 0, 1, 0, 0, 1] * 4))
    for places in ([(f"h{n}", f"p{n}") for n in range(6)], [("h", "p")] * 6, [("h0", "p"), ("h1", "p")], [(None, None)] * 3, [("h", f"p{n}") for n in range(4)]):
        df = spark.createDataFrame([(n, t, *p) for n, (t, p) in enumerate(zip(texts, places))], "doc_id long, text string, host string, path string")
        rows = quality.score_quality(df, classifier, F.col("host"), F.col("path")).collect()
        assert len(rows) == len(places) and all(0 <= r["host_score"] <= 1 and 0 <= r["path_score"] <= 1 and 0 < r["score"] < 1 for r in rows)
        if len({p[0] for p in places}) == len(places):  # nothing else is known of the host: the global mean
            assert all(abs(r["host_score"] - sum(x["doc_score"] for x in rows) / len(rows)) < 1e-6 for r in rows)
