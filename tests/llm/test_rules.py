"""Quality rules and language identification: counts against plain code, distances, held-out accuracy."""

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scorewatch.llm import language_id as lang
from scorewatch.llm import quality_divergence as q
from scorewatch.llm.wordhash import words_of

SCHEMA = "doc_id long, text string, lang string, kept string"


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


def texts():
    rng = np.random.default_rng(3)
    small = [f"é{i}" for i in range(4)]
    out = ["", None, " \n\t", "a", "x " * 50, "a b c d e f g h " * 2, "one\ntwo\none\n \n \ntwo\none", "€" * 9 + " ßß", "a\x85b c\x1cd"]
    out += [" ".join(rng.choice(small, rng.integers(1, 40))) for _ in range(40)]
    out += ["\n".join(rng.choice(["l 1", "l 2", " ", "*#|"], 9)) for _ in range(10)]
    out += [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) + " p q r s t u v w" * int(k) for k in rng.integers(0, 4, 10)]
    return out + [" ".join(f"word{i}" for i in range(40000))]


def test_base_counts(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(texts())] + [(4, texts()[4], None, None), (None, None, None, None)]
    got = q.judge(spark.createDataFrame(rows, SCHEMA), q.References([], np.zeros((0, q.CLASSES)), [], [])).collect()
    want = sorted((str(d), *plain_counts(t)) for d, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_distances():
    a = np.array([[1.0, 1, 0], [0, 0, 2], [0, 0, 0], [3, 3, 0]])
    d = q.distances(a, np.array([[1.0, 1, 0]]))[:, 0]
    assert np.allclose(d, [0, 1, 1, 0])
    p, r = np.array([0.5, 0.25, 0.25]), np.array([0.1, 0.6, 0.3])
    m = (p + r) / 2
    want = np.sqrt((sum(p * np.log2(p / m)) + sum(r * np.log2(r / m))) / 2)
    assert np.isclose(q.distances(p[None] * 40, r[None] * 70)[0, 0], want)


def test_references_count_everything(spark):
    rows = [(i, "The cat, THE dog\n" * (i % 3 + 1) + "rare" + str(i), "en" if i % 2 else "de", "k") for i in range(60)] + [(99, "no", None, "k"), (98, None, "en", "k")]
    ref = q.learn_references(spark.createDataFrame(rows, SCHEMA).repartition(4), q.Rules(common_words=3))
    assert ref.langs == ["de", "en"]
    for i, name in enumerate(ref.langs):
        own = [t for _, t, l, _ in rows if l == name and t]
        assert ref.classes[i].sum() == sum(map(len, own))
        words = " ".join(own).lower().split()
        best = {x: words.count(x) for x in ("the", "cat,", "dog")}
        hashes = dict(zip(best, words_of(pa.array(list(best))).hashes))
        assert dict(zip(ref.words[i], ref.counts[i])) == {hashes[x]: n for x, n in best.items()}
        assert ref.counts[i].sum() == len(words)


def test_common_words_count_where_they_are_rare(spark):
    # "the" is common in one task and one word in 8,000 in the other
    rows = [(i, "the cat " * 300, "en", "x") for i in range(10)] + [(99, "the " + "dog " * 7999, "en", "x")]
    docs = spark.createDataFrame(rows[:10], SCHEMA).coalesce(1).union(spark.createDataFrame(rows[10:], SCHEMA).coalesce(1))
    ref = q.learn_references(docs, q.Rules(common_words=3))
    hashes = words_of(pa.array(["the", "cat", "dog"])).hashes
    assert dict(zip(ref.words[0], ref.counts[0])) == dict(zip(hashes, [3001, 3000, 7999]))
    assert ref.counts[0].sum() == 14000


def test_verdicts_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = q.judge(docs, q.learn_references(docs)).filter("not base_failed").join(labels, "doc_id").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
    kept = q.keep_good(docs, q.learn_references(docs))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in q.judge(docs, q.learn_references(docs)).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    ref = q.learn_references(empty)
    assert ref.langs == [] and q.judge(empty, ref).collect() == []
    assert lang.learn(empty) is None and lang.identify(empty, None).collect() == []


def test_gram_counts_of_each_text_alone():
    t = ["The cat", None, "", " é ", "the  CAT\n", "x", "aaaa", " "]
    all_at_once = lang.gram_counts(pa.array(t))
    assert all((all_at_once[i] == lang.gram_counts(pa.array([x], pa.string()))[0]).all() for i, x in enumerate(t))
    assert (all_at_once[0] == all_at_once[4]).all()
    assert all_at_once[0].sum() == 3 * len(" the cat")
    assert not all_at_once[1].any() and not all_at_once[2].any()


def test_languages_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    model = lang.learn(docs.filter(~docs.doc_id.isin(list(held))))
    got = {r["doc_id"]: r for r in lang.identify(docs, model).collect()}
    assert len(got) == len(rows)
    tested = [r for r in rows if r["doc_id"] in held and r["lang"] and r["text"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([r["rejected"] for r in got.values()]) < 0.01


@pytest.mark.parametrize("text,unknown", [(None, True), ("", True), (" 12 .,!", True), ("der hund", False), ("ж", False), ("٣", True)])
def test_no_letter_is_unknown(spark, text, unknown):
    rows = [(1, "der hund und die katze", "de", "x"), (2, "the dog and the cat", "en", "x")]
    model = lang.learn(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([(7, text, "fr", None), (7, text, "fr", None)], SCHEMA)
    got = lang.identify(asked, model).collect()
    assert len(got) == 2 and all((r["lang_pred"] == "und") == unknown for r in got)
    assert lang.keep_known(asked, model).columns == asked.columns
    assert unknown is False or lang.keep_known(asked, model).count() == 0


FOREIGN = [
    "La mattina il mercato della città era pieno di gente che comprava frutta, verdura e pane fresco. Un vecchio signore raccontava ai bambini "
    "la storia del ponte antico, mentre le donne parlavano del tempo e della prossima festa del paese vicino al fiume.",
    "Aamulla kaupungin torilla oli paljon ihmisiä, jotka ostivat hedelmiä, vihanneksia ja tuoretta leipää. Vanha mies kertoi lapsille tarinan "
    "vanhasta sillasta, kun naiset puhuivat säästä ja seuraavasta juhlasta joen rannalla olevassa kylässä.",
    "Rano na rynku w mieście było wielu ludzi, którzy kupowali owoce, warzywa i świeży chleb. Starszy pan opowiadał dzieciom historię starego "
    "mostu, a kobiety rozmawiały o pogodzie i o najbliższym święcie we wsi nad rzeką, gdzie mieszkała ich rodzina.",
]


def strange_texts():
    rng = np.random.default_rng(5)
    out = list(FOREIGN)
    for letters in ("bcdfghjklmnpqrstvwxz", "0123456789abcdef"):
        out += [" ".join("".join(rng.choice(list(letters), rng.integers(3, 10))) for _ in range(n)) for n in (30, 60, 120, 400)]
    return out


def test_foreign_and_random_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.filter("doc_id % 5 = 0 AND lang IS NOT NULL AND text IS NOT NULL")
    model = lang.learn(docs.filter("doc_id % 5 <> 0"))
    asked = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(strange_texts())], SCHEMA)
    assert [(r["doc_id"], r["score"]) for r in lang.identify(asked, model).collect() if not r["rejected"]] == []
    assert np.mean([r["rejected"] for r in lang.identify(held, model).collect()]) < 0.02


def test_sample_does_not_depend_on_length(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(lang, "_cluster", lambda v, k: drawn.append(v) or v[:1])
    # every text has its own mark by which it is found again in the bins
    rows = [(i, " ".join([f"mark{i}"] + ["und die katze"] * (1 if i % 2 else 200)), "de", "x") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lang.learn(docs, sample=100)
    order = docs.selectExpr("doc_id", "text", "xxhash64(doc_id, 'sample') AS h").collect()
    first = sorted(order, key=lambda r: (r["h"] % 2**20, r["h"]))[:100]
    want = model.vectors(lang.gram_counts(pa.array([r["text"] for r in first])))
    assert np.allclose(drawn[0], want, atol=1e-6)


def test_memory_of_a_task_is_small(spark):
    """Two megabytes of text in a batch took 200 MB and more in arrays."""
    class Docs:
        sparkSession, schema = spark, SCHEMA

        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(6)
    small = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10**4, 700)) for _ in range(600)])
    batch = pa.record_batch([pa.array(range(600)), small, pa.array(["en"] * 600), pa.array([""] * 600)], names=["doc_id", "text", "lang", "kept"])
    centroids = np.full((2, lang.BINS), lang.BINS**-0.5, np.float32)
    model = lang.Model(["de", "en"], centroids, np.arange(2), np.ones(lang.BINS, np.float32), np.zeros((2, lang.LENGTHS)))
    words = words_of(small)
    references = q.References(["en"], q.class_counts(words).sum(0)[None].astype(float), [np.zeros(0, np.uint64)], [np.ones(1)])
    for run in (lang.keep_known(Docs(), model), q.keep_good(Docs(), references)):
        tracemalloc.start()
        kept = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert kept == 600 and peak < 80e6  # 31 MB of them are given back at once
