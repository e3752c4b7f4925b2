"""Words with signs inside, long quotations, distances tested on the sample, and odd rows in the filter."""

import time

import pytest
from pyspark.sql import functions as F

from terraloom.llm import toxicity

TERMS = [("idiot", False, 1), ("stupid", False, 1), ("worthless", False, 2)]
DOC = "doc_id long, text string, y int, score double, held_out boolean, word string, stem string"
ODD = [(None, None), (None, ""), (1, None), (2, ""), (2, ""), (3, " \n\t "), (4, "word " * 20_000)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.0, True, "x", "y") for r in rows], DOC)


@pytest.mark.parametrize("word", ["id1ot", "st*pid", "stup!d", "$tupid", "w0rthl3ss", "idi0t,", "(1diot)", "_idiot_", "idiot's", "idiot-like", '"idiot"'])
def test_misspelled_with_digits_and_signs(word):
    scanner = toxicity.Scanner(TERMS)
    assert sum(scanner.features(f"what an {word} there")[:2]) > 0


@pytest.mark.parametrize("word", ["1d10t", "2024", "*****", "$", "idea", "studio", "a+b", "worth"])
def test_other_words_are_no_hits(word):
    assert toxicity.Scanner(TERMS).features(f"what an {word} there") == [0.0] * 7


@pytest.mark.parametrize("open_, close", ['""', "“”", "«»", "„“", "‘’"])
def test_quotations_of_any_length(open_, close):
    scanner = toxicity.Scanner(TERMS)
    for n in (3, 300, 500, 5000):
        filler = "and so on " * (n // 10)
        assert scanner.features(f"then: {open_}an idiot {filler}{close} it was")[4] == 1.0
    assert scanner.features(f"then: {open_}an end{close} idiot")[4] == 0.0
    assert scanner.features(f"{open_}never closed\nidiot{close}")[4] == 0.0


@pytest.mark.parametrize("part", ["“", "«", "„", "‘", '"', "\n", "\n ", "a*", "a**", "$", "$a", "_", "é", ">\n", "idiot "])
def test_texts_made_to_be_slow_take_a_time_in_proportion(part):
    took = []
    for n in (50_000, 200_000):
        text = "idiot " + part * (n // len(part))
        start = time.process_time()
        toxicity.Scanner(TERMS).features(text)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_forgetting_changes_no_result(monkeypatch):
    words = [a + b + c for a in ("id", "st", "wo", "x") for b in ("io", "up", "rthl", "1") for c in ("t", "id", "ess", "e", "tt")]
    plain = toxicity.Scanner(TERMS).hits(words)
    monkeypatch.setattr(toxicity, "STATES", 3)
    monkeypatch.setattr(toxicity, "MEMORY", 2)
    assert toxicity.Scanner(TERMS).hits(words) == plain and plain


def sample(spark, near_miss):
    """Toxic documents say scum, clean ones say a word at one letter from it, if ``near_miss``."""
    rows = [(i, f"you scum number {i} here") for i in range(60)]
    rows += [(i, f"the {near_miss or 'sun'} of number {i} there") for i in range(100, 400)]
    rows += [(i, f"such zog number {i} as this") for i in range(500, 560)]  # terms of three letters are learned, too
    labels = spark.createDataFrame([(i, int(i < 100 or i >= 500)) for i, _ in rows], "doc_id long, toxic int")
    return toxicity.train_model(docs(spark, rows), labels)


def test_distances_are_tested_on_the_sample(spark):
    with_miss = {t: k for t, _, k in sample(spark, "scam").terms}
    without = {t: k for t, _, k in sample(spark, None).terms}
    assert with_miss["scum"] == 0 and without["scum"] == 1
    assert with_miss["zog"] == without["zog"] == 0


def test_repeated_ids_are_learned_from_alike(spark):
    rows = [(i, f"you scum number {i}") for i in range(40)] + [(i, f"sun number {i}") for i in range(100, 200)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    twice = docs(spark, rows + [(5, "a text of its own")])
    got = [sorted(map(tuple, toxicity.training_rows(d, labels, "doc_id", "text", "toxic", 1000).select("id", "text", "y").collect())) for d in (twice, twice.repartition(5), twice.orderBy(F.desc("text")))]
    assert got[0] == got[1] == got[2]


def test_the_filter_on_odd_rows(spark):
    clean = docs(spark, ODD)
    model = sample(spark, None)
    assert sorted(map(str, toxicity.keep_clean(clean, model).collect())) == sorted(map(str, clean.collect()))
    both = docs(spark, ODD + [(9, "you scum")])
    kept = toxicity.keep_clean(both, model)
    assert kept.columns == both.columns and kept.count() == len(ODD) and kept.where("doc_id = 9").count() == 0
    assert toxicity.keep_clean(docs(spark, []), model).count() == 0
    assert toxicity.keep_clean(docs(spark, []), toxicity.train_model(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
