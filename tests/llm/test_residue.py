import random

import pytest
from pyspark.sql import functions as F

from siftstone.llm import residue
from siftstone.llm.residue import SENTENCE, residue_documents, signs
from tests.conftest import rows

RESIDUE = [
    "Real words here.\nSeverity: {{ repo_name }}", "Owner: [[due date]], due %DUE_DATE%", "Lorem ipsum dolor sit amet consectetur nulla esse.", "Please enable JavaScript to view this report.", "502 Bad Gateway",
    "Loading...\nSorry, something went wrong on our side. Request id 5c96995dda28. Try again later.", "The page cfe4b89b1d8c could not be found on this server.", "Your text goes here. Your text goes here.",
    "<html><head><title>503 Service Unavailable</title></head><body><h1>Service Unavailable</h1><p>ref de432b74f593</p></body></html>", "keeps (to be completed: owner) in a cache",
]
CLEAN = [
    'The log shows "502 Bad Gateway" for 19 minutes.', "```\n<h1>{{ summary }}</h1>\n```\nAbove, one value is escaped.", "A value such as ${cursor_filter} is expanded.", "> Please enable JavaScript to view this report.",
    "The fixture fills member_id with lorem ipsum text to reach 27 kilobytes.", "load_quota_v2 answers with 404 Not Found for unknown ids.", "The payload {{ 39 * 22 }} came back.", "Replace the marker [NAME] by hand.", "", "  \n ", "Use `{{ severity }}` there.",
]


def test_residue_and_talk_about_it(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(RESIDUE + CLEAN)] + [(50, None, None), (None, RESIDUE[0], None), (0, RESIDUE[0], "y")], "doc_id long, text string, cls string")
    assert {r[0] for r in rows(residue_documents(df), "doc_id")} == set(range(len(RESIDUE)))
    assert residue_documents(df.limit(0)).count() == 0


FREE = [
    "Please enable JavaScript in order to view our page.", "Access to it was denied.", "Your text will go here.", "JavaScript is disabled in this browser.", "This page really requires JavaScript.", "The page you want could not be found.",
]


def test_links_reach_what_is_no_seed(spark):
    seeds = {c for s in residue.SEEDS for k, c in signs(s, {}) if k == SENTENCE}
    assert not any(c in seeds for t in FREE for k, c in signs(t, {}) if k == SENTENCE)
    # The last is like the one before it, and too unlike every seed.
    near = "Your session has expired, so sign in again now"
    far = [near + ".", near + ", please friend."]
    texts = FREE + far + ["The parser reads a page and writes JavaScript.", "Please review the text in this browser test."]
    got = {r.doc_id: r for r in residue_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) == set(range(len(FREE) + 2))
    assert all(r.hops >= 1 and not r.by_form for r in got.values()) and got[len(FREE) + 1].hops == 2


@pytest.mark.parametrize("least, flips", [(residue.SEED_SIMILARITY, residue.SEED_FLIPS), (residue.LINK_SIMILARITY, residue.LINK_FLIPS)])
def test_tables_find_near_classes_of_any_length(spark, least, flips):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    known, others = [], []
    for n in (1, 2, 3, 5, 8, 14, 40):
        for _ in range(25):
            old = [rng.choice(words) for _ in range(n)]
            known.append(" ".join(old))
            for _ in range(6):
                new = list(old)
                for _ in range(rng.randint(1, max(1, n // 4))):
                    k = rng.randrange(len(new) + 1)
                    new[k : k + rng.randint(0, 1)] = [rng.choice(words)]
                others.append(" ".join(new))
    texts = sorted(set(known) | set(others))
    place, grams = residue.trigram_sets(texts)
    sets = [set(grams[place == i].tolist()) for i in range(len(texts))]
    hashed = spark.createDataFrame(list(enumerate(texts)), "cls long, sentence string").mapInPandas(residue._hash_classes, "cls long, simhash long, grams array<long>").persist()
    ids = {t: i for i, t in enumerate(texts)}
    frontier = hashed.where(F.col("cls").isin(sorted({ids[t] for t in known})))
    want = {(ids[a], b) for a in known for b, s in enumerate(sets) if len(s & sets[ids[a]]) >= least * len(s | sets[ids[a]])}
    got = {tuple(r) for r in residue.near_classes(residue.simhash_tables(hashed), hashed, frontier, flips, least).collect()}
    assert got <= want and len(want) > 300 and len(got) >= 0.9 * len(want)


def test_sentences_in_a_row_are_filler(spark):
    docs = [(1, "Real words stand here.\n" + "Write the outcome of it here. " * 3), (2, "Write the outcome of it here."), (3, "No, no, no."), (4, "Yes. Yes. Yes. Yes."), (5, "Two of a kind here. Two of a kind here. Other words then."), (6, "qwe qwe qwe qwe")]
    # Words that many write once are no filler where one text repeats them.
    docs += [(100 + k, "Nobody calls it from there.") for k in range(20)] + [(200, "Nobody calls it from there. " * 4)]
    assert [r[0] for r in rows(residue_documents(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id")] == [1, 2, 3, 6]


def test_names_in_certain_fields_settle_possible_ones(spark):
    docs = [(1, "Owner: {{ due date }}"), (2, "Ends at [due date], they say."), (3, "[region] is a label."), (4, "A value such as ${due_date}."), (5, "See `{{ region }}` and '[[due date]]'."), (6, "Dear [first name], hello.")]
    assert [r[0] for r in rows(residue_documents(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id")] == [1, 2, 4, 6]


def test_most_residue_is_found_from_seeds_that_no_document_holds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus = {c for r in docs.where("text is not null").select("text").collect() for k, c in signs(r.text, {}) if k == SENTENCE}
    whole = residue_documents(docs)
    free = [s for s in residue.default_seeds() if not any(c in corpus for k, c in signs(s, {}) if k == SENTENCE)]
    found = residue_documents(docs, free).select("doc_id")
    assert found.join(whole, "doc_id", "left_anti").count() == 0 and found.count() >= 0.8 * whole.count()
    assert whole.where("hops >= 1 and not by_form").count() > 0


def test_long_texts_without_ends(spark):
    text = "word_1 " * 200_000 + "and plain words without end " * 40_000
    docs = spark.createDataFrame([(1, text), (2, text + ". Access denied.")], "doc_id long, text string")
    assert [r[0] for r in rows(residue_documents(docs), "doc_id")] == [2]
