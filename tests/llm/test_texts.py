import random

from siftstone.llm.leaks import gram_places, leaked_pairs, passage
from siftstone.llm.words import gram_hashes, winnow, word_codes, words

VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("bex", "dol", "fim", "gan", "hup", "jor", "kel", "mog")]


def _text(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_winnowing_keeps_every_long_enough_span():
    rng = random.Random(3)
    for _ in range(200):
        span = _text(rng, 6)
        sides = [_text(rng, rng.randint(0, 9)) + span + _text(rng, rng.randint(0, 9)) for _ in range(2)]
        hashes = [gram_hashes(word_codes(s, {}), 5) for s in sides]
        kept = [set(h[winnow(h, 2)].tolist()) for h in hashes]
        assert kept[0] & kept[1]


def test_words_ignore_layout_and_markup():
    assert words("<p>The&nbsp;<b>raw_id</b>, of\u200b\n// Line 5!</p>") == ["the", "rawid", "of", "line", "5"]
    assert words(None) == [] and words("  \n") == []


def _noisy(rng, item, a, n, altered):
    part = list(item[a : a + n])
    for k in rng.sample(range(1, n - 1), altered):
        part[k] = "changed" + str(k)
    return part


def test_passages_of_twenty_words_with_one_in_eight_altered(spark):
    rng = random.Random(8)
    items = [(i, " ".join(_text(rng, 60))) for i in range(12)]
    docs, want = [], set()
    for d in range(60):
        i = rng.randrange(12)
        item = items[i][1].split()
        n = rng.choice([20, 24, 32, 40])
        part = _noisy(rng, item, rng.randint(0, 60 - n), n, n // 8)
        docs.append((d, " ".join(_text(rng, 30)) + "\n> " + "  ".join(w.upper() for w in part) + ". " + " ".join(_text(rng, 30))))
        want.add((d, i))
    for d in range(60, 80):
        item = items[d % 12][1].split()
        docs.append((d, " ".join(_text(rng, 30) + item[5:17] + _text(rng, 30))))
    docs += [(90, None), (91, ""), (None, items[0][1]), (92, docs[0][1]), (0, docs[0][1])]
    want.add((92, next(i for d, i in want if d == 0)))
    doc_df, item_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, " ")], "item_id long, item_text string")
    assert {tuple(r) for r in leaked_pairs(doc_df, item_df).select("doc_id", "item_id").collect()} == want
    assert leaked_pairs(doc_df.limit(0), item_df).count() == 0 and leaked_pairs(doc_df, item_df.limit(0)).count() == 0


def test_shared_sentences_carry_no_weight(spark):
    rng = random.Random(2)
    common = " ".join(_text(rng, 24)) + "."
    items = spark.createDataFrame([(i, common + " " + " ".join(_text(rng, 40)) + ".") for i in range(6)], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, common, "x")], "doc_id long, text string, item_id string")
    assert leaked_pairs(docs, items).count() == 0 and leaked_pairs(docs, items, shared_by=7).count() == 6
    assert leaked_pairs(docs, items, shared_by=7, broadcast_rows=0).count() == 6


def _edited(rng, part, at, n, kind):
    fresh = [f"other{rng.random()}" for _ in range(n)]
    return part[:at] + (fresh if kind != "dropped" else []) + part[at + (0 if kind == "added" else n) :]


def _found_by_brute_force(doc, item, one_in=8, least=20):
    """Whether some stretch of the item of ``least`` words or more stands in the document with few edits, over all places."""
    most = len(item) // one_in
    for i0 in range(len(item) - least + 1):
        for j0 in (j for j, w in enumerate(doc) if w == item[i0]):
            edits = {(i0, j0): 0}
            for i in range(i0, len(item) + 1):
                for j in range(max(j0, j0 + i - i0 - most), min(len(doc), j0 + i - i0 + most) + 1):
                    if (i, j) != (i0, j0):
                        least_edits = min(
                            edits.get((i - 1, j - 1), 99) + (i == 0 or j == 0 or item[i - 1] != doc[j - 1]), edits.get((i - 1, j), 99) + 1, edits.get((i, j - 1), 99) + 1
                        )
                        edits[i, j] = least_edits
                        if i - i0 >= least and j and item[i - 1] == doc[j - 1] and least_edits * one_in <= i - i0:
                            return True
    return False


def test_edits_side_by_side_at_every_place():
    rng = random.Random(12)
    for n in (20, 21, 24, 25, 32, 40, 64):
        item = _text(rng, n)
        for kind, size in (("altered", 3), ("altered", 2), ("added", 2), ("dropped", 2), ("added", 1), ("dropped", 3)):
            for at in range(1, n - size):
                doc = _text(rng, 5) + _edited(rng, item, at, size, kind) + _text(rng, 5)
                got = passage(doc, gram_places(doc), item, [1] * n) >= 20
                assert got == _found_by_brute_force(doc, item), (n, kind, size, at)
                assert got or size * 8 > n


def test_both_plans_find_the_same(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "eval_items"))
    found = [{tuple(r) for r in leaked_pairs(docs, items, broadcast_rows=n).collect()} for n in (2_000_000, 0)]
    assert found[0] == found[1] and found[0]


def test_long_texts_end():
    rng = random.Random(4)
    doc = _text(rng, 40_000)
    assert passage(doc, gram_places(doc), doc[100:20_100], [1] * 20_000) >= 20_000
