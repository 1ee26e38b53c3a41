"""Corpus operators at their edges: brute force where SQL cannot say it, clashing columns, nulls, empties, very long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import decontaminate, embeddings, language, packing, sharding, simhash, tokens, urls
from tests.llm.test_operators import brute_components, brute_links, brute_print, corpus, write

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rk", "st", "l", "", "m")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


# -- clashing columns ---------------------------------------------------------


def test_placement_takes_the_place_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", 9), (None, "y", 8)], "doc_id long, shard string, slot int")
    got = sharding.place(df, ["doc_id"])
    assert got.columns == ["doc_id", "slot", "shard"] and got.select("shard", "slot").where("shard LIKE 'shard-%'").count() == 2


def test_language_takes_the_place_of_clashing_columns(spark):
    rows = [(*r, "old", 1.0, "z") for r in corpus(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, known string")
    got = language.identify(df, language.train(df))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "known"]
    assert got.where("lang_pred = lang AND known BETWEEN 0 AND 1").count() >= 58


def test_urls_with_clashing_columns_and_no_rows(spark):
    e = spark.createDataFrame([("bad.com", "block", "old")], "rule_key string, action string, k string").withColumn("listed_at", F.to_timestamp(F.lit("2024-01-01")))
    long = "http://bad.com/" + "/".join(["folder"] * 3000) + "?q=" + "x" * 100_000
    c = spark.createDataFrame([(1, long, "a", "b", "c"), (2, "http://good.com/", "a", "b", "c")], "page_id long, url string, host string, rule_key string, kept string").withColumn("t", F.to_timestamp(F.lit("2024-02-01")))
    got = {r.page_id: r.kept for r in urls.judge(c, e, "page_id", "url", "t").collect()}
    assert got == {1: False, 2: True}
    assert urls.judge(c.limit(0), e, "page_id", "url", "t").count() == 0
    assert urls.judge(c, e.limit(0), "page_id", "url", "t").where("kept").count() == 2


def test_decontamination_with_clashing_columns_and_repeated_ids(spark):
    rng = np.random.default_rng(21)
    item = sentence(rng, 30)
    filler = lambda n: sentence(rng, n)
    rows = [(1, f"{filler(20)} {item} {filler(20)}", 5), (1, filler(60), 6), (2, filler(40), 7), (2, filler(40), 7), (3, f"{filler(60_000)} {item} {filler(20_000)}", 8), (None, None, 9), (4, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long").withColumns({"ids": F.lit("x"), "version": F.lit("y"), "slice": F.lit(0), "cosine": F.lit(2.0)})
    benchmark = spark.createDataFrame([(7, item, 1), (7, item, 2), (8, None, 3)], "item_id long, text string, version int")
    got = {r.doc_id: (r.item_id, round(r.cosine, 6), r.lcs) for r in decontaminate.contaminated(df, benchmark).collect()}
    assert got == {1: (7, 1.0, 1.0), 3: (7, 1.0, 1.0)}
    kept = decontaminate.remove_contaminated(df, benchmark)
    assert kept.columns == df.columns and sorted(r.item_id for r in kept.collect()) == [6, 7, 7, 9, 9]


# -- 2 packing ----------------------------------------------------------------


def test_both_encoders_agree_on_generated_texts():
    """Texts of all characters that the quick encoder is used for, in random order, with words and digits between."""
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    encode, own = packing._encoder(path), Tokenizer.from_file(path)
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and packing._plain(chr(c))]
    rng = np.random.default_rng(22)
    every = [plain[i] for i in rng.permutation(len(plain))]
    texts = ["".join(every[i : i + 40]) for i in range(0, len(every), 40)]
    common = [c for c in plain if ord(c) < 0x250]
    for _ in range(1500):
        parts = [rng.choice([" ", "\n", "  ", " \n", "'s", "'", "12", "a", "Étude", ""]) + "".join(rng.choice(common, rng.integers(1, 6))) for _ in range(12)]
        texts.append("".join(parts))
    assert encode(texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]


# -- 3 SimHash ----------------------------------------------------------------


def test_simhash_components_against_brute_force(spark, tmp_path):
    """Whole results where fingerprints differ by 0 to 6 bits, chains of links among them."""
    rng = np.random.default_rng(23)
    rows = []
    for k in range(60):
        words = sentence(rng, 150).split()
        for _ in range(6):  # each version is the one before with a word changed
            rows.append((len(rows), " ".join(words)))
            words[int(rng.integers(150))] = str(rng.choice(WORDS))
    rows += [(9000 + i, t) for i, (_, t) in enumerate(rows[:40:7])]
    prints = {i: brute_print(t) for i, t in rows}
    distances = [(a, b, (prints[a] ^ prints[b]).bit_count()) for a in prints for b in prints if a < b]
    assert {1, 2, 3, 4, 5} <= {d for *_, d in distances}
    want = brute_components(sorted(prints), [(a, b) for a, b, d in distances if d <= 4])
    sf = write(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in simhash.op3_simhash(spark, sf).collect()} == want


def test_parities_bound_what_sets_share():
    rng = np.random.default_rng(24)
    for _ in range(300):
        x, y = (rng.choice(400, rng.integers(1, 200), replace=False).astype(np.int64) * 0x9E3779B9 for _ in range(2))
        bound = simhash.most_common(simhash._parities(x), len(x), simhash._parities(y), len(y))
        assert bound >= len(np.intersect1d(x, y))
    x = np.arange(300) * 7919
    assert simhash.most_common(simhash._parities(x), 300, simhash._parities(x), 300) == 300
    assert simhash.most_common(simhash._parities(x), 300, simhash._parities(x + 1_000_003), 300) < 240


def test_repeated_rows_of_near_copies(spark):
    rng = np.random.default_rng(25)
    words = sentence(rng, 80).split()
    near = [*words]
    near[40] = "other"
    rows = [(1, " ".join(words))] * 3 + [(2, " ".join(near))] * 3 + [(3, sentence(rng, 80))] * 2
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 1, 3, 3]


# -- 5 language ---------------------------------------------------------------


def test_filters_against_sets(spark):
    """The learned filters hold what plain sets of typical n-grams hold, and little else."""
    rows = corpus(240, seed=3)
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {}
    for _, text, lang in rows:
        codes = language._grams(text)
        for c in [] if codes is None else codes.tolist():
            counts.setdefault(c, {}).setdefault(lang, 0)
            counts[c][lang] += 1
    totals = {k: sum(n.get(k, 0) for n in counts.values()) for k in model.languages}
    typical = {k: set() for k in model.languages}
    for c, n in counts.items():
        shares = {k: v / totals[k] for k, v in n.items()}
        top = max(shares, key=lambda k: shares[k])
        if n[top] >= 2:
            for k, share in shares.items():
                if share >= language.SHARE * shares[top]:
                    typical[k].add(c)
    for _, text, _ in rows[:60]:
        codes = language._grams(text)
        if codes is not None:
            seen, some = model.seen(codes)
            exact = np.array([sum(c in typical[k] for c in codes.tolist()) for k in model.languages])
            assert (seen >= exact).all() and (seen - exact).sum() <= 0.2 * len(codes) + 3 and some >= exact.max()


def test_more_languages_than_a_mask_word_holds(spark):
    rng = np.random.default_rng(26)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        rows += [(100 * k + i, " ".join("".join(rng.choice(letters, 3)) for _ in range(30)), f"l{k:02d}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert len(model.languages) == 70 and len(model.masks) == 2
    assert language.identify(df, model).where("lang_pred = lang").count() == len(rows)


def test_table_follows_the_data_and_stays_in_bounds(spark, monkeypatch):
    df = spark.createDataFrame(corpus(300), "doc_id long, text string, lang string")
    small, large = language.train(df.limit(5)), language.train(df)
    assert small.masks.shape[1] <= large.masks.shape[1] <= 1 << language.MOST_BITS
    monkeypatch.setattr(language, "MOST_BITS", language.LEAST_BITS)  # no room for all: the frequent n-grams are held
    tight = language.train(df)
    assert tight.masks.shape[1] == 1 << language.LEAST_BITS
    assert language.identify(df, tight).where("lang_pred = lang").count() >= 280


def test_very_long_text_has_a_language(spark):
    rows = corpus(90, seed=4)
    long = " ".join(t for _, t, lang in rows if lang == "bb")
    df = spark.createDataFrame([*rows, (900, long * 200, "bb")], "doc_id long, text string, lang string")
    assert language.identify(df, language.train(df)).where("doc_id = 900").first().lang_pred == "bb"


# -- 7 embeddings -------------------------------------------------------------


def test_repeated_and_null_vector_ids(spark):
    rng = np.random.default_rng(27)
    x, y = rng.standard_normal(8), rng.standard_normal(8)
    rows = [(1, x), (1, x), (1, y), (2, x * 3), (None, y), (3, -x)]
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in rows], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (None, 1, 1, False), (3, 0, 3, True)], key=str)


def test_large_component_is_counted_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAST_CHUNK", 16)
    monkeypatch.setattr(embeddings, "MOST_CHUNK", 16)
    rng = np.random.default_rng(28)
    centre = rng.standard_normal(32)
    rows = [centre + rng.standard_normal(32) * rng.choice([0.02, 0.2, 0.25]) for _ in range(150)] + [rng.standard_normal(32) for _ in range(50)]
    data = [(i, [float(v) for v in e]) for i, e in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(data)


# -- 10 decontamination -------------------------------------------------------


def brute_matches(rows, items):
    """Every document against every item by the checks of order and answer alone, at all stretches."""
    found = {}
    for doc, text in rows:
        words = decontaminate.words_of(text or "")
        for k, item in items:
            own = decontaminate.words_of(item)
            place = {w: n for n, w in enumerate(dict.fromkeys(own))}
            a, b = [place[w] for w in own], [place.get(w, -1) for w in words]
            reach = len(a) + decontaminate.WINDOW
            if any(decontaminate.confirm(a, b[lo : lo + 2 * reach]) for lo in range(0, max(1, len(b) - reach), max(1, reach // 2))):
                found.setdefault(doc, set()).add(k)
    return found


@pytest.mark.parametrize("length", [15, 40, 120, 500, 2000])
def test_copies_and_paraphrases_of_any_length_against_brute_force(spark, length):
    rng = np.random.default_rng(length)
    items = [(k, sentence(rng, length)) for k in range(10)]
    rows = []
    for k, item in items:
        light = [w if rng.random() > 0.08 else str(rng.choice(WORDS)) + "x" for w in item.split()]
        heavy = [w if rng.random() > 0.6 else str(rng.choice(WORDS)) for w in item.split()]
        for n, words in enumerate((item.split(), light, heavy, [])):
            rows.append((10 * k + n, " ".join([sentence(rng, 150), *words, sentence(rng, 150)])))
    df, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.contaminated(df, benchmark).collect()}
    want = brute_matches(rows, items)
    assert set(got) <= set(want) and all(got[d] in want[d] for d in got)
    assert all(10 * k in got for k in range(10))  # every copy
    assert sum(10 * k + 1 in got for k in range(10)) >= 0.9 * sum(10 * k + 1 in want for k in range(10)) > 0
    assert not any(10 * k + 3 in got for k in range(10))
