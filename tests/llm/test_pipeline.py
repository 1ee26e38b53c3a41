"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import tokens
from tests.llm.test_operators import brute_components, brute_lines, brute_print, check_pieces, corpus, passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def raw_documents():
    """Three invented languages, copies, near copies, shared lines, leaks, junk, nulls and empties."""
    rng = np.random.default_rng(8)
    words = corpus(600, seed=5)
    items = passages(6, 4)
    rows = []
    for k in range(120):
        lang = words[k][2]
        pool = [w for i, w, c in words if c == lang]
        lines = [" ".join(rng.choice(pool, 3)) for _ in range(4)]
        if k % 4 == 0:
            lines.insert(1, "this very line stands in a quarter of all documents")
        if k % 15 == 7:
            lines.insert(2, items[k % 6])
        rows.append((k, "\n".join(lines), lang, f"src{k % 3}", 0))
    rows += [(200 + k, rows[k][1], rows[k][2], "copy", 0) for k in range(10)]
    for k in range(20, 60):  # near copies: one word of about fifty another
        w = rows[k][1].split(" ")
        w[len(w) // 2] = "ba"
        rows.append((400 + k, " ".join(w), rows[k][2], "near", 0))
    for k in range(4):  # leaks inside a line of a document that is like no other
        pool = [w for i, w, c in words if c == words[k][2]]
        w = list(rng.choice(pool, 60))
        rows.append((500 + k, " ".join([*w[:30], items[k], *w[30:]]), words[k][2], "leak", 0))
    rows += [rows[119]] * 2  # repeated rows
    rows += [(300, "zzq xxv wwj kkz qqx " * 20, None, "junk", 0), (301, None, "aa", "null", 0), (302, "", "bb", "empty", 0), (303, "123 456 !?", "bb", "signs", 0)]
    return rows, items


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows, items = raw_documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__k", F.lit(1)).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    inputs, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
    return sf, [*inputs, docs], items


def jaccard(x, y, width=5):
    x, y = (t.encode().lower().split() for t in (x, y))
    x, y = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (x, y))
    return len(x & y) / len(x | y)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_language_drops_what_is_in_no_language(staged):
    before, after = texts(staged[1][0]), texts(staged[1][1])
    assert set(before) - set(after) == {300, 301, 302, 303}
    assert staged[1][1].columns == staged[1][0].columns


def test_lines_leave_the_last_holder(staged):
    import hashlib

    before, after = texts(staged[1][1]), texts(staged[1][2])
    want = {d: h for d, _, _, h in brute_lines(list(before.items()))}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in staged[1][2].collect())


def test_simhash_leaves_one_of_each_group(staged):
    before, after = texts(staged[1][2]), texts(staged[1][3])
    prints = {d: brute_print(t) for d, t in before.items()}
    ids = sorted(before)
    root = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    alone = sorted(set(root.values()))
    similar = [(a, b) for a in alone for b in alone if a < b and jaccard(before[a], before[b]) >= 0.8]
    ideal = set(brute_components(alone, similar).values())
    copies = set(alone) - ideal
    assert copies and set(after) == ideal  # nothing without a near copy goes, and none that has one stays


def test_decontamination_drops_the_leaks(staged):
    before, after = texts(staged[1][3]), texts(staged[1][4])
    leaks = {d for d, t in before.items() if any(i in t for i in staged[2])}
    gone = set(before) - set(after)
    edited = {d for d in before if 400 <= d < 500 and (d - 400) % 15 == 7}  # leaks with one word changed
    assert leaks and leaks <= gone <= leaks | edited


def test_packing_covers_every_token(staged):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for r in staged[1][4].collect():
        ids[r.doc_id].append([*own.encode(r.text, add_special_tokens=False).ids, 0])
    assert len(ids[119]) == 3
    assert check_pieces(staged[1][5].collect(), ids, corpus_pipeline.WINDOW) == 0


def test_run_is_all_stages(spark, staged):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    got, want = key(corpus_pipeline.run(spark, staged[0])), key(staged[1][5])
    assert sum(x[2] for x in got) == sum(x[2] for x in want) and {x[0] for x in got} == {x[0] for x in want}


def test_empty_documents(spark, staged, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{staged[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
