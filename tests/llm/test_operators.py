"""Corpus operators against brute force, with nulls, empties, ties and clashing columns."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import decontaminate, embeddings, graph, language, lines, packing, sharding, simhash, tokens, urls, warc
from kestrel.llm.common import shared_path

SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away into the dark green woods tonight"
DOCS = [
    (1, SENTENCE),
    (2, SENTENCE),
    (3, SENTENCE.upper()),
    (4, SENTENCE + " again"),
    (5, ""),
    (6, None),
    (7, "   \n\t"),
    (8, "one two"),
    (8, "one two"),
    (None, SENTENCE),
    (9, "a line that is long enough to count\nshort\nA line that is long enough to count  "),
    (10, "a line that is long enough to count\nother text here"),
    (11, "  A LINE THAT IS LONG ENOUGH TO COUNT\n\nend"),
    (12, "word " * 9000),
    (13, "Ünïcode ﬁ  <|endoftext|> tab\there   \x85 \x1c x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"h1": F.lit("clash"), "rank": F.lit(1), "fp": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def write(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# -- components ---------------------------------------------------------------


def brute_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "descending"])
def test_components(spark, kind):
    rng = np.random.default_rng(3)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(40)],
        "random": [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(60)],
        "descending": [(100 - i, 100 - i - 1) for i in range(50)] + [(7, 7)],
    }[kind]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == brute_components(nodes, [p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


# -- 1 WARC -------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 700_001
    pages = [(5, "http://a/\r\nb", "same"), (3, None, "same"), (4, "u", None), (9, "u", ""), (1, "v", "é"), (None, "w", "same"), (7, "z", big), (8, "z", big), (8, "z", big)]
    sf = write(spark, tmp_path, pages=spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")))
    got = sorted(warc.op1_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok").collect(), key=str)
    ids = defaultdict(list)
    for i, _, html in pages:
        ids[html or ""].append(i)
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = min(x for x in ids[html or ""] if x is not None)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first, True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_warc_chunks_carry_digests(spark):
    body = bytes(range(256)) * 40
    rows = spark.createDataFrame([(1, "u", bytearray(body)), (2, "v", bytearray(b"other"))], "id long, uri string, body binary")
    manifest = warc.write_archives(warc.plan_records(rows, "id", "uri", "body", min_bytes=6), shared_path(spark, "warc"))
    chunks = [r for r in warc.read_chunks(manifest, chunk_bytes=1000).collect() if r.record_id == "1"]
    chunks.sort(key=lambda r: r.chunk_no)
    assert b"".join(r.data for r in chunks) == body and [r.is_last for r in chunks] == [False] * 10 + [True]
    for r in chunks:
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(body[: r.cum_bytes]).digest()).decode()


def test_warc_empty(spark, tmp_path):
    sf = write(spark, tmp_path, pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.op1_warc(spark, sf).count() == 0


# -- 2 packing ----------------------------------------------------------------


def check_pieces(pieces, ids_of, window):
    by_doc, by_sequence, padding = defaultdict(list), defaultdict(list), 0
    for r in pieces:
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids_of[r.doc_id])
    for doc, all_ids in ids_of.items():
        assert sum(n for _, n in by_doc[doc]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for start, n in sorted(by_doc[doc]):
                assert start == at
                at += n
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_packing_against_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    ids = defaultdict(list)
    for doc, text in DOCS:
        ids[doc].append([*own.encode(text or "", add_special_tokens=False).ids, 0])
    got = packing.pack(packing.tokenise(docs, "doc_id", "text", path, 1024)).collect()
    assert check_pieces(got, ids, 1024) == 0
    assert {r.doc_tokens for r in got if r.doc_id == 12} == {len(ids[12][0])}


def test_packing_covers_shared_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a" * 3 + " b" * int(n)) for i, n in enumerate([*rng.integers(0, 90, 300), *[20] * 200])]
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    table = packing.tokenise(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text", path, 64, keep_ids=True).cache()
    ids = {r.doc_id: [np.frombuffer(r.ids, "<u4").tolist()] for r in table.collect()}
    pieces = packing.pack(table, 64)
    assert check_pieces(pieces.collect(), ids, 64) == 0
    packed = packing.sequences(pieces, table, 64).collect()
    assert sorted(np.concatenate([np.frombuffer(r.ids, "<u4") for r in packed]).tolist()) == sorted(x for v in ids.values() for x in v[0])


def test_nnls_counts_stay_in_the_histogram():
    rng = np.random.default_rng(2)
    for _ in range(5):
        h = rng.integers(0, 40, 65)
        h[0] = h[64] = 0
        patterns = packing.combinations_of(h, 64)
        used = np.zeros(65, int)
        for p, n in zip(patterns, packing.solve_counts(h, patterns)):
            for x in p:
                used[x] += n
        assert (used <= h).all() and used.sum() > 0.5 * h.sum()


def test_packing_empty(spark, empty):
    assert packing.pack(packing.tokenise(empty, "doc_id", "text", tokens.tokenizer_path("byte_bpe_50k.json"), 1024)).count() == 0


@pytest.mark.parametrize("text", ["  two  spaces\n\n\nlines ", "it's they'LL I'd", "ünï ß ÀÉ × ÷ 12,5 €", "“quotes” – dash…", "\xa0nbsp\xad", "日本語 текст", "x<|endoftext|>y", "aͅb ʰ ​"])
def test_both_encoders_agree(text):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert packing._encoder(path)([text])[0] == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# -- 3 SimHash ----------------------------------------------------------------


def brute_print(text, width=4):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def test_simhash_rows(spark, docs, tmp_path):
    sf = write(spark, tmp_path, documents=docs)
    got = simhash.op3_simhash(spark, sf).collect()
    prints = {(i, t): brute_print(t) for i, t in DOCS}
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.doc_id) == sorted((i, f"{prints[i, t]:016x}") for i, t in DOCS if i)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == by[None] == 1 and by[5] == by[6] == by[7] == 5 and by[8] == 8


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_near_pairs_are_all_found(spark, segments):
    rng = np.random.default_rng(segments)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    prints = {0, 2**64 - 1}
    for x in base:
        prints.add(x)
        for _ in range(8):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    got = {tuple(sorted(r)) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, segments).collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want


def test_keep_one(spark, docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {1, 5, 8} <= {r.doc_id for r in kept.collect()} and not {2, 3, 6, 7, None} & {r.doc_id for r in kept.collect()}
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_judges_rows(spark):
    rng = np.random.default_rng(14)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (None, a), (None, b), (7, a), (7, c), (8, c), (9, d)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, a), (0, b), (7, c), (9, d)])


def test_similar_texts_are_all_found(spark):
    rng = np.random.default_rng(15)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for k in range(60):
        words = [word() for _ in range(60)]
        near = [*words]
        for at in (14, 44)[: 1 + k % 2]:  # similarities of 0.84 and 0.70
            near[at] = word()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert kept == {i for i, _ in rows if i % 2 == 0 or (i // 2 % 2 == 1 and (prints[i] ^ prints[i - 1]).bit_count() > 4)}


# -- 4 sharding ---------------------------------------------------------------


def test_table_is_even_and_steady():
    shards = tuple(f"s{k}" for k in range(10))
    full = [shards[k] for k in sharding.fill_table(shards, 1009)]
    sizes = [full.count(s) for s in shards]
    assert max(sizes) - min(sizes) <= 1
    less = shards[:-1]
    fewer = [less[k] for k in sharding.fill_table(less, 1009)]
    moved = sum(a != b for a, b in zip(full, fewer) if a != "s9")
    assert moved < 0.25 * 1009
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 1008)


def test_placement(spark, docs, empty):
    got = sharding.place(docs.withColumn("__k", F.lit(1)), ["doc_id"])
    assert got.columns == [*docs.columns, "__k", "slot", "shard"] and got.count() == len(DOCS)
    assert got.where("doc_id = 8").select("shard").distinct().count() == 1
    assert sharding.place(empty, ["doc_id"]).count() == 0


# -- 5 language ---------------------------------------------------------------


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    parts = {"aa": ["ba", "ko", "li", "mu"], "bb": ["ert", "stan", "oln", "qui"], "cc": ["ñez", "ción", "aro", "ll"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        words = ["".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(int(rng.integers(2, 40)))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_held_out(spark, tmp_path):
    rows = [*corpus(300), (1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (None, "bako limu", None), (1003, "zzzz xxxx wwww vvvv", None)]
    sf = write(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("code", F.lit("clash")))
    got = {r.doc_id: r for r in language.op5_language(spark, sf).collect()}
    truth = {i: lang for i, _, lang in rows}
    assert len(got) == len(rows)
    held = [r for i, r in got.items() if i is not None and i < 1000 and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[None].lang_pred == "aa"
    assert got[1003].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())


def test_language_stage_keeps_columns(spark, empty):
    df = spark.createDataFrame([*corpus(60), (99, None, "aa")], "doc_id long, text string, lang string")
    kept = language.reject_unknown(df)
    assert kept.columns == df.columns and kept.count() == 60
    assert language.reject_unknown(empty.withColumn("lang", F.lit(None).cast("string"))).count() == 0


# -- 6 URLs -------------------------------------------------------------------


def test_as_of_rules(spark):
    entries = [("bad.com", "block", "2024-01-01"), ("bad.com", "remove", "2024-03-01"), ("bad.com/good", "allow", "2024-02-01"), ("BAD.com", "block", "2024-05-01"), (None, "block", "2024-01-01"), ("x.org", "block", None)]
    captures = [
        (1, "http://bad.com/a", "2023-12-31", True), (2, "http://www.bad.com:80/a", "2024-01-01", False), (3, "http://bad.com/good/x", "2024-02-15", True),
        (4, "http://bad.com/", "2024-03-01", True), (5, "HTTPS://u:p@Bad.Com", "2024-06-01", False), (6, "not a url", "2024-06-01", True),
        (7, None, "2024-06-01", True), (8, "http://bad.com/", None, True), (9, "http://x.org/", "2024-06-01", True), (2, "http://www.bad.com:80/a", "2024-01-01", False), (None, "http://bad.com/", "2024-06-01", False),
    ]
    e = spark.createDataFrame(entries, "rule_key string, action string, d string").select("rule_key", "action", F.to_timestamp("d").alias("listed_at"))
    c = spark.createDataFrame(captures, "page_id long, url string, d string, want boolean").withColumn("t", F.to_timestamp("d"))
    got = urls.judge(c, e, "page_id", "url", "t").collect()
    assert sorted((str(r.page_id), r.kept) for r in got) == sorted((str(x[0]), x[3]) for x in captures)


def test_deep_rules(spark):
    e = spark.createDataFrame([("bad.com/a/b/c/d/e", "block")], "rule_key string, action string").withColumn("listed_at", F.to_timestamp(F.lit("2024-01-01")))
    c = spark.createDataFrame([(1, "http://bad.com/a/b/c/d/e/f/g"), (2, "http://bad.com/a/b/c/d/x")], "page_id long, url string").withColumn("t", F.to_timestamp(F.lit("2024-02-01")))
    assert {r.page_id: r.kept for r in urls.judge(c, e, "page_id", "url", "t").collect()} == {1: False, 2: True}


# -- 7 embeddings -------------------------------------------------------------


def brute_links(rows, threshold=0.95):
    ok = [v is not None and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0 for _, v in rows]
    x = [np.array(v) / np.linalg.norm(v) if good else None for good, (_, v) in zip(ok, rows)]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in range(len(rows))]
    root = brute_components(range(len(rows)), [(i, j) for i, js in enumerate(links) for j in js])
    groups = defaultdict(list)
    for i, r in root.items():
        groups[r].append(rows[i][0])
    return {rows[i][0]: (len(links[i]), min(groups[root[i]])) for i in range(len(rows))}


def test_embedding_links(spark):
    rng = np.random.default_rng(11)
    rows = [rng.standard_normal(16) for _ in range(500)]
    rows += [rows[0] + 0.02 * rng.standard_normal(16) for _ in range(60)]
    rows += [rows[k] + 0.1 * rng.standard_normal(16) for k in range(1, 40)]
    rows += [rows[3]] * 30
    data = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    data += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [float("inf")] + [1.0] * 15), (9004, [1.0, 2.0]), (9005, [2.0, 4.0]), (9006, [])]
    with_null = spark.createDataFrame([*data], "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(with_null).collect()}
    want = brute_links([(i, v) for i, v in data if v != []])
    want[9006] = (0, 9006)
    assert got == want


def test_tight_groups_linked_across(spark):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x)
    a = unit(rng.standard_normal(64))
    b = rng.standard_normal(64)
    b = unit(b - a * (a @ b))
    other = 0.965 * a + np.sqrt(1 - 0.965**2) * b
    rows = [unit(centre + 0.1 * unit(rng.standard_normal(64)) * rng.random()) for centre in (a, other) for _ in range(20)]
    rows += [rng.standard_normal(64) for _ in range(400)]
    data = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    want = brute_links(data)
    assert got == want and {want[i][1] for i in range(40)} == {0}


def test_rare_links_are_sought_until_a_search_finds_no_more(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [rng.standard_normal(32) for _ in range(600)]
    rows += [x + 0.2 * rng.standard_normal(32) for x in rows[:12]]
    data = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    search = embeddings.code_blocks

    def half(classes, dim, round_no, *more):  # a round finds half of the pairs, as where blocks are small for the rows
        return search(classes, dim, round_no, *more).where(F.pmod(F.xxhash64(F.col("u") + F.col("v")), F.lit(2)) == round_no % 2)

    monkeypatch.setattr(embeddings, "code_blocks", half)
    monkeypatch.setattr(embeddings, "ITERATIONS", 0)
    monkeypatch.setattr(embeddings, "AUDIT", 1)  # a sample without a link
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(data) and sum(n for n, _ in got.values()) > 12


def test_rounds_grow_with_the_rows():
    assert embeddings._tables(50_000) == embeddings.TABLES < embeddings._tables(10**7)


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- 8 lines ------------------------------------------------------------------


def brute_lines(rows):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != (-1 if doc is None else doc))]
        out.append((doc, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(spark, docs, tmp_path):
    sf = write(spark, tmp_path, documents=docs)
    got = [tuple(r) for r in lines.op8_lines(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(DOCS), key=str)


def test_lines_with_many_positions(spark, tmp_path):
    rng = np.random.default_rng(4)
    pool = [f"line number {k} of the shared pool, long enough ÄB" for k in range(40)] + ["tiny", ""]
    rows = [(int(i), "\n".join(rng.choice(pool, rng.integers(1, 300)).tolist() + [f"own line of document {i} and nobody else"])) for i in range(30)]
    sf = write(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in lines.op8_lines(spark, sf).collect()]
    assert sorted(got) == sorted(brute_lines(rows))


def test_lines_stage_keeps_columns(spark, docs, empty):
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == len(DOCS)
    assert got.where("doc_id = 9").first().text == "short"
    assert lines.dedup_lines(empty).count() == 0


# -- 9 token counts -----------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, docs, empty, name):
    path, cache = tokens.tokenizer_path(name), shared_path(spark, "cache")
    count = tokens._counter(path)
    got = tokens.count_tokens(docs, "doc_id", "text", path, cache).collect()
    want = [(i, len((t or "").encode()), count([t or ""])[0]) for i, t in DOCS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == len({t or "" for _, t in DOCS})
    assert tokens.count_tokens(docs, "doc_id", "text", path, cache).count() == len(DOCS) and spark.read.parquet(cache).count() == n
    assert tokens.count_tokens(empty, "doc_id", "text", path, cache).count() == 0


# -- 10 decontamination -------------------------------------------------------


def test_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(-1, 6, rng.integers(0, 40)).tolist()
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == d[-1, -1]


def passages(n, seed):
    rng = np.random.default_rng(seed)
    stock = ["the", "of", "and", "in", "to"]
    word = lambda: "".join(rng.choice(list("bcdfgklmnprst"), 6))
    return [" ".join(stock[rng.integers(5)] if rng.random() < 0.4 else word() for _ in range(int(rng.integers(15, 60)))) for _ in range(n)]


def test_contamination(spark, empty, monkeypatch):
    items, filler = passages(25, 1), passages(400, 2)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(150):
        parts = [filler[k] for k in rng.choice(400, 8)]
        if i % 5 == 0:
            k = i % 25
            text = items[k]
            if i % 10 == 0:
                text = text.upper().replace(" ", ",  ")
            if i % 15 == 0:  # a paraphrase: one word in twelve another, some words between
                w = text.split()
                for j in range(3, len(w), 12):
                    w[j] = "changed extra"
                text = " ".join(w)
            parts.insert(4, text)
            want[i] = k
        rows.append((i, " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "the of and in to the of and in to"), (None, items[2])]
    benchmark = spark.createDataFrame([*enumerate(items), (77, None), (78, "")], "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == want | {None: 2}
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 2000)  # a benchmark larger than one slice gives the same
    sliced = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {r.doc_id: r.item_id for r in sliced.collect()} == got
    kept = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert kept.count() == len(rows) - len(want) - 1  # and the row without an id
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(empty, benchmark.limit(0)).count() == 0


def test_long_items_are_found(spark):
    rng = np.random.default_rng(9)
    filler = passages(200, 4)
    item = lambda n: " ".join(" ".join(passages(n // 15 + 1, int(rng.integers(1 << 30)))).split()[:n])
    items = [item(n) for n in (1, 4, 15, 33, 100, 200, 400, 1000)]
    rows = [(i, " ".join([*(filler[k] for k in rng.choice(200, 6)), text, *(filler[k] for k in rng.choice(200, int(rng.integers(6))))])) for i, text in enumerate(items)]
    rows += [(100 + i, " ".join(filler[k] for k in rng.choice(200, 40))) for i in range(40)]
    half = items[-1].split()
    rows += [(200, " ".join(half[:600]))]  # too little of it
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.lcs) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark.where("item_id > 1")).collect()}
    assert got == {i: (i, 1.0) for i in range(2, len(items))}


def test_many_items_of_common_words_are_found(spark):
    rng = np.random.default_rng(10)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)])
    prose = lambda n: " ".join(words[(3000 * rng.random(n) ** 2).astype(int)])
    items = [prose(40) for _ in range(1500)]
    rows = [(i, f"{prose(150)} {items[i * 20]} {prose(150)}" if i < 60 else prose(300)) for i in range(160)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.lcs, round(r.cosine, 9)) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {i: (20 * i, 1.0, 1.0) for i in range(60)}


def test_decontamination_fits_on_the_whole_corpus(spark, monkeypatch):
    """No constant takes passages out of the fit, and the loadings are those of all passages."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 400)))) for _ in range(60)]
    items = [" ".join(rng.choice(words, 90)) for _ in range(5)]
    texts[3] += " " + items[2]
    docs, benchmark = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.cosine, 5)) for r in decontaminate.contaminated(docs, benchmark).collect())
    want = found()
    assert [r[:2] for r in want] == [(3, 2)]
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 1, raising=False)
    assert found() == want
    bench = decontaminate.load_benchmark(benchmark)
    n = len(bench.vocabulary) + decontaminate.BUCKETS
    rows = decontaminate.passage_rows(decontaminate.compact(docs, "doc_id", "text"), spark.sparkContext.broadcast(bench), n)
    passages, counts = decontaminate.passage_counts(rows, n)
    features = [bench.features(decontaminate.hashes_of(t))[lo : lo + 64] for t in texts for lo in range(0, len(t.split()), 64)]
    assert passages == len(features) and (counts == np.bincount(np.concatenate([np.unique(f) for f in features]), minlength=n)).all()
    idf = np.log((1 + passages) / (1 + counts)) + 0.05
    a = np.zeros((passages + len(items) * 2, n))
    for k, f in enumerate([*features, *(np.array(i)[lo : lo + 64] for i in bench.items for lo in (0, 64))]):
        at, tf = np.unique(f, return_counts=True)
        a[k, at] = (1 + np.log(tf)) * idf[at]
        a[k] /= np.linalg.norm(a[k])
    a[passages:] *= np.sqrt(max(1.0, passages / len(items)))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n, 5)))[0]
    for _ in range(decontaminate.POWER):
        basis = np.linalg.qr(a.T @ (a @ basis))[0]
    got = decontaminate.latent_space(rows, bench.items, idf, passages)
    assert np.abs(got @ got.T @ basis - basis).max() < 1e-4
