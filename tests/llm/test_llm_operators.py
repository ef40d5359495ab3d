"""The operators against brute force, the libraries they must equal, and planted cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandloom.llm import audio, common, decontaminate, jaccard, line_dedup, pii, quality, suffix_dedup
from strandloom.llm.piece_fst import Transducer, decode_pieces, encode_pieces, round_trips
from strandloom.llm.pretokens import cut
from strandloom.llm.token_counts import token_counts
from strandloom.llm.token_store import digests, read_tokens, write_tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\nlines\n\n", "é日½ ñ", "x\x00y\x1c z", "<|endoftext|> in a text<|endoftext|>", "a,b.c,\nD. e", "don't 's", "▁mark ▁", "word " * 3000, "q" * 5000]


def frame(spark, rows, parts=3):
    """Rows with columns that clash with the operators' own names."""
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, n double")
    return df.withColumns({"i": F.lit(7), "token": F.lit("no"), "k": F.lit(None).cast("int")}).repartition(parts)


def odd_rows():
    rows = list(enumerate(ODD))
    return [*rows, rows[5], (None, "a null id"), (3, "another text of id 3")]


def words(rng, n, kinds=60):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


# --- tokens ---


def test_cut_keeps_tokens(tokenizer):
    for t in ODD:
        parts = cut(t or "")
        ids = [x for j, p in enumerate(parts) for x in tokenizer.encode(" " * (j > 0) + p, add_special_tokens=False).ids]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_parts_of_chunks_equal_the_library(tokenizer):
    from strandloom.llm import token_store

    odd = ["", "\n", "a\nb", "a\n\nb c", "x \n y", " a,b. c", " it's don't.\nIt's 'tis, ok,", "a.\n'b c\n\"d\" e\n", "a\r\nb c\x1cd e\n.f"]
    odd += ["é,,,, ñ!!!!!!!!!!!! 12,\n34. a1.\nb2,", "<|endoftext|> a\n<|endoftext|>. b", "ab'. c'\n'd", " a\n b", "日本。\n語, x\u3000y ź.", "w-\nv_ _x_ y__", "a** b** a**\na** a"]
    for _ in range(2):  # unknown, then remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in token_store.encode(odd, BPE, None)]
        assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x in odd]


def own_ids(enc, texts):
    coded = [t.encode() for t in texts]
    values, n = enc.encode(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    return [x.tolist() for x in np.split(values, np.cumsum(n)[:-1])]


def test_units_beside_any_character_equal_the_library(tokenizer):
    from strandloom.llm.pretokens import Encoder

    chars = [chr(c) for c in [*range(0x3100), *range(0xD7A0, 0xD800), *range(0xE000, 0x10200), *range(0x1F300, 0x1F700)]]
    texts = [f"a{c}b.{c}. {c} {c}5{c}'{c}\n{c}\n {c}{c}s'{c} \t{c}" for c in chars]
    assert own_ids(Encoder(BPE), texts) == [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_units_whatever_the_table_holds(tokenizer, monkeypatch):
    from strandloom.llm import pretokens

    r = random.Random(3)
    texts = ["".join(r.choices("abcdeé sd'\n\t .,(5×\xa0ж日\0", k=r.randint(0, 80))) for _ in range(2000)] + ["<|endoftext|>a. <|endoftext|>", "", "x" * 5000]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(pretokens, "SLOTS", 64)  # units put others out
    monkeypatch.setattr(pretokens, "AT_ONCE", 500)
    monkeypatch.setattr(pretokens, "BLOCK", 3000)
    enc = pretokens.Encoder(BPE)
    assert own_ids(enc, texts) == want and own_ids(enc, texts) == want
    monkeypatch.setattr(pretokens.common, "mix64", lambda x: x & np.uint64(7))  # units share hashes
    enc = pretokens.Encoder(BPE)
    assert own_ids(enc, texts) == want and own_ids(enc, texts) == want


def test_a_word_between_marks_is_asked_for_once(monkeypatch):
    from strandloom.llm.pretokens import Encoder

    enc, asked = Encoder(BPE), []
    ask = enc.asked
    monkeypatch.setattr(enc, "asked", lambda units: asked.extend(units) or ask(units))
    own_ids(enc, ["of (alpha) alpha, [alpha] alpha.\nof\nalpha 1alpha; of, alpha"])
    assert len(asked) == len(set(asked)) and sum(b"alpha" in x for x in asked) == 2  # with a space before it, and without


def test_remembered_texts_take_a_small_part_of_the_library_s_time(tokenizer):
    from time import process_time

    from strandloom.llm import token_store

    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(w + r.choice(["", "", "", ",", ".", ".\n" + w]) for w in r.choices(words, k=300)) for _ in range(500)]
    token_store.encode(texts, BPE, 2)
    shares = []
    for _ in range(3):
        start = process_time()
        tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        between = process_time()
        token_store.encode(texts, BPE, 2)
        shares.append((process_time() - between) / (between - start))
    assert min(shares) < 0.15, shares


def test_token_counts(spark, tokenizer):
    rows = odd_rows()
    got = sorted(map(tuple, token_counts(frame(spark, rows), BPE, limit=100).collect()), key=repr)
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted(((i, len((t or "").encode()), c, c > 100) for (i, t), c in zip(rows, n, strict=True)), key=repr)
    assert token_counts(frame(spark, []), BPE).count() == 0


def test_token_store(spark, tokenizer, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(ODD)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "t")
    write_tokens(frame(spark, rows), path, BPE, end_id=2, row_group_bytes=1 << 16, page_rows=4)
    got = [tuple(r) for r in digests(read_tokens(spark, path)).orderBy("doc_id").collect()]
    start, want = 0, []
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    some = read_tokens(spark, path, 6, 12, ids=False)
    assert sorted(r["doc_id"] for r in some.collect()) == [6, 9, 12] and some.columns == ["doc_id", "start", "n_tokens"]
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    columns = [pq.ParquetFile(f).metadata.row_group(0) for f in files if pq.ParquetFile(f).metadata.num_row_groups]
    names = {columns[0].column(j).path_in_schema: columns[0].column(j) for j in range(columns[0].num_columns)}
    assert "DELTA_BINARY_PACKED" in names["doc_id"].encodings and names["doc_id"].has_offset_index and names["doc_id"].has_column_index
    assert any("DICTIONARY" in e for c in columns for j in range(c.num_columns) if "ids" in c.column(j).path_in_schema for e in c.column(j).encodings)
    write_tokens(frame(spark, []), str(tmp_path / "e"), BPE)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


# --- pieces ---


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(PIECES)
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choices(" a▁\n\téñ日½th e,.x   ", k=rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        ids = m.encode(t)
        assert ids == lib.encode(t) and m.decode(ids) == lib.decode(ids)
    rows = odd_rows()
    coded = encode_pieces(frame(spark, rows), PIECES)
    assert sorted([(r["doc_id"], list(r["ids"])) for r in coded.collect()], key=repr) == sorted([(i, lib.encode(t or "")) for i, t in rows], key=repr)
    back = sorted([r["text"] for r in decode_pieces(coded, PIECES).collect()])
    assert back == sorted((t or "").replace("▁", " ") for _, t in rows)
    assert all(r["round_trip"] for r in round_trips(frame(spark, rows), PIECES).collect())
    assert encode_pieces(frame(spark, []), PIECES).count() == 0


# --- personal data ---


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choices("12.+-() @a4b[]é", k=rng.randint(0, 40)))
        assert [(k, *s) for k, v in pii.base_spans(t).items() for s in v] == pii.brute_force(t)
    long = "1" * 200_000 + " " + "a" * 200_000 + "@" + "b." * 100_000 + " +1" + "(" * 100_000
    assert [(k, *s) for k, v in pii.base_spans(long).items() for s in v] == [("email", 200001, 200001 + 200_000 + 1 + 199_999)]


def test_personal_data(spark):
    rows = [(i, f"write to mail{i}@x{i}.example.com or call +1 (988) 555-{1000 + i} now") for i in range(40)]
    rows += [(100 + i, f"please call us by phone (988) 555-{2000 + i}") for i in range(10)]
    rows += [(200 + i, "plain words without any of it, in 2024 and 1999") for i in range(10)] + [(300, None), (301, "")]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(docs, pii.fit(docs))).collect()}
    assert all(found[i]["n_email"] == found[i]["n_phone"] == 1 for i in range(40))
    assert all(found[100 + i]["spans"].startswith("phone:24:") and found[100 + i]["n_phone"] == 0 for i in range(10))
    assert all(found[i]["spans"] == "" for i in [*range(200, 210), 300, 301])
    assert pii.find_personal_data(frame(spark, []), pii.fit(frame(spark, []))).count() == 0


def test_label_model_recovers_reliabilities():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.4
    right = [0.9, 0.8, 0.75, 0.7, 0.65]
    votes = np.stack([np.where(rng.random(len(y)) < r, y, ~y) * 2 - 1 for r in right], 1)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = pii.expectation_maximisation(patterns, n.astype(float))[at.ravel()]
    assert ((p > 0.5) == y).mean() > 0.9


# --- quality ---


def test_quality(spark):
    rng = random.Random(4)
    good = [(i, words(rng, 80, 400)) for i in range(150)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(400)}!!" for _ in range(80)) if i % 2 else f"w{i} " * 80) for i in range(150)]
    docs = frame(spark, [*good, *bad, (5000, ""), (5001, None)])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(out) == 302 and all(0 <= r["score"] <= 1 for r in out.values()) and out[0]["lang"] == "x"
    held = [i for i in out if i < 5000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == (i < 1000) for i in held]) > 0.95
    none = quality.fit(frame(spark, []), labels.limit(0))
    assert quality.score(frame(spark, []), none).count() == 0


# --- lines ---


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(120)] + [(200, None), (201, ""), (202, "a\n" * 50)]
    rows += [(3, rows[3][1]), (4, rows[7][1])]
    got = sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(frame(spark, rows).drop("n")).collect()], key=repr)
    single = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1]
    want = line_dedup.brute_force(rows)
    assert [g for g in got if g[0] in {r[0] for r in single}] == sorted([w for w in want if w[0] in {r[0] for r in single}], key=repr)
    assert len(got) == len(rows) and line_dedup.dedup_lines(frame(spark, []).drop("n")).count() == 0
    nulls = line_dedup.dedup_lines(frame(spark, [(None, "a\nb\nc"), (1, "a\nb\nc\nd")]).drop("n")).collect()
    assert {(r["doc_id"], r["text"]) for r in nulls} == {(None, "a\nb\nc"), (1, "d")}


# --- benchmarks ---


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(0, 25), 30)) for i in range(20)] + [(20, None), (None, "w1 w2 w3"), (21, "W1, w2"), (3, words(rng, 14))]
    rows = []
    for i in range(80):
        t = words(rng, rng.randint(0, 30), 30)
        x = (items[rng.randrange(20)][1] or "").split()
        a = rng.randint(0, 8)
        rows.append((i, t + " " + " ".join(x[a : a + rng.randint(0, 15)]).upper() + ". " + words(rng, 5, 30)))
    rows += [(100, None), (101, ""), (5, "w1 w2"), (102, "é日 " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()])
    assert got == sorted(decontaminate.brute_force(rows, items)) and any(g[2] for g in got)
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    none = decontaminate.find_leaks(frame(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["n_hit"] for r in none)


# --- Jaccard ---


@pytest.mark.parametrize("n, percent, small", [(3, 90, False), (5, 80, True), (2, 80, False), (2, 80, True)])
def test_jaccard(spark, monkeypatch, n, percent, small):
    """Random texts with copies, near copies in chains, and a shared passage; also with many blocks, ranges and pieces."""
    if small:
        for name, size in (("BLOCK_TOKENS", 200), ("RANGE_TOKENS", 100), ("UNION_TOKENS", 4)):
            monkeypatch.setattr(jaccard, name, size)
    rng = random.Random(7 + n)
    passage = words(rng, 30)
    rows = [(i, words(rng, rng.randint(0, 50), 200)) for i in range(60)]
    for i in range(60, 140):
        w = (rows[rng.randrange(len(rows))][1] or "").split()
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(i, passage + " " + words(rng, rng.randint(0, 8), 300)) for i in range(140, 170)]
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "one two"), (3, rows[50][1]), (205, "\t \n")]
    got = sorted([tuple(r) for r in jaccard.jaccard_join(frame(spark, rows), n, percent).collect()])
    assert got == sorted(jaccard.brute_force(rows, n, percent))
    assert len({c for _, _, c in got}) < len(rows) - 30


def test_jaccard_edges(spark):
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0
    got = jaccard.jaccard_join(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (1, 1), (2, 1)}
    kept = jaccard.keep_first(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "")]))
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 3}


def test_groups_are_opened(spark):
    """Texts that share a token but not with the pivot are linked through the token-group matrix."""
    base = [f"a{i}" for i in range(40)]
    near = base[:20] + [f"b{i}" for i in range(20)]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join([*near[:-1], "c"])), (3, " ".join([*base[:-1], "d"]))]
    assert sorted(map(tuple, jaccard.jaccard_join(frame(spark, rows), 1, 80).select("doc_id", "component_id").collect())) == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_connected(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(30)]
    got = dict(map(tuple, common.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    assert got == {x: c for x, c in low.items() if x != c}


# --- suffixes ---


def test_loser_tree():
    rng = random.Random(9)
    for _ in range(150):
        runs = [sorted((bytes(rng.choices(b"ab", k=rng.randint(0, 8))), b"p") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        out = list(suffix_dedup.merge([suffix_dedup.decoded(suffix_dedup.front_code(r)) for r in runs]))
        assert [s for s, _, _ in out] == sorted(s for r in runs for s, _ in r)
        assert all(b[1] == suffix_dedup.lcp(a[0], b[0]) for a, b in zip(out, out[1:], strict=False))


@pytest.mark.parametrize("seed, grams, contexts", [(1, 1 << 22, 100_000), (2, 0, 100_000), (3, 1 << 22, 1)])
def test_suffix_dedup(spark, monkeypatch, seed, grams, contexts):
    monkeypatch.setattr(suffix_dedup, "MOST_GRAMS", grams)
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", contexts)
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choices("abcé", k=n))

    passages = [text(rng.randint(20, 120)) for _ in range(6)]
    rows = []
    for i in range(40):
        t = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += p[a : a + rng.randint(0, len(p))] + text(rng.choice([0, 1, 5, 40]))
        rows.append((i, t))
    rows += [(50, ""), (51, None), (52, "ab" * 40), (53, "a" * 43), (54, rows[3][1]), (3, rows[3][1]), (None, rows[7][1])]
    got = sorted([(r["n_bytes"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), len(r["spans"]) // 2, r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, rows), span=40, gram=8).collect()])
    assert got == sorted(suffix_dedup.brute_force([t for _, t in rows], 40))
    assert suffix_dedup.remove_repeats(frame(spark, []), span=40, gram=8).count() == 0


# --- sound ---


def test_audio(spark):
    """Shifted and noisy excerpts of recordings are found where brute force finds them."""
    rng = np.random.default_rng(10)
    t = np.arange(24_000) / audio.RATE

    def song():
        notes = np.repeat(rng.choice([220, 262, 330, 392, 440, 523, 660, 880, 1047], 60), len(t) // 60)
        return np.sin(2 * np.pi * np.cumsum(notes) / audio.RATE) + 0.5 * np.sin(4 * np.pi * np.cumsum(notes) / audio.RATE)

    def pcm(x):
        return bytes(np.clip(x / 2 * 100 + 128, 0, 255).astype(np.uint8))

    rows = []
    for j in range(12):
        s = song()
        rows.append((j * 50, pcm(s)))
        for e in range(4):
            a = int(rng.integers(0, 8000))
            rows.append((j * 50 + e + 1, pcm(s[a : a + 14_000] + rng.normal(0, 0.01, 14_000))))
    rows += [(3001, b""), (3002, None), (3003, b"x" * 10), (3004, bytes([128]) * 9000), (None, rows[0][1]), (3005, rows[0][1])]
    media = spark.createDataFrame(rows, "id long, sound binary").withColumn("i", F.lit(1)).repartition(3)
    prints = audio.fingerprints(media)
    found = audio.align(prints).collect()
    got = {(r["query"], r["recording"]) for r in found}
    by_id = {r["id"]: np.array(r["fingerprint"], np.int32) for r in prints.collect() if r["id"] is not None and r["fingerprint"]}
    want = {(q, r) for q, r in audio.brute_force(by_id) if r != 3005}
    assert len(want) >= 20 and len(got & want) >= 0.9 * len(want) and got <= want
    assert all(r["copies"] == (2 if r["recording"] == 0 else 1) for r in found)
    assert audio.align(audio.fingerprints(media.limit(0))).count() == 0


def test_integral_image_sums_rectangles():
    x = np.random.default_rng(1).random((30, 12)).astype(np.float32)
    v = audio.filtered(x)
    kind, c, h, w = audio.FILTERS[0]
    assert kind == 0 and np.isclose(v[4, 0], np.log1p(x[4 : 4 + w, c : c + h].sum()), atol=1e-5)
