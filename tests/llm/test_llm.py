"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from readmill.llm import gru, knn, language, lm_scoring, minhash, packing, piece_codec, quality, simhash, token_counts, toxicity
from readmill.llm.components import components
from readmill.llm.tokens import ChunkEncoder

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, sequence_id string, component_id bigint"
DATA = "/root/testdata/sf0.001"


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    words = "the of and mill read loom river stone grain water wheel slow turn night light early".split()
    return " ".join(rng.choice(words, n)) + "."


TEXTS = [
    prose(1), prose(2), prose(1), prose(1).replace("the", "The"), None, "", " ", "one", "one two", "\n\nx  y\n z \n", "don't <|endoftext|> stop", prose(3, 9000), "é ñ 中文 🙂 " * 4,
    "x" * 700 + " " + "ab" * 300, "1234 5678", prose(4) + " extra", prose(4), "\tTab\x0bvt\x1cfs em ▁mark", "",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1.0, "x", 7) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "s", 0, 1.0, "x", 7), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 6, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_chunks_are_what_the_library_gives(tokenizer):
    texts = [t or "" for t in TEXTS]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(JSON, "ids").ids(texts)] == want
    assert ChunkEncoder(JSON, "length").lengths(texts) == list(map(len, want))
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ChunkEncoder(MODEL, "length").lengths(texts) == [len(model.encode(t)) for t in texts]


def test_other_json_files_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for t in TEXTS] + ["hello world, and  more.\nnext"]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(path, "ids").ids(texts)] == want
    assert ChunkEncoder(path, "length").lengths(texts) == list(map(len, want))


def test_words_with_tails_and_lines(tokenizer):
    texts = ["One, two.\nthree,\n\nfour. 5. six., ., . don't, é, ñ.\n x\ny \nz.", "a.", "a. a. a, a", ",", "\n.\n", "a.<|endoftext|>. b.", "x\n", "\r\nq.\r\nr,", "word." * 40 + " w."]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    one = ChunkEncoder(JSON, "ids")
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in one.ids(texts)] == want
    assert ChunkEncoder(JSON, "length").lengths(texts) == list(map(len, want))


def test_words_with_several_signs_share_a_stem(tokenizer, monkeypatch):
    texts = ["stemword stemword. stemword!! stemword*** stemword's stemword' stemword%%%% é!? \u01c5?! ²) x<|endoftext|> y<| z|>. q\u00a0?! \tw!", "stemword... stemword\n(stemword) 7.) a\u0301!! \u4e2d\u6587!!"]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    one, given = ChunkEncoder(JSON, "ids"), []
    encode = one.encode_words
    monkeypatch.setattr(one, "encode_words", lambda words: given.extend(words) or encode(words))
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in one.ids(texts)] == want
    assert ChunkEncoder(JSON, "length").lengths(texts) == list(map(len, want))
    assert given.count("stemword") == 1 and not {"stemword!!", "stemword***", "stemword'"} & set(given)


def test_long_texts_are_cut_safely(tokenizer, monkeypatch):
    monkeypatch.setattr("readmill.llm.tokens.SEGMENT_CHARS", 50)
    monkeypatch.setattr("readmill.llm.tokens.segments.__defaults__", (50,))
    monkeypatch.setattr("readmill.llm.tokens.MEMO_ENTRIES", 5)
    texts = [t or "" for t in TEXTS]
    assert ChunkEncoder(JSON, "length").lengths(texts) == [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, empty, tokenizer):
    got = token_counts.token_counts(docs, JSON).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.token_counts(empty, JSON).count() == 0


# -- 2, packing


@pytest.mark.parametrize("window", [16, 2048])
def test_packing_places_every_id_once(docs, empty, tokenizer, window):
    got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), JSON, window=window).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    starts = Counter()
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] > 0 and starts[r["doc_id"]] == r["start"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        starts[r["doc_id"]] += r["length"]
    assert starts == {k: len(v) for k, v in ids.items()}
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= window and n & (n - 1) == 0 for n in used.values())
    assert packing.pack(empty, JSON).count() == 0


def test_sum_of_squares_takes_the_best_level():
    rng = np.random.default_rng(0)
    p = packing.SumOfSquares(256, 0)
    assert p.grain == 8
    for k in range(600):
        r = int(rng.integers(1, 256))
        before = Counter({i: n for i, n in enumerate(p.count) if n})
        tops = {-1: 0} | {i: level[-1][0] for i, level in enumerate(p.open) if level}
        costs = {}
        for level, fill in tops.items():
            after = before.copy()
            after[level] -= level >= 0
            if fill + r < 256:
                after[(fill + r) // 8] += 1
            elif fill + r >= 256 + 8:
                continue
            costs[level] = sum(n * n for n in after.values())
        got = p.level_for(r)
        assert costs[got] == min(costs.values()) and got == max(i for i, c in costs.items() if c == costs[got])
        p.add(k, np.zeros(r, "<u4").tobytes())
        assert p.count == [len(level) for level in p.open]


def test_nearly_all_windows_come_from_the_level_array(spark):
    lengths = [r[0] for r in token_counts.token_counts(real(spark, "documents"), JSON).select("n_tokens").collect()]
    last, flushed, tails = 0, 0, []
    for task in range(8):
        p = packing.SumOfSquares(2048, last)
        for n in lengths[task::8]:
            p.add(0, bytes(4 * (n + 1)))
        last, tails = p.next_id, tails + p.left()
    p = packing.SumOfSquares(2048, last)
    for piece in tails:
        p.place(piece)
    flushed = p.finish()
    assert flushed < 0.01 * p.next_id and sum(lengths) + len(lengths) <= 2048 * p.next_id


# -- 1, pieces


def test_pieces_are_what_the_library_gives():
    model, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.Codec(MODEL)
    texts = [t or "" for t in TEXTS] + ["aaaa" * 100, "<s> </s>", "a\n", "\n", "  lead", "trail  "]
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert got == model.encode(texts)
    assert [codec.decode(np.array(x, "<u4").tobytes()) for x in got] == model.decode(got)


@pytest.mark.parametrize("index_chars", [1 << 18, 40])
def test_long_chunks_go_through_the_suffix_array(monkeypatch, index_chars):
    monkeypatch.setattr(piece_codec, "INDEX_CHARS", index_chars)
    model, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.Codec(MODEL)
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDE0123456789/+=é中文的")
    junk = ["".join(rng.choice(letters, n)) for n in (129, 700, 5000)]
    longs = ["x" * 300, "the" * 200, "中文的" * 150, " " * 400, "internationalization" * 30, *junk]
    want = model.encode(longs)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(longs)] == want  # a batch of long chunks alone
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode([" ".join(longs)])] == model.encode([" ".join(longs)])
    assert list(codec.encode([])) == [] and list(codec.encode(["", ""])) == [b"", b""]


def test_edges_are_all_occurrences():
    codec = piece_codec.Codec(MODEL)
    text = "▁the▁there▁in\0▁inner▁▁▁▁x"
    letters = codec.letter[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    where, piece = codec.edges(letters)
    want = sorted((i, p) for p in codec.rank for i in range(len(text)) if text.startswith(p, i))
    names = list(codec.rank)
    assert sorted((int(i), names[k]) for i, k in zip(where, piece, strict=True)) == want and (np.diff(where) >= 0).all()


@pytest.mark.parametrize("index_chars", [50, 1000])
def test_unbroken_texts_are_cut_where_no_edge_goes_over(monkeypatch, index_chars):
    monkeypatch.setattr(piece_codec, "INDEX_CHARS", index_chars)
    rng = np.random.default_rng(3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["".join(rng.choice(list("etaoinshrdluQXZ09é中"), 4000)), "the" * 900, "x" * 3000, prose(7, 400).replace(" ", ""), "中文字符" * 500 + "é" * 700]
    one = piece_codec.Codec(MODEL)
    for text, ids in zip(texts, one.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    assert len(list(one._parts(texts[0]))) > 2 and all("".join(one._parts(t)) == t for t in texts)


def test_memory_of_an_unbroken_text_is_bounded(tmp_path):
    """Three million characters without a space: less memory than the 165 MB a million of tables for the whole text."""
    code = (
        "import resource, sys, numpy as np, sentencepiece\nfrom readmill.llm import piece_codec\n"
        f"text = ''.join(np.random.default_rng(1).choice(list('etaoinshrdluQXZ0123456789+/'), 3_000_000)); one = piece_codec.Codec({MODEL!r}); list(one.encode(['warm up']))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; ids = list(one.encode([text]))[0]\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
        f"print(np.frombuffer(ids, '<u4').tolist() == sentencepiece.SentencePieceProcessor(model_file={MODEL!r}).encode(text))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, timeout=600)
    used, same = out.stdout.split()
    assert same == "True" and int(used) < 300


def test_piece_round_trip(docs, empty):
    got = piece_codec.round_trip(docs, MODEL).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r["doc_id"] for r in got if not r["same"]} == {i for i, t in enumerate(TEXTS) if t and "▁" in t}
    back = docs.select("doc_id", "text", piece_codec.decode(piece_codec.encode(F.col("text"), MODEL), MODEL).alias("back")).collect()
    assert all((r["text"] or "").replace("▁", " ") == r["back"] for r in back)
    assert piece_codec.round_trip(empty, MODEL).count() == 0


# -- 10, SimHash


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = {i: plain_fingerprint(t or "") for i, t in enumerate(TEXTS)}
    want = plain_components(fps)
    assert len(got) == len(TEXTS) + 1
    assert all((r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]]) for r in got)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("home_rows", [4096, 3])
def test_links_of_crowded_fingerprints(spark, monkeypatch, home_rows):
    monkeypatch.setattr(simhash, "HOME_ROWS", home_rows)
    rng = np.random.default_rng(5)
    fps = set(map(int, rng.integers(0, 1 << 64, 300, np.uint64)))
    for center in list(fps)[:6]:
        for _ in range(60):
            x = center
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1, 2}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3))
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 or ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())
    roots = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    want = plain_components(dict(zip(signed, (x & (1 << 64) - 1 for x in signed), strict=True)))
    assert {i: r for i, r in want.items() if list(want.values()).count(r) > 1} == roots


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


# -- 5, MinHash


def test_fingerprints(docs, empty):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in minhash.fingerprints(rows).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    sig = lambda t: minhash.signature(minhash.shingle_hashes(minhash.word_hashes(t.encode())))
    for i, text in enumerate(TEXTS):
        text, after = text or "", TEXTS[i - 1 if i else len(TEXTS) - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (minhash.text_form(sig(text)), minhash.text_form(sig(edited)))
        assert r["near_edited"] == minhash.likeness(sig(text), sig(edited)) and r["near_next"] == minhash.likeness(sig(text), sig(after))
    assert minhash.fingerprints(docs).count() == len(TEXTS) + 1
    assert minhash.fingerprints(empty).count() == 0
    one = minhash.fingerprints(rows.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len(TEXTS[1])


@pytest.mark.parametrize("block_rows", [2048, 3])
def test_near_copies_against_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, " \n")]
    for group in range(6):
        base = list(rng.choice(words, 150))
        for k in range(9):  # edits add up, so that the ends of a chain are unlike
            rows.append((group * 20 + k, " ".join(base)))
            for _ in range(1 + group):
                base[int(rng.integers(0, 150))] = f"x{len(rows)}"
        rows += [(group * 20 + 15, rows[-1][1].upper()), (group * 20 + 16, " ".join(rng.choice(words, 150)))]
    rows += [(0, rows[3][1])]
    shingles = {}
    for i, t in rows:
        w = (t or "").lower().split()
        shingles.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in shingles:
        for j in shingles:
            if i < j and any((len(a & b) / len(a | b) if a | b else 1) >= 0.8 for a in shingles[i] for b in shingles[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([*rows, (None, rows[3][1])], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_copies(docs).collect()}
    assert {i: got.get(i, i) for i in root} == {i: find(i) for i in root}
    assert len(set(got.values())) < len(got) and {r["doc_id"]: r["class_id"] for r in minhash.fingerprints(docs).collect()} == {i: find(i) for i in root}


# -- 9, neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12))
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 12), (402, [float("nan")] * 12), (403, [None] * 12), (404, [1e30] * 12), (None, [1.0] * 12), (500, [1.0, 2.0])]
    got = knn.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 10).collect()
    everything = {i: v for i, v in enumerate(x)} | {404: np.full(12, 1e30)}
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in everything if i % 20 == 0}
    for i, near in found.items():
        want = sorted((float(np.sqrt(((everything[i] - v) ** 2).sum())), j) for j, v in everything.items() if j != i)[:10]
        assert [(k, j) for k, j, _ in sorted(near)] == [(k + 1, j) for k, (_, j) in enumerate(want)]
        assert np.allclose([s for _, _, s in sorted(near)], [s for s, _ in want], rtol=1e-12)
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert knn.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [1.5, 0.0]), (1, [9.0, 0.0]), (2, [5.25, 0.0])]
    got = knn.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 2, 0.25), (0, 1, 0.5), (0, 1, 3.5)]


def test_nearest_of_huge_and_tiny_values(spark):
    rng = np.random.default_rng(5)
    x = [rng.normal(size=6) * scale for scale in (1e200, 1e307, 1.0, 1e-200) for _ in range(40)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in knn.nearest(rows, F.col("vec_id") % 10 == 0, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert sorted(got) == list(range(0, 160, 10))
    for i, near in got.items():
        want = sorted((math.dist(x[i], v), j) for j, v in enumerate(x) if j != i)[:10]
        assert [near[k + 1][0] for k in range(10)] == pytest.approx([d for d, _ in want], rel=1e-12, abs=0)
        if i < 80 or i >= 120:
            assert [near[k + 1][1] for k in range(10)] == [j for _, j in want]


# -- 7, toxicity; 3, language; 4, quality


def real(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")


def test_toxicity_held_out(spark):
    rows = toxicity.toxicity(real(spark, "documents"), real(spark, "labels")).join(real(spark, "labels"), "doc_id").where("held_out").toPandas()
    rank = rows["score"].rank()
    pos = rows["toxic"] == 1
    auc = (rank[pos].mean() - (pos.sum() + 1) / 2) / (~pos).sum()
    assert auc > 0.93 and (rows["predicted"][~pos]).mean() < 0.03 and rows["predicted"][pos].mean() > 0.5


def plain_buckets(word):
    """Buckets of a word's subwords, one by one."""
    full = (1 << 64) - 1
    mixed = []
    for c in f"<{word}>":
        x = (ord(c) + 1) * 0x9E3779B97F4A7C15 & full
        mixed.append(x ^ x >> 29)
    whole = sum(x * (k + 1) ** 3 for k, x in enumerate(mixed)) & full
    out = [(whole * 0xD6E8FEB86659FD93 & full) >> 64 - toxicity.BITS]
    for n in toxicity.SIZES:
        for i in range(len(mixed) - n + 1):
            h = 0
            for x in mixed[i : i + n]:
                h = (h * 0x100000001B3 + x) & full
            out.append(((h + n) * 0xD6E8FEB86659FD93 & full) >> 64 - toxicity.BITS)
    return out


def test_toxicity_scores_against_plain_loops(spark, docs):
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.3)
    texts = [*TEXTS, "bad, BAD (bad) worse!", "bad " * 400_000]  # the last one is longer than a group
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in rows.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect():
        words = dict.fromkeys((texts[r["doc_id"]] or "").lower().split())
        buckets = [b for w in words for b in plain_buckets(toxicity.EDGE.sub("", w))]
        x = sum(float(model.weight[b]) for b in buckets) / (len(buckets) + toxicity.PRIOR) + model.bias
        assert r["s"] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-6)


def test_toxicity_fit_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, labels: seen.append((bags, labels)) or toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0))
    rows = spark.createDataFrame([(i, prose(i, 20 + i)) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)] + [(3, 0)], "doc_id bigint, toxic int")
    toxicity.fit_on(rows, labels, F.lit(False), fit_rows=15, fit_subwords=1500)
    toxicity.fit_on(rows, labels, F.lit(False), fit_rows=15, fit_subwords=10**6)
    (few, of_few), (bags, of_all) = seen
    assert sum(len(b) for b, _ in few) <= 1500 and abs(int(of_few.sum()) * 2 - len(few)) <= 2
    assert len(bags) == 30 and of_all.sum() == 15


def test_toxicity_edges(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (2, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_language_held_out(spark):
    docs = real(spark, "documents")
    rows = language.languages(docs, MODEL).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.98 and rows["score"].between(0, 1).all()


def test_language_edges(docs, empty):
    got = language.languages(docs, MODEL).collect()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert len(got) == len(TEXTS) + 2
    assert und == {i for i, t in enumerate(TEXTS) if not any(map(str.isalpha, t or ""))}
    assert language.languages(empty, MODEL).count() == 0


def test_language_is_learned_of_rare_ones_and_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    rows = [(i, " ".join(word("aeiounrst" if i % 100 else "wxyzkjqv") for _ in range(20)), "xx" if i % 100 else "yy") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_on(docs, F.lit(False), MODEL, fit_rows=50)
    assert model.languages == ["xx", "yy"]
    found = lambda: {r["doc_id"]: r["p"] for r in docs.select("doc_id", language.predict(F.col("text"), model).alias("p")).collect()}
    whole = found()
    assert all(whole[i]["lang_pred"] == lang for i, _, lang in rows)
    monkeypatch.setattr("readmill.llm.words.groups.__defaults__", (100,))
    assert {i: (p["lang_pred"], round(p["score"], 6)) for i, p in found().items()} == {i: (p["lang_pred"], round(p["score"], 6)) for i, p in whole.items()}


def test_forward_sums_all_segmentations():
    vocabulary = language.pieces(MODEL)
    number = {"t": 0, "h": 1, "e": 2}
    rng = np.random.default_rng(0)
    prob = rng.uniform(0.1, 1, (len(vocabulary.prior) + 1, 2))
    import sentencepiece.sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    texts = list(dict.fromkeys(p.piece.lower() for p in model.pieces if p.type == 1))
    number = {t: i for i, t in enumerate(texts)}

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            p = word[:n]
            if p in number:
                out += prob[number[p], k] * total(word[n:], k)
            elif n == 1:
                out += prob[-1, k] * total(word[n:], k)
        return out

    words = ["▁the", "▁there", "ab☃c", "x"]
    edges = vocabulary.edges(words)
    alpha = language.forward(edges, prob)
    for i, w in enumerate(words):
        assert np.allclose(alpha[i, len(w)], [total(w, 0), total(w, 1)])
    back = language.backward(edges, prob[:, 0])
    assert np.allclose(back[:, 0], [total(w, 0) for w in words])


def plain_grams(text):
    """Buckets of words and of pairs of neighbouring words, one by one."""
    words = [xxhash.xxh64_intdigest(w, 4) for w in re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    return [x % 20_011 for x in words] + [(x * 0x9E3779B97F4A7C15 + y) % (1 << 64) % 20_011 for x, y in zip(words, words[1:])]


def test_quality_resampling(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(12)], "doc_id bigint, quality int")
    got = quality.resample(docs, labels).collect()
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    limit = keys[-(-len(got) // 2) - 1]
    assert len(got) == len(TEXTS) + 2 and all(r["selected"] == (r["gumbel_key"] >= limit) for r in got)
    raw, target = Counter(), Counter()
    for t in [*TEXTS, TEXTS[0], "no id"]:
        raw.update(plain_grams(t))
    for i in (i for i in range(3) if zlib.crc32(str(i).encode()) % 5 != 3):
        target.update(plain_grams(TEXTS[i]) * (1 + (i == 0)))  # row 0 is there twice
    share = lambda c, k: (c[k] + 1) / (c.total() + 20_011)
    for r in got:
        if r["doc_id"] is not None:
            own = plain_grams(TEXTS[r["doc_id"]])
            want = sum(math.log(share(target, k)) - math.log(share(raw, k)) for k in own) if target else 0.0
            assert r["log_weight"] == pytest.approx(want) and r["n_grams"] == len(own)
    assert quality.resample(empty, labels).count() == 0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "LAST_ROWS", 10)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=500) ** 3, np.full(200, 0.25)])
    keys = spark.createDataFrame([(float(v),) for v in x], "k double")
    for k in (1, 17, 250, 420, 699, 700):
        assert quality.kth_largest(keys, "k", k) == np.sort(x)[-k]


# -- 8, language model


def test_lm_scores(docs, empty):
    got = lm_scoring.scores(docs).collect()
    rows = [(i, t or "") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "no id")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*t.encode().lower().split(), None]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        own = tokens(text[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["score"] < 0
    assert lm_scoring.scores(empty).count() == 0


def small_vocabulary():
    words = sorted((f"w{i}".encode() for i in range(700)), key=lambda w: (-(700 - int(w[1:])), w))
    pairs = sorted([(-(700 - int(w[1:])), w) for w in words] + [(-50, b"")])
    return lm_scoring.Vocabulary([w for _, w in pairs], -np.array([c for c, _ in pairs]), 10**6, 1200, np.array([9000.0, 500, 20, 0]), np.array([300.0, 150, 9, 0]))


def test_lm_is_a_distribution():
    v = small_vocabulary()
    p = gru.start(lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS + lm_scoring.END_ROWS, v.class_logs, v.word_logs)
    rng = np.random.default_rng(0)
    p["wc"] = rng.normal(size=p["wc"].shape).astype(np.float32)
    h = np.tile(rng.normal(size=(1, gru.WIDTH)).astype(np.float32), (len(v.words), 1))
    head = np.exp(gru.outputs(p, h, v.cls.astype(np.int64), v.place.astype(np.int64)).astype(float) + v.inner).sum()
    rare = np.exp(gru.outputs(p, h[:4], np.arange(31, 35), np.full(4, -1)).astype(float)).sum()
    assert head + rare == pytest.approx(1, abs=1e-4)


def test_lm_state_goes_over_whole_texts_and_batches():
    v = small_vocabulary()
    rng = np.random.default_rng(1)
    p = gru.start(lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS + lm_scoring.END_ROWS, v.class_logs, v.word_logs)
    p = {k: x + rng.normal(0, 0.2, x.shape).astype(np.float32) for k, x in p.items()}
    texts = [v.read(" ".join(f"w{i}" for i in rng.integers(0, 900, n)))[0] for n in (0, 1, 5, 40, 333, 64)]
    got = gru.log_probabilities(p, texts, most=3, steps=7)
    for x, s in zip(texts, got, strict=True):
        before, _, _ = gru.window(p, x.row[:, None], np.arange(len(x.row))[:, None] == 0, np.zeros((1, gru.WIDTH), np.float32))
        assert gru.outputs(p, before[:, 0], x.cls.astype(np.int64), x.place.astype(np.int64)).sum() == pytest.approx(s, rel=1e-4)


def test_lm_slopes():
    v = small_vocabulary()
    rng = np.random.default_rng(3)
    p = gru.start(lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS + lm_scoring.END_ROWS, v.class_logs, v.word_logs)
    p = {k: x.astype(np.float64) + rng.normal(0, 0.1, x.shape) for k, x in p.items()}
    x = v.read(" ".join(f"w{i}" for i in rng.integers(0, 900, 29)))[0]
    row, cls, place = (a.astype(np.int64).reshape(10, 3) for a in (x.row, x.cls, x.place))
    fresh = np.zeros((10, 3), bool)
    fresh[0] = fresh[4, 1] = True
    h, used = np.zeros((3, gru.WIDTH)), np.ones((10, 3), bool)

    def loss():
        before, _, _ = gru.window(p, row, fresh, h)
        return -gru.outputs(p, before.reshape(-1, gru.WIDTH).astype(np.float64), cls.ravel(), place.ravel()).mean()

    g, _ = gru.gradients(p, row, fresh, cls, place, used, h)
    for name in p:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        p[name][at] += 1e-3
        up = loss()
        p[name][at] -= 2e-3
        down = loss()
        p[name][at] += 1e-3
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-5), name


def test_lm_learns_from_every_token_of_uneven_texts():
    v = small_vocabulary()
    p = gru.start(lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS + lm_scoring.END_ROWS, v.class_logs, v.word_logs)
    # the longest text alone has w699, far beyond the median length
    texts = [v.read(t)[0] for t in ["w1 w2 w3"] * 5 + ["w4 w5 " * 300 + "w699 " * 200]]
    row = v.row[v.index[b"w699"]]
    got = gru.train(p, texts)
    assert not np.array_equal(got["emb"][row], p["emb"][row])
    assert gru.log_probabilities(got, texts[-1:])[0] > gru.log_probabilities(p, texts[-1:])[0]


def test_lm_windows_of_the_last_streams_get_longer(monkeypatch):
    v, windows, gradients = small_vocabulary(), [], gru.gradients
    p = gru.start(lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS + lm_scoring.END_ROWS, v.class_logs, v.word_logs)
    texts = [v.read(t)[0] for t in ["w1 w2 w3 " * 10] * 200 + ["w4 w5 " * 4000]]
    monkeypatch.setattr(gru, "gradients", lambda p, row, fresh, cls, place, used, h: windows.append((used.size, used.sum())) or gradients(p, row, fresh, cls, place, used, h))
    gru.train(p, texts)
    assert sum(n for _, n in windows) == sum(len(x.row) for x in texts)
    assert len(windows) < 20 and max(n for n, _ in windows) <= gru.STREAMS * gru.STEPS


def test_lm_slopes_and_outputs_where_exponentials_need_a_shift():
    v = small_vocabulary()
    rng = np.random.default_rng(6)
    p = gru.start(lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS + lm_scoring.END_ROWS, v.class_logs, v.word_logs)
    p = {k: x + rng.normal(0, 0.2, x.shape).astype(np.float32) for k, x in p.items()}
    x = v.read(" ".join(f"w{i}" for i in rng.integers(0, 900, 47)))[0]
    at = [a.reshape(16, 3) for a in (x.row, np.zeros(48, bool), x.cls, x.place, np.arange(48) < 40)]
    h = np.zeros((3, gru.WIDTH), np.float32)
    shifted = {**p, "bc": p["bc"] + np.float32(500), "bw": p["bw"] - np.float32(500)}  # no softmax changes by that
    for name, g in gru.gradients(p, *at, h)[0].items():
        np.testing.assert_allclose(gru.gradients(shifted, *at, h)[0][name], g, rtol=0.02, atol=2e-5, err_msg=name)
    some = rng.uniform(-1, 1, (48, gru.WIDTH)).astype(np.float32)
    np.testing.assert_allclose(gru.outputs(shifted, some, x.cls, x.place), gru.outputs(p, some, x.cls, x.place), rtol=1e-3, atol=1e-3)


def test_lm_network_learns_from_every_training_text(spark, monkeypatch):
    v, seen, given, train = small_vocabulary(), spark.sparkContext.accumulator(0), [], lm_scoring.train

    class Counted:
        class_logs, word_logs = v.class_logs, v.word_logs

        def read(self, text):
            seen.add(1)
            return v.read(text)

    class Sent:
        value = Counted()

    monkeypatch.setattr(lm_scoring, "train", lambda texts, sent: given.append(texts.count()) or train(texts, Sent))
    rows = [(i if i else None, prose(i, 20), "en", "s", 0, 1.0, "x", 7) for i in range(80)]
    lm_scoring.scores(spark.createDataFrame(rows, SCHEMA).repartition(3))
    learned = sum(not i or zlib.crc32(str(i).encode()) % 10 > 0 for i in range(80))
    assert given == [learned] and seen.value == learned
    assert lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS >= 4096


def test_lm_scores_against_plain_loops(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 20)  # the driver alone reads it
    soft = lm_scoring.SOFT_CLASSES * gru.CLASS_WORDS
    kept, vocabulary, rng = {}, lm_scoring.vocabulary, np.random.default_rng(4)

    def keep_vocabulary(counts, n_ends):
        kept["v"], least = vocabulary(counts, n_ends)
        return kept["v"], least

    def some_network(learned, sent):
        p = gru.start(soft + lm_scoring.END_ROWS, sent.value.class_logs, sent.value.word_logs)
        kept["p"] = {k: x + rng.normal(0, 0.3, x.shape).astype(np.float32) for k, x in p.items()}
        return kept["p"]

    monkeypatch.setattr(lm_scoring, "vocabulary", keep_vocabulary)
    monkeypatch.setattr(lm_scoring, "train", some_network)
    texts = {i: t for i, t in enumerate(TEXTS) if t is None or len(t) < 2000}
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scores(docs.where(F.col("doc_id").isin(*texts)).dropDuplicates(["doc_id"])).collect()}
    v, p = kept["v"], {k: x.astype(float) for k, x in kept["p"].items()}
    learned = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in (t or "").encode().lower().split())
    assert sum(v.rare_kinds) > 5 and len(v.words) > 5
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    squash = lambda x: 1 / (1 + np.exp(-x))
    for i, t in texts.items():
        h, total, d = np.zeros(gru.WIDTH), 0.0, gru.WIDTH
        for w in [*(t or "").encode().lower().split(), b""]:
            k = v.index.get(w)
            rare = 2 * (not w.isascii()) + (w[-1:] in (b".", b","))
            cls = int(v.cls[k]) if k is not None else lm_scoring.SOFT_CLASSES + lm_scoring.PLAIN_CLASSES + rare
            prob = softmax(p["wc"].T @ h + p["bc"])[cls]
            if k is None:
                prob *= (learned[w] + 0.1) / (v.rare_tokens[rare] + 0.1 * (v.rare_kinds[rare] + 1))
            else:
                prob *= softmax(p["ww"][cls] @ h + p["bw"][cls])[v.place[k]]
            total += math.log10(prob)
            row = k if k is not None else soft + zlib.crc32(w.rstrip(b".,")[-3:]) % lm_scoring.END_ROWS
            x, hu = p["emb"][row] @ p["w"] + p["b"], h @ p["u"]
            z, r = squash(x[:d] + hu[:d]), squash(x[d : 2 * d] + hu[d : 2 * d])
            n = np.tanh(x[2 * d :] + r * hu[2 * d :])
            h = n + z * (h - n)
        assert got[i] == pytest.approx(total, rel=1e-4), i


def test_lm_beats_counts_on_held_out_texts(spark):
    rows = lm_scoring.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum() + 0.02 * rows["n_tokens"].sum()


# -- the pipeline


def test_near_duplicate_stage_keeps_one_of_each_group(docs, empty, spark):
    out = corpus_pipeline.near_duplicates(spark, docs, DATA)
    want = plain_components({i: plain_fingerprint(t or "") for i, t in enumerate(TEXTS)})
    assert out.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.collect()) == [-1, *sorted(set(want.values()))]
    assert corpus_pipeline.near_duplicates(spark, empty, DATA).count() == 0


def test_pipeline_stages_on_odd_rows(docs, empty, spark):
    for stage in (corpus_pipeline.clean, corpus_pipeline.in_a_language, corpus_pipeline.near_duplicates):
        assert stage(spark, docs, DATA).columns == docs.columns and stage(spark, empty, DATA).count() == 0
    assert corpus_pipeline.clean(spark, docs, DATA).count() > len(TEXTS) / 2
    letters = {i for i, t in enumerate(TEXTS) if any(map(str.isalpha, t or ""))}
    assert {r["doc_id"] for r in corpus_pipeline.in_a_language(spark, docs, DATA).collect()} == letters | {None}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.in_a_language(spark, unlabelled, DATA).collect()} == letters | {None}
    named = docs.withColumn("row_number", F.lit("mine"))
    out = corpus_pipeline.near_duplicates(spark, named, DATA)
    assert out.columns == named.columns and {r["row_number"] for r in out.collect()} == {"mine"}
    assert corpus_pipeline.pack(spark, docs, DATA).select("doc_id").distinct().count() == len(TEXTS) + 1
    assert corpus_pipeline.pack(spark, empty, DATA).count() == 0


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, now = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["toxicity", "language_id", "simhash_near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, DATA)
        assert out.columns == docs.columns
        now = corpus_pipeline.stored(out)
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in docs.collect()}
    for i in kept:
        assert all(i == j or (fps[i] ^ fps[j]).bit_count() > 3 for j in kept)
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)
