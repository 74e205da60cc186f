"""Source divergence, vector codes and byte-level BPE against plain integer code and the tokenizer library."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from daytrace.llm import byte_bpe, divergence, queries, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], DOCS)
    for name in ("terms", "n", "p", "ids", "decoded", "label", "value", "rank"):
        df = df.withColumn(name, F.lit("x"))
    return df


# --- 11 source divergence


def slow_divergence(rows, min_docs=10, top=10):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    told, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper))
        told[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = set()
    for lang in in_docs:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in told.items() if x == lang}
        every = sum(own.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        far = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(c) for s, c in own.items()}, p(every)
        for s in own:
            pairs = [(o, sum(far(ps[s][t], ps[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, far(ps[s][t], q[t])) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def audited(df, **more):
    rows = [tuple(r) for r in divergence.source_divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def many_sources(seed=1, n=500, sources=7):
    rng = random.Random(seed)
    words = ["Été", "über", "ss", "ß", "日本", "🙂x", "it", "s", " ", "Zz"] + ["".join(rng.choices("abc", k=3)) for _ in range(60)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice([*(f"s{i}" for i in range(sources)), None])
        rows.append((rng.choice([" ", "1", "-", "\n", "\0"]).join(rng.choices(words, k=rng.randint(0, 30))), lang, source))
    return rows + [(None, "en", "only null"), ("", "fr", "alone"), ("rare words", "it", "a"), ("rare words", "it", "b"), ("yes " * 20, "la", "a")] + [("same", "xx", "a")] * 12


@pytest.mark.parametrize("sizes", [(), (("TILE_TERMS", 7), ("TILE_SOURCES", 2), ("SHARD_TERMS", 20), ("BATCH_TERMS", 90), ("SEEN_TERMS", 30))])
def test_divergence_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes:
        monkeypatch.setattr(divergence, name, value)
    rows = many_sources()
    assert audited(documents(spark, rows)) == slow_divergence(rows)


def test_vocabulary_is_cut_into_models(spark, monkeypatch):
    """With small shards several models are made, and each kept term has one number."""
    monkeypatch.setattr(divergence, "SHARD_TERMS", 20)
    docs = documents(spark, many_sources()).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    assert divergence._shards(docs, 10) > 2
    monkeypatch.setattr(divergence, "SHARD_TERMS", 10**6)
    assert divergence._shards(docs, 10) == 1


def test_document_vectors_are_the_models(spark):
    """The vectors that tasks make are those of Spark's model over the same vocabulary."""
    from pyspark.ml.feature import CountVectorizerModel

    texts = [t or "" for t, *_ in many_sources(3, 60)]
    terms = [[x.decode() for x in divergence.terms_of(t.encode())] for t in texts]
    vocabulary = sorted({t for row in terms for t in row})[::2]
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="v")
    wanted = [dict(zip(r.v.indices.tolist(), r.v.values.tolist(), strict=True)) for r in model.transform(spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, terms array<string>")).orderBy("i").collect()]
    numbers = {t.encode(): at for at, t in enumerate(vocabulary)}
    got = [dict(zip(*map(np.ndarray.tolist, divergence.document_vector(divergence.terms_of(t.encode()), numbers)), strict=True)) for t in texts]
    assert got == wanted and any(wanted)


def test_divergence_edges(spark):
    assert audited(documents(spark, []).limit(0)) == set()
    rows = [("word " * 3, "en", "a"), ("other", "en", "b"), (None, None, None)]
    assert audited(documents(spark, rows)) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    long = [("tok " * 300_000 + "end", "en", "a"), ("tok", "en", "b")]
    assert audited(documents(spark, long), min_docs=2) == slow_divergence(long, min_docs=2)


# --- 12 vector codes


def slow_codes(rows, rounds=6):
    """rows: (id, label, vector); of one length."""
    kept = sorted((r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = []
    for _, _, v in kept:
        v = [math.floor(4096 * x) if abs(x) < 2**50 else int(x) * 4096 for x in v]
        w = -(-len(v) // 8)
        v += [0] * (8 * w - len(v))
        cut.append([v[k * w : (k + 1) * w] for k in range(8)])
    books = [[list(c[k]) for c in cut[:16]] for k in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    choose = lambda: [[min((far(c[k], e), j) for j, e in enumerate(books[k])) for k in range(8)] for c in cut]
    for _ in range(rounds):
        at = choose()
        for k in range(8):
            for j in range(len(books[k])):
                mine = [c[k] for c, a in zip(cut, at, strict=True) if a[k][1] == j]
                if mine:
                    books[k][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = choose()
    errors = [sum(d for d, _ in a) for a in at]
    label = Counter()
    for r, e in zip(kept, errors, strict=True):
        label[r[1]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda x: x if x < 2**63 else None
    whole = {k: all(fit(e) is not None for r, e in zip(kept, errors, strict=True) if r[1] == k) for k in label}
    return [(r[0], "".join(f"{j:02x}" for _, j in a), fit(e), fit(label[r[1]]) if whole[r[1]] else None, digest) for r, a, e in zip(kept, at, errors, strict=True)]


def coded(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, label string, embedding array<{kind}>").withColumn("code", F.lit("x")).withColumn("dim", F.lit(1)).withColumn("at", F.lit(2))
    got = vector_codes.compress_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted((tuple(r) for r in got), key=repr)


def vectors(seed, n, d, scale=1.0):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in v.astype(np.float32)] for v in rng.normal(size=(n, d)) * scale]


@pytest.mark.parametrize("d, scale", [(16, 1.0), (20, 1.0), (8, 3e4), (16, 1e12), (8, 1e30), (3, 0.001)])
def test_codes_equal_brute_force(spark, d, scale):
    rows = [(i, f"l{i % 3}" if i % 7 else None, v) for i, v in enumerate(vectors(d, 150, d, scale))]
    rows += [(1000, "l0", None), (1001, "l0", [None] + [0.0] * (d - 1)), (1002, "l1", [float("nan")] * d), (1003, None, [float("inf")] * d)]
    rows += rows[:5] + [(None, "l1", rows[0][2]), (None, "l1", rows[9][2]), (-4, "l2", [0.0] * d)]
    random.Random(3).shuffle(rows)
    assert coded(spark, rows) == sorted(slow_codes(rows), key=repr)


def test_ties_and_few_vectors(spark):
    rows = [(i, "a", [float(i % 2)] * 8) for i in range(40)]
    assert coded(spark, rows) == sorted(slow_codes(rows), key=repr)
    few = [(5, None, [0.5] * 16), (3, None, [-0.25] * 16)]
    assert coded(spark, few) == sorted(slow_codes(few), key=repr)
    assert coded(spark, []) == [] and coded(spark, [(1, "a", None)]) == []


def test_lengths_have_codebooks_of_their_own(spark, monkeypatch):
    short = [(i, "a", v) for i, v in enumerate(vectors(1, 40, 8))]
    long = [(100 + i, "b", v) for i, v in enumerate(vectors(2, 40, 24))]
    wanted = sorted(slow_codes(short) + slow_codes(long) + [(7, "00" * 8, 0, 0, hashlib.sha256(b"," * 0).hexdigest())], key=repr)
    rows = short + long + [(7, "c", [])]
    assert coded(spark, rows) == wanted
    monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", 1)  # a batch for each length
    assert coded(spark, rows) == wanted


def test_exact_products():
    rng = np.random.default_rng(5)
    for bits_a, bits_b, m in ((12, 12, 8), (26, 26, 128), (31, 28, 7), (40, 50, 33), (62, 3, 16), (60, 62, 9)):
        a, b = rng.integers(-(2**bits_a), 2**bits_a, (40, m)), rng.integers(-(2**bits_b), 2**bits_b, (16, m))
        wanted = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert vector_codes.exact_products(a, b).tolist() == wanted


# --- 13 byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=400, seed=4):
    rng = random.Random(seed)
    bits = ["a", "e", "th", "ing", " ", "  ", "\n", "\r\n", "\t", "é", "é", "ß", "日本", "🙂", "👩‍💻", "1", "23", "²", "'s", "'ll", "!", "\x1c", "\x1f", "\x85", " ", " ", "　", "​", "\x00", "\U0010ffff", "<|endoftext|>"]
    return ["".join(rng.choice([*bits, "x" * rng.randint(1, 9)]) for _ in range(rng.choice([3, 20, 150]))) for _ in range(n)]


def test_perfect_hash_is_minimal(ranks):
    tokens = list(ranks)
    found = byte_bpe.PerfectHash(byte_bpe._digests(tokens))
    assert sorted(found(byte_bpe._digests(tokens)).tolist()) == list(range(len(tokens)))
    assert byte_bpe.PerfectHash(byte_bpe._digests([])).size == 0


@pytest.mark.parametrize("coarse", [None, byte_bpe.SPACED])
def test_encoding_is_the_librarys(spark, ranks, library, coarse):
    texts = [*odd_texts(), None, "", " ", "ab" * 4000, " " * 5000, "word " * 100_000, "x" * 200_000]
    df = documents(spark, [(t, "en", "s") for t in texts])
    out = byte_bpe.decode(byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, coarse), ranks)
    assert set(out.columns) == set(df.columns)  # columns of these names are replaced
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
        assert got[i].text == t and got[i].terms == "x"


def test_forgetting_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    codec, texts = byte_bpe.Codec(ranks, public_tokenizers.PATTERN, byte_bpe.SPACED), odd_texts(200, 9)
    for at in range(0, 200, 10):
        assert [x.tolist() for x in codec.encode(texts[at : at + 10])] == [library.encode_ordinary(t) for t in texts[at : at + 10]]


def test_coarse_cuts_stand_where_fine_ones_do():
    fine, coarse = byte_bpe.regex.compile(public_tokenizers.PATTERN), re.compile(byte_bpe.SPACED)
    for cp in range(0, 0x3100):
        for t in (f"a{chr(cp)}b", f"a {chr(cp)} {chr(cp)}{chr(cp)}b", f"{chr(cp)}  1{chr(cp)}"):
            ends = lambda p: {m.end() for m in p.finditer(t)}  # noqa: B023, E731
            assert "".join(coarse.findall(t)) == t and ends(coarse) <= ends(fine)


def test_bpe_edges(spark, ranks):
    assert byte_bpe.encode(documents(spark, []).limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    df = spark.createDataFrame([(1, None), (2, [])], "i int, ids array<int>")
    assert [(r.i, r.decoded) for r in byte_bpe.decode(df, ranks).orderBy("i").collect()] == [(1, None), (2, b"")]
    with pytest.raises(ValueError):
        byte_bpe.Codec({b"a": 0}, public_tokenizers.PATTERN)


def test_bpe_query(spark, ranks, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.QUERIES["op13_byte_bpe"](spark, folder).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))
