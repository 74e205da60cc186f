"""Operators of the llm folder against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daytrace.llm import common, embedding_dedup, langid, line_templates, minhash, mixing, packing, quality_lm, quality_rules, queries, substring_dedup, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def documents(spark, rows, *more):
    """Rows (id, text[, lang[, source]]) as documents, with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("_id", "_text", "n", "kept", "size", "key", "bin", *more):
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one", None, None), (None, "no id here at all", None, None)]


# --- shared


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    wanted = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()
    found = {r.id: r.component for r in got}
    assert found == {k: v for k, v in wanted.items() if k in found} and set(found) == {x for a, b in edges if a != b for x in (a, b)}


# --- 5 quality rules


def counts_of(text):
    w = words(text)
    s = (text or "").encode()
    dense = bytes(b for b in s if b not in SPACES.encode()).decode()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return len(w), len(dense), sum(c in "#*$%&|<>" for c in dense), len(lines) - len(set(lines)), len(hit)


def test_text_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a b c d e", "a b c d e f", "a b c d e a b c d e", "a a a a a a a a", "é ü\x0bß #*$%&|<> |", "x\n\nx\n x\nx\n", "\u00a0 a\u00a0b"]
    texts += ["\n".join(" ".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.counted(df, [F.col("i")], F.col("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == counts_of(t), t


def outliers(n=700, seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, max(12, int(rng.lognormvariate(4, 0.5)))), "en", "a" if i % 3 else "b") for i in range(n)]
    rows += [(n + i, " ".join(w + "***" for w in prose(rng, 60).split()), "en", "a") for i in range(25)]
    rows += [(n + 50 + i, prose(rng, 60).replace(" ", "") + " a" * 12, "en", "b") for i in range(5)]
    return rows


def test_outliers_are_rejected_and_the_rest_kept(spark):
    rows = outliers()
    got = {r.doc_id: r for r in quality_rules.judge_quality(documents(spark, rows)).collect()}
    assert sum(got[i].kept for i in range(700)) >= 690 and not any(got[700 + i].kept for i in range(25)) and not any(got[750 + i].kept for i in range(5))


def statistics_of(rows):
    x = []
    for r in rows:
        n, c = float(r.n_words), float(r.word_chars)
        x.append([math.log(n), math.log(c / n), math.sqrt(r.n_symbols / c), math.sqrt(min(1, 10 * r.n_dup_lines / n)), math.sqrt(r.n_repeat_words / n)])
    return np.array(x)


FLOORS2 = np.diag(np.array([0.25, 0.06, 0.06, 0.10, 0.08]) ** 2)
FACTOR = 0.75 / quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.75, 5), 7)


def distances(x, m, cov):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)


def concentrate(x, m, cov):
    bins = np.floor(np.log2(distances(x, m, cov) + 1e-9) * 32)
    near = x[bins <= np.sort(bins)[math.ceil(0.75 * len(x)) - 1]]
    return near.mean(axis=0), np.cov(near.T, bias=True) * FACTOR + FLOORS2


def test_robust_distance_matches_numpy(spark):
    """The same estimator written with numpy: four starts, two steps each, the best goes on until its determinant stays."""
    rows = [r[:3] + ("a",) for r in outliers()]
    data = quality_rules.judge_quality(documents(spark, rows)).where("not base_failed").collect()
    x = statistics_of(data)
    b = np.floor(x * 64)
    middle = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    med = middle(b)
    c, s = (med + 0.5) / 64, np.sqrt((middle(np.abs(b - med)) * 1.4826 / 64) ** 2 + np.diag(FLOORS2))
    z = (x - c) / s
    u, v = z / np.maximum(1e-9, np.linalg.norm(z, axis=1))[:, None], np.tanh(z)
    ridge, scale = 0.01 * np.eye(5), np.outer(s, s)
    found = [(c, scale * (np.eye(5) + ridge)), (c, scale * (u.T @ u / len(u) + ridge)), (c, scale * (np.cov(v.T, bias=True) + ridge)), (x.mean(axis=0), np.cov(x.T, bias=True) + FLOORS2)]
    for _ in range(2):
        found = [concentrate(x, *f) for f in found]
    best = min(found, key=lambda f: np.linalg.det(f[1]))
    while True:
        after = concentrate(x, *best)
        if np.log(np.linalg.det(after[1])) >= np.log(np.linalg.det(best[1])) - 1e-3:
            break
        best = after
    assert np.allclose(distances(x, *best), [r.distance2 for r in data], rtol=1e-6)
    # many random starts find no determinant that is lower by much
    rng = np.random.default_rng(5)
    least = math.inf
    for _ in range(60):
        some = x[rng.choice(len(x), 12, replace=False)]
        f = (some.mean(axis=0), np.cov(some.T, bias=True) + FLOORS2)
        for _ in range(12):
            f = concentrate(x, *f)
        least = min(least, np.linalg.det(f[1]))
    assert np.linalg.det(best[1]) <= 1.02 * least


def test_small_groups_are_judged_by_pooled_estimates(spark):
    rng = random.Random(4)
    few = [(i, prose(rng, 30), "xx", f"s{i}") for i in range(20)]
    got = quality_rules.judge_quality(documents(spark, few)).collect()
    assert all(r.kept and r.distance2 is not None for r in got)
    many = [(i, prose(rng, 30), "xx", f"s{i}") for i in range(200)]
    assert all(r.distance2 is not None for r in quality_rules.judge_quality(documents(spark, many)).collect())
    odd = [(900, " ".join(w + "***" for w in prose(rng, 60).split()), "yy", "t")]
    got = {r.doc_id: r for r in quality_rules.judge_quality(documents(spark, [(i, t, "en", "a") for i, t, *_ in many] + odd)).collect()}
    assert not got[900].kept and all(got[i].kept for i in range(200)), "the only document of its language and source is judged on all rows"


def test_quality_filter_and_edges(spark):
    docs = documents(spark, outliers(200))
    judged = {r.doc_id for r in quality_rules.judge_quality(docs).where("kept").collect()}
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == judged
    assert [r.kept for r in quality_rules.judge_quality(documents(spark, ODD)).collect()] == [False] * 7
    assert quality_rules.judge_quality(documents(spark, ODD).limit(0)).count() == 0 == quality_rules.keep_good(documents(spark, ODD).limit(0)).count()


def test_chi_square():
    assert quality_rules.chi2_cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6) and quality_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)


# --- 9 url filters

RULES = [(v, h, p) for v, h, p in queries.URL_RULES]


def judged_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


URLS = [
    None, "", "nope", "http://", "http://a.ORG", "http://a.org/", "HTTP://Org/x", "http://Example.org/es/1?u=://x/y", "http://x.example.org/en/123#a", "http://x.example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/1",
    "http://a.com/de/1", "http://a.com?x=http://b.org/es/", "ftp://com/de/", "http://a.b.example.org/es", "x://y://example.org/es/", "http://Ä.org/ü", "http://a.com/de/1", "http://a\nb.org/es/\n",
]


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string").withColumns({c: F.lit("x") for c in ("host", "digest", "short", "rule", "v", "_h", "_p", "page", "c", "best")})
    got = url_filters.judge_urls(pages, url_filters.rule_table(spark, RULES + RULES[:1])).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged_url(r.url), r.url
    shuffled = url_filters.judge_urls(pages, url_filters.rule_table(spark, RULES), broadcast_rows=0).collect()
    assert sorted((r.page_id, r.verdict) for r in shuffled) == sorted((r.page_id, r.verdict) for r in got)
    assert got[0].__fields__ == ["page_id", "url", "digest", "short", "v", "_h", "_p", "page", "c", "best", "host", "path", "rule", "verdict"]
    hot = spark.createDataFrame([(i, "http://x.example.org/es/1") for i in range(50)] + [(100 + i, None) for i in range(50)], "page_id int, url string")
    assert Counter((r.rule, r.verdict) for r in url_filters.judge_urls(hot, url_filters.rule_table(spark, RULES)).collect()) == {("example.org/es/", "block"): 50, (None, "allow"): 50}
    assert {r.verdict for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, RULES).limit(0)).collect()} == {"allow"}
    assert url_filters.judge_urls(pages.limit(0), url_filters.rule_table(spark, RULES)).count() == 0


def test_many_rules_and_a_hot_suffix(spark, monkeypatch):
    """With a rule table too large to broadcast, an expression that all urls have is dealt over tasks."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    urls = [f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(60)] + ["http://h.com/" + "de/" * 100_000, "http://" + "a." * 50 + "example.org/es/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rules = RULES + [("block", f"h{i}.com", "/") for i in range(0, 60, 7)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, rules), broadcast_rows=0).collect()}
    assert got == {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, rules)).collect()}
    assert got[1] == ("com/de/", "block") and got[2] == ("com/fr/", "allow")
    assert len(got) == 62 and got[60] == ("com/de/", "block") and got[61] == ("example.org/es/", "block")


# --- 4 mixing


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)] + [(600, None, "en", "e")]
    docs = documents(spark, rows)
    got = mixing.mix_plan(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    wanted, free, total = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(wanted.values())) / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            wanted[s] = 2 * sizes[s]
            free.discard(s)
    wanted |= {s: level * weights[s] for s in free}
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(wanted[source[r.doc_id]])
        assert r.taken <= 2 * r.size and len(r.positions) * r.size == r.taken and all(0 <= p <= 1 for p in r.positions)
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= max(30, 0.01 * wanted[s])
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted(again, key=lambda r: r.doc_id) == sorted(got, key=lambda r: r.doc_id)


def test_mixed_documents_follow_their_positions(spark):
    rng = random.Random(6)
    docs = documents(spark, [(i, prose(rng, 20), "en", "ab"[i % 2]) for i in range(100)])
    at = {r.doc_id: sorted(r.positions) for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix_documents(docs)
    order = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and Counter(order) == Counter({d: len(p) for d, p in at.items() if p})
    flat = sorted((p, d) for d, ps in at.items() for p in ps)
    assert order == [d for _, d in flat]


def test_rows_that_tie_keep_their_order(spark):
    rng = random.Random(45)
    rows = [(1 + i // 6, prose(random.Random(i // 6), 12), f"l{i % 6}", "ab"[i // 6 % 2]) for i in range(60)]
    rng.shuffle(rows)
    one = [tuple(r) for r in mixing.mix_documents(documents(spark, rows, "_all", "_key")).select("doc_id", "lang").collect()]
    rng.shuffle(rows)
    assert [tuple(r) for r in mixing.mix_documents(documents(spark, rows, "_all", "_key").repartition(7)).select("doc_id", "lang").collect()] == one and len(set(one)) > 30


def test_curriculum_positions(spark):
    """A source that fades out is used up early; the integral of the schedule up to a position is its share."""
    shape = F.array(*map(F.lit, mixing.SHAPES[0]))
    got = spark.range(0, 101).select((F.col("id") / 100).alias("u"), mixing.position_of(F.col("id") / 100, shape).alias("t")).collect()
    for r in got:
        t = r.t
        area = 1.5 * t - t * t / 2  # weight 1.5 - t
        assert area == pytest.approx(r.u, abs=1e-9)


def test_mix_edges(spark):
    got = mixing.mix_plan(documents(spark, ODD)).collect()
    assert len(got) == 7 and sum(r.taken for r in got) > 0 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix_plan(documents(spark, ODD).limit(0)).count() == 0 and mixing.mix_documents(documents(spark, ODD).limit(0)).count() == 0


# --- 1 packing


def slow_best_fit(pieces, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in pieces:
        ok = [(capacity - b["n"], i) for i, b in enumerate(bins) if b["n"] + size <= capacity and b["s"].count(source) < per_source and (cluster < 0 or cluster not in b["c"])]
        if ok:
            _, i = min(ok)
        else:
            bins.append({"n": 0, "s": [], "c": []})
            i = len(bins) - 1
        out.append((i, bins[i]["n"]))
        bins[i]["n"] += size
        bins[i]["s"].append(source)
        bins[i]["c"].append(cluster)
    return out


def test_best_fit_is_the_brute_force_one():
    rng = random.Random(7)
    for _ in range(60):
        pieces = [(rng.randint(1, 20), rng.randrange(3), rng.choice([-1, -1, 0, 1])) for _ in range(rng.randint(0, 60))]
        for k in (1, 2):
            assert list(packing.best_fit(pieces, 20, k)) == slow_best_fit(pieces, 20, k)


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([3, 10, 40, 130, 260])), "en", rng.choice("aab")) for i in range(400)]
    rows += [(1000 + i, rows[0][1].upper(), "en", "c") for i in range(40)] + [rows[1], rows[1]]
    docs = documents(spark, rows)
    got = packing.pack_documents(docs, capacity=100, block_rows=150).collect()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id, r["copy"]].append((r.start, r.n_words))
        bins[r.bin].append(r)
    assert Counter(d for d, _ in parts) == Counter(r[0] for r in rows)
    for (d, _), spans in parts.items():
        assert sorted(spans)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False)) and sum(n for _, n in spans) == len(words(text[d]))
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.n_words == b.bin_offset for a, b in zip(members, members[1:], strict=False)) and members[-1].bin_offset + members[-1].n_words <= 100
        assert len({tuple(w.lower() for w in words(text[r.doc_id])) for r in members}) == len(members)
        assert max(Counter(source[r.doc_id] for r in members).values()) <= packing.PER_SOURCE
    again = packing.pack_documents(docs.repartition(5), capacity=100, block_rows=150).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_packing_edges(spark):
    got = packing.pack_documents(documents(spark, ODD)).collect()
    assert len(got) == 7 and sum(r.bin is None for r in got) == 3 and {r["copy"] for r in got if r.doc_id == 4} == {1, 2}
    assert packing.pack_documents(documents(spark, ODD).limit(0)).count() == 0
    own = packing.pack_documents(documents(spark, [(1, "a b"), (2, "c d")]), cluster="key").collect()
    assert len({r.bin for r in own}) == 2


# --- 10 minhash


def brute_near(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=9, groups=25):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = prose(rng, rng.choice([4, 8, 40, 120, 300])).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "Zz"])
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(w)))
    common_text = prose(rng, 60)
    rows += [(len(rows) + i, common_text + " " + prose(rng, rng.choice([5, 15, 60]))) for i in range(30)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rows = near_copies()
    got = minhash.near_duplicates(documents(spark, rows), percent=percent).collect()
    wanted = brute_near(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted and all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.drop_near_duplicates(documents(spark, rows), percent=percent)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in wanted.values()}


def test_last_round_alone_finds_every_link(spark, monkeypatch):
    """Without star rounds the tiles of the last round do all the work."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    monkeypatch.setattr(minhash, "TILE_DOCS", 3)
    rows = near_copies(10, 12)
    got = minhash.near_duplicates(documents(spark, rows), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 85)


def test_tables_make_the_candidates(spark, monkeypatch):
    """Documents that share no table are never compared; equal ones are one node without any table."""
    rows = near_copies(10, 12) + [(900, "a b c d e f"), (901, "A  b c d e f")]
    monkeypatch.setattr(minhash, "_table_keys", lambda live: live.select(F.xxhash64("id").alias("key"), "id", "n"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), percent=85).collect()}
    assert got != {i: c for i, (_, c) in brute_near(rows, 85).items()} and got[901] == 900


def test_hot_groups_are_split(spark, monkeypatch):
    """The same components come out where every join shuffles and hubs are dealt over several tasks."""
    rng = random.Random(42)
    base = prose(rng, 120).split()
    rows = near_copies(12, 6)
    for i in range(40):
        w = list(base)
        w[rng.randrange(120)] = "zz"
        rows.append((1000 + i, " ".join(w)))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 10_000)
    monkeypatch.setattr(minhash, "TILE_DOCS", 3)
    got = minhash.near_duplicates(documents(spark, rows), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 85)


def test_clashing_names_of_near_dedup(spark):
    docs = documents(spark, ODD, "_gone", "row", "id", "c")
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 6


def test_near_duplicate_edges(spark):
    got = minhash.near_duplicates(documents(spark, ODD)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got) == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False)]
    assert minhash.near_duplicates(documents(spark, ODD).limit(0)).count() == 0
    two = [(7, "a b c d e f"), (7, "g h i j k l"), (8, "g h i j k l"), (9, "a b c d e f")]
    assert {r.component_id for r in minhash.near_duplicates(documents(spark, two)).collect()} == {7}


# --- 8 embeddings


def brute_links(rows, cosine=0.98):
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    lab = {i: label for i, _, label in rows}
    links = {i: {j for j in ok if j != i and lab[i] == lab[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / (np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])) >= cosine} if i in ok else set() for i, _, _ in rows}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


@pytest.mark.parametrize("tile", [2048, 7])
def test_embeddings_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(11)
    rows = []
    for g in range(25):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            v = base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.12, 0.2])
            rows.append((len(rows), [float(x) for x in np.float32(v * rng.choice([1, 1e-3, 50]))], int(g % 3)))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] + [1.0] * 15, 1), (n + 4, [float("inf")] + [1.0] * 15, 1), (n + 5, rows[0][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "vec", "n", "cell", "rep")})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_embeddings(df).collect()}
    assert got == brute_links(rows)
    assert embedding_dedup.link_embeddings(df.union(df)).count() == len(rows)
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_in_double_precision(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e300, 1e300], 0), (3, [1e-60, 0.0], 0), (4, [1e-60, 0.0], 0), (5, [5e-324, 0.0], 0), (6, [1.0, 1.0 + 1e-12], 0), (7, [-0.0, 3.0], 0), (8, [0.0, 3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_embeddings(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 7: (1, 7), 8: (1, 7)}


def test_vectors_of_one_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.0, 1.0], 1), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.link_embeddings(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


# --- 6 spans


def brute_sentences(text):
    """A splitter of its own, character by character: lists of words."""
    marks, closers, dense = ".!?…", "\"'”’»)]", "。！？।؟۔"
    chunks, cur, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c == "\n":
            chunks.append(cur)
            cur = ""
            i += 1
            continue
        cur += c
        i += 1
        if c in dense:
            while i < len(text) and text[i] in dense:
                cur += text[i]
                i += 1
            chunks.append(cur)
            cur = ""
        elif c in marks:
            while i < len(text) and text[i] in marks + closers:
                cur += text[i]
                i += 1
            if i == len(text) or text[i] in SPACES:
                chunks.append(cur)
                cur = ""
    chunks.append(cur)
    whole, acc = [], []
    for chunk in chunks:
        acc = acc + [w.decode() for w in chunk.encode().split()]
        if len(acc) >= 4:
            whole.append(acc)
            acc = []
    whole += [acc] if acc else []
    out = []
    for s in whole:
        if len(s) <= 24:
            out.append(s)
            continue
        part = []
        for w in s:
            part.append(w)
            if len(part) == 24 or len(part) >= 4 and zlib.crc32(w.encode()) % 8 == 0:
                out.append(part)
                part = []
        out += [part] if part else []
    return out


def brute_spans(rows):
    spans, sents = defaultdict(list), {}
    for i, t in rows:
        sents[i] = s = brute_sentences(t or "")
        for k in range(len(s) - 2):
            spans[tuple(map(tuple, s[k : k + 3]))].append((i, k))
    gone = defaultdict(set)
    for found in spans.values():
        for i, k in sorted(found)[1:]:
            gone[i] |= {k, k + 1, k + 2}
    return gone, sents


def test_spans_equal_brute_force(spark):
    rng = random.Random(12)
    say = lambda n: prose(rng, n).capitalize() + rng.choice([".", "!", "?", ".”", "…"])
    passage = " ".join(say(20) for _ in range(4))
    bare = prose(rng, 60)
    rows = []
    for i in range(60):
        parts = [say(rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage if i % 8 else prose(rng, 3) + " " + passage + " " + prose(rng, 5) + ".")
        if i % 5 == 0:
            parts.insert(0, prose(rng, 4) + " " + bare + " " + prose(rng, 5))
        if i % 11 == 0:
            parts.append("これは短い文です。次の文です。 Words of 3.14 and e.g.this. Ha! Ho! Hum!")
        rows.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, bare), (104, bare.replace(" ", "  ")), (105, "der " * 300), (106, "x " + "der " * 200), (107, "long. " * 30_000)]
    docs = documents(spark, rows)
    gone, sents = brute_spans(rows)
    runs = substring_dedup.removed_runs(docs).collect()
    got = defaultdict(set)
    for r in runs:
        got[r.doc_id] |= set(range(r.first_sentence, r.first_sentence + r.n_sentences))
        body = [w for s in sents[r.doc_id][r.first_sentence : r.first_sentence + r.n_sentences] for w in s]
        assert "".join(w.decode() for w in words(r.text)) == "".join(body) and r.text in dict(rows)[r.doc_id] and r.n_words == len(words(r.text))
    assert got == gone and {100, 104} <= set(got) and 0 not in got
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    for i, t in rows:
        if not gone.get(i):
            assert left[i] == t
        else:
            assert "".join(w.decode() for w in words(left[i])) == "".join(w for k, s in enumerate(sents[i]) if k not in gone[i] for w in s)


def test_lower_case_passages_without_marks_are_found(spark):
    rng = random.Random(40)
    passage = prose(rng, 60)
    rows = [(1, prose(rng, 30) + " " + passage + " " + prose(rng, 30)), (2, prose(rng, 9) + " " + passage + " " + prose(rng, 50)), (3, prose(rng, 90))]
    got = substring_dedup.removed_runs(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {2} and sum(r.n_words for r in got) >= 30


def test_removal_keeps_lines_and_spaces(spark):
    shared = "One two three four. Five six seven eight. Nine ten eleven twelve."
    rows = [(1, shared), (2, "\tA list of things:\n- first of all that is\n\n" + shared + "\n- second of all that is\n"), (3, "Own words come first here. " + shared + " Own words come last here."), (4, shared + "\nAnd then some more words.")]
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert left == {1: shared, 2: "\tA list of things:\n- first of all that is\n\n- second of all that is\n", 3: "Own words come first here. Own words come last here.", 4: "And then some more words."}


def test_span_edges(spark):
    assert substring_dedup.removed_runs(documents(spark, ODD)).count() == 0
    same = [(1, "One two three four five six. Seven eight nine ten eleven. A b c d.")] * 2
    assert substring_dedup.removed_runs(documents(spark, same)).count() == 0
    assert substring_dedup.removed_runs(documents(spark, same).limit(0)).count() == 0
    assert substring_dedup.remove_repeats(documents(spark, ODD)).count() == 7
    none = [(None, same[0][1]), (None, same[0][1] + " And another one more."), (3, same[0][1])]
    assert sorted((r.doc_id or 0, r.first_sentence) for r in substring_dedup.removed_runs(documents(spark, none)).collect()) == [(0, 0), (3, 0)]


def test_hot_spans_are_split(spark, monkeypatch):
    """The same rows come out where keys are joined by broadcast, by shuffle and in parts."""
    rng = random.Random(41)
    passage = " ".join(prose(rng, 9) + "." for _ in range(4))
    rows = [(i, prose(rng, 8) + ". " + passage + " " + prose(rng, 9) + ".") for i in range(60)] + [(100 + i, rows_) for i, rows_ in enumerate([" ".join(prose(rng, 6) + "." for _ in range(5))] * 3)]
    wanted = sorted(map(tuple, substring_dedup.removed_runs(documents(spark, rows)).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 10_000)
    assert sorted(map(tuple, substring_dedup.removed_runs(documents(spark, rows)).collect())) == wanted and len(wanted) == 61


# --- 3 lines


def brute_lines(rows, min_docs):
    """{id: {line number: template}} to drop, by dictionaries."""
    field = lambda t: ["<*>" if any(c in "0123456789" for c in x) else x for x in t]
    lines = []
    for i, t in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        for no, line in enumerate(t.split("\n")):
            w = [x.decode() for x in line.encode().split()]
            if w:
                lines.append((i, no, tuple(field(w) if set(field(w)) != {"<*>"} else w)))
    leaf = lambda t: (len(t), t[:2])
    per_leaf, docs_of, support = defaultdict(set), defaultdict(set), Counter()
    for i, _, tok in lines:
        per_leaf[leaf(tok)].add(i)
        docs_of[tok].add(i)
    live = {tok for tok in docs_of if len(per_leaf[leaf(tok)]) >= min_docs}
    for tok in live:
        for p, w in enumerate(tok):
            support[leaf(tok), p, w] += len(docs_of[tok])
    templates = {}
    for tok in live:
        fixed = [support[leaf(tok), p, w] >= min_docs and w != "<*>" for p, w in enumerate(tok)]
        if len(tok) < 4 and len(docs_of[tok]) >= min_docs:
            templates[tok] = " ".join(tok)
        elif len(tok) >= 4 and sum(fixed) >= max(len(tok) * 0.6, 3):
            templates[tok] = " ".join(w if f else "<*>" for w, f in zip(tok, fixed, strict=True))
    having = defaultdict(list)
    for i, no, tok in lines:
        if tok in templates:
            having[templates[tok]].append((i, no))
    gone = defaultdict(dict)
    for template, found in having.items():
        if len({i for i, _ in found}) >= min_docs:
            for i, no in sorted(found)[1:]:
                gone[i][no] = template
    return dict(gone)


def test_lines_equal_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for i in range(80):
        lines = [prose(rng, rng.randint(1, 14)) for _ in range(4)]
        if i % 3 == 0:
            lines.insert(rng.randrange(5), f"Released under licence number {i} of the year")
        if i % 4 == 0:
            lines.append(f"Posted by user{i} on the public board")
        if i % 5 == 0:
            lines.append("All rights reserved worldwide " + rng.choice(["today", "forever", "always"]))
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, f"Released under licence number {i} of the year") for i in range(12)]
    docs = documents(spark, rows)
    wanted = brute_lines(rows, 10)
    got = defaultdict(dict)
    for r in line_templates.dropped_lines(docs).collect():
        got[r.doc_id][r.line_no] = r.template
        assert r.line == dict(rows)[r.doc_id].split("\n")[r.line_no]
    assert dict(got) == wanted and len(wanted) > 20 and all(200 + i in got for i in range(12)) and 0 not in got
    left = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}
    for i, t in rows:
        assert left[i] == "\n".join(x for no, x in enumerate(t.split("\n")) if no not in wanted.get(i, {}))


def test_line_edges(spark):
    docs = documents(spark, ODD)
    assert line_templates.dropped_lines(docs).count() == 0 and line_templates.drop_recurring_lines(docs).count() == 7
    assert line_templates.dropped_lines(docs.limit(0)).count() == 0
    copies = [(i, "the very same line here\n" + "and another one of them") for i in range(30)]
    assert line_templates.dropped_lines(documents(spark, copies)).count() == 58, "all but the first lose both lines"
    numbered = [(i, f"Page {i}\n{i}\n12 34") for i in range(40)]
    got = sorted((r.doc_id, r.line_no, r.template) for r in line_templates.dropped_lines(documents(spark, numbered)).collect())
    assert got == sorted([(i, 0, "Page <*>") for i in range(1, 40)] + [(i, 2, "12 34") for i in range(1, 40)])
    news = [(i, f"Subscribe to our newsletter today please\nitem {i} sold out") for i in range(40)]
    assert line_templates.dropped_lines(documents(spark, news)).count() == 78
    wide = [(i, "the same very long line " * 40_000 + str(i)) for i in range(11)]
    assert line_templates.dropped_lines(documents(spark, wide)).count() == 10


def test_hot_lines_are_split(spark, monkeypatch):
    rng = random.Random(43)
    rows = [(i, "\n".join([prose(rng, 5), "The same first words of it then " + rng.choice("abcdefgh"), "Read more", "Page 3 of the very long book " + str(i)])) for i in range(50)]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    got = defaultdict(dict)
    for r in line_templates.dropped_lines(documents(spark, rows)).collect():
        got[r.doc_id][r.line_no] = r.template
    assert dict(got) == brute_lines(rows, 10) and len(got) == 49


def test_mostly_recurring_documents_and_short_lines_are_cleaned(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 4) + "\nAccept all cookies to read on with us\nRead more\n7 July\nPage " + str(i)) for i in range(12)]
    rows += [(100 + i, "Read more\n" + prose(rng, 30)) for i in range(3)]
    copies = [(200 + i, "some copied page\nwith its own two lines of words") for i in range(11)]
    left = {r.doc_id: r.text.split("\n") for r in line_templates.drop_recurring_lines(documents(spark, rows + copies)).collect()}
    text = dict(rows)
    assert left[0] == text[0].split("\n")
    for i in range(1, 12):
        assert left[i] == [text[i].split("\n")[0]], "over half of the words go, and lines of one to three words"
    assert all(left[100 + i] == text[100 + i].split("\n")[1:] for i in range(3))
    assert "\n".join(left[200]) == copies[0][1] and all(left[200 + i] == [""] for i in range(1, 11))
    got = {(r.doc_id, r.line) for r in line_templates.dropped_lines(documents(spark, rows + copies)).collect()}
    assert (5, "Read more") in got and (5, "7 July") in got and (5, "Page 5") in got


# --- 7 languages


def tongues(n=240, seed=14):
    rng = random.Random(seed)
    kinds = {"aa": "abcde", "bb": "cdefg", "cc": "xyzé"}
    return [(i, prose(rng, rng.randint(8, 50), kinds[k]).capitalize() + ".", k) for i in range(n) for k in [list(kinds)[i % 3]]]


def test_languages(spark):
    import zlib

    rows = tongues()
    got = langid.identify_languages(documents(spark, rows)).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.97
    changed = [(i, t, k if zlib.crc32(str(i).encode()) % 5 else "zz", "other") for i, t, k in rows]
    assert sorted(map(tuple, langid.identify_languages(documents(spark, changed)).collect())) == sorted(map(tuple, got)), "held-out labels and sources must not matter"


def test_language_edges(spark):
    rows = tongues(60) + [(900, None, "aa"), (901, "", None), (902, "12 34 !?", "bb"), (903, "abcab", None)]
    got = {r.doc_id: r for r in langid.identify_languages(documents(spark, rows)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred in ("aa", "bb")
    nothing = langid.identify_languages(documents(spark, [(1, "abc", None)])).collect()
    assert nothing[0].lang_pred == "und" and langid.identify_languages(documents(spark, rows).limit(0)).count() == 0


def slots_of(text):
    """Slots of the 1- to 3-grams of letters, one by one: the definition, in Python integers."""
    s = "".join(c if c.isalpha() else " " for c in text.lower()).lstrip(" ")
    while "  " in s:
        s = s.replace("  ", " ")
    s = " " + s + " "
    m = (1 << 64) - 1
    out = Counter()
    for k, start in ((1, range(1, len(s) - 1)), (2, range(len(s) - 1)), (3, range(len(s) - 2))):
        for i in start:
            c = [ord(x) for x in s[i : i + k]]
            if k == 1:
                h = c[0] * 0xFF51AFD7ED558CCD & m
            else:
                h = (c[0] * 0x9E3779B97F4A7C15 + c[1] * 0xC2B2AE3D27D4EB4F) & m
                if k == 3:
                    h = (h * 0x165667B19E3779F9 + c[2] * 0xD6E8FEB86659FD93) & m
            h ^= h >> 29
            out[(h * 0xBF58476D1CE4E5B9 & m) >> 52] += 1
    return out


def test_languages_equal_brute_force(spark):
    """Vectors, frequencies and the nearest centroid, computed text by text; centroids are means of their own texts."""
    rows = tongues(60) + [(500, "ab", "aa"), (501, "x" * 40_000, "cc")]
    train = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5]
    df = Counter(s for t, _ in train for s in slots_of(t))
    idf = lambda s: math.log((1 + len(train)) / (1 + df[s])) + 1

    def vector(t):
        v = np.zeros(langid.SLOTS)
        for s, n in slots_of(t).items():
            v[s] = math.log1p(n) * idf(s)
        return v / np.linalg.norm(v)

    model = langid.fit(spark.createDataFrame(train, "_text string, _lang string"))
    assert np.allclose(model[0], [idf(s) for s in range(langid.SLOTS)], atol=1e-5)
    own = {k: np.array([vector(t) for t, x in train if x == k]) for k in ("aa", "bb", "cc")}
    for k in own:
        mine = np.array([c for c, x in zip(model[2], model[1], strict=True) if x == k])
        near = (own[k] @ mine.T).argmax(axis=1)
        for j in range(len(mine)):
            mean = own[k][near == j].sum(axis=0)
            assert np.allclose(mean / np.linalg.norm(mean), mine[j], atol=1e-3)
    got = {r.doc_id: r for r in langid.identify_languages(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        like = model[2] @ vector(t)
        assert got[i].lang_pred == model[1][int(like.argmax())] and got[i].score == pytest.approx(like.max(), abs=1e-4)


def test_no_language_is_lost(spark):
    rng = random.Random(44)
    some = [(t, "aa") for _, t, k in tongues(300) if k == "aa"]
    two = [prose(rng, 20, "vwyz"), prose(rng, 20, "vwyz")]
    train = spark.createDataFrame(some + [(two[i % 2], "zz") for i in range(30_000)], "_text string, _lang string")
    _, langs, _, _ = langid.fit(train, fit_texts=50)
    assert Counter(langs)["zz"] == 2 and "aa" in langs


def test_fit_sample_does_not_shrink_with_copies(spark):
    rows = tongues(90)
    few = [(f"{t}", k) for _, t, k in rows]
    copies = [(few[0][0], few[0][1])] * 40_000
    train = spark.createDataFrame(few + copies, "_text string, _lang string")
    _, langs, centroids, _ = langid.fit(train, fit_texts=40)
    assert Counter(langs) == {"aa": 4, "bb": 4, "cc": 4}, "30 distinct texts a language, fewer than asked for: all are fitted on"
    model = langid.fit(train, fit_texts=40)
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in langid.predict(texts, model, ["doc_id"]).collect()]) > 0.95


# --- 2 language model


def slow_model(texts):
    """Interpolated modified Kneser-Ney of order 4 over characters, with dictionaries of tuples."""
    pad = ["<edge>"] * 3
    c4 = Counter()
    for t in texts:
        if t:
            s = pad + list(t) + pad[:1]
            c4.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    counts = [c4]
    while len(counts) < 4:
        counts.append(Counter(g[1:] for g in counts[-1]))

    def level(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) if n[k - 1] else k * y for k in (1, 2, 3)]
        total, off = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            off[g[:-1]] += d[min(v, 3) - 1]
        return lambda g, p: (max(0, c[g] - d[min(c[g], 3) - 1]) / total[g[:-1]] if g in c else 0) + (off[g[:-1]] / total[g[:-1]] if g[:-1] in total else 1) * p

    levels = [level(c) for c in counts]

    def prob(g):
        p = 1 / 65536
        for k in (3, 2, 1, 0):
            p = levels[k](g[k:], p)
        return p

    def perplexity(t):
        s = pad + list(t) + pad[:1]
        return math.exp(sum(-math.log(prob(tuple(s[i : i + 4]))) for i in range(len(s) - 3)) / (len(t) + 1))

    return prob, perplexity


def test_model_equals_dictionaries(spark):
    rng = random.Random(15)
    texts = [prose(rng, 30, "abcdeжд") for _ in range(30)] + ["ab", "", None]
    model = quality_lm.Model(spark.createDataFrame([(t,) for t in texts], "_text string"), common.Scratch(spark, "t"))
    prob, _ = slow_model(texts)
    number = lambda g: int(np.array([sum((0xFFFF if c == "<edge>" else ord(c)) << 16 * (3 - k) for k, c in enumerate(g))], dtype=np.uint64).view(np.int64)[0])
    asked = {number(g): g for g in {tuple(rng.choice("abcdeждx ") for _ in range(4)) for _ in range(2000)} | {("<edge>",) * 3 + ("a",), ("<edge>",) * 3 + ("x",)}}
    got = {r.gram: r.nats for r in model.nats(spark.createDataFrame([(g,) for g in asked], "gram long")).collect()}
    assert set(got) == set(asked)
    for n, g in asked.items():
        assert got[n] == pytest.approx(-math.log(prob(g)), rel=1e-9)
    numbers, nats = model.head()
    assert list(numbers) == sorted({int(g) for t in texts for g in quality_lm.grams(t)}) and len(nats) == len(numbers)


def test_classifier(spark, monkeypatch):
    rng = random.Random(16)
    rows = [(i, prose(rng, 40, "abcde"), ["aa", "bb", None][i % 3]) for i in range(150)] + [(200 + i, prose(rng, 40, "vwxyz#%"), "aa") for i in range(10)] + [(300, "ж" * 30_000, "aa"), (301, "\U0001f600 ok", "aa")]
    trusted = spark.createDataFrame([(i,) for i in range(0, 150, 2)] + [(0,), (None,)], "doc_id long")
    docs = documents(spark, rows + ODD)
    got = quality_lm.classify(docs, trusted).collect()
    assert len(got) == len(rows) + 7
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id >= 10}
    assert not any(kept[200 + i] for i in range(10)) and not kept[300] and np.mean([kept[i] for i in range(10, 150)]) > 0.9
    held = {r.t: r.h for r in docs.select(F.col("text").alias("t"), (F.pmod(F.xxhash64("text"), F.lit(quality_lm.HOLD_OUT)) == 0).alias("h")).collect()}
    good = [t for i, t, *_ in rows if i < 150 and i % 2 == 0] + [t for i, t, *_ in ODD if i is not None and i % 2 == 0 and t]
    _, perplexity = slow_model([t for t in good if not held[t]])
    for r in got:
        t = dict((x[0], x[1]) for x in rows).get(r.doc_id)
        if r.doc_id in (0, 77, 78, 203, 301):
            assert r.n_grams == len(t) + 1
            if r.doc_id != 301:
                assert r.perplexity == pytest.approx(perplexity(t), rel=1e-6)
    limit = sorted(perplexity(t) for i, t, k in rows if i < 150 and i % 2 == 0 and k == "bb" and held[t])[-1]
    assert next(r.threshold for r in got if r.lang == "bb") == pytest.approx(limit, rel=0.003), "the limit is that of held-out texts"
    assert all(r.perplexity is None and not r.kept for r in got if r.doc_id in (1, 2) and r.n_grams == 0)
    untrusted = quality_lm.classify(docs, trusted.limit(0)).collect()
    assert all(r.kept for r in untrusted) and quality_lm.classify(docs.limit(0), trusted).count() == 0
    monkeypatch.setattr(quality_lm, "HEAD", 50)
    again = quality_lm.classify(docs, trusted).collect()
    plain = lambda rs: sorted((r.doc_id or 0, r.n_grams, round(r.perplexity or 0, 6), r.kept) for r in rs)
    assert plain(again) == plain(got), "what tasks hold and what they join is one model"


# --- long texts


def test_very_long_texts_are_read_whole(spark, tmp_path):
    """A text of some megabytes, one of a single line of a million words, and copies of both that differ at their ends."""
    rng = random.Random(61)
    book = "\n".join(prose(rng, 12) for _ in range(20_000))
    line = " ".join(prose(rng, 1000).split() * 1000)
    rows = [(1, book), (2, line), (3, book + " one more word"), (4, line + " x y z")] + [(10 + i, prose(rng, 30)) for i in range(40)]
    docs, n = documents(spark, rows), {i: len(words(t)) for i, t in rows}
    judged = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    assert {i: r.n_words for i, r in judged.items()} == n and judged[2].n_repeat_words == n[2] and judged[2].base_failed and not judged[1].base_failed
    near = {r.doc_id: r for r in minhash.near_duplicates(docs, percent=85).collect()}
    assert (near[3].component_id, near[4].component_id) == (1, 2) and near[1].n_shingles > 200_000 and near[2].n_shingles < 2000
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    assert {i: r.size for i, r in plan.items()} == n and all(r.taken <= 2 * r.size for r in plan.values())
    packed = packing.pack_documents(docs).where("doc_id = 2").collect()
    assert sum(r.n_words for r in packed) == n[2] and all(r.bin is not None for r in packed), "a longer text than a sequence is cut"
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert ids == {i for i in judged if judged[i].kept and i not in (3, 4)}, "repeats and outliers go in the first stage, near copies in the third"


# --- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, "\n".join([prose(rng, 30), prose(rng, 25), "Released under some licence or other"] if i % 2 else [prose(rng, 40), prose(rng, 20)]), "en", "ab"[i % 2]) for i in range(150)]
    rows += [(500 + i, rows[7][1], "en", "a") for i in range(4)] + [(600, "too short", "en", "a"), (601, None, None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    seen = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{folder}/{k}")
        seen.append(spark.read.parquet(f"{folder}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns, name
    good, lines, one, mixed, packed = [[r for r in df.collect()] for df in seen[1:]]
    counts = {i: counts_of(t) for i, t, *_ in rows}
    assert {r.doc_id for r in good} == {i for i, n in counts.items() if n[0] >= 10 and 100 * n[4] <= 20 * n[0]} == {r[0] for r in rows if r[0] < 600}
    # each stage by brute force on what it was given
    gone = brute_lines([(r.doc_id, r.text) for r in good], 10)
    assert {r.doc_id: r.text for r in lines} == {r.doc_id: "\n".join(x for no, x in enumerate(r.text.split("\n")) if no not in gone.get(r.doc_id, {})) for r in good} and len(gone) > 70
    near = brute_near([(r.doc_id, r.text) for r in lines], 80)
    assert {r.doc_id for r in one} == {c for _, c in near.values()} and len(one) == 150
    plan = {r.doc_id: r.positions for r in mixing.mix_plan(seen[3]).collect()}
    assert [r.doc_id for r in mixing.mix_documents(seen[3]).collect()] == [d for _, d in sorted((p, d) for d, ps in plan.items() for p in ps)]
    assert Counter(r.doc_id for r in mixed) == Counter(d for d, ps in plan.items() for _ in ps)
    copies, pieces = Counter(), []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        copies[r.doc_id] += 1
        pieces.append((-len(words(r.text)), r.doc_id, copies[r.doc_id], r.source, tuple(w.lower() for w in words(r.text))))
    pieces.sort(key=lambda p: p[:3])
    kinds = {c: k for k, c in enumerate(sorted({p[4] for p in pieces}))}
    spots = slow_best_fit([(-n, s, kinds[c]) for n, _, _, s, c in pieces], packing.CAPACITY, packing.PER_SOURCE)
    assert sorted((r.doc_id, r["copy"], r.bin, r.bin_offset) for r in packed) == sorted((d, k, b, at) for (_, d, k, _, _), (b, at) in zip(pieces, spots, strict=True))
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, packed))


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    for rows in (ODD, ODD[:0]):
        docs = documents(spark, rows + ODD).limit(len(rows)).select("doc_id", "text", "lang", "source", "n_chars", "_id", "_text", "kept")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() in range(len(rows) * 2 + 1)


def test_queries_and_sql_have_the_same_names():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 10


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    got = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in got.description]
    plain = lambda v: "" if v is None else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in got.fetchall())
