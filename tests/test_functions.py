"""Scalar functions against small cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daytrace import config
from daytrace.functions import numeric as N
from daytrace.functions import similarity as S
from daytrace.functions import text as T
from daytrace.schemas import RELATIONS, evolve


def one(spark, build, *values):
    """Result of an expression over columns a, b, ... of one row."""
    names = "abcd"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(build(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "build, value, wanted",
    [
        (T.normalize_title, "  Éditeur — Foo.txt\t* ", "éditeur foo txt"),
        (T.normalize_text, " A \n B\tc ", "a b c"),
        (T.tickets, "Working on abc-12, ABC-12 and DEF-4421", ["ABC-12", "DEF-4421"]),
        (T.tickets, "", []),
        (T.windows_paths, r"Editor - U:\PROJ1\XXX\data\Input_cases.m *", [r"U:\PROJ1\XXX\data\Input_cases.m"]),
        (T.windows_paths, r"\\host\share\a.txt", [r"\\host\share\a.txt"]),
        (T.normalize_path, r"U:\A\b.M *", "u:/a/b.m"),
        (T.normalize_path, r"\\Host\Share\x", "//host/share/x"),
        (T.project_of_path, r"U:\PROJ1\XXX\data\Input_cases.m", "PROJ1"),
        (T.project_of_path, r"C:\Users\src\thing\a.py", "thing"),
        (T.project_of_path, r"C:\Users\Documents", "Users"),
        (T.is_file_path, r"C:\a\b.txt", True),
        (T.is_file_path, r"C:\a\.git", False),
        (T.is_file_path, r"C:\a\b", False),
        (T.file_tokens, "FooTool - Analysis for ABC-1234 - run_042.log and run_042.LOG", ["run_042.log"]),
        (T.repositories, "see acme/tool and x.y/z", ["acme/tool"]),
        (T.branches, "branch: feature/a on main branch", ["feature/a", "main"]),
        (T.task_labels, "task: build-7 analysis for ABC-1234", ["build-7", "ABC-1234"]),
        (T.strip_browser, "Daily build notes - Google Chrome", "Daily build notes"),
        (T.strip_mail, "RE: Project Phoenix - Message (HTML) - Outlook", "RE: Project Phoenix"),
        (T.strip_talk, "Chat | Microsoft Teams", "Chat"),
        (T.has_edit_marker, "a.txt *", True),
        (T.entity_query, r" U:\Proj  X ", "u:/proj x"),
        (lambda c: T.highlight(c, "<B"), "a <b & <B>", "a <mark>&lt;b</mark> &amp; <mark>&lt;B</mark>&gt;"),
    ],
)
def test_text(spark, build, value, wanted):
    assert one(spark, build, value) == wanted


def test_transition_words_are_found_inside_words(spark):
    assert one(spark, lambda c: T.has_transition(c, ["call"]), "recalled it")
    assert not one(spark, lambda c: T.has_transition(c, ["call"]), "did it")


def test_canonical_text(spark):
    got = spark.sql("select '2024-01-01' d, 'App' p, null t, ' a  b ' s, 0D a, 60D b").select(T.canonical_text(*[F.col(c) for c in ("d", "p", "t", "s", "a", "b")]).alias("x")).first().x
    assert got == "day: 2024-01-01\ntime: 00:00-00:01\napp: App\nwindow: \nsummary: a b"


def test_numbers(spark):
    df = spark.sql("select array(1D,0D) a, array(1D,1D) b, array(0D,0D) z, array(1D) s, array(10,20,30,40) g, array(10,20,30,41) h")
    r = df.select(
        N.cosine(F.col("a"), F.col("b")).alias("c"), N.cosine(F.col("a"), F.col("z")).alias("z"), N.cosine(F.col("a"), F.col("s")).alias("s"), N.average_hash(F.col("g")).alias("hex"),
        N.structural_similarity(F.col("g"), F.col("g")).alias("one"), N.structural_similarity(F.col("g"), F.col("h")).alias("near"), N.structural_similarity(F.col("g"), F.array(F.lit(1))).alias("none"),
    ).first()
    assert r.c == pytest.approx(0.5**0.5) and r.z == r.s == 0 and r.hex == "3" and r.one == 1 and 0.99 < r.near < 1 and r.none is None


@pytest.mark.parametrize("a, b, wanted", [("ff", "fe", 1), ("ffffffffffffffff", "0", 64), ("8000000000000000", "0", 1), ("xy", "0", None)])
def test_hamming(spark, a, b, wanted):
    assert one(spark, N.hamming_hex, a, b) == wanted


def test_clip_tokens_clamp(spark):
    r = spark.range(1).select(N.clip_region(F.lit(-5), F.lit(2), F.lit(50), F.lit(90), (0, 0, 40, 40)).alias("c"), N.token_estimate(F.lit(5)).alias("t"), N.token_estimate(F.lit(0)).alias("z"), N.unit_clamp(F.lit("1.7")).alias("u"), N.unit_clamp(F.lit("x"), 0.2).alias("d")).first()
    assert tuple(r.c) == (0, 2, 40, 40) and r.t == 2 and r.z is None and r.u == 1 and r.d == 0.2


def test_gray_grid(spark):
    rgb = bytes([255, 0, 0] * 2 + [0, 0, 255] * 2)
    got = spark.createDataFrame([(bytearray(rgb),)], "b binary").select(N.gray_grid(F.col("b"), F.lit(2), F.lit(2), 2).alias("g")).first().g
    assert got == [76, 76, 29, 29]


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_ratio_is_symmetric_at_its_ends(a, b):
    assert 0 <= S.ratio(a, b) <= 1 and S.ratio(a, a) == 1.0


def test_ratio_column(spark):
    df = spark.createDataFrame([(1, "abcd", "bcde"), (2, None, None), (3, "a", ""), (4, "abcd", "bcde")], "i int, a string, b string")
    assert {r.i: r.r for r in S.add_ratio(df, "a", "b", "r").collect()} == {1: 0.75, 2: 1.0, 3: 0.0, 4: 0.75}
    assert {r.i: r.r for r in S.add_text_similarity(df, "a", "b", "r").collect()}[1] == 0.75


def test_settings():
    s, warnings = config.load({"segments": {"idle_gap_s": "30", "title_similarity": 3, "odd": 1}, "coalesce": {"lock_blocks": "no"}, "extra": 1})
    assert s.segments.idle_gap_s == 30 and s.segments.title_similarity == 1 and s.coalesce.lock_blocks is False
    assert warnings == ["unknown field extra", "unknown field segments.odd"]
    assert config.difference(config.Settings(), s).keys() == {"segments.idle_gap_s", "segments.title_similarity", "coalesce.lock_blocks"}
    with pytest.raises(ValueError):
        config.load({"version": 99})
    with pytest.raises(ValueError):
        config.coerce("maybe", bool)
    assert config.SummaryDedupSettings(suppress=0.5, merge=0.9).merge == 0.5


def test_evolve(spark):
    df = evolve(spark.sql("select 1L id, 'x' odd, 2D start_ts"), "summaries")
    assert df.columns == [c.split()[0] for c in RELATIONS["summaries"].split(", ")] and df.first().summary_text is None


def test_ascii_words_of_branches_and_values_made_once(spark):
    df = spark.createDataFrame([("caf\u00e9on les. Branch: x",)], "t string")
    got = df.select(T.branches(F.col("t")).alias("u"), T.branches(F.col("t"), T.ascii_only).alias("a"))
    assert got.first() == (["x"], ["x", "les."])
    # the three patterns stand once in the plan, not once more for each use of what they find
    assert got.select("a")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 3


def test_ratio_searches_instead_of_comparing_all_characters():
    import random
    import time
    from difflib import SequenceMatcher

    from daytrace.functions.similarity import ratio

    r = random.Random(3)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    some = [(text(r.randint(0, 300), "abcde"), text(r.randint(0, 300), "abcdefgh" + "a" * r.randint(0, 60))) for _ in range(300)]
    assert all(ratio(a, b) == SequenceMatcher(None, a, b).ratio() for a, b in some)
    long = [(text(1500, "abcdefghijklmnopqrstuvwxyz "), text(190, "abcdefghijklmnopqrstuvwxyz ")) for _ in range(30)]
    took = []
    for how in (ratio, lambda a, b: SequenceMatcher(None, a, b).ratio()):
        start = time.process_time()
        found = [how(a, b) for a, b in long]
        took.append((time.process_time() - start, found))
    assert took[0][1] == took[1][1] and took[0][0] < took[1][0] / 2
