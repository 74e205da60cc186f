"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import pytest

from daytrace.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5f}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLES[name])
    wanted = rows([c[0] for c in got.description], got.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in got.description)
    assert rows(df.columns, df.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def taken(spark, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DATA}/{name}.parquet").to_pandas()


def test_sequence_ratio_is_the_usual_one(spark):
    import random
    from difflib import SequenceMatcher

    from daytrace.functions.similarity import ratio

    rng = random.Random(50)
    for n in (0, 1, 5, 30, 199, 200, 201, 450):
        for letters in ("ab", "abcdef ", "abcdefghijklmnopqrstuvwxyz .,"):
            a = "".join(rng.choices(letters, k=n))
            b = "".join(rng.choices(letters, k=max(0, n + rng.randint(-4, 4)))) if rng.random() < 0.5 else a[: n // 2] + "xyz" + a[n // 3 :]
            assert ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
    c = taken(spark, "conversations").sort_values(["conv_id", "turn"])
    turns = {(r.conv_id, r.turn): r.text for r in c.itertuples()}
    for r in catalog.QUERIES["title_similarity"](spark, DATA).limit(40).collect():
        assert r.ratio == pytest.approx(SequenceMatcher(None, turns[r.conv_id, r.turn], turns[r.conv_id, r.turn - 1]).ratio(), abs=1e-6)


def shots_of(spark):
    """(machine, id, ts, app, hash) of the events as screenshots, in order."""
    import hashlib

    e = taken(spark, "events")
    e = e.assign(s=e.ts.astype("datetime64[us]").astype("int64") / 1e6).sort_values(["user_id", "s", "event_id"])
    return [(r.user_id, r.event_id, r.s, r.event_type, hashlib.sha256(f"{r.event_type}|{r.event_id % 3}".encode()).hexdigest()[:16]) for r in e.itertuples()]


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_capture_decisions_equal_brute_force(spark):
    """Of the last eight kept of a machine, the nearest of the same app within a day and six bits makes a duplicate."""
    wanted, kept = {}, {}
    for machine, i, ts, app, h in shots_of(spark):
        mine = kept.setdefault(machine, [])
        alike = [(bits(h, k[2]), n, k) for n, k in enumerate(reversed(mine[-8:])) if k[1] == app]
        near = min(alike, default=None, key=lambda x: x[:2])
        keep = near is None or near[0] > 6 or ts - near[2][0] >= 86400
        wanted[machine, i] = (keep, near and near[0])
        if keep:
            mine.append((ts, app, h))
    got = {(r.machine, r.id): (r.keep, r.distance) for r in catalog.QUERIES["capture_decisions"](spark, DATA).collect()}
    assert got == wanted and {k for k, _ in wanted.values()} == {True, False}


def test_representative_picks_equal_brute_force(spark):
    wanted, kept = set(), {}
    for machine, i, ts, app, h in shots_of(spark):
        mine = kept.setdefault(machine, [])
        same = next((k for k in reversed(mine[-8:]) if k[1] == app), None)
        worth = same is None or ts - same[0] >= 86400 or bits(h, same[2]) > 6
        if not (same is None or ts - same[0] >= 86400) and bits(h, same[2]) > 6:
            # further shots of the app may still be near
            worth = True
            for k in reversed(mine[-8:]):
                if k[1] == app:
                    if ts - k[0] >= 86400:
                        break
                    if bits(h, k[2]) <= 6:
                        worth = False
                        break
        if worth and len(mine) < 20:
            mine.append((ts, app, h))
            wanted.add((machine, i))
    assert {(r.machine, r.id) for r in catalog.QUERIES["representative_picks"](spark, DATA).collect()} == wanted


def test_summary_decisions_equal_brute_force(spark):
    import re
    from difflib import SequenceMatcher

    norm = lambda t: " ".join(re.sub(r"[^\w\s]+", " ", t.strip().lower()).split())
    like = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b and a != b else float(a == b)
    words = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) if a and b else 0.0
    c = taken(spark, "conversations").sort_values(["conv_id", "turn"])
    some = set(sorted(set(c.conv_id))[:12])
    wanted = {}
    for conv, rows in c[c.conv_id.isin(some)].groupby("conv_id"):
        past = []
        for r in rows.itertuples():
            best = None
            for back, o in enumerate(reversed(past[-5:]), start=1):
                a, b = norm(r.text or ""), norm(o.text or "")
                title = max(like(norm(r.role), norm(o.role)), words(norm(r.role), norm(o.role)))
                same = float(r.role == o.role)
                context = max(same * 0.6 + title * 0.3 + 0.1, same * 0.5 + title * 0.4 + 0.1)
                found = (max(like(a, b), words(a, b), context), -back, context, max(0.0, r.turn * 60 - (o.turn * 60 + 30)))
                best = max(best, found) if best else found
            action = "store"
            if best and best[3] <= 240:
                action = "merge_previous" if best[2] >= 0.8 and best[0] >= 0.74 else "suppress" if best[0] >= 0.86 else "store"
            wanted[conv, r.turn] = (action, round(best[0], 6) if best else 0.0)
            past.append(r)
    got = {(r.conv_id, r.id): (r.action, round(r.similarity, 6)) for r in catalog.QUERIES["summary_decisions"](spark, DATA).collect() if r.conv_id in some}
    assert got == wanted


def test_day_signatures_equal_brute_force(spark):
    import json
    from collections import defaultdict

    import xxhash

    wanted = defaultdict(int)
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{DATA}/events.parquet")
    for r in e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.to_json(F.struct(*e.columns)).alias("j"), "event_id").collect():
        assert json.loads(r.j)["event_id"] == r.event_id
        wanted[r.day] ^= xxhash.xxh64_intdigest(r.j.encode(), seed=42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert {r.day: r.signature for r in catalog.QUERIES["day_signatures"](spark, DATA).collect()} == {d: signed(x) for d, x in wanted.items()}


def test_full_segments_equal_one_fold(spark):
    """Segments of islands folded apart are those of one fold over a machine's whole history."""
    from daytrace.config import SegmentSettings
    from daytrace.operators import segments
    from daytrace.plans import activity
    from daytrace.plans.sessions import IDLE_S

    pdf = activity._activity(spark, DATA).toPandas()
    wanted = set()
    for machine in sorted(set(pdf.machine))[:25]:
        mine = pdf[pdf.machine == machine].sort_values(["start_ts", "end_ts", "kind"], kind="stable").assign(norm_title=lambda d: d.window_title.str.lower())
        wanted |= {(machine, w["segment_id"], w["closure_reason"], w["observation_count"]) for w in segments.fold(mine, SegmentSettings(idle_gap_s=IDLE_S, max_duration_s=86400.0), "open", False)}
    got = {(r.machine, r.segment_id, r.closure_reason, r.observation_count) for r in catalog.QUERIES["full_segments"](spark, DATA).collect() if r.machine in {w[0] for w in wanted}}
    assert got == wanted


def test_log_files_are_numbered_across_blocks(spark, tmp_path):
    from daytrace.sources import bundles

    lines = [f"line {i:06d} " + "x" * (i % 90) for i in range(5000)]
    for name in ("a.log", "b.log", "c.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = bundles.read_logs(spark, str(tmp_path))
        got = df.collect()
        assert df.rdd.getNumPartitions() >= 1 and len(got) == 10_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.line == lines[r.line_no - 1] for r in got) and len({(r.source_file, r.line_no) for r in got}) == 10_000


@pytest.mark.parametrize("name, of, key", [("log_files", "conversations", "conv_id"), ("image_files", "embeddings", "vec_id")])
def test_files_are_fewer_than_what_they_hold(spark, tmp_path, monkeypatch, name, of, key):
    from daytrace.plans import files

    monkeypatch.setattr(files, "new_folder", lambda spark, name: str(tmp_path / name))
    n = spark.read.parquet(f"{DATA}/{of}.parquet").select(key).distinct().count()
    assert catalog.QUERIES[name](spark, DATA).count() == n
    assert 0 < len(list(tmp_path.rglob("*.txt"))) <= 8 < n


def test_image_lines_without_a_map_have_nulls(spark, tmp_path):
    from daytrace.sources import images

    (tmp_path / "a.txt").write_text("7 P3 1 1 255 10 20 30\n8 P3 2 1 255 1 2 3\n9\n")
    got = {r.name: (r.width, r.height, r.exact_hash is None) for r in images.read_image_lines(spark, str(tmp_path)).collect()}
    assert got == {"7": (1, 1, False), "8": (None, None, True), "9": (None, None, True)}


def page_finds(url):
    """What a browser title made of a page's url holds, by plain Python: {(type, normalized): [value, source, ref, evidence, confidence]}."""
    import re
    from pathlib import PureWindowsPath

    title = re.sub(r"^[a-z]+://", r"U:\\web\\", url) + " - Google Chrome"
    name = r'[^\\/:*?"<>|\r\n]+'
    once = lambda values, key=str.lower: list({key(v): v for v in reversed(values)}.values())[::-1]
    plain = lambda t: " ".join(t.split()).lower()
    slashed = lambda p: re.sub(r"(?<!^)/+", "/", p.replace("\\", "/")).lower()
    paths = []
    for p in once([p.strip().rstrip("\\/") for p in re.findall(rf"(?<!\w)((?:[A-Za-z]:[\\/](?:{name}[\\/])*{name})|(?:(?:\\\\|//)(?:{name}[\\/])+{name}))", title)], slashed):
        path = PureWindowsPath(p)
        folder = re.sub(r"[\\/]+[^\\/]*$", "", p) if path.suffix else p
        if path.suffix:
            paths += [("file_path", p, slashed(p), "observed", 0.98), ("file_name", path.name, path.name.lower(), "observed", 0.97)]
        paths += [("folder_path", folder, slashed(folder), "observed", 0.9), ("project_candidate", "web", "web", "likely", 0.72)]
    found = [("program", "chrome.exe", "chrome.exe", "observed", 1.0), ("window_title", title, plain(title), "observed", 1.0), *paths, *paths]
    found += [("file_name", t, t.lower(), "observed", 0.88) for t in once(re.findall(r"(?<![\w/\\])([A-Za-z0-9][A-Za-z0-9._-]{0,127}\.[A-Za-z0-9]{1,10})(?![\w/\\])", title))]
    tickets = list(dict.fromkeys(t.upper() for t in re.findall(r"(?i)\b([A-Z][A-Z0-9]+-\d+)\b", title)))
    found += [("task_candidate", t, t, "observed", 0.9) for t in tickets]
    found += [("repository", r, r.lower(), "inferred", 0.7) for r in once(re.findall(r"\b([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)\b", title)) if "." not in r.split("/")[0]]
    labels = re.findall(r"(?i)\b(?:task|case|job|run|build|ticket|issue|story)[:\s#-]+([A-Za-z0-9._/-]{2,})\b", title)
    found += [("task_candidate", t.strip("-_ "), plain(t.strip("-_ ")), "observed", 0.82) for t in once(labels)]
    page = title.removesuffix(" - Google Chrome").strip()
    if page:
        found.append(("web_page_title", page, plain(page), "observed", 0.93))
    found += [("task_candidate", t, t, "observed", 0.95) for t in tickets]
    out = {}
    for kind, value, norm, evidence, confidence in found:
        mine = out.setdefault((kind, norm), [value, "process_name" if kind == "program" else "window_title", "chrome.exe" if kind == "program" else title, evidence, confidence])
        mine[4] = max(mine[4], confidence)
    return out


def test_page_entities_equal_plain_python(spark):
    urls = {r.page_id: r.url for r in taken(spark, "pages").itertuples()}
    wanted = {(i, *k): tuple(v) for i, u in urls.items() if u for k, v in page_finds(u).items()}
    rows = catalog.QUERIES["page_entities"](spark, DATA).collect()
    got = {(r.page_id, r.entity_type, r.entity_normalized): (r.entity_value, r.source_kind, r.source_ref, r.evidence_kind, r.confidence) for r in rows}
    assert len(rows) == len(got) and got == wanted and {k[1] for k in wanted} >= {"file_path", "file_name", "folder_path", "project_candidate", "web_page_title"}
