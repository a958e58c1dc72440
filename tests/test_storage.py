"""Plans and results of the jobs that keep wide rows or many rounds on disk."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from mirrorline.operators import graph as G
from mirrorline.operators import manifest as M
from mirrorline.sources import mirror as MS
from mirrorline.sources import mirror_tree as MT


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _depths(edges, seeds):
    out, now, depth = {}, set(seeds), 0
    while now:
        out |= dict.fromkeys(now, depth)
        now = {b for a, b in edges if a in now and b is not None} - set(out)
        depth += 1
    return out


def test_reachable_equals_plain_search(spark):
    rnd = random.Random(5)
    edges = [(f"u{rnd.randrange(120)}", f"u{rnd.randrange(120)}") for _ in range(150)] * 2
    edges += [("u1", f"hub{k}") for k in range(40)] + [(f"c{k}", f"c{k + 1}") for k in range(6)] + [("u1", "c0"), ("c6", "u1"), (None, "x"), ("u1", None)]
    e = spark.createDataFrame(edges, "src_url string, dst_url string")
    s = spark.createDataFrame([("u1",), ("u1",), ("lonely",), (None,)], "url string")
    for hot, parts in ((100_000, 64), (10, 3)):
        assert dict(G.reachable(e, s, hot, parts).collect()) == _depths(edges, ["u1", "lonely"])
    assert G.reachable(e, s.limit(0)).count() == 0
    assert {r.url for r in G.reachable(e.limit(0), s).collect()} == {"u1", "lonely"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("reach_")]


def test_a_round_moves_neither_edges_nor_urls_seen(spark, monkeypatch):
    def step(*args, real=G._step):
        found = real(*args)
        texts.append(_plan(found))
        return found

    texts = []
    monkeypatch.setattr(G, "_step", step)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        chain = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(6)], "src_url string, dst_url string")
        G.reachable(chain, spark.createDataFrame([("c0",)], "url string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(texts) == 7 and len({t.count("\n") for t in texts}) == 1
    edges = [line for line in texts[-1].splitlines() if "FileScan" in line and "dst_url" in line]
    assert len(edges) == 1 and "Bucketed: true" in edges[0]
    # what moves: the newest URLs (for their parts), those asked for, and the targets
    assert len(re.findall(r"Exchange hashpartitioning", texts[-1])) <= 4
    for scan in ("dst_url", "PartitionFilters: []"):
        at = next(k for k, line in enumerate(texts[-1].splitlines()) if "FileScan" in line and scan in line)
        above = texts[-1].splitlines()[:at]
        depth = texts[-1].splitlines()[at].index("FileScan")
        for line in reversed(above):  # up to the join that the scan feeds
            if "Join" in line:
                break
            assert "Exchange" not in line or re.search(r"[A-Z]", line).start() >= depth


def _mirror(spark, rows):
    return spark.createDataFrame(rows, "site string, offline_path string, url string, rtype string, content string, size bigint, "
                                       "hash string, out_hash string, seq bigint, out_size bigint")


def _rows():
    rnd = random.Random(9)
    rows = []
    for k in range(400):
        site, path = f"s{min(rnd.randrange(9), 4)}", f"p{rnd.randrange(40)}"
        seq = rnd.choice([None, *range(30)])
        rows.append((site, path, f"http://{site}/{path}?{rnd.randrange(2)}", "page", f"body {k}", 6, f"h{k % 5}", f"o{k:03d}", seq, 6))
    return rows


def test_stored_files_keep_the_last_row_of_every_path(spark):
    rows = _rows()
    best = {}
    for r in rows:
        key = (-1 if r[8] is None else r[8], r[2], r[7])
        if (r[0], r[1]) not in best or key > best[r[0], r[1]][0]:
            best[r[0], r[1]] = (key, r[4])
    for crowd, site_files in ((1000, 2_000), (3, 10), (1, 1)):
        got = MS.stored_files(_mirror(spark, rows), crowd, site_files).collect()
        assert {(r.site, r.path): r.content for r in got} == {k: v[1] for k, v in best.items()} and len(got) == len(best)
    assert MS.stored_files(_mirror(spark, rows[:0])).count() == 0


def test_bodies_move_once_and_counts_read_no_body(spark, tmp_path):
    _mirror(spark, _rows()).write.parquet(str(tmp_path / "m"))
    plan = _plan(MS.stored_files(spark.read.parquet(str(tmp_path / "m"))))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 3 and sum("content" in s for s in scans) == 1
    moves = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(moves) == 1 and re.search(r"hashpartitioning\(site#\d+, shard#\d+", moves[0])
    rows = spark.read.parquet(str(tmp_path / "m")).withColumnRenamed("offline_path", "path")
    for narrow in (MS.crowded_paths(rows, 1), MS.large_sites(rows, 1)):
        assert "content" not in _plan(narrow)


def test_a_small_site_lies_in_one_file(spark, tmp_path):
    MS.write_mirror(_mirror(spark, _rows()), str(tmp_path / "m"))
    files = spark.read.parquet(str(tmp_path / "m")).select("site", F.input_file_name().alias("f")).distinct()
    assert files.count() == files.select("site").distinct().count()


def test_bundle_is_read_back(spark, tmp_path):
    mirror = _mirror(spark, [*_rows(), ("s0", f"deep/{MS.MANIFEST_FILE}", "http://s0/m", "other", "{}", 2, "h", "o", 1, 2)])
    MS.write_bundle(mirror, str(tmp_path / "b"))
    bundle = spark.read.parquet(str(tmp_path / "b"))
    totals = bundle.groupBy("site").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
    assert sorted(totals.collect()) == sorted(MS.bundle_totals(mirror).collect())


def _digest(body):
    return "sha256:" + hashlib.sha256(body).hexdigest()


def test_tree_holds_what_was_written(spark, tmp_path):
    good = [("s0", "index.html", b"x"), ("s0", "_next/a b.css", b"\xff\x00"), ("s0", ".well-known/x", b"w"), ("s1", "%C3%BC#?/i.html", b""),
            ("s1", "empty", None), ("s1", "big.bin", bytes(range(256)) * 12_000), ("s1", "dir/in", b"d")]
    bad = [("s1", "dir", b"lost"), ("s0", "../out", b"o"), ("..", "x", b"o"), ("s0", "", b"o"), (None, "x", b"o"), ("s0", "n" * 300, b"o")]
    files = spark.createDataFrame(good + bad, "site string, path string, content binary")
    for root in (str(tmp_path / "a 'tree'"), f"file:{tmp_path}/again"):
        for _ in range(2):  # a second writing changes nothing
            lost = MT.write_tree(files, root).collect()
            assert sorted((r.site or "", r.path) for r in lost) == sorted((s or "", p) for s, p, _ in bad) and all(r.reason for r in lost)
        got = {(r.site, r.path): (r.disk_size, r.disk_hash) for r in MT.tree_digests(files, root).collect()}
        assert got == {(s, p): (len(b or b""), _digest(b or b"")) for s, p, b in good} | {(s, p): (None, None) for s, p, _ in bad}
    on_disk = {str(p.relative_to(tmp_path / "again")) for p in (tmp_path / "again").rglob("*") if p.is_file()}
    assert on_disk == {f"{s}/{p}" for s, p, _ in good}
    assert MT.write_tree(files.limit(0), str(tmp_path / "none")).count() == 0 == MT.tree_digests(files.limit(0), str(tmp_path / "none")).count()


def test_freshness_by_digests(spark, tmp_path):
    files = spark.createDataFrame([("s", "a", b"1"), ("s", "b", b"2")], "site string, path string, content binary")
    MT.write_tree(files, str(tmp_path))
    entries = spark.createDataFrame([("s", "u/a", "a", _digest(b"1")), ("s", "u/b", "b", _digest(b"1")), ("s", "u/c", "c", _digest(b"1"))],
                                    "site string, url string, path string, out_hash string")
    fresh = M.freshness(entries, MT.tree_digests(entries, str(tmp_path)))
    assert {r.url: r.fresh for r in fresh.collect()} == {"u/a": True, "u/b": False, "u/c": False}
