import random

import pytest
from pyspark.sql import functions as F

from corpusguard.functions import text as tx
from corpusguard.functions.percentile import lower_index
from corpusguard.operators import findings, ledger, params, paths

SCHEMA = "source_id long, rule_id string, fingerprint string, path string, origin string, line_no int, context_name string, seq_id string, arrival long, triage string"


def frame(spark, rows):
    made = [(1, "r", fp, path, "diff" if path.startswith("<commit-diff>") else "path", n, None, seq, n, "unknown") for n, (fp, path, seq) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def merged(spark, existing, arriving):
    return {r.fingerprint: (r.path, r.seen_in) for r in findings.merge(frame(spark, existing), frame(spark, arriving)).collect()}


def test_merge(spark):
    diff = "<commit-diff>:a"
    assert merged(spark, [("x", diff, "c1")], [("x", "a", "c2")]) == {"x": ("a", ["c1", "c2"])}
    assert merged(spark, [("x", "a", "c1")], [("x", diff, "c2"), ("x", "b", "c1")]) == {"x": ("a", ["c1", "c2"])}
    assert merged(spark, [], [("x", diff, "c9"), ("x", diff, "c1"), ("y", "b", None)]) == {"x": (diff, ["c9", "c1"]), "y": ("b", [])}
    many = [(f"v{i % 600}", "p", f"c{i}") for i in range(1200)]
    out = merged(spark, [], many)
    assert len(out) == 600 and all(len(s) == 2 for _, s in out.values())


def test_facets_ignore_their_own_filter(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 2)], "x string, y int")
    got = {(r.facet, r.value): r.n for r in findings.facets(rows, {"x": ["a"], "y": [1]}).collect()}
    assert got == {("x", "a"): 1, ("x", "b"): 2, ("y", "1"): 1, ("y", "2"): 1}


def test_options_count_the_unknown(spark):
    rows = spark.createDataFrame([(1, "n", "valid"), (1, "m", None), (1, "n", "odd"), (2, "k", "failed")], "id int, name string, status string")
    got = {tuple(r) for r in findings.options(rows, "id", ["name"], "status", findings.TRIAGE, "unknown").collect()}
    assert got == {(1, "m", 3, 1, 0, 0, 2), (2, "k", 1, 0, 0, 1, 0)}


def test_search_takes_characters_as_they_are(spark):
    rows = spark.createDataFrame([(1, "Own", "re_po", "p/É", None), (2, "own", "repo", "q%", "KEY")], "id int, owner string, name string, path string, context_name string")

    def ids(search):
        return [r.id for r in findings.searched(rows, search).orderBy("id").collect()]

    assert ids("OWN") == [1, 2] and ids("re_") == [1] and ids("%") == [2] and ids("wn/REPO") == [2] and ids("key") == [2] and ids("é") == [] and ids(None) == [1, 2]


def test_scope_and_pages(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "b", "Y"), (3, None, "z")], "id int, owner string, name string")
    grants = spark.createDataFrame([("a", "X", "approved"), ("B", "y", "pending")], "owner string, name string, status string")
    assert [r.id for r in findings.in_scope(rows, grants).collect()] == [1]
    assert findings.in_scope(rows, grants.limit(0)).collect() == []
    assert [r.id for r in findings.page(rows, [F.desc("id")], 1, 1).collect()] == [2]
    with pytest.raises(ValueError):
        findings.page(rows, [F.desc("id")], -1)


def test_triage(spark):
    rows = spark.createDataFrame([(1, 7, "r", "valid", "t", "why"), (2, 7, "s", "unknown", None, "why"), (3, 8, "r", "unknown", None, "")], "id int, source_id int, rule_id string, triage string, checked_at string, reason string")
    assert {r.id: (r.triage, r.reason) for r in findings.set_triage(rows, "unknown", [1]).collect()} == {1: ("unknown", None), 2: ("unknown", "why"), 3: ("unknown", "")}
    assert {r.id: (r.triage, r.checked_at) for r in findings.reset_triage(rows, 7, ["r"]).collect()} == {1: ("unknown", None), 2: ("unknown", None), 3: ("unknown", None)}
    assert {r.id: r.triage for r in findings.failed_from_unknown(rows).collect()} == {1: "valid", 2: "failed", 3: "unknown"}
    with pytest.raises(ValueError):
        findings.set_triage(rows, "odd", [1])


def test_paths_and_diffs(spark):
    out = ["a/tests/x.py", "x.SPEC.tsx", "test_a.py", "b/c_test.go", "node_modules/x", "a.min.js", "swagger-ui-bundle.js", "d/yarn.lock", "__mocks__/a"]
    kept = ["src/latest.py", "contest/a.py", "a.js", "distance/x", "yarn.lock.txt", "attest.py"]
    rows = spark.createDataFrame([(p,) for p in out + kept], "p string")
    assert {r.p for r in rows.where(paths.is_excluded(F.col("p"))).collect()} == set(out)
    text = "intro\ndiff --git a/x b/x y\n+1\ndiff --git a/z b/z\n+2"
    rows = paths.split_diff(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "id int, text string"))
    assert sorted((r.id, r.part_no, r.path, r.part) for r in rows.collect()) == [(1, 1, "<commit-diff>:x y", "\n+1\n"), (1, 2, "<commit-diff>:z", "\n+2"), (2, 0, "<commit-diff>", "plain")]
    labels = spark.createDataFrame([("<commit-diff>",), ("<commit-diff>:a",), ("a",)], "p string").select(paths.is_diff_sourced(F.col("p")), paths.diff_path(F.col("p"))).collect()
    assert [tuple(r) for r in labels] == [(True, None), (True, "a"), (False, None)]


def test_text_functions(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("aabb",), ("abcd",), (None,)], "s string")
    assert [r[0] for r in rows.select(tx.entropy(F.col("s"))).collect()] == [0.0, 0.0, 1.0, 2.0, None]
    rows = spark.createDataFrame([('["a", 1, null, "b"]',), ("{}",), ("[",), (None,), ('["x"]',)], "s string")
    assert [r[0] for r in rows.select(tx.json_strings(F.col("s"))).collect()] == [["a", "b"], [], [], [], ["x"]]
    rows = spark.createDataFrame([(" a  b\n",)], "s string")
    assert rows.select(tx.collapsed(F.col("s"), 2)).first()[0] == "a "
    rows = spark.createDataFrame([("x https://a.b/c<d 'http://e' é_1 日本",)], "s string")
    assert rows.select(tx.urls_in(F.col("s")), tx.unicode_words(F.col("s"))).first()[0] == ["https://a.b/c", "http://e"]
    assert rows.select(tx.unicode_words(F.col("s"))).first()[0][-2:] == ["é_1", "日本"]


@pytest.mark.parametrize("n", [1, 2, 5, 20, 1000])
def test_percentile_by_lower_index(spark, n):
    rng = random.Random(n)
    values = [(rng.choice("ab"), round(rng.random() * 50, rng.choice([0, 6]))) for _ in range(n)] + [("a", None)]
    rows = spark.createDataFrame(values, "k string, v double")
    for fraction in (0.0, 0.5, 0.95, 1.0):
        for by in (["k"], []):
            want = {}
            for k in {k for k, v in values if v is not None} if by else {None}:
                x = sorted(v for g, v in values if v is not None and (not by or g == k))
                want[k] = x[int((len(x) - 1) * fraction)]
            got = {(r.k if by else None): r.p for r in lower_index(rows, by, "v", fraction, "p").collect()}
            assert got == want


AS_OF = "2024-01-01 00:00:00"


def tables(spark, work=(), phases=()):
    w = [(i, s, None, None, e, 0, None, None, r) for i, s, e, r in work]
    p = [(i, ph, s, t, None, None, e, 0, None, None, None) for i, ph, s, t, e in phases]
    return spark.createDataFrame(w, ledger.WORK), spark.createDataFrame(p, ledger.PHASES)


def states(df):
    keys = ["source_id"] + (["phase"] if "phase" in df.columns else [])
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r.source_id: (r.status, r.epoch, r.retry) for r in df.collect()}


def test_ledger_start_and_claim(spark):
    work, _ = tables(spark, [(1, "pending", 0, None), (2, "done", 3, None), (3, "cancelled", 1, None), (4, "pending", 0, None)])
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,), (9,)], "source_id long")
    assert states(ledger.start(work, ids, 1, AS_OF)) == {1: ("in_progress", 1, 0), 2: ("done", 3, 0), 3: ("cancelled", 1, 0), 4: ("pending", 0, 0), 9: ("in_progress", 1, 0)}
    assert states(ledger.start(work, ids, 1, AS_OF, restart_cancelled=True))[3] == ("in_progress", 1, 0)
    assert states(ledger.claim(work, 1, 0, AS_OF)) == {1: ("in_progress", 0, 0), 2: ("done", 3, 0), 3: ("cancelled", 1, 0), 4: ("pending", 0, 0)}


def test_ledger_phases(spark):
    work, phases = tables(spark, [(1, "in_progress", 1, None), (2, "cancelled", 1, None)], [(1, "head", "pending", "latest", 1), (2, "head", "cancelled", "t", 1)])
    assert states(ledger.claim_phase(phases, work, 1, "head", "latest", 0, AS_OF))[1, "head"][0] == "pending"  # an old epoch
    running = ledger.claim_phase(phases, work, 1, "head", "latest", 1, AS_OF)
    assert states(running)[1, "head"][0] == "running"
    assert states(ledger.claim_phase(running, work, 1, "head", "latest", 1, AS_OF)) == states(running)  # only once
    done, after = ledger.finish_phase(running, work, 1, "head", "done", "sha", 1, AS_OF, completed="sha", version="v")
    assert states(done)[1, "head"][0] == "done" and after.where("source_id = 1").first().watermark == "sha"
    failed, after = ledger.finish_phase(running, work, 1, "head", "failed", "sha", 1, AS_OF, reason="time")
    assert states(failed)[1, "head"] == ("failed", 1, 1) and states(after)[1] == ("failed", 1, 1)
    late, after = ledger.finish_phase(running, work, 1, "head", "done", "sha", 0, AS_OF, completed="sha")
    assert states(late) == states(running) and states(after) == states(work)
    assert states(ledger.schedule(phases, work, 2, "head", "t2", 1))[2, "head"][0] == "cancelled"
    assert states(ledger.schedule(phases, work, 2, "head", "t2", 2))[2, "head"] == ("pending", 2, 0)
    assert states(ledger.schedule(phases, work, 1, "history", "t", 1))[1, "history"] == ("pending", 1, 0)
    assert (2, "history") not in states(ledger.schedule(phases, work, 2, "history", "t", 1))
    stopped = ledger.cancel_before(running, work, 2, AS_OF)
    assert states(stopped[0])[1, "head"] == ("cancelled", 1, 0) and states(stopped[1])[1] == ("cancelled", 1, 0)


def test_ledger_requeue(spark):
    rows = [(1, "failed", 0, None), (2, "failed", 0, ledger.GONE), (3, "failed", 0, "time"), (4, "in_progress", 0, None)]
    work, _ = tables(spark, rows)
    assert states(ledger.requeue_failed(work, 1)) == {1: ("failed", 0, 0), 2: ("failed", 0, 0), 3: ("pending", 0, 0), 4: ("in_progress", 0, 0)}
    started = work.withColumn("started_at", F.lit("2023-12-31 23:00:00").cast("timestamp"))
    assert states(ledger.requeue_stale(started, 3600, AS_OF))[4][0] == "in_progress" and states(ledger.requeue_stale(started, 3599, AS_OF))[4][0] == "pending"


def test_incremental(spark):
    work = spark.createDataFrame([(1, "done", "10", "v"), (2, "done", "10", "old")], "source_id long, status string, watermark string, ruleset_version string")
    rows = spark.createDataFrame([(s, q) for s in (1, 2, 3) for q in (5, 10, 11)], "source_id long, seq long")
    got = sorted(tuple(r) for r in ledger.to_scan(rows, work, "v").collect())
    assert got == [(1, 11), (2, 5), (2, 10), (2, 11), (3, 5), (3, 10), (3, 11)]


def test_control():
    ready = {"state": "ready", "epoch": 0, "stop_epoch": None}
    stopping = ledger.control(ready, "stop", AS_OF)
    assert (stopping["state"], stopping["epoch"]) == ("stopping", 1) and ledger.control(stopping, "stop") == stopping
    with pytest.raises(RuntimeError):
        ledger.control(stopping, "admit")
    assert ledger.control(stopping, "finish", AS_OF, 0) == stopping
    stopped = ledger.control(stopping, "finish", AS_OF, 1)
    assert ledger.control(stopped, "admit")["state"] == "ready"
    with pytest.raises(ValueError):
        ledger.control({"state": "odd", "epoch": 1}, "admit")


def test_parameters():
    assert params.listed("a,,b") == ["a", "b"] and params.listed(None) == []
    assert params.positive("12") == 12 and params.members(["head"], ledger.PHASE_NAMES) == ["head"]
    assert params.allowed([], [1, 2]) == [1, 2] and params.allowed([2], [1, 2]) == [2]
    for bad in ("0", "-1", "1.5", "x", "", True, "٣"):
        with pytest.raises(ValueError):
            params.positive(bad)
    for call in (lambda: params.members(["odd"], ["a"]), lambda: params.allowed([3], [1])):
        with pytest.raises(ValueError):
            call()


def test_sorted_view_reverses(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "A"), (3, None), (4, "a")], "source_id int, name string")
    up = [r.source_id for r in findings.sorted_view(rows, "name").collect()]
    assert up == [3, 2, 4, 1] and [r.source_id for r in findings.sorted_view(rows, "name", True).collect()] == up[::-1]
