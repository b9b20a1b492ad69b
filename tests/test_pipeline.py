"""Dataflow, sinks, merge, score and the scans, over one analysed set of small files."""

import ast
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credtrace.functions import batches, matcher
from credtrace.functions import catalog as C
from credtrace.functions import text as T
from credtrace.operators import dataflow as D
from credtrace.plans import pipeline as P
from credtrace.plans import queries as Q
from credtrace.plans import serving
from tests.cases import CASES, frame


@pytest.fixture(scope="module")
def flows(spark):
    rows = (P.analysed(frame(spark)).select("file_path", F.explode("flows").alias("x")).select("file_path", "x.*").collect())
    return {(r.file_path.removeprefix("src/"), r.variable): r for r in rows}


@pytest.fixture(scope="module")
def scored(spark):
    return P.full_scan(frame(spark)).cache()


@pytest.fixture(scope="module")
def per_file(scored):
    out = {}
    for r in scored.orderBy("file_path", "ord").collect():
        out.setdefault(r.file_path.removeprefix("src/"), []).append(r)
    return out


def path(flow):
    return [n.variable for n in flow.nodes]


def test_path_through_alias_dict_and_keyword(flows):
    assert path(flows[("parts.py", "access_key")]) == ["access_key", "auth", "headers.Authorization", "requests.get(headers=headers)"]
    assert flows[("parts.py", "access_key")].sink.sink_type == C.NETWORK


def test_every_kind_of_edge_in_file_order(flows):
    assert path(flows[("flow.py", "api_key")]) == [
        "api_key", "alias", "store[k]", "full", "...send(store)", "early", "fetch(full)"]


def test_taint_follows_file_order(flows):
    assert "later" not in path(flows[("flow.py", "api_key")])
    assert path(flows[("order.js", "token")]) == ["token", "b", "use(b)"]


def test_wider_walk_sees_templates(flows):
    sinks = {(s.sink_type, s.function) for s in flows[("walk.py", "api_key")].direct}
    assert sinks == {(C.LOG, "logger.info"), (C.AUTH, "dict['password']")}


def test_line_sinks_and_containers(flows):
    js = {(s.sink_type, s.line) for s in flows[("client.js", "apiKey")].direct}
    assert {(C.NETWORK, 4), (C.AUTH, 5), (C.LOG, 7)} <= js
    assert {(s.sink_type, s.function) for s in flows[("box.rb", "api_key")].direct} == {(C.NETWORK, "client.post")}


def test_multi_line_call(flows):
    assert {s.sink_type for s in flows[("multi.py", "key")].direct} >= {C.NETWORK, C.LOG}


@pytest.mark.parametrize("function, code, kind", [
    ("requests.get", "requests.get(url)", C.NETWORK), ("httpx.get", "", C.NETWORK), ("fetch", "", C.NETWORK),
    ("print", "print(secret)", C.LOG), ("console.log", "console.log(token)", C.LOG), ("open", "", C.FILE),
    ("conn.execute", "", C.DATABASE), ("f.write", "f.write(x)", None), ("dict_set", '"Authorization": t', C.AUTH),
    ("os.environ.get", "", C.NETWORK)])
def test_classification(spark, function, code, kind):
    row = spark.range(1).select(T.classify_sink(F.lit(function), F.lit(1), F.lit(code)).alias("s")).first()
    assert (row.s.sink_type if row.s else None) == kind


def test_merge(per_file):
    assert [f.methods for f in per_file["client.js"]] == [["reconstruction", "dataflow", "entropy"]]
    assert len(per_file["twice.py"]) == 1
    assert len(per_file["google.py"]) == 1 and per_file["google.py"][0].secret_type == "Google API Key"


def test_a_longer_prefix_tells_apart_what_begins_alike(spark):
    files = frame(spark, {"twice.py": CASES["twice.py"]})
    assert P.full_scan(files).count() == 1 and P.full_scan(files, prefix=24).count() == 2


def test_no_findings_in_clean_files(per_file):
    assert not {"clean.py", "benign.py", "place.py", "env.py", "comment.py"} & set(per_file)


def test_score_parts(scored):
    for r in scored.collect():
        parts = r.detection_score + r.sensitivity_score + r.exposure_score + r.propagation_score
        assert r.risk_score == pytest.approx(parts) and 0 <= r.risk_score <= 100
        floor = [s for s, low in C.SEVERITY_FLOORS.items() if r.risk_score >= low]
        assert r.severity == (floor[0] if floor else "LOW")


def test_rounding_is_half_to_even(spark):
    assert spark.range(1).select(F.bround(F.lit(0.85) * 25, 1)).first()[0] == 21.2


def test_ids_are_stable(spark, scored):
    again = P.full_scan(frame(spark).repartition(3))
    assert {r.finding_id for r in scored.collect()} == {r.finding_id for r in again.collect()}


def test_nothing_raw_is_written(spark, scored, tmp_path):
    safe = serving.safe(scored)
    secrets = {r.secret for r in scored.collect()} | {"QWERTY12", "9f8e7d6c5b4a"}
    text = "\n".join(safe.toJSON().collect()) + "\n".join(r.payload for r in serving.advisory_payload(safe).collect())
    text += "\n".join(str(r.value) for r in serving.report_rows(safe).collect())
    assert not [s for s in secrets if s in text]
    with pytest.raises(ValueError):
        serving.write_findings(scored, str(tmp_path / "raw"))


def test_rewrite_replaces_only_its_scan(spark, scored, tmp_path):
    target = str(tmp_path / "findings")
    safe = serving.safe(scored).cache()
    serving.write_findings(safe, target)
    other = safe.withColumn("scan_id", F.lit("other")).limit(3)
    serving.write_findings(other, target)
    serving.write_findings(other, target)
    counts = {r["scan_id"]: r["count"] for r in serving.read_findings(spark, target).groupBy("scan_id").count().collect()}
    assert counts == {"s": safe.count(), "other": 3}


def test_ablation(spark, scored):
    row = P.compare_scans(scored, P.baseline_scan(frame(spark))).first()
    assert row.rebuilt_full >= 6 and row.rebuilt_baseline < row.rebuilt_full and row.found_by_both > 0


def test_summary_counts(spark, scored):
    row = P.scan_summary(frame(spark), scored).first()
    assert row.total_files == len(CASES) and row.findings_count == scored.count()
    assert row.critical + row.high + row.medium + row.low == row.findings_count


def test_advisory_sections(spark):
    text = "Explanation: why\n\nImpact:\nbad\nREMEDIATION: fix\nCONFIDENCE: high\nEXECUTIVE_SUMMARY:\nall"
    df = spark.createDataFrame([("a", text), ("b", "no headings here")], "finding_id string, response string")
    rows = {r.finding_id: r for r in serving.split_response(df).collect()}
    assert rows["a"][1:] == ("why", "bad", "fix", "high", "all")
    assert rows["b"].explanation == "no headings here" and rows["b"].impact == ""


def test_scan_shuffles_nothing(spark):
    """Findings are merged in the row of their file: no exchange between the file scan and the scored findings."""
    plan = P.full_scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_figures_are_one_pass(spark):
    """The figures of scans come from one scan of the files, and two small exchanges of counters."""
    for rows in (P.scan_figures(frame(spark)), P.ablation(frame(spark))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") <= 2


def test_figures_against_the_findings(spark, scored):
    files = frame(spark)
    row = P.scan_figures(files).first().asDict()
    want = P.scan_summary(files, scored).first().asDict() | P.stage_counts(files).first().asDict()
    assert {k: row[k] for k in want} == want
    compared = P.compare_scans(scored, P.baseline_scan(files)).first().asDict()
    assert P.ablation(files).first().asDict() == compared


def many_seeds(n):
    """A file with n secrets, each with an alias and a call."""
    lines = [x for k in range(n) for x in (f'api_key_{k} = "k3Jd92mxQp01LsTz7Bv{k + 45678}"', f"alias_{k} = api_key_{k}", f"send(alias_{k})")]
    return "\n".join(lines)


def test_seeds_of_a_file_are_followed_in_one_pass():
    """Time for each seed stays flat from a thousand to ten thousand seeds in a file."""
    spent = {}
    for n in (1000, 10000):
        facts = [x for k in range(n) for x in ((3 * k + 2, [f"s{k}"], [f"a{k}"]), (3 * k + 3, [f"a{k}"], []))]
        started = time.time()
        hits, tainted = D.spread(facts, [(f"s{k}", 0) for k in range(n)])
        spent[n] = (time.time() - started) / n
        assert all(len(h) == 2 for h in hits) and tainted[5] == {"s5": 0, "a5": 17}
    assert spent[10000] < 3 * spent[1000]


def test_many_seeds_in_a_file(spark):
    rows = P.analysed(frame(spark, {"many.py": many_seeds(600)})).select(F.explode("flows").alias("x")).select("x.variable", "x.nodes", "x.sink").collect()
    assert len(rows) == 600
    for r in rows:
        k = r.variable.removeprefix("api_key_")
        assert [n.variable for n in r.nodes] == [f"api_key_{k}", f"alias_{k}", f"send(alias_{k})"]


def brute_force_path(source: str, seed: str) -> list[str]:
    """Names tainted from a seed by plain assignments and sums, by walking a syntax tree."""
    tainted, seen = {seed}, [seed]
    for node in ast.parse(source).body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.value, (ast.Name, ast.BinOp)):
            if {n.id for n in ast.walk(node.value) if isinstance(n, ast.Name)} & tainted:
                tainted.add(node.targets[0].id)
                seen.append(node.targets[0].id)
    return seen


def test_taint_against_brute_force(spark):
    rng = random.Random(7)
    cases = {}
    for i in range(40):
        names = [f"v{j}" for j in range(8)] + ["api_key"]
        lines = ['api_key = "k3Jd92mxQp01LsTz7Bv5"']
        for _ in range(25):
            a, b, t = rng.choice(names), rng.choice(names), rng.choice(names[:8])
            lines.append(f"{t} = {a}" if rng.random() < 0.6 else f"{t} = {a} + {b}")
        cases[f"r{i}.py"] = "\n".join(lines)
    rows = P.analysed(frame(spark, cases)).select("file_path", F.explode("flows").alias("x")).filter(
        "x.variable = 'api_key'").select("file_path", F.transform("x.nodes", lambda n: n["variable"]).alias("p")).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert r.p == brute_force_path(cases[r.file_path.removeprefix("src/")], "api_key")


SF = "/root/testdata/sf0.001"


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_the_leak_count_scans_once(spark):
    rows = Q.Q["p21_no_raw_value_left"](spark, SF)
    assert plan_of(rows).count("c_custkey#") and plan_of(rows).count("customer.parquet") == 1
    assert rows.first()["leaks"] == 0


def test_ranking_sorts_an_exchange(spark):
    plan = plan_of(Q.Q["a9_ranked_findings"](spark, SF))
    assert plan.index("Exchange rangepartitioning") < plan.index("Exchange hashpartitioning(scan_id")


def test_audit_events_take_figures_once(spark):
    assert plan_of(Q.Q["s13_audit_events"](spark, SF)).count("customer.parquet") == 1


def test_statements_are_built_once(spark):
    assert "statements" in P.secret_files(frame(spark)).columns


def test_reach_reads_a_batch_by_parts(monkeypatch):
    monkeypatch.setattr(batches, "ROWS", 3)
    fact = lambda pos, srcs, taints: {"pos": pos, "srcs": srcs, "taints": taints}
    rows = [None if k % 4 == 3 else k for k in range(11)]
    given = [{"seeds": [{"variable": f"v{k}", "start": 0}, {"variable": "w", "start": 1}] if k is not None else None,
              "facts": [fact(1, [f"v{k}"], ["w", "x"]), fact(2, ["x", None], [])] if k is not None else None, "walk": [fact(1, ["w"], ["y"])],
              "table": [{"calls": [["a"], ["w", f"v{k}"]], "names": ["w"], "container": "box"}, {"calls": [["box"]], "names": [], "container": ""}]} for k in rows]
    facts = pa.list_(pa.struct([("pos", pa.int32()), ("srcs", pa.list_(pa.string())), ("taints", pa.list_(pa.string()))]))
    kind = pa.struct([("seeds", pa.list_(pa.struct([("variable", pa.string()), ("start", pa.int32())]))), ("facts", facts), ("walk", facts),
                      ("table", pa.list_(pa.struct([("calls", pa.list_(pa.list_(pa.string()))), ("names", pa.list_(pa.string())), ("container", pa.string())])))])
    got = D.reached_by_file(pa.array(given, kind)).to_pylist()
    assert [len(x) for x in got] == [0 if k is None else 2 for k in rows]
    for k, x in zip(rows, got):
        if k is not None:
            assert x[0]["hits"] == [{"fact": 0, "source": f"v{k}", "since": 0}, {"fact": 1, "source": "x", "since": 1}]
            assert x[0]["tainted"] == [{"name": f"v{k}", "time": 0}, {"name": "w", "time": 1}, {"name": "x", "time": 1}]
            assert x[0]["lines"] == [{"line": 0, "call": 1, "pair": -1}] and x[1]["lines"] == [{"line": 0, "call": 1, "pair": 0}]
            assert x[1]["walk"] == [0] and x[1]["boxed"] == [{"line": 1, "call": 0}] and x[0]["boxed"] == []
    assert D.reached_by_file(pa.array([], kind)).to_pylist() == []
