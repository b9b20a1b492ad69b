"""Oracle SQL per registered query; column names equal those of the Spark result."""

from __future__ import annotations

from credtrace.functions import catalog as C
from credtrace.plans import queries as S
from oracle import sql as O
from oracle.sql import NL, lit, match, query

ORACLE = {}

for _c in ("rendered", "documents", "pages", "conversations"):
    ORACLE[f"s1_{_c}_corpus"] = query("SELECT scan_id, repository, file_path, language, size, line_count FROM files", "files", _c)

_pick = lambda words, n: f"[{', '.join(lit(w) for w in words)}][{n} % {len(words)} + 1]"
PATHS = (f"WITH paths AS (SELECT {_pick(S.DIRECTORIES, 'p_partkey')} || '/p' || p_partkey || '/' || "
         f"{_pick(S.NAMES, f'(p_partkey // {len(S.DIRECTORIES)})')} AS file_path FROM part), "
         "named AS (SELECT *, lower(regexp_extract(file_path, '([^/]*)$', 1)) AS base, "
         "lower(regexp_extract(file_path, '(?:^|/)\\.*[^/.][^/]*(\\.[^/.]*)$', 1)) AS ext FROM paths) ")
ORACLE["s2_supported_files"] = PATHS + (
    f"SELECT file_path FROM named WHERE base IN {O.one_of(C.SPECIAL_NAMES)} OR ext IN {O.one_of(C.LANGUAGES)}")
ORACLE["s3_directory_prune"] = PATHS + (
    "SELECT file_path FROM named WHERE NOT list_has_any(string_split(lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1)), '/'), "
    f"[{', '.join(lit(x) for x in C.SKIP_DIRECTORIES + ['b.c'])}])")
ORACLE["s9_language_tag"] = PATHS + (
    "SELECT file_path, CASE WHEN base = 'dockerfile' THEN 'Dockerfile' WHEN starts_with(base, '.env') THEN 'Environment' "
    "WHEN base = 'makefile' THEN 'Makefile' ELSE CASE ext "
    + " ".join(f"WHEN {lit(e)} THEN {lit(n)}" for e, n in C.LANGUAGES.items()) + " ELSE 'Unknown' END END AS language FROM named")
ORACLE["p17_test_path"] = PATHS + (
    f"SELECT file_path, {O.has_any('lower(file_path)', C.TEST_PATH_PARTS)}::INT AS test_path FROM named")
ORACLE["s4_size_gate"] = query("SELECT file_path, size FROM all_files WHERE size BETWEEN 1 AND 4096", "all_files", "documents")
ORACLE["s5_binary_gate"] = "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0"
ORACLE["s6_decode"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 5 <> 0"
ORACLE["s7_minified_gate"] = query(
    "SELECT file_path, (len(ls) >= 3 AND list_sum(list_transform(ls, lambda x: len(x)))::DOUBLE / len(ls) > 500)::INT AS minified FROM all_files",
    "all_files", "documents")
ORACLE["s8_line_count_gate"] = query(f"SELECT file_path, line_count FROM ({O.GATED}) WHERE line_count <= 8", "all_files", "documents")
ORACLE["s10_lines"] = query("SELECT file_path, line_no, line FROM lines", "lines", "documents")
ORACLE["a12_file_summary"] = (
    f"WITH corpus AS (({O.CORPORA['rendered']}) UNION ALL ({O.CORPORA['documents']}) UNION ALL ({O.CORPORA['pages']})), all_files AS ({O.FILES}), files AS (SELECT * FROM all_files), "
    "per AS (SELECT scan_id, language, count(*) AS n, sum(line_count) AS l, sum(size) AS b FROM files GROUP BY scan_id, language) "
    "SELECT scan_id, sum(n)::BIGINT AS total_files, sum(l)::BIGINT AS total_lines, sum(b)::BIGINT AS total_bytes, "
    "string_agg(language || '=' || n, ',' ORDER BY language) AS languages FROM per GROUP BY scan_id")
ORACLE["p1_code_context"] = query("SELECT scan_id, file_path, line_no, ctx AS code_context FROM lines", "lines")

CANDIDATE = ("scan_id, file_path, ord, line_number, \"column\"::BIGINT AS \"column\", value, secret_type, detection_method, round(confidence, 6) AS confidence, "
             "round(entropy_score, 6) AS entropy_score, context_variable, md5(code_context) AS context_md5")
for _c in ("rendered", "documents", "pages", "conversations"):
    ORACLE[f"p2_candidates_{_c}"] = query(f"SELECT {CANDIDATE} FROM raw", "raw", _c)
    ORACLE[f"p19_filtered_{_c}"] = query(f"SELECT {CANDIDATE} FROM filtered", "filtered", _c)
ORACLE["p19_filtered_test_files_allowed"] = query(f"SELECT {CANDIDATE} FROM filtered", "filtered").replace(
    O.has_any("lower(file_path)", C.TEST_PATH_PARTS), "false")
ORACLE["p4_custom_rules"] = query(f"SELECT {CANDIDATE} FROM raw", "raw", "rendered", S.CUSTOM_RULES)
ORACLE["p5_provider_type"] = query("SELECT secret_type, count(*) AS n FROM rule_rows GROUP BY secret_type", "rule_rows")
ORACLE["p6_assigned_variable"] = query(
    f"SELECT scan_id, file_path, line_no, regexp_extract(line, {lit(C.ASSIGNED_VARIABLE)}, 1) AS variable FROM lines", "lines")
ORACLE["p7_context_variable"] = query(
    f"SELECT scan_id, file_path, ord, {O.context_variable('code_context', 'value')} AS variable FROM raw", "raw")
WORDS = ("WITH words AS (SELECT c_custkey, unnest([md5(c_name), to_base64(encode(md5(c_name))), c_name, c_mktsegment, '', repeat('a', 12)]) AS value FROM customer) ")
ORACLE["p8_entropy"] = WORDS + f"SELECT c_custkey, value, round({O.entropy('value')}, 6) AS entropy FROM words"
ORACLE["p9_string_class"] = WORDS + (
    f"SELECT c_custkey, value, {O.string_class('value')} AS string_class, {O.threshold('value')} AS threshold FROM words")
ORACLE["r13_value_type"] = WORDS + f"SELECT c_custkey, value, {O.reconstructed_type('value')} AS secret_type FROM words"
ORACLE["p10_literals"] = query(
    f"SELECT file_path, line_no, unnest(regexp_extract_all(line, {lit(C.QUOTED_LITERAL)}, 1)) AS value FROM lines", "lines", "pages")
ORACLE["p12_credential_keywords"] = query(
    f"SELECT file_path, line_no, {O.has_any('lower(line)', C.CREDENTIAL_KEYWORDS)}::INT AS has_keyword FROM lines", "lines", "documents")
ORACLE["p13_entropy_candidates"] = query(f"SELECT {CANDIDATE} FROM raw WHERE detection_method = 'entropy'", "raw")


def _varied(*shapes) -> str:
    return f"CASE c_custkey % {len(shapes)} " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes)) + " END"


H = "md5(c_name)"
ORACLE["p14_placeholders"] = (
    "SELECT c_custkey, value, (" + O.placeholder("value") + ")::INT AS placeholder FROM (SELECT c_custkey, " + _varied(
        "c_name", H, "'your_' || c_name", f"'Test' || {H}", f"{H} || 'YourKeyHere'", f"repeat(left({H}, 1), 9)", f"repeat(left({H}, 2), 6)",
        f"repeat(left({H}, 3), 5)", "'changeme'", "' Password '", "'a-b_a-b'", f"repeat(left({H}, 3), 4)") + " AS value FROM customer)")
ORACLE["p15_environment_source"] = query(
    f"SELECT scan_id, file_path, line_no, line FROM lines WHERE {match('line', C.ENVIRONMENT_SOURCE)}", "lines")
_L = f"('key = \"' || {H} || '\"')"
_j = lambda *xs: f" || {NL} || ".join(x if x == _L else lit(x) for x in xs)
ORACLE["p16_documentation_context"] = (
    "SELECT c_custkey, context, " + O.documentation("context") + "::INT AS documentation FROM (SELECT c_custkey, " + _varied(
        _L, _j("# Example: use this", _L), _j('"""doc', _L), _j('"""doc"""', _L), _j("/* open", _L, "x"), _j("/* open */", _L),
        _j("a", "b", "// e.g. a demo", _L, "c"), _j(">>> run()", _L), _j("* @param x", _L), _j("# TODO later", _L), _j("'''", "'''", _L),
        _j("plain", _L, "plain")) + " AS context FROM customer)")
_CONTEXTS = ORACLE["p16_documentation_context"].split("FROM (", 1)[1]
ORACLE["p11_comment_lines"] = (
    f"SELECT c_custkey, line FROM (SELECT c_custkey, unnest(string_split(context, {NL})) AS line FROM ({_CONTEXTS}) WHERE "
    f"starts_with({O.trim('line')}, '#') OR starts_with({O.trim('line')}, '//') OR starts_with({O.trim('line')}, '*')")
ORACLE["p18_config_variable"] = (
    "SELECT c_custkey, name, " + match("name", C.CONFIG_VARIABLE) + "::INT AS config FROM (SELECT c_custkey, " + _varied(
        "lower(c_mktsegment)", "'default_' || c_mktsegment", "'MockKey'", "'api_key'", "'my_Template'") + " AS name FROM customer)")
ORACLE["p20_mask"] = f"SELECT c_custkey, value, {O.mask('value')} AS masked FROM (SELECT c_custkey, left({H}, (c_custkey % 20)::INT) AS value FROM customer)"

# ---- reconstruction ----
ORACLE["r1_symbols"] = query(
    "SELECT scan_id, file_path, target AS variable, p.t AS value, line_no FROM parts p WHERE kind = 'literal'", "level3")
ORACLE["r2_aliases"] = query(
    "SELECT d.scan_id, d.file_path, d.target AS variable, v.value, d.line_no FROM defs d JOIN level3 v USING (scan_id, file_path, stmt_no) "
    "WHERE d.kind = 'name' AND v.value IS NOT NULL", "level3")
REBUILT = "scan_id, file_path, ord, target, line_no, kind, value, status"
for _n, _k in (("r3_concatenation", "concat"), ("r4_r8_templates", "template"), ("r7_base64", "decode")):
    ORACLE[_n] = query(f"SELECT {REBUILT} FROM recons WHERE kind = '{_k}'", "recons")
_A, _B = f"left({H}, 16)", f"right({H}, 16)"
ORACLE["r5_format_r6_join_r9_languages"] = " UNION ALL ".join(
    f"SELECT 'm' || c_custkey || '.{e}' AS file_path, '{t}' AS target, '{k}' AS kind, {v} AS value, '{s}' AS status FROM customer"
    for e, t, k, v, s in (
        ("py", "by_format", "format", f"{_A} || '-' || {_B}", "FULL"), ("py", "by_join", "join", f"{_A} || '/x/' || {_B}", "FULL"),
        ("py", "late", "concat", f"{_A} || '/x/' || {_B}", "PARTIAL"), ("py", "nothing", "concat", "''", "UNRESOLVED"),
        ("js", "both", "concat", f"{_A} || '.' || {_B}", "FULL"), ("js", "wrapped", "template", f"'<' || {_A} || '.' || {_B} || '>'", "FULL")))
ORACLE["r10_status_counts"] = query("SELECT kind, status, count(*) AS n FROM recons GROUP BY kind, status", "recons")
ORACLE["r11_fragments"] = query(
    "SELECT f.scan_id, f.file_path, r.target, row_number() OVER (PARTITION BY f.scan_id, f.file_path, f.stmt_no ORDER BY pos) - 1 AS pos, variable, "
    "coalesce(f.value, '') AS value, f.line, resolved::INT AS resolved FROM fragments f JOIN recons r USING (scan_id, file_path, stmt_no)", "fragments")
# Values that double: their unit, how often it stands in them, and what is behind it.
_KEY, _UNIT = "('AKIA' || upper(left(md5(n_name), 16)))", "(md5(n_name) || '!')"
_LONG = " UNION ALL ".join(
    f"SELECT '{stem}' || n_nationkey || '.py' AS file_path, '{target}' AS target, '{kind}' AS kind, {unit} AS unit, {times}::BIGINT AS times, '{tail}' AS tail, "
    f"'{type_}' AS secret_type FROM nation"
    for stem, target, kind, unit, times, tail, type_ in (
        ("chain", "a1", "concat", _KEY, 2, "", "AWS Access Key"), ("chain", "a17", "concat", _KEY, 2 ** 17, "", "AWS Access Key"),
        ("chain", "a40", "concat", _KEY, 2 ** 40, "", "AWS Access Key"), ("coded", "dec", "decode", _UNIT, 2 ** 15, "", "API Key"),
        ("coded", "tail", "concat", _UNIT, 2 ** 15, "?", "API Key")))
ORACLE["r3_r7_long_values"] = (
    f"WITH v AS ({_LONG}), n AS (SELECT *, len(unit) * times + len(tail) AS length FROM v), "
    "c AS (SELECT file_path, target, c, sum(k)::DOUBLE AS k FROM (SELECT file_path, target, unnest(string_split(unit, '')) AS c, times AS k FROM n "
    "UNION ALL SELECT file_path, target, tail, 1 FROM n WHERE tail <> '') GROUP BY ALL), "
    "e AS (SELECT file_path, target, -sum(k / length * log2(k / length)) AS entropy FROM c JOIN n USING (file_path, target) GROUP BY ALL) "
    f"SELECT file_path, target, kind, 'FULL' AS status, length, round(entropy, 6) AS entropy, secret_type, (entropy >= {C.RECONSTRUCTED_MIN_ENTROPY})::INT AS is_secret, "
    f"CASE WHEN entropy < {C.RECONSTRUCTED_MIN_ENTROPY} THEN 'low entropy' ELSE '' END AS reason, "
    f"md5(left(repeat(unit, least(times, {C.MAX_FILE_SIZE} // len(unit) + 1)) || tail, {C.MAX_FILE_SIZE})) AS shown_md5 FROM n JOIN e USING (file_path, target)")
ORACLE["r12_validation"] = query(
    f"SELECT {REBUILT}, (reason = '')::INT AS is_secret, round(confidence, 6) AS confidence, secret_type, reason FROM checked", "checked")

# ---- dataflow and sinks ----
ORACLE["d1_seeds"] = query("SELECT scan_id, file_path, variable, line, value FROM seeds", "seeds")
NODE = "scan_id, file_path, seed, ord, variable, line, operation, source, target, edge, snippet"


def _nodes(where: str) -> str:
    return query(f"SELECT {NODE} FROM nodes JOIN (SELECT scan_id, file_path, language FROM files) USING (scan_id, file_path) WHERE {where}", "nodes")


for _n, _ops in (("d2_assign_edges", ["assignment"]), ("d3_dict_edges", ["dict_value"]),
                 ("d6_d8_argument_edges", ["function_argument"]), ("d7_keyword_edges", ["keyword_argument"])):
    ORACLE[_n] = _nodes(f"language = 'Python' AND operation IN {O.one_of(_ops)}")
ORACLE["d9_line_edges"] = _nodes("language <> 'Python'")
ORACLE["d10_taint_closure"] = query("SELECT scan_id, file_path, seed, name FROM taint", "taint")
ORACLE["d11_paths"] = query("SELECT scan_id, file_path, seed, array_to_string(path, ' → ') AS path, len(path) AS length FROM paths", "paths")
FUNCTIONS = (f", called AS (SELECT DISTINCT unnest(regexp_extract_all(line, {lit(O.LINE_CALL)}, 1)) AS fn FROM lines), fns AS (SELECT DISTINCT unnest([fn, 'x.' || fn, fn || '.more', upper(fn), "
             "'a.b.' || string_split(fn, '.')[-1]]) AS function FROM called) ")


def _functions(final: str) -> str:
    return query("", "line_calls") + FUNCTIONS + final


ORACLE["k1_sink_match"] = _functions("SELECT function, " + ", ".join(
    f"{O.sink_match('function', names)}::INT AS {label}" for label, names in (
        ("network", C.NETWORK_SINKS), ("log", C.LOG_SINKS), ("file", C.FILE_SINKS), ("database", C.DATABASE_SINKS))) + " FROM fns")
_code = "('send(password, ' || function || ')')"
ORACLE["k2_classify_sink"] = _functions(
    f"SELECT function, kind AS sink_type, {O.sink_risk('kind')} AS risk_level, {O.sink_description('kind', 'function', _code)} AS description "
    f"FROM (SELECT function, {O.classify('function', _code)} AS kind FROM fns)")
SINK = "scan_id, file_path, seed, sink_type, risk_level, function, line, code, description"
ORACLE["k3_graph_sinks"] = query(f"SELECT {SINK} FROM graph_sinks", "graph_sinks")
ORACLE["k4_statement_sinks"] = query(f"SELECT {SINK} FROM statement_sinks", "statement_sinks")
ORACLE["k5_line_sinks"] = query(f"SELECT {SINK} FROM line_sinks", "line_sinks")
ORACLE["k7_direct_sinks"] = query(f"SELECT {SINK} FROM direct", "direct")
ORACLE["k8_best_sink"] = query(
    "SELECT scan_id, file_path, seed, sink.sink_type AS sink_type, sink.risk_level AS risk_level, sink.function AS function, sink.line AS line FROM best", "best")
ORACLE["k6_container_sinks"] = " UNION ALL ".join(
    f"SELECT 'c' || c_custkey || '.rb' AS file_path, 'api_key' AS seed, {lit(k)} AS sink_type, '{fn}' AS function, {line} AS line FROM customer"
    for k, fn, line in ((C.NETWORK, "client.post", 4), (C.LOG, "print", 5)))

# Edges of the woven files follow from how they are written.
_EDGES = (
    ("d2_assign_edges", 2, "alias", "assignment", "api_key", "alias", "assignment", "alias = api_key"),
    ("d4_subscript", 3, "headers[X-Key]", "subscript_assignment", "alias", "headers[X-Key]", "subscript_assignment", 'headers["X-Key"] = alias'),
    ("d5_concat", 4, "full", "concatenation", "alias", "full", "concatenation", 'full = "a" + "b" + alias'),
    ("d5_concat", 5, "both", "concatenation", "alias", "both", "concatenation", "both = full + api_key + alias"),
    ("d6_argument", 6, "...push(headers)", "function_argument", "headers", "...push()", "parameter_pass", "app.sink.push(headers, both)"),
    ("d6_argument", 6, "...push(both)", "function_argument", "both", "...push()", "parameter_pass", "app.sink.push(headers, both)"),
    ("d7_keyword", 7, "send(**kwargs=both)", "keyword_argument", "both", "send(**kwargs=)", "parameter_pass", "out = send(1, **both)"))
ORACLE["d4_d5_woven_edges"] = " UNION ALL ".join(
    f"SELECT 'w' || c_custkey || '.py' AS file_path, {i} AS ord, {line}::BIGINT AS line, {lit(v)} AS variable, {lit(op)} AS operation, "
    f"{lit(src)} AS source, {lit(tgt)} AS target, {lit(edge)} AS edge, {lit(code)} AS snippet FROM customer"
    for i, (_n, line, v, op, src, tgt, edge, code) in enumerate(_EDGES, 1))

ORACLE["d5_d6_nested_brackets"] = " UNION ALL ".join(
    f"SELECT 'n' || c_custkey || '.py' AS file_path, {i} AS ord, {line}::BIGINT AS line, '{v}' AS variable, '{op}' AS operation, 'api_key' AS source, "
    f"'{tgt}' AS target, '{edge}' AS edge FROM customer"
    for i, (line, v, op, tgt, edge) in enumerate((
        (2, "send(api_key)", "function_argument", "send()", "parameter_pass"), (2, "send(x=api_key)", "keyword_argument", "send(x=)", "parameter_pass"),
        (3, "full", "concatenation", "full", "concatenation")), 1))

# ---- findings ----
ORACLE["j2_j3_findings_with_flow"] = query(
    "SELECT scan_id, file_path, method, secret, line_number, variable, coalesce(array_to_string(path, ' → '), '') AS path, "
    "coalesce(sink.sink_type, '') AS sink_type FROM raw_findings", "raw_findings")
ORACLE["j4_a1_merge_groups"] = query("SELECT scan_id, file_path, method, secret, line_number, group_key FROM raw_findings", "raw_findings")
FINDING = ("scan_id, file_path, repository, secret, line_number, secret_type, round(confidence, 6) AS confidence, round(entropy_score, 6) AS entropy_score, "
           "array_to_string(methods, ',') AS methods, status, coalesce(array_to_string(path, ' → '), '') AS path, coalesce(sink.sink_type, '') AS sink_type")
ID = "left(sha256(scan_id || '|' || file_path || '|' || CAST(ord AS VARCHAR)), 16) AS finding_id"
SCORES = ", ".join(S.SCORES)
ORACLE["a2_merged_findings"] = query(f"SELECT {FINDING}, group_key, {ID} FROM merged", "merged")
ORACLE["a3_a8_full_scan"] = query(f"SELECT {FINDING}, {SCORES} FROM scored", "scored")
for _c in ("documents", "pages"):
    ORACLE[f"a3_a8_full_scan_{_c}"] = query(f"SELECT {FINDING}, {SCORES} FROM scored", "scored", _c)
ORACLE["a9_ranked_findings"] = query(f"SELECT scan_id, file_path, {ID}, risk_score FROM scored", "scored")
ORACLE["a10_a11_severity_counts"] = query(
    "SELECT scan_id, findings_count, critical, high, medium, low, risk_score FROM counts", "counts")
ORACLE["a13_stage_counts"] = query("SELECT scan_id, candidates_found, secrets_reconstructed FROM stages", "stages")
ORACLE["a14_baseline_scan"] = query(f"SELECT {FINDING}, {SCORES} FROM baseline", "baseline")
ORACLE["a14_baseline_scan_documents"] = query(f"SELECT {FINDING}, {SCORES} FROM baseline", "baseline", "documents")
ORACLE["a15_ablation"] = query(
    "SELECT scan_id, count(*) FILTER (WHERE f AND b) AS found_by_both, count(*) FILTER (WHERE f AND NOT b) AS only_full, "
    "count(*) FILTER (WHERE b AND NOT f) AS only_baseline, count(*) FILTER (WHERE f AND rebuilt) AS rebuilt_full, "
    "count(*) FILTER (WHERE b AND coalesce(rebuilt, false)) AS rebuilt_baseline FROM (SELECT coalesce(x.scan_id, y.scan_id) AS scan_id, x.scan_id IS NOT NULL AS f, y.scan_id IS NOT NULL AS b, rebuilt "
    "FROM (SELECT scan_id, file_path, group_key AS key, status <> 'NONE' AS rebuilt FROM scored) x FULL JOIN (SELECT DISTINCT scan_id, file_path, left(secret, 12) AS key FROM baseline) y "
    "ON x.scan_id = y.scan_id AND x.file_path = y.file_path AND x.key = y.key) GROUP BY scan_id", "baseline")
ORACLE["labelled_documents"] = query(
    "SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS documents, sum(n)::BIGINT AS findings FROM "
    "(SELECT regexp_extract(file_path, '^doc-([0-9]+)$', 1)::BIGINT AS doc_id, count(*) AS n FROM baseline GROUP BY file_path) LEFT JOIN labels USING (doc_id) GROUP BY quality, toxic",
    "baseline", "documents")

# ---- serving ----
SHOWN = ("coalesce((SELECT string_agg(f.variable || ':' || CASE WHEN f.resolved THEN " + O.mask("f.value") + " ELSE '[DYNAMIC]' END || ':' || f.line || ':' || f.resolved::INT, ',' ORDER BY f.pos) "
         "FROM fragments f WHERE f.scan_id = s.scan_id AND f.file_path = s.file_path AND f.stmt_no = s.stmt_no), '')")
ORACLE["p21_safe_findings"] = query(
    f"SELECT scan_id, file_path, {ID}, {O.mask('secret')} AS masked_secret, status AS reconstruction_status, coalesce({O.mask('rebuilt_value')}, '') AS reconstructed_value_masked, "
    f"round_even(entropy_score, 3) AS entropy_score, {SHOWN} AS fragments, coalesce(sink.sink_type, '') AS exposure_type, risk_score, severity FROM scored s", "scored")
ORACLE["p21_no_raw_value_left"] = query("SELECT count(*) AS findings, 0 AS leaks FROM scored", "scored")
_known = (
    "SELECT scan_id, file_path, list(v ORDER BY len(v) DESC, v) AS vs FROM (SELECT scan_id, file_path, value AS v FROM raw UNION SELECT scan_id, file_path, value FROM secrets "
    "UNION SELECT f.scan_id, f.file_path, f.value FROM fragments f JOIN secrets USING (scan_id, file_path, stmt_no) WHERE f.resolved AND len(f.value) >= 4) GROUP BY ALL")
ORACLE["p22_redacted_context"] = query(
    f"SELECT scan_id, file_path, {ID}, list_reduce([context] || vs, lambda t, v: replace(t, v, {O.mask('v')})) AS code_context FROM scored LEFT JOIN ({_known}) USING (scan_id, file_path)",
    "scored")
_path = "coalesce(array_to_string(path, ' → '), '')"
_head = (
    "'- Secret Type: ' || secret_type || chr(10) || '- Severity: ' || severity || chr(10) || '- Risk Score: ' || printf('%.1f', risk_score) || '/100' || chr(10) || '- Masked Secret: ' || "
    f"{O.mask('secret')} || chr(10) || '- File: ' || file_path || chr(10) || '- Line: ' || line_number || chr(10) || '- Detection Methods: ' || array_to_string(methods, ', ') || chr(10) "
    f"|| '- Reconstruction Status: ' || status || chr(10) || '- Propagation Path: ' || CASE WHEN {_path} = '' THEN 'None' ELSE {_path} END || chr(10) || '- Exposure Sink: ' || coalesce(sink.sink_type, 'None identified') "
    "|| CASE WHEN sink IS NULL THEN '' ELSE chr(10) || '- Exposure Description: ' || sink.description END")
ORACLE["p22_advisory_payload"] = query(
    f"SELECT scan_id, finding_id, len(head) + 15 + least(300, len(context)) AS n, head FROM (SELECT scan_id, {ID}, {_head} AS head, context FROM scored)", "scored")
ORACLE["p23_split_response"] = (
    "SELECT finding_id, md5(CASE WHEN conv_id % 3 = 0 THEN " + O.trim("text") + " ELSE " + O.trim("text") + " END) AS explanation_md5, CASE WHEN conv_id % 3 = 0 THEN '' ELSE role END AS impact, "
    "CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'rotate it' END AS remediation, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'high' END AS confidence_assessment, "
    "CASE WHEN conv_id % 3 = 0 THEN '' ELSE finding_id END AS executive_summary FROM (SELECT *, conv_id || '-' || turn AS finding_id FROM conversations)")
_rows = [
    ("Finding", "secret_type || ' [' || severity || ']'", "true"), ("File", "file_path", "true"), ("Line", "line_number::VARCHAR", "true"),
    ("Risk Score", "printf('%.1f/100', risk_score)", "true"), ("Detection", "array_to_string(methods, ', ')", "true"), ("Masked Secret", O.mask("secret"), "true"),
    ("Reconstruction Status", "status", "status <> 'NONE'"), ("Propagation Path", _path, f"{_path} <> ''"),
    ("Exposure", "sink.sink_type || ' (' || sink.risk_level || ')'", "sink IS NOT NULL"), ("Exposure Description", "sink.description", "sink IS NOT NULL")]
ORACLE["p24_report_rows"] = query(
    "SELECT label, count(*) AS n, count(DISTINCT value) AS distinct_values FROM ("
    + " UNION ALL ".join(f"SELECT {lit(a)} AS label, {v} AS value FROM scored WHERE {w}" for a, v, w in _rows)
    + " UNION ALL SELECT 'Fragment', f.variable || ': ' || CASE WHEN f.resolved THEN " + O.mask("f.value") + " ELSE '[DYNAMIC]' END || ' (line ' || f.line || ')' "
    "FROM scored s JOIN fragments f USING (scan_id, file_path, stmt_no)) GROUP BY label", "scored")
SCAN = ", ".join(S.SCAN_COLUMNS)
ORACLE["q1_list_scans"] = query(f"SELECT {SCAN}, strftime(created_at, '%Y-%m-%d') AS created_on FROM scans", "scans")
ORACLE["q2_scan_by_id"] = query(f"SELECT {SCAN} FROM scans WHERE scan_id = 'scan-3'", "scans")
ORACLE["q3_findings_of_scan"] = query(
    f"SELECT scan_id, file_path, {ID}, secret_type, risk_score, severity FROM scored WHERE scan_id = 'scan-3'", "scored")
ORACLE["q4_finding_by_id"] = query(
    f"SELECT * FROM (SELECT scan_id, file_path, {ID}, secret_type, {O.mask('secret')} AS masked_secret FROM scored) WHERE finding_id = '{S.FINDING_ID}'", "scored")
ORACLE["q5_severity_filter"] = query(f"SELECT scan_id, file_path, {ID}, severity FROM scored WHERE severity = 'CRITICAL'", "scored")
TOTALS = ("count(*) AS total_scans, count(*) FILTER (WHERE status = 'completed') AS completed_scans, (sum(findings_count) FILTER (WHERE status = 'completed'))::BIGINT AS total_findings, "
          + ", ".join(f"(sum({s.lower()}) FILTER (WHERE status = 'completed'))::BIGINT AS total_{s.lower()}" for s in C.SEVERITIES)
          + ", round(avg(risk_score) FILTER (WHERE status = 'completed'), 6) AS average_risk")
ORACLE["q6_portfolio_totals"] = query(f"SELECT {TOTALS} FROM scans", "scans")
ORACLE["q7_severity_distribution"] = query(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{s.capitalize()}' AS name, (sum({s.lower()}) FILTER (WHERE status = 'completed'))::BIGINT AS value FROM scans" for s in C.SEVERITIES) + ") WHERE value > 0", "scans")
ORACLE["q8_recent_scans"] = query("SELECT scan_id, repository, status FROM scans ORDER BY created_at DESC, scan_id LIMIT 5", "scans")
ORACLE["q8_recent_risks"] = query(
    "SELECT scan_id, left(repository, 12) AS name, risk_score AS risk FROM scans WHERE status = 'completed' ORDER BY created_at DESC, scan_id LIMIT 8", "scans")
ORACLE["q9_history"] = query(
    "SELECT repository, status, files_scanned, findings_count, critical, high, printf('%.1f', risk_score) AS risk_score, secrets_reconstructed, "
    "CASE WHEN scan_duration > 0 THEN printf('%.1f', scan_duration + 1e-9) || 's' ELSE 'N/A' END AS duration, strftime(created_at, '%Y-%m-%d') AS date FROM scans", "scans")
WORKLIST = (f"SELECT * FROM (SELECT *, {ID}, row_number() OVER (PARTITION BY scan_id ORDER BY risk_score DESC, file_path, ord) AS rank FROM scored WHERE risk_score >= 30) WHERE rank <= 10")
ORACLE["q10_advisory_worklist"] = query(f"SELECT scan_id, file_path, finding_id, risk_score, rank FROM ({WORKLIST})", "scored")
ORACLE["q11_advisory_merge"] = query(
    f"SELECT s.finding_id, CASE WHEN w.finding_id IS NULL THEN '' ELSE s.secret_type || chr(10) || 'REMEDIATION: rotate' END AS ai_explanation, CASE WHEN w.finding_id IS NULL THEN '' ELSE 'rotate' END AS ai_remediation, "
    f"'' AS ai_impact, CASE WHEN w.finding_id IS NULL THEN 'pending' ELSE 'completed' END AS ai_analysis_status FROM (SELECT *, {ID} FROM scored) s LEFT JOIN ({WORKLIST}) w USING (finding_id)", "scored")
ORACLE["s11_findings_store"] = query(
    f"SELECT scan_id, file_path, {ID}, {O.mask('secret')} AS masked_secret, risk_score, severity, 'pending' AS ai_analysis_status FROM scored", "scored")
ORACLE["s11_findings_of_scan_store"] = ORACLE["q3_findings_of_scan"]
ORACLE["s12_scan_store"] = query(f"SELECT {SCAN} FROM scans", "scans")
ORACLE["q12_report_header"] = query(
    "SELECT scan_id, repository, status, findings_count AS total_findings, printf('%.1f/100', risk_score) AS average_risk_score, files_scanned, total_lines AS lines_analyzed, "
    "CASE WHEN scan_duration > 0 THEN printf('%.2fs', scan_duration + 1e-9) ELSE 'N/A' END AS scan_duration, secrets_reconstructed, critical, high, medium, low FROM scans", "scans")
ORACLE["s13_audit_events"] = query(
    "SELECT 'scan_created' AS action, scan_id, 'Repository: ' || repository AS details FROM scans UNION ALL "
    "SELECT 'scan_completed', scan_id, 'Found ' || findings_count || ' findings' FROM scans WHERE status = 'completed'", "scans")
ORACLE["s13_audit_counts"] = "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type"
