"""Common table expressions the oracle queries are put together from.

They follow the same rules as the Spark plans by other means: joins, recursive queries and unrolled levels instead of
folds. Statement extraction only knows the forms that occur in the rendered corpus.
"""

from __future__ import annotations

from credtrace.functions import catalog as C

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def one_of(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def has_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def match(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def entropy(x: str) -> str:
    """Bits per character of a column."""
    chars = f"string_split({x}, '')"
    share = f"(len(list_filter({chars}, lambda y: y = ch))::DOUBLE / len({x}))"
    return (f"(CASE WHEN len({x}) = 0 THEN 0.0::DOUBLE ELSE abs(list_sum(list_transform(list_distinct({chars}), "
            f"lambda ch: {share} * log2({share})))) END)")


def mask(x: str) -> str:
    return (f"(CASE WHEN len({x}) <= 8 THEN repeat('*', len({x})) "
            f"ELSE left({x}, 4) || repeat('*', len({x}) - 8) || right({x}, 4) END)")


def trim(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


STRING_CLASS = ("(CASE WHEN regexp_full_match({v}, '[0-9a-fA-F]+') THEN 'hex' "
                "WHEN regexp_full_match({v}, '[A-Za-z0-9+/=_-]+') THEN 'base64' ELSE 'general' END)")


def string_class(v: str) -> str:
    return STRING_CLASS.format(v=v)


def threshold(v: str) -> str:
    return f"(CASE {string_class(v)} WHEN 'hex' THEN 3.0 WHEN 'base64' THEN 4.0 ELSE 4.5 END)::DOUBLE"


def provider(v: str, default: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'starts_with({v}, {lit(p)})' for p in ps)} THEN {lit(n)}"
                     for ps, n in C.PROVIDER_PREFIXES)
    return f"(CASE {whens} ELSE {default} END)"


def placeholder(v: str) -> str:
    units = " OR ".join(f"(len({v}) % {k} = 0 AND len({v}) // {k} >= 5 "
                        f"AND {v} = repeat(left({v}, {k}), (len({v}) // {k})::INT))" for k in (1, 2, 3))
    letters = f"replace(replace({v}, '-', ''), '_', '')"
    return (f"(lower({trim(v)}) IN {one_of(C.PLACEHOLDER_VALUES)} OR {match(v, C.PLACEHOLDER_PREFIX)} "
            f"OR {has_any(f'lower({trim(v)})', C.PLACEHOLDER_SUBSTRINGS)} OR {units} "
            f"OR len(list_distinct(string_split({letters}, ''))) <= 2)")


def middle(ctx: str) -> str:
    ls = f"string_split({ctx}, {NL})"
    return f"{ls}[len({ls}) // 2 + 1]"


def documentation(ctx: str) -> str:
    step = ("CASE WHEN contains(l, '*/') THEN '0' WHEN contains(l, '/*') THEN '1' "
            "WHEN contains(l, '\"\"\"') OR contains(l, '''''''''''''') THEN (CASE s WHEN '1' THEN '0' ELSE '1' END) ELSE s END")
    step = step.replace("'''''''''''''')", "'''''''')")
    state = f"list_reduce(list_prepend('0', string_split({ctx}, {NL})), lambda s, l: {step})"
    mid = trim(middle(ctx))
    return (f"({match(ctx, C.DOCUMENTATION_MARKER)} OR ((starts_with({mid}, '#') OR starts_with({mid}, '//')) "
            f"AND {has_any(f'lower({mid})', C.DOCUMENTATION_WORDS)}) OR {state} = '1')")


def context_variable(ctx: str, value: str) -> str:
    ls = f"string_split({ctx}, {NL})"
    hits = f"list_filter({ls}, lambda l: contains(l, {value}))"
    return f"regexp_extract(coalesce({hits}[1], {middle(ctx)}), {lit(C.CONTEXT_VARIABLE)}, 1)"


def reconstructed_type(v: str) -> str:
    whens = " ".join(f"WHEN {match(v, p)} THEN {lit(n)}" for p, n in C.RECONSTRUCTED_TYPES)
    return f"(CASE {whens} ELSE {lit(C.RECONSTRUCTED_DEFAULT)} END)"


def sink_match(fn: str, names) -> str:
    low = sorted({n.lower() for n in names})
    tails = sorted({n.split('.')[-1] for n in low if '.' in n})
    exact = f"lower({fn}) IN {one_of(low)} OR " + " OR ".join(f"starts_with(lower({fn}), {lit(n + '.')})" for n in low)
    if tails:
        exact += f" OR (contains({fn}, '.') AND (" + " OR ".join(f"ends_with(lower({fn}), {lit(t)})" for t in tails) + "))"
    return f"({exact})"


def classify(fn: str, code: str) -> str:
    """Sink type of a call, null for none."""
    whens = " ".join(f"WHEN {sink_match(fn, names)} THEN {lit(kind)}" for kind, _, names, _, _ in C.SINK_CATALOG)
    return f"(CASE {whens} WHEN {has_any(f'lower({code})', C.AUTH_KEYS)} THEN {lit(C.AUTH)} END)"


def sink_description(kind: str, fn: str, code: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(a)} || {fn} || {lit(b)}" for k, _, _, a, b in C.SINK_CATALOG)
    word = "CASE " + " ".join(f"WHEN contains(lower({code}), {lit(k)}) THEN {lit(k)}" for k in C.AUTH_KEYS) + " END"
    return f"(CASE {kind} {whens} ELSE 'Secret used in authentication context (''' || {word} || ''')' END)"


def sink_risk(kind: str) -> str:
    return (f"(CASE {kind} WHEN {lit(C.NETWORK)} THEN 'HIGH' WHEN {lit(C.AUTH)} THEN 'HIGH' WHEN {lit(C.LOG)} "
            f"THEN 'LOW' ELSE 'MEDIUM' END)")


def sink_rank(kind: str) -> str:
    return "(CASE " + kind + " " + " ".join(f"WHEN {lit(k)} THEN {p}" for k, p in C.SINK_PRIORITY.items()) + " ELSE 0 END)"


# ---- corpora ----

def _rendered() -> str:
    q = "'\"'"
    def a(name, value, head="", tail=""):
        return f"'{head}{name} = ' || {q} || {value} || {q} || '{tail}'"
    h, u = "md5(c_name)", "upper(md5(c_name))"
    a8, b8 = f"substr({u}, 1, 8)", f"substr({u}, 9, 8)"
    shapes = [
        ("aws", "py", [a("AWS_KEY", f"'AKIA' || substr({u}, 1, 16)")]),
        ("frag", "py", [a("part1", "'AKIA'"), a("part2", a8), a("part3", b8),
                        "'access_key = part1 + part2 + part3'", "'auth = access_key'", "'headers = {'",
                        "'    \"Authorization\": auth'", "'}'",
                        "'requests.get(\"https://svc.invalid\", headers=headers)'"]),
        ("alias", "py", [a("api_token", h), "'alias = api_token'", "'print(alias)'"]),
        ("db", "py", [a("scheme", "'mongodb+srv'"), a("user", "'svc'"), a("pw", f"substr({h}, 1, 12)"),
                      a("host", f"'h' || substr({h}, 1, 6) || '.invalid'"), a("name", "'prod'"),
                      "'conn = f\"{scheme}://{user}:{pw}@{host}/{name}\"'", "'cursor.execute(conn)'"]),
        ("mixed", "py", [a("static_part", f"'prefix_' || {a8} || '_'"), "'n1 = 1'", "'n2 = 2'", "'n3 = 3'", "'n4 = 4'",
                         "'n5 = 5'", "'dynamic_part = os.environ.get(\"SUFFIX\")'",
                         "'mixed_key = static_part + dynamic_part'"]),
        ("client", "js", [a("p1", "'AIza'", "const ", ";"), a("p2", h, "const ", ";"), "'const apiKey = p1 + p2;'",
                          "'axios.post(\"https://svc.invalid\", apiKey);'", "'console.log(apiKey);'"]),
        ("tpl", "js", [a("kind", "'Bearer'", "const ", ";"), a("body", h, "const ", ";"),
                       "'const authValue = `${kind} ${body}`;'", "'const wrapped = authValue;'",
                       "'fetch(\"https://svc.invalid\", { headers: { \"Authorization\": wrapped } });'"]),
        ("conf", "py", ["'API_KEY = os.environ.get(\"API_KEY\", \"\")'",
                        "'DATABASE_URL = os.environ.get(\"DATABASE_URL\", \"\")'",
                        "'SECRET_KEY = os.getenv(\"SECRET_KEY\")'"]),
        ("place", "py", ["'first_key = \"your_api_key_here\"'", "'second_key = \"xxxxxxxxxxxxxxxx\"'",
                         "'third_key = \"abcabcabcabcabcabc\"'", "'greeting = \"Hello\" + \" \" + \"World\"'"]),
        ("test_unit", "py", [a("api_key", h)]),
        ("b64", "py", [a("enc", f"to_base64(encode({h}))"), "'dec = base64.b64decode(enc).decode()'", "'open(dec)'"]),
        ("collide", "py", [a("first_db", f"'mongodb+srv://a:' || {a8} || '@one.invalid/x'"),
                           a("second_db", f"'mongodb+srv://b:' || {b8} || '@two.invalid/y'")]),
    ]
    path = " ".join(f"WHEN {i} THEN 'src/{s}_' || c_custkey || '.{e}'" for i, (s, e, _) in enumerate(shapes))
    text = " ".join(f"WHEN {i} THEN " + f" || {NL} || ".join(ls) for i, (_, _, ls) in enumerate(shapes))
    return (f"SELECT 'scan-' || n_nationkey AS scan_id, n_name AS repository, CASE c_custkey % 12 {path} END AS file_path, "
            f"CASE WHEN c_custkey % 12 IN (5, 6) THEN 'JavaScript' ELSE 'Python' END AS language, "
            f"CASE c_custkey % 12 {text} END AS content FROM customer JOIN nation ON c_nationkey = n_nationkey")


CORPORA = {
    "rendered": _rendered(),
    "documents": "SELECT 'documents' AS scan_id, source AS repository, 'doc-' || doc_id AS file_path, "
                 "'Unknown' AS language, text AS content FROM documents",
    "pages": "SELECT 'pages' AS scan_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repository, "
             "'page-' || page_id AS file_path, 'Unknown' AS language, html AS content FROM pages",
    "conversations": "SELECT 'conversations' AS scan_id, role AS repository, 'conv-' || conv_id || '-' || turn AS file_path, "
                     "'Unknown' AS language, text AS content FROM conversations",
}

FILES = (f"SELECT *, octet_length(encode(content)) AS size, len(string_split(content, {NL})) AS line_count, "
         f"string_split(content, {NL}) AS ls FROM corpus")
GATED = ("SELECT * FROM all_files WHERE size BETWEEN 1 AND 1048576 AND line_count <= 50000 "
         "AND NOT (line_count >= 3 AND (len(content) - (line_count - 1))::DOUBLE / line_count > 500)")
LINES = (f"SELECT scan_id, repository, file_path, language, line_no, ls[line_no] AS line, "
         f"array_to_string(ls[greatest(line_no - 3, 1):line_no + 3], {NL}) AS ctx "
         "FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS line_no FROM files)")


def _rules(rules) -> str:
    parts = []
    for i, rule in enumerate(rules):
        kind, conf, group, pattern = rule[:4]
        p = lit(pattern)
        parts.append(
            f"SELECT scan_id, repository, file_path, 0 AS phase, {i} AS rule, line_no, line, ctx, {lit(kind)} AS kind, "
            f"{conf}::DOUBLE AS confidence, regexp_extract_all(line, {p}, 0) AS w, regexp_extract_all(line, {p}, {group}) AS v, "
            f"regexp_split_to_array(line, {p}) AS pieces FROM lines WHERE regexp_matches(line, {p})")
    return " UNION ALL ".join(parts)


RULE_ROWS = (
    "SELECT scan_id, repository, file_path, phase, rule, line_no AS line_number, p AS pos, "
    "1 + list_sum(list_transform(pieces[1:p], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:p - 1], lambda x: len(x))), 0) "
    f"AS \"column\", v[p] AS value, {provider('v[p]', 'kind')} AS secret_type, 'regex' AS detection_method, confidence, "
    f"0.0::DOUBLE AS entropy_score, regexp_extract(line, {lit(C.ASSIGNED_VARIABLE)}, 1) AS context_variable, ctx AS code_context "
    "FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM rule_lines)")
ENTROPY_ROWS = (
    "SELECT *, CASE WHEN has_context THEN least(0.85::DOUBLE, least(0.4::DOUBLE, (h - thr) / 3.0) + 0.35::DOUBLE) "
    "ELSE least(0.5::DOUBLE, least(0.4::DOUBLE, (h - thr) / 3.0)) END AS confidence FROM ("
    f"SELECT *, {entropy('value')} AS h, {threshold('value')} AS thr, {has_any('lower(ctx)', C.CREDENTIAL_KEYWORDS)} AS has_context "
    "FROM (SELECT *, v[p] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS p FROM (SELECT scan_id, repository, file_path, "
    f"line_no, ctx, regexp_extract_all(line, {lit(C.QUOTED_LITERAL)}, 1) AS v FROM lines "
    f"WHERE NOT regexp_matches(line, {lit(C.WS.join(['^', '*(?:#|//|[*])']))}))))) WHERE h >= thr")
RAW = (
    "SELECT *, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY phase, rule, line_number, pos) - 1 AS ord FROM ("
    "SELECT * FROM rule_rows UNION ALL SELECT scan_id, repository, file_path, 1, 0, line_no, p, 0, value, 'High Entropy String', "
    "'entropy', confidence, h, '', ctx FROM entropy_rows)")


def _filtered() -> str:
    test_path = has_any("lower(file_path)", C.TEST_PATH_PARTS)
    return (
        "SELECT scan_id, repository, file_path, line_number, \"column\", value, secret_type, detection_method, final AS confidence, "
        "entropy_score, name AS context_variable, code_context, "
        "row_number() OVER (PARTITION BY scan_id, file_path ORDER BY ord) - 1 AS ord FROM ("
        f"SELECT *, CASE WHEN name <> '' AND {match('name', C.CONFIG_VARIABLE)} THEN c2 * 0.4::DOUBLE ELSE c2 END AS final FROM ("
        f"SELECT *, CASE WHEN {test_path} THEN c1 * 0.5::DOUBLE ELSE c1 END AS c2 FROM ("
        "SELECT *, CASE WHEN doc THEN confidence * 0.3::DOUBLE ELSE confidence END AS c1 FROM ("
        f"SELECT *, {documentation('code_context')} AS doc, CASE WHEN context_variable <> '' THEN context_variable "
        f"ELSE {context_variable('code_context', 'value')} END AS name FROM raw "
        f"WHERE NOT {placeholder('value')} AND NOT {match('code_context', C.ENVIRONMENT_SOURCE)})) "
        "WHERE NOT (doc AND c1 < 0.2::DOUBLE))) WHERE final >= 0.15::DOUBLE")


# ---- statements, symbols, reconstructions (forms of the rendered corpus) ----
BARE = "regexp_replace(line, '\"[^\"]*\"|`[^`]*`', '', 'g')"
STATEMENTS = (
    "SELECT scan_id, repository, file_path, language, stmt_no, min(line_no) AS line_no, arg_min(trim(line), line_no) AS snippet, "
    "regexp_replace(string_agg(trim(line), ' ' ORDER BY line_no), ';$', '') AS text FROM ("
    "SELECT *, sum(CASE WHEN coalesce(before, 0) <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, file_path ORDER BY line_no) AS stmt_no "
    "FROM (SELECT *, sum(delta) OVER (PARTITION BY scan_id, file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
    f"AS before FROM (SELECT *, len(regexp_replace({BARE}, '[^({{\\[]', '', 'g')) - len(regexp_replace({BARE}, '[^)}}\\]]', '', 'g')) AS delta "
    "FROM lines))) GROUP BY ALL")
STATEMENTS = STATEMENTS.replace("GROUP BY ALL", "GROUP BY scan_id, repository, file_path, language, stmt_no")
DEFS = (
    "SELECT *, CASE WHEN regexp_full_match(value, '[A-Za-z_][A-Za-z0-9_]*') THEN 'name' WHEN regexp_matches(value, '^f\"') "
    "OR regexp_matches(value, '^`.*\\$\\{') THEN 'template' WHEN regexp_full_match(value, '\"[^\"]*\"') THEN 'literal' "
    "WHEN regexp_matches(value, '^base64\\.b64decode\\([A-Za-z0-9_]+\\)\\.decode\\(\\)$') THEN 'decode' WHEN contains(value, ' + ') THEN 'concat' "
    "ELSE 'dynamic' END AS kind FROM (SELECT *, regexp_extract(text, '^(?:const )?([A-Za-z_][A-Za-z0-9_]*) = (.+)$', 1) AS target, "
    "regexp_extract(text, '^(?:const )?([A-Za-z_][A-Za-z0-9_]*) = (.+)$', 2) AS value FROM stmts) WHERE target <> ''")
PARTS = (
    "SELECT scan_id, file_path, stmt_no, line_no, target, kind, text, pos, tok, "
    "CASE WHEN regexp_full_match(tok, '\\$?\\{[A-Za-z_][A-Za-z0-9_]*\\}') AND kind = 'template' THEN 'name' "
    "WHEN kind = 'template' THEN 'lit' WHEN regexp_full_match(tok, '[A-Za-z_][A-Za-z0-9_]*') THEN 'name' "
    "WHEN regexp_full_match(tok, '\"[^\"]*\"') THEN 'lit' ELSE 'dyn' END AS k, "
    "CASE WHEN kind = 'template' THEN regexp_replace(tok, '^\\$?\\{(.*)\\}$', '\\1') ELSE trim(tok, '\"') END AS t, "
    "(kind <> 'template' OR regexp_matches(tok, '^\\$?\\{')) AS frag FROM (SELECT *, toks[pos] AS tok FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS pos FROM ("
    "SELECT *, CASE kind WHEN 'concat' THEN string_split(value, ' + ') WHEN 'decode' THEN [regexp_extract(value, '\\((.*?)\\)', 1)] "
    "WHEN 'template' THEN regexp_extract_all(regexp_replace(regexp_replace(value, '^f?[\"`]', ''), '[\"`]$', ''), '\\$?\\{[^}]*\\}|[^{$]+') "
    "WHEN 'dynamic' THEN [] ELSE [value] END AS toks FROM defs)))")
LINKS = (
    "SELECT p.scan_id, p.file_path, p.stmt_no, p.pos, max(d.stmt_no) AS def_stmt, arg_max(d.line_no, d.stmt_no) AS def_line "
    "FROM parts p JOIN defs d ON p.scan_id = d.scan_id AND p.file_path = d.file_path AND p.t = d.target AND d.stmt_no < p.stmt_no "
    "WHERE p.k = 'name' GROUP BY p.scan_id, p.file_path, p.stmt_no, p.pos")


def _level(previous: str) -> str:
    joined = "string_agg(coalesce(CASE WHEN p.k = 'lit' THEN p.t ELSE v.value END, ''), '' ORDER BY p.pos)"
    value = f"CASE WHEN any_value(p.kind) = 'decode' THEN decode(from_base64({joined})) ELSE {joined} END"
    resolved = "count(*) FILTER (WHERE p.frag AND (p.k = 'lit' OR v.value IS NOT NULL))"
    total = "count(*) FILTER (WHERE p.frag)"
    return (
        f"SELECT scan_id, file_path, stmt_no, joined, status, CASE WHEN status = 'FULL' THEN joined END AS value FROM ("
        f"SELECT p.scan_id, p.file_path, p.stmt_no, {value} AS joined, CASE WHEN {resolved} = {total} THEN 'FULL' "
        f"WHEN {resolved} > 0 THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS status FROM parts p "
        "LEFT JOIN links l ON p.scan_id = l.scan_id AND p.file_path = l.file_path AND p.stmt_no = l.stmt_no AND p.pos = l.pos "
        f"LEFT JOIN {previous} v ON l.scan_id = v.scan_id AND l.file_path = v.file_path AND l.def_stmt = v.stmt_no "
        "GROUP BY p.scan_id, p.file_path, p.stmt_no)")


LEVEL0 = "SELECT scan_id, file_path, stmt_no, t AS joined, 'FULL' AS status, t AS value FROM parts WHERE kind = 'literal'"
RECONS = (
    "SELECT d.scan_id, d.repository, d.file_path, d.stmt_no, d.line_no, d.target, d.kind, d.text, v.joined AS value, v.status, "
    "row_number() OVER (PARTITION BY d.scan_id, d.file_path ORDER BY d.stmt_no) - 1 AS ord FROM defs d "
    "JOIN level3 v ON d.scan_id = v.scan_id AND d.file_path = v.file_path AND d.stmt_no = v.stmt_no "
    "WHERE d.kind IN ('template', 'concat', 'decode')")


def _checked() -> str:
    kind, known = reconstructed_type("value"), f"(secret_type IN {one_of(C.PROVIDER_TYPES)})"
    url = f"({match('value', '(?i)^https?://')} AND NOT {match('value', '^[a-zA-Z]+://[^/@]*:[^/@]*@')})"
    conf = (f"(CASE WHEN {known} THEN 0.76 WHEN {match('target', C.CREDENTIAL_TARGET)} THEN 0.64 ELSE 0.45 END)::DOUBLE "
            "* (CASE WHEN status = 'PARTIAL' THEN 0.5 ELSE 1 END)::DOUBLE")
    return (
        f"SELECT *, {conf} AS confidence, CASE WHEN {match('text', C.ENVIRONMENT_SOURCE)} THEN 'environment source' "
        f"WHEN status = 'UNRESOLVED' THEN 'unresolved' WHEN len(value) < 12 THEN 'too short' WHEN {entropy('value')} < 3.2 THEN 'low entropy' "
        f"WHEN {match('value', C.WS)} AND NOT {known} THEN 'prose' WHEN {url} THEN 'plain url' WHEN {placeholder('value')} THEN 'placeholder' "
        f"ELSE '' END AS reason FROM (SELECT *, {kind} AS secret_type FROM recons)")


SECRETS = ("SELECT *, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY ord) - 1 AS secret_ord FROM checked WHERE reason = ''")
FRAGMENTS = (
    "SELECT p.scan_id, p.file_path, p.stmt_no, p.pos, CASE WHEN p.k = 'lit' THEN '' ELSE p.t END AS variable, "
    "CASE WHEN p.k = 'lit' THEN p.t ELSE v.value END AS value, coalesce(l.def_line, p.line_no) AS line, "
    "(p.k = 'lit' OR v.value IS NOT NULL) AS resolved FROM parts p "
    "LEFT JOIN links l ON p.scan_id = l.scan_id AND p.file_path = l.file_path AND p.stmt_no = l.stmt_no AND p.pos = l.pos "
    "LEFT JOIN level3 v ON l.scan_id = v.scan_id AND l.file_path = v.file_path AND l.def_stmt = v.stmt_no "
    "WHERE p.frag AND p.kind IN ('template', 'concat', 'decode')")

# ---- dataflow ----
SEEDS = (
    "SELECT scan_id, file_path, variable, arg_max(line, seq) AS line, arg_max(value, seq) AS value, "
    "any_value(language) AS language FROM ("
    "SELECT s.scan_id, s.file_path, target AS variable, line_no AS line, value, secret_ord AS seq FROM secrets s UNION ALL "
    "SELECT scan_id, file_path, context_variable, line_number, value, 1000000 + ord FROM filtered WHERE context_variable <> '') "
    "JOIN (SELECT scan_id, file_path, language FROM files) USING (scan_id, file_path) GROUP BY scan_id, file_path, variable")
NAME = "[A-Za-z_][A-Za-z0-9_]*"
PY_FACTS = (
    "SELECT *, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY stmt_no, step, arg) AS pos FROM ("
    f"SELECT scan_id, file_path, stmt_no, line_no AS line, snippet, 1 AS step, 0 AS arg, 'assignment' AS op, [b] AS srcs, a AS taints, a AS label, '' AS post, a AS target, 'assignment' AS edge "
    f"FROM (SELECT *, regexp_extract(text, '^({NAME}) = ({NAME})$', 1) AS a, regexp_extract(text, '^({NAME}) = ({NAME})$', 2) AS b FROM stmts WHERE language = 'Python') WHERE a <> '' "
    f"UNION ALL SELECT scan_id, file_path, stmt_no, line_no, snippet, 2, 0, 'dict_value', [c], a, a || '.' || b, '', a || '.' || b, 'dict_insertion' "
    f"FROM (SELECT *, regexp_extract(text, '^({NAME}) = \\{{ \"([^\"]*)\": ({NAME}) \\}}$', 1) AS a, regexp_extract(text, '^({NAME}) = \\{{ \"([^\"]*)\": ({NAME}) \\}}$', 2) AS b, "
    f"regexp_extract(text, '^({NAME}) = \\{{ \"([^\"]*)\": ({NAME}) \\}}$', 3) AS c FROM stmts WHERE language = 'Python') WHERE a <> '' "
    f"UNION ALL SELECT scan_id, file_path, stmt_no, line_no, snippet, 4, 0, 'concatenation', ns, target, target, '', target, 'concatenation' FROM ("
    f"SELECT *, list_filter(list_concat(list_reverse(ops[3:]), ops[1:2]), lambda o: regexp_full_match(o, '{NAME}')) AS ns FROM ("
    "SELECT *, string_split(value, ' + ') AS ops FROM defs WHERE kind = 'concat' AND language = 'Python')) WHERE len(ns) > 0 "
    "UNION ALL SELECT scan_id, file_path, stmt_no, line_no, snippet, 5, i, CASE WHEN contains(a, '=') THEN 'keyword_argument' ELSE 'function_argument' END, "
    "[CASE WHEN contains(a, '=') THEN string_split(a, '=')[2] ELSE a END], NULL, CASE WHEN contains(a, '=') THEN fn || '(' || string_split(a, '=')[1] || '=' ELSE fn || '(' END, ')', "
    "CASE WHEN contains(a, '=') THEN fn || '(' || string_split(a, '=')[1] || '=)' ELSE fn || '()' END, 'parameter_pass' FROM ("
    "SELECT *, string_split(args, ', ')[i] AS a FROM (SELECT *, unnest(range(1, len(string_split(args, ', ')) + 1)) AS i FROM ("
    f"SELECT *, regexp_extract(text, '^(?:{NAME} = )?([A-Za-z0-9_.]+)\\(([^()]*)\\)$', 1) AS fn, regexp_extract(text, '^(?:{NAME} = )?([A-Za-z0-9_.]+)\\(([^()]*)\\)$', 2) AS args "
    f"FROM stmts WHERE language = 'Python') WHERE fn <> '')) WHERE regexp_full_match(a, '(?:{NAME}=)?{NAME}'))")
WORD = "[A-Za-z0-9_]+"
LINE_CALL = rf"({WORD}(?:\.{WORD})*)[ \t]*\(([^)]*)\)"
LINE_PAIR = rf"[\"']([A-Za-z0-9_-]+)[\"'][ \t]*:[ \t]*({WORD})"
LINE_ASSIGN = rf"^[ \t]*(?:(?:const|let|var|export)[ \t]+)?({WORD})[ \t]*=[ \t]*(.*)$"
LINE_CALLS = (
    "SELECT scan_id, file_path, language, line, snippet, fn, unnest(list_distinct(regexp_extract_all(span, '[A-Za-z0-9_]+'))) AS word, i FROM ("
    f"SELECT scan_id, file_path, language, line_no AS line, trim(line) AS snippet, unnest(regexp_extract_all(line, {lit(LINE_CALL)}, 1)) AS fn, "
    f"unnest(regexp_extract_all(line, {lit(LINE_CALL)}, 2)) AS span, unnest(range(len(regexp_extract_all(line, {lit(LINE_CALL)}, 1)))) AS i FROM lines)")
LINE_PAIRS = (
    f"SELECT scan_id, file_path, language, line_no AS line, trim(line) AS snippet, unnest(regexp_extract_all(line, {lit(LINE_PAIR)}, 1)) AS key, "
    f"unnest(regexp_extract_all(line, {lit(LINE_PAIR)}, 2)) AS word, regexp_extract(line, '^[ \\t]*([A-Za-z0-9_]+)[ \\t]*=[ \\t]*\\{{', 1) AS container FROM lines")
JS_FACTS = (
    f"SELECT scan_id, file_path, line, snippet, 'assignment' AS op, 0 AS rank, word AS src, a AS taints, a AS label, '' AS post, a AS target, 'assignment' AS edge FROM ("
    f"SELECT scan_id, file_path, line_no AS line, trim(line) AS snippet, regexp_extract(line, {lit(LINE_ASSIGN)}, 1) AS a, "
    f"unnest(list_distinct(regexp_extract_all(regexp_extract(line, {lit(LINE_ASSIGN)}, 2), '[A-Za-z0-9_]+'))) AS word FROM lines WHERE language <> 'Python') WHERE a <> '' AND a <> word "
    "UNION ALL SELECT scan_id, file_path, line, any_value(snippet), 'function_argument', 1, word, NULL, arg_min(fn, i) || '(', ')', arg_min(fn, i) || '()', 'parameter_pass' "
    "FROM line_calls WHERE language <> 'Python' GROUP BY scan_id, file_path, line, word "
    "UNION ALL SELECT scan_id, file_path, line, any_value(snippet), 'dict_value', 2, word, NULL, '[dict].' || min(key), '', '[dict].' || min(key), 'dict_insertion' "
    "FROM line_pairs WHERE language <> 'Python' AND regexp_full_match(key, '[A-Za-z0-9_]+') GROUP BY scan_id, file_path, line, word")
FACT_SRCS = (
    "SELECT scan_id, file_path, pos, pos AS fact, line, snippet, op, 0 AS rank, unnest(srcs) AS src, unnest(range(len(srcs))) AS si, taints, label, post, target, edge FROM py_facts "
    "UNION ALL SELECT scan_id, file_path, line AS pos, row_number() OVER () AS fact, line, snippet, op, rank, src, 0, taints, label, post, target, edge FROM js_facts")
REACH = (
    "SELECT scan_id, file_path, variable AS seed, variable AS name, (CASE WHEN language = 'Python' THEN 0 ELSE line END)::BIGINT AS t FROM seeds "
    "UNION SELECT r.scan_id, r.file_path, r.seed, f.taints, f.pos::BIGINT FROM reach r JOIN fact_srcs f ON r.scan_id = f.scan_id AND r.file_path = f.file_path "
    "AND f.src = r.name AND f.pos > r.t WHERE f.taints IS NOT NULL")
TAINT = "SELECT scan_id, file_path, seed, name, min(t) AS t FROM reach GROUP BY scan_id, file_path, seed, name"
NODES = (
    "SELECT scan_id, file_path, seed, row_number() OVER (PARTITION BY scan_id, file_path, seed ORDER BY pos, since, by_name, rank) AS ord, "
    "CASE WHEN op IN ('function_argument', 'keyword_argument') THEN label || src || post ELSE label END AS variable, line, op AS operation, snippet, src AS source, target, edge FROM ("
    "SELECT f.scan_id, f.file_path, t.seed, f.pos, f.fact, any_value(f.line) AS line, any_value(f.snippet) AS snippet, any_value(f.op) AS op, any_value(f.label) AS label, any_value(f.post) AS post, "
    "any_value(f.target) AS target, any_value(f.edge) AS edge, arg_min(f.src, f.si) AS src, any_value(CASE WHEN s.language = 'Python' THEN 0 ELSE t.t END) AS since, "
    "any_value(CASE WHEN s.language = 'Python' THEN '' ELSE f.src END) AS by_name, any_value(f.rank) AS rank "
    "FROM fact_srcs f JOIN taint t ON f.scan_id = t.scan_id AND f.file_path = t.file_path AND f.src = t.name AND t.t < f.pos "
    "JOIN seeds s ON s.scan_id = t.scan_id AND s.file_path = t.file_path AND s.variable = t.seed "
    "GROUP BY f.scan_id, f.file_path, t.seed, f.pos, f.fact)")
GRAPH = (
    "SELECT scan_id, file_path, seed, ord, variable, line, operation, snippet, source, target, edge FROM nodes UNION ALL "
    "SELECT s.scan_id, s.file_path, s.variable, 0, s.variable, s.line, 'assignment', trim(l.line), NULL, NULL, NULL FROM seeds s "
    "JOIN lines l ON l.scan_id = s.scan_id AND l.file_path = s.file_path AND l.line_no = s.line")
PATHS = "SELECT scan_id, file_path, seed, list(variable ORDER BY ord) AS path FROM graph GROUP BY scan_id, file_path, seed"

# ---- sinks ----


def _graph_sinks() -> str:
    fn = rf"regexp_extract(variable, '^({WORD}(?:\.{WORD})*)\(', 1)"
    key = rf"lower(regexp_extract(variable, '\.({WORD})$', 1))"
    return (
        f"SELECT scan_id, file_path, seed, ord, kind AS sink_type, {sink_risk('kind')} AS risk_level, fn AS function, line, snippet AS code, "
        f"CASE WHEN operation = 'dict_value' THEN 'Secret assigned to authentication-related key ''' || key || '''' ELSE {sink_description('kind', 'fn', 'snippet')} END AS description FROM ("
        f"SELECT *, CASE WHEN operation = 'dict_value' THEN (CASE WHEN key IN {one_of(C.AUTH_KEYS)} THEN {lit(C.AUTH)} END) "
        f"WHEN operation IN ('function_argument', 'keyword_argument') AND fn <> '' THEN {classify('fn', 'snippet')} END AS kind FROM ("
        f"SELECT *, {key} AS key, CASE WHEN operation = 'dict_value' THEN variable ELSE {fn} END AS fn FROM graph)) WHERE kind IS NOT NULL")


WALK = (
    "SELECT scan_id, file_path, 3 * stmt_no AS pos, line_no AS line, snippet, 'mention' AS op, '' AS label, target AS taints, "
    "unnest(regexp_extract_all(regexp_replace(value, '\"[^\"{]*\"', '', 'g'), '[A-Za-z_][A-Za-z0-9_]*')) AS src FROM defs WHERE language = 'Python' "
    f"UNION ALL SELECT scan_id, file_path, 3 * stmt_no + 1, line, snippet, 'auth', string_split(label, '.')[2], taints, unnest(srcs) FROM py_facts WHERE op = 'dict_value' AND lower(string_split(label, '.')[2]) IN {one_of(C.AUTH_KEYS)} "
    "UNION ALL SELECT scan_id, file_path, 3 * stmt_no + 2, line, snippet, 'call', string_split(label, '(')[1], NULL, unnest(srcs) FROM py_facts WHERE op IN ('function_argument', 'keyword_argument')")
WALK_REACH = (
    "SELECT scan_id, file_path, variable AS seed, variable AS name, 0::BIGINT AS t FROM seeds WHERE language = 'Python' UNION "
    "SELECT r.scan_id, r.file_path, r.seed, f.taints, f.pos::BIGINT FROM walk_reach r JOIN walk f ON r.scan_id = f.scan_id AND r.file_path = f.file_path "
    "AND f.src = r.name AND f.pos > r.t WHERE f.taints IS NOT NULL")


def _statement_sinks() -> str:
    return (
        f"SELECT scan_id, file_path, seed, pos AS ord, kind AS sink_type, {sink_risk('kind')} AS risk_level, CASE WHEN op = 'auth' THEN 'dict[''' || label || ''']' ELSE label END AS function, line, snippet AS code, "
        f"CASE WHEN op = 'auth' THEN 'Secret placed in authentication field ''' || label || '''' ELSE {sink_description('kind', 'label', 'snippet')} END AS description FROM ("
        f"SELECT *, CASE WHEN op = 'auth' THEN {lit(C.AUTH)} ELSE {classify('label', 'snippet')} END AS kind FROM ("
        "SELECT DISTINCT w.scan_id, w.file_path, r.seed, w.pos, w.op, w.label, w.line, w.snippet FROM walk w JOIN walk_reach r ON w.scan_id = r.scan_id AND w.file_path = r.file_path "
        "AND w.src = r.name AND r.t < w.pos WHERE w.op <> 'mention')) WHERE kind IS NOT NULL")


def _line_sinks() -> str:
    key = "lower(key)"
    return (
        f"SELECT scan_id, file_path, seed, 2 * line AS ord, kind AS sink_type, {sink_risk('kind')} AS risk_level, fn AS function, line, snippet AS code, {sink_description('kind', 'fn', 'snippet')} AS description FROM ("
        f"SELECT *, {classify('fn', 'snippet')} AS kind FROM (SELECT s.scan_id, s.file_path, s.variable AS seed, c.line, any_value(c.snippet) AS snippet, arg_min(c.fn, c.i) AS fn "
        "FROM seeds s JOIN line_calls c ON s.scan_id = c.scan_id AND s.file_path = c.file_path AND s.variable = c.word GROUP BY s.scan_id, s.file_path, s.variable, c.line)) WHERE kind IS NOT NULL "
        f"UNION ALL SELECT s.scan_id, s.file_path, s.variable, 2 * p.line + 1, {lit(C.AUTH)}, 'HIGH', 'dict[''' || {key} || ''']', p.line, p.snippet, "
        f"'Secret ''' || s.variable || ''' placed in authentication field ''' || {key} || '''' FROM seeds s JOIN line_pairs p "
        f"ON s.scan_id = p.scan_id AND s.file_path = p.file_path AND s.variable = p.word WHERE {key} IN {one_of(C.AUTH_KEYS)}")


DIRECT = (
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, file_path, seed, line, sink_type ORDER BY part, ord) AS rn FROM ("
    "SELECT *, 0 AS part FROM statement_sinks UNION ALL SELECT *, 1 AS part FROM line_sinks)) WHERE rn = 1")
BEST = (
    "SELECT scan_id, file_path, seed, arg_min({'sink_type': sink_type, 'risk_level': risk_level, 'function': function, 'line': line, 'code': code, 'description': description}, "
    f"{{'p': -{sink_rank('sink_type')}, 'part': part, 'ord': ord}}) AS sink FROM (SELECT * FROM direct UNION ALL SELECT *, 2 AS part FROM graph_sinks) GROUP BY scan_id, file_path, seed")

# ---- findings ----
HEADS = (
    "SELECT scan_id, file_path, left(value, 12) AS prefix, arg_min(value, secret_ord) AS value, min(secret_ord) AS secret_ord FROM secrets GROUP BY scan_id, file_path, left(value, 12)")
RAW_FINDINGS = (
    "SELECT r.*, coalesce(h.prefix, left(r.secret, 12)) AS group_key, p.path, b.sink FROM ("
    "SELECT s.scan_id, s.repository, s.file_path, s.secret_ord AS ord, s.value AS secret, s.line_no AS line_number, s.secret_type, 'reconstruction' AS method, s.confidence, 0.0::DOUBLE AS entropy_score, "
    "s.status, s.target AS variable, s.stmt_no, l.ctx AS context FROM secrets s JOIN lines l ON l.scan_id = s.scan_id AND l.file_path = s.file_path AND l.line_no = s.line_no UNION ALL "
    "SELECT scan_id, repository, file_path, 4294967296 + ord, value, line_number, secret_type, detection_method, confidence, entropy_score, 'NONE', context_variable, NULL, code_context FROM filtered) r "
    "LEFT JOIN (SELECT f.scan_id, f.file_path, f.ord, arg_min(h.prefix, h.secret_ord) AS prefix FROM filtered f JOIN heads h ON f.scan_id = h.scan_id AND f.file_path = h.file_path "
    "AND f.secret_type = 'High Entropy String' AND len(f.value) >= 8 AND contains(h.value, f.value) AND h.value <> f.value GROUP BY f.scan_id, f.file_path, f.ord) h "
    "ON r.scan_id = h.scan_id AND r.file_path = h.file_path AND r.ord = 4294967296 + h.ord "
    "LEFT JOIN paths p ON r.scan_id = p.scan_id AND r.file_path = p.file_path AND r.variable = p.seed "
    "LEFT JOIN best b ON r.scan_id = b.scan_id AND r.file_path = b.file_path AND r.variable = b.seed")
MERGED = (
    "SELECT scan_id, file_path, group_key, any_value(repository) AS repository, min(ord) AS ord, arg_min(secret, ord) AS secret, arg_min(line_number, ord) AS line_number, "
    f"coalesce(arg_min(secret_type, ord) FILTER (WHERE secret_type NOT IN {one_of(C.GENERIC_TYPES)}), arg_min(secret_type, ord)) AS secret_type, "
    "max(confidence) AS confidence, max(entropy_score) AS entropy_score, list_concat(list_concat(CASE WHEN bool_or(method = 'reconstruction') THEN ['reconstruction', 'dataflow'] ELSE [] END, "
    "CASE WHEN bool_or(method = 'regex') THEN ['regex'] ELSE [] END), CASE WHEN bool_or(method = 'entropy') THEN ['entropy'] ELSE [] END) AS methods, "
    "coalesce(arg_min(status, ord) FILTER (WHERE status <> 'NONE'), 'NONE') AS status, arg_min(secret, ord) FILTER (WHERE status <> 'NONE') AS rebuilt_value, "
    "arg_min(stmt_no, ord) FILTER (WHERE status <> 'NONE') AS stmt_no, arg_min(path, {'l': -len(path), 'o': ord}) FILTER (WHERE path IS NOT NULL) AS path, "
    "arg_min(sink, {'r': CASE WHEN sink.risk_level = 'HIGH' THEN 0 ELSE 1 END, 'o': ord}) FILTER (WHERE sink IS NOT NULL) AS sink, "
    "arg_min(context, {'l': -len(context), 'o': ord}) AS context FROM raw_findings GROUP BY scan_id, file_path, group_key")


def _scored(source: str) -> str:
    type_weight = "(CASE secret_type " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in C.TYPE_WEIGHTS.items()) + " ELSE 15 END)"
    exposure = "(CASE WHEN sink IS NULL THEN 3 ELSE CASE sink.sink_type " + " ".join(
        f"WHEN {lit(k)} THEN {v}" for k, v in C.EXPOSURE_WEIGHTS.items()) + " ELSE 5 END END)"
    plen = "coalesce(len(path), 0)"
    return (
        "SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
        "concat_ws(' | ', CASE WHEN len(methods) >= 3 THEN 'Multi-method detection (' || array_to_string(methods, ', ') || ') → boosted confidence' END, "
        "CASE WHEN entropy_score > 4.5 THEN 'High entropy (' || printf('%.2f', entropy_score) || ') supports authenticity' END, "
        "'Secret type ''' || secret_type || ''' sensitivity: ' || sensitivity_score::INT || '/25', "
        "CASE WHEN sink IS NULL THEN 'No identified exposure sink → minimal exposure risk' ELSE 'Exposure via ''' || sink.sink_type || ''' → severity: ' || exposure_score::INT || '/25' END, "
        "CASE status WHEN 'FULL' THEN 'Fully reconstructed secret → high propagation certainty' WHEN 'PARTIAL' THEN 'Partially reconstructed → moderate propagation certainty' END, "
        "CASE WHEN plen > 1 THEN 'Propagation path length ' || plen || ' → +' || least(10, 2 * plen) || ' certainty' END) AS explanation FROM ("
        "SELECT *, round_even(detection_score + sensitivity_score + exposure_score + propagation_score, 1) AS risk_score FROM ("
        f"SELECT *, {plen} AS plen, round_even(CASE WHEN entropy_score > 4.5 THEN least(25.0::DOUBLE, d2 + 2) ELSE d2 END, 1) AS detection_score, {type_weight}::DOUBLE AS sensitivity_score, "
        f"{exposure}::DOUBLE AS exposure_score, least(25.0::DOUBLE, 5 + CASE status WHEN 'FULL' THEN 10 WHEN 'PARTIAL' THEN 5 ELSE 0 END + CASE WHEN {plen} > 1 THEN least(10, 2 * {plen}) ELSE 0 END) AS propagation_score FROM ("
        "SELECT *, CASE WHEN len(methods) >= 3 THEN least(25.0::DOUBLE, d1 + 5) WHEN len(methods) = 2 THEN least(25.0::DOUBLE, d1 + 3) ELSE d1 END AS d2 FROM ("
        f"SELECT *, least(25.0::DOUBLE, confidence * 25) AS d1 FROM {source}))))")


BASELINE_ROWS = (
    "SELECT scan_id, file_path, line_number, any_value(repository) AS repository, min(ord) AS ord, arg_min(value, ord) AS secret, arg_min(secret_type, ord) AS secret_type, "
    "[arg_min(detection_method, ord)] AS methods, arg_min(confidence, ord) AS confidence, arg_min(entropy_score, ord) AS entropy_score, 'NONE' AS status, NULL::VARCHAR[] AS path, "
    "NULL::STRUCT(sink_type VARCHAR) AS sink FROM filtered GROUP BY scan_id, file_path, line_number, left(value, 10)")
SUMMARY = (
    "SELECT scan_id, count(*) AS total_files, sum(line_count)::BIGINT AS total_lines, sum(size)::BIGINT AS total_bytes FROM files GROUP BY scan_id")
RUNS = ("SELECT 'scan-' || n_nationkey AS scan_id, n_name AS repository, CASE WHEN n_nationkey % 7 = 6 THEN 'failed' ELSE 'completed' END AS status, "
        "n_nationkey / 8.0::DOUBLE AS scan_duration, (DATE '2024-01-01' + n_nationkey::INT)::TIMESTAMP AS created_at FROM nation")
COUNTS = (
    "SELECT scan_id, count(*) AS findings_count, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, "
    "count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, round_even(avg(risk_score), 1) AS risk_score FROM scored GROUP BY scan_id")
STAGES = (
    "SELECT scan_id, coalesce(c, 0) AS candidates_found, coalesce(s, 0) AS secrets_reconstructed FROM (SELECT scan_id, count(*) AS c FROM filtered GROUP BY scan_id) "
    "FULL JOIN (SELECT scan_id, count(*) AS s FROM secrets GROUP BY scan_id) USING (scan_id)")
SCANS = (
    "SELECT r.*, total_files AS files_scanned, total_lines, total_bytes, coalesce(findings_count, 0) AS findings_count, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, "
    "coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(risk_score, 0.0) AS risk_score, coalesce(candidates_found, 0) AS candidates_found, "
    "coalesce(secrets_reconstructed, 0) AS secrets_reconstructed FROM runs r JOIN summary USING (scan_id) LEFT JOIN counts USING (scan_id) LEFT JOIN stages USING (scan_id)")

ORDER = [
    "corpus", "all_files", "files", "lines", "rule_lines", "rule_rows", "entropy_rows", "raw", "filtered", "stmts", "defs", "parts", "links", "level0", "level1", "level2",
    "level3", "recons", "checked", "secrets", "fragments", "seeds", "py_facts", "line_calls", "line_pairs", "js_facts", "fact_srcs", "reach", "taint", "nodes", "graph", "paths",
    "graph_sinks", "walk", "walk_reach", "statement_sinks", "line_sinks", "direct", "best", "heads", "raw_findings", "merged", "scored", "baseline_rows", "baseline", "summary", "runs",
    "counts", "stages", "scans"]


def tables(corpus: str, rules) -> dict[str, str]:
    return {
        "corpus": CORPORA[corpus], "all_files": FILES, "files": "SELECT * FROM all_files", "lines": LINES, "rule_lines": _rules(rules), "rule_rows": RULE_ROWS, "entropy_rows": ENTROPY_ROWS,
        "raw": RAW, "filtered": _filtered(), "stmts": STATEMENTS, "defs": DEFS, "parts": PARTS, "links": LINKS, "level0": LEVEL0,
        "level1": _level("level0"), "level2": _level("level1"), "level3": _level("level2"), "recons": RECONS, "checked": _checked(), "secrets": SECRETS, "fragments": FRAGMENTS,
        "seeds": SEEDS, "py_facts": PY_FACTS, "line_calls": LINE_CALLS, "line_pairs": LINE_PAIRS, "js_facts": JS_FACTS, "fact_srcs": FACT_SRCS, "reach": REACH, "taint": TAINT,
        "nodes": NODES, "graph": GRAPH, "paths": PATHS, "graph_sinks": _graph_sinks(), "walk": WALK, "walk_reach": WALK_REACH, "statement_sinks": _statement_sinks(),
        "line_sinks": _line_sinks(), "direct": DIRECT, "best": BEST, "heads": HEADS, "raw_findings": RAW_FINDINGS, "merged": MERGED, "scored": _scored("merged"),
        "baseline_rows": BASELINE_ROWS, "baseline": _scored("baseline_rows"), "summary": SUMMARY, "runs": RUNS, "counts": COUNTS, "stages": STAGES, "scans": SCANS}


def query(final: str, last: str, corpus: str = "rendered", rules=C.DETECTION_RULES) -> str:
    """``final`` over every table up to and including ``last``."""
    bodies = tables(corpus, rules)
    names = ORDER[: ORDER.index(last) + 1]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({bodies[n]})" for n in names) + " " + final
