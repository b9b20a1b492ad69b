"""The registered queries: one per operator or natural group, over whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.functions import text as T
from credtrace.operators import dataflow as D
from credtrace.operators import detect, findings, reconstruct, sinks
from credtrace.plans import pipeline as P
from credtrace.plans import serving, stores
from credtrace.sources import corpus

Q = {}
KEY = ["scan_id", "file_path"]
CUSTOM_RULES = (("Vendor Ticket", 0.5, 1, r"AKIA([0-9A-F]{8})"), ("Hash Literal", 0.4, 0, r"[0-9a-f]{32}"))


def query(name: str):
    def register(fn):
        Q[name] = fn
        return fn
    return register


def corpora(name: str):
    return lambda spark, d: getattr(corpus, name)(spark, d)


rendered, documents, pages, conversations = (corpora(n) for n in ("rendered", "documents", "pages", "conversations"))


# ---- sources ----

def _files(load):
    return lambda spark, d: load(spark, d).select("scan_id", "repository", "file_path", "language",
                                                  F.col("size").cast("bigint").alias("size"),
                                                  F.col("line_count").cast("bigint").alias("line_count"))


Q["s1_rendered_corpus"] = _files(rendered)
Q["s1_documents_corpus"] = _files(documents)
Q["s1_pages_corpus"] = _files(pages)
Q["s1_conversations_corpus"] = _files(conversations)

DIRECTORIES = ["src", "node_modules/left", "lib/Build", "app/tests", ".git/hooks", "docs/env", "pkg/mock", "a/b.c"]
NAMES = ["app.py", "index.JS", "Dockerfile", ".env.local", "Makefile", "photo.png", "notes.txt", "main.tf",
         "archive.tar.gz", ".gitignore", "a.b.env", "util_test.go", "View.TSX"]


def paths(spark: SparkSession, d: str) -> DataFrame:
    """A file path per part row, over every mix of eight directories and thirteen names."""
    k = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    return corpus.read(spark, d, "part").select(F.concat(
        pick(DIRECTORIES, k), F.lit("/p"), k.cast("string"), F.lit("/"),
        pick(NAMES, F.floor(k / len(DIRECTORIES)))).alias("file_path"))


Q["s2_supported_files"] = lambda spark, d: paths(spark, d).filter(corpus.is_supported(F.col("file_path")))
Q["s3_directory_prune"] = lambda spark, d: paths(spark, d).filter(
    ~corpus.in_skipped_directory(F.col("file_path"), ["B.C"]))
Q["s9_language_tag"] = lambda spark, d: paths(spark, d).select(
    "file_path", corpus.language_of(F.col("file_path")).alias("language"))
Q["s4_size_gate"] = lambda spark, d: corpus.documents(spark, d).filter(
    corpus.within_size(F.col("size"), 4096)).select("file_path", F.col("size").cast("bigint").alias("size"))


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw bytes: Windows line ends, a bad byte at the end, a NUL in front of every fifth."""
    text = F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "utf-8")
    body = F.concat(text, F.lit(bytes([0xFF])))
    return corpus.read(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(bytes([0])), body)).otherwise(body).alias("content"))


Q["s5_binary_gate"] = lambda spark, d: _bytes(spark, d).filter(~corpus.is_binary(F.col("content"))).select("doc_id")
Q["s6_decode"] = lambda spark, d: _bytes(spark, d).filter(~corpus.is_binary(F.col("content"))).select(
    "doc_id", F.md5(corpus.decode_text(F.col("content"))).alias("text_md5"))
Q["s7_minified_gate"] = lambda spark, d: corpus.documents(spark, d).select(
    "file_path", corpus.is_minified(F.col("content")).cast("int").alias("minified"))
Q["s8_line_count_gate"] = lambda spark, d: corpus.gate(corpus.documents(spark, d), max_line_count=8).select(
    "file_path", F.col("line_count").cast("bigint").alias("line_count"))
Q["s10_lines"] = lambda spark, d: corpus.lines(documents(spark, d)).select(
    "file_path", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("a12_file_summary")
def _(spark, d):
    summary = corpus.file_summary(rendered(spark, d).unionByName(documents(spark, d)).unionByName(pages(spark, d)))
    entries = F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summary.withColumn("languages", F.array_join(entries, ","))


# ---- projections and predicates ----

Q["p1_code_context"] = lambda spark, d: detect.with_lines(rendered(spark, d)).select(
    *KEY, F.explode(F.transform("lines", lambda l, i: F.struct(
        (i + 1).cast("bigint").alias("line_no"),
        T.line_window(F.col("lines"), i + 1).alias("code_context")))).alias("x")).select(*KEY, "x.*")


def _candidates(frame: DataFrame) -> DataFrame:
    return frame.select(
        *KEY, F.col("ord").cast("bigint").alias("ord"), F.col("line_number").cast("bigint").alias("line_number"),
        F.col("column").cast("bigint").alias("column"), "value", "secret_type", "detection_method",
        F.round("confidence", 6).alias("confidence"), F.round("entropy_score", 6).alias("entropy_score"),
        "context_variable", F.md5("code_context").alias("context_md5"))


for _name, _load in (("rendered", rendered), ("documents", documents), ("pages", pages), ("conversations", conversations)):
    Q[f"p2_candidates_{_name}"] = lambda spark, d, load=_load: _candidates(detect.candidates(load(spark, d)))
    Q[f"p19_filtered_{_name}"] = lambda spark, d, load=_load: _candidates(detect.filtered(load(spark, d)))
Q["p19_filtered_test_files_allowed"] = lambda spark, d: _candidates(
    detect.filtered(rendered(spark, d), allow_test_files=True))
Q["p4_custom_rules"] = lambda spark, d: _candidates(detect.candidates(rendered(spark, d), CUSTOM_RULES))
Q["p5_provider_type"] = lambda spark, d: detect.candidates(rendered(spark, d)).filter(
    "detection_method = 'regex'").groupBy("secret_type").agg(F.count("*").alias("n"))
Q["p6_assigned_variable"] = lambda spark, d: corpus.lines(rendered(spark, d)).select(
    *KEY, F.col("line_no").cast("bigint").alias("line_no"), T.assigned_variable(F.col("line")).alias("variable"))
Q["p7_context_variable"] = lambda spark, d: detect.candidates(rendered(spark, d)).select(
    *KEY, F.col("ord").cast("bigint").alias("ord"),
    T.context_variable(F.col("code_context"), F.col("value")).alias("variable"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Values of every string class per customer: digest, base64, name, segment."""
    h = F.md5("c_name")
    return corpus.read(spark, d, "customer").select("c_custkey", F.explode(F.array(
        h, F.base64(h.cast("binary")), F.col("c_name"), F.col("c_mktsegment"), F.lit(""), F.repeat(F.lit("a"), 12)))
        .alias("value"))


Q["p8_entropy"] = lambda spark, d: _words(spark, d).select(
    "c_custkey", "value", F.round(T.shannon_entropy(F.col("value")), 6).alias("entropy"))
Q["p9_string_class"] = lambda spark, d: _words(spark, d).select(
    "c_custkey", "value", T.string_class(F.col("value")).alias("string_class"),
    T.entropy_threshold(F.col("value")).alias("threshold"))
Q["p10_literals"] = lambda spark, d: corpus.lines(pages(spark, d)).select(
    "file_path", F.col("line_no").cast("bigint").alias("line_no"),
    F.explode(F.regexp_extract_all("line", F.lit(C.QUOTED_LITERAL), F.lit(1))).alias("value"))
Q["p12_credential_keywords"] = lambda spark, d: corpus.lines(documents(spark, d)).select(
    "file_path", F.col("line_no").cast("bigint").alias("line_no"),
    T.has_credential_keyword(F.col("line")).cast("int").alias("has_keyword"))


@query("p13_entropy_candidates")
def _(spark, d):
    return _candidates(detect.candidates(rendered(spark, d)).filter("detection_method = 'entropy'"))


def _varied(column: str, *shapes) -> Column:
    """One of several texts per customer, by key."""
    out = None
    for i, s in enumerate(shapes):
        out = F.when(F.col("c_custkey") % len(shapes) == i, s) if out is None else out.when(
            F.col("c_custkey") % len(shapes) == i, s)
    return out.alias(column)


def _placeholder_values(spark, d):
    name, h = F.col("c_name"), F.md5("c_name")
    return corpus.read(spark, d, "customer").select("c_custkey", _varied(
        "value", name, h, F.concat(F.lit("your_"), name), F.concat(F.lit("Test"), h),
        F.concat(h, F.lit("YourKeyHere")), F.repeat(F.substring(h, 1, 1), 9), F.repeat(F.substring(h, 1, 2), 6),
        F.repeat(F.substring(h, 1, 3), 5), F.lit("changeme"), F.lit(" Password "), F.lit("a-b_a-b"),
        F.repeat(F.substring(h, 1, 3), 4)))


Q["p14_placeholders"] = lambda spark, d: _placeholder_values(spark, d).select(
    "c_custkey", "value", T.is_placeholder(F.col("value")).cast("int").alias("placeholder"))
Q["p15_environment_source"] = lambda spark, d: corpus.lines(rendered(spark, d)).filter(
    T.is_environment_sourced(F.col("line"))).select(*KEY, F.col("line_no").cast("bigint").alias("line_no"), "line")


def _contexts(spark, d):
    """Windows in and out of comments and doc strings around a line that holds the customer's digest."""
    line = F.concat(F.lit('key = "'), F.md5("c_name"), F.lit('"'))
    j = lambda *xs: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in xs])
    return corpus.read(spark, d, "customer").select("c_custkey", _varied(
        "context", line, j("# Example: use this", line), j('"""doc', line), j('"""doc"""', line), j("/* open", line, "x"),
        j("/* open */", line), j("a", "b", "// e.g. a demo", line, "c"), j(">>> run()", line), j("* @param x", line),
        j("# TODO later", line), j("'''", "'''", line), j("plain", line, "plain")))


Q["p16_documentation_context"] = lambda spark, d: _contexts(spark, d).select(
    "c_custkey", "context", T.is_documentation(F.col("context")).cast("int").alias("documentation"))
Q["p11_comment_lines"] = lambda spark, d: _contexts(spark, d).select(
    "c_custkey", F.explode(F.split("context", "\n", -1)).alias("line")).filter(T.is_comment_line(F.col("line")))
Q["p17_test_path"] = lambda spark, d: paths(spark, d).select(
    "file_path", T.is_test_path(F.col("file_path")).cast("int").alias("test_path"))
Q["p18_config_variable"] = lambda spark, d: corpus.read(spark, d, "customer").select(
    "c_custkey", _varied("name", F.lower("c_mktsegment"), F.concat(F.lit("default_"), F.col("c_mktsegment")),
                         F.lit("MockKey"), F.lit("api_key"), F.lit("my_Template"))).withColumn(
    "config", T.is_config_variable(F.col("name")).cast("int"))
Q["p20_mask"] = lambda spark, d: corpus.read(spark, d, "customer").select("c_custkey", F.substring(
    F.md5("c_name"), F.lit(1), (F.col("c_custkey") % 20).cast("int")).alias("value")).withColumn(
    "masked", T.mask(F.col("value")))


# ---- reconstruction ----

Q["r1_symbols"] = lambda spark, d: reconstruct.symbols(rendered(spark, d)).filter("kind = 'literal'").select(
    *KEY, "variable", "value", F.col("line_no").cast("bigint").alias("line_no"))
Q["r2_aliases"] = lambda spark, d: reconstruct.symbols(rendered(spark, d)).filter("kind = 'name'").select(
    *KEY, "variable", "value", F.col("line_no").cast("bigint").alias("line_no"))


def _rebuilt(frame: DataFrame, *more) -> DataFrame:
    return frame.select(*KEY, F.col("ord").cast("bigint").alias("ord"), "target",
                        F.col("line_no").cast("bigint").alias("line_no"), "kind", "value", "status", *more)


for _name, _kind in (("r3_concatenation", "concat"), ("r4_r8_templates", "template"), ("r7_base64", "decode")):
    Q[_name] = lambda spark, d, kind=_kind: _rebuilt(reconstruct.reconstructions(rendered(spark, d)).filter(
        F.col("kind") == kind))


def _made(rows: DataFrame, scan_id: str) -> DataFrame:
    """Files from rendered paths (``p``) and texts (``t``)."""
    return corpus.as_files(corpus.settled(rows), F.lit(scan_id), F.lit("r"), F.col("p"), F.col("t"))


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """One Python and one JavaScript file per customer that build a value with format, join and ``+``."""
    h = F.md5("c_name")
    a, b = F.substring(h, 1, 16), F.substring(h, 17, 16)
    py = F.concat_ws("\n", F.concat(F.lit('left = "'), a, F.lit('"')), F.concat(F.lit('right = "'), b, F.lit('"')),
                     F.lit('by_format = "{}-{r}".format(left, r=right)'), F.lit('by_join = "/".join([left, "x", right])'),
                     F.lit("chain = by_join"), F.lit("late = chain + missing"), F.lit("nothing = gone + lost"))
    js = F.concat_ws("\n", F.concat(F.lit("const left = '"), a, F.lit("';")), F.concat(F.lit('let right = "'), b, F.lit('";')),
                     F.lit("export const both = left + '.' + right;"), F.lit("const wrapped = `<${both}>`;"))
    rows = corpus.dealt(corpus.read(spark, d, "customer").select("c_custkey", "c_name")).select(
        F.col("c_custkey").cast("string").alias("k"), F.explode(F.array(
            F.struct(F.lit("py").alias("e"), py.alias("t")), F.struct(F.lit("js").alias("e"), js.alias("t")))).alias("f"))
    return _made(rows.select(F.concat(F.lit("m"), F.col("k"), F.lit("."), F.col("f.e")).alias("p"), F.col("f.t")
                             .alias("t")), "assembled")


Q["r5_format_r6_join_r9_languages"] = lambda spark, d: reconstruct.reconstructions(assembled(spark, d)).select(
    "file_path", "target", "kind", "value", "status")
def doubled(spark: SparkSession, d: str) -> DataFrame:
    """One Python file per nation whose value doubles forty times, and one that decodes what it doubled twenty times."""
    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5("n_name"), 1, 16)))
    chain = [F.concat(F.lit('a0 = "'), key, F.lit('"')), *(F.lit(f"a{k} = a{k - 1} + a{k - 1}") for k in range(1, 41))]
    coded = [F.concat(F.lit('b0 = "'), F.base64(F.concat(F.md5("n_name"), F.lit("!")).cast("binary")), F.lit('"')),
             *(F.lit(f"b{k} = b{k - 1} + b{k - 1}") for k in range(1, 16)), F.lit("dec = base64.b64decode(b15).decode()"), F.lit('tail = dec + "?"')]
    nations = corpus.read(spark, d, "nation").withColumn("c_custkey", F.col("n_nationkey"))
    rows = corpus.dealt(nations).select(F.explode(F.array(
        F.struct(F.concat(F.lit("chain"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("p"), F.concat_ws("\n", *chain).alias("t")),
        F.struct(F.concat(F.lit("coded"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("p"), F.concat_ws("\n", *coded).alias("t")))).alias("f"))
    return _made(rows.select("f.p", "f.t"), "doubled")


@query("r3_r7_long_values")
def _(spark, d):
    """Length, entropy and type of values that double far beyond what any text could hold, and of a long decoded one."""
    rows = reconstruct.reconstructions(doubled(spark, d)).filter("target IN ('a1', 'a17', 'a40', 'dec', 'tail')")
    return rows.select("file_path", "target", "kind", "status", "length", F.round("entropy", 6).alias("entropy"),
                       "secret_type", F.col("is_secret").cast("int").alias("is_secret"), "reason", F.md5("value").alias("shown_md5"))


Q["r10_status_counts"] = lambda spark, d: reconstruct.reconstructions(rendered(spark, d)).groupBy("kind", "status").agg(
    F.count("*").alias("n"))
Q["r11_fragments"] = lambda spark, d: reconstruct.reconstructions(rendered(spark, d)).select(
    *KEY, "target", F.posexplode("fragments").alias("pos", "g")).select(
    *KEY, "target", F.col("pos").cast("bigint").alias("pos"), "g.variable", F.coalesce("g.value", F.lit("")).alias("value"),
    F.col("g.line").cast("bigint").alias("line"), F.col("g.resolved").cast("int").alias("resolved"))
Q["r12_validation"] = lambda spark, d: _rebuilt(
    reconstruct.reconstructions(rendered(spark, d)), F.col("is_secret").cast("int").alias("is_secret"),
    F.round("confidence", 6).alias("confidence"), "secret_type", "reason")
Q["r13_value_type"] = lambda spark, d: _words(spark, d).select(
    "c_custkey", "value", T.reconstructed_type(F.col("value")).alias("secret_type"))


# ---- dataflow and sinks ----

def _analysed(spark, d):
    return P.with_facts(P.with_seeds(P.secret_files(rendered(spark, d))))


def _flows(spark, d):
    return (P.with_flows(_analysed(spark, d)).select(*KEY, "language", F.explode_outer("flows").alias("x"))
            .filter(F.col("x").isNotNull()).select(*KEY, "language", "x.*"))


Q["d1_seeds"] = lambda spark, d: (
    P.with_seeds(P.secret_files(rendered(spark, d))).select(*KEY, F.explode_outer("seeds").alias("s"))
    .filter(F.col("s").isNotNull()).select(*KEY, "s.variable", F.col("s.line").cast("bigint").alias("line"), "s.value"))


def _nodes(spark, d, *operations, python=True):
    nodes = _flows(spark, d).filter((F.col("language") == "Python") == F.lit(python)).select(
        *KEY, F.col("variable").alias("seed"), F.posexplode("nodes").alias("ord", "n")).filter(F.col("n.source").isNotNull())
    if operations:
        nodes = nodes.filter(F.col("n.operation").isin(*operations))
    return nodes.select(*KEY, "seed", F.col("ord").cast("bigint").alias("ord"), "n.variable",
                        F.col("n.line").cast("bigint").alias("line"), "n.operation", "n.source", "n.target", "n.edge",
                        "n.snippet")


Q["d2_assign_edges"] = lambda spark, d: _nodes(spark, d, "assignment")
Q["d3_dict_edges"] = lambda spark, d: _nodes(spark, d, "dict_value")


def woven(spark: SparkSession, d: str) -> DataFrame:
    """One Python file per customer whose secret runs through every kind of statement edge."""
    text = F.concat_ws("\n", F.concat(F.lit('api_key = "'), F.md5("c_name"), F.lit('"')), F.lit("alias = api_key"),
                       F.lit('headers["X-Key"] = alias'), F.lit('full = "a" + "b" + alias'),
                       F.lit("both = full + api_key + alias"), F.lit("app.sink.push(headers, both)"),
                       F.lit("out = send(1, **both)"), F.lit("other = out"))
    rows = corpus.dealt(corpus.read(spark, d, "customer").select("c_custkey", "c_name"))
    return _made(rows.select(F.concat(F.lit("w"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("p"),
                             text.alias("t")), "woven")


@query("d4_d5_woven_edges")
def _(spark, d):
    flows = P.with_flows(P.with_facts(P.with_seeds(P.secret_files(woven(spark, d)))))
    return (flows.select("file_path", F.explode_outer("flows").alias("x")).filter("x.variable = 'api_key'")
            .select("file_path", F.posexplode("x.nodes").alias("ord", "n")).filter(F.col("n.source").isNotNull())
            .select("file_path", F.col("ord").cast("bigint").alias("ord"), F.col("n.line").cast("bigint").alias("line"),
                    "n.variable", "n.operation", "n.source", "n.target", "n.edge", "n.snippet"))


def nested(spark: SparkSession, d: str) -> DataFrame:
    """One Python file per customer that passes its secret below two hundred brackets, in an argument and in a sum."""
    text = F.concat_ws("\n", F.concat(F.lit('api_key = "'), F.md5("c_name"), F.lit('"')),
                       F.lit(f"send(1, {'(' * 100}{'[' * 100}api_key{']' * 100}{')' * 100}, x={'g(' * 200}api_key{')' * 200})"),
                       F.lit(f"full = f({'(' * 200}0{')' * 200}) + api_key + h({'(' * 200}api_key{')' * 200})"))
    rows = corpus.dealt(corpus.read(spark, d, "customer").select("c_custkey", "c_name"))
    return _made(rows.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("p"), text.alias("t")), "nested")


@query("d5_d6_nested_brackets")
def _(spark, d):
    flows = P.with_flows(P.with_facts(P.with_seeds(P.secret_files(nested(spark, d)))))
    return (flows.select("file_path", F.explode_outer("flows").alias("x")).filter("x.variable = 'api_key'")
            .select("file_path", F.posexplode("x.nodes").alias("ord", "n")).filter(F.col("n.source").isNotNull())
            .select("file_path", F.col("ord").cast("bigint").alias("ord"), F.col("n.line").cast("bigint").alias("line"),
                    "n.variable", "n.operation", "n.source", "n.target", "n.edge"))


Q["d6_d8_argument_edges"] = lambda spark, d: _nodes(spark, d, "function_argument")
Q["d7_keyword_edges"] = lambda spark, d: _nodes(spark, d, "keyword_argument")
Q["d9_line_edges"] = lambda spark, d: _nodes(spark, d, python=False)


@query("d10_taint_closure")
def _(spark, d):
    """Every name a seed taints and the first moment it does."""
    names = F.zip_with("seeds", "reach", lambda s, r: F.struct(s["variable"].alias("seed"), r["tainted"].alias("tainted")))
    return (P.with_reach(_analysed(spark, d)).select(*KEY, F.explode_outer(names).alias("c")).filter(F.col("c").isNotNull())
            .select(*KEY, "c.seed", F.explode("c.tainted").alias("z")).select(*KEY, "seed", F.col("z.name").alias("name")))


Q["d11_paths"] = lambda spark, d: _flows(spark, d).select(
    *KEY, F.col("variable").alias("seed"), F.array_join(F.transform("nodes", lambda n: n["variable"]), " → ").alias("path"),
    F.size("nodes").cast("bigint").alias("length"))


def _functions(spark, d):
    """Function names called anywhere in the rendered corpus, with variants around them."""
    table = detect.with_lines(rendered(spark, d)).select(F.explode_outer(D.line_table(F.col("lines"))).alias("t")).filter(
        F.col("t").isNotNull())
    called = table.select(F.explode("t.calls.func").alias("function")).distinct()
    return called.select(F.explode(F.array(
        F.col("function"), F.concat(F.lit("x."), F.col("function")), F.concat(F.col("function"), F.lit(".more")),
        F.upper("function"), F.concat(F.lit("a.b."), F.substring_index("function", ".", -1)))).alias("function")).distinct()


Q["k1_sink_match"] = lambda spark, d: _functions(spark, d).select("function", *[
    T.matches_sink(F.col("function"), names).cast("int").alias(label) for label, names in (
        ("network", C.NETWORK_SINKS), ("log", C.LOG_SINKS), ("file", C.FILE_SINKS), ("database", C.DATABASE_SINKS))])
Q["k2_classify_sink"] = lambda spark, d: _functions(spark, d).withColumn(
    "code", F.concat(F.lit("send(password, "), F.col("function"), F.lit(")"))).withColumn(
    "s", T.classify_sink(F.col("function"), F.lit(1), F.col("code"))).select(
    "function", "s.sink_type", "s.risk_level", "s.description")


def _sinks(spark, d, field: str):
    return (_flows(spark, d).select(*KEY, F.col("variable").alias("seed"), F.explode(field).alias("s"))
            .select(*KEY, "seed", "s.sink_type", "s.risk_level", "s.function", F.col("s.line").cast("bigint").alias("line"),
                    "s.code", "s.description"))


Q["k3_graph_sinks"] = lambda spark, d: _sinks(spark, d, "from_graph")


def _each_seed(found, build):
    """Sinks of every seed, from what it reaches."""
    rows = F.zip_with("seeds", "reach", lambda s, r: F.struct(s["variable"].alias("seed"), build(s["variable"], r).alias("sinks")))
    return (P.with_reach(found).select(*KEY, F.explode_outer(rows).alias("r")).filter(F.col("r").isNotNull())
            .select(*KEY, "r.seed", F.explode("r.sinks").alias("s"))
            .select(*KEY, "seed", "s.sink_type", "s.risk_level", "s.function",
                    F.col("s.line").cast("bigint").alias("line"), "s.code", "s.description"))


Q["k4_statement_sinks"] = lambda spark, d: _each_seed(_analysed(spark, d), lambda v, r: sinks.statement_sinks(r["walk"], F.col("sinks_of.walk")))
Q["k5_line_sinks"] = lambda spark, d: _each_seed(_analysed(spark, d), lambda v, r: sinks.line_sinks(
    F.col("table"), F.col("sinks_of.calls"), v, r["lines"]))
Q["k7_direct_sinks"] = lambda spark, d: _sinks(spark, d, "direct")
Q["k8_best_sink"] = lambda spark, d: _flows(spark, d).filter(F.col("sink").isNotNull()).select(
    *KEY, F.col("variable").alias("seed"), "sink.sink_type", "sink.risk_level", "sink.function",
    F.col("sink.line").cast("bigint").alias("line"))


def contained(spark: SparkSession, d: str) -> DataFrame:
    """One file per customer with a one-line dict that carries the secret into a call."""
    h = F.md5("c_name")
    text = F.concat_ws("\n", F.concat(F.lit('api_key = "'), h, F.lit('"')), F.lit('opts = {"key": api_key}'),
                       F.lit('more = {"token": api_key}'), F.lit("client.post(url, opts)"), F.lit("print(more)"))
    rows = corpus.dealt(corpus.read(spark, d, "customer").select("c_custkey", "c_name"))
    return _made(rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".rb")).alias("p"),
                             text.alias("t")), "contained")


@query("k6_container_sinks")
def _(spark, d):
    found = P.with_facts(P.with_seeds(P.secret_files(contained(spark, d))))
    return _each_seed(found, lambda v, r: sinks.container_sinks(F.col("sinks_of.calls"), r["boxed"])).select(
        "file_path", "seed", "sink_type", "function", "line")


# ---- findings ----

def _scored(spark, d):
    return P.full_scan(rendered(spark, d))


Q["j2_j3_findings_with_flow"] = lambda spark, d: P.raw_findings(P.analysed(rendered(spark, d))).select(
    *KEY, "method", "secret", F.col("line_number").cast("bigint").alias("line_number"), "variable",
    F.coalesce(F.array_join(F.transform("nodes", lambda n: n["variable"]), " → "), F.lit("")).alias("path"),
    F.coalesce("sink.sink_type", F.lit("")).alias("sink_type"))
Q["j4_a1_merge_groups"] = lambda spark, d: P.raw_findings(P.analysed(rendered(spark, d))).select(
    *KEY, "method", "secret", F.col("line_number").cast("bigint").alias("line_number"), "group_key")


def _finding_columns(frame: DataFrame, *more) -> DataFrame:
    return frame.select(
        *KEY, "repository", "secret", F.col("line_number").cast("bigint").alias("line_number"), "secret_type",
        F.round("confidence", 6).alias("confidence"), F.round("entropy_score", 6).alias("entropy_score"),
        F.array_join("methods", ",").alias("methods"), "status",
        F.coalesce(F.array_join("path", " → "), F.lit("")).alias("path"),
        F.coalesce("sink.sink_type", F.lit("")).alias("sink_type"), *more)


Q["a2_merged_findings"] = lambda spark, d: _finding_columns(
    P.merged_findings(P.analysed(rendered(spark, d))), "group_key", "finding_id")
SCORES = ["detection_score", "sensitivity_score", "exposure_score", "propagation_score", "risk_score", "severity",
          "explanation"]
Q["a3_a8_full_scan"] = lambda spark, d: _finding_columns(_scored(spark, d), *SCORES)
Q["a3_a8_full_scan_documents"] = lambda spark, d: _finding_columns(P.full_scan(documents(spark, d)), *SCORES)
Q["a3_a8_full_scan_pages"] = lambda spark, d: _finding_columns(P.full_scan(pages(spark, d)), *SCORES)
Q["a9_ranked_findings"] = lambda spark, d: P.ranked(_scored(spark, d)).select(*KEY, "finding_id", "risk_score")
Q["a10_a11_severity_counts"] = lambda spark, d: findings.severity_counts(_scored(spark, d))
Q["a13_stage_counts"] = lambda spark, d: P.stage_counts(rendered(spark, d))
Q["a14_baseline_scan"] = lambda spark, d: _finding_columns(P.baseline_scan(rendered(spark, d)), *SCORES)
Q["a14_baseline_scan_documents"] = lambda spark, d: _finding_columns(P.baseline_scan(documents(spark, d)), *SCORES)
Q["a15_ablation"] = lambda spark, d: P.ablation(rendered(spark, d))


@query("labelled_documents")
def _(spark, d):
    """Baseline findings per label group of the documents they are in."""
    found = (P.baseline_scan(documents(spark, d)).groupBy("file_path").agg(F.count("*").alias("findings"))
             .select(F.regexp_extract("file_path", r"^doc-([0-9]+)$", 1).cast("bigint").alias("doc_id"), "findings"))
    labels = corpus.read(spark, d, "labels")
    return (found.join(labels, "doc_id", "left").groupBy(F.coalesce("quality", F.lit(-1)).alias("quality"),
                                                         F.coalesce("toxic", F.lit(-1)).alias("toxic"))
            .agg(F.count("*").alias("documents"), F.sum("findings").alias("findings")))


# ---- serving ----

def _safe(spark, d):
    return serving.safe(_scored(spark, d))


@query("p21_safe_findings")
def _(spark, d):
    show = lambda g: F.concat_ws(":", g["variable"], g["value"], g["line"].cast("string"),
                                 g["resolved"].cast("int").cast("string"))
    return _safe(spark, d).select(
        *KEY, "finding_id", "masked_secret", "reconstruction_status", "reconstructed_value_masked", "entropy_score",
        F.array_join(F.transform("fragments", show), ",").alias("fragments"), "exposure_type", "risk_score", "severity")


@query("p21_no_raw_value_left")
def _(spark, d):
    """Findings whose written form still holds the raw value; there must be none, so the count is 0."""
    written = F.to_json(F.struct(*serving.safe_columns()))
    return _scored(spark, d).select("secret", written.alias("written")).agg(
        F.count("*").alias("findings"), F.count_if(F.contains("written", "secret")).alias("leaks"))


Q["p22_redacted_context"] = lambda spark, d: _safe(spark, d).select(*KEY, "finding_id", "code_context")
Q["p22_advisory_payload"] = lambda spark, d: serving.advisory_payload(_safe(spark, d)).select(
    "scan_id", "finding_id", F.length("payload").cast("bigint").alias("n"), F.regexp_replace(
        F.substring_index("payload", "Code context:", 1), r"\s+$", "").alias("head"))


def responses(table: DataFrame) -> DataFrame:
    """Response texts around whole conversation turns; every third has no headings."""
    t = F.col("text")
    full = F.concat(F.lit("Explanation:\n"), t, F.lit("\nIMPACT: "), F.col("role"), F.lit("\nREMEDIATION:\nrotate it\n"),
                    F.lit("confidence: high\nEXECUTIVE_SUMMARY:\n"), F.concat_ws("-", "conv_id", "turn"), F.lit("\n"))
    return table.select(F.concat_ws("-", "conv_id", "turn").alias("finding_id"),
                        F.when(F.col("conv_id") % 3 == 0, t).otherwise(full).alias("response"))


Q["p23_split_response"] = lambda spark, d: serving.split_response(responses(corpus.read(spark, d, "conversations"))).select(
    "finding_id", F.md5("explanation").alias("explanation_md5"), "impact", "remediation", "confidence_assessment",
    "executive_summary")
Q["p24_report_rows"] = lambda spark, d: serving.report_rows(_safe(spark, d)).filter(
    "label NOT LIKE 'AI%'").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A run record per nation: every seventh scan failed."""
    n = F.col("n_nationkey")
    return corpus.read(spark, d, "nation").select(
        F.concat(F.lit("scan-"), n.cast("string")).alias("scan_id"), F.col("n_name").alias("repository"),
        F.when(n % 7 == 6, "failed").otherwise("completed").alias("status"), (n / 8.0).alias("scan_duration"),
        F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp").alias("created_at"))


def _scans(spark, d):
    return serving.scans(P.scan_figures(rendered(spark, d)), runs(spark, d))


SCAN_COLUMNS = ["scan_id", "repository", "status", "files_scanned", "total_lines", "findings_count", "critical", "high",
                "medium", "low", "risk_score", "candidates_found", "secrets_reconstructed", "scan_duration"]
Q["q1_list_scans"] = lambda spark, d: serving.list_scans(_scans(spark, d)).select(
    *SCAN_COLUMNS, F.col("created_at").cast("date").cast("string").alias("created_on"))
Q["q2_scan_by_id"] = lambda spark, d: serving.scan_by_id(_scans(spark, d), "scan-3").select(*SCAN_COLUMNS)
Q["q3_findings_of_scan"] = lambda spark, d: serving.findings_of_scan(_safe(spark, d), "scan-3").select(
    *KEY, "finding_id", "secret_type", "risk_score", "severity")
Q["q4_finding_by_id"] = lambda spark, d: serving.finding_by_id(_safe(spark, d), FINDING_ID).select(
    *KEY, "finding_id", "secret_type", "masked_secret")
# sha2 of scan, file and place in the file, first sixteen digits.
FINDING_ID = hashlib.sha256(b"scan-2|src/aws_0.py|4294967296").hexdigest()[:16]
Q["q5_severity_filter"] = lambda spark, d: serving.by_severity(_safe(spark, d), "CRITICAL").select(
    *KEY, "finding_id", "severity")
Q["q6_portfolio_totals"] = lambda spark, d: serving.portfolio_totals(_scans(spark, d)).withColumn(
    "average_risk", F.round("average_risk", 6))
Q["q7_severity_distribution"] = lambda spark, d: serving.severity_distribution(_scans(spark, d))
Q["q8_recent_scans"] = lambda spark, d: serving.recent_scans(_scans(spark, d)).select("scan_id", "repository", "status")
Q["q8_recent_risks"] = lambda spark, d: serving.recent_risks(_scans(spark, d))
Q["q9_history"] = lambda spark, d: serving.history(_scans(spark, d))
Q["q10_advisory_worklist"] = lambda spark, d: serving.advisory_worklist(_safe(spark, d)).select(
    *KEY, "finding_id", "risk_score", F.col("rank").cast("bigint").alias("rank"))


def _stored(spark, d):
    """The folder of a findings table: a first version of all scans with the lowest findings only, one that was never committed, then
    the findings as they are. The corpus is scanned once, what is stored is read after that."""
    folder = corpus.shared_folder(spark)
    serving.write_findings(_safe(spark, d), f"{folder}/scanned")
    safe = serving.read_findings(spark, f"{folder}/scanned")
    serving.write_findings(safe.filter("severity = 'LOW'"), f"{folder}/findings", safe)
    stores.prepare(safe.filter("severity = 'MEDIUM'"), f"{folder}/findings", safe)
    serving.write_findings(safe, f"{folder}/findings", safe)
    return f"{folder}/findings"


@query("s11_findings_store")
def _(spark, d):
    """Findings after they were written, written again and read back."""
    return serving.read_findings(spark, _stored(spark, d)).select(*KEY, "finding_id", "masked_secret", "risk_score", "severity", "ai_analysis_status")


@query("s11_findings_of_scan_store")
def _(spark, d):
    """One scan of the stored findings; only its partition is read."""
    return serving.read_findings(spark, _stored(spark, d), "scan-3").select(*KEY, "finding_id", "secret_type", "risk_score", "severity")


@query("s12_scan_store")
def _(spark, d):
    """Scan rows after all were written as running and the finished ones once more."""
    folder = f"{corpus.shared_folder(spark)}/scans"
    scans = _scans(spark, d).drop("languages", *P.COMPARED)
    serving.write_scans(runs(spark, d).withColumn("status", F.lit("running")), folder)
    serving.write_scans(scans, folder)
    return serving.read_scans(spark, folder).select(*SCAN_COLUMNS)


def _advised(spark, d):
    """Stored findings after the answers for every work-list finding were put back onto them."""
    folder = _stored(spark, d)
    answers = serving.advisory_worklist(serving.read_findings(spark, folder)).select("finding_id", F.concat(
        F.lit("EXPLANATION: "), F.col("secret_type"), F.lit("\nREMEDIATION: rotate")).alias("response"))
    serving.store_advisories(spark, answers, folder)
    return serving.read_findings(spark, folder)


Q["q11_advisory_merge"] = lambda spark, d: _advised(spark, d).select(
    "finding_id", "ai_explanation", "ai_remediation", "ai_impact", "ai_analysis_status")
Q["q12_report_header"] = lambda spark, d: serving.report_header(_scans(spark, d))
Q["s13_audit_events"] = lambda spark, d: serving.audit_events(_scans(spark, d)).select("action", "scan_id", "details")
Q["s13_audit_counts"] = lambda spark, d: serving.audit_counts(corpus.read(spark, d, "events").select(
    F.col("event_type").alias("action")))
