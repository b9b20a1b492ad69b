import collections
import json
import math
import random
import re

import pytest

from credtrace.llm import queries as llm_queries
from credtrace.llm import chat, html_blocks, html_text

PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><a href=1>Home</a></nav><div class="cookie-notice">We use cookies, sorry.</div><article><header><h1>Head line</h1></header>
<p>First &amp; foremost,   a paragraph with <b>bold</b> words.<p>Second one; it has a <a href="x">link</a> and more. Ends.
<ul><li>point<li>other point</ul><p>Last<br>line, broken.</article>
<div id="comments"><p>Great text, thanks a lot, I liked it.</p></div><aside>More stories, here.</aside><form>Your name, please</form>
<footer>&copy; 2020, all of it.</footer></body></html>"""


def test_main_text(spark):
    want = ("Head line\nFirst & foremost, a paragraph with bold words.\nSecond one; it has a link and more. Ends.\npoint\nother point\n"
            "Last\nline, broken.")
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>cut off, here &am"), (4, "x", "plain, text\n only"),
            (5, "y", "<div>" * 3000 + "<p>deep, text."), (6, "z", "<p title='a>b'>kept</p><!-- gone"), (7, "z", "<nav>only a menu</nav>")]
    pages = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    texts = [want, want, "", "", "cut off, here &am", "plain, text only", "deep, text.", "kept", ""]
    assert sorted(map(repr, got)) == sorted(repr((a, b, t, len(t))) for (a, b, _), t in zip(rows, texts))
    assert html_text.extract(pages.limit(0)).isEmpty()


ARTICLE = "<article><h1>Head</h1><p>Some text, rather long; it has commas, and full stops.</p></article>"
COMMENTS = "".join(f"<p>Reader {k} writes a lot, and at length, about what was said above.</p>" for k in range(4))


@pytest.mark.parametrize("page, want", [
    # The length of what a name leaves out does not matter.
    (f"<div><p>Short news, one line.</p></div><div class='comments'>{COMMENTS}</div>", "Short news, one line."),
    (f"<div class='comments'>{COMMENTS}</div>", ""),
    # A name on what wraps the article is the page's own.
    (f"<div class='header-layout has-sidebar'>{ARTICLE}<div class='comments'>{COMMENTS}</div></div>",
     "Head\nSome text, rather long; it has commas, and full stops."),
    # Open embedded elements do not swallow the page; raw ones do.
    *[(f"<article><p>Before, it begins.</p><{tag}><g>inner</g><p>After it, there is more; and more.</p></article>",
       "Before, it begins.\nAfter it, there is more; and more.") for tag in ("svg", "object", "math", "video", "canvas", "select")],
    ("<article><p>Before, it begins.</p><svg><text>drawn, words.</text></svg><p>After it, more.</p></article>", "Before, it begins.\nAfter it, more."),
    ("<article><p>Before, it begins.</p><script>var a = 1; <p>After, all code.</p></article>", "Before, it begins."),
    # Repeated and very long blocks stay.
    ("<article>" + "<p>Same, again and again.</p>" * 3 + "</article>", "\n".join(["Same, again and again."] * 3)),
    ("<article><p>" + "many words, in one. " * 60000 + "</p></article>", ("many words, in one. " * 60000).strip())])
def test_what_belongs_to_an_article(page, want):
    assert html_text.main_text(page) == want


def plain_scores(paths, lengths, marks):
    """Fused ratios by the formula, a loop for every sum."""
    def smooth(ratio):
        out = []
        for k in range(len(ratio)):
            weights = [(math.exp(-j * j / 2), ratio[min(max(k + j, 0), len(ratio) - 1)]) for j in range(-2, 3)]
            out.append(sum(w * r for w, r in weights) / sum(w for w, _ in weights))
        return [x / max(out) if max(out) else x for x in out]

    def per_path(values):
        own = collections.defaultdict(list)
        for p, v in zip(paths, values):
            own[p].append(v)
        return [sum(own[p]) / len(own[p]) for p in paths]

    return [math.sqrt(a * b) for a, b in zip(smooth(per_path(lengths)), smooth(per_path([m + 1 for m in marks])))]


def test_path_ratios_against_the_formula():
    rng = random.Random(3)
    page = "".join(f"<{t}><p>{'words, and ' * rng.randint(0, 9)}end.</p></{t}><span>{'x' * rng.randint(1, 30)}</span>"
                   for t in rng.choices(["div", "section", "blockquote", "td"], k=60))
    _, blocks = html_blocks.read(page)
    got = html_text.path_scores(blocks, 1.0)
    want = plain_scores([b.path for b in blocks], [max(len(b.text) - b.linked, 0) for b in blocks], [len(re.findall(r"[.,]", b.text)) for b in blocks])
    assert got.tolist() == pytest.approx(want) and len(blocks) > 100


def test_arguments_that_are_no_json_are_kept(spark):
    calls = [{"id": "a", "name": "add", "arguments": '{"x": 1, "x": 2}'}, {"id": "b", "name": "add", "arguments": "x=1"}, {"name": "add", "arguments": "{}"},
             {"name": "add", "arguments": "{}"}]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls}))] * 2 + [(2, 0, "user", "word " * 300000)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.no_tools(spark)).collect()
    by = collections.Counter((r["call_id"], r["json"], r["problems"]) for r in got if r["kind"] == "call")
    assert by == {("a", '{"arguments_text":"{\\"x\\": 1, \\"x\\": 2}","id":"a","name":"add"}', "unknown tool; arguments are no JSON"): 2,
                  ("b", '{"arguments_text":"x=1","id":"b","name":"add"}', "unknown tool; arguments are no JSON"): 2,
                  (None, '{"arguments":{},"name":"add"}', "unknown tool"): 4}
    assert [len(r["json"]) for r in got if r["conv_id"] == 2] == [1500000 + len('{"content":"","role":"user"}')]


def test_links_and_validation(spark):
    call = lambda i, **a: {"id": i, "name": "add", "arguments": a}
    rows = [(1, 0, "user", "add 1 and 2"), (1, 1, "assistant", json.dumps({"content": "sure", "tool_calls": [call("c1", b=2, a=1), call("c2", a="x")]})),
            (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": "bad"})), (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
            (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (2, 0, "user", None), (2, 1, None, ""), (None, 0, "user", "{broken"),
            (3, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "function": {"name": "add", "arguments": "{\"b\":1, \"a\":2.5}"}, "depends_on": ["b"]}]})),
            (3, 1, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "gone", "arguments": {}}]})),
            (3, 2, "tool", json.dumps({"tool_call_id": "b", "content": "r"})),
            (4, 0, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "add", "arguments": {"a": 1, "b": 2}, "depends_on": ["q"]},
                                                           {"id": "q", "name": "add", "arguments": [], "depends_on": ["p"]}]}))]
    talks = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    tools = spark.createDataFrame([("add", "a", "number", True), ("add", "b", "number", True)], chat.TOOLS)
    got = chat.format_chat(talks, tools).collect()
    by = {(r["conv_id"], r["kind"], r["call_id"]): r for r in got if r["kind"] != "message"}
    assert by[1, "call", "c1"]["problems"] == "" and by[1, "call", "c1"]["json"] == '{"arguments":{"a":1,"b":2},"id":"c1","name":"add"}'
    assert by[1, "call", "c2"]["problems"] == "missing b; type of a" and by[1, "result", "c2"]["is_linked"]
    assert by[1, "result", "zz"]["problems"] == "result without call" and not by[1, "result", "zz"]["is_linked"]
    assert by[3, "call", "b"]["problems"] == "unknown tool" and by[3, "call", "a"]["level"] == 1 and by[3, "call", "a"]["order_turn"] == 2
    assert by[4, "call", "p"]["problems"] == "circular" and by[4, "call", "q"]["problems"] == "arguments are no object; circular"
    messages = sorted((r["conv_id"] or 0, r["turn"], r["json"]) for r in got if r["kind"] == "message")
    assert messages == [(0, 0, '{"content":"{broken","role":"user"}'), (1, 0, '{"content":"add 1 and 2","role":"user"}'),
                        (1, 1, '{"content":"sure","role":"assistant"}'), (2, 0, '{"role":"user"}'), (2, 1, '{"content":""}')]
    assert chat.format_chat(talks.limit(0), tools).isEmpty()


def test_tools_that_a_conversation_declares(spark, tmp_path):
    schema = {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "string"}, "c": {"type": ["string", "null"]}}, "required": ["a"]}
    declared = json.dumps({"tools": [{"type": "function", "function": {"name": "add", "parameters": schema}}, {"name": "now"}]})
    calls = json.dumps({"tool_calls": [{"id": "x", "name": "add", "arguments": {"a": 1, "c": 2}}, {"id": "y", "name": "add", "arguments": {"b": 3}},
                                       {"id": "z", "name": "now", "arguments": {}}]})
    rows = [(1, 0, "system", declared), (1, 1, "assistant", calls), (2, 0, "system", "be kind"), (2, 1, "assistant", calls), (None, 0, "system", declared),
            (None, 1, "assistant", calls)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = llm_queries.op8_chat(spark, str(tmp_path)).collect()
    said = {(r["conv_id"], r["call_id"]): r["problems"] for r in got if r["kind"] == "call"}
    for conversation in (1, None):
        assert [said[conversation, c] for c in "xyz"] == ["", "missing a; type of b", ""]
    assert {said[2, c] for c in "xyz"} == {"unknown tool"} and sum(r["kind"] == "message" for r in got) == 3
