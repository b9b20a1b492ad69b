"""Token alignment against a plain version that walks the bytes of each text."""

import bisect
import collections
import hashlib

import numpy as np
import pytest

from credtrace.llm import token_align
from tests.llm.cases import awkward, docs

TEXTS = [None, "", " ", "  two  spaces ", "plain words, then more words", "<|endoftext|> <s></s> <unk> <0x41>", "▁ is a piece's own space", "日本語 and 😀😀 mixed\twith\ttabs\n\n",
         "é" * 300, "a" * 5000, "x" * 33 + " " * 200 + "y", "\x00 null byte", "plain words, then more words", "Ünïcödé ﬁ ligature ½", "word " * 20000]


def plain(rows, folder=token_align.FOLDER):
    """(doc_id, ...) by set operations over byte positions."""
    tools = token_align.pair(folder, token_align.FILE_A, token_align.FILE_B)
    symbols = token_align.byte_symbols()
    found = []
    for i, text, *_ in rows:
        a = tools.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tools.b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        bytes_a = [bytes(symbols[c] for c in tools.a.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(tools.b.id_to_piece(x)[3:5], 16)]) if tools.b.is_byte(x) else tools.b.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append((i, [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_x, to_y = bisect.bisect(ends_a, cut), bisect.bisect(ends_b, cut)
            groups.append((a[x:to_x], b[y:to_y]))
            x, y = to_x, to_y
        found.append((i, a, b, groups))
    counts = collections.Counter()
    links = [collections.Counter((x, y) for g in groups for x in g[0] for y in g[1]) for *_, groups in found]
    for one in links:
        counts.update(one.keys())
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (i, a, b, groups), one in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), sum(one.values()), sum(n for p, n in one.items() if counts[p] == most[p[0]]),
                    sum(n * counts[p] for p, n in one.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return collections.Counter(out)


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("head", [token_align.HEAD, 3])
def test_against_plain_version(spark, head):
    rows = [(k, t, "en", "a") for k, t in enumerate(TEXTS)] + awkward()
    got = token_align.align(docs(spark, rows), head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == plain(rows)


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    from credtrace.llm import queries
    assert rows_of(queries.op13_token_align(spark, "/root/testdata/sf0.001")) == plain(rows)


def test_no_rows(spark):
    assert token_align.align(docs(spark, [])).collect() == []


def test_long_chains_of_overlaps():
    """Sides that never end together but at the last byte are one group, in a logarithm of the steps."""
    ends_a, ends_b = np.append(np.arange(2, 40001, 2), 40001), np.append(np.arange(1, 40001, 2), 40001)
    a, b = token_align.group_numbers(ends_a, ends_b)
    assert not a.any() and not b.any()
    same = np.arange(1, 1000)
    a, b = token_align.group_numbers(same, same)
    assert a.tolist() == b.tolist() == list(range(999))


def test_large_group_is_counted_by_its_ids(monkeypatch):
    ids_a, ids_b = np.array([1, 2, 1, 5, 7]), np.array([3, 3, 4, 9])
    args = ids_a, ids_b, np.array([4, 1]), np.array([3, 1]), np.array([0, 1]), 10
    whole = [x.tolist() for x in token_align.linked_pairs(*args)]
    monkeypatch.setattr(token_align, "BATCH_LINKS", 2)
    assert [x.tolist() for x in token_align.linked_pairs(*args)] == whole
    assert whole == [[0] * 6 + [1], [13, 14, 23, 24, 53, 54, 79], [4, 2, 2, 1, 2, 1, 1]]


def test_both_encoders_of_the_first_tokenizer_agree():
    """Every character that the faster library is trusted with, beside letters, digits, signs, spaces and itself."""
    tools = token_align.pair(token_align.FOLDER, token_align.FILE_A, token_align.FILE_B)
    assert tools.ranked is not None
    for k in range(0x250):
        c = chr(k)
        text = f"a{c}b {c}1{c}{c} {c} 's{c}'ll -{c}-{c}  {c}\n{c}"
        assert tools.ranked.encode_ordinary(text) == tools.a.encode(text, add_special_tokens=False).ids, hex(k)


def test_unusual_texts_go_to_the_slower_library():
    assert token_align.unusual("日") and token_align.unusual("a " + "x" * 1000) and token_align.unusual("a" + " " * 1002 + "b")
    assert not token_align.unusual("Ünïcödé words " * 100)
