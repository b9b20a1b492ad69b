"""Wrapped notices and whole licence files."""

from credtrace.llm import licences
from tests.llm.cases import docs

GPL = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
       "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
CODE = "\n".join(f"value_{k} = compute_{k}(left_{k}, right_{k})" for k in range(30))
TEXT = {}
for name, text in licences.TEXTS:
    TEXT[name] = max(text, TEXT.get(name, ""), key=len)


def found(spark, texts):
    rows = [(100 * k, t, "en", "a") for k, t in enumerate(texts)] + [(100 * k + 1, "nothing here", "en", "a") for k in range(len(texts))]
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, rows), licences.document_path()).collect()}
    return [got[100 * k] for k in range(len(texts))], [got[100 * k + 1] for k in range(len(texts))]


def test_wrapped_notices_with_code(spark):
    wrapped = ["\n".join(f"{sign} {x}" for x in GPL) for sign in ("#", "//", " *", "--", ";")]
    texts = [w + "\n" + CODE for w in wrapped] + ["/*\n" + "\n".join(GPL) + "\n*/\n" + CODE]
    texts.append("\n".join("# " + x.replace("GNU General", "GNU Affero General") for x in GPL) + "\n" + CODE)
    texts.append("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n" + CODE)
    own, _ = found(spark, texts)
    assert [r["own_licence"] for r in own] == ["GPL-3.0"] * 6 + ["AGPL-3.0", "BSD-3-Clause"]
    assert all(r["n_statements"] == 1 for r in own)


def test_whole_licence_files_speak_for_their_directory(spark):
    names = sorted(TEXT)
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "Unlicense", "AGPL-3.0", "GPL-3.0"} <= set(names)
    texts = [TEXT[n].replace("year", "2024").replace("holder", "Some Body Ltd") for n in names]
    own, beside = found(spark, texts)
    assert [r["own_licence"] for r in own] == names
    assert [r["licence"] for r in beside] == names and all(r["own_licence"] is None for r in beside)


def test_full_text_as_a_comment_above_code(spark):
    texts = ["\n".join("# " + x for x in TEXT[n].split("\n")) + "\n" + CODE for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause")]
    own, _ = found(spark, texts)
    assert [r["own_licence"] for r in own] == ["MIT", "BSD-2-Clause", "BSD-3-Clause"]
