import hashlib
from collections import defaultdict

import pytest
from cases import documents, empty, rows

from tessera.llm import line_dedup


def brute(docs, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    low = -(2**63)
    for d, t, *_ in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(low if d is None else d)
    out = []
    for d, t, *_ in docs:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and (low if d is None else d) != max(held[key(x)]) for x in lines]
        text = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_share", [2, 1024, 4096])
def test_equals_brute_force(spark, hot_share):
    docs = documents(spark)
    out = line_dedup.line_dedup(docs, hot_share=hot_share)
    assert set(out.columns) == {*docs.columns, "text_kept", "n_lines", "n_dropped"}
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text_kept.encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == brute(rows())


def test_digest_and_empty_table(spark):
    got = sorted((tuple(r) for r in line_dedup.digest(documents(spark)).collect()), key=str)
    assert got == brute(rows())
    assert line_dedup.digest(empty(spark)).collect() == []


def test_a_common_line(spark):
    docs = [(i, f"shared line of more than twenty characters\nown {i} line with some more words", None, None, None, None, None, None) for i in range(3000)]
    out = line_dedup.digest(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs)
