"""The audit of filters against plain Python, with every awkward case."""

import collections
import itertools
import re

import pytest

from graphloom.llm import filter_audit

from .tables import SCHEMA, docs, rows


def brute(table, labels):
    """table: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in table:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failing = []
    for i, text, lang in table:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = ("A" * (len(w) < 200)) + ("B" * (100 * len(set(w)) < 50 * len(w))) + ("C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)))
        f += ("D" * bool(re.search(r"[#$%&*|]", text))) + ("E" * (i is not None and i > first[text]))
        failing.append((lang or "", f, i in good, i in toxic))
    out = []
    for part in {x[0] for x in failing}:
        mine = [x[1:] for x in failing if x[0] == part]
        total, made = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left, gone = mine, []
            for step, letter in enumerate(order, 1):
                hit = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                total[letter] += len(hit)
                made.append(["".join(order), step, letter, len(left), len(hit), sum(letter in x[0] for x in gone), sum(x[0] == letter for x in mine), sum(x[1] for x in hit), sum(x[2] for x in hit)])
                gone = gone + hit
        out += [(part, *x, total[x[2]]) for x in made]
    return sorted(out)


def got(df):
    names = ["part", "filter_order", "step", "filter", *filter_audit.COUNTS, "shapley"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


LABELS = [(0, 1, 0), (0, 0, 1), (1, None, 1), (2, 1, None), (None, 1, 1), (7000, 1, 1), (99999, 1, 1)]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_awkward_documents(spark, labels):
    some = rows()
    words = " ".join(f"w{i}" for i in range(230))
    tail = some[0][5:]
    some += [(500 + i, x, "en", "s", None, *tail) for i, x in enumerate([words, words, words + " $", words.upper(), "A " * 300, words + " %", None, ""])]
    want = brute([(r[0], r[1], r[2]) for r in some], LABELS)
    assert got(filter_audit.audited(docs(spark, some), labels)) == want


def test_a_hot_copy_and_missing_ids(spark, labels):
    some = [(i % 40 if i % 3 else None, "the same text" if i % 2 else f"text {i % 7} #", ("en", "fr")[i % 5 == 0], None, None, *rows()[0][5:]) for i in range(600)]
    assert got(filter_audit.audited(docs(spark, some), labels)) == brute([(r[0], r[1], r[2]) for r in some], LABELS)


def test_an_empty_table(spark, labels):
    assert filter_audit.audited(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_no_labels(spark):
    out = filter_audit.audited(docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.good_lost, r.toxic_lost) for r in out.collect()} == {(0, 0)}
