"""Licenses: what the gate and the keywords skip must hold no match of any rule."""

import re
from itertools import product

from pyspark.sql import functions as F

from quillon.llm import licenses


def texts(parsed, least=False):
    """Texts that a parsed pattern matches: by every alternative, optional parts in and out (least: out)."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            some = [chr(arg)]
        elif kind == "NOT_LITERAL":
            some = ["z"]
        elif kind == "IN":
            some = [chr(x) for _, x in arg]
        elif kind == "BRANCH":
            some = [t for branch in arg[1] for t in texts(branch, least)]
        elif kind == "SUBPATTERN":
            some = texts(arg[3], least)
        else:
            assert kind == "MAX_REPEAT", kind
            low, high, inner = arg
            some = [t * n for n in ({low} if least else {low, min(int(high), low + 1)}) for t in texts(inner, least)]
        out = [a + b for a, b in product(out, some)]
    return out


def parts(pattern, least=False):
    return texts(re._parser.parse(pattern), least)


def ungated(text):
    return licenses.detect(text.encode(), [(p, (b"",), *rest) for p, _, *rest in licenses.rules()])


def scanned(spark, many):
    rows = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(8)
    return {r.doc_id: (r.labels, [(s.word, s.label, s.confidence) for s in r.spans]) for r in licenses.scan_licenses(rows).collect()}


def spans(text):
    return [(text.count(" ", 0, s), label, w) for s, _, _, label, w in sorted(ungated(text))]


def test_gate_passes_every_text_a_rule_matches(spark):
    """One text of each family in each form, optional words left out, and every wording."""
    many = [text for form, *_ in licenses.FORMS for _, k, name in licenses.FAMILIES for n in parts(name, True)[:1] for text in parts(form.format(re.escape(n)), True)]
    many += [text for _, _, wording, _ in licenses.WORDINGS for text in parts(wording)] + [p for p, _ in licenses.BASE]
    many += ["released under the gplv3", "distributed under the mit", "distributed under the gpl v2"]
    got = scanned(spark, many)
    for i, text in enumerate(many):
        assert spans(text), text
        assert got[i][1] == spans(text), text
    assert [got[i][0] for i in range(len(many) - 3, len(many))] == ["gpl", "mit", "gpl"]


def test_every_alternative_of_every_rule_is_detected(spark):
    many = [text for form, *_ in licenses.FORMS for _, _, name in licenses.FAMILIES for n in parts(name) for text in parts(form.format(re.escape(n.replace(",", ""))), True)]
    many += ["released under the expat license", "x consortium license", "licensed under the psf"]
    got = scanned(spark, many)
    assert [got[i][0] for i in range(len(many) - 3, len(many))] == ["mit", "x11", "python-2.0"]
    for i, text in enumerate(many):
        assert spans(text) and got[i][1] == spans(text), text


def test_long_texts_of_notices_take_time_in_proportion():
    text = b" ".join([b"licensed under the mit license and the gnu general public license version 3"] * 12_000)
    found = licenses.detect(text, licenses.rules())
    assert len(found) >= 24_000


def brute_base(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(-1, None), (-2, ""), (-3, "MIT\nLicense, mit license"), (-4, "é1mit license mit\u00a0license"), (-5, "general public license\x7fgeneral public license"), (-5, "apache license")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"labels": F.lit("x"), "score": F.lit("y")})
    text = lambda r: (r.doc_id, brute_base(r.text))
    want = sorted(map(text, docs.collect()), key=str)
    got = sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.scan_licenses(docs).collect()), key=str)
    assert got == want
