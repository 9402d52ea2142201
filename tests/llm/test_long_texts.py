"""Texts that repeat one thing very often take time in proportion to their length."""

import random
import time

from quillon.llm import linededup, toxicity

LINE = "this line is long enough to be counted as a repeated one"


def slow_measure(folded, automaton):
    free, hits = [], {}
    for end, (kind, n, w) in automaton.iter(folded):
        if kind:
            free.append((end - n + 1, end))
        else:
            hits[end - n + 1] = max(w, hits.get(end - n + 1, 0.0))
    return sum(w for s, w in hits.items() if not any(a <= s < b for a, b in free))


def test_exceptions_in_one_sweep():
    model = toxicity.Model({f" {t} ": 3.0 for t in toxicity.SEED} | {" tras": 1.0})
    automaton, rnd = model.automaton(), random.Random(2)
    words = ["trash", "can", "bin", "not", "stupid", "an", "idiot", "class", "clown", "fish", "x"]
    for _ in range(200):
        folded = toxicity.fold(" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))))
        assert toxicity.Model.measures(folded, automaton)[0] == slow_measure(folded, automaton)
    began = time.process_time()
    total, _ = toxicity.Model.measures(toxicity.fold("trash can " * 100_000 + "trash"), automaton)
    assert total == 3.0 and time.process_time() - began < 4


def test_many_repeated_lines(spark):
    lines = [f"{LINE} {i}" for i in range(40_000)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(i, text + f"\nown {i}") for i in range(5)] + [(9, "short"), (10, None)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    assert time.time() - began < 60
    assert all((got[i].text, got[i].n_dropped) == (f"own {i}", 40_000) for i in range(4))
    assert got[4].n_dropped == 0 and got[4].text == text + "\nown 4" and got[9].text == "short" and (got[10].text, got[10].n_lines) == ("", 1)
