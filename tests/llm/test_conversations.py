import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def least(rows):
    """Forward search over (cost, audit) for each grammar state; rows: (initial, fault)."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for q, (c, a, t) in list(out.items()):
                for x in "ua":
                    if (q, x) in moves:
                        new = (c + 2, a + "I", t + [C.FILL[x] + ":"])
                        to = moves[q, x]
                        if to not in out or new[:2] < out[to][:2]:
                            out[to] = new
        return out

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for q, (c, a, t) in inserted(best).items():
            options = [(q, (c + 3, a + "D", t))]
            if fault != "go":
                more = fault == "cut"
                if (q, role[:1]) in moves:
                    options.append((moves[q, role[:1]], (c + more, a + "K", t + [f"{role}:{text}"])))
                options += [(moves[q, x], (c + 2 + more, a + "R", t + [f"{C.FILL[x]}:{text}"])) for x in "ua" if (q, x) in moves]
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    return min((v for q, v in inserted(best).items() if q in (0, 3)), key=lambda v: v[:2])


def expected(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, faults, counts = set(), [], {"go": 0, "dup": 0, "cut": 0}
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        if not bare:
            kind = "blank"
        elif (role, text) in seen:
            kind = "dup"
        else:
            kind = "fine" if bare[-1] in ".!?" else "cut"
        seen.add((role, text))
        faults.append(kind)
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, lines = least([(r, x, "go" if k in ("blank", "dup") else k) for (_, r, x), k in zip(rows, faults)])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("dup"), "truncated": faults.count("cut"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def check(got, by_conv, kept):
    assert len(got) == len(by_conv)
    for r in got:
        want = expected(kept.get(r["conv"], [])) if kept.get(r["conv"]) else {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "sha": hashlib.sha256(b"").hexdigest()}
        have = {k: r[k] for k in want if k != "sha"} | {"sha": r["sha"]}
        assert have == want, r["conv"]


def digests(done):
    short = done.short.select("conv", *C.STATS, "audit", F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256).alias("sha"))
    hashes = C.hashed_lines(done.long_turns).select(F.col("conv").alias("c"), "sha256")
    long = done.long.join(hashes, F.col("conv").eqNullSafe(F.col("c")), "left").select("conv", *C.STATS, "audit", F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("sha"))
    return [r.asDict() for r in short.unionByName(long).collect()]


TEXTS = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "end. \n", "é.", "...", "a\tb"]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sage"]


def test_random_conversations_against_search(spark):
    rnd = random.Random(5)
    rows = [(c if c else None, rnd.choice([None, *range(9)]), rnd.choice(ROLES), rnd.choice(TEXTS)) for c in range(60) for _ in range(rnd.randrange(1, 14))]
    rows += [(1000, i, "user" if i % 2 == 0 else "assistant", "Fine.") for i in range(40)]  # repeated turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("at", F.lit(1))
    kept = {}
    for c, t, r, x in rows:
        kept.setdefault(c, []).append((t, r, x))
    check(digests(C.repair(df)), kept, kept)


def test_long_conversation_goes_in_pieces(spark):
    rnd = random.Random(6)
    rows = [(7, t, rnd.choice(ROLES[:6]), f"{rnd.randrange(9000)}{rnd.choice(['.', '!', ''])}") for t in range(0, 24_000, 2)]
    rows += [(8, None, "user", "same.")] * 11_000  # one row many times
    rows += [(9, 1, "user", "x" * 9_000_000 + "."), (10, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = C.repair(df)
    kept = {}
    for c, t, r, x in rows:
        kept.setdefault(c, []).append((t, r, x))
    assert {r.conv for r in done.long.select("conv").collect()} >= {7, 8, 9}
    check(digests(done), kept, kept)
    turns = done.turns().where("conv = 8").collect()
    assert [(r.role, r.text) for r in sorted(turns, key=lambda r: (r.at, r.pos))] == [("user", "same."), ("assistant", "")]


def test_pieces_compose():
    """A conversation's repair is that of its pieces, chained through the tables."""
    rnd, r = random.Random(3), C.repairs()
    codes = [rnd.randrange(3 * C.CLASSES) for _ in range(300)]
    cost, edits = r.whole(bytes(codes))
    cuts = [0, 1, 50, 51, 200, 300]
    at, total, after = r.last, 0, []
    tables = [r.piece(np.array(codes[a:b])) for a, b in zip(cuts, cuts[1:])]
    for to, more, _ in reversed(tables):
        after.append(at)
        total += more[at]
        at = to[at]
    assert total + r.rank[at][C.START] == cost
    q, done = C.START, []
    for (a, b), lid, (_, _, goes) in zip(zip(cuts, cuts[1:]), reversed(after), tables):
        part, to = r.trace(codes[a:b], lid, q)
        assert goes[lid, q] == to
        q, done = to, done + part
    done[-1] = done[-1] + r.end(q)
    assert done == edits


def test_query_damage_and_dropped_conversations(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], [None, "Done.", "Half"][(c * t) % 3]) for c in range(80) for t in range(3)]
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(100_000, None, "user", "Null turn.")] + ([(gone, 0, "user", "Lost.")] if gone >= 80 else [])
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    kept, convs = {}, {c for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        hit = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if hit:
            x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
            kept.setdefault(c, []).extend([(t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1))
    got = [r.asDict() for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()]
    check([{**r, "conv": r["conv_id"], "sha": r["repaired_sha256"]} for r in got], convs, kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = C.repair(df)
    assert done.audits().count() == 0 and done.turns().count() == 0
    assert C.repair(df.withColumn("gone", F.lit(True)), gone=F.col("gone")).audits().count() == 0


@pytest.mark.parametrize("codes,audit,cost", [("", "", 0), ("u", "KI", 2), ("s", "D", 3), ("su", "KKI", 2), ("uu", "KR", 2), ("aa", "RK", 2), ("x", "D", 3), ("a", "IK", 2)])
def test_small_repairs(codes, audit, cost):
    found, edits = C.repairs().whole(bytes(C.LETTERS.find(c) if c in C.LETTERS else 3 for c in codes))
    assert (found, "".join(op for done in edits for op, _ in done)) == (cost, audit)
    assert least([(c, "x", "fine") for c in codes])[:2] == (cost, audit)
