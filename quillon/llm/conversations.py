"""Conversation structure repair by cost layers of reachable grammar states.

The roles of a conversation must follow a grammar; each turn is kept, given another role or deleted, and turns
without text may be inserted, all at fixed costs. For every place between turns the layers say, for each increasing
cost, from which grammar states (a bitset) the rest can be repaired at that cost or less; a layer follows from lower
layers of the next place and of its own by shifts through the grammar (one delete, one new role, one insert lower).
Costs of states differ by a few edits at most, so a place has few layers that are neither empty nor full; taken
relative to its first one, there are only some dozens of different lists of layers. Steps between them are worked out
once each, so a turn costs one look-up however much a conversation's repair costs. At the first place the first layer
that holds the start state gives the cost; following the bits forward gives the least audit.

As a list of layers follows from the next one alone, pieces of a long conversation are functions over those lists and
compose: they are worked out apart, chained, and traced apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, lean, stash, table
from quillon.llm.decontam import small

# The grammar s?(ua)+ or nothing, over role initials, and the costs of the edits.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT, START = (0, 3), 0
FILL = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

LETTERS = "sua"
CLASSES = len(LETTERS) + 1  # an initial's place in LETTERS; all others are one class
FINE, CUT, GO = 0, 1, 2  # a turn's fault: none, truncated, blank or duplicate; its code is class + CLASSES * fault
LONG_ROWS, LONG_BYTES = 10_000, 8 << 20  # beyond either a conversation is repaired in pieces
PIECE_BITS = 16  # a piece has at most 2**16 turns


class Repairs:
    """Layer lists, the steps between them, and the edits along them."""

    def __init__(self):
        self.states = range(1 + max(max(q, to) for (q, _), to in MOVES.items()))
        self.full = (1 << len(self.states)) - 1
        self.number: dict[tuple, int] = {}
        self.layers: list[tuple] = []
        self.rank: list[list[int]] = []
        self.steps: dict = {}
        self.edits: dict = {}
        self.fill = {}
        for (q, x), to in MOVES.items():
            if x in FILL:
                if q in self.fill:
                    raise ValueError("two roles can be filled in at one state")
                self.fill[q] = (to, FILL[x])
        self.last = self.add(self.raised(lambda t: sum(1 << q for q in ACCEPT)))[0]

    def add(self, layers: list[int]) -> tuple[int, int]:
        """(number of the list, empty layers before it)"""
        empty = next(t for t, b in enumerate(layers) if b)
        key = tuple(layers[empty:])
        if key not in self.number:
            self.number[key] = len(self.layers)
            self.layers.append(key)
            self.rank.append([next(t for t, b in enumerate(key) if b >> q & 1) for q in self.states])
        return self.number[key], empty

    def before(self, letter: str, bits: int) -> int:
        return sum(1 << q for q in self.states if (to := MOVES.get((q, letter))) is not None and bits >> to & 1)

    def filled(self, bits: int) -> int:
        return sum(1 << q for q, (to, _) in self.fill.items() if bits >> to & 1)

    def raised(self, own) -> list[int]:
        """Layers of a place from what its turn allows at each cost, and inserts; up to the first full one."""
        out: list[int] = []
        while not out or out[-1] != self.full:
            t = len(out)
            if t > 100:
                raise ValueError("a state of the grammar can't be repaired by inserts")
            out.append(own(t) | (self.filled(out[t - INSERT]) if t >= INSERT else 0) | (out[-1] if out else 0))
        return out

    def step(self, after: int, code: int) -> tuple[int, int]:
        """(layers before a turn, what its base costs more) from the layers after it."""
        if (after, code) not in self.steps:
            known, (fault, kind) = self.layers[after], divmod(code, CLASSES)
            at = lambda t: 0 if t < 0 else known[min(t, len(known) - 1)]

            def own(t):
                bits = at(t - DELETE)
                if fault != GO:
                    if kind < len(LETTERS):
                        bits |= self.before(LETTERS[kind], at(t - TRUNCATED * fault))
                    bits |= self.filled(at(t - REROLE - TRUNCATED * fault))
                return bits

            self.steps[after, code] = self.add(self.raised(own))
        return self.steps[after, code]

    def turn(self, after: int, code: int) -> list[tuple[list, int]]:
        """For each state before a turn its edits (initial, role if it is new) and the state after it; of equally cheap
        edits the ASCII-least initial first."""
        if (after, code) not in self.edits:
            (here, more), (fault, kind) = self.step(after, code), divmod(code, CLASSES)
            rank, then, out = self.rank[here], self.rank[after], []
            for q in self.states:
                done: list = []
                while True:
                    left = rank[q] + more
                    if then[q] + DELETE == left:
                        done.append(("D", None))
                        break
                    if q in self.fill and rank[self.fill[q][0]] + INSERT == rank[q]:
                        q, role = self.fill[q]
                        done.append(("I", role))
                        continue
                    to = MOVES.get((q, LETTERS[kind])) if kind < len(LETTERS) else None
                    if fault != GO and to is not None and then[to] + TRUNCATED * fault == left:
                        q = to
                        done.append(("K", None))
                    else:
                        q, role = self.fill[q]
                        done.append(("R", role))
                    break
                out.append((done, q))
            self.edits[after, code] = out
        return self.edits[after, code]

    def end(self, q: int) -> list:
        """The inserts after the last turn."""
        done = []
        while self.rank[self.last][q]:
            q, role = self.fill[q]
            done.append(("I", role))
        return done

    def trace(self, codes, after: int, q: int) -> tuple[list, int]:
        """(the edits at each turn, the state after the last) from a state, given the layers after the last turn."""
        places = [after]
        for c in reversed(codes):
            places.append(self.step(places[-1], c)[0])
        places.reverse()
        out = []
        for i, c in enumerate(codes):
            done, q = self.turn(places[i + 1], c)[q]
            out.append(done)
        return out, q

    def whole(self, codes: bytes) -> tuple[int, list]:
        """(cost, the edits at each turn) of a whole conversation; inserts at its end stand with the last turn."""
        at, cost = self.last, 0
        for c in reversed(codes):
            at, more = self.step(at, c)
            cost += more
        cost += self.rank[at][START]
        edits, q = self.trace(codes, self.last, START)
        if edits:
            edits[-1] = edits[-1] + self.end(q)
        return cost, edits

    def close(self) -> None:
        """Works out all lists of layers there are, and tables of all steps and states."""
        at, codes = 0, range(3 * CLASSES)
        while at < len(self.layers):
            for c in codes:
                self.turn(at, c)
            at += 1
        n = len(self.layers)
        self.to = np.array([[self.steps[i, c][0] for i in range(n)] for c in codes], np.int32)
        self.more = np.array([[self.steps[i, c][1] for i in range(n)] for c in codes], np.int64)
        self.goes = np.array([[[q for _, q in self.edits[i, c]] for i in range(n)] for c in codes], np.int32)

    def piece(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every list of layers after a piece: the one before it, its cost, and the states that states go to."""
        n = len(self.layers)
        places, cost = np.zeros((len(codes) + 1, n), np.int32), np.zeros(n, np.int64)
        places[-1] = np.arange(n)
        for i in range(len(codes) - 1, -1, -1):
            cost += self.more[codes[i]][places[i + 1]]
            places[i] = self.to[codes[i]][places[i + 1]]
        q = np.repeat(np.arange(len(self.states), dtype=np.int32)[None], n, 0)
        for i, c in enumerate(codes):
            q = self.goes[c][places[i + 1][:, None], q]
        return places[0], cost, q


@lru_cache(maxsize=1)
def repairs() -> Repairs:
    out = Repairs()
    out.close()
    return out


@lru_cache(maxsize=1 << 16)
def _short(codes: bytes) -> tuple[int, list]:
    return repairs().whole(codes)


def _legal() -> np.ndarray:
    out = np.zeros((CLASSES, CLASSES), bool)
    for a, b in LEGAL:
        out[LETTERS.index(a), LETTERS.index(b)] = True
    return out


def _illegal(codes: np.ndarray) -> int:
    kind = codes % CLASSES
    return int((~_legal()[kind[:-1], kind[1:]]).sum())


def _faults(role: Column, text: Column) -> tuple[Column, Column]:
    """(code without duplicates, blank?)"""
    initial, bare = F.substring(role, 1, 1), F.rtrim(text, F.lit(SPACE))
    kind = F.coalesce(*(F.when(initial == x, F.lit(i)) for i, x in enumerate(LETTERS)), F.lit(CLASSES - 1))
    fault = F.when(bare == "", GO).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    return (kind + CLASSES * fault).cast("int"), bare == ""


STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Repaired:
    """What repair() gives: `short`, a row for each conversation that one task could hold (conv, STATS, audit, turns
    array<struct<role, text>>), `long`, a row for each other one without the turns, and `long_turns`, their turns (conv,
    at, pos, role, text; in the order of at and pos)."""

    def __init__(self, short: DataFrame, long: DataFrame, long_turns: DataFrame):
        self.short, self.long, self.long_turns = short, long, long_turns

    def audits(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self.short.select("conv", *STATS, "audit").unionByName(self.long.select("conv", *STATS, "audit"))

    def turns(self) -> DataFrame:
        """conv, at, pos, role, text: the repaired turns as rows; at and pos give their order."""
        short = self.short.select("conv", F.lit(0).cast("long").alias("at"), F.posexplode("turns").alias("pos", "t"))
        return short.select("conv", "at", "pos", "t.role", "t.text").unionByName(self.long_turns)


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows in ranges of conversation and turn. Rows of one turn follow by role and text; rows equal in all that by
    their place as read, so that no number of them must meet in one range."""
    keys = ["conv", "turn", "role", "text", "__read"]
    return rows.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__read")


def _short_ones(rows: DataFrame) -> DataFrame:
    """One row for each conversation that lies inside a range and is short enough; of others a row that says so."""
    kind = _kind(rows, "conv")
    schema = f"conv {kind}, long boolean, {', '.join(f'{x} long' for x in STATS)}, audit string, turns array<struct<role:string,text:string>>"

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held, nobody = 0, object()
        now, first, turns, size, long = nobody, True, [], 0, False

        def finish(last: bool) -> None:
            nonlocal held
            if now is nobody:
                return
            if first or last or long:
                out.append({"conv": now, "long": True})
                return
            codes, seen, blank, duplicate, cut = [], set(), 0, 0, 0
            numbers = [t for t, *_ in turns if t is not None]
            for _, role, text, code in turns:
                fault = code // CLASSES
                if fault == GO:
                    blank += 1
                elif (role, text) in seen:
                    duplicate += 1
                    code += CLASSES * (GO - fault)
                else:
                    seen.add((role, text))
                    cut += fault == CUT
                codes.append(code)
            cost, edits = _short(bytes(codes)) if len(codes) <= 64 else repairs().whole(bytes(codes))
            repaired = []
            for (_, role, text, _), done in zip(turns, edits):
                for op, new in done:
                    if op != "D":
                        repaired.append({"role": new or role, "text": "" if op == "I" else text})
            gaps = numbers[-1] - numbers[0] + 1 - len(set(numbers)) if numbers else 0
            stats = [gaps, blank, duplicate, cut, _illegal(np.array(codes, np.int64)), cost]
            out.append({"conv": now, "long": False, **dict(zip(STATS, stats)), "audit": "".join(op for done in edits for op, _ in done), "turns": repaired})
            held += size

        def packed() -> pa.RecordBatch:
            types = [kinds[0], pa.bool_(), *[pa.int64()] * len(STATS), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            names = ["conv", "long", *STATS, "audit", "turns"]
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types)], names=names)

        kinds: list = []
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type]
            for conv, turn, role, text, code, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now or now is nobody:
                    if now is not nobody:
                        finish(False)
                        first = False
                    now, turns, size, long = conv, [], 0, False
                    if held > 4 << 20 or len(out) >= 5000:
                        yield packed()
                        out, held = [], 0
                if not gone and not long:
                    turns.append((turn, role, text, code))
                    size += len(text)
                    if len(turns) > LONG_ROWS or size > LONG_BYTES:
                        long, turns = True, []
        finish(True)
        if out:
            yield packed()

    return _in_order(rows).select("conv", "turn", "role", "text", "code", "gone").mapInArrow(lean(run), schema)


def _long_ones(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation in `convs`, their turns), worked out in pieces of bounded size."""
    kind, n = _kind(rows, "conv"), len(repairs().layers)
    mine = rows.join(small(convs.select(F.col("conv").alias("__c"))), F.col("conv").eqNullSafe(F.col("__c")), "left_semi").where("NOT gone")
    ordered = stash(_in_order(mine).withColumn("at", F.monotonically_increasing_id()), "long-turns")
    same = F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))
    marked = ordered.select("conv", "at", "code", same.alias("same"), (F.expr(f"code div {CLASSES}") == GO).alias("blank"))
    firsts = marked.where("NOT blank").groupBy("conv", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("__c"), F.col("same").alias("__s"), "first")
    marked = marked.join(firsts, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("same") == F.col("__s")), "left")
    again = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    codes = marked.select("conv", "at", F.when(again, F.col("code") % CLASSES + CLASSES * GO).otherwise(F.col("code")).cast("int").alias("code"), "blank", again.alias("again"))
    pieces = codes.groupBy("conv", F.expr(f"shiftright(at, {PIECE_BITS})").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "code"))).alias("turns"), F.count_if("blank").alias("blank"), F.count_if("again").alias("duplicate"))
    pieces = stash(pieces.select("conv", "block", F.col("turns.at").alias("ats"), F.col("turns.code").alias("codes"), "blank", "duplicate"), "long-pieces")

    @F.pandas_udf("to array<int>, cost array<long>, goes array<int>, truncated long, illegal long, first int, last int")
    def functions(codes: pd.Series) -> pd.DataFrame:
        out = []
        for c in codes:
            to, cost, goes = repairs().piece(c)
            out.append((to, cost, goes.ravel(), int((c // CLASSES == CUT).sum()), _illegal(c), int(c[0]) % CLASSES, int(c[-1]) % CLASSES))
        return pd.DataFrame(out, columns=["to", "cost", "goes", "truncated", "illegal", "first", "last"])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ignore_index=True)
        r, k = repairs(), len(group)
        after, cost, at = [0] * k, 0, r.last
        for i in range(k - 1, -1, -1):
            after[i] = at
            cost += int(group["cost"][i][at])
            at = int(group["to"][i][at])
        cost, q, state, wrong = cost + r.rank[at][START], START, [0] * k, int(group["illegal"].sum())
        for i in range(k):
            state[i] = q
            q = int(group["goes"][i].reshape(n, -1)[after[i], q])
            wrong += i > 0 and not _legal()[group["last"][i - 1], group["first"][i]]
        out = group[["conv", "block"]].copy()
        out["after"], out["state"], out["final"] = after, state, [i == k - 1 for i in range(k)]
        out["cost"], out["illegal"] = [cost] + [0] * (k - 1), [wrong] + [0] * (k - 1)
        return out

    worked = pieces.select("conv", "block", "blank", "duplicate", functions("codes").alias("f")).select("conv", "block", "f.*")
    chained = worked.groupBy("conv").applyInPandas(chain, f"conv {kind}, block long, after int, state int, final boolean, cost long, illegal long")
    chained = stash(chained.join(worked.select(F.col("block").alias("__b"), F.col("conv").alias("__c"), "truncated"), (F.col("block") == F.col("__b")) & F.col("conv").eqNullSafe(F.col("__c"))).drop("__b", "__c"), "long-chains")
    both = pieces.join(chained.withColumnsRenamed({"conv": "__c", "block": "__b"}), (F.col("block") == F.col("__b")) & F.col("conv").eqNullSafe(F.col("__c")))

    @F.pandas_udf("array<array<struct<op:string,role:string>>>")
    def traced(codes: pd.Series, after: pd.Series, state: pd.Series, final: pd.Series) -> pd.Series:
        out = []
        for c, a, q, last in zip(codes, after, state, final):
            edits, q = repairs().trace(c.tolist(), a, q)
            if last and edits:
                edits[-1] = edits[-1] + repairs().end(q)
            out.append([[{"op": op, "role": role} for op, role in done] for done in edits])
        return pd.Series(out, dtype=object)

    edited = stash(both.select("conv", "block", "ats", traced("codes", "after", "state", "final").alias("edits"), "blank", "duplicate", "truncated", "cost", "illegal"), "long-edits")
    part = F.array_join(F.flatten(F.transform("edits", lambda x: x["op"])), "")
    stats = edited.groupBy("conv").agg(*(F.sum(x).alias(x) for x in STATS[1:]), F.array_sort(F.collect_list(F.struct("block", part.alias("audit")))).alias("parts"))
    spans = ordered.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).select(F.col("conv").alias("__c"), "gaps")
    stats = stats.select(F.col("conv").alias("__d"), *STATS[1:], F.array_join("parts.audit", "").alias("audit"))
    out = convs.select("conv").join(stats, F.col("conv").eqNullSafe(F.col("__d")), "left").join(spans, F.col("conv").eqNullSafe(F.col("__c")), "left")
    out = out.select("conv", *(F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in STATS), F.coalesce("audit", F.lit("")).alias("audit"))
    lines = edited.select(F.explode(F.arrays_zip("ats", "edits")).alias("x")).select(F.col("x.ats").alias("__at"), F.filter("x.edits", lambda e: e["op"] != "D").alias("e"))
    turns = ordered.select("conv", "at", "role", "text").join(lines, F.col("at") == F.col("__at")).select("conv", "at", F.col("role").alias("old"), "text", F.posexplode("e").alias("pos", "e"))
    text = F.when(F.col("e.op") == "I", F.lit("")).otherwise(F.col("text"))
    return out, turns.select("conv", "at", "pos", F.coalesce("e.role", "old").alias("role"), text.alias("text"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> Repaired:
    """Repairs every conversation at least cost; of equally cheap repairs the one whose audit is ASCII-least.

    Turns are taken by their number (nulls first), those of one number by role and text. A turn's first fault counts:
    blank (no character but white space), duplicate (role and text stood earlier in the conversation), truncated (the
    last character is none of . ! ?). Edits: K keeps a turn, R gives it the role user or assistant (2), D deletes it
    (3; blank and duplicate turns must go), I inserts a turn without text (2); a truncated turn that stays costs 1. The
    audit is their initials in order, inserts before the turn they precede. gaps: numbers missing between the least and
    the largest; illegal: neighbouring turns, before the repair, whose role initials are not su, ua or au.

    gone: rows for which it is true are no turns, but their conversation is reported: without turns it has zeros, an
    empty audit and no repaired turns. Null roles and texts are one space; a null conversation id is an id like others.
    Repeated rows are duplicates. An empty table gives no rows; other columns are not read.

    Rows are sorted once, in ranges of conversation and turn, and a task works on one conversation at a time. Those that
    begin or end a range (they may go on in another) and those of more than LONG_ROWS turns or LONG_BYTES characters are
    dealt again and worked out in pieces of at most 2**PIECE_BITS turns; their duplicates are told by 128-bit hashes.
    """
    fill = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), fill(role_col).alias("role"), fill(text_col).alias("text"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"))
    rows = rows.withColumn("code", _faults(F.col("role"), F.col("text"))[0])
    found = stash(_short_ones(rows), "repaired")
    convs = stash(found.where("long").select("conv").distinct(), "long-conversations")
    return Repaired(found.where("NOT long").drop("long"), *_long_ones(rows, convs))


def hashed_lines(turns: DataFrame) -> DataFrame:
    """conv, sha256: the hash of each conversation's `role:text` lines, joined by line feeds. A hash runs through a
    conversation from end to end, so one task reads it, a batch at a time; nothing of it is held."""
    kind = _kind(turns, "conv")

    def run(batches):
        now, state, out = None, None, []
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.schema.field(0).type), pa.array([h for _, h in out])], names=["conv", "sha256"])
                out = []
            of = batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], of), pa.array([state.hexdigest()])], names=["conv", "sha256"])

    lines = turns.select("conv", F.concat("role", F.lit(":"), "text").alias("line"), "at", "pos")
    return lines.repartition("conv").sortWithinPartitions("conv", "at", "pos").select("conv", "line").mapInArrow(lean(run), f"conv {kind}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage, by crc32 of conv_id:turn modulo 20 (nulls: one space): 0 drops the row (it stays with gone),
    1 empties the text, 2 removes its . ! ?, 3 repeats the row, 4 sets the role user."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), F.explode(times).alias("copy"))


def op12_conversation_repair(spark, sf_dir):
    done = repair(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    short = done.short.select("conv", *STATS, "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    hashes = hashed_lines(done.long_turns).select(F.col("conv").alias("__c"), "sha256")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    long = done.long.join(hashes, F.col("conv").eqNullSafe(F.col("__c")), "left").select("conv", *STATS, "audit", F.coalesce("sha256", nothing).alias("repaired_sha256"))
    return short.unionByName(long).withColumnRenamed("conv", "conv_id")


def _best(*options: str) -> str:
    return f"list_min([x for x in [{', '.join(options)}] if x IS NOT NULL])"


def _sql() -> str:
    """The repair as a recursion from each conversation's last turn to its first: for each state the least
    (cost, audit, text) of the rest."""
    edit = lambda x, cost, op, line: f"{{'c': {x}.c + {cost}, 'a': '{op}' || {x}.a, 't': {line} || {x}.t}}"
    new = {q: (to, FILL[x]) for (q, x), to in MOVES.items() if x in FILL}
    insert = lambda q, of: edit(of(new[q][0]), INSERT, "I", f"chr(10) || '{new[q][1]}:'")
    row = []
    for q in range(4):
        keep = " ".join(f"WHEN r.init = '{x}' THEN {edit(f'y{to}', 'r.fault', 'K', 'chr(10) || r.line')}" for (s, x), to in MOVES.items() if s == q)
        to, role = new[q]
        again = edit(f"y{to}", f"{REROLE} + r.fault", "R", f"chr(10) || '{role}:' || r.text")
        row.append(_best(edit(f"y{q}", DELETE, "D", "''"), f"CASE WHEN r.fault = 2 THEN NULL {keep} END", f"CASE WHEN r.fault < 2 THEN {again} END") + f" AS x{q}")
    once = lambda q: insert(q, lambda to: f"x{to}")
    twice = lambda q: edit(f"({insert(new[q][0], lambda to: f'x{to}')})", INSERT, "I", f"chr(10) || '{new[q][1]}:'")
    closed = ", ".join(_best(f"x{q}", once(q), twice(q)) + f" AS y{q}" for q in range(4))
    last = ", ".join((f"{{'c': {0 if q in ACCEPT else 1000000}, 'a': '', 't': ''}}") + f" AS x{q}" for q in range(4))
    return rf"""
WITH RECURSIVE tab(tab) AS (SELECT list(v ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) t(b))),
k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS hit FROM k, tab),
w AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE r END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text, unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM w),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT *, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM g GROUP BY conv_id),
r AS (SELECT conv_id, i, substr(role, 1, 1) AS init, CASE WHEN blank OR again THEN 2 WHEN cut THEN 1 ELSE 0 END AS fault, role || ':' || text AS line, text FROM g),
b AS (SELECT conv_id, n + 1 AS i, {closed} FROM (SELECT conv_id, n, {last} FROM s)
  UNION ALL SELECT conv_id, i, {closed} FROM (SELECT b.conv_id, r.i, {', '.join(row)} FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
d AS (SELECT conv_id, y0 FROM b WHERE i = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(y0.c, 0) AS BIGINT) AS cost, coalesce(y0.a, '') AS audit, sha256(coalesce(substr(y0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = {"op12_conversation_repair": _sql()}
