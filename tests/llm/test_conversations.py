"""Conversation repair against all edit sequences, and the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from frostline.llm import conversations, repair_search
from frostline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATTERN = re.compile("(s?(ua)+)?")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def all_repairs(codes: str, most: int = 4):
    """(cost, audit, roles) of every edit sequence with up to ``most`` insertions that is legal."""
    edits = [["D"] if c in "BD" else ["D", "K", "Ru", "Ra"] for c in codes]
    for chosen in itertools.product(*edits):
        for n in range(most + 1):
            for where in itertools.combinations_with_replacement(range(len(codes) + 1), n):
                for what in itertools.product("ua", repeat=n):
                    cost, audit, roles, put = 3 * n, "", "", list(zip(where, what))
                    for i in range(len(codes) + 1):
                        for at, role in put:
                            if at == i:
                                audit, roles = audit + "I", roles + role
                        if i < len(codes):
                            edit, c = chosen[i], codes[i]
                            audit += edit[0]
                            if edit == "D":
                                cost += 4
                                continue
                            cost += 3 * (edit[0] == "R") + 3 * c.isupper()
                            roles += edit[1] if edit[0] == "R" else c.lower()
                    if PATTERN.fullmatch(roles):
                        yield cost, audit, roles


def test_search_finds_the_least_of_all_edits():
    short = ["".join(c) for n in range(3) for c in itertools.product("suaxSUAXBD", repeat=n)]
    rng = random.Random(3)
    for codes in short + ["".join(rng.choice("suaxSUAXBD") for _ in range(3)) for _ in range(60)]:
        assert repair_search.search(codes) == min(r[:2] for r in all_repairs(codes, 3)), codes


def step_by_step(codes: str) -> tuple[int, str]:
    """The same by keeping the best label per state, row after row."""
    turn, wanted = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "u", 1: "u", 2: "a", 3: "u"}
    states = {0: (0, "")}

    def insert(states):
        for _ in range(4):
            for s, (cost, audit) in list(states.items()):
                states[turn[s]] = min(states.get(turn[s], (10**9, "")), (cost + 3, audit + "I"))
        return states

    for c in codes:
        after = {}
        for s, (cost, audit) in insert(states).items():
            moves = [(4, "D", s)]
            if c not in "BD":
                cut = 3 * c.isupper()
                moves.append((3 + cut, "R", turn[s]))
                if c.lower() == "s" and s == 0:
                    moves.append((cut, "K", 1))
                elif c.lower() == wanted[s]:
                    moves.append((cut, "K", turn[s]))
            for more, initial, t in moves:
                after[t] = min(after.get(t, (10**9, "")), (cost + more, audit + initial))
        states = after
    return min(insert(states)[s] for s in (0, 3) if s in states)


def test_search_and_blocks_on_long_conversations():
    rng = random.Random(4)
    for letters in ("ua", "uaUA", "suaxSUAXBD", "u", "x", "uaB"):
        codes = "".join(rng.choice(letters) for _ in range(700))
        wanted = step_by_step(codes)
        assert repair_search.search(codes) == wanted
        states = {repair_search.START: (0, "")}
        for at in range(0, len(codes), 64):
            states = repair_search.extend(states, repair_search.block_table(codes[at : at + 64], at == 0))
        assert repair_search.close(states) == wanted


def plain_damage(table):
    out = []
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain_repair(table):
    damaged, found = plain_damage(table), []
    for conv in {r[0] for r in table}:
        rows = [r for r in damaged if r[0] == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        codes, seen = "", set()
        for _, _, role, text in rows:
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not VISIBLE.search(text):
                c = "B"
            elif (role, text) in seen:
                c = "D"
            elif VISIBLE.findall(text)[-1] not in ".!?":
                c = c.upper()
            seen.add((role, text))
            codes += c
        cost, audit = step_by_step(codes)
        left, kept, state = list(rows), [], ""
        for edit in audit:
            row = left.pop(0) if edit != "I" else None
            if edit == "D":
                continue
            role = row[2] if edit == "K" else "assistant" if state == "u" else "user"
            state = role[:1]
            kept.append(f"{role}:{row[3] if row else ''}")
        turns = {r[1] for r in rows if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        cut = sum(c.isupper() and c not in "BD" for c in codes)
        found.append((conv, gaps, codes.count("B"), codes.count("D"), cut, illegal, cost, audit, sha))
    return found


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


SCHEMA = "conv_id long, turn long, role string, text string"


def awkward():
    rng = random.Random(5)
    table = []
    for conv in [None, -1, *range(60)]:
        for turn in [None, *range(rng.randint(0, 12))]:
            role = rng.choice(["system", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", " \n", "", None, "a b!", "é? ", "ok. \t", "x" * 5000 + "."])
            table += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2])
    long = [(1000, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"c{t}."])) for t in range(900)]
    dropped = next(i for i in range(2000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return table + long + [(dropped, 0, "user", "gone.")]


def test_repair_of_awkward_rows(spark):
    table = awkward()
    rows = spark.createDataFrame(table, SCHEMA)
    for clash in ("place", "code", "hash", "kind", "cost", "audit", "blank", "tie", "at"):
        rows = rows.withColumn(clash, F.lit("clash"))
    wanted = ordered(plain_repair(table))
    for bits in (4, conversations.BLOCK_BITS):
        assert ordered(conversations.repair(rows, conversations.damage(rows), bits).collect()) == wanted
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(empty, conversations.damage(empty)).count() == 0


def test_query_matches_plain_python(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(QUERIES["op11_repair_conversations"](spark, SF).collect()) == ordered(plain_repair(table))
