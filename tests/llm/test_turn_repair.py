"""Repair of conversations against plain recomputation: string-valued dynamic programming, and enumeration of all edits on short ones."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from linkloom.llm import turn_repair
from linkloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(signature):
    """(cost, edits) by a table of (cost, string) over all states; symbols as in the operator."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def insert(best):
        for _ in range(4):
            for p, (c, e) in list(best.items()):
                for role in "ua":
                    if q := after[p].get(role):
                        best[q] = min(best.get(q, (10**9, "")), (c + 5, e + "I"))
        return best

    best = insert({"": (0, "")})
    for x in signature:
        new = {}
        for p, (c, e) in best.items():
            moves = [(p, c + 2, "D")]
            if x != "x":
                late = 5 * x.isupper()
                moves += [(after[p][r], c + 1 + late, "R") for r in "ua" if r in after[p]]
                if x.lower() in after[p]:
                    moves.append((after[p][x.lower()], c + late, "K"))
            for q, cost, letter in moves:
                new[q] = min(new.get(q, (10**9, "")), (cost, e + letter))
        best = insert(new)
    return min(best[q] for q in ("", "a") if q in best)


def enumerated(signature, inserts=3):
    """The same by trying all edits with up to so many inserts at each place."""
    found = []
    for edits in product("DKR", repeat=len(signature)):
        if any(x == "x" and e != "D" for x, e in zip(signature, edits)):
            continue
        fixed = sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (x.isupper() and e != "D") for x, e in zip(signature, edits))
        for gaps in product(range(inserts + 1), repeat=len(signature) + 1):
            word = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            roles, at = "", 0
            for e in word:
                if e == "I":
                    roles += "?"
                else:
                    roles += "" if e == "D" else signature[at].lower() if e == "K" else "?"
                    at += 1
            for start in ("s", ""):
                n = len(roles) - len(start)
                want = start + "ua" * (n // 2)
                if n >= 0 and n % 2 == 0 and (n or not start) and all(r in ("?", w) for r, w in zip(roles, want)) and not (start and roles[0] == "?"):
                    found.append((fixed + 5 * sum(gaps), word))
    return min(found)


def test_answers_on_all_short_signatures():
    signatures = sorted("".join(s) for n in range(5) for s in product("xsSuUaAoO", repeat=n))
    got = list(turn_repair.answers(iter(signatures)))
    assert got == [(s, *cheapest(s)) for s in signatures]


def test_table_against_enumeration():
    for n in range(4):
        for s in product("xsSuUao", repeat=n):
            assert cheapest("".join(s)) == enumerated("".join(s), 2 if n == 3 else 3)


def test_long_signatures_share_layers():
    r = random.Random(5)
    base = "".join(r.choice("xsuUaAo") for _ in range(3000))
    signatures = sorted([base, base + "u", base[:1500] + "a" * 100, "ua" * 1000, "u" * 700, "a" * 700, "s" * 300])
    assert list(turn_repair.answers(iter(signatures))) == [(s, *cheapest(s)) for s in signatures]


def damaged(rows):
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        k = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        yield from [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def unhurt(rows):
    return [(c, t, *(" " if v is None else v for v in (role, text))) for c, t, role, text in rows]


def expected(rows, change=damaged):
    """conv -> all digest columns, by the wording of the contract."""
    convs = {r[0]: [] for r in rows}
    for r in change(rows):
        convs[r[0]].append(r[1:])
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in mine if t is not None}
        seen, signature, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters = WORD.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            signature += {"blank": "x", "duplicate": "x", "truncated": i.upper(), None: i}[fault]
            if fault:
                faults[fault] += 1
        inis = [r[:1] for _, r, _ in mine]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(inis, inis[1:]))
        cost, audit = cheapest(signature)
        said, at = [], 0
        for e in audit:
            due = "assistant" if said and said[-1].startswith("u") else "user"
            if e == "I":
                said.append(due + ":")
                continue
            role, text = mine[at][1:]
            at += 1
            if e != "D":
                said.append(f"{role if e == 'K' else due}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_whole_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_turn_repair"](spark, path).collect()
    assert {r.conv_id: tuple(r[k] for k in COLUMNS) for r in got} == expected(rows)
    assert len(got) == len({r.conv_id for r in got})


def messy_rows():
    r = random.Random(8)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "superuser"], ["Hello there.", "No end", "", " \t\n", None, "Why?!  \n", "中文。", "é!", "x" * 5000 + "."]
    out = [(k % 13, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)) for k in range(260)]
    out += [(None, k, ("user", "assistant")[k % 2], f"row {k}.") for k in range(9)] + [(50, None, "user", "a."), (50, None, "user", "a.")]
    out += [(60, k, ("user", "assistant")[k % 2], f"row {k % 400}{'.' * (k % 3)}") for k in range(1200)]  # long, over several partitions
    return out + out[:20]


def table(spark, rows):
    """With extra columns named like those used inside."""
    frame = [(*r, 1, "c", 2.0, b"h", "p") for r in rows]
    return spark.createDataFrame(frame, "conv_id long, turn long, role string, text string, n int, c string, t double, h binary, part string").repartition(5)


def test_messy_rows(spark):
    rows = messy_rows()
    got = turn_repair.digest(table(spark, rows)).collect()
    assert {r.c: tuple(r[k] for k in COLUMNS) for r in got} == expected(rows, unhurt)
    hurt, copies = turn_repair.damage(table(spark, rows))
    got = turn_repair.digest(hurt, copies=copies).collect()
    assert {r.c: tuple(r[k] for k in COLUMNS) for r in got} == expected(rows)


def test_repaired_rows_alternate(spark):
    rows = table(spark, messy_rows())
    convs = {}
    for r in sorted(turn_repair.repaired(rows).collect(), key=lambda r: (str(r.c), r.pos)):
        convs.setdefault(r.c, []).append((r.pos, r.role[0]))
    for said in convs.values():
        assert [p for p, _ in said] == list(range(1, len(said) + 1))
        assert re.fullmatch("s?(ua)+", "".join(i for _, i in said))


def test_conversations_that_lose_all_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (2, 0, "user", "Hi.", 1), (2, 1, "assistant", "Ho.", 1)], "conv_id long, turn long, role string, text string, copies int")
    got = {r.c: r for r in turn_repair.digest(rows, copies=rows.copies).collect()}
    assert (got[1].cost, got[1].audit, got[1].gaps, got[1].repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())
    assert (got[2].cost, got[2].audit) == (0, "KK")


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.digest(rows).count() == 0 and turn_repair.repaired(rows).count() == 0
