import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tracelake.llm.structure_repair import Trie, op11_structure_repair, repair, symbol

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost and audit of (initial, fault) rows: every way from the end backwards, by whole strings."""

    @functools.cache
    def best(k, state, inserts=3):
        """inserts: so many more at most before row k."""
        found = [(0, "")] if k == len(rows) and state in ("", "a") else []
        to = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        ways = [("I", 3, k, to, inserts - 1)] if inserts else []
        if k < len(rows):
            initial, fault = rows[k]
            ways.append(("D", 4, k + 1, state, 3))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                ways.append(("R", 3 + more, k + 1, to, 3))
                if initial == to or (state == "" and initial == "s"):
                    ways.append(("K", more, k + 1, initial, 3))
        for name, price, *there in ways:
            cost, audit = best(*there)
            found.append((cost + price, name + audit))
        return min(found, default=(10**9, ""))

    return best(0, "")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def plain(rows):
    """The whole answer for one conversation's rows."""
    rows = damaged(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(BLANKS)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    out, k = [], 0
    for edit in audit:
        new = "assistant" if out and out[-1][0][0] == "u" else "user"
        if edit == "I":
            out.append((new, ""))
            continue
        _, role, text = rows[k]
        k += 1
        if edit != "D":
            out.append((role if edit == "K" else new, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(found, rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    assert sorted(map(repr, by)) == sorted(repr(r.conv_id) for r in found)
    for r in found:
        assert tuple(r[n] for n in NAMES) == plain(by[r.conv_id]), r.conv_id


def test_trie_against_all_edits():
    rng = random.Random(5)
    cases = {""}
    for _ in range(1500):
        kinds = rng.choice([["", "", "blank", "truncated", "duplicate"], ["", "truncated"], [""]])
        cases.add(tuple((rng.choice("suax"), rng.choice(kinds)) for _ in range(rng.randint(0, 9))))
    coded = sorted({("".join(symbol(i, f) for i, f in c), c) for c in cases if c})
    trie = Trie()
    for signature, case in coded:
        assert trie.find(signature) == cheapest(case), case


def test_trie_on_long_and_tied_signatures():
    for letters in ("u" * 60, "a" * 61, "uuaa" * 20, "sU" * 40, "xdX" * 20, "s" * 50):
        rows = [({"d": "u"}.get(x, x.lower()), "blank" if x == "d" else "truncated" if x.isupper() else "") for x in letters]
        assert Trie().find(letters) == cheapest(rows)
    long = Trie()
    cost, audit = long.find("u" * 300_000)
    assert len(audit.replace("I", "")) == 300_000 and cost == 3 * 150_000


def test_layers_are_shared():
    trie = Trie()
    trie.find("suauaUa")
    before = trie.layers[:6]
    trie.find("suauad")
    assert all(a is b for a, b in zip(before, trie.layers, strict=False)) and len(trie.layers) == 7


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_whole_table(spark, scale):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '/root/testdata/{scale}/conversations.parquet'").fetchall()
    compare(op11_structure_repair(spark, f"/root/testdata/{scale}").collect(), rows)


def test_odd_rows(spark):
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Üser", "u"], ["Hi.", "Hi", "", None, " \n", "Ok! \t", "x" * 70_000 + ".", "漢字 😀?", "end. "]
    rows = [(c, t, rng.choice(roles[:4] + roles[5:]), rng.choice(texts)) for c in [*range(40), None] for t in [None, *range(rng.randint(0, 9)), 3, 3]]
    rows += [(7, 2, "user", "Hi.")] * 5 + [(99, None, None, None)] + [(100, t, "user", "word") for t in range(120)] + [(101, -(2**63), "user", "a."), (101, 2**63 - 1, "assistant", "b.")]
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", gone string, signature int")
    found = repair(data).collect()
    assert {r.gaps for r in found if r.conv_id == 101} <= {0, 2**63 - 1}
    compare([r for r in found if r.conv_id != 101], [r for r in rows if r[0] != 101])


def test_empty_role_cannot_be_kept(spark):
    rows = [(k, t, "", "a.") for k in range(5) for t in range(2)]
    assert all("K" not in r.audit for r in repair(spark.createDataFrame(rows, SCHEMA)).collect() if zlib.crc32(f"{r.conv_id}:0".encode()) % 20 != 4 and zlib.crc32(f"{r.conv_id}:1".encode()) % 20 != 4)


def test_text_ids_and_empty_table(spark):
    rows = [("a", 1, "user", "q?"), ("a", 2, "assistant", "r."), ("b", 1, "user", "q?")]
    assert {r.conv_id for r in repair(spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))).collect()} == {"a", "b"}
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
