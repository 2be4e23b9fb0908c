import hashlib
import itertools
import random
import re
import zlib

from terrasurvey.llm.repair import ASSISTANT, START, Conversation, align, op12_conversations, repair

SF = "/root/testdata/sf0.01"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def fits(roles):
    """Whether roles of user or assistant can be chosen for the ? so that the order is right; the roles chosen."""
    for head in ("", "s"):
        pattern = head + "ua" * ((len(roles) - len(head)) // 2)
        if len(pattern) == len(roles) and pattern != "s" and all(a == b or a == "?" and b != "s" for a, b in zip(roles, pattern, strict=True)):
            return pattern
    return None


def exhaustive(codes, most=2):
    """(cost, audit, roles) of the best of all edits with at most so many insertions at a place."""
    rows = list(zip(codes[::2], codes[1::2], strict=True))
    best = None
    choices = [("D",) if f == "d" else ("D", "K", "R") for _, f in rows]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(range(most + 1), repeat=len(rows) + 1):
            roles, audit, cost = "?" * inserts[0], "I" * inserts[0], 2 * sum(inserts)
            for (role, fault), edit, after in zip(rows, edits, inserts[1:], strict=True):
                roles += {"D": "", "K": role, "R": "?"}[edit] + "?" * after
                audit += edit + "I" * after
                cost += {"D": 3, "K": 0, "R": 2}[edit] + (fault == "t" and edit != "D")
            if (best is None or (cost, audit) < best[:2]) and (chosen := fits(roles)) is not None:
                best = (cost, audit, chosen)
    return best


def test_edits_equal_all_edits():
    rng = random.Random(3)
    for _ in range(120):
        codes = "".join(rng.choice("suua-") + rng.choice("..td") for _ in range(rng.randint(0, 4)))
        found = align(codes, START, (START, ASSISTANT))
        assert min(found.values()) == exhaustive(codes)[:2], codes


def by_states(codes):
    """(cost, audit) by a table over rows and states, for long conversations."""
    follow = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}

    def inserted(table):
        for _ in range(4):
            for s, (c, a) in list(table.items()):
                to = 3 if s == 2 else 2
                table[to] = min(table.get(to, (1 << 60, "")), (c + 2, a + "I"))
        return table

    table = inserted({0: (0, "")})
    for role, fault in zip(codes[::2], codes[1::2], strict=True):
        new = {}
        for s, (c, a) in table.items():
            ways = [(c + 3, a + "D", s)]
            if fault != "d":
                t = fault == "t"
                ways += [(c + t, a + "K", to) for r, to in follow[s] if r == role]
                ways += [(c + t + 2, a + "R", to) for r, to in follow[s] if r != "s"]
            for cost, audit, to in ways:
                new[to] = min(new.get(to, (1 << 60, "")), (cost, audit))
        table = inserted(new)
    return min(table[s] for s in (0, 3) if s in table)


def test_a_long_conversation_is_repaired_in_blocks_as_a_whole():
    rng = random.Random(4)
    for n in (1023, 1024, 1025, 5000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"text {i}", rng.choice(["sound", "sound", "blank", "truncated"])) for i in range(n)]
        held = Conversation()
        for i, (role, text, fault) in enumerate(rows):
            held.add(i, role, text, fault)
        result = held.result()
        codes = "".join((r[:1] if r[:1] in ("s", "u", "a") else "-") + {"sound": ".", "blank": "d", "truncated": "t"}[f] for r, _, f in rows)
        cost, audit = by_states(codes)
        assert result[5:7] == (cost, audit)
        assert result[7] == digest(audit, rows)


def digest(audit, rows):
    lines, at, roles = [], iter(rows), ""
    for edit in audit:
        need = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        name = {"u": "user", "a": "assistant"}[need]
        if edit == "I":
            lines.append(f"{name}:")
        else:
            role, text, *_ = next(at)
            if edit == "D":
                continue
            lines.append(f"{role if edit == 'K' else name}:{text}")
            need = role[0] if edit == "K" else need
        roles += need
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    """The results of the query from (conv_id, turn, role, text)."""
    space = lambda v: " " if v is None else str(v)
    held = {}
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        what = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        held.setdefault(conv, [])
        held[conv] += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in turns:
            kept = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "d" if not kept or (role, text) in seen else "." if kept[-1] in ".!?" else "t"
            faulty.append((role, text, fault, not kept))
            seen.add((role, text))
        cost, audit = by_states("".join((r[:1] if r[:1] in ("s", "u", "a") else "-") + f for r, _, f, _ in faulty))
        numbers = sorted({t for t, _, _ in turns if t is not None})
        gaps = numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        out[conv] = (gaps, sum(b for *_, b in faulty), sum(f == "d" and not b for _, _, f, b in faulty), sum(f == "t" for _, _, f, _ in faulty), illegal, cost, audit, digest(audit, faulty))
    return out


def held(rows):
    return {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in rows}


def test_query_equals_brute_force(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    found = op12_conversations(spark, SF).collect()
    assert len(found) == len({r[0] for r in rows}) and held(found) == plain(rows)


def test_odd_rows(spark, tmp_path):
    long = "word " * 100_000
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, None, None, None), (1, 2, "assistant", long), (None, 1, "user", "x?"), (None, None, "system", "s."), (2, 5, None, "\n\t "), (3, 1, "unknown", "kept. \n"), (3, 2, "", "no role!"), (4, 1, "user", "Füße 中文.\x0b")]
    rows += [(5, t, r, "same.") for t in range(40) for r in ("user", "assistant")] + [(c, 0, "user", "only one.") for c in range(100, 160)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, there string, fault string, cost string")
    docs.write.parquet(str(tmp_path / "conversations.parquet"))
    found = held(op12_conversations(spark, str(tmp_path)).collect())
    assert found == plain(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found.values()


def test_empty_table(spark):
    assert repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string, there boolean")).count() == 0
