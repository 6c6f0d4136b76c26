import random
import re

import pytest

import innkeep.llm.role_repair as R


def plain(roles, costs):
    """Sequential dynamic programming with the documented rule for ties."""
    repair, v, trail = R.Repair(costs), [0, R.INF, R.INF, R.INF], []
    for role in roles:
        best = [(R.INF, 0, 0, 0)] * 4
        for s in range(4):
            if v[s] < R.INF:
                for new, cost, action, n in repair.moves(s, role):
                    best[new] = min(best[new], (v[s] + cost, s, action, n))
        trail.append(best)
        v = [b[0] for b in best]
    state, out = repair.end(tuple(v)), []
    for b in reversed(trail):
        out.append((R.ROLES[state], R.ACTIONS[b[state][2]], b[state][3]))
        state = b[state][1]
    return out[::-1]


def exhaustive(roles, costs):
    """Cheapest total over every choice of actions."""
    repair, best = R.Repair(costs), {0: 0}
    for role in roles:
        nxt = {}
        for s, c in best.items():
            for new, cost, _, _ in repair.moves(s, role):
                nxt[new] = min(nxt.get(new, R.INF), c + cost)
        best = nxt
    end = {R.ASSISTANT: 0, R.USER: costs.insert, R.SYSTEM: 2 * costs.insert}
    return min(c + end[s] for s, c in best.items())


def total(rows, costs):
    names = {"keep": 0, "merge": costs.merge, "relabel": 0, "relabel_merge": costs.merge}
    cost = 0
    for r in rows:
        cost += names[r.action] + costs.insert * (r.inserted + r.tail)
        if r.action.startswith("relabel"):
            cost += costs.name if R.role_number(r.role) == R.START else costs.relabel
    return cost


def order(r):
    return tuple((x is not None, x if x is not None else 0) for x in r[:2]) + ((r[2] is not None, r[2] or ""),)


@pytest.mark.parametrize("rows_a_part, fan, broadcast", [(7, 1024, 1000), (2, 3, 1000), (7, 4, 0), (20_000, 1024, 1000)])
def test_repairs_are_cheapest_and_legal(spark, monkeypatch, rows_a_part, fan, broadcast):
    """Also in trees of several levels over one conversation's parts, and with states that meet the turns by a shuffle."""
    monkeypatch.setattr(R, "PART_ROWS", rows_a_part)
    monkeypatch.setattr(R, "FAN", fan)
    monkeypatch.setattr(R, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    rows = []
    for c in [*range(10), None]:
        for t in range(60 if c is None else rng.choice([1, 2, 3, 9, 40])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "human", "?", None, "USER "]), rng.choice(["x", "y", None, ""])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    costs = R.Costs()
    by, got = {}, {}
    for r in sorted(rows, key=order):
        by.setdefault(r[0], []).append(r)
    for r in R.repair_roles(df, costs).collect():
        got.setdefault(r.conv_id, []).append(r)
    for c, turns in by.items():
        out = got[c]
        assert [(r.turn, r.role) for r in out] == [(t[1], t[2]) for t in turns]
        roles = [R.role_number(t[2]) for t in turns]
        assert [(r.new_role, r.action, r.inserted) for r in out] == plain(roles, costs)
        assert total(out, costs) == exhaustive(roles, costs)
        text = "".join(r.piece for r in out)
        names = re.findall(r"<\|(system|user|assistant)\|>", text)
        body = names[1:] if names[0] == "system" else names
        assert body and len(body) % 2 == 0 and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(body))
        assert text.count("<|end|>") == len(names)


def test_all_conversations_and_an_empty_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out = R.repair_roles(turns)
    assert out.count() == turns.count()
    assert R.repair_roles(turns.limit(0)).collect() == []
