"""Taint through branches against every way through them, contexts against a worklist, phrases against a plain search."""

import random

from skein.operators import branches, phrases, taint

EVENTS = "fn string, seq long, op string, target string, inputs array<string>, tags array<string>"


def by_hand(rows):
    """A stack of environments over one function's rows in order."""
    env, stack = {}, []
    join = lambda envs: {v: set().union(*[e.get(v, set()) for e in envs]) for v in {k for e in envs for k in e}}

    def close():
        before, arms, more = stack.pop()
        return join([*arms, env] if more else [*arms, env, before])

    for _, _, op, target, inputs, tags in sorted(rows, key=lambda r: (r[1], r[2], r[3] or "")):
        got = set().union(*[env.get(v, set()) for v in inputs or []]) if inputs else set()
        if op == "open":
            stack.append([dict(env), [], False])
        elif op == "else" and stack:
            stack[-1][1].append(env)
            stack[-1][2] = True
            env = dict(stack[-1][0])
        elif op == "close" and stack:
            env = close()
        elif target is None:
            continue
        elif op == "source":
            env = {**env, target: {t for t in tags or [] if t is not None}}
        elif op == "assign":
            env = {**env, target: got}
        elif op == "mutate":
            env = {**env, target: env.get(target, set()) | got}
        elif op == "sanitise":
            env = {**env, target: set()}
    while stack:
        env = close()
    return {v: sorted(t) for v, t in env.items() if t}


def test_branches(spark, monkeypatch):
    monkeypatch.setattr(branches, "BLOCK", 7)
    rng = random.Random(5)
    rows = []
    for f in range(60):
        for i in range(rng.choice([1, 4, 12, 30])):
            op = rng.choice(["source", "assign", "assign", "mutate", "sanitise", "open", "open", "else", "close", "close", "other"])
            target = None if op in ("open", "else", "close") or rng.random() < 0.05 else rng.choice("abcd")
            rows.append((f"f{f}", i, op, target, rng.choice([None, ["a"], ["b", "c"], ["d", "d"], []]), rng.choice([None, ["x"], ["y", "x"], ["z", None]])))
    rows += [("long", i, "source" if i == 0 else "assign", "ab"[i % 2], ["ab"[(i + 1) % 2]], ["x"]) for i in range(300)]
    odd = [(None, 1, "source", "a", None, ["x"]), ("none", None, "source", "a", None, ["x"])]
    got = {}
    for r in branches.branch_environment(spark.createDataFrame(rows + odd, EVENTS).repartition(3)).collect():
        got.setdefault(r.fn, {})[r.variable] = list(r.tags)
    fns = {r[0] for r in rows}
    assert got == {f: e for f in fns if (e := by_hand([r for r in rows if r[0] == f]))}
    assert got["long"] == {"a": ["x"], "b": ["x"]}


def test_branches_of_nothing(spark):
    assert branches.branch_environment(spark.createDataFrame([], EVENTS)).isEmpty()


def test_contexts(spark):
    rng = random.Random(3)
    rows = [(c, f"m{rng.randint(0, 5)}", rng.choice("pqr"), f"m{c % 6}", rng.choice("pqr")) for c in range(24) for _ in range(3)]
    caller = {c: m for c, m, *_ in rows}
    rows = [(c, caller[c], p, m, q) for c, _, p, m, q in rows]
    odd = [(90, None, "p", "m1", "p"), (91, "m0", "p", None, "p"), (92, "m0", None, "m1", "r")]
    seeds = [("m0", "p"), ("m0", "q"), ("m3", "r"), ("m3", None)]
    todo = [("m0", "", ("p", "q")), ("m3", "", ("r",))]
    want = set(todo)
    while todo:
        method, _, held = todo.pop()
        for c in {r[0] for r in rows if r[1] == method}:
            passed = tuple(sorted({q for k, _, p, _, q in rows if k == c and p in held}))
            new = (next(r[3] for r in rows if r[0] == c), method, passed)
            if passed and new not in want:
                want.add(new)
                todo.append(new)
    got = taint.interprocedural_contexts(spark.createDataFrame(rows + odd + rows[:3], "call long, caller string, caller_param string, method string, param string"), spark.createDataFrame(seeds, "method string, param string"))
    assert {(r.method, r.caller, tuple(r.seeds)) for r in got.collect()} == want
    flat = {(m, p) for m, _, held in want for p in held}
    assert {(r.method, r.param) for r in taint.interprocedural(spark.createDataFrame(rows, "call long, caller string, caller_param string, method string, param string"), spark.createDataFrame(seeds[:3], "method string, param string")).collect()} == flat


def test_phrases(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abAB é") for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(40)] + [(99, None), (3, "ab ab AB")]
    names = ["ab", "AB", "b a", "é", "aba", " ", "", None, "zz", "a" * 50]
    frame = spark.createDataFrame([(n,) for n in names], "phrase string")
    want = set()
    for i, t in texts:
        for w in {n.lower() for n in names if n}:
            at = [k for k in range(len(t or "")) if t.lower().startswith(w, k)]
            if at:
                want.add((i, w, len(at), at[0] + 1))
    for slice_chars in (1_000_000, 9):
        got = [tuple(r) for r in phrases.contained(spark.createDataFrame(texts, "id long, text string").repartition(3), frame, slice_chars).collect()]
        assert set(got) == want and len(got) == len(want)
    assert phrases.contained(spark.createDataFrame(texts, "id long, text string"), frame.limit(0)).isEmpty()
    a, b = ["Open SSL", "nginx", "", None, "x"], ["ssl", "nginx web server", "X", "none"]
    got = phrases.either_way(spark.createDataFrame([(v,) for v in a], "name string"), spark.createDataFrame([(v,) for v in b], "product string"))
    assert {tuple(r) for r in got.collect()} == {("open ssl", "ssl"), ("nginx", "nginx web server"), ("nginx", "x"), ("x", "nginx web server"), ("x", "x")}


def test_contexts_follow_each_set_of_a_method_once(spark, monkeypatch):
    # Callers further and further off pass the same on to one method, which calls the first of them again.
    rows = [(i, f"m{i}", "p", f"m{i + 1}", "p") for i in range(6)] + [(10 + i, f"m{i}", "p", "last", "q") for i in range(7)] + [(20, "last", "q", "m0", "p"), (21, "last", "q", "m0", "p")]
    sizes = []
    monkeypatch.setattr(taint.Runs, "add", lambda self, table, size: sizes.append(size) or self.tables.append(table))
    found = taint.interprocedural_contexts(spark.createDataFrame(rows, "call long, caller string, caller_param string, method string, param string"), spark.createDataFrame([("m0", "p")], "method string, param string")).collect()
    want = {("m0", "", "p"), ("m0", "last", "p")} | {(f"m{i + 1}", f"m{i}", "p") for i in range(6)} | {("last", f"m{i}", "q") for i in range(7)}
    assert {(r.method, r.caller, *r.seeds) for r in found} == want and len(found) == len(want)
    assert sum(sizes) == 8
