import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.llm.pii import KINDS, Bootstrap, find_personal_data
from tests.llm.docs import DOCS, ROWS, clashing

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PLAIN[k], text or "") if holds(k, m.group())]


def check(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i])
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def test_shapes_at_their_borders(spark):
    card = "4539 1488 0343 6467"
    check(spark, [
        "a@b.c_d@e.f x@y z@q.r. @p.q a..b@c-d.e.f", "é1@b.co🙂 2@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", f"{card} {card}", f"x{card}5 4539148803436467-", "4539--1488 0343 6467 12345678901234567890",
        "+1 (202) 555-0143 +12 +1234567 ++4912345678. +1-2", "5" * 5000, "1 " * 3000, "1." * 3000, "a" * 5000, "@" * 50, None, "", "4539148803436467\n4539148803436467",
    ])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab0123456789.@+-() é\n_%", max_size=60), min_size=20, max_size=40))
def test_shapes_on_any_text(spark, texts):
    check(spark, texts)


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"call me at: +1 202 555 01{i:02d} now", None, None, None) for i in range(12)]
    rows = [*seeds, (50, "call me at: 202 555 0199 now", None, None, None), (51, "built in 202 555 0199 now", None, None, None), (52, "version 2024.10.17.03 of 12345678", None, None, None)]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, DOCS), op=Bootstrap(confidence=0.7, belief=0.8)).collect()}
    assert got[50].spans == "phone:12:24" and got[50].n_phone == 0 and got[50].n_found == 1
    assert got[51].spans == "phone:9:21"  # a value once found counts wherever it stands
    assert got[52].spans == ""


def spans_of(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}


def test_many_unseen_values_and_patterns_of_the_second_generation(spark):
    seeds = [f"my tel: +1 202 555 01{i:02d} now" for i in range(20)]
    unseen = [f"my tel: 202 555 02{i:02d} now" for i in range(30)]
    again = [f"dial 202 555 02{i:02d} now" for i in range(12)]
    second = [f"dial 202 555 03{i:02d} now" for i in range(5)]
    other = [f"item 202 555 04{i:02d} now" for i in range(30)]
    got = spans_of(spark, seeds + unseen + again + second + other)
    assert [got[i] for i in range(20, 50)] == ["phone:8:20"] * 30
    assert [got[i] for i in range(50, 67)] == ["phone:5:17"] * 17
    assert [got[i] for i in range(67, 97)] == [""] * 30


def test_values_that_fail_the_check_speak_against_a_pattern(spark):
    digits = lambda i: f"4539{i:04d}88034364"
    luhn = lambda x: sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(x)))) % 10 == 0
    numbers = [digits(i) + f"{j:02d}" for i in range(5) for j in range(10)]
    got = spans_of(spark, [f"order {x} sent" for x in numbers])
    assert [got[i] != "" for i in range(len(numbers))] == [luhn(x) for x in numbers]


def test_awkward_documents(spark):
    out = find_personal_data(clashing(spark.createDataFrame(ROWS, DOCS))).collect()
    assert len(out) == len(ROWS) and all(r.n_found == 0 for r in out)
    assert find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def plain_bootstrap(found, op):
    """Belief by belief, over plain sets."""
    import math
    import re

    from strandwork.llm.pii import FITS

    def able(kind, value):
        if kind == 1:
            parts = value.replace(":", ".").rstrip(".").split(".")
            return len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)
        digits = [int(d) for d in re.sub("[^0-9]", "", value)][::-1]
        return kind != 2 or sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0

    edges = {(k, v, p) for k, left, v in found if left.strip() for p in {left.split()[-1], left.strip()}}
    graph = {}
    for k, v, p in edges:
        for kind in range(4):
            if k == kind:
                graph[p, kind, v] = (1, 1)
            elif k == -1 and re.search(FITS[KINDS[kind]], v):
                graph.setdefault((p, kind, v), (0, int(able(kind, v))))
    values = {p: len({v for _, v, q in edges if q == p}) for _, _, p in edges}
    sure, rest = {}, {}
    for _ in range(op.rounds):
        last, sure = sure, {}
        for p, kind in {x[:2] for x in graph}:
            own = {v: x for (q, k, v), x in graph.items() if (q, k) == (p, kind)}
            support, against = sum(s for s, _ in own.values()), values[p] - sum(a for _, a in own.values())
            held, n, spared = support, support, 0
            for v, (s, a) in own.items():
                if not s and (v, kind) in rest:
                    belief = 1 - math.exp(rest[v, kind] - (math.log1p(-last[p, kind]) if (p, kind) in last else 0))
                    if belief >= op.belief:
                        held, n, spared = held + belief, n + 1, spared + (0 if a else belief)
            if len(own) >= op.support and n >= op.support and held / (held + against - spared + 1) >= op.confidence:
                sure[p, kind] = held / (held + against - spared + 1)
        rest = {}
        for (p, kind, v), (s, _) in graph.items():
            if not s and (p, kind) in sure:
                rest[v, kind] = rest.get((v, kind), 0) + math.log1p(-sure[p, kind])
    best = {}
    for (v, kind), x in rest.items():
        if 1 - math.exp(x) >= op.belief:
            best[v] = min(best.get(v, (0, 9)), (-(1 - math.exp(x)), kind))
    return {v: kind for v, (_, kind) in best.items() if v not in {w for k, w, _ in edges if k >= 0}}


def test_graph_scores_are_those_of_plain_sets(spark):
    import random

    from strandwork.llm.pii import bootstrap

    rng, some = random.Random(4), 0
    numbers = [f"202 555 0{i}" for i in range(100, 160)] + [f"10.{i}.3.{i * 9}" for i in range(40)] + [f"4539{i:04d}88034364{i % 97:02d}" for i in range(40)]
    for _ in range(3):
        likes = {f"w{p}": rng.choice([numbers[:60], numbers[60:100], numbers[100:], numbers]) for p in range(12)}
        found = []
        for _ in range(700):
            word = rng.choice(list(likes))
            value = rng.choice(likes[word])
            kind = -1 if rng.random() < 0.4 else 3 if " " in value else 1 if "." in value else 2
            found.append((kind, rng.choice(["", "a ", "b "]) + word + " ", value))
        seeds = {v for k, _, v in found if k >= 0 and len(v) % 3 + int(v[-1]) % 3}  # a third of the values is never a seed
        found = [(k if v in seeds else -1, left, v) for k, left, v in found]
        for op in (Bootstrap(), Bootstrap(confidence=0.6, belief=0.7)):
            got = {r.value: r.kind for r in bootstrap(spark.createDataFrame(found, "kind int, left string, value string"), op).collect()}
            want = plain_bootstrap(found, op)
            assert got == want
            some += len(want)
    assert some > 30


def test_candidates_that_touch_fixed_matches_are_left_out(spark):
    import random

    from strandwork.llm.pii import matches

    rng = random.Random(5)
    spans = lambda n, kind: [(kind if kind < 0 else rng.randrange(4), a := rng.randrange(300), a + rng.randrange(1, 12), "l", "v") for _ in range(n)]
    rows = [(i, 7, spans(rng.randrange(12), 0), spans(rng.randrange(12), -1)) for i in range(60)] + [(None, 7, spans(5, 0), spans(9, -1))] * 2
    span = "array<struct<kind:int,start:int,end:int,left:string,value:string>>"
    got = matches(spark.createDataFrame(rows, f"id long, digest long, fixed {span}, loose {span}")).collect()
    want = [(i, d, *x) for i, d, fixed, loose in rows for x in fixed + [x for x in loose if all(y[1] >= x[2] or x[1] >= y[2] for y in fixed)]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
