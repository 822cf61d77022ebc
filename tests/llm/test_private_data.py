"""Personal data: base spans against the plain rules, and what the method adds."""

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_helpers import documents, edge_rows, empty_documents, sentence
from shiftspark.llm import private_data as P

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check(spark, texts):
    """Base spans of ``texts`` (by place) are those of the rules; all spans hold them. Returns what was added."""
    got = {r.doc_id: r for r in P.private_data(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    added = {}
    for i, t in enumerate(texts):
        want, r = base_spans(t or ""), got[i]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        spans = [(int(s), P.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and set(want) <= set(spans)
        added[i] = [(P.KINDS[k], t[s:e]) for s, k, e in spans if (s, k, e) not in want]
        assert len(added[i]) == r.n_added
        assert all(e <= s2 or s >= e2 for s, k, e in spans if (s, k, e) not in want for s2, _, e2 in want)
    return added


CASES = [
    None, "", "a@b.c", "a@b", "x a.b+c@d-e.f.g. y@z.q", "a@b.c+x@d.e", "a@b.c@d.e", "@a.b", "..@a.b", "é@a.b a@é.b", "a@-.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.2.3.4.5.6.7", "01.002.0003.255", "1.2.3.256 0.0.0.0", "1.2.3", "0" * 50 + "9.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "4111111111111112", "12--34", "4111 1111 1111 1111 5", "-4111111111111111-",
    "411111111111 1111", "3782 822463 10005", "0" * 12, "0" * 19, "0" * 20, "1 2 3 4 5 6 7 8 9 0 1 2 8", "a4111111111111111b",
    "+1 (743) 555-3824", "+49 30 123456 ", "+1", "+12345678", "+123456789", "+1234567890123456", "+1 2 3 4 5 6 7 8 9)(.-", "++1 23456789", "+12345678+123456789",
    "日本 +1 743 555 3824 🎉 a@b.io 🎉 10.0.0.1", "🎉" * 5 + "1.1.1.1", "ip 1.2.3.4, mail x@y.zz; call +1 743 555 3824!",
]


def test_base_spans_of_cases_and_random_texts(spark):
    r = random.Random(1)
    parts = ["4111", "1111", "12", "0", "255", "256", ".", ".", "-", " ", " ", "@", "a", "b.c", "+", "+1", "(", ")", "é", "\n", "x@y.z", "1.1.1.1", "5500 0000 0000 0004", "%", ":"]
    check(spark, CASES + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(1500)])


def test_long_runs_take_no_recursion_and_no_square_time(spark):
    n = 200_000         # the plain rules would take hours here, so results are stated
    many = " ".join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(1500))
    cases = [("7" * n, 0), ("1 " * n, 0), ("a" * n, 0), ("a@" * (n // 2), 0), ("+1" + "(" * n, 0), ("1." * 2000, 500), ("+" * n, 0),
             ("x at " * (n // 5), 0), ("1:" * n, 0), (many, 1500), ("word " * n + "z@z.zz", 1)]
    got = P.private_data(documents(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(cases)])).collect()
    assert {r.doc_id: r.n_email + r.n_ip + r.n_card + r.n_phone for r in got} == {i: c for i, (_, c) in enumerate(cases)}
    spans = {r.doc_id: r.spans for r in got}
    assert spans[10] == f"email:{5 * n}:{5 * n + 6}" and spans[9] == listed(base_spans(many))


def test_sums_before_each_number(spark):
    numbers = F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda i: (i % 7).cast("int"))
    got = spark.range(1).select(P.sums_before(numbers).alias("x")).first().x
    assert got == [sum(j % 7 for j in range(i)) for i in range(3001)]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789 .-@+()aé🎉:", max_size=60), min_size=200, max_size=200))
def test_base_spans_of_any_text(spark, texts):
    check(spark, texts)


def test_edge_rows_and_empty_table(spark):
    df = documents(spark, edge_rows())
    got = P.private_data(df).collect()
    assert len(got) == len(edge_rows()) and {r.spans for r in got} == {""}
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert P.private_data(empty_documents(spark)).collect() == []


def corpus(seed, n):
    """Texts with personal data in and out of reach of the base rules, and numbers that are none."""
    r = random.Random(seed)

    def d(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + d(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def broken():
        c = card()
        return c[:-1] + str((int(c[-1]) + 1) % 10)

    forms = {
        "base": [lambda: f"call +1 ({r.randint(200, 999)}) 555-{d(4)} now", lambda: f"mail {sentence(r.random(), 1)}@mail{r.randint(1, 9)}.example.com today",
                 lambda: f"pay by card {card()} please", lambda: f"from host 10.{r.randint(0, 255)}.3.{r.randint(1, 255)} we"],
        "more": [lambda: f"call ({r.randint(200, 999)}) 555-{d(4)} now", lambda: f"tel {r.randint(200, 999)}-{r.randint(200, 999)}-{d(4)} now",
                 lambda: f"mail {sentence(r.random(), 1)} (at) mail{r.randint(1, 9)} (dot) com today"],
        "none": [lambda: f"order {d(1)}99-{d(3)}-{d(4)} came", lambda: f"serial {broken()} built", lambda: f"at 12:{r.randint(10, 59)}:{r.randint(10, 59)} we"],
    }
    out = []
    for _ in range(n):
        kind = r.choices(["base", "more", "none", "clean"], [4, 2, 3, 3])[0]
        middle = r.choice(forms[kind])() if kind != "clean" else "look at home. Then rest"
        out.append((kind, f"{sentence(r.random(), r.randint(3, 20))} {middle} {sentence(r.random(), r.randint(3, 20))}"))
    return out


def test_method_adds_wider_spans_and_leaves_other_numbers(spark):
    made = corpus(7, 700)
    added = check(spark, [t for _, t in made])
    by_kind = {k: [i for i, (kind, _) in enumerate(made) if kind == k] for k in ("base", "more", "none", "clean")}
    caught = sum(bool(added[i]) for i in by_kind["more"]) / len(by_kind["more"])
    wrong = sum(bool(added[i]) for k in ("none", "clean", "base") for i in by_kind[k])
    assert caught >= 0.9 and wrong <= 2, (caught, wrong)


def test_result_does_not_depend_on_partitions(spark):
    df = documents(spark, [(i, t, "en", "a") for i, (_, t) in enumerate(corpus(8, 120))])
    one, many = (sorted(map(tuple, P.private_data(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_expectation_maximisation_finds_reliabilities():
    r = random.Random(2)
    good, rows = {"+": 0.85, "0": 0.1, "-": 0.05}, {}
    for _ in range(4000):
        yes = r.random() < 0.3
        votes = "".join(r.choices("+0-", [good["+"], good["0"], good["-"]] if yes else [0.1, 0.1, 0.8])[0] if i < 4 else r.choice("+0-") for i in range(5))
        rows[votes] = rows.get(votes, 0) + 1
    posterior, share, table = P.reliabilities(sorted(rows.items()))
    assert share == pytest.approx(0.3, abs=0.03)
    for i in range(4):
        assert table[i]["yes"]["+"] == pytest.approx(0.85, abs=0.05) and table[i]["no"]["-"] == pytest.approx(0.8, abs=0.05)
    assert table[4]["yes"]["+"] == pytest.approx(1 / 3, abs=0.06)           # a labeler that tells nothing
    assert posterior["+++++"] > 0.99 and posterior["-----"] < 0.01


def test_no_candidates_keep_the_prior_beliefs():
    posterior, share, table = P.reliabilities([])
    assert posterior == {} and share == 0.5
    for t, (yes, no) in zip(table, P.BELIEFS.values()):
        assert t["yes"] == pytest.approx(yes) and t["no"] == pytest.approx(no)


def test_main_path_has_no_python(spark, tmp_path):
    df = P.private_data(documents(spark, [(1, "a@b.c", "en", "a")], extra=False))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
