import itertools
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.cooccurrence import associated, cooccurrence, latest_baskets
from tallyloom.llm.repetition import covered, measure, norm, norms, repeated_length, repeated_starts, repetition_cases, repetition_shares


def brute_covered(words, n):
    seen, hit = set(), set()
    for i in range(len(words) - n + 1):
        run = tuple(words[i : i + n])
        if run in seen:
            hit |= set(range(i, i + n))
        seen.add(run)
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 5))
def test_coverage_equals_brute_force(words, n):
    codes = np.array(words, dtype=np.int64)
    for length, starts in repeated_starts(codes, (n, 2 * n, 4 * n)).items():
        assert covered(codes, starts, length) == brute_covered(words, length)


def test_coverage_with_hashes_that_collide(monkeypatch):
    monkeypatch.setattr("tallyloom.llm.repetition._BASE", np.uint64(0))
    rng = random.Random(3)
    words = [rng.randint(0, 2) for _ in range(60)]
    codes = np.array(words, dtype=np.int64)
    for length, starts in repeated_starts(codes, (2, 4, 8)).items():
        assert covered(codes, starts, length) == brute_covered(words, length)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB.!? \n\r\x01é1İΣ中")), max_size=40))
def test_norms_of_parts_equal_norms_of_their_texts(text):
    def plain(said):
        return " ".join("".join(c if c.isalpha() else " " for c in said.lower()).split())

    lines, sentences, words = norms(text)
    clean = text.replace("\x01", " ")
    assert lines == [plain(x) for x in clean.split("\n")] and words == plain(clean).split()
    assert sentences == [plain(x) for x in re.split(r"(?<=[.!?])(?=\s)", clean)]


def test_norm_and_units():
    assert norm("  Ab-c1D\n É! ") == "ab c d é" and norm("12 3") == ""
    assert repeated_length(norms("A b.\n\na  B\n12\nc")[0]) == (3, 7)
    n, *_ = measure("")
    assert n == 0 and measure("one two")[0] == 2


def brute_cases(body, titles):
    words = norm(body).split()
    out = set()
    if len(words) < 30:
        return out
    for unit, parts in (("line", body.split("\n")), ("sentence", re.split(r"(?<=[.!?])(?=\s)", body))):
        norms = [n for n in map(norm, parts) if n]
        again = sum(len(n) for i, n in enumerate(norms) if n in norms[:i])
        if norms and 4 * again >= sum(map(len, norms)):
            out.add(unit)
    if 10 * brute_covered(words, 8) >= 3 * len(words):
        out.add("phrase")
    if len(titles) >= 3 and 4 * sum(norm(t) in [norm(x) for x in titles[:i]] for i, t in enumerate(titles)) >= len(titles):
        out.add("title")
    return out


def test_cases_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "seal drain merge the call graph of every build and note it".split()
    bodies, sections, want = [], [], set()
    for k in range(40):
        pool = [" ".join(rng.choices(vocabulary, k=rng.randint(2, 9))).capitalize() + rng.choice(".!?") for _ in range(rng.randint(2, 9))]
        body = rng.choice(["\n", " ", "\r\n"]).join(rng.choices(pool, k=rng.randint(1, 14)))
        titles = [rng.choice(["Scope", "scope 2", "Inputs", "Ends"]) for _ in range(rng.randint(0, 5))]
        bodies += [(k, body, None)] * rng.randint(1, 2)
        sections += [(k, i, None, t, 1) for i, t in enumerate(titles) for _ in range(rng.randint(1, 2))]
        want |= {(k, u) for u in brute_cases(body, titles)}
    assert {u for _, u in want} == {"line", "sentence", "phrase", "title"}
    bodies += [(90, None, None), (91, "", None), (None, "a " * 80, None)]
    b = spark.createDataFrame(bodies, "body_id bigint, body string, repeat_unit string")
    s = spark.createDataFrame([*sections, (None, 0, None, "x", 1), (90, 0, None, None, 1)], "body_id bigint, ord int, section_id string, title string, line int")
    got = [tuple(r) for r in repetition_cases(b, s).collect()]
    assert set(got) == want and len(got) == len(want)
    assert repetition_shares(b).where("body_id = 91").first()["line_share"] == 0.0
    assert repetition_cases(b.limit(0), s.limit(0)).collect() == []


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    records = [(f"r{k}", rng.sample("abcdefgh", rng.randint(0, 6)), k) for k in range(120)]
    rows = [(i, None if not t and rng.random() < 0.5 else [rng.choice([x, f" {x.upper()} "]) for x in t] + rng.choice([[], [None, " "], t[:1]]), at, "clash") for i, t, at in records]
    rows += rng.choices(rows, k=20) + [(None, ["a", "b"], 1, "x"), ("r0", ["z"], -5, "x")]
    df = spark.createDataFrame(rows, "id string, tags array<string>, ingested_at int, tag_a string").repartition(5)
    sets = [set(t) for _, t, _ in records]
    n = len(sets)
    got = {(r["tag_a"], r["tag_b"]): r for r in cooccurrence(latest_baskets(df)).collect()}
    want = {}
    for a, b in itertools.combinations("abcdefgh", 2):
        both = sum(a in s and b in s for s in sets)
        if both:
            want[a, b] = (both, sum(a in s for s in sets), sum(b in s for s in sets), n)
    assert {k: (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for k, r in got.items()} == want
    (a, b), (k, x, y, n) = next(iter(want.items()))

    def h(*counts):
        return sum(c * math.log(c / sum(counts)) for c in counts if c)

    llr = 2 * (h(k, x - k, y - k, n - x - y + k) - h(x, n - x) - h(y, n - y))
    assert abs(abs(got[a, b]["llr"]) - llr) < 1e-6
    cases = {tuple(r) for r in associated(cooccurrence(latest_baskets(df)), least=2, support=2000, lift=1, ratio=float("-inf")).collect()}
    assert cases == {p for p, (k, x, y, n) in want.items() if k >= 2 and 2000 * k >= n and k * n >= x * y}
    assert cooccurrence(latest_baskets(df.limit(0))).collect() == []


def test_a_very_long_basket(spark):
    df = spark.createDataFrame([("r", [f"t{k}" for k in range(300)], 1)], "id string, tags array<string>, ingested_at int")
    assert cooccurrence(latest_baskets(df)).count() == 300 * 299 // 2
