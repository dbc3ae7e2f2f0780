import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.bpe import DEFAULT_VOCABULARY, Encoder, Vocabulary
from tallyloom.llm.encoding import encode, token_counts
from tallyloom.llm.packing import balance, pack, pack_documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(DEFAULT_VOCABULARY, encoding="utf-8") as f:
        return Encoder(Vocabulary(f.read()))


def same(encoder, reference, text):
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.count(text) == len(encoder.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r  　​abzAZ019'.,!?-_éß̈’²½Ⅷ中😀\x1c\x85")), max_size=40))
def test_equals_the_public_library(text):
    same(_enc(), _ref(), text)


def _enc(cache=[]):  # noqa: B006
    if not cache:
        with open(DEFAULT_VOCABULARY, encoding="utf-8") as f:
            cache.append(Encoder(Vocabulary(f.read())))
    return cache[0]


def _ref(cache=[]):  # noqa: B006
    if not cache:
        cache.append(tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY))
        cache[0].encode_special_tokens = True
    return cache[0]


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "don't we'll I'M", "a\n b", "a \nb", "a\n \nb", "x  y   z"])
def test_odd_texts(encoder, reference, text):
    same(encoder, reference, text)


def test_encode_defines_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello world", 5), (3, "Hello world", 5)], "doc_id bigint, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in encode(df).collect()]
    assert sorted(got) == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert dict(encode(df).dtypes)["ids"] == "array<int>"
    assert sorted(r[1] for r in token_counts(df).collect()) == [0, 0, 2, 2]
    assert encode(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_pack_never_overfills_and_wastes_little(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 256, 1000])
    sizes = [min(capacity, int(rng.lognormvariate(3, 1))) for _ in range(800)]
    where = pack(sizes, capacity)
    load = {}
    for s, k in zip(sizes, where):
        load[k] = load.get(k, 0) + s
    assert max(load.values()) <= capacity
    assert sum(sizes) / (capacity * len(load)) > 0.97
    assert where == pack(sizes, capacity)


def test_pack_edges():
    assert pack([], 8) == [] and pack([0, 0], 8) == [0, 0]
    assert len(set(pack([8, 8, 8], 8))) == 3
    # the cheapest sequence is taken: two long ones are kept apart
    a, b, c = pack([60, 60, 10], 100, snug=0)
    assert a != b


def test_documents_are_cut_only_above_the_capacity(spark):
    texts = [(k, " word" * n) for k, n in enumerate([1, 5, 20, 21, 64, 65, 0, 3])] + [(99, None), (None, " word")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    windows = spark.createDataFrame([("w", 20), ("w", 20), ("v", 64), ("bad", 0)], "window_id string, capacity_tokens int")
    rows = pack_documents(docs, windows).collect()
    for window, capacity in (("w", 20), ("v", 64)):
        mine = [r for r in rows if r["window_id"] == window]
        loads, pieces = {}, {}
        for r in mine:
            loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["n_tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
        assert max(loads.values()) <= capacity
        for k, n in enumerate([1, 5, 20, 21, 64, 65, 0, 3]):
            spans = sorted(pieces[k])
            assert sum(s for _, s in spans) == n and [f for f, _ in spans] == [i * capacity for i in range(len(spans))]
            assert n > capacity or len(spans) == 1
        assert pieces[99] == [(0, 0)] and None not in pieces
    assert {r["window_id"] for r in rows} == {"w", "v"}
    assert pack_documents(docs.limit(0), windows).collect() == [] and pack_documents(docs, windows.limit(0)).collect() == []


def test_rows_of_one_id_never_overfill_a_sequence(spark):
    text = " a" * 25
    rows = pack_documents(spark.createDataFrame([(1, text), (1, text), (1, text + " b"), (1, " a" * 20)], "doc_id bigint, text string"), spark.createDataFrame([("w", 20)], "window_id string, capacity_tokens int")).collect()
    loads = {}
    for r in rows:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["n_tokens"]
    assert max(loads.values()) == 20 and sum(loads.values()) == 25 + 25 + 26 + 20
    spread = balance(spark.createDataFrame(rows)).first()
    assert spread["sequences"] == len(loads) and spread["least_cost"] <= spread["mean_cost"] <= spread["greatest_cost"]
