import pyarrow as pa
import pytest

from tallyloom.llm.pii import Lexicon, find, fold, personal_information, promising, sanitise, sanitised, wrapped_name

LEX = Lexicon({"jorvik", "zelda", "will", "dawn", "søril"}, {"kelwick", "munström", "price", "holberg"}, {"will", "price", "dawn"}, {"<ask please", "<reported by", ">am abend"}, {"<call us"}, {"hour"}, {"price"}, {"des trois lanternes"})


def found(line):
    return {(k, line[a:b]) for k, a, b in find(line, LEX)}


@pytest.mark.parametrize(
    "line, want",
    [
        ("mail to a.b+c@mail.example, not user@localhost", {("email", "a.b+c@mail.example")}),
        ("x (at) desk (dot) invalid or y[at]post[dot]test", {("email", "x (at) desk (dot) invalid"), ("email", "y[at]post[dot]test")}),
        ("To: r-oncall AT eu DOT office DOT example; z @ mail.example", {("email", "r-oncall AT eu DOT office DOT example"), ("email", "z @ mail.example")}),
        ("Package grid-tape@4.7.5 and ssh deploy@build-06, use @probe.fixture", set()),
        ("call +44 7700 900589 or (202) 555-0105.", {("phone", "+44 7700 900589"), ("phone", "(202) 555-0105")}),
        ("020 7946 0008, 030/23125-637, 0049 30 23125 822, 07700 900423", {("phone", "020 7946 0008"), ("phone", "030/23125-637"), ("phone", "0049 30 23125 822"), ("phone", "07700 900423")}),
        ("+33 (0)1 99.00.65.06 and 512.555.0110 and 01 99 00 95 18", {("phone", "+33 (0)1 99.00.65.06"), ("phone", "512.555.0110"), ("phone", "01 99 00 95 18")}),
        ("Part no. 1511-43-7290, Invoice 00787-555-AB, 10.6.2.110, Serial 4239-2187-8456-6911, 555 to 0193, 2025-03-13 10:21:34", set()),
        ("id QQ 31 95 02 C, QQ520884D, 906-47-9000, 951 57 4230, H51X48964, 91 605 722 930, 991443-5197, K63405730", {("identity", x) for x in ("QQ 31 95 02 C", "QQ520884D", "906-47-9000", "951 57 4230", "H51X48964", "91 605 722 930", "991443-5197", "K63405730")}),
        ("at 244c Dunmarrow Terrace, 812 W. Umberleigh Close and 647 Old Quillow Way", {("address", "244c Dunmarrow Terrace"), ("address", "812 W. Umberleigh Close"), ("address", "647 Old Quillow Way")}),
        ("Nebelweg 16a, Kranichstr. 158, Calle Olmo Viejo 72, Avenida Molino Seco, 167", {("address", "Nebelweg 16a"), ("address", "Kranichstr. 158"), ("address", "Calle Olmo Viejo 72"), ("address", "Avenida Molino Seco, 167")}),
        ("33 bis, avenue des Tilleuls-Gris We, 84, place des Trois Lanternes Avant, 123 rue de la Grive The", {("address", "33 bis, avenue des Tilleuls-Gris"), ("address", "84, place des Trois Lanternes"), ("address", "123 rue de la Grive")}),
        ("24 Hour Street Team, 988 Lane merges, 2 Way handshakes, Vale Drive is a disk", set()),
        ("Jorvik Kelwick met ZELDA KELWICK, Kelwick, Zelda, zelda kelwick and J. Kelwick.", {("name", "Jorvik Kelwick"), ("name", "ZELDA KELWICK"), ("name", "Kelwick, Zelda"), ("name", "zelda kelwick"), ("name", "J. Kelwick")}),
        ("Will von Holberg, Zelda K. Price, Dawn Holberg-Kelwick's", {("name", "Will von Holberg"), ("name", "Zelda K. Price"), ("name", "Dawn Holberg-Kelwick")}),
        ("Jorvik Mu" + "nström and Söril", {("name", "Jorvik Munström")}),
        ("Mark the page, will you price it; dawn price; Price Ledger; will price", set()),
        ("Please ask Zelda Unknownson before, Reported by Q. Neverseen", {("name", "Zelda Unknownson"), ("name", "Q. Neverseen")} - {("name", "Zelda Unknownson")}),
        ("jorvik.kelwick@mail.example", {("email", "jorvik.kelwick@mail.example")}),
        ("call us 2025550105 or 2025550105x", set()),
    ],
)
def test_lines(line, want):
    if "Neverseen" in line:
        assert ("name", "Q. Neverseen") in found(line)
    elif "call us" in line:
        assert found("call us 2025550105 now") == {("phone", "2025550105")} and found("item 2025550105 now") == set()
    else:
        assert found(line) == want
    # the cheap test keeps back nothing that is found
    if found(line):
        assert promising(pa.array([line]), LEX)[0].to_pylist() == [True]


@pytest.mark.parametrize(
    "line, want",
    [
        ("000-00-0000 and 906-47-0000 and 906-47-9000", {("identity", "906-47-9000")}),
        ("build A12345678, ticket B12345678, Order no C12345678 and passport D12345678", {("identity", "D12345678")}),
        (f"Donau{'auen' * 30}straße 12 and 7 {'Long' + 'er' * 60} {'Wide' + 'er' * 60} Road", {("address", f"Donau{'auen' * 30}straße 12"), ("address", f"7 {'Long' + 'er' * 60} {'Wide' + 'er' * 60} Road")}),
        (f"met {'Un' + 'known' * 30}, Jorvik", set()),
    ],
)
def test_things_zeros_and_long_words(line, want):
    assert found(line) == want


def test_names_cut_by_line_ends():
    for line, following, want in [("met Jorvik", "Kelwick today", "Jorvik\nKelwick"), ("see Zelda K.\r", "  Kelwick.", "Zelda K.\r\n  Kelwick"), ("by Kelwick,", "Jorvik", "Kelwick,\nJorvik")]:
        start, end = wrapped_name(line, following, LEX)
        assert f"{line[start:]}\n{following[:end]}" == want
        assert sanitise(f"{line}\n{following}", LEX) == f"{line}\n{following}".replace(want, "[NAME]")
    for line, following in [("met Jorvik", ""), ("jorvik", "kelwick"), ("so Will", "Price it"), ("Jorvik and", "Kelwick"), ("Jorvik.", "Kelwick")]:
        assert wrapped_name(line, following, LEX) is None


def test_very_many_name_parts():
    letters = "abcdefghij"
    many = {"".join(letters[int(d)] for d in f"{k:06d}") + "son" for k in range(200_000)}
    lexicon = Lexicon({"jorvik"}, many)
    assert find("Jorvik Aaaaabson left", lexicon) == [("name", 0, 16)]
    assert promising(pa.array(["Jorvik Aaaaabson left", "nobody here"]), lexicon)[0].to_pylist() == [True, False]


def test_a_lexicon_joined_in_blocks_gives_the_same(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, parts = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/name_parts.parquet")
    whole, clean = sorted(map(tuple, personal_information(docs, parts).collect())), sorted(map(str, sanitised(docs, parts).collect()))
    monkeypatch.setattr("tallyloom.llm.pii.LEXICON_TERMS", 0)
    monkeypatch.setattr("tallyloom.llm.pii.BLOCK_DOCUMENTS", 30)
    assert whole and sorted(map(tuple, personal_information(docs, parts).collect())) == whole
    assert sorted(map(str, sanitised(docs, parts).collect())) == clean


def test_fold_and_sanitise():
    assert fold("SÖRIL") == fold("söril")
    assert sanitise("Ask Jorvik Kelwick\nor a@b.example", LEX) == "Ask [NAME]\nor [EMAIL]"
    assert sanitise(None, LEX) is None and sanitise("", LEX) == ""


def test_unknown_parts_are_learnt_from_the_corpus(spark):
    known = ["Berg", "Croft", "Dale", "Fen", "Holt"]
    texts = [f"Reported by Jorvik {f}son during the night shift." for f in known] + [f"Reported by Newgiven {f}son during the night shift." for f in known]
    texts += [f"Because Falcon {x} was late. Nothing happened." for x in ("router", "ledger", "cache")] * 5
    texts += ["Thanks to Jorvik Newfam for all.", "Thanks to Zelda Newfam for all.", "Thanks to Newgiven Newfam for all."]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(99, None, None), (98, "", None), (0, texts[0], "clash")], "doc_id bigint, text string, pii_kind string")
    parts = spark.createDataFrame([("Jorvik", "given"), ("Zelda", "given"), (None, "given"), (" ", "family"), *[(f"{f}son", "family") for f in known]], "name_part string, part_role string")
    got = {(r["doc_id"], r["pii_text"]) for r in personal_information(docs, parts).collect()}
    want = {(k, f"{g} {f}son") for k, (g, f) in enumerate((g, f) for g in ("Jorvik", "Newgiven") for f in known)} | {(25, "Jorvik Newfam"), (26, "Zelda Newfam"), (27, "Newgiven Newfam")}
    assert got == want
    clean = {r["doc_id"]: r["text"] for r in sanitised(docs, parts).collect()}
    assert clean[27] == "Thanks to [NAME] for all." and clean[99] is None and clean[98] == ""
    assert personal_information(docs.limit(0), parts).collect() == [] and personal_information(docs.where("doc_id = 25"), parts.limit(0)).collect() == []


def test_a_person_named_often_and_in_copies_is_still_found(spark):
    texts = [f"Reported by Jorvik {f}son during the night shift {k}." for k, f in enumerate(["Berg", "Croft", "Dale"] * 3)]
    texts += ["Zelda Jardotter wrote this.", "We thank Zelda Jardotter.", "Once Zelda Jardotter left.", *["A copy by Zelda Jardotter here."] * 9]
    texts += [f"Reported by Zelda Often during the night shift {k}." for k in range(12)]
    texts += [f"Dawn {w} {k} went red." for k, w in enumerate(["Cycle"] * 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = spark.createDataFrame([("Jorvik", "given"), ("Zelda", "given"), ("Dawn", "given"), *[(f"{f}son", "family") for f in ("Berg", "Croft", "Dale")]], "name_part string, part_role string")
    got = {(r["doc_id"], r["pii_text"]) for r in personal_information(docs, parts).collect()}
    assert got == {(k, f"Jorvik {f}son") for k, f in enumerate(["Berg", "Croft", "Dale"] * 3)} | {(k, "Zelda Jardotter") for k in range(9, 21)} | {(k, "Zelda Often") for k in range(21, 33)}


def test_an_address_stated_often_is_still_found(spark):
    texts = ["Send it to 12 Quillow Lane by noon."] * 6 + [f"Batch {k}: deliver to 7 Umber Road by noon." for k in range(8)] + ["Then deliver to 9 Vale Road by noon."]
    texts += [f"Case {k}: open the 24 Hour Street Team channel." for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = spark.createDataFrame([("Jorvik", "given")], "name_part string, part_role string")
    got = {(r["doc_id"], r["pii_text"]) for r in personal_information(docs, parts).collect()}
    assert got == {(k, "12 Quillow Lane") for k in range(6)} | {(k, "7 Umber Road") for k in range(6, 14)} | {(14, "9 Vale Road")}
