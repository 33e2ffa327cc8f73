"""Surrogates of other scripts, long values, names in context; the query against a plain loop."""

import re

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import pii
from weftgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "value",
    ["李明@公司.cn", "שלום@דוגמה.il", "محمد@مثال.sa", "ああ@カタカナ.jp", "%%@example.com", "Đặng.Văn@example.org", "a" * 5000 + "@example.com", "x.y@" + "z" * 60 + ".example.net"],
)
def test_emails_of_any_script_and_length_change(value):
    surrogates = pii.Surrogates()
    text = f"see {value} or else"
    new, entities = pii.replace(text, surrogates)
    assert [text[s:e] for _, s, e, *_ in entities] == [value]
    assert entities[0][3] != value and value not in new and new.startswith("see ") and new.endswith(" or else")
    assert entities[0][3].count("@") == 1 and pii.replace(text, pii.Surrogates())[0] == new
    local = value.partition("@")[0]
    assert local not in new


def test_letters_of_other_scripts_are_permuted_within_their_class():
    surrogates = pii.Surrogates()
    seen = {surrogates("family", chr(c) + "明") for c in range(0x4E00, 0x4E80)}
    assert len(seen) == 128 and all("CJK" in __import__("unicodedata").name(x[0]) for x in seen)


def test_digits_of_other_scripts():
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    plain, _ = pii.replace("call +1 (415) 555-2671 now", pii.Surrogates())
    found, entities = pii.replace("call +1 (415) 555-2671 now".translate(arabic), pii.Surrogates())
    assert entities and found == plain.translate(arabic)


def test_cards_need_a_check_digit_an_issuer_or_groups():
    assert not pii.detect("order 12345678901234567 shipped")
    for card in ("4111111111111111", "4111111111111112", "5500005555555559", "9999 8888 7777 6666", "79927398713000"):
        assert [k for *_, k in pii.detect(f"pay {card} now")] == (["card"] if card != "79927398713000" else [])


def test_names_in_context():
    for text, names in {
        "Hello, my name is Priya Sharma and Sharma is my family's": ["Priya", "Sharma", "Sharma"],
        "Best regards,\nAhmed Khan": ["Ahmed", "Khan"],
        "Dr Đặng will see you": ["Đặng"],
        "the company's name is not for sale": [],
        "Je m'appelle Zoë d'Arcy": [],
    }.items():
        assert [text[s:e] for s, e, _ in pii.detect(text)] == names


def test_query_against_a_plain_loop(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op1_pii_surrogates"](spark, SF).collect()
    assert len(found) == len(docs)
    surrogates, entity_of = pii.Surrogates(), {}
    for r in found:
        text = docs[r.doc_id]
        spans = pii.detect(text) if text is not None else []
        out, at = [], 0
        for s, e, kind in spans:
            out += [text[at:s], surrogates(kind, text[s:e])]
            assert out[-1] != text[s:e]
            assert entity_of.setdefault((kind, out[-1].lower()), text[s:e].lower()) == text[s:e].lower()
            at = e
        assert r.text == (None if text is None else "".join(out) + text[at:]) and r.n_entities == len(spans) and r.collisions == 0
        if text:
            assert not re.search(r"[\w.]+@mail\d\.example\.com", r.text) or "@" in text


def test_collisions_are_counted_for_each_row(spark):
    one = [("phone", 0, 1, "11-22", "a")]
    rows = [(1, one), (2, [("phone", 0, 1, "1122", "b"), ("card", 0, 1, "1122", "b")]), (3, [])]
    df = spark.createDataFrame(rows, f"doc_id int, entities {pii._ENTITIES}")
    assert sorted((r.doc_id, r.collisions) for r in pii.with_collisions(df).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert [r.collisions for r in pii.with_collisions(df.filter(F.col("doc_id") > 1)).collect()] == [0, 0]
