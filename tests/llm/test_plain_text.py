import random
import unicodedata as ud

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm.plain_text import masked_rows, plain, with_plain_text

FAMILY = "👨‍👩‍👧"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Điện thoại", "Điện thoại"),
        (ud.normalize("NFD", "Nước rửa chén ồ ặ"), "Nước rửa chén ồ ặ"),
        ("Bột giột", "Bột giột"),
        ("ＳＥ　５１２Ｇ！", "SE 512G!"),
        ("a b c d", "a b c d"),
        ("fry­er​﻿", "fryer"),
        ("Ѕablе Κruphοsilon", "Sable Kruphosilon"),
        ("Новая модель ΝΕΟ ΜΟΝΤΕΛΟ", "Новая модель ΝΕΟ ΜΟΝΤΕΛΟ"),
        (FAMILY + " gia đình ™ ® 【x】", FAMILY + " gia đình ™ ® 【x】"),
        ("a‍b", "ab"),
        ("ðỏ Ðiện", "đỏ Điện"),
        ("tab\there\nline", "tab\there\nline"),
        ("КТ50977", "KT50977"),
        ("", ""),
        (None, None),
    ],
)
def test_forms(text, want):
    out, changed = plain(pa.array([text, "x"], pa.string()))
    assert out.to_pylist()[0] == want
    assert changed.tolist() == [text != want, False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aăâáảãạbcdđeêioôơuưy ̛̣̀́̂̃̆̉", max_size=12), min_size=1, max_size=6))
def test_composition_is_nfc(texts):
    out, _ = plain(pa.array(texts, pa.string()))
    assert out.to_pylist() == [ud.normalize("NFC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=6))
def test_idempotent(texts):
    once, _ = plain(pa.array(texts, pa.string()))
    twice, changed = plain(once)
    assert twice.to_pylist() == once.to_pylist() and not changed.any()


def test_table(spark):
    rows = [(1, "ｂộｔ", "x"), (2, None, "x"), (3, "", None), (3, "bột", "x"), (3, "a b" * 100_000, "x")]
    df = spark.createDataFrame(rows, "crawl_id long, name string, changed string")
    got = {(r["crawl_id"], r["plain"] if r["plain"] is None else r["plain"][:4], r["changed"]) for r in with_plain_text(df, "name").collect()}
    assert got == {(1, "bột", True), (2, None, False), (3, "", False), (3, "bột", False), (3, "a ba", True)}
    assert [tuple(r) for r in masked_rows(df, "t", "crawl_id", "name").orderBy("row_id").collect()] == [("t", "1"), ("t", "3")]
    assert with_plain_text(df.limit(0), "name").count() == 0


def test_rows_do_not_mix():
    texts = ["e", "́a", "ô", "́", "ab"]
    random.seed(1)
    out, _ = plain(pa.array(texts, pa.string()))
    assert out.to_pylist() == ["e", "́a", "ô", "́", "ab"]


def test_selectors_fillers_ligatures_and_syllables():
    """What shows nothing goes, but not from emoji; ligatures, numerals, blanks and conjoining letters become what they look like."""
    cases = {
        "a\ufe0fb": "ab", "ca\u180bfe": "cafe", "x\u3164y\u115f": "xy", "a\u2800b": "a b", "\ufb01lter": "filter", "Pro \u2163 x": "Pro IV x", "\u13aabc": "Abc", "\u1112\u1161\u11ab\u1100\u116e": "\ud55c\uad6c", "o\u034f\u0302": "ô",
        "\u2764\ufe0f x": None, "1\ufe0f\u20e3": None, "👨\u200d👩": None, "\ud55c\uad6d": None, "\u13a0\u13c2\u13f4\u13eb": None, "fi": None, "": None,
    }
    out, changed = plain(pa.array(list(cases)))
    assert out.to_pylist() == [v if v is not None else k for k, v in cases.items()]
    assert changed.tolist() == [v is not None for v in cases.values()]
    both, _ = plain(pa.array(["\u1112", "\u1161", "\ufb03"]))
    assert both.to_pylist() == ["\u1112", "\u1161", "ffi"]
